"""sediment: ordered, versioned key-value analytics expressed on Spark DataFrames."""
from sediment.model import EngineConfig, PUT, TOMBSTONE

__all__ = ["EngineConfig", "PUT", "TOMBSTONE"]
