"""sediment.llm"""
