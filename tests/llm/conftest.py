import pytest

ROWS = [
    (5, "The quick brown fox jumps over the lazy dog, again and again.", "en", "a"), (3, "", "en", "a"), (1, None, None, None), (7, " \t\n ", "fr", "b"),
    (9, "The quick brown fox jumps over the lazy dog, again and again.", "en", "b"), (9, "The quick brown fox jumps over the lazy dog, again and again.", "en", "b"),
    (None, "nobody's text: Éa ñu ß 日本", "de", "c"), (11, "word " * 9000, "en", "a"), (13, "one", "en", "a"), (15, "one two", "es", "d"),
    (17, "A tab\tand\x0bvertical\x0cfeed   nbsp <|endoftext|> it's 12 !! $$$", "en", "a"), (19, "THE QUICK brown fox", "en", "a"), (21, "x" * 3000, "en", "a"),
]


@pytest.fixture
def odd(spark):
    """Documents with nulls, empty and long texts, repeated rows and clashing extra columns."""
    from sediment.llm.common import small_batches
    small_batches(spark)
    return spark.createDataFrame([(*r, 1.5, "z", 2, b"q") for r in ROWS], "doc_id long, text string, lang string, source string, score double, key string, accepted int, ids binary")


@pytest.fixture
def empty(odd):
    return odd.where("1 = 0")


@pytest.fixture(scope="session")
def small():
    return "/root/testdata/sf0.01"
