import pytest

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, size string, key string, rank string, kept string, doc string"


@pytest.fixture(scope="session")
def docs(spark):
    """Nulls in every column, empty, blank and very long texts, copies, repeated rows, and columns whose names clash."""
    long = " ".join(f"wort{i % 977} und{i % 13}" for i in range(30_000))
    base = " ".join(f"alpha{i} beta{i * 7 % 31}" for i in range(60))
    rows = [
        (5, base, "en", "b", 1), (3, base, "en", "b", 1), (9, base + " tail of another text", "en", None, 1), (7, "", None, "a", 0), (8, None, "de", "a", None), (11, "  \n\t ", "de", "", 3),
        (12, "one two", None, "a", 7), (13, "ONE  two", "en", "c", 8), (14, long, "de", "c", 1), (15, "x" + long[5000:60_000], "de", "c", 1), (16, "a" * 500, "en", "d", 500), (16, "a" * 500, "en", "d", 500),
        (None, "no id here but words enough to be a text", "fr", "d", 1), (17, "12 34 %% --", "fr", "é", 1), (18, "<|endoftext|> ünïcödé ☃ 漢字 " * 3, "fr", "é", 1), (19, base[:300] + " changed " + base[300:], "en", "b", 1),
    ]
    return spark.createDataFrame([(*r, "s", "k", "r", "q", "d") for r in rows], SCHEMA)


@pytest.fixture(scope="session")
def small(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")
