import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def docs(spark):
    """A frame of documents from texts or (id, text) pairs, with columns whose names clash with internal ones."""

    def make(texts):
        rows = [(t if isinstance(t, tuple) else (i, t)) for i, t in enumerate(texts)]
        df = spark.createDataFrame([(i, t, "en", "src0", len(t or "")) for i, t in rows], SCHEMA)
        from pyspark.sql import functions as F

        return df.withColumns({c: F.lit(1) for c in ("score", "kept", "rep", "row", "shard", "ids", "words")})

    return make


@pytest.fixture(scope="session")
def odd_texts():
    return [None, "", "   \n\t ", "one", "Ünïcode wörds und straße", "emoji 😀 and 汉字 mixed İstanbul ΟΔΟΣ", "a\x1cb\x85c d", "tab\tnew\nline\r\nend", "x" * 5000, "<|endoftext|> </s> [INST]", "it's we'll I'd 123 4.5", "same", "same"]
