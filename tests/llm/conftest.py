import pytest
from pyspark.sql import functions as F

#: (doc_id, text, lang, source): nulls anywhere, empty and very long texts, ties, repeated rows.
ROWS = [
    (1, "The quick brown fox jumps over the lazy dog. Mail bob.x@ex-ample.com or +1 (918) 555-3922!", "en", "src1"),
    (2, None, "en", "src1"),
    (3, "", None, "src12"),
    (4, "  \t\n ", "de", None),
    (5, "Der schnelle braune Fuchs springt über den faulen Hund <|endoftext|> 4111 1111 1111 1111", "de", "src2"),
    (5, "Der schnelle braune Fuchs springt über den faulen Hund <|endoftext|> 4111 1111 1111 1111", "de", "src2"),
    (6, "the quick brown fox jumps over the lazy dog. mail bob.x@ex-ample.com or +1 (918) 555-3922!", "en", "src1"),
    (None, "漢字かな交じり文 1.2.3.4 😀 ꙮ", None, None),
    (7, "wörd " * 30_000, "de", "src30"),
    (8, "x" * 100_000, "en", "odd"),
    (9, "1234 !!! ...", "fr", "src12"),
    (10, "Le renard brun saute par-dessus le chien paresseux\nl'été.\r\n\x0b fin", "fr", "src5"),
    (50, "same same", "en", "src1"),
    (51, "same same", "en", "src1"),
]


@pytest.fixture(scope="session")
def docs(spark):
    """The rows, with further columns whose names operators use inside."""
    df = spark.createDataFrame(ROWS, "doc_id long, text string, lang string, source string")
    df = df.withColumn("n_chars", F.length("text").cast("long"))
    for c in ("key", "total", "n", "row", "fp", "rid", "score", "held_out", "spans", "supply", "start", "budget", "mix_leaf", "mix_key", "component_id", "bucket", "ids"):
        df = df.withColumn(c, F.lit("clash"))
    return df


@pytest.fixture(scope="session")
def empty(docs):
    return docs.where("false")
