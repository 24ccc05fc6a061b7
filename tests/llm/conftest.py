import pytest

ODD = [
    (1, "the cat sat on the mat and the dog sat on the log", "en", "a", 1),
    (2, None, None, None, None),
    (3, "", "en", "a", 0),
    (3, "", "en", "a", 0),
    (None, "no id at all here", "de", "b", 3),
    (5, " \n\t ", "en", "b", 4),
    (6, "naïve café 日本語 😀 <|endoftext|> tail", "fr", "c", 5),
    (7, "word " * 3000, "en", "c", 6),
    (8, "x" * 5000, "en", "c", 7),
    (9, "the cat sat on the mat and the dog sat on the log", "en", "a", 1),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, blanks, copies, repeated rows, other scripts, long texts, and columns with names that operators use inside."""
    from pyspark.sql import functions as F

    df = spark.createDataFrame(ODD, SCHEMA).repartition(2)
    return df.withColumns({"row": F.lit("r"), "words": F.lit(1), "kept": F.lit("k"), "n_words": F.lit("w"), "registers": F.lit(2.5), "class_id": F.lit(None).cast("int"), "meta.url": F.lit("u"), "v": F.lit(0), "bucket": F.lit("b"), "entry": F.lit(True)})


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
