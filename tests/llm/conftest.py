import pytest

#: Nulls, empty and very long texts, repeated rows, and an extra column whose names clash with what operators add.
AWKWARD = [
    (1, "The cat sat on the mat and looked at the moon for a long time", "en", "a", 1), (2, "The cat sat on the mat and looked at the moon for a long time", "en", "a", 1),
    (2, "The cat sat on the mat and looked at the moon for a long time", "en", "a", 1), (3, None, "en", "a", 1), (4, "", None, None, None), (None, "no id here", "en", "b", 1),
    (5, "  \n\t ", "en", "b", 1), (6, "word " * 30000, "en", "b", 1), (7, "x" * 50000, "en", None, 1), (8, "mail bob@example.org or +1 555 123 4567 now 😀", "en", "b", 1),
]
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def awkward(spark):
    from pyspark.sql import functions as F

    docs = spark.createDataFrame(AWKWARD, COLUMNS)
    for name in ("size", "score", "token", "spans", "base", "digits", "rank", "row", "copies", "component_id", "label", "target", "proposals"):
        docs = docs.withColumn(name, F.lit("clash"))
    return docs.cache()


@pytest.fixture(scope="session")
def nothing(awkward):
    return awkward.limit(0)
