import pytest
from pyspark.sql import types as T

from flowsieve.llm import catalog  # noqa: F401  (without the subpackage these tests are not collected)

DOCS = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()),
    # names that operators use inside
    T.StructField("shard", T.StringType()), T.StructField("_row", T.StringType()), T.StructField("fp", T.StringType()), T.StructField("id", T.StringType()),
])


@pytest.fixture(scope="session")
def make(spark):
    """Documents from (doc_id, text[, lang]) with further columns of clashing names."""

    def build(rows):
        full = [(r[0], r[1], r[2] if len(r) > 2 else None, None, len(r[1] or ""), "x", "y", "z", "w") for r in rows]
        return spark.createDataFrame(full, DOCS)

    return build


@pytest.fixture(scope="session")
def odd(make):
    """NULLs in every column, empty and white texts, ties, repeated rows, a long text, signs only."""
    return make([
        (1, "The cat sat on the mat and looked out."), (1, "The cat sat on the mat and looked out."), (2, None), (3, ""), (None, "The cat sat on the mat and looked out."),
        (None, None), (4, " \t\n "), (5, "word " * 40_000), (6, "%%% $$$ 123"), (7, "ünïcödé … 文字   x"), (8, "a"), (9, "x" * 30_000), (10, "The CAT sat on the mat and looked out."),
    ])


@pytest.fixture(scope="session")
def small():
    return "/root/testdata/sf0.01"
