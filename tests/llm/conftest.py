import pytest
from pyspark.sql import types as T

DOCS = T.StructType([T.StructField(n, t) for n, t in (
    ("doc_id", T.LongType()), ("text", T.StringType()), ("lang", T.StringType()), ("source", T.StringType()),
    ("n_chars", T.LongType()))])
#: Names that operators use inside, as columns of the input.
CLASHES = "row rid fp first size weight draw copies taken target kept length piece part ring pivot score b a root".split()


@pytest.fixture(scope="session")
def make_docs(spark):
    """Documents from (id, text) or (id, text, source) rows."""
    def make(rows):
        full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", len(r[1] or "")) for r in rows]
        return spark.createDataFrame(full, DOCS)
    return make


@pytest.fixture(scope="session")
def odd_docs(make_docs):
    """Nulls, empty and blank texts, a very long one, repeated rows and ids, and extra columns of clashing names."""
    from pyspark.sql import functions as F
    long = " ".join(f"word{i % 977}" for i in range(30_000))
    docs = make_docs([
        (1, "The same text here"), (2, "The  same text\nhere", "t"), (2, "The  same text\nhere", "t"), (3, None), (4, ""),
        (5, " \t\n", None), (None, "a text without id"), (None, None, None), (6, long, "t"), (7, long + " end"), (8, "x"),
        (9, "<|endoftext|> Ünïcode   é, 한글 🙂 don't"), (2, "another text under the same id")])
    return docs.withColumns({c: F.lit("clash") for c in CLASHES})
