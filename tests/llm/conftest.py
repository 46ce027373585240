from __future__ import annotations

import pytest
from pyspark.sql import types as T

#: Columns whose names clash with what the operators use inside.
CLASHING = ("id", "size", "shard", "fp", "part", "key", "ids", "h1", "t1", "score", "n", "row", "copies", "media", "slot", "host", "rank",
            "__own", "__id", "__k", "__copies", "kept_id", "rid", "rsource", "total", "at", "lo", "tie", "many", "hash", "before", "text_hash")


@pytest.fixture
def odd_docs(spark):
    """Nulls in every column, empty and long texts, ties, repeated rows, and extra columns with clashing names."""
    rows = [
        (1, "the quick brown fox jumps over the lazy dog again and again", "en", "a"),
        (2, "the quick brown fox jumps over the lazy dog again and again", "en", "a"),
        (2, "the quick brown fox jumps over the lazy dog again and again", "en", "a"),
        (3, None, "en", "b"),
        (4, "", None, None),
        (None, "a text without an id", "en", "b"),
        (None, None, None, None),
        (5, " \t\n ", "de", "b"),
        (6, "word " * 60_000, "en", "c"),
        (7, "ü" * 3000 + " ß", "de", "c"),
        (8, "1234 5678 !!! <|endoftext|> ???", "en", "a"),
        (2, "another text under the same id", "en", "a"),
    ]
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType())] + [T.StructField(c, T.StringType()) for c in CLASHING] + [T.StructField("attributes", T.MapType(T.StringType(), T.IntegerType()))])
    return spark.createDataFrame([(*r, *["x"] * len(CLASHING), {"k": 1}) for r in rows], schema)


@pytest.fixture
def no_docs(odd_docs):
    return odd_docs.limit(0)
