"""Explicit schemas of every stored or exchanged table."""

from pyspark.sql.types import (
    ArrayType,
    DoubleType,
    FloatType,
    IntegerType,
    LongType,
    StringType,
    StructField,
    StructType,
)

VECTOR = ArrayType(FloatType(), containsNull=False)

FILES = StructType([
    StructField("folder", StringType(), False),
    StructField("path", StringType(), False),
    StructField("content", StringType(), False),
    StructField("size", LongType(), False),
])

# One row per file touched by a version; `prev_version` names the version whose
# rows this one replaces, so replaced rows are found without a group-by.
MANIFEST = StructType([
    StructField("folder", StringType(), False),
    StructField("path", StringType(), False),
    StructField("hash", StringType(), True),
    StructField("op", StringType(), False),  # U = present, D = removed
    StructField("status", StringType(), False),
    StructField("old_hash", StringType(), True),
    StructField("prev_version", IntegerType(), True),
    StructField("copies", LongType(), False),
    StructField("conflict", IntegerType(), False),
    StructField("seq", LongType(), True),  # of the change, if it came with one
])

CHUNKS = StructType([
    StructField("folder", StringType(), False),
    StructField("path", StringType(), False),
    StructField("hash", StringType(), False),
    StructField("chunk_index", IntegerType(), False),
    StructField("chunk_id", StringType(), False),
    StructField("text", StringType(), False),
    StructField("vector", VECTOR, False),
])

# One row per file that a version left out.
REJECTS = StructType([
    StructField("folder", StringType(), False),
    StructField("path", StringType(), False),
    StructField("size", LongType(), True),
    StructField("reason", StringType(), False),
])

# `folder` null searches the whole index, `cutoff` null takes the default.
REQUESTS = StructType([
    StructField("query_id", LongType(), False),
    StructField("query", StringType(), True),
    StructField("folder", StringType(), True),
    StructField("cutoff", DoubleType(), True),
])

HITS = StructType([
    StructField("query_id", LongType(), False),
    StructField("folder", StringType(), True),
    StructField("path", StringType(), True),
    StructField("chunk_id", StringType(), True),
    StructField("chunk_index", IntegerType(), True),
    StructField("score", DoubleType(), True),
])

DELTA = StructType([
    StructField("folder", StringType(), False),
    StructField("path", StringType(), False),
    StructField("content", StringType(), True),
    StructField("op", StringType(), False),
    StructField("seq", LongType(), False),
])


def require(df, schema: StructType, what: str):
    """`df` narrowed to `schema`; a missing or differently typed column raises."""
    have = {f.name: f.dataType for f in df.schema.fields}
    for field in schema.fields:
        if field.name not in have:
            raise ValueError(f"{what}: column {field.name!r} is missing")
        if have[field.name].simpleString() != field.dataType.simpleString():
            raise ValueError(
                f"{what}: column {field.name!r} is {have[field.name].simpleString()}, "
                f"expected {field.dataType.simpleString()}"
            )
    return df.select(*[f.name for f in schema.fields])
