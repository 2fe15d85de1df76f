"""Explicit schemas; nothing is inferred."""

from pyspark.sql import types as T

RECORD_SCHEMA = T.StructType(
    [
        T.StructField("ord", T.LongType()),
        T.StructField("id", T.StringType()),
        T.StructField("name", T.StringType()),
        T.StructField("revision", T.LongType()),
        T.StructField("content", T.StringType()),
        T.StructField("updatedAt", T.TimestampType()),
    ]
)

#: ``expected`` is a double: a JSON 3, 3.0 and 3e0 are one number, "3" is none.
ATTEMPT_SCHEMA = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("seq", T.LongType()),
        T.StructField("expected", T.DoubleType()),
        T.StructField("content", T.StringType()),
    ]
)
