"""Schemas of the state tables.

All timestamps are zone-less wall-clock values in UTC, so results do not depend
on the session time zone.
"""

from __future__ import annotations

from pyspark.sql import types as T

PAGES = T.StructType(
    [
        T.StructField("page_id", T.LongType()),
        T.StructField("url", T.StringType()),
        T.StructField("html", T.StringType()),
    ]
)

URL = T.StructType(
    [
        T.StructField("url", T.StringType()),
        T.StructField("ts", T.TimestampNTZType()),
        T.StructField("visited", T.IntegerType()),
    ]
)

VISITED = T.StructType([T.StructField("url", T.StringType())])

CONTENT = T.StructType(
    [
        T.StructField("url", T.StringType()),
        T.StructField("content", T.StringType()),
        T.StructField("ts", T.TimestampNTZType()),
    ]
)

DUPE = T.StructType(
    [
        T.StructField("sig", T.StringType()),
        T.StructField("recent_url", T.StringType()),
        T.StructField("ts", T.TimestampNTZType()),
    ]
)

LIKED = T.StructType(
    [
        T.StructField("rule_set", T.StringType()),
        T.StructField("content_hash", T.StringType()),
        T.StructField("url", T.StringType()),
        T.StructField("content", T.StringType()),
        T.StructField("note", T.StringType()),
        T.StructField("ts", T.TimestampNTZType()),
    ]
)

CLAIMS = T.StructType(
    [
        T.StructField("owner", T.StringType()),
        T.StructField("as_of", T.TimestampNTZType()),
    ]
)

RULES = T.StructType(
    [
        T.StructField("rule_set", T.StringType(), False),
        T.StructField("polarity", T.StringType(), False),
        T.StructField("pos", T.IntegerType(), False),
        T.StructField("pattern", T.StringType(), False),
    ]
)
