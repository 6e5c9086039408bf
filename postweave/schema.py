"""The posts table: the only columns any analytic reads."""

from __future__ import annotations

from pyspark.sql import types as T

POSTS = T.StructType(
    [
        # a string: schema inference would read a 19-digit id as a number
        T.StructField("status_id", T.StringType(), False),
        T.StructField("created_at", T.TimestampType(), False),
        T.StructField("screen_name", T.StringType(), False),
        T.StructField("text", T.StringType(), True),
        T.StructField("is_quote", T.BooleanType(), False),
        T.StructField("is_retweet", T.BooleanType(), False),
        T.StructField("favorite_count", T.LongType(), False),
        T.StructField("retweet_count", T.LongType(), False),
        T.StructField("followers_count", T.LongType(), False),
    ]
)

# Order of the raw table's columns.
RAW_COLUMNS = (
    "created_at",
    "screen_name",
    "text",
    "is_quote",
    "is_retweet",
    "favorite_count",
    "retweet_count",
    "followers_count",
    "status_id",
)
