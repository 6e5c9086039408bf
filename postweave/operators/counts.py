"""Counting, daily totals and reshaping."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def count_by(df: DataFrame, *keys: str, out: str = "n") -> DataFrame:
    """Rows per key; counted on the map side before the shuffle."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias(out))


def daily_sums(posts: DataFrame) -> DataFrame:
    """Favourites, retweets and posts per day."""
    return posts.groupBy(F.to_date("created_at").alias("date")).agg(
        F.sum("favorite_count").alias("Daily Favorites"),
        F.sum("retweet_count").alias("Daily Retweets"),
        F.count(F.lit(1)).alias("Daily Tweets"),
    )


def date_bounds(posts: DataFrame) -> DataFrame:
    """First and last date of the posts."""
    return posts.agg(F.min("created_at").alias("first"), F.max("created_at").alias("last"))


def unpivot_metrics(
    df: DataFrame, keep: Sequence[str], metrics: Sequence[str], name: str = "type", value: str = "value"
) -> DataFrame:
    """Turn metric columns into (name, value) rows beside the kept columns."""
    return df.unpivot(list(keep), list(metrics), name, value)


def union_series(*series: DataFrame) -> DataFrame:
    """Stack (series, date, n) tables."""
    stacked = series[0]
    for more in series[1:]:
        stacked = stacked.unionByName(more)
    return stacked
