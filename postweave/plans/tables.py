"""The posts as tables to look at."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postweave.functions.calendar import date_text
from postweave.operators.ranking import preview, sort_rows
from postweave.schema import RAW_COLUMNS


def post_preview(posts: DataFrame, n: int = 6) -> DataFrame:
    """Date and text of the first posts."""
    first = preview(posts.select("status_id", "created_at", "text"), n)
    return first.select(date_text(F.col("created_at")).alias("created_at"), "text")


def raw_table(posts: DataFrame, limit: int | None = None) -> DataFrame:
    """Nine columns of the posts by date and id; ``limit`` keeps the first rows."""
    kept = posts.select(*RAW_COLUMNS) if limit is None else preview(posts.select(*RAW_COLUMNS), limit)
    shown = kept.withColumn("created_at", date_text(F.col("created_at")))
    return sort_rows(shown, "created_at", "status_id")
