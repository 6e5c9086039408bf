"""Intermediate tables in the shared folder, which every executor can read again after a loss."""

from __future__ import annotations

from pyspark.sql import DataFrame

from postweave.sources.storage import fresh_folder


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to a new table below the folder that ``spark.checkpoint.dir`` names, and read from there."""
    folder = fresh_folder(df.sparkSession, name)
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)
