"""CSV folders from several makers: files with other headers, and rows that do not parse."""

from __future__ import annotations

import csv
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from postweave.schema import POSTS
from postweave.sources.posts import CSV, MISSING, typed

_NAMES = [field.name for field in POSTS]
_REJECTED = T.StructType([T.StructField(name, T.StringType()) for name in ("file", "reason", "row")])
_BROKEN = "_broken"


def load_posts_folder(spark: SparkSession, path: str, multi_line: bool = True) -> tuple[DataFrame, DataFrame]:
    """The posts of a folder whose files may have different headers, and the rows that were not taken.

    The headers are found first; files with the same one are read by one scan, in which its columns are found by name
    as in ``load_posts_csv``, and the scans are united. So the plan grows with the number of different headers, not of files; the
    paths of the files are in it, as they are in Spark's own list.

    A row is rejected whole if it has more or fewer values than its header, or a value that is there but does not
    parse; a missing value is null. All lines of a file without a header that names every posts column are rejected. ``rejected``
    holds the file, the reasons and the row: the raw line if its number of values is wrong, else its posts columns as JSON.
    Every row is in exactly one of the two tables. A header may hold other columns and a byte order mark, but no
    line break.
    """
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"))
    taken, left, known = [], [], []
    for names, files in _headers(spark, path):
        rows = _rows(spark, path, names, files, multi_line)
        marked = MISSING in names
        taken.append(rows.filter(F.size("_faults") == 0).select(*[_field(field, marked) for field in POSTS]))
        raw = F.to_json(F.struct(*_NAMES))
        reason = F.array_join("_faults", "; ").alias("reason")
        left.append(rows.filter(F.size("_faults") > 0).select("file", reason, F.coalesce(_BROKEN, raw).alias("row")))
        known += files
    headless = lines.filter(~F.col("file").isin(known)) if known else lines
    left.append(headless.select("file", F.lit("no header with every posts column").alias("reason"), F.col("value").alias("row")))
    none = spark.createDataFrame([], POSTS)
    return reduce(DataFrame.unionByName, taken, none), reduce(DataFrame.unionByName, left, spark.createDataFrame([], _REJECTED))


def _headers(spark: SparkSession, path: str) -> list[tuple[list[str], list[str]]]:
    """Each header that names every posts column, with the paths of its files."""
    first = F.col("_metadata.file_block_start") == 0
    lines = spark.read.text(path).filter(first).select(
        "value", F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("place")
    )
    # few lines hold all the names: those alone are grouped
    likely = lines.filter(reduce(lambda a, b: a & b, [F.col("value").contains(name) for name in _NAMES]))
    heads = likely.groupBy("file").agg(F.min_by("value", "place").alias("head"))
    found = []
    for head, files in heads.groupBy("head").agg(F.sort_array(F.collect_list("file"))).orderBy("head").collect():
        names = next(csv.reader([head.removeprefix("\ufeff")]))
        if set(_NAMES) <= set(names):
            found.append((names, files))
    return found


def _rows(spark: SparkSession, path: str, names: list[str], files: list[str], multi_line: bool) -> DataFrame:
    """The raw posts columns of some files of one header, with the faults of each row."""
    places = [f"_{place}" for place in range(len(names))]
    schema = T.StructType([T.StructField(name, T.StringType()) for name in [*places, _BROKEN]])
    reader = spark.read.schema(schema).options(**CSV).option("multiLine", multi_line).option("columnNameOfCorruptRecord", _BROKEN)
    kept = [F.col(f"_{names.index(name)}").alias(name) for name in [*_NAMES, *({MISSING} & set(names))]]
    rows = reader.csv(path).select(F.col("_metadata.file_path").alias("file"), *kept, _BROKEN).filter(F.col("file").isin(files))
    faults = [F.when(F.col(_BROKEN).isNotNull(), F.lit(f"not {len(names)} values"))]
    for field in POSTS:
        kind = field.dataType.simpleString()
        if kind != "string":
            unread = (F.col(field.name) != "") & _field(field, False).isNull() & F.col(_BROKEN).isNull()
            faults.append(F.when(unread, F.lit(f"{field.name} is no {kind}")))
    return rows.withColumn("_faults", F.array_compact(F.array(*faults)))


def _field(field: T.StructField, marked: bool) -> Column:
    return typed(field.name, field.dataType.simpleString(), marked, strict=False)
