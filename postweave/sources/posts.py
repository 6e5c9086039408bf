"""The posts table: CSV in and out, cleaning on load, one account's timeline."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postweave.functions.text import clean_text
from postweave.operators.ranking import first_by
from postweave.params import at_least
from postweave.schema import POSTS

# Set alike on both sides. All values are written quoted, so a missing string and an empty one look alike;
# which strings of a row are missing stands in a column of its own.
MISSING = "missing_columns"
CSV = {
    "header": True,
    "quote": '"',
    "escape": '"',
    "encoding": "UTF-8",
    "emptyValue": "",
    "timestampFormat": "yyyy-MM-dd HH:mm:ss",
    "ignoreLeadingWhiteSpace": False,
    "ignoreTrailingWhiteSpace": False,
}


def load_posts_csv(spark: SparkSession, path: str, multi_line: bool = True, strict: bool = False) -> DataFrame:
    """Read posts from UTF-8 CSV with a header; only the posts columns are kept.

    Columns are found by name, as a file may hold many others in any order; all files of a folder must have them in
    the same order, or reading fails (``csv_folders.load_posts_folder`` reads such folders). A value that does not parse is null, or with ``strict`` an error. In files of
    other makers an empty value without quotes is a missing one. A quoted text may hold
    line breaks; such files cannot be split, so large exports should be many files (which
    ``write_posts_csv`` makes). ``multi_line=False`` splits files whose texts hold no line breaks.
    """
    header = spark.read.options(**CSV).option("multiLine", multi_line).option("enforceSchema", False).csv(path)
    marked = MISSING in header.columns
    return header.select(*[typed(field.name, field.dataType.simpleString(), marked, strict) for field in POSTS])


def typed(name: str, kind: str, marked: bool, strict: bool):
    """The raw column ``name`` as a ``kind``; ``marked`` if a column names the missing strings of a row."""
    value = F.col(name)
    if kind == "string":
        if not marked:
            return value.alias(name)
        # Spark reads an empty value as a missing one, quoted or not
        listed = F.array_contains(F.split(F.coalesce(MISSING, F.lit("")), " "), name)
        return F.when(~listed, F.coalesce(value, F.lit(""))).alias(name)
    value = F.nullif(value, F.lit(""))
    if kind == "timestamp":
        return (F.to_timestamp(value) if strict else F.try_to_timestamp(value)).alias(name)
    return (value.cast(kind) if strict else value.try_cast(kind)).alias(name)


def write_posts_csv(posts: DataFrame, path: str, rows_per_file: int = 1_000_000) -> None:
    """Write posts as UTF-8 CSV files with a header, every value quoted.

    One more column names, separated by blanks, the string columns that are missing in a row.
    """
    at_least("rows_per_file", rows_per_file, 1)
    strings = [field.name for field in posts.schema if field.dataType.simpleString() == "string"]
    missing = F.concat_ws(" ", *[F.when(F.col(name).isNull(), name) for name in strings])
    (
        posts.withColumn(MISSING, missing).write.options(**CSV)
        .option("quoteAll", True)
        .option("maxRecordsPerFile", rows_per_file)
        .mode("errorifexists")
        .csv(path)
    )


def normalise_posts(raw: DataFrame) -> DataFrame:
    """Clean the text and turn ``created_at`` into a date."""
    return raw.withColumns({"text": clean_text(F.col("text")), "created_at": F.to_date("created_at")})


def user_timeline(posts: DataFrame, screen_name: str, n: int = 3200) -> DataFrame:
    """The latest ``n`` posts of an account; ids settle the order within a day."""
    own = posts.filter(F.col("screen_name") == screen_name)
    return first_by(own, "created_at", n, tie="status_id", descending=True)
