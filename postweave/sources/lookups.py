"""Sentiment lexicons and stop words."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postweave.params import LEXICONS, one_of

# Fry's hundred most frequent English words, as published, in lower case.
FRY_100 = tuple(
    """
    the of and a to in is you that it he was for on are as with his they i
    at be this have from or one had by word but not what all were we when your can said
    there use an each which she do how their if will up other about out many then them these so
    some her would make like him into time has look two more write go see number no way could people
    my than first water been call who oil its now find long down day did get come made may part
    """.split()
)


def load_lexicon(spark: SparkSession, folder: str, name: str = "bing", fmt: str = "parquet") -> DataFrame:
    """Read lexicon ``name`` from ``folder`` as (word, sentiment).

    The two columns are taken by position. A numeric score becomes a label like any other, and one
    word may have several rows.
    """
    one_of("lexicon", name, LEXICONS)
    path = f"{folder.rstrip('/')}/{name}.{fmt}"
    reader = spark.read.option("header", True) if fmt == "csv" else spark.read
    return as_lexicon(reader.format(fmt).load(path))


def as_lexicon(table: DataFrame) -> DataFrame:
    """The first two columns of a table as (word, sentiment), both strings."""
    word, label = table.columns[:2]
    return table.select(
        F.col(f"`{word}`").cast("string").alias("word"), F.col(f"`{label}`").cast("string").alias("sentiment")
    )


def load_stopwords(spark: SparkSession, path: str | None = None, fmt: str = "parquet") -> DataFrame:
    """Stop words as a table of one column, ``word``: the first column of a stored table of any size.

    Without a path, the hundred most frequent English words; ``FRY_100`` has them as a list, which a plan
    looks up without a join.
    """
    if path is None:
        return spark.createDataFrame([(word,) for word in FRY_100], "word string")
    table = spark.read.format(fmt).load(path)
    return table.select(F.col(f"`{table.columns[0]}`").cast("string").alias("word")).dropna().distinct()
