"""Row filters and projections."""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postweave.operators.lookup_joins import fits_broadcast
from postweave.params import STOP_MODES, one_of

def select_columns(df: DataFrame, columns: Sequence[str], renamed: Mapping[str, str] | None = None) -> DataFrame:
    """Project to ``columns`` and rename some of them."""
    return df.select(*columns).withColumnsRenamed(dict(renamed or {}))


def original_posts(posts: DataFrame) -> DataFrame:
    """Drop retweets."""
    return posts.filter(~F.col("is_retweet"))


def exclude_pattern(df: DataFrame, column: str, pattern: str) -> DataFrame:
    """Drop rows whose value matches the regex; an empty pattern keeps all."""
    return df.filter(~F.col(column).rlike(pattern)) if pattern else df


def contains_pattern(df: DataFrame, column: str, pattern: str) -> DataFrame:
    """Keep rows whose value matches the regex; an empty pattern keeps all."""
    return df.filter(F.col(column).rlike(pattern)) if pattern else df


# Up to so many stop words are looked for one by one, more in a set of them.
FEW_WORDS = 16


def drop_stopword_ngrams(
    df: DataFrame, column: str, stopwords: Sequence[str] | DataFrame, mode: str = "token"
) -> DataFrame:
    """Drop n-grams that hold a stop word.

    ``token`` compares whole words. ``substring`` matches the stop words joined into one regex
    anywhere in the n-gram, so a one-letter stop word drops every n-gram with that letter. A few listed words are looked
    for in the n-gram as it is, more are looked up in a set. A table of stop words, first column, may be of any size, and its words are plain text, no regex.
    Its join is on the words of the n-grams; for substrings, these words are first looked through themselves, each once.
    An n-gram that is null stays.
    """
    one_of("mode", mode, STOP_MODES)
    if isinstance(stopwords, DataFrame):
        listed = stopwords.select(F.col(f"`{stopwords.columns[0]}`").alias("_word")).dropna().distinct()
        # a condition that always holds: this branch needs all columns, as the other does, and shares its shuffle
        read = df.filter(F.xxhash64(*[F.col(f"`{name}`") for name in df.columns]) >= F.lit(-(2**63)))
        distinct = read.select(F.col(column).alias("_held")).distinct()
        # outer, though no split is empty: a plain one puts a condition of its own below the counts
        split = distinct.select("_held", F.explode_outer(F.array_distinct(F.split("_held", " "))).alias("_word"))
        if mode == "substring":
            within, across = listed.filter(~F.contains("_word", F.lit(" "))), listed.filter(F.contains("_word", F.lit(" ")))
            stopped = split.join(_with_substring(split.select("_word").distinct(), "_word", within), "_word").select("_held")
            if not across.isEmpty():
                stopped = stopped.unionByName(_with_substring(distinct, "_held", across, " "))
        else:
            stopped = split.join(F.broadcast(listed) if fits_broadcast(listed) else listed, "_word").select("_held")
        # not an anti join, which would be put below the counts
        return df.join(stopped.distinct(), F.col(column) == F.col("_held"), "left").filter(F.col("_held").isNull()).drop("_held")
    if not stopwords:
        return df
    if mode == "substring":
        held = F.col(column).rlike("|".join(stopwords))
    elif len(stopwords) <= FEW_WORDS and column in df.columns:
        # exploded, an n-gram is made once: a plain column's expression would be repeated wherever the filter names it
        df = df.withColumn(column, F.explode(F.array(column)))
        held = reduce(Column.__or__, [_holds_word(F.col(column), word) for word in stopwords if word is not None], F.lit(False))
    else:
        held = F.exists(F.split(column, " "), lambda word: word.isin(list(stopwords)))
    return df.filter(~F.coalesce(held, F.lit(False)))


def _holds_word(value: Column, word: str) -> Column:
    """Whether ``word`` is among the parts that blanks cut ``value`` into."""
    if " " in word:
        return F.lit(False)
    text = value.cast("string")
    return (text == F.lit(word)) | text.startswith(f"{word} ") | text.endswith(f" {word}") | text.contains(f" {word} ")


# The parts of a value are looked up by so many of their first characters before they are shuffled.
HEAD = 3


def _with_substring(values: DataFrame, column: str, listed: DataFrame, mark: str = "") -> DataFrame:
    """The distinct ``values`` of which some part is in ``listed``, whose words all hold ``mark``.

    Listed words of at most ``HEAD`` characters and the beginnings of longer ones are broadcast if they fit: values with one
    of the former are not looked through further, parts that begin like none of the latter are not shuffled.
    """
    heads = listed.select(F.length("_word").alias("_size"), F.substring("_word", 1, HEAD).alias("_head")).distinct()
    if not fits_broadcast(heads):
        return _parts(values, column, listed, mark).join(listed.withColumnRenamed("_word", "_part"), "_part").select(column).distinct()
    heads = F.broadcast(heads)
    short, long = listed.filter(F.length("_word") <= HEAD), listed.filter(F.length("_word") > HEAD)
    found = _parts(values, column, short, mark).join(heads, (F.col("_part") == F.col("_head")) & (F.col("_size") == F.length("_part")), "left_semi")
    found = found.select(column).distinct()
    parts = _parts(values.join(found, column, "left_anti"), column, long, mark).withColumn("_head", F.substring("_part", 1, HEAD))
    parts = parts.withColumn("_size", F.length("_part")).join(heads, ["_size", "_head"], "left_semi")
    long = long.withColumnRenamed("_word", "_part")
    more = parts.join(F.broadcast(long) if fits_broadcast(long) else long, "_part").select(column)
    return found.unionByName(more.distinct())


def _parts(values: DataFrame, column: str, listed: DataFrame, mark: str) -> DataFrame:
    """The parts of each value, as ``_part``, that are as long as some listed word and hold ``mark``.

    Each meets at most one listed word in a join, however many of these begin alike.
    """
    sizes = listed.agg(F.collect_set(F.length("_word")).alias("sizes")).scalar()
    sized = values.select(column, F.explode(sizes).alias("_span")).filter(F.col("_span") <= F.length(column))
    last = F.length(column) - F.col("_span") + 1
    placed = sized.select(column, "_span", F.explode(F.sequence(F.lit(1), last)).alias("_at"))
    return placed.select(column, F.col(column).substr(F.col("_at"), F.col("_span")).alias("_part")).filter(F.contains("_part", F.lit(mark)))


def exclude_exact(df: DataFrame, column: str, value: str) -> DataFrame:
    """Drop rows whose value equals ``value``."""
    return df.filter(F.col(column) != value)


def date_range_filter(posts: DataFrame, first: dt.date | str | None, last: dt.date | str | None) -> DataFrame:
    """Keep posts from ``first`` to ``last``, both days whole, whatever the time of day; None leaves that end open."""
    if first is not None:
        posts = posts.filter(F.col("created_at") >= F.lit(first).cast("date"))
    if last is not None:
        posts = posts.filter(F.col("created_at") < F.date_add(F.lit(last).cast("date"), 1))
    return posts
