"""Sentiment of words, phrases, days and posts against a lexicon.

A lexicon is a (word, sentiment) table. Its labels are at most as many as its rows, so whatever has
one row per label is as small as the lexicon is.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postweave.functions.labels import NEGATIVE, signed_mirror
from postweave.functions.text import strip_links
from postweave.operators.counts import count_by, union_series
from postweave.operators.filters import exclude_exact, exclude_pattern, original_posts
from postweave.operators.lookup_joins import BROADCAST_BYTES, count_sentiments, fits_broadcast, join_back_text
from postweave.operators.ranking import sort_rows, top_k_exact, top_n_by_group
from postweave.operators.statistics import daily_trend
from postweave.operators.tokens import ngram_words, tokenize_ngrams, tokenize_words

# What one ranked row, a post id with its label and count, may take.
ID_BYTES = 128


def sentiment_words(posts: DataFrame, lexicon: DataFrame, top: int = 5, filterword: str = "") -> DataFrame:
    """The most frequent words of each sentiment, as (word, sentiment, n)."""
    words = tokenize_words(posts.select(strip_links(F.col("text")).alias("text")))
    words = exclude_exact(words, "word", filterword)
    small = fits_broadcast(lexicon)
    counts = count_sentiments(words, lexicon, ["word"], small)
    return top_n_by_group(counts, "sentiment", "n", top, few_groups=small)


def sentiment_daily(posts: DataFrame, bing: DataFrame) -> DataFrame:
    """Sentiment words per day, retweets included, as (sentiment, date, n)."""
    words = tokenize_words(posts.select("text", F.to_date("created_at").alias("date")))
    return count_sentiments(words, bing, ["date"]).select("sentiment", "date", "n")


def posts_daily(posts: DataFrame) -> DataFrame:
    """Posts per day, retweets left out, as (date, n)."""
    return count_by(original_posts(posts).select(F.to_date("created_at").alias("date")), "date")


def sentiment_trend(posts: DataFrame, bing: DataFrame, days: int = 7, method: str = "mean") -> DataFrame:
    """Sentiment words and posts per day, smoothed by ``method``, as (series, date, n, trend)."""
    sentiment = sentiment_daily(posts, bing).withColumnRenamed("sentiment", "series")
    volume = posts_daily(posts).select(F.lit("Tweets/Day").alias("series"), "date", "n")
    return daily_trend(union_series(sentiment, volume), "n", days, method=method)


def ngram_sentiment(
    posts: DataFrame, bing: DataFrame, n: int = 2, top: int = 5, filterword: str = ""
) -> DataFrame:
    """The most frequent n-grams with sentiment words, as (sentiment, ngram, n), negative ones below zero.

    An n-gram counts once for each sentiment word in it.
    """
    ngrams = tokenize_ngrams(posts.select(strip_links(F.col("text")).alias("text")), n=n)
    words = ngram_words(exclude_pattern(ngrams, "ngram", filterword))
    small = fits_broadcast(bing)
    counts = count_sentiments(words, bing, ["ngram"], small).select("sentiment", "ngram", "n")
    best = top_n_by_group(counts, "sentiment", "n", top, few_groups=small)
    return best.withColumn("n", signed_mirror(F.col("n"), F.col("sentiment"), NEGATIVE))


def sentiment_posts(posts: DataFrame, lexicon: DataFrame, top: int = 5) -> DataFrame:
    """The ``top`` posts with most words of each sentiment, as (created_at, text, sentiment, n).

    Equal counts go by id. Only ids are ranked; the texts are fetched for the posts that remain.
    """
    words = tokenize_words(original_posts(posts).select("status_id", "text"))
    small = fits_broadcast(lexicon)
    counts = count_sentiments(words, lexicon, ["status_id"], small)
    best = top_k_exact(counts, "sentiment", "n", top, tie="status_id")
    texts = posts.select("status_id", "created_at", "text")
    # at most ``top`` ids per label
    few = small and lexicon.select("sentiment").distinct().count() * top * ID_BYTES <= BROADCAST_BYTES
    found = join_back_text(best, texts, small=few)
    ordered = sort_rows(found, "sentiment", F.desc("n"), "status_id")
    return ordered.select("created_at", "text", "sentiment", "n")
