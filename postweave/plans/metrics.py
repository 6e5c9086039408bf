"""Engagement metrics of posts; retweets are left out throughout."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postweave.functions.calendar import date_text
from postweave.functions.labels import RECEIVED_NAMES, label_contains, label_metric
from postweave.functions.text import strip_links
from postweave.operators.counts import count_by, daily_sums, unpivot_metrics
from postweave.operators.joins import join_groups
from postweave.operators.filters import drop_stopword_ngrams, exclude_exact, exclude_pattern, original_posts
from postweave.operators.ranking import capped_top, nth_value, sort_rows, top_n, top_n_by_group
from postweave.operators.statistics import daily_trend, log_histogram, metric_summary, tally_median, tally_values
from postweave.operators.tokens import extract_mentions, tokenize_ngrams
from postweave.params import METRICS, at_least, one_of

_DAILY = ("Daily Favorites", "Daily Retweets", "Daily Tweets")


def post_summary(posts: DataFrame) -> DataFrame:
    """Minimum, median, mean, maximum, deviation and number of posts per metric."""
    long = unpivot_metrics(original_posts(posts), [], METRICS, "key", "value")
    named = long.select(label_metric(F.col("key"), RECEIVED_NAMES).alias("key"), "value")
    return metric_summary(named, "key", "value", few_groups=True, cuts=1)


def metric_daily(posts: DataFrame) -> DataFrame:
    """Daily favourites, retweets and posts, as (date, type, value)."""
    return unpivot_metrics(daily_sums(original_posts(posts)), ["date"], _DAILY)


def metric_trend(posts: DataFrame, days: int = 7, method: str = "mean") -> DataFrame:
    """``metric_daily`` smoothed by ``method`` per type, as (date, type, value, trend)."""
    series = metric_daily(posts).withColumnRenamed("type", "series")
    return daily_trend(series, "value", days, method=method).withColumnRenamed("series", "type")


def top_posts(posts: DataFrame, tweetmetric: str = "favorite_count", top: int = 5) -> DataFrame:
    """The posts with the highest metric, ties kept, as (text, date, type, value), highest first.

    The metric is one column, chosen before ranking: finding its n-th largest value reads that
    column alone, and the texts are read for the posts that reach it.
    """
    metric = one_of("tweetmetric", tweetmetric, METRICS)
    best = top_n(original_posts(posts).select("status_id", "text", "created_at", metric), metric, top)
    shown = best.select(
        "text",
        date_text(F.col("created_at")).alias("date"),
        F.lit(metric).alias("type"),
        F.col(metric).alias("value"),
        "status_id",
    )
    return sort_rows(shown, F.desc("value"), "status_id").drop("status_id")


def top_posts_ngrams(
    posts: DataFrame,
    n: int = 2,
    top: int = 5,
    toptweetn: int = 100,
    filterword: str = "",
    stopwords: Sequence[str] = (),
    stop_mode: str = "token",
) -> DataFrame:
    """The n-grams that the posts with the highest metrics share, as (type, ngram, n).

    The posts are not unpivoted: each metric's n-th largest value is found from its own column, and
    a post that reaches one or both is tokenised for those. Both cuts reach the scan as a filter.
    """
    at_least("toptweetn", toptweetn, 1)
    originals = original_posts(posts)
    reaches = {}
    for metric in METRICS:
        reaches[metric] = F.col(metric) >= nth_value(originals, metric, toptweetn)
    types = F.array_compact(F.array(*[F.when(reached, F.lit(metric)) for metric, reached in reaches.items()]))
    either = reaches[METRICS[0]] | reaches[METRICS[1]]
    best = originals.filter(either).select(strip_links(F.col("text")).alias("text"), types.alias("types"))
    ngrams = tokenize_ngrams(best, n=n)
    ngrams = exclude_pattern(ngrams, "ngram", filterword)
    ngrams = drop_stopword_ngrams(ngrams, "ngram", stopwords, stop_mode)
    counts = count_by(ngrams.select(F.explode("types").alias("type"), "ngram"), "type", "ngram")
    return capped_top(top_n_by_group(counts, "type", "n", top, few_groups=True), "type", "ngram", top)


def mention_top(posts: DataFrame, top: int = 5, filterusername: str = "") -> DataFrame:
    """The most mentioned handles, as (word, n)."""
    texts = original_posts(posts).select(strip_links(F.col("text")).alias("text"))
    mentions = exclude_exact(extract_mentions(texts), "word", "")
    if filterusername:
        mentions = exclude_exact(mentions, "word", filterusername)
    return top_n(count_by(mentions, "word"), "n", top)


def metric_distribution(posts: DataFrame, wordmetric: str = "", bins: int = 30) -> DataFrame:
    """Histogram and median of each metric for posts with and without a word.

    Rows are (metric, Word, bin, n, median); zeros have no bin but count in the median. Posts without a
    text are a group with a null ``Word``. The posts
    are read once, into counts per distinct value, from which both are derived.
    """
    labelled = original_posts(posts).select(label_contains(F.col("text"), wordmetric).alias("Word"), *METRICS)
    long = unpivot_metrics(labelled, ["Word"], METRICS, "metric")
    named = long.select(label_metric(F.col("metric")).alias("metric"), "Word", "value")
    groups = ["metric", "Word"]
    tally = tally_values(named, groups, "value")
    medians = tally_median(tally, groups, "value", few_groups=True, cuts=1)
    histogram = log_histogram(tally, groups, "value", bins, times="times", few_groups=True)
    return join_groups(histogram, medians, groups, small=True)
