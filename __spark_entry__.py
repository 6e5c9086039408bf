"""

The test tables hold no posts, so every query starts from ``posts_view``: a document is a post, and
its order, customer and line items give the other columns. Each query is one call into the library;
what is added here is the derived input, rounding and date-to-text casts that the comparison needs.
"""

from __future__ import annotations

import os
import sys
from collections.abc import Callable

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import DataFrame, SparkSession  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

import oracle_queries  # noqa: E402
from postweave.functions import calendar, labels, text  # noqa: E402
from postweave.operators import (  # noqa: E402
    counts,
    filters,
    lookup_joins,
    ranking,
    statistics,
    tfidf,
    tokens,
    topic_updates,
    topics,
)
from postweave.params import DIVISIONS, METRICS  # noqa: E402
from postweave.plans import metrics, ngrams, performance, sentiment, tables  # noqa: E402
from postweave.plans import topics as topic_plans  # noqa: E402
from postweave.schema import POSTS, RAW_COLUMNS  # noqa: E402
from postweave.sources import csv_folders, lookups, posts, storage  # noqa: E402

try:  # an optional part of the library
    import corpus_pipeline
    import postweave.llm.registry as llm_registry
except ModuleNotFoundError as missing:
    if missing.name not in ("corpus_pipeline", "postweave.llm", "postweave.llm.registry"):
        raise
    corpus_pipeline = llm_registry = None

SMOKE_DIR = "/root/testdata/sf0.001"
STOPWORDS = list(oracle_queries.STOPWORDS)

_FROM_ORDERS = {"screen_name", "created_at", "is_retweet", "favorite_count", "followers_count"}
_FROM_CUSTOMERS = {"screen_name", "followers_count"}


def posts_view(spark: SparkSession, sf_dir: str, *columns: str, marked: bool = False) -> DataFrame:
    """The posts table with ``columns`` only.

    Orders, customers and line items are left-joined on their keys, so a table none of whose columns
    is wanted is not read at all. The joins carry no text except for the documents' own side.
    """

    def table(name: str, *wanted: str) -> DataFrame:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*wanted)

    wanted = set(columns)
    own = ["doc_id"] + ["text"] * ("text" in wanted) + ["source"] * (marked or "is_quote" in wanted)
    view = table("documents", *own)
    if "text" in wanted:
        view = storage.spread(view, "doc_id")
    if wanted & _FROM_ORDERS:
        orders = table("orders", "o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate")
        if wanted & _FROM_CUSTOMERS:
            customers = table("customer", "c_custkey", "c_name", "c_acctbal")
            orders = orders.join(customers, F.col("c_custkey") == F.col("o_custkey"), "left")
        view = view.join(orders, F.col("o_orderkey") == F.col("doc_id"), "left")
    if "retweet_count" in wanted:
        lines = table("lineitem", "l_orderkey", "l_quantity").groupBy("l_orderkey").agg(F.sum("l_quantity").alias("q"))
        view = view.join(lines, F.col("l_orderkey") == F.col("doc_id"), "left")
    mark = [
        F.lit(' a.b <b>"café"</b>, \\n @'),
        F.translate("source", "0123456789", "abcdefghij"),
        F.lit("_9 said\nsee https://t.co/"),
        F.col("doc_id").cast("string"),
        F.lit(" tail\nend"),
    ]
    made = {
        "status_id": lambda: F.col("doc_id").cast("string"),
        "screen_name": lambda: F.col("c_name"),
        "text": lambda: F.concat("text", *mark) if marked else F.col("text"),
        "created_at": lambda: F.to_date("o_orderdate"),
        "is_quote": lambda: F.col("source") == "src0",
        "is_retweet": lambda: F.col("o_orderstatus") == "P",
        "favorite_count": lambda: F.floor(F.col("o_totalprice") / 1000).cast("bigint"),
        "retweet_count": lambda: F.coalesce(F.floor("q").cast("bigint"), F.lit(0).cast("bigint")),
        "followers_count": lambda: F.floor(F.greatest("c_acctbal", F.lit(0.0))).cast("bigint"),
    }
    return view.select(*[made[column]().alias(column) for column in columns])


def marked_posts(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """Posts whose texts end with a link, a quoted phrase and a mention, which the documents lack."""
    return posts_view(spark, sf_dir, *columns, marked=True)


def page_posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw web pages as posts, for the tag pattern."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return storage.spread(pages.select(F.col("page_id").cast("string").alias("status_id"), F.col("html").alias("text")))


def lexicon(spark: SparkSession, name: str = "bing") -> DataFrame:
    """A hand-made lexicon of the documents' sentiment words."""
    return lookups.as_lexicon(spark.sql(oracle_queries.LEXICONS[name]))


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({column: F.round(column, 6) for column in columns})


def dated(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({column: calendar.date_text(F.col(column)) for column in columns})


def entry(spark: SparkSession) -> DataFrame:
    """Flagship: the most frequent bigrams."""
    return ngrams.ngram_top(posts_view(spark, SMOKE_DIR, "text"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = {name: _with_path(query) for name, query in _QUERIES.items()}
    if llm_registry is not None:
        found |= {name: _with_path(query) for name, query in llm_registry.QUERIES.items()}
        found["pipeline"] = _with_path(corpus_pipeline.run)
    return found


def oracle_sql() -> dict[str, str]:
    found = {name: sql for name, sql in oracle_queries.build().items() if name in _QUERIES}
    if llm_registry is not None:
        found |= llm_registry.SQL
        if corpus_pipeline.ORACLE_SQL is not None:
            found["pipeline"] = corpus_pipeline.ORACLE_SQL
    return found


def _with_path(query: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    """``query``, with this folder on the path of Python workers that are started from elsewhere."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        here = os.path.dirname(os.path.abspath(__file__))
        known = spark.sparkContext.environment.get("PYTHONPATH", "")
        if here not in known.split(os.pathsep):
            spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join(filter(None, (here, known)))
        return query(spark, sf_dir)

    return run


_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def _query(function: Callable[[SparkSession, str], DataFrame]):
    _QUERIES[function.__name__.removeprefix("q_")] = function
    return function


# --- sources and sinks


@_query
def q_load_posts_csv(spark, sf_dir):
    folder = storage.fresh_folder(spark, "posts")
    posts.write_posts_csv(marked_posts(spark, sf_dir, *RAW_COLUMNS), folder)
    loaded = posts.load_posts_csv(spark, folder)
    return loaded.withColumn("created_at", F.date_format("created_at", "yyyy-MM-dd HH:mm:ss"))


@_query
def q_write_posts_csv(spark, sf_dir):
    folder = storage.fresh_folder(spark, "posts")
    posts.write_posts_csv(posts_view(spark, sf_dir, *RAW_COLUMNS), folder, rows_per_file=500)
    return dated(posts.normalise_posts(posts.load_posts_csv(spark, folder)), "created_at")


@_query
def q_user_timeline(spark, sf_dir):
    view = posts_view(spark, sf_dir, "screen_name", "status_id", "created_at", "text")
    return dated(posts.user_timeline(view, "Customer#000001378", 3200), "created_at")


@_query
def q_load_lexicon(spark, sf_dir):
    # a scored lexicon of part names, stored as CSV under other column names
    folder = storage.fresh_folder(spark, "lexicons")
    parts = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.lower("p_name").alias("term"), F.col("p_size").alias("score"))
    parts.write.option("header", True).csv(f"{folder}/afinn.csv")
    return lookups.load_lexicon(spark, folder, "afinn", "csv")


@_query
def q_load_stopwords(spark, sf_dir):
    # the customers' market segments as a stored stop-word table
    folder = storage.fresh_folder(spark, "stopwords")
    segments = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.lower("c_mktsegment").alias("word"))
    segments.write.parquet(folder)
    return lookups.load_stopwords(spark, folder)


# --- projections, filters, scalar functions


@_query
def q_clean_text(spark, sf_dir):
    both = page_posts(spark, sf_dir).unionByName(marked_posts(spark, sf_dir, "status_id", "text"))
    return both.select("status_id", text.clean_text(F.col("text")).alias("text"))


@_query
def q_strip_links(spark, sf_dir):
    marked = marked_posts(spark, sf_dir, "status_id", "text")
    return marked.select("status_id", text.strip_links(F.col("text")).alias("text"))


@_query
def q_normalise_posts(spark, sf_dir):
    return dated(posts.normalise_posts(marked_posts(spark, sf_dir, *RAW_COLUMNS)), "created_at")


@_query
def q_select_columns(spark, sf_dir):
    view = posts_view(spark, sf_dir, "status_id", *METRICS)
    return filters.select_columns(view, ["status_id", *METRICS], labels.RECEIVED_NAMES)


@_query
def q_original_posts(spark, sf_dir):
    return filters.original_posts(posts_view(spark, sf_dir, "status_id", "is_retweet", "favorite_count"))


@_query
def q_exclude_pattern(spark, sf_dir):
    grams = tokens.tokenize_ngrams(posts_view(spark, sf_dir, "text"), n=2)
    return counts.count_by(filters.exclude_pattern(grams, "ngram", "^th|[aeiou]n "), "ngram")


@_query
def q_contains_pattern(spark, sf_dir):
    grams = tokens.tokenize_ngrams(posts_view(spark, sf_dir, "text"), n=2)
    return counts.count_by(filters.contains_pattern(grams, "ngram", "^th|[aeiou]n "), "ngram")


def _drop_stopwords(spark, sf_dir, mode):
    grams = tokens.tokenize_ngrams(posts_view(spark, sf_dir, "text"), n=2)
    return counts.count_by(filters.drop_stopword_ngrams(grams, "ngram", STOPWORDS, mode), "ngram")


@_query
def q_drop_stopword_ngrams(spark, sf_dir):
    return _drop_stopwords(spark, sf_dir, "token")


@_query
def q_drop_stopword_ngrams_substring(spark, sf_dir):
    return _drop_stopwords(spark, sf_dir, "substring")


@_query
def q_exclude_exact(spark, sf_dir):
    words = tokens.tokenize_words(posts_view(spark, sf_dir, "text"))
    return counts.count_by(filters.exclude_exact(words, "word", "the"), "word")


@_query
def q_date_range_filter(spark, sf_dir):
    view = posts_view(spark, sf_dir, "status_id", "created_at")
    return dated(filters.date_range_filter(view, "1996-02-01", "1998-06-30"), "created_at")


@_query
def q_calendar_buckets(spark, sf_dir):
    view = posts_view(spark, sf_dir, "status_id", "created_at")
    made = [calendar.calendar_bucket(F.col("created_at"), division).alias(division) for division in DIVISIONS]
    return view.select("status_id", *made, calendar.calendar_bucket(F.col("created_at"), "week", True).alias("week_year"))


@_query
def q_date_casts(spark, sf_dir):
    view = spark.read.parquet(f"{sf_dir}/events.parquet")
    return view.select("event_id", calendar.date_text(F.col("ts")).alias("day"))


@_query
def q_lower_text(spark, sf_dir):
    return posts_view(spark, sf_dir, "status_id", "text").select("status_id", text.lower_text(F.col("text")).alias("text"))


@_query
def q_label_contains(spark, sf_dir):
    view = posts_view(spark, sf_dir, "status_id", "text")
    return view.select("status_id", labels.label_contains(F.col("text"), "The [aio]").alias("Word"))


@_query
def q_label_metric(spark, sf_dir):
    long = counts.unpivot_metrics(posts_view(spark, sf_dir, "status_id", *METRICS), ["status_id"], METRICS, "metric")
    return long.select("status_id", labels.label_metric(F.col("metric")).alias("metric"), "value")


@_query
def q_signed_mirror(spark, sf_dir):
    words = tokens.tokenize_words(posts_view(spark, sf_dir, "text"))
    found = lookup_joins.count_sentiments(words, lexicon(spark), ["word"])
    return found.withColumn("n", labels.signed_mirror(F.col("n"), F.col("sentiment"), labels.NEGATIVE))


@_query
def q_normalise_handle(spark, sf_dir):
    pieces = tokens.tokenize_whitespace(posts_view(spark, sf_dir, "status_id", "text"))
    return counts.count_by(pieces.select(text.normalise_handle(F.col("word")).alias("handle")), "handle")


@_query
def q_log_scores(spark, sf_dir):
    view = posts_view(spark, sf_dir, "status_id", "retweet_count")
    made = view.select(
        "status_id",
        labels.log_score(F.col("retweet_count")).alias("log_score"),
        labels.log_scale(F.col("retweet_count")).alias("log_scale"),
    )
    return rounded(made, "log_score", "log_scale")


# --- tokenisation


@_query
def q_tokenize_words(spark, sf_dir):
    return tokens.tokenize_words(posts_view(spark, sf_dir, "status_id", "text"))


@_query
def q_tokenize_words_numbers(spark, sf_dir):
    # numbers, joiners and scripts beside order numbers; the expression is SQL of both engines
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    numbered = oracle_queries.NUMBERED.replace("''", "\\'")
    made = orders.select(F.col("o_orderkey").cast("string").alias("status_id"), F.expr(numbered).alias("text"))
    return tokens.tokenize_words(made)


@_query
def q_tokenize_ngrams(spark, sf_dir):
    return tokens.tokenize_ngrams(posts_view(spark, sf_dir, "status_id", "text"), n=2)


def _ngram_counts(spark, sf_dir, n):
    return counts.count_by(tokens.tokenize_ngrams(posts_view(spark, sf_dir, "text"), n=n), "ngram")


@_query
def q_tokenize_ngrams_1(spark, sf_dir):
    return _ngram_counts(spark, sf_dir, 1)


@_query
def q_tokenize_ngrams_3(spark, sf_dir):
    return _ngram_counts(spark, sf_dir, 3)


@_query
def q_tokenize_ngrams_4(spark, sf_dir):
    return _ngram_counts(spark, sf_dir, 4)


@_query
def q_tokenize_whitespace(spark, sf_dir):
    return tokens.tokenize_whitespace(posts_view(spark, sf_dir, "status_id", "text"))


@_query
def q_first_word(spark, sf_dir):
    grams = tokens.tokenize_ngrams(posts_view(spark, sf_dir, "text"), n=2)
    return counts.count_by(grams.select(text.first_word(F.col("ngram")).alias("word")), "word")


@_query
def q_extract_mentions(spark, sf_dir):
    return tokens.extract_mentions(marked_posts(spark, sf_dir, "status_id", "text"))


# --- joins


@_query
def q_lexicon_join(spark, sf_dir):
    words = tokens.tokenize_words(posts_view(spark, sf_dir, "status_id", "text"))
    return lookup_joins.lexicon_join(words, lexicon(spark, "nrc")).select("status_id", "word", "sentiment")


@_query
def q_lexicon_join_large(spark, sf_dir):
    # a lexicon that grows with the posts: every word of theirs, by its first letter and under one common label
    words = tokens.tokenize_words(posts_view(spark, sf_dir, "status_id", "text"))
    labels = F.explode(F.array(F.substring("word", 1, 1), F.lit("any")))
    listed = words.select("word").distinct().select("word", labels.alias("sentiment"))
    return lookup_joins.count_sentiments(words, listed, ["status_id"], small=False)


@_query
def q_join_back_text(spark, sf_dir):
    words = tokens.tokenize_words(posts_view(spark, sf_dir, "status_id", "text"))
    ids = lookup_joins.count_sentiments(words, lexicon(spark), ["status_id"])
    return lookup_joins.join_back_text(ids, posts_view(spark, sf_dir, "status_id", "text"))


@_query
def q_ngram_context(spark, sf_dir):
    grams = tokens.tokenize_ngrams(posts_view(spark, sf_dir, "status_id", "text"), n=2)
    return lookup_joins.lexicon_join(tokens.ngram_words(grams), lexicon(spark)).select("status_id", "ngram", "word", "sentiment")


# --- aggregations and reshape


@_query
def q_count_by(spark, sf_dir):
    return counts.count_by(posts_view(spark, sf_dir, "screen_name", "is_retweet"), "screen_name", "is_retweet")


@_query
def q_metric_summary(spark, sf_dir):
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_returnflag", "l_quantity")
    return rounded(statistics.metric_summary(lines, "l_returnflag", "l_quantity"), "min", "median", "mean", "max", "sd")


@_query
def q_daily_sums(spark, sf_dir):
    return dated(counts.daily_sums(posts_view(spark, sf_dir, "created_at", *METRICS)), "date")


@_query
def q_group_median(spark, sf_dir):
    long = counts.unpivot_metrics(
        posts_view(spark, sf_dir, "status_id", "is_retweet", *METRICS), ["status_id", "is_retweet"], METRICS, "metric"
    )
    return statistics.group_median(long, ["metric", "is_retweet"], "value", few_groups=True)


@_query
def q_unpivot_metrics(spark, sf_dir):
    return counts.unpivot_metrics(posts_view(spark, sf_dir, "status_id", *METRICS), ["status_id"], METRICS)


@_query
def q_date_bounds(spark, sf_dir):
    return dated(counts.date_bounds(posts_view(spark, sf_dir, "created_at")), "first", "last")


@_query
def q_tf_idf(spark, sf_dir):
    grams = tokens.tokenize_ngrams(posts_view(spark, sf_dir, "is_quote", "created_at", "text"), n=1, out="word")
    per_year = counts.count_by(grams.select(F.year("created_at").alias("year"), "word"), "year", "word")
    return rounded(tfidf.tf_idf(per_year, "word", "year", "n"), "tf", "idf", "tf_idf")


@_query
def q_log_histogram(spark, sf_dir):
    long = counts.unpivot_metrics(posts_view(spark, sf_dir, "is_retweet", *METRICS), ["is_retweet"], METRICS, "metric")
    return statistics.log_histogram(long, ["metric", "is_retweet"], "value", few_groups=True)


def _scores(spark, sf_dir, with_percentile):
    scored = []
    for metric in METRICS:
        one = posts_view(spark, sf_dir, "status_id", metric).select("status_id", F.col(metric).alias("value"))
        scores = statistics.zscore_percentile(one, "value", with_percentile)
        scored.append(scores.withColumn("metric", F.lit(metric)))
    return scored[0].unionByName(scored[1])


@_query
def q_zscore_percentile(spark, sf_dir):
    return rounded(_scores(spark, sf_dir, False), "z")


@_query
def q_zscore_percentile_values(spark, sf_dir):
    return rounded(_scores(spark, sf_dir, True), "z", "percentile")


@_query
def q_label_high_low(spark, sf_dir):
    view = posts_view(spark, sf_dir, "status_id", "retweet_count")
    return statistics.label_high_low(view, "retweet_count", 75)


# --- ranking


@_query
def q_top_n(spark, sf_dir):
    return ranking.top_n(posts_view(spark, sf_dir, "status_id", "retweet_count"), "retweet_count", 25)


@_query
def q_top_n_deep(spark, sf_dir):
    # more distinct values than one list takes
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_linenumber", "l_extendedprice")
    return ranking.top_n(lines, "l_extendedprice", 25_000)


@_query
def q_top_n_by_group(spark, sf_dir):
    view = posts_view(spark, sf_dir, "status_id", "screen_name", "retweet_count")
    return ranking.top_n_by_group(view, "screen_name", "retweet_count", 1)


@_query
def q_top_k_exact(spark, sf_dir):
    view = posts_view(spark, sf_dir, "status_id", "is_retweet", "retweet_count")
    return ranking.top_k_exact(view, "is_retweet", "retweet_count", 25, tie="status_id")


@_query
def q_capped_top(spark, sf_dir):
    grams = tokens.tokenize_ngrams(posts_view(spark, sf_dir, "is_retweet", "text"), n=2)
    per_kind = counts.count_by(grams, "is_retweet", "ngram")
    tied = ranking.top_n_by_group(per_kind, "is_retweet", "n", 25, few_groups=True)
    return ranking.capped_top(tied, "is_retweet", "ngram", 25)


@_query
def q_sort_rows(spark, sf_dir):
    view = posts_view(spark, sf_dir, "status_id", *METRICS)
    return ranking.sort_rows(view, F.desc("favorite_count"), "retweet_count", "status_id")


@_query
def q_preview(spark, sf_dir):
    return dated(ranking.preview(posts_view(spark, sf_dir, "status_id", "created_at", "text")), "created_at")


@_query
def q_rank_within(spark, sf_dir):
    best = sentiment.sentiment_words(posts_view(spark, sf_dir, "text"), lexicon(spark, "nrc"), top=5)
    return ranking.rank_within(best, ["sentiment"], "n", tie="word").withColumn("ord", F.col("ord").cast("bigint"))


@_query
def q_daily_trend(spark, sf_dir):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    daily = counts.count_by(events.select(F.col("event_type").alias("series"), F.to_date("ts").alias("date")), "series", "date")
    return rounded(dated(statistics.daily_trend(daily, "n", 3), "date"), "trend")


@_query
def q_daily_trend_linear(spark, sf_dir):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    daily = counts.count_by(events.select(F.col("event_type").alias("series"), F.to_date("ts").alias("date")), "series", "date")
    return rounded(dated(statistics.daily_trend(daily, "n", 3, method="linear"), "date"), "trend")


@_query
def q_daily_trend_local(spark, sf_dir):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    daily = counts.count_by(events.select(F.col("event_type").alias("series"), F.to_date("ts").alias("date")), "series", "date")
    return rounded(dated(statistics.daily_trend(daily, "n", 3, method="local"), "date"), "trend")


# --- rows with missing keys, texts and dates, and times of day


def gapped_posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as posts, of which some have no account, no text or no date."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    key = F.col("o_orderkey")
    return orders.select(
        key.cast("string").alias("status_id"),
        F.when(key % 5 > 0, F.col("o_orderpriority")).alias("screen_name"),
        F.when(key % 7 > 0, F.concat("o_orderpriority", F.substring(F.lit(" best"), F.lit(1), (key % 6).cast("int")))).alias("text"),
        F.when(key % 3 > 0, F.to_date("o_orderdate")).alias("created_at"),
        F.floor(F.col("o_totalprice") / 1000).cast("bigint").alias("favorite_count"),
        (key % 11).cast("bigint").alias("retweet_count"),
        F.lit(False).alias("is_retweet"),
    )


@_query
def q_date_range_filter_times(spark, sf_dir):
    # the second and third day of the events, whose times of day are kept
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", F.col("ts").alias("created_at"))
    first = events.agg(F.date_add(F.to_date(F.min("created_at")), 1), F.date_add(F.to_date(F.min("created_at")), 2)).first()
    return dated(filters.date_range_filter(events, *first), "created_at")


@_query
def q_calendar_buckets_missing(spark, sf_dir):
    made = [calendar.calendar_bucket(F.col("created_at"), division).alias(division) for division in DIVISIONS]
    yearly = calendar.calendar_bucket(F.col("created_at"), "week", True).alias("week_year")
    return gapped_posts(spark, sf_dir).select("status_id", *made, yearly)


@_query
def q_top_n_by_group_missing(spark, sf_dir):
    view = gapped_posts(spark, sf_dir).select("status_id", "screen_name", "favorite_count")
    return ranking.top_n_by_group(view, "screen_name", "favorite_count", 3)


@_query
def q_metric_summary_missing(spark, sf_dir):
    made = statistics.metric_summary(gapped_posts(spark, sf_dir), "screen_name", "favorite_count")
    return rounded(made, "median", "mean", "sd")


@_query
def q_group_median_missing(spark, sf_dir):
    view = gapped_posts(spark, sf_dir).select("status_id", "screen_name", "favorite_count")
    return statistics.group_median(view, ["screen_name"], "favorite_count")


@_query
def q_log_histogram_missing(spark, sf_dir):
    return statistics.log_histogram(gapped_posts(spark, sf_dir), ["screen_name"], "favorite_count")


@_query
def q_tf_idf_missing(spark, sf_dir):
    view = gapped_posts(spark, sf_dir).select("screen_name", F.month("created_at").alias("term"))
    return rounded(tfidf.tf_idf(counts.count_by(view, "screen_name", "term"), "term", "screen_name", "n"), "tf", "idf", "tf_idf")


@_query
def q_metric_distribution_missing(spark, sf_dir):
    return rounded(metrics.metric_distribution(gapped_posts(spark, sf_dir), "best"), "median")


@_query
def q_load_posts_csv_marks(spark, sf_dir):
    # texts that are missing, empty or look like marks of a missing one
    key = F.col("o_orderkey")
    mark = F.when(key % 4 == 0, None).when(key % 4 == 1, "").when(key % 4 == 2, "\\N").otherwise("\\\\N")
    made = {field.name: F.lit(None).cast(field.dataType).alias(field.name) for field in POSTS}
    made |= {"status_id": key.cast("string").alias("status_id"), "text": mark.alias("text")}
    folder = storage.fresh_folder(spark, "posts")
    posts.write_posts_csv(spark.read.parquet(f"{sf_dir}/orders.parquet").select(*made.values()), folder)
    return posts.load_posts_csv(spark, folder).select("status_id", "text")


@_query
def q_drop_stopword_ngrams_table(spark, sf_dir):
    # a stop-word table of any size: the words of part names and of raw pages
    named = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.explode(F.split("p_name", " ")).alias("word"))
    paged = spark.read.parquet(f"{sf_dir}/pages.parquet").select(F.explode(F.split("html", " ")).alias("word"))
    listed = named.unionByName(paged).select(F.lower("word").alias("word"))
    grams = tokens.tokenize_ngrams(posts_view(spark, sf_dir, "text"), n=2)
    return filters.drop_stopword_ngrams(counts.count_by(grams, "ngram"), "ngram", listed)


@_query
def q_drop_stopword_ngrams_substring_table(spark, sf_dir):
    # some ten thousand stop words: the words of part names, without their last two letters, and the digits of order keys
    named = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.explode(F.split("p_name", " ")).alias("word"))
    named = named.select(F.expr("substr(word, 1, length(word) - 2)").alias("word")).filter("length(word) > 1")
    keyed = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").cast("string").alias("word"))
    grams = counts.count_by(tokens.tokenize_ngrams(posts_view(spark, sf_dir, "text"), n=2), "ngram")
    return filters.drop_stopword_ngrams(grams, "ngram", named.unionByName(keyed), "substring")


def _two_makers(spark, sf_dir, written) -> str:
    """A folder of posts in two headers: every second post as the library writes them, the others in another order."""
    folder = storage.fresh_folder(spark, "posts")
    odd = F.col("status_id").cast("bigint") % 2 == 1
    posts.write_posts_csv(written.filter(~odd), f"{folder}/own")
    other = written.filter(odd).select(F.lit("x,y").alias("maker"), *reversed(written.columns), F.col("text").alias("again"))
    other.write.options(**posts.CSV).option("quoteAll", True).csv(f"{folder}/other")
    return f"{folder}/*"


@_query
def q_load_posts_csv_mixed(spark, sf_dir):
    folder = _two_makers(spark, sf_dir, marked_posts(spark, sf_dir, *RAW_COLUMNS))
    loaded, _ = csv_folders.load_posts_folder(spark, folder)
    return loaded.withColumn("created_at", F.date_format("created_at", "yyyy-MM-dd HH:mm:ss"))


@_query
def q_load_posts_csv_rejected(spark, sf_dir):
    # some of the dates and counts are words
    key, made = F.col("status_id").cast("bigint"), posts_view(spark, sf_dir, *RAW_COLUMNS)
    made = made.withColumns({
        "created_at": F.when(key % 7 == 0, "someday").otherwise(F.date_format("created_at", "yyyy-MM-dd HH:mm:ss")),
        "favorite_count": F.when(key % 5 == 0, "many").otherwise(F.col("favorite_count").cast("string")),
    })
    _, rejected = csv_folders.load_posts_folder(spark, _two_makers(spark, sf_dir, made))
    maker = F.regexp_extract("file", "/(own|other)/[^/]*$", 1)
    return rejected.select(F.get_json_object("row", "$.status_id").alias("status_id"), maker.alias("maker"), "reason")


# --- set operations


@_query
def q_union_series(spark, sf_dir):
    view = posts_view(spark, sf_dir, "created_at", "is_retweet")
    kinds = counts.count_by(
        view.select(F.when(F.col("is_retweet"), "retweets").otherwise("originals").alias("series"), F.col("created_at").alias("date")),
        "series",
        "date",
    )
    volume = sentiment.posts_daily(view).select(F.lit("Tweets/Day").alias("series"), "date", "n")
    return dated(counts.union_series(kinds, volume), "date")


# --- topic modelling


def _topic_model(spark, sf_dir):
    view = posts_view(spark, sf_dir, "created_at", "text")
    return topic_plans.topic_model(view, k=4)


@_query
def q_document_terms(spark, sf_dir):
    words = tokens.tokenize_words(posts_view(spark, sf_dir, "created_at", "text"), out="ngram")
    bucketed = words.select(calendar.calendar_bucket(F.col("created_at"), "biweek").alias("bucket"), "ngram")
    return topics.document_terms(bucketed)


@_query
def q_fit_topics(spark, sf_dir):
    model = _topic_model(spark, sf_dir)
    held = [F.col(f"p{topic}").alias(f"topic{topic + 1}") for topic in range(model.k)]
    return rounded(model.documents.select("bucket", *held), *[f"topic{topic + 1}" for topic in range(model.k)])


@_query
def q_topic_terms(spark, sf_dir):
    return rounded(topics.topic_terms(_topic_model(spark, sf_dir), top=25), "beta")


@_query
def q_topic_documents(spark, sf_dir):
    return rounded(topics.topic_documents(_topic_model(spark, sf_dir)), "gamma")


@_query
def q_fit_topics_converged(spark, sf_dir):
    # a fit that ends by its tolerance; it divides all counts of a bucket among the topics
    model = topic_plans.topic_model(posts_view(spark, sf_dir, "created_at", "text"), k=3, n=1, division="biweek", seed=7, tolerance=0.01)
    held = sum((F.col(f"p{topic}") for topic in range(model.k)), F.lit(0.0))
    return model.documents.select("bucket", F.round(held).cast("bigint").alias("n"), F.lit(model.converged).alias("converged"))


@_query
def q_update_topics(spark, sf_dir):
    # fitted on the older posts, then updated with the newer in two batches: the sums per n-gram are those of all posts
    view = posts_view(spark, sf_dir, "created_at", "text")
    older = {"n": 1, "division": "biweek", "last": "1995-06-30"}
    model = topic_plans.topic_model(view, k=3, seed=7, tolerance=0.01, **older)
    newer = topic_plans.topic_buckets(view, first="1995-07-01", n=1, division="biweek")
    updated = topic_updates.update_topics(model, newer, batches=2, tolerance=0.01)
    held = sum((F.col(f"p{topic}") for topic in range(updated.k)), F.lit(0.0))
    return updated.terms.select("ngram", F.round(held).cast("bigint").alias("n"))


@_query
def q_topic_likelihood(spark, sf_dir):
    view = posts_view(spark, sf_dir, "created_at", "text")
    told = topic_updates.topic_likelihood(_topic_model(spark, sf_dir), topic_plans.topic_buckets(view))
    return rounded(told.select("document", "n", (F.col("log_likelihood") / F.col("n")).alias("per_word")), "per_word")


# --- the complete analytics


@_query
def q_post_summary(spark, sf_dir):
    return rounded(metrics.post_summary(posts_view(spark, sf_dir, "is_retweet", *METRICS)), "median", "mean", "sd")


@_query
def q_ngram_top(spark, sf_dir):
    return ngrams.ngram_top(posts_view(spark, sf_dir, "text"))


@_query
def q_ngram_top_filtered(spark, sf_dir):
    return ngrams.ngram_top(
        posts_view(spark, sf_dir, "text"), n=3, top=25, filterword="ing", containword="er", stopwords=STOPWORDS
    )


@_query
def q_ngram_negation(spark, sf_dir):
    return ngrams.ngram_negation(posts_view(spark, sf_dir, "text"), "no")


@_query
def q_sentiment_words(spark, sf_dir):
    return sentiment.sentiment_words(posts_view(spark, sf_dir, "text"), lexicon(spark), filterword="with")


@_query
def q_sentiment_words_nrc(spark, sf_dir):
    return sentiment.sentiment_words(posts_view(spark, sf_dir, "text"), lexicon(spark, "nrc"), top=2)


@_query
def q_sentiment_words_afinn(spark, sf_dir):
    return sentiment.sentiment_words(posts_view(spark, sf_dir, "text"), lexicon(spark, "afinn"))


@_query
def q_sentiment_daily(spark, sf_dir):
    return dated(sentiment.sentiment_daily(posts_view(spark, sf_dir, "created_at", "text"), lexicon(spark)), "date")


@_query
def q_sentiment_trend(spark, sf_dir):
    view = posts_view(spark, sf_dir, "created_at", "is_retweet", "text")
    return rounded(dated(sentiment.sentiment_trend(view, lexicon(spark)), "date"), "trend")


@_query
def q_sentiment_trend_local(spark, sf_dir):
    view = posts_view(spark, sf_dir, "created_at", "is_retweet", "text")
    return rounded(dated(sentiment.sentiment_trend(view, lexicon(spark), 14, method="local"), "date"), "trend")


@_query
def q_ngram_sentiment(spark, sf_dir):
    return sentiment.ngram_sentiment(posts_view(spark, sf_dir, "text"), lexicon(spark), filterword="ing")


@_query
def q_sentiment_posts(spark, sf_dir):
    view = posts_view(spark, sf_dir, "status_id", "created_at", "is_retweet", "text")
    return dated(sentiment.sentiment_posts(view, lexicon(spark)), "created_at")


@_query
def q_metric_daily(spark, sf_dir):
    return dated(metrics.metric_daily(posts_view(spark, sf_dir, "created_at", "is_retweet", *METRICS)), "date")


@_query
def q_metric_trend(spark, sf_dir):
    view = posts_view(spark, sf_dir, "created_at", "is_retweet", *METRICS)
    return rounded(dated(metrics.metric_trend(view), "date"), "trend")


@_query
def q_metric_trend_local(spark, sf_dir):
    view = posts_view(spark, sf_dir, "created_at", "is_retweet", *METRICS)
    return rounded(dated(metrics.metric_trend(view, 14, method="local"), "date"), "trend")


@_query
def q_top_posts(spark, sf_dir):
    view = posts_view(spark, sf_dir, "status_id", "created_at", "is_retweet", "text", *METRICS)
    return metrics.top_posts(view, "retweet_count")


@_query
def q_top_posts_ngrams(spark, sf_dir):
    return metrics.top_posts_ngrams(posts_view(spark, sf_dir, "is_retweet", "text", *METRICS), filterword="ing")


@_query
def q_top_posts_ngrams_stopwords(spark, sf_dir):
    view = posts_view(spark, sf_dir, "is_retweet", "text", *METRICS)
    return metrics.top_posts_ngrams(view, toptweetn=250, top=10, stopwords=STOPWORDS)


@_query
def q_mention_top(spark, sf_dir):
    return metrics.mention_top(marked_posts(spark, sf_dir, "is_retweet", "text"), filterusername="srch")


@_query
def q_metric_distribution(spark, sf_dir):
    view = posts_view(spark, sf_dir, "is_retweet", "text", *METRICS)
    return rounded(metrics.metric_distribution(view, "Best"), "median")


@_query
def q_high_low_terms(spark, sf_dir):
    view = posts_view(spark, sf_dir, "is_retweet", "text", *METRICS)
    return rounded(performance.high_low_terms(view), "tf", "idf", "tf_idf")


@_query
def q_topic_buckets(spark, sf_dir):
    view = posts_view(spark, sf_dir, "created_at", "text")
    return topic_plans.topic_buckets(view, "1996-01-01", "1999-12-31", "week", filterword="ing", stopwords=STOPWORDS)


@_query
def q_topic_terms_job(spark, sf_dir):
    view = posts_view(spark, sf_dir, "created_at", "text")
    job = topic_plans.topic_terms_job(
        view, top=5, k=3, seed=7, n=1, division="biweek", stopwords=STOPWORDS
    )
    return rounded(job, "beta")


@_query
def q_topic_documents_job(spark, sf_dir):
    view = posts_view(spark, sf_dir, "created_at", "text")
    job = topic_plans.topic_documents_job(
        view, k=3, seed=7, n=1, division="biweek", stopwords=STOPWORDS
    )
    return rounded(job, "gamma")


@_query
def q_post_preview(spark, sf_dir):
    return tables.post_preview(posts_view(spark, sf_dir, "status_id", "created_at", "text"))


@_query
def q_raw_table(spark, sf_dir):
    return tables.raw_table(posts_view(spark, sf_dir, *RAW_COLUMNS))
