"""Missing groups, texts and dates, and times of day."""

import datetime as dt
from math import erfc, sqrt

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as driver
from postweave.functions import calendar, labels
from postweave.operators import filters, ranking, statistics, tfidf, topics
from postweave.plans import metrics


@pytest.fixture(scope="module")
def grouped(spark):
    rows = [("a", 1), ("a", 5), (None, 2), (None, 4), (None, 9), ("b", None)]
    return spark.createDataFrame(rows, "g string, v long")


@pytest.mark.parametrize("few", [False, True])
def test_a_missing_group_is_a_group(grouped, rows_of, few):
    assert sorted(map(repr, rows_of_any(ranking.top_n_by_group(grouped, "g", "v", 1, few)))) == ["('a', 5)", "(None, 9)"]
    medians = {(row.g, row.v): row["median"] for row in statistics.group_median(grouped, ["g"], "v", few).collect()}
    assert medians == {("a", 1): 3, ("a", 5): 3, (None, 2): 4, (None, 4): 4, (None, 9): 4, ("b", None): None}
    summary = {row.g: row["median"] for row in statistics.metric_summary(grouped, "g", "v", few).collect()}
    assert summary == {"a": 3, None: 4, "b": None}
    assert {row.g for row in statistics.log_histogram(grouped, ["g"], "v", few_groups=few).collect()} == {"a", None}


def rows_of_any(df):
    return [tuple(row) for row in df.collect()]


def test_missing_documents_and_terms_have_weights(spark):
    counts = spark.createDataFrame([(None, "x", 1), ("d", "x", 1), ("d", None, 2)], "doc string, term string, n long")
    made = {(row.doc, row.term): (row.tf, row.idf) for row in tfidf.tf_idf(counts, "term", "doc", "n").collect()}
    assert made[None, "x"] == (1, 0) and made["d", "x"] == (pytest.approx(1 / 3), 0)
    assert made["d", None] == (pytest.approx(2 / 3), pytest.approx(0.6931471805599453))


def test_the_last_day_is_whole(make_posts):
    times = [dt.datetime(2024, 3, 2, 23), dt.datetime(2024, 3, 3), dt.datetime(2024, 3, 4, 15, 30), dt.datetime(2024, 3, 5)]
    posts = make_posts(*[{"created_at": time} for time in times])
    kept = filters.date_range_filter(posts, "2024-03-03", dt.date(2024, 3, 4))
    assert sorted(row.status_id for row in kept.collect()) == ["2", "3"]
    days = posts.withColumn("created_at", F.to_date("created_at"))
    assert sorted(row.status_id for row in filters.date_range_filter(days, "2024-03-03", "2024-03-04").collect()) == ["2", "3"]


@pytest.mark.parametrize("division", ["month", "biweek", "week", "day"])
@pytest.mark.parametrize("with_year", [False, True])
def test_a_missing_date_has_no_bucket(spark, division, with_year):
    day = F.lit(None).cast("date")
    assert spark.range(1).select(calendar.calendar_bucket(day, division, with_year).alias("b")).first()["b"] is None


def test_posts_without_text_are_a_group(make_posts):
    posts = make_posts({"text": "best", "favorite_count": 3}, {"text": None, "favorite_count": 8}, {"text": "x", "favorite_count": 2})
    made = {(row.metric, row.Word): row["median"] for row in metrics.metric_distribution(posts, "best").collect()}
    assert made == {("Favorites", "contains best"): 3, ("Favorites", None): 8, ("Favorites", "doesn't contain best"): 2}


def test_percentiles_to_double_precision(spark):
    scores = [k / 7 for k in range(-90, 91)] + [0.0, 3.0, -3.0, 2.9999999, 20.0, -37.0]
    table = spark.createDataFrame([(z,) for z in scores], "z double")
    for row in table.select("z", labels.normal_percentile(F.col("z")).alias("p")).collect():
        assert row.p == pytest.approx(50 * erfc(-row.z / sqrt(2)), rel=1e-11, abs=1e-12)


def test_local_line_has_no_lag_at_the_ends(spark):
    rows = [("s", dt.date(2024, 1, 1) + dt.timedelta(days=k), 3 * k + 1) for k in range(12)] + [("t", dt.date(2024, 5, 1), 4)]
    series = spark.createDataFrame(rows, "series string, date date, n long")
    made = {(row.series, row.date): row.trend for row in statistics.daily_trend(series, "n", 3, method="linear").collect()}
    assert all(made[series, date] == pytest.approx(n) for series, date, n in rows)
    with pytest.raises(ValueError):
        statistics.daily_trend(series, "n", method="cubic")


def test_stop_word_tables_and_sets(spark):
    grams = spark.createDataFrame([("a cat",), ("big cat",), ("big dog",), (None,)], "ngram string")
    table = spark.createDataFrame([("a",), ("dog",), (None,)], "anything string")
    assert sorted(rows_of_any(filters.drop_stopword_ngrams(grams, "ngram", table)), key=repr) == [("big cat",), (None,)]
    listed = filters.drop_stopword_ngrams(grams, "ngram", [f"w{k}" for k in range(2000)] + ["a", "dog"])
    assert rows_of_any(listed.dropna()) == [("big cat",)]
    assert "INSET" in listed._jdf.queryExecution().optimizedPlan().toString()


def test_a_model_says_how_it_ended(spark):
    cells = spark.createDataFrame([(b, w, n) for b, w, n in (("1", "x", 5), ("1", "y", 3), ("2", "y", 4), ("2", "z", 6))], "bucket string, ngram string, n long")
    short = topics.fit_topics(cells, k=2, iterations=1, tolerance=1e-9)
    assert (short.iterations, short.converged) == (1, False) and short.moved > 0
    settled = topics.fit_topics(cells, k=2, tolerance=0.05)
    assert settled.converged and settled.moved < 0.05
    settled.drop()
    with pytest.raises(Exception):
        settled.terms.count()


def test_no_python_in_any_plan_of_the_library(spark):
    sf_dir = "/root/testdata/sf0.001"
    eager = {"fit_topics", "topic_terms", "topic_documents", "topic_terms_job", "topic_documents_job", "fit_topics_converged"}
    for name, query in driver._QUERIES.items():
        if name not in eager and not name.startswith(("load_", "write_")):
            plan = query(spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
            assert "PythonUDF" not in plan and "MapInArrow" not in plan and "ArrowEvalPython" not in plan, name
