import datetime as dt
import statistics as plain
from decimal import Decimal
from math import erf, log, sqrt

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from postweave.functions.labels import HIGH, LOW
from postweave.operators import order_statistics, statistics
from postweave.operators.counts import unpivot_metrics


def values(spark, *rows, kind="bigint"):
    return spark.createDataFrame(list(rows), f"g string, v {kind}")


def medians(df):
    tally = statistics.tally_values(df, ["g"], "v")
    return {r[0]: r[1] for r in statistics.tally_median(tally, ["g"], "v").collect()}


numbers = st.one_of(st.integers(-5, 5), st.integers(-(10**12), 10**12), st.integers(10**9, 10**9 + 3))


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.sampled_from("ab"), numbers), min_size=1, max_size=30))
def test_median_is_exact(spark, rows):
    expected = {}
    for group in {g for g, _ in rows}:
        expected[group] = plain.median(v for g, v in rows if g == group)
    assert medians(values(spark, *rows)) == expected


def test_medians_of_whole_numbers_beyond_doubles_and_of_decimals(spark):
    big = 2**53
    df = values(spark, ("a", big + 1), ("a", big + 3), ("b", 2**63 - 1), ("b", -(2**63)), ("b", 2**63 - 3))
    assert medians(df) == {"a": float(big + 2), "b": float(2**63 - 3)}
    tally = statistics.tally_values(df, ["g"], "v")
    found = order_statistics.values_at(tally, ["g"], "v", "times", {"least": "0", "middle": "_total div 2", "none": "_total"})
    assert sorted(map(tuple, found.collect())) == [("a", big + 1, big + 3, None), ("b", -(2**63), 2**63 - 3, None)]
    exact = [Decimal("1" + "0" * 20 + f".{i:03}") for i in (1, 2, 4)]
    tally = statistics.tally_values(values(spark, *[("a", v) for v in exact], kind="decimal(30,3)"), ["g"], "v")
    found = order_statistics.values_at(tally, ["g"], "v", "times", {"middle": "_total div 2"})
    assert found.first()["middle"] == exact[1]


def test_close_values_are_spread(spark, monkeypatch):
    rows = spark.range(0, 200_000, 1, 4).select(F.lit("a").alias("g"), (10**15 + F.col("id")).alias("v"))
    tally = statistics.tally_values(rows, ["g"], "v")
    seen = []
    cut = order_statistics._cut
    monkeypatch.setattr(order_statistics, "_cut", lambda *args: seen.append(cut(*args)) or seen[-1])
    assert statistics.tally_median(tally, ["g"], "v").first()["median"] == 10**15 + 99_999.5
    # of 200,000 values in one slot, those two parts are put in order that hold the middle
    assert seen[0].count() < 200_000 / 4096 * 2 + 4


def test_median_of_doubles_and_nulls(spark):
    df = values(spark, ("a", 1.5), ("a", None), ("a", 2.5), ("b", None), kind="double")
    assert medians(df) == {"a": 2.0}


def test_median_counts_zeros_and_histogram_leaves_them_out(spark):
    df = values(spark, ("a", 0), ("a", 1), ("a", 10), ("a", 100))
    assert medians(df) == {"a": 5.5}
    bins = statistics.log_histogram(df, ["g"], "v").collect()
    assert sorted((r["bin"], r["n"]) for r in bins) == [(1, 1), (16, 1), (30, 1)]


def test_histogram_of_one_distinct_value(spark):
    bins = statistics.log_histogram(values(spark, ("a", 7), ("a", 7)), ["g"], "v", few_groups=True).collect()
    assert [(r["bin"], r["n"]) for r in bins] == [(1, 2)]


def test_group_median_is_attached_to_every_row(spark, rows_of):
    df = values(spark, ("a", 1), ("a", 4), ("b", 9))
    assert rows_of(statistics.group_median(df, ["g"], "v"), "g", "v", "median") == [
        ("a", 1, 2.5),
        ("a", 4, 2.5),
        ("b", 9, 9.0),
    ]


def test_metric_summary(spark):
    df = values(spark, ("a", 1), ("a", 2), ("a", 6), ("b", 5))
    found = {r["g"]: r for r in statistics.metric_summary(df, "g", "v").collect()}
    row = found["a"]
    assert (row["min"], row["median"], row["mean"], row["max"], row["TotalTweets"]) == (1, 2.0, 3.0, 6, 3)
    assert row["sd"] == pytest.approx(plain.stdev([1, 2, 6]))
    assert found["b"]["sd"] is None


def test_metric_summary_of_missing_close_and_large_values(spark):
    big = 2**53
    rows = [("a", None), ("a", big + 1), ("a", big + 3), ("a", big + 3), ("b", None), (None, 4), (None, 4), ("c", -7), ("c", 7)]
    df = spark.createDataFrame(rows, "g string, v bigint")
    for few in (True, False):
        found = {r["g"]: tuple(r)[1:] for r in statistics.metric_summary(df, "g", "v", few).collect()}
        assert found["a"][:5] == (big + 1, float(big + 3), pytest.approx(big + 7 / 3, rel=1e-15), big + 3, pytest.approx(2 / sqrt(3)))
        assert found["a"][5] == 4
        assert found["b"] == (None, None, None, None, None, 1)
        assert found[None] == (4, 4.0, 4.0, 4, 0.0, 2)
        assert found["c"] == (-7, 0.0, 0.0, 7, pytest.approx(sqrt(98)), 2)
    # values that lie close together far from zero
    close = spark.createDataFrame([("a", 1e9 + x / 8) for x in range(9)], "g string, v double")
    assert statistics.metric_summary(close, "g", "v").first()["sd"] == pytest.approx(plain.stdev([x / 8 for x in range(9)]))


def test_a_summary_reads_its_input_once(spark, tmp_path):
    path = str(tmp_path / "values")
    values(spark, ("a", 1), ("a", 2), ("b", 5)).write.parquet(path)
    df = statistics.metric_summary(spark.read.parquet(path), "g", "v", few_groups=True)
    df.collect()
    final = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert final.count("FileScan parquet") == 1


def test_equal_values_have_no_label(spark):
    df = values(spark, ("a", 3), ("a", 3))
    assert statistics.label_high_low(df, "v", 50).count() == 0
    assert statistics.label_high_low(values(spark, ("a", 3)), "v", 50).count() == 0


def test_labels_follow_the_percentile(spark):
    rows = [("a", v) for v in (0, 1, 5, 20, 300)]
    logs = [log(v + 1) for _, v in rows]
    mean, sd = plain.mean(logs), plain.stdev(logs)
    exact = {v: 50 * (1 + erf((log(v + 1) - mean) / sd / sqrt(2))) for _, v in rows}
    for pct in (1, 30, 50, 80, 100):
        labelled = statistics.label_high_low(values(spark, *rows), "v", pct).collect()
        assert {r["v"]: r["comparison"] for r in labelled} == {v: HIGH if p > pct else LOW for v, p in exact.items()}
    scored = statistics.zscore_percentile(values(spark, *rows), "v", True).collect()
    assert {r["v"]: pytest.approx(r["percentile"]) for r in scored} == exact


@pytest.mark.parametrize("pct", [0, -1, 101])
def test_percentile_is_checked(spark, pct):
    with pytest.raises(ValueError):
        statistics.label_high_low(values(spark, ("a", 1)), "v", pct)


def test_daily_trend_averages_the_days_around(spark):
    days = [("s", dt.date(2024, 1, d), n) for d, n in ((1, 2), (2, 4), (5, 9))]
    df = spark.createDataFrame(days, "series string, date date, n bigint")
    found = {r["date"].day: r["trend"] for r in statistics.daily_trend(df, "n", 1).collect()}
    assert found == {1: 3.0, 2: 3.0, 5: 9.0}


def fitted(points, day, width, degree):
    """The value at ``day`` of a weighted polynomial, by numpy's least squares."""
    days = np.array([d for d, _ in points], dtype=float)
    root = np.sqrt((1 - np.abs((days - day) / width) ** 3) ** 3)
    powers = np.vander((days - day) / width, degree + 1, increasing=True)
    return np.linalg.lstsq(powers * root[:, None], np.array([v for _, v in points]) * root, rcond=None)[0][0]


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.dictionaries(st.integers(0, 24), st.one_of(st.none(), st.integers(-9, 10**6)), min_size=1), st.integers(0, 9))
def test_local_trend_is_the_weighted_fit(spark, held, days):
    start = dt.date(2024, 1, 1)
    df = spark.createDataFrame([("s", start + dt.timedelta(d), n) for d, n in held.items()], "series string, date date, n bigint")
    for row in statistics.daily_trend(df, "n", days, method="local").collect():
        day = (row["date"] - start).days
        near = [(d, n) for d, n in held.items() if n is not None and abs(d - day) <= days]
        if near:
            assert row["trend"] == pytest.approx(fitted(near, day, days + 1, min(len(near), 3) - 1), rel=1e-6, abs=1e-3)
        else:
            assert row["trend"] is None


def test_local_trend_follows_a_parabola_and_keeps_series_and_missing_dates_apart(spark):
    start = dt.date(2024, 1, 1)
    bent = [("a", start + dt.timedelta(d), float(d * d - 3 * d)) for d in range(12)]
    df = spark.createDataFrame([*bent, ("b", start, 7.0), ("b", None, 5.0), (None, start, 2.0)], "series string, date date, n double")
    for row in statistics.daily_trend(df, "n", 4, method="local").collect():
        assert row["trend"] == pytest.approx(row["n"], abs=1e-8)
    assert statistics.daily_trend(df.limit(0), "n", 4, method="local").count() == 0


def test_unpivot(spark, rows_of):
    df = spark.createDataFrame([("1", 2, 3)], "id string, a bigint, b bigint")
    assert rows_of(unpivot_metrics(df, ["id"], ["a", "b"])) == [("1", "a", 2), ("1", "b", 3)]
