import pytest
from pyspark.sql import functions as F

from postweave.operators import ranking


def counts(spark, *rows):
    return spark.createDataFrame(list(rows), "g string, ngram string, n bigint")


def test_top_n_keeps_ties(spark, rows_of):
    df = counts(spark, ("", "x", 3), ("", "y", 2), ("", "z", 2), ("", "w", 1))
    assert rows_of(ranking.top_n(df, "n", 2), "ngram") == [("x",), ("y",), ("z",)]
    assert ranking.top_n(df, "n", 9).count() == 4


@pytest.mark.parametrize("few_groups", [True, False])
def test_top_n_by_group_keeps_ties(spark, rows_of, few_groups):
    df = counts(spark, ("a", "x", 3), ("a", "y", 2), ("a", "z", 2), ("a", "w", 1), ("b", "v", 1), ("b", "u", 1))
    best = ranking.top_n_by_group(df, "g", "n", 2, few_groups=few_groups)
    assert rows_of(best, "g", "ngram") == [("a", "x"), ("a", "y"), ("a", "z"), ("b", "u"), ("b", "v")]


@pytest.mark.parametrize("n", [1, 2, 3, 7])
def test_top_n_by_group_against_brute_force_on_a_skewed_group(spark, rows_of, n):
    rows = [("hot" if i % 3 else f"g{i % 7}", f"t{i}", i * i % 11) for i in range(600)]
    expected = []
    for group in {r[0] for r in rows}:
        values = sorted((r[2] for r in rows if r[0] == group), reverse=True)
        expected += [r for r in rows if r[0] == group and sum(v > r[2] for v in values) < n]
    df = counts(spark, *rows)
    assert rows_of(ranking.top_n_by_group(df, "g", "n", n)) == sorted(expected)
    assert rows_of(ranking.top_n_by_group(df.repartition(13), "g", "n", n, True)) == sorted(expected)


def test_capped_top_cuts_ties_by_label(spark, rows_of):
    df = counts(spark, ("t", "z", 3), ("t", "a", 2), ("t", "b", 2))
    tied = ranking.top_n_by_group(df, "g", "n", 2)
    assert rows_of(ranking.capped_top(tied, "g", "ngram", 2), "ngram") == [("a",), ("b",)]


def test_top_k_exact_breaks_ties_by_id(spark, rows_of):
    df = counts(spark, ("s", "2", 2), ("s", "3", 2), ("s", "1", 2))
    assert rows_of(ranking.top_k_exact(df, "g", "n", 2, tie="ngram"), "ngram") == [("1",), ("2",)]


def test_rank_within_and_sort(spark, rows_of):
    df = counts(spark, ("a", "x", 3), ("a", "y", 1), ("b", "z", 2))
    assert rows_of(ranking.rank_within(df, ["g"], "n", "ngram"), "ngram", "ord") == [("x", 2), ("y", 1), ("z", 1)]
    assert [r[1] for r in ranking.sort_rows(df, F.desc("n")).collect()] == ["x", "z", "y"]


@pytest.mark.parametrize("n", [0, 1, 2, 5, 40, 999])
@pytest.mark.parametrize("descending", [True, False])
def test_first_by_against_brute_force_on_a_hot_value(spark, n, descending):
    rows = [(str(i * 7 % 101), None if i % 31 == 0 else (5 if i % 3 else i % 9)) for i in range(101)]
    known = sorted((r for r in rows if r[1] is not None), key=lambda r: (-r[1] if descending else r[1], r[0]))
    expected = (known + sorted(r for r in rows if r[1] is None))[:n]
    df = spark.createDataFrame(rows, "id string, v bigint").repartition(5)
    assert [tuple(r) for r in ranking.first_by(df, "v", n, "id", descending).collect()] == expected


@pytest.mark.parametrize("n", [1, 3, 4, 50])
def test_nth_value_counts_repeats(spark, n):
    values = [9, 9, 9, 4, 4, 1]
    df = spark.createDataFrame([(v,) for v in values] + [(None,)], "v int")
    found = spark.range(1).select(ranking.nth_value(df, "v", n), ranking.nth_value(df, "v", n, False)).first()
    assert tuple(found) == (values[min(n, 6) - 1], sorted(values)[min(n, 6) - 1])
    assert ranking.top_n(df.limit(0), "v", n).count() == 0


@pytest.mark.parametrize("n", [1, 3, 4, 6, 50])
@pytest.mark.parametrize("kind", ["int", "double", "decimal(30,3)", "date", "timestamp"])
def test_nth_value_by_ranges(spark, monkeypatch, n, kind):
    monkeypatch.setattr(ranking, "LISTED", 0)
    values = [9, 9, 9, 4, 4, -1]
    df = spark.createDataFrame([(v,) for v in values] + [(None,)], "v int")
    made = {"date": F.date_add(F.lit("2024-01-01").cast("date"), "v"), "timestamp": F.timestamp_micros(F.col("v").cast("bigint"))}
    df = df.select("v", made.get(kind, F.col("v").cast(kind)).alias("made"))
    for down, order in ((True, values), (False, sorted(values))):
        reached = df.filter(F.col("made") == ranking.nth_value(df, "made", n, down)).select("v").distinct()
        assert [r[0] for r in reached.collect()] == [order[min(n, 6) - 1]]
    assert ranking.top_n(df.limit(0), "made", n).count() == 0


def test_a_million_of_close_values_without_a_list(spark):
    close = spark.range(0, 1_200_000, 1, 8).select((F.col("id") + 2**60).alias("v"))
    best = ranking.top_n(close, "v", 1_000_000)
    assert "collect_list" not in best._jdf.queryExecution().toString()
    assert tuple(best.agg(F.count("v"), F.min("v")).first()) == (1_000_000, 2**60 + 200_000)


@pytest.mark.parametrize("bad", [0, -1])
def test_n_is_checked(spark, bad):
    df = counts(spark, ("a", "x", 3))
    with pytest.raises(ValueError):
        ranking.top_n(df, "n", bad)
    with pytest.raises(ValueError):
        ranking.top_n_by_group(df, "g", "n", bad)
