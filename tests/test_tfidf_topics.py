import hashlib
from math import log

import numpy as np
import pytest
from pyspark.sql import functions as F

from postweave.operators import joins, tfidf, topics
from postweave.plans.topics import topic_buckets


def test_tf_sums_to_one_and_idf_is_zero_for_common_terms(spark):
    rows = [("d1", "x", 3), ("d1", "y", 1), ("d2", "x", 1), ("d2", "z", 1), ("d3", "x", 2)]
    counts = spark.createDataFrame(rows, "doc string, term string, n bigint")
    for few in (True, False):
        found = tfidf.tf_idf(counts, "term", "doc", "n", few_docs=few).collect()
        sums = {}
        for r in found:
            sums[r["doc"]] = sums.get(r["doc"], 0) + r["tf"]
        assert sums == {d: pytest.approx(1) for d in ("d1", "d2", "d3")}
        weights = {(r["doc"], r["term"]): r["tf_idf"] for r in found}
        assert weights[("d1", "x")] == 0
        assert weights[("d2", "z")] == pytest.approx(0.5 * log(3))


def test_two_way_form_equals_the_general_form(spark, rows_of):
    tokens = [("hi", w) for w in "x x y w".split()] + [("lo", w) for w in "x z z z w".split()]
    df = spark.createDataFrame(tokens, "side string, term string")
    general = tfidf.tf_idf(df.groupBy("side", "term").agg(F.count("*").alias("n")), "term", "side", "n")
    assert rows_of(tfidf.two_way_tf_idf(df, "term", "side", "hi", "lo")) == rows_of(general)


def start_weight(seed, topic, bucket, ngram):
    def bits(text):
        at = 4 * (topic % 8)
        return int(hashlib.md5(f"{seed}.{topic // 8}|{text}".encode()).hexdigest()[at : at + 4], 16) + 1.0

    return bits(bucket) * bits(f"{bucket}|{ngram}")


def brute_force(cells, k, iterations, seed, a, e):
    """The same model with dense numpy arrays over documents, terms and topics."""
    buckets, terms = sorted({c[0] for c in cells}), sorted({c[1] for c in cells})
    n = np.zeros((len(buckets), len(terms)))
    p = np.zeros((len(buckets), len(terms), k))
    for b, t, count in cells:
        i, j = buckets.index(b), terms.index(t)
        n[i, j] = count
        w = np.array([start_weight(seed, z, b, t) for z in range(k)])
        p[i, j] = count * w / w.sum()
    for _ in range(iterations):
        held, kept = p.sum(1), p.sum(0)
        w = (kept[None] + e) * ((held + a) / (held.sum(0) + e * len(terms)))[:, None]
        p = n[:, :, None] * w / w.sum(2, keepdims=True)
    beta = (p.sum((0)) + e) / (p.sum((0, 1)) + e * len(terms))
    gamma = (p.sum(1) + a) / (p.sum((1, 2)) + k * a)[:, None]
    return (
        {(z + 1, t): beta[j, z] for z in range(k) for j, t in enumerate(terms)},
        {(b, z + 1): gamma[i, z] for z in range(k) for i, b in enumerate(buckets)},
    )


CELLS = [
    (b, t, 1 + (3 * i + 5 * j) % 4 + (9 if (i + j) % 3 == 0 else 0))
    for i, b in enumerate(["1-2024", "2-2024", "3-2024", "4-2024"])
    for j, t in enumerate(["a b", "b c", "c d", "d e", "e f"])
    if (i * j) % 4 != 3
]


@pytest.mark.parametrize(("k", "iterations", "seed"), [(2, 0, 0), (3, 6, 1), (10, 3, 2)])
def test_topics_against_brute_force(spark, k, iterations, seed):
    counts = spark.createDataFrame(CELLS, "bucket string, ngram string, n bigint")
    model = topics.fit_topics(counts, k, iterations, seed, tolerance=0)
    beta, gamma = brute_force(CELLS, k, iterations, seed, 50.0 / k, 0.1)
    found = {(r["topic"], r["term"]): r["beta"] for r in topics.all_topic_terms(model).collect()}
    assert found == {key: pytest.approx(value, rel=1e-9) for key, value in beta.items()}
    shares = {(r["document"], r["topic"]): r["gamma"] for r in topics.topic_documents(model).collect()}
    assert shares == {key: pytest.approx(value, rel=1e-9) for key, value in gamma.items()}


def test_topic_shares_sum_to_one(spark):
    counts = spark.createDataFrame(CELLS, "bucket string, ngram string, n bigint")
    model = topics.fit_topics(counts.repartition(7), k=3, iterations=4, tolerance=0)
    beta = topics.all_topic_terms(model).groupBy("topic").agg(F.sum("beta")).collect()
    gamma = topics.topic_documents(model).groupBy("document").agg(F.sum("gamma")).collect()
    assert [r[1] for r in beta] == [pytest.approx(1)] * 3
    assert [r[1] for r in gamma] == [pytest.approx(1)] * 4
    assert topics.topic_terms(model, top=2).count() == 6


def test_topics_separate_documents_without_common_terms(spark):
    cells = [(f"a{i}", t, 20) for i in range(3) for t in ("x", "y")] + [(f"b{i}", t, 20) for i in range(3) for t in ("v", "w")]
    counts = spark.createDataFrame(cells, "bucket string, ngram string, n bigint")
    model = topics.fit_topics(counts, k=2, document_prior=0.1)
    best = {}
    for r in topics.topic_documents(model).collect():
        if r["gamma"] > 0.9:
            best[r["document"]] = r["topic"]
    assert len(best) == 6
    assert len({best[f"a{i}"] for i in range(3)}) == len({best[f"b{i}"] for i in range(3)}) == 1
    assert best["a0"] != best["b0"]


def test_a_fit_ends_when_little_moves(spark, monkeypatch):
    steps = []
    iterate = topics._iterate
    monkeypatch.setattr(topics, "_iterate", lambda *args: steps.append(1) or iterate(*args))
    counts = spark.createDataFrame(CELLS, "bucket string, ngram string, n bigint")
    topics.fit_topics(counts, 2, iterations=6, tolerance=1.0)
    assert len(steps) == 1


def test_large_document_tables_are_not_broadcast(spark, monkeypatch):
    counts = spark.createDataFrame(CELLS, "bucket string, ngram string, n bigint")
    small = topics.all_topic_terms(topics.fit_topics(counts, 2, 2)).collect()
    monkeypatch.setattr(topics, "BROADCAST_BYTES", 0)
    assert not topics._few(1, 2)
    model = topics.fit_topics(counts, 2, 2)
    large = {tuple(r)[:2]: r["beta"] for r in topics.all_topic_terms(model).collect()}
    assert large == {tuple(r)[:2]: pytest.approx(r["beta"]) for r in small}


def test_topic_buckets_clean_and_count(spark, make_posts, rows_of):
    posts = make_posts({"text": "a <b>b</b> a b"}, {"text": "A b https://t.co/x gone"})
    assert rows_of(topic_buckets(posts, n=2)) == [("1-2024", "a b", 3), ("1-2024", "b a", 1), ("1-2024", "b link", 1)]
    assert rows_of(topic_buckets(posts, n=2, stopwords=["a"])) == [("1-2024", "b link", 1)]
    assert topic_buckets(posts, first="2025-01-01").count() == 0


def test_a_fit_leaves_only_its_results(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(topics, "fresh_folder", lambda session, name: str(tmp_path / "topics-1"))
    counts = spark.createDataFrame(CELLS, "bucket string, ngram string, n bigint")
    topics.fit_topics(counts, 2, 3)
    assert sorted(p.name for p in (tmp_path / "topics-1").iterdir()) == ["documents", "terms"]
    assert [row[0] for row in spark.sql("SHOW DATABASES").collect()] == ["default"]


def test_cells_are_written_once(spark, monkeypatch, tmp_path):
    """No file of the cells changes after the first pass, and iterations write no table of their columns."""
    monkeypatch.setattr(topics, "fresh_folder", lambda session, name: str(tmp_path / "topics-2"))
    seen = []
    moved = topics._moved

    def spy(*args):
        home = tmp_path / "topics-2" / "iterations"
        seen.append({p.name: p.stat().st_mtime_ns for p in (home / "cells").iterdir()})
        assert {p.name for p in home.iterdir()} <= {"counts", "cells", "terms_even", "terms_odd", "held_even", "held_odd"}
        return moved(*args)

    monkeypatch.setattr(topics, "_moved", spy)
    topics.fit_topics(spark.createDataFrame(CELLS, "bucket string, ngram string, n bigint"), 2, 4, tolerance=0)
    assert len(seen) == 4 and all(files == seen[0] for files in seen)


def test_iterations_do_not_shuffle_the_cells(spark, monkeypatch):
    plans = []
    iterate = topics._iterate

    def spy(*args):
        step = iterate(*args)
        plans.append(step._jdf.queryExecution().executedPlan().toString())
        return step

    monkeypatch.setattr(topics, "_iterate", spy)
    topics.fit_topics(spark.createDataFrame(CELLS, "bucket string, ngram string, n bigint"), 2, 2, tolerance=0)
    assert len(plans) == 2
    for shown in plans:
        assert "Exchange hashpartitioning(ngram" not in shown
        assert "Bucketed: true" in shown


@pytest.mark.parametrize(
    ("rows", "buckets"), [(0, 1), (60_000, 1), (200_000, 4), (10**6, 8), (10**8, 100), (10**11, 100_000), (10**13, 100_000)]
)
def test_buckets_follow_the_number_of_cells(rows, buckets):
    assert topics._bucket_number(rows, cores=8) == buckets


def test_no_posts_give_no_topics(spark, make_posts):
    from postweave.plans.topics import topic_model

    model = topic_model(make_posts({"text": "a b"}), k=2, iterations=2, first="2030-01-01")
    assert (model.vocabulary, topics.topic_terms(model).count(), topics.topic_documents(model).count()) == (0, 0, 0)


def test_weights_with_a_document_of_half_of_all_terms(spark):
    # document 0 holds every second row, term "t0" lies in every document
    rows = spark.range(0, 200_000, 1, 8).select(
        F.when(F.col("id") % 2 == 0, 0).otherwise(F.col("id") % 4999 + 1).alias("doc"),
        F.when(F.col("id") % 2 == 0, F.concat(F.lit("t"), F.col("id"))).otherwise(F.lit("t0")).alias("term"),
    )
    counts = rows.groupBy("doc", "term").agg(F.count(F.lit(1)).alias("n"))
    totals = counts.groupBy("doc").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("_rows"))
    kept = {name: spark.conf.get(name) for name in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    try:
        for name, value in zip(kept, ("false", "-1")):
            spark.conf.set(name, value)
        joined = joins.dealt_join(counts, totals.drop("_rows"), totals, "doc", ["term"])
        tasks = sorted(r[1] for r in joined.groupBy(F.spark_partition_id()).count().collect())
        assert tasks[-1] < 2 * tasks[len(tasks) // 2]
        weighed = tfidf.tf_idf(counts, "term", "doc", "n")
        assert weighed.count() == counts.count() == sum(tasks)
        documents = totals.count()
        found = weighed.filter("doc = 0 and term in ('t0', 't2')").select("term", "tf", "idf").collect()
        assert {r[0]: r[1:] for r in found} == {"t0": (1e-5, 0.0), "t2": (1e-5, pytest.approx(log(documents)))}
    finally:
        for name, value in kept.items():
            spark.conf.set(name, value)


def test_top_terms_are_ranked_among_the_near_ones(spark):
    """Ties of the n-th, also by rounding alone, are kept; far terms are not rounded and ranked."""
    sums = [(f"t{i}", 0.001 * (i % 100), float(i % 7), 0.5 * i) for i in range(3000)] + [("a", 5.0000001, 9.0, 1.0), ("b", 5.0, 8.0, 1.0), ("c", 4.9999999, 8.0, 1.0), ("d", 4.9, 0.0, 3.0)]
    terms = spark.createDataFrame(sums, "ngram string, p0 double, p1 double, p2 double")
    documents = spark.createDataFrame([("1-2024", 900.0, 8000.0, 3003.0)], "bucket string, p0 double, p1 double, p2 double")
    model = topics.TopicModel(terms, documents, 3, len(sums), 1.0, 0.1, "", 1, 0.0, True)
    for top in (1, 2, 3, 5, 20_000):
        found = sorted(map(tuple, topics.topic_terms(model, top).collect()))
        listed = [(r[0], r[1], r[2]) for r in topics.top_n_by_group(topics._listed_terms(model), "topic", "expected", top).collect()]
        assert found == sorted(listed)
    assert sorted(r["term"] for r in topics.topic_terms(model, 1).filter("topic = 1").collect()) == ["a", "b", "c"]
    assert topics._listed_terms(model, 2).filter("topic = 1 and term like 't%'").count() < 3000 == topics._listed_terms(model).filter("topic = 1 and term like 't%'").count()
