"""Every registered query beside its SQL. ORACLE_SF_DIR picks the scale."""

import os

import pytest

import __spark_entry__ as driver
from tests.oracle_check import compare, connect

SF_DIR = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


OWN = set(driver._QUERIES)


@pytest.mark.parametrize("name", sorted(set(driver.oracle_sql()) & OWN))
def test_query_equals_its_sql(spark, con, name):
    verdict, _ = compare(driver.queries()[name](spark, SF_DIR), con, driver.oracle_sql()[name])
    assert verdict == "ok"


def test_every_query_has_its_sql():
    assert set(driver.oracle_sql()) & OWN == OWN


def test_entry(spark):
    assert driver.entry(spark).columns == ["ngram", "n"]


def test_partitioning_does_not_change_results(spark):
    from postweave.plans.metrics import metric_distribution, top_posts_ngrams
    from postweave.plans.performance import high_low_terms

    columns = ("is_retweet", "text", "favorite_count", "retweet_count")
    posts = driver.posts_view(spark, SF_DIR, *columns)
    for job in (metric_distribution, top_posts_ngrams, high_low_terms):
        results = [sorted(map(repr, job(posts.repartition(parts)).collect())) for parts in (1, 5)]
        assert results[0] == results[1], job.__name__
