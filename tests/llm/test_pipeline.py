import os

import pytest

import __spark_entry__ as driver
import corpus_pipeline
from postweave.llm import registry
from tests.oracle_check import compare, connect

SF_DIR = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_query_equals_its_sql(spark, name):
    verdict, _ = compare(driver.queries()[name](spark, SF_DIR), connect(SF_DIR), driver.oracle_sql()[name])
    assert verdict == "ok"


def test_queries_and_the_pipeline():
    numbers = sorted(int(name[2:].split("_")[0]) for name in registry.QUERIES)
    assert numbers == list(range(1, 14))
    assert "pipeline" in driver.queries() and len(corpus_pipeline.STAGES) == 5


def test_stages_against_plain_versions(spark):
    from tests.llm.test_decontamination import brute as plain_windows
    from tests.llm.test_line_dedup import brute as lines
    from tests.llm.test_simhash import brute as groups

    documents = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    (_, keep_good), (_, drop_lines), (_, keep_one), (_, drop_held), (_, pack) = corpus_pipeline.STAGES
    given = documents.collect()
    labels = {row.doc_id: row.quality for row in spark.read.parquet(f"{SF_DIR}/labels.parquet").collect()}

    good = keep_good(spark, documents, SF_DIR)
    first = {row.doc_id: row for row in good.collect()}
    assert good.columns == documents.columns and all(first[k] == row for row in given for k in [row.doc_id] if k in first)
    right = sum((doc_id in first) == bool(quality) for doc_id, quality in labels.items())
    assert right >= 0.95 * len(labels)

    lined = drop_lines(spark, good, SF_DIR)
    second = {row.doc_id: row.text for row in lined.collect()}
    assert lined.columns == documents.columns
    assert sorted(second.items(), key=repr) == lines([(k, row.text) for k, row in first.items()])

    single = keep_one(spark, lined, SF_DIR)
    third = {row.doc_id: row.text for row in single.collect()}
    assert set(third) == {doc_id for doc_id, _, component in groups(list(second.items())) if doc_id == component}
    assert all(third[k] == second[k] for k in third)

    clean = drop_held(spark, single, SF_DIR)
    fourth = {row.doc_id for row in clean.collect()}
    assert clean.columns == documents.columns
    items = spark.read.parquet(f"{SF_DIR}/benchmark.parquet").collect()
    held = set()
    for doc_id, text in third.items():
        for item in items:
            windows, hits, _, share = plain_windows(text, item.text)
            if windows and hits >= -(-windows * 4 // 5) and share >= 0.8:
                held.add(doc_id)
    assert fourth == set(third) - held and held

    packed = pack(spark, clean, SF_DIR).collect()
    assert {row.doc_id for row in packed} == fourth
    ran = corpus_pipeline.run(spark, SF_DIR).collect()
    assert sorted(map(tuple, ran)) == sorted(map(tuple, packed))
