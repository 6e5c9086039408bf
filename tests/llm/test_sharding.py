import zlib
from collections import Counter

from postweave.llm import sharding


def test_shards_are_even_and_hold_the_mixture(spark):
    sizes = {"a": 700, "b": 200, None: 90, "c": 10}
    rows = [(k, f"text {k}", source) for k, source in enumerate(s for s, n in sizes.items() for _ in range(n))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)
    made = sharding.interleave(docs).collect()
    per_shard = Counter(row.shard for row in made)
    assert set(per_shard) == set(range(16)) and max(per_shard.values()) - min(per_shard.values()) <= 1
    for source, n in sizes.items():
        held = Counter(row.shard for row in made if row.source == source)
        assert all(abs(held[shard] - n / 16) <= 1.5 for shard in range(16)), source
    for shard in range(16):
        slots = sorted(row.slot for row in made if row.shard == shard)
        assert slots == list(range(len(slots)))
    assert sorted(row.doc_id for row in made) == sorted(row[0] for row in rows)
    again = sharding.interleave(docs.repartition(2)).collect()
    assert {(r.doc_id, r.shard, r.slot) for r in made} == {(r.doc_id, r.shard, r.slot) for r in again}


def test_order_is_by_fraction(spark):
    rows = [(k, "x", "a" if k < 3 else "b") for k in range(40)]
    made = sharding.interleave(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    ordered = sorted(made, key=lambda row: (row.shard, row.slot))
    assert [row.fraction for row in ordered] == sorted(row.fraction for row in made)
    assert sorted(row.fraction for row in made if row.source == "a") == [(r - 0.5) / 3 for r in (1, 2, 3)]


def test_odd_rows(make_docs, crowded, prose):
    long = prose(1, 30_000)
    docs = [(1, None), (2, ""), (3, "é"), (3, "é"), (None, "x"), (None, "x"), (4, long)]
    made = sharding.shard_rows(crowded(make_docs(*docs))).collect()
    assert len(made) == 7 and len({(row.shard, row.slot) for row in made}) == 7
    by_id = {row.doc_id: row for row in made}
    assert (by_id[1].size, by_id[1].text_crc32) == (1, 0)
    assert (by_id[3].size, by_id[3].text_crc32) == (3, zlib.crc32("é".encode()))
    assert by_id[4].size == len(long) + 1
    assert {row.law for row in made} == {"rows"} and {row.grown_shard for row in made} == {None}
    assert sharding.shard_rows(make_docs((1, "x")).filter("false")).count() == 0


def test_no_python_in_the_plan(make_docs):
    plan = sharding.shard_rows(make_docs((1, "x")))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "CartesianProduct" not in plan
