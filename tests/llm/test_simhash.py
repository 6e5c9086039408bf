import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from postweave.llm import components, simhash


def brute(docs, words=3):
    fps = []
    for doc_id, text in docs:
        own = (text or "").encode().lower().split()
        shingles = [b" ".join(own[i : i + words]) for i in range(len(own) - words + 1)] or ([b" ".join(own)] if own else [])
        hashes = [xxh64_intdigest(shingle, 42) for shingle in shingles]
        fps.append(sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)))
    group = list(range(len(docs)))
    for i in range(len(docs)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 3 and group[i] != group[j]:
                low, high = sorted((group[i], group[j]))
                group = [low if g == high else g for g in group]
    ids = [[docs[k][0] for k in range(len(docs)) if group[k] == g and docs[k][0] is not None] for g in group]
    return sorted(((doc_id, f"{fp:016x}", min(own) if own else None) for (doc_id, _), fp, own in zip(docs, fps, ids)), key=repr)


def test_every_pair_within_the_radius_shares_a_table():
    draw = random.Random(1)
    for _ in range(5000):
        apart = sum(1 << p for p in draw.sample(range(64), draw.randint(0, 3)))
        assert any(not apart & mask for mask in simhash.MASKS)
        for mask, subs in zip(simhash.MASKS, simhash.SUB_MASKS):
            if not apart & mask:
                assert any(not apart & sub for sub in subs)


def test_components_equal_brute_force(make_docs, crowded, prose):
    base = prose(1, 300).split()
    near = [" ".join(base[:k] + ["changed"] + base[k + 1 :]) for k in range(0, 300, 10)]
    docs = [(10 + k, text) for k, text in enumerate(near)]
    docs += [(1, None), (2, ""), (3, " \t\n"), (4, "One two"), (5, "ONE two"), (6, prose(6, 40_000)), (6, prose(6, 40_000))]
    docs += [(None, prose(7)), (7, prose(7)), (None, prose(8)), (8, prose(9)), (9, "é ü word")]
    made = simhash.components(crowded(make_docs(*docs))).collect()
    assert sorted(map(tuple, made), key=repr) == brute(docs)
    assert simhash.components(make_docs((1, "x")).filter("false")).count() == 0


@pytest.mark.parametrize("limit", [2, 5, 1024])
def test_large_buckets_lose_no_link(spark, limit):
    draw = random.Random(limit)
    centre = draw.getrandbits(64)
    fps = {centre ^ sum(1 << p for p in draw.sample(range(20), draw.randint(0, 6))) for _ in range(400)}
    fps |= {draw.getrandbits(64) for _ in range(100)}
    signed = sorted(fp - (1 << 64) if fp >> 63 else fp for fp in fps)
    table = spark.createDataFrame([(fp,) for fp in signed], "fp long").repartition(4)
    found = components.connected(simhash.links(table, limit)).collect()
    ours = {row.node: row.component for row in found}
    group = {fp: fp for fp in signed}
    values = np.array(signed, dtype=np.int64).view(np.uint64)
    for i, fp in enumerate(signed):
        for j in np.flatnonzero(np.bitwise_count(values[i] ^ values[:i]) <= 3):
            low, high = sorted((group[fp], group[signed[j]]))
            if low != high:
                group = {k: low if g == high else g for k, g in group.items()}
    assert {fp: ours.get(fp, fp) for fp in signed} == group


def test_keep_one(make_docs, prose):
    docs = [(1, prose(1)), (2, prose(1)), (3, prose(3)), (3, prose(3)), (None, prose(1)), (None, "z"), (5, None), (6, "")]
    table = make_docs(*docs)
    kept = simhash.keep_one(table)
    assert kept.columns == table.columns
    assert sorted((row.doc_id for row in kept.collect()), key=repr) == [1, 3, 5, None, None]


def test_rows_that_share_an_id_but_not_their_text(make_docs, prose):
    docs = [(8, prose(1)), (8, prose(2)), (9, prose(1)), (8, prose(1)), (10, prose(2)), (3, prose(4)), (3, prose(4) + " more"), (12, prose(5))]
    results = set()
    for parts in (1, 2, 3, 4):
        kept = simhash.keep_one(make_docs(*docs, parts=parts)).collect()
        results.add(tuple(sorted((row.doc_id, row.text) for row in kept)))
    assert len(results) == 1
    assert [row[0] for row in results.pop()] == [3, 8, 8, 12]


def test_components_of_a_chain_and_a_star(spark):
    chain = [(k, k + 1) for k in range(60)] + [(1000, k) for k in range(1001, 1200)] + [(5000, 5000), (None, 3), (7, 6)]
    made = components.connected(spark.createDataFrame(chain, "a long, b long").withColumn("c", F.lit(1)))
    got = {row.node: row.component for row in made.collect()}
    assert got == {**{k: 0 for k in range(61)}, **{k: 1000 for k in range(1000, 1200)}}
    assert components.connected(spark.createDataFrame([], "a long, b long")).count() == 0
