import hashlib
from collections import defaultdict

import numpy as np
import pytest

from postweave.llm import vector_codes as vc

EMBEDDINGS = "vec_id long, embedding array<float>, label int"


def brute(rows, entries=64, rounds=2):
    """{vec_id: (code, error, label_error)} and the codebooks' digest, in plain Python integers."""
    kept = [(i, [int(np.floor(256 * float(np.float32(x)))) for x in v], label) for i, v, label in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    size = -(-max(len(v) for _, v, _ in kept) // 16) * 16
    width = size // 16
    kept = [(i, v + [0] * (size - len(v)), label) for i, v, label in kept]
    cut = lambda v, p: v[p * width : (p + 1) * width]
    seeds = sorted(kept, key=lambda row: (row[0] is None, row[0] or 0))[:entries]
    books = [[cut(v, p) for _, v, _ in seeds] for p in range(16)]

    def nearest(v, p):
        return min((sum((a - b) ** 2 for a, b in zip(cut(v, p), entry)), e) for e, entry in enumerate(books[p]))

    for _ in range(rounds):
        held = defaultdict(list)
        for _, v, _ in kept:
            for p in range(16):
                held[p, nearest(v, p)[1]].append(cut(v, p))
        for (p, e), parts in held.items():
            books[p][e] = [sum(column) // len(parts) for column in zip(*parts)]
    made, by_label = {}, defaultdict(int)
    for i, v, label in kept:
        found = [nearest(v, p) for p in range(16)]
        made[i] = ("".join(f"{e:02x}" for _, e in found), sum(d for d, _ in found), label)
        by_label[label] += made[i][1]
    digest = hashlib.sha256(",".join(str(x) for book in books for entry in book for x in entry).encode()).hexdigest()
    return {i: (code, error, by_label[label]) for i, (code, error, label) in made.items()}, digest


def vectors(count, size=32, seed=0):
    draw = np.random.default_rng(seed)
    centres = draw.standard_normal((5, size))
    return [(int(k * 3 - 50), [float(x) for x in (centres[k % 5] + 0.3 * draw.standard_normal(size)).astype(np.float32)], int(k % 4)) for k in range(count)]


def check(spark, rows, parts=4, **options):
    table = spark.createDataFrame(rows, EMBEDDINGS).repartition(parts)
    made = vc.compress(table).collect()
    expected, digest = brute(rows, **options)
    assert {row.vec_id: (row.code, row.error, row.label_error) for row in made} == expected
    assert {row.codebooks_sha256 for row in made} == {digest}
    assert len(made) == len(expected)


def test_codes_against_brute_force(spark):
    check(spark, vectors(150))
    check(spark, vectors(90, 16, 3), parts=1)


def test_dropped_rows_ties_and_few_vectors(spark):
    rows = vectors(20) + [(900, None, 1), (901, [float("nan")] + [0.0] * 31, 1), (902, [float("inf")] * 32, None), (903, [None] + [1.0] * 31, 2)]
    rows += [(910 + k, [0.5, -0.001] * 16, None) for k in range(6)] + [(920, [0.0] * 32, 7), (None, [1.0] * 32, 7)]
    check(spark, rows)


def test_other_sizes_count_as_padded(spark):
    check(spark, vectors(70, 20) + [(1000, [], 1), (1001, [1.5], 1), (1002, [0.25] * 33, None)])


def test_large_components_are_bounded(spark):
    table = spark.createDataFrame([(1, [1e30] * 16, 1), (2, [-3e38] * 16, 1)], EMBEDDINGS)
    assert {row.error for row in vc.compress(table).collect()} == {0}


def test_repeated_ids_are_coded_each(spark, crowded):
    rows = vectors(80)
    twice = rows + [rows[3]] + [(rows[4][0], rows[5][1], 9)]
    made = vc.compress(crowded(spark.createDataFrame(twice, EMBEDDINGS))).collect()
    assert len(made) == 82 and len([r for r in made if r.vec_id == rows[4][0]]) == 2
    assert len({tuple(r) for r in made if r.vec_id == rows[3][0]}) == 1


def test_only_parts_that_change_their_entry_are_dealt_again(spark, monkeypatch):
    dealt = []
    real = vc._dealt
    monkeypatch.setattr(vc, "_dealt", lambda members: (dealt.append(members.count()), real(members))[1])
    rows = vectors(400)
    codes = vc.fit_codes(spark.createDataFrame(rows, EMBEDDINGS), rounds=3, salt_rows=50)
    assert dealt[0] == 400 * 16 and dealt[1:] == list(codes.migrated)
    assert 0 < codes.migrated[1] < codes.migrated[0] < 400 * 16 / 2
    expected, digest = brute(rows, rounds=3)
    assert codes.sha256 == digest
    assert sum(row.error for row in codes.rows.collect()) == sum(error for _, error, _ in expected.values())


def test_seldom_labels_are_joined_by_shuffle(spark, monkeypatch):
    monkeypatch.setattr(vc, "HOT_SHARE", 3)
    rows = [(i, v, None if i % 3 else i % 5) for i, v, _ in vectors(70)]
    check(spark, rows)


def test_empty_table(spark):
    table = spark.createDataFrame([(1, None, 1)], EMBEDDINGS)
    assert vc.compress(table).count() == 0 and vc.compress(table.filter("false")).columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    with pytest.raises(ValueError):
        vc.fit_codes(table, entries=257)
