import numpy as np
import pytest

from postweave.llm import embedding_dedup
from postweave.llm.embedding_dedup import calibrated, near_duplicates

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, cosine=0.93):
    made = []
    usable = {}
    for vec_id, vector, label in rows:
        fine = vec_id is not None and label is not None and vector is not None and all(x is not None and np.isfinite(x) for x in vector)
        if fine and any(vector):
            usable[vec_id, label, tuple(np.float32(vector))] = np.float64(np.float32(vector))
    keys = list(usable)
    links = {key: set() for key in keys}
    for i, a in enumerate(keys):
        for b in keys[:i]:
            x, y = usable[a], usable[b]
            if a[1] == b[1] and len(x) == len(y) and x @ y / np.sqrt((x @ x) * (y @ y)) >= cosine:
                links[a].add(b)
                links[b].add(a)
    component = {}
    for key in sorted(keys, key=lambda k: k[0]):
        front = [key]
        while front:
            one = front.pop()
            if one not in component:
                component[one] = component.get(key, key[0])
                front += links[one]
    for vec_id, vector, label in rows:
        key = (vec_id, label, tuple(np.float32(vector))) if vector is not None and None not in vector else None
        n, name = (len(links[key]), component[key]) if key in links else (0, vec_id)
        made.append((vec_id, n, name, None if vec_id is None else vec_id == name))
    return sorted(made, key=repr)


def groups(seed, count, size=24):
    draw = np.random.default_rng(seed)
    rows = []
    for k in range(count):
        centre = draw.standard_normal(size)
        for _ in range(draw.integers(1, 6)):
            rows.append((centre + draw.standard_normal(size) * draw.choice([0.05, 0.2, 0.3]), int(k % 3)))
    return [(i, [float(x) for x in np.float32(vector)], label) for i, (vector, label) in enumerate(rows)]


def test_equals_brute_force(spark, crowded):
    rows = groups(1, 120)
    rows += [(5000 + k, rows[3][1], rows[3][2]) for k in range(40)] + [(6000, rows[3][1], 2), (6001, rows[3][1], None)]
    near = np.array(rows[3][1])
    rows += [(7000 + k, [float(x) for x in near + 0.001 * k], rows[3][2]) for k in range(60)]
    rows += [(8000, None, 1), (8001, [0.0] * 24, 1), (8002, [float("nan")] * 24, 1), (8003, [1.0, None], 1), (8004, [float("inf")] * 24, 1), (8005, [], 1)]
    rows += [(8006, [1.0, 2.0], 1), (8007, [2.0, 4.0], 1), (None, rows[3][1], rows[3][2]), (3, rows[3][1], rows[3][2]), (8008, [1e30] * 24, 0), (8009, [1e-30] * 24, 0)]
    made = near_duplicates(crowded(spark.createDataFrame(rows, SCHEMA)).repartition(4)).collect()
    assert sorted(map(tuple, made), key=repr) == brute(rows)


def test_small_blocks_and_signs(spark, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "LIST_ROWS", 8)
    monkeypatch.setattr(embedding_dedup, "BLOCK", 4)
    calibrated.cache_clear()
    try:
        rows = groups(2, 150)
        expected, made = brute(rows), sorted(map(tuple, near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()), key=repr)
        links = sum(row[1] for row in expected)
        assert links > 200 and sum(row[1] for row in made) >= 0.99 * links
        assert all(ours[1] <= theirs[1] for ours, theirs in zip(made, expected))
    finally:
        calibrated.cache_clear()


@pytest.mark.parametrize("rows", [1, 128, 5000, 10**6, 10**9])
def test_calibration(rows):
    bits, tables = calibrated(rows, 0.93)
    hit = (1 - np.arccos(0.93) / np.pi) ** bits * 0.9
    assert 1 - (1 - hit) ** tables - tables * hit * (1 - hit) ** (tables - 1) >= 0.998
    assert tables < 400


def test_empty_table(spark):
    assert near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0
