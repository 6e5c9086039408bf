import random

import numpy as np
import pyarrow as pa
import pytest

from postweave.llm import quality


@pytest.fixture(scope="module")
def table(make_docs, spark, prose):
    draw = random.Random(9)
    rows = []
    for k in range(240):
        text = prose(k, draw.randint(20, 120))
        rows.append((k, text if k % 3 else "".join(draw.choice("#$%&*|") for _ in range(len(text)))))
    labels = spark.createDataFrame([(k, int(k % 3 > 0), 0) for k in range(240)], "doc_id long, quality int, toxic int")
    return make_docs(*rows), labels


def test_the_identity_equals_all_pairs():
    texts = pa.array([b"one two two three", b"", None, b"x y", b"#### ####"], pa.binary())
    given = next(quality.inputs(texts, pa.array([17, 0, None, 3, 9], pa.int64())))
    draw = np.random.default_rng(1)
    machine = quality.Machine(
        0.3,
        draw.standard_normal(quality.WORD_INPUTS).astype(np.float32),
        draw.standard_normal((quality.WORD_INPUTS, quality.FACTORS)).astype(np.float32),
        draw.standard_normal(quality.STATISTICS).astype(np.float32),
        draw.standard_normal((quality.STATISTICS, quality.FACTORS)).astype(np.float32),
        given.dense.mean(axis=0),
        np.ones(quality.STATISTICS),
    )
    scores = machine.score(given)
    dense = machine.standard(given.dense)
    for row in range(5):
        own = given.row == row
        values = np.concatenate((given.value[own], dense[row]))
        weights = np.concatenate((machine.weights[given.word[own]], machine.dense_weights))
        vectors = np.concatenate((machine.vectors[given.word[own]], machine.dense_vectors))
        total = machine.bias + weights @ values
        for i in range(len(values)):
            for j in range(i):
                total += vectors[i] @ vectors[j] * values[i] * values[j]
        assert scores[row] == pytest.approx(1 / (1 + np.exp(-np.clip(total, -30, 30))), abs=1e-3)


def test_held_out_accuracy(table):
    docs, labels = table
    rows = {row.doc_id: row for row in quality.assess(docs, labels).collect()}
    truth = {row.doc_id: row.quality for row in labels.collect()}
    import zlib

    assert all(row.held_out == (zlib.crc32(str(k).encode()) % 3 == 1) for k, row in rows.items())
    held = [k for k, row in rows.items() if row.held_out]
    assert len(held) > 50 and sum(rows[k].predicted == truth[k] for k in held) / len(held) > 0.95
    assert all(row.predicted == int(row.score >= 0.5) and 0 <= row.score <= 1 for row in rows.values())


def test_labels_of_held_out_rows_change_nothing(table, spark):
    docs, labels = table
    other = labels.selectExpr("doc_id", "if(crc32(cast(doc_id as string)) % 3 = 1, 1 - quality, quality) as quality")
    one = {row.doc_id: row.score for row in quality.assess(docs, labels).collect()}
    two = {row.doc_id: row.score for row in quality.assess(docs, other).collect()}
    assert one == two


def test_odd_rows(table, make_docs, crowded, spark, prose):
    _, labels = table
    odd = [(300, None), (301, ""), (302, " \n\t"), (303, prose(1, 30_000)), (304, "x"), (304, "x"), (None, "word")]
    docs = crowded(table[0].unionByName(make_docs(*odd)))
    rows = [row for row in quality.assess(docs, labels).collect() if row.doc_id is None or row.doc_id >= 300]
    assert len(rows) == 7 and all(0 <= row.score <= 1 for row in rows)
    assert len({row.score for row in rows if row.doc_id in (300, 301)}) <= 2
    one_kind = spark.createDataFrame([(1, 1, 0), (None, 0, 0), (2, None, 0)], "doc_id long, quality int, toxic int")
    assert {row.score for row in quality.assess(make_docs(*odd), one_kind).collect()} == {0.5}
    assert quality.assess(docs.filter("false"), labels).count() == 0
    kept = quality.keep_good(docs, labels)
    assert kept.columns == docs.columns
    assert quality.assess(docs, labels.filter("false")).filter("score <> 0.5").count() == 0
