import numpy as np
import pyarrow as pa
import pytest

from postweave.llm import lm_scoring as lm


@pytest.fixture(scope="module")
def fitted(make_docs, prose):
    words = prose(5, 12)
    docs = [(k, " ".join(words.split()[(k * j) % 12] for j in range(40))) for k in range(1, 30)]
    odd = [(40, None), (41, ""), (42, " \n"), (43, "word"), (44, "Word"), (45, words * 3000), (46, words), (46, words), (None, words)]
    table = make_docs(*docs, *odd)
    return docs + odd, table, lm.fit(table, 2)


def test_scores_equal_the_definition(fitted, crowded):
    docs, table, (words, weights) = fitted
    rows = {row.doc_id: row for row in lm.score(crowded(table), words, weights).collect()}
    single = {name: value.astype(np.float32) for name, value in weights.items()}
    for doc_id, text in docs[:5] + docs[29:34]:
        ids = np.concatenate([ids for *_, ids, _ in lm.token_ids(pa.array([(text or "").encode()], pa.binary()))] or [np.zeros(0, int)])
        total = 0.0
        for k, token in enumerate(ids):
            seen = [words.classes[ids[k + p]] if 0 <= k + p < len(ids) else lm.CLASSES for p in lm.PLACES]
            hidden = np.tanh(sum(single["inner"][place][c] for place, c in enumerate(seen)) + single["inner_bias"])
            logits = hidden @ single["outer"] + single["outer_bias"]
            total += logits[words.classes[token]] - np.log(np.exp(logits).sum()) + words.within[token]
        assert rows[doc_id].n_tokens == len(ids)
        assert rows[doc_id].log_likelihood == pytest.approx(total, rel=1e-4, abs=1e-4)
        assert (rows[doc_id].mean_log_likelihood is None) == (len(ids) == 0)
    assert rows[43].log_likelihood == rows[44].log_likelihood and rows[45].n_tokens > 30_000


def test_batches_do_not_change_scores(spark, fitted):
    docs, table, (words, weights) = fitted
    made = set()
    for parts, rows in ((1, 3), (2, 10_000), (7, 1)):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)
        scored = lm.score(table.repartition(parts), words, weights).collect()
        made.add(tuple(sorted(map(tuple, scored), key=repr)))
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(made) == 1


def test_probabilities_sum_to_one(fitted):
    _, _, (words, weights) = fitted
    logs, _ = lm.log_probabilities(weights, np.array([[1], [2], [lm.CLASSES], [0]]))
    whole = np.exp(logs[0][words.classes] + words.within)
    assert whole.sum() == pytest.approx(1, abs=1e-3)


def test_counts_are_of_all_documents(fitted):
    docs, table, _ = fitted
    assert sum(row.n for row in lm.count_tokens(table).collect()) == sum(len((text or "").split()) for _, text in docs)


def test_training_helps(fitted):
    docs, table, (words, weights) = fitted
    start = lm.start_weights(words.shares)
    texts = pa.array([(text or "").encode() for _, text in docs], pa.binary())
    before, after = (lm.text_scores(texts, words, w)[1].sum() for w in (start, weights))
    assert after > before


def test_the_slope_is_the_derivative():
    draw = np.random.default_rng(0)
    shares = np.full(lm.CLASSES, 1 / lm.CLASSES)
    seen, classes = draw.integers(0, lm.CLASSES + 1, (4, 50)), draw.integers(0, lm.CLASSES, 50)

    def loss(weights):
        return -lm.log_probabilities(weights, seen)[0][np.arange(50), classes].mean()

    trainer = lm.Trainer(lm.start_weights(shares))
    start = {name: value.astype(np.float64) for name, value in trainer.weights.items()}
    trainer.learn(seen, classes)
    for name in start:
        place = np.unravel_index(np.abs(trainer.moments[name][0]).argmax(), start[name].shape)
        moved = {key: value.copy() for key, value in start.items()}
        moved[name][place] += 1e-4
        slope = (loss(moved) - loss(start)) / 1e-4
        assert trainer.moments[name][0][place] / 0.1 == pytest.approx(slope, rel=2e-2)


def test_empty_table(make_docs):
    assert lm.pseudo_likelihood(make_docs((1, "x")).filter("false"), 1).count() == 0
