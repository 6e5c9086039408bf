import numpy as np
import pyarrow as pa
import pytest

from postweave.llm import lm_scoring as lm
from postweave.llm.lm_tokens import Table, Tokens, mean_rows

PAIRS = 1500


def text_of(pairs, ends):
    return " ".join(f"a{k} b{end}" for k, end in zip(pairs, ends))


@pytest.fixture(scope="module")
def fitted(make_docs):
    # every a is followed by a b of its own; all words are equally frequent
    draw = np.random.default_rng(5)
    lines = np.concatenate([draw.permutation(PAIRS) for _ in range(40)]).reshape(-1, 50)
    docs = [(k, text_of(line, line)) for k, line in enumerate(lines)]
    table = make_docs(*docs)
    return docs, lines, table, lm.fit_tokens(table, 3)


def scores(texts, model):
    words, weights, tokens = model
    return lm.text_scores(pa.array([text.encode() for text in texts], pa.binary()), words, weights, Tokens(*tokens, lm.PLACES))[1]


def ids_of(text):
    return np.concatenate([ids for *_, ids, _ in lm.token_ids(pa.array([text.encode()], pa.binary()))])


def test_words_of_one_class_and_count_are_told_apart(fitted, make_docs):
    docs, lines, _, model = fitted
    counts = np.bincount(np.concatenate([ids_of(text) for _, text in docs]), minlength=lm.TOKENS)
    ends = np.concatenate([ids_of(f"b{k}") for k in range(PAIRS)])
    groups = {}
    for k in np.flatnonzero(counts[ends] == 40):
        groups.setdefault(model[0].classes[ends[k]], []).append(k)
    other = np.arange(PAIRS)
    for some in groups.values():
        other[some] = np.roll(some, 1)
    assert (other != np.arange(PAIRS)).mean() > 0.9
    # each word is replaced by one of its class and count: classes alone, and shares of them, are as they were
    told = scores([text for _, text in docs[:300]], model)
    swapped = scores([text_of(line, other[line]) for line in lines[:300]], model)
    assert (told > swapped).mean() > 0.99
    plain = lm.text_scores(pa.array([t.encode() for _, t in docs[:300]], pa.binary()), *model[:2])[1]
    assert told.sum() > plain.sum()


def test_the_query_scores_by_tokens(fitted, make_docs):
    docs, lines, _, _ = fitted
    odd = [(-1, text_of(lines[0], np.roll(lines[0], 1))), (-2, docs[0][1].upper()), (-3, None), (-4, ""), (-5, "once")]
    made = {row.doc_id: row for row in lm.pseudo_likelihood(make_docs(*docs, *odd), 3).collect()}
    assert made[0].log_likelihood > made[-1].log_likelihood
    assert made[0].log_likelihood == made[-2].log_likelihood
    assert [(made[k].n_tokens, made[k].log_likelihood, made[k].mean_log_likelihood) for k in (-3, -4)] == [(0, 0.0, None)] * 2
    assert made[-5].n_tokens == 1 and made[-5].log_likelihood < 0


def test_scores_equal_the_definition(fitted):
    docs, _, _, model = fitted
    words, weights, (tree, near, cuts) = model
    signs = Tokens(tree, near, cuts, lm.PLACES).signs
    for text in (docs[0][1], "a1", "unheard of a2 b2", f"b7 {docs[1][1]} a3"):
        ids, total = ids_of(text), 0.0
        for k, token in enumerate(ids):
            hidden = weights["inner_bias"].copy()
            for place, offset in enumerate(lm.PLACES):
                if 0 <= k + offset < len(ids):
                    beside = ids[k + offset]
                    hidden += weights["inner"][place][words.classes[beside]]
                    if tree.places[beside] < tree.known:
                        hidden += signs[place] * near[tree.places[beside]]
                else:
                    hidden += weights["inner"][place][lm.CLASSES]
            hidden = np.tanh(hidden)
            logits = hidden @ weights["outer"] + weights["outer_bias"]
            total += logits[words.classes[token]] - np.log(np.exp(logits).sum())
            cut = tree.roots[words.classes[token]]
            while cut:
                after = 1 / (1 + np.exp(-(hidden[: lm.CUT_UNITS] @ cuts[cut].astype(float) + tree.odds[cut])))
                late = tree.places[token] >= cut
                total += np.log(after if late else 1 - after)
                cut = (tree.upper if late else tree.lower)[cut]
            if tree.places[token] >= tree.known:
                total -= np.log(tree.rest[words.classes[token]])
        assert scores([text], model)[0] == pytest.approx(total, rel=1e-4)


def test_all_ids_come_to_one_and_start_with_their_share(fitted):
    words, weights, (tree, near, cuts) = fitted[3]
    every, hidden = np.arange(lm.TOKENS), np.tile(np.tanh(np.random.default_rng(1).standard_normal(lm.HIDDEN)).astype(np.float32), (lm.TOKENS, 1))
    classes = words.classes.astype(np.int64)
    held = Tokens(tree, near, cuts, lm.PLACES).within(hidden, classes, tree.places[every])
    met = np.bincount(classes, minlength=lm.CLASSES) > 0
    assert np.bincount(classes, np.exp(held), lm.CLASSES)[met] == pytest.approx(1, abs=1e-3)
    start = Tokens(tree, near * 0, cuts * 0, lm.PLACES).within(hidden, classes, tree.places[every])
    assert start == pytest.approx(words.within, abs=1e-3)


def test_batches_do_not_change_scores(spark, fitted):
    docs, _, table, model = fitted
    some, made = table.filter("doc_id < 40"), set()
    for parts, rows in ((1, 3), (2, 10_000), (7, 1)):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)
        made.add(tuple(sorted(map(tuple, lm.score(some.repartition(parts), *model).collect()))))
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(made) == 1


def test_the_slope_of_cuts_is_the_derivative(fitted):
    words, _, (tree, near, cuts) = fitted[3]
    draw = np.random.default_rng(2)
    places = draw.integers(0, tree.known, 40).astype(np.int32)
    by_place = np.argsort(tree.places)
    classes, hidden = words.classes[by_place[places]].astype(np.int64), draw.uniform(-1, 1, (40, lm.HIDDEN))
    slope = Tokens(tree, near, cuts, lm.PLACES).learn_cuts(hidden.astype(np.float32), classes, places)
    for unit in range(lm.HIDDEN):
        moved = [Tokens(tree, near, cuts, lm.PLACES).within(hidden + step * (np.arange(lm.HIDDEN) == unit), classes, places) for step in (1e-4, -1e-4)]
        assert slope[:, unit] == pytest.approx((moved[1] - moved[0]) / 2e-4, rel=1e-2, abs=2e-2)


def test_rows_learn_the_sum_of_their_slopes():
    table = Table(np.zeros((5, 2)), 1.0)
    rows, slopes = np.array([0, 0, 2, 3, 4, 4]), np.arange(12, dtype=np.float32).reshape(6, 2)
    starts = np.array([0, 2, 3, 4])
    table.learn(rows[starts], table.values.take(rows[starts], axis=0), starts, slopes)
    wanted = np.zeros((5, 2))
    for row, times in ((0, 2), (2, 1), (3, 1)):
        wanted[row] = -slopes[rows == row].sum(axis=0) / np.sqrt(1 + times / 8)
    assert table.values == pytest.approx(wanted) and table.visits.tolist() == [2, 0, 1, 1, 0]


def test_means_are_weighted_by_visits():
    parts = [
        (np.array(rows, np.uint16).tobytes(), np.array(visits, np.int32).tobytes(), np.array(values, np.float16).tobytes())
        for rows, visits, values in (([1, 7], [3, 1], [[1, 2], [5, 6]]), ([7], [3], [[1, 2]]))
    ]
    rows, values = mean_rows(parts, 2)
    assert np.frombuffer(rows, np.uint16).tolist() == [1, 7]
    assert np.frombuffer(values, np.float16).tolist() == [1, 2, 2, 3]


def test_many_words_have_vectors_of_their_own(make_docs):
    table = make_docs(*[(k, " ".join(f"w{k}x{j}" for j in range(1000))) for k in range(80)])
    words, weights, (tree, near, cuts) = lm.fit_tokens(table, 1)
    assert tree.known > 70_000
    assert (np.abs(near[: tree.known].astype(float)).sum(axis=1) > 0).mean() > 0.99
    assert (np.abs(cuts[1 : tree.known].astype(float)).sum(axis=1) > 0).mean() > 0.95
