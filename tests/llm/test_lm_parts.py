import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from postweave.llm import lm_scoring as lm
from postweave.llm.lm_tokens import Tokens, run_sums, tree
from postweave.llm.words import HASH_BYTES, lower_ascii, mix, word_hashes, word_spans


@pytest.fixture(scope="module")
def model():
    draw = np.random.default_rng(3)
    counts = np.zeros(lm.TOKENS, dtype=np.int64)
    counts[draw.choice(lm.TOKENS, 5000, replace=False)] = draw.zipf(1.3, 5000).clip(max=10**6)
    words = lm.vocabulary(counts)
    known = tree(counts, lm.by_count(counts), words.classes, lm.CLASSES)
    near, cuts = (draw.standard_normal((known.known + 2, width)).astype(np.float16) for width in (lm.HIDDEN, lm.CUT_UNITS))
    weights = {name: value.astype(np.float32) for name, value in lm.start_weights(words.shares).items()}
    return counts, words, known, near, cuts, weights


def path(known, word_class, place):
    cut = known.roots[word_class]
    while cut:
        yield cut, place >= cut
        cut = (known.upper if place >= cut else known.lower)[cut]


def test_scoring_holds_logits_in_parts(model):
    _, words, known, near, cuts, weights = model
    texts, tokens = pa.array([b" ".join(b"w%d" % (k % 700) for k in range(16_000))], pa.binary()), Tokens(known, near, cuts, lm.PLACES)
    lm.text_scores(texts, words, weights, tokens)
    tracemalloc.start()
    lm.text_scores(texts, words, weights, tokens)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 12e6  # the logits of all classes at all places, in double precision, are 8.2 MB for each step on them


def test_depths_are_the_lengths_of_paths(model):
    counts, words, known, *_ = model
    for token in [*np.flatnonzero(counts)[:300], 0, 1, lm.TOKENS - 1]:
        assert known.depths[known.places[token]] == len([*path(known, words.classes[token], known.places[token])])


def test_scores_within_a_class_equal_the_walk(model):
    counts, words, known, near, cuts, _ = model
    draw = np.random.default_rng(4)
    ids = np.concatenate((draw.choice(np.flatnonzero(counts), 400), draw.integers(0, lm.TOKENS, 20)))
    hidden, places, classes = draw.uniform(-1, 1, (420, lm.HIDDEN)).astype(np.float32), known.places[ids], words.classes[ids].astype(np.int64)
    found = Tokens(known, near, cuts, lm.PLACES).within(hidden, classes, places)
    for k in range(420):
        total = 0.0 if places[k] < known.known else -np.log(known.rest[classes[k]])
        for cut, after in path(known, classes[k], places[k]):
            odds = hidden[k, : lm.CUT_UNITS].astype(float) @ cuts[cut].astype(float) + known.odds[cut]
            total -= np.log1p(np.exp(-odds if after else odds))
        assert found[k] == pytest.approx(total, rel=1e-4, abs=1e-4)


def test_cuts_learn_from_their_own_tokens_alone(model):
    counts, words, known, near, cuts, _ = model
    draw = np.random.default_rng(6)
    ids = draw.choice(np.flatnonzero(counts), 3000, p=counts[counts > 0] / counts.sum())
    ids[:500] = draw.choice(np.flatnonzero(counts == counts[counts > 0].min()), 500)
    hidden, places, classes = draw.uniform(-1, 1, (3000, lm.HIDDEN)).astype(np.float32), known.places[ids], words.classes[ids].astype(np.int64)
    tokens = Tokens(known, near, cuts * np.float16(0.1) * (np.arange(len(cuts)) > 0)[:, None], lm.PLACES)
    start, back, sums = tokens.cuts.values.astype(float), np.zeros((3000, lm.HIDDEN)), {}
    for k in range(3000):
        for cut, after in path(known, classes[k], places[k]):
            off = 1 / (1 + np.exp(-(hidden[k, : lm.CUT_UNITS] @ start[cut] + known.odds[cut]))) - after
            back[k, : lm.CUT_UNITS] += off * start[cut]
            sums.setdefault(cut, []).append(off * hidden[k, : lm.CUT_UNITS])
    assert tokens.learn_cuts(hidden, classes, places) == pytest.approx(back, abs=1e-4)
    for cut, slopes in sums.items():
        start[cut] -= tokens.cuts.rate * np.sum(slopes, axis=0) / np.sqrt(1 + len(slopes) / 8)
    assert tokens.cuts.values == pytest.approx(start, abs=1e-3) and not tokens.cuts.values[0].any()
    assert {k: len(v) for k, v in sums.items()} == {k: tokens.cuts.visits[k] for k in np.flatnonzero(tokens.cuts.visits)}


@pytest.mark.parametrize("longest", (1, 2, 8, 9, 40))
def test_sums_of_runs(longest):
    draw = np.random.default_rng(longest)
    for count in (1, 2, 300):
        times = draw.integers(1, longest + 1, count)
        starts = np.cumsum(times) - times
        values = draw.standard_normal((times.sum(), 3)).astype(np.float32)
        assert run_sums(values, starts, times).tobytes() == np.add.reduceat(values, starts, axis=0).tobytes()


def test_class_scores_equal_the_whole_distribution(model):
    _, words, *_, weights = model
    draw = np.random.default_rng(7)
    total = 2 * lm.PART + 5
    seen, classes = draw.integers(0, lm.CLASSES + 1, (len(lm.PLACES), total)), draw.integers(0, lm.CLASSES, total)
    added = draw.standard_normal((total, lm.HIDDEN)).astype(np.float32)
    logs, hidden = lm.class_scores(weights, seen, classes, added)
    whole, same = lm.log_probabilities(weights, seen, added, exact=True)
    assert logs.tobytes() == whole[np.arange(total), classes].tobytes() and hidden.tobytes() == same.tobytes()


def test_windows_end_at_documents():
    doc = np.array([0, 0, 0, 2, 3, 3, 3, 3, 7])
    classes = np.arange(10, 19)
    for size in range(10):
        seen = lm.windows(classes[:size], doc[:size])
        for row, place in zip(seen, lm.PLACES):
            assert row.tolist() == [classes[k + place] if 0 <= k + place < size and doc[k + place] == doc[k] else lm.CLASSES for k in range(size)]


def test_words_and_hashes_do_not_depend_on_their_block():
    base, rows = 0x9E3779B97F4A7C15, ["", "One two", "\x08\t\n\x0b\x0c\r\x0e @AZ[`az{ Àé", " x ", "y" * (HASH_BYTES + 9), "", "a b " * HASH_BYTES, "q" * 5 + " " + "z" * (3 * HASH_BYTES)]
    bytes_ = [row.encode() for row in rows]
    data, offsets = np.frombuffer(b"".join(bytes_), np.uint8), np.cumsum([0, *map(len, bytes_)])
    low = lower_ascii(data)
    assert low.tobytes() == b"".join(row.lower() for row in bytes_)
    starts, ends, doc = word_spans(low, offsets)
    wanted = [(k, word) for k, row in enumerate(bytes_) for word in row.lower().split()]
    assert [(int(d), low[s:e].tobytes()) for d, s, e in zip(doc, starts, ends)] == wanted
    hashes = {}
    for (_, word), made in zip(wanted, word_hashes(low, starts, ends, base).tolist()):
        assert hashes.setdefault(word, made) == made
    for word in (b"one", b"a", b"q" * 5):
        plain = sum((byte + 1) * pow(base, k, 1 << 64) for k, byte in enumerate(word)) + len(word)
        assert hashes[word] == int(mix(np.array([plain % (1 << 64)], np.uint64))[0])
