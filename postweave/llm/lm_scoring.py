"""Document scores by masked pseudo-likelihood.

A token is a lower-cased word, hashed into ``TOKENS`` ids. A network sees the two tokens on either side of a place, not
the one in it, and gives every id a probability there: first that of one of ``CLASSES`` classes of ids of like frequency, then
that of the id within its class, by cuts of the class (``lm_tokens``). Each id has a vector of its own as input, beside one of its
class, and each cut one as output; all ids together come to one. A document's score is the sum of the log-probabilities of all
its tokens.

Counts are taken over all documents. The network is trained on every place of every document, in rounds: each task
starts from the same weights, goes through its documents, and the weights of all tasks are averaged in a shuffle: dense ones
weighted by tokens, an id's or a cut's vectors by how often a task met them. What reaches the driver, and every task, is a
number and two vectors for each id that occurs, of which there are at most ``TOKENS``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postweave.llm.lm_tokens import BLOCK, Tokens, Tree, mean_rows, tree
from postweave.llm.words import groups, lower_ascii, word_hashes, word_spans

TOKENS = 1 << 20
CLASSES = 64
HIDDEN = 16
PLACES = (-2, -1, 1, 2)
ROUNDS = 1
BATCH = 2048
RUN = 4 * BATCH
PART = 1024
CUT_UNITS = 8
TOKEN_RATE = 0.1
_BASE = 0x9E3779B97F4A7C15
_SHAPES = {"inner": (len(PLACES), CLASSES + 1, HIDDEN), "inner_bias": (HIDDEN,), "outer": (HIDDEN, CLASSES), "outer_bias": (CLASSES,)}


@dataclass
class Vocabulary:
    """``classes``: the class of each id; ``within``: the log of its share of the class; ``shares``: of each class."""

    classes: np.ndarray
    within: np.ndarray
    shares: np.ndarray


def token_ids(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, ids, document) of binary ``texts`` in groups; whole texts, ``document`` from 0 in the group."""
    for first, end, data, offsets in groups(texts):
        low = lower_ascii(data)
        starts, ends, doc = word_spans(low, offsets)
        yield first, end, (word_hashes(low, starts, ends, _BASE) & np.uint64(TOKENS - 1)).astype(np.int64), doc


def count_tokens(docs: DataFrame) -> DataFrame:
    """(id, n) over all documents; every task adds up its own first."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(TOKENS, dtype=np.int64)
        for batch in batches:
            for _, _, ids, _ in token_ids(batch.column(0)):
                np.add.at(total, ids, 1)
        met = np.flatnonzero(total)
        for at in range(0, len(met), 50_000):
            part = met[at : at + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(total[part], pa.int64())], ["id", "n"])

    own = docs.select(F.col("text").cast("binary").alias("text")).mapInArrow(counted, "id int, n long")
    return own.groupBy("id").agg(F.sum("n").alias("n"))


def by_count(counts: np.ndarray) -> np.ndarray:
    """All ids, those of the highest counts first."""
    return np.lexsort((np.arange(TOKENS), -counts))


def vocabulary(counts: np.ndarray) -> Vocabulary:
    """Classes cut at equal sums of the square roots of counts: the frequent ids have classes nearly to themselves."""
    order = by_count(counts)
    mass = np.cumsum(np.sqrt(counts[order] + 1e-6))
    classes = np.empty(TOKENS, dtype=np.int64)
    classes[order] = np.minimum((mass - mass[0]) / mass[-1] * CLASSES, CLASSES - 1).astype(np.int64)
    smoothed = counts + 0.5
    totals = np.bincount(classes, smoothed, CLASSES)
    totals[totals == 0] = 0.5
    within = np.log(smoothed / totals[classes])
    return Vocabulary(classes.astype(np.uint8), within.astype(np.float32), totals / totals.sum())


def start_weights(shares: np.ndarray, seed: int = 11) -> dict[str, np.ndarray]:
    draw = np.random.default_rng(seed)
    return {
        "inner": draw.standard_normal(_SHAPES["inner"]) * 0.3,
        "inner_bias": np.zeros(HIDDEN),
        "outer": draw.standard_normal(_SHAPES["outer"]) * 0.1,
        "outer_bias": np.log(shares),
    }


def windows(classes: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """The classes around each token, one row per place of ``PLACES``; ``CLASSES`` stands for beyond the document."""
    total = len(classes)
    seen = np.full((len(PLACES), total), CLASSES, dtype=np.int64)
    for row, place in zip(seen, PLACES):
        low, high = max(0, -place), total - max(0, place)
        if low < high:
            near = slice(low + place, high + place)
            np.copyto(row[low:high], classes[near], where=doc[near] == doc[low:high])
    return seen


def class_logits(
    weights: dict[str, np.ndarray], seen: np.ndarray, added: np.ndarray | None = None, exact: bool = False
) -> tuple[np.ndarray, np.ndarray]:
    """(logit of each class, 0 at most, hidden layer) for each column of ``seen``; ``added`` is what tokens add to that layer.

    A matrix product may add up a row by where it lies in its block. If ``exact``, both its sides are rounded to steps whose
    products add up without rounding in double precision: then a row's result does not depend on that.
    """
    hidden = weights["inner"][0].take(seen[0], axis=0) + weights["inner_bias"]
    for place in range(1, len(PLACES)):
        hidden += weights["inner"][place].take(seen[place], axis=0)
    if added is not None:
        hidden += added
    np.tanh(hidden, out=hidden)
    if exact:
        outer = weights["outer"].astype(np.float64)
        step = 2.0 ** (np.ceil(np.log2(np.abs(outer).sum(axis=0).max() + 1e-9)) - 26)
        units = hidden.astype(np.float64)
        units *= 2.0**26
        np.rint(units, out=units)
        # the steps are powers of two, so that it does not matter where they come in
        logits = (units @ (np.rint(outer / step) * (step * 2.0**-26))).astype(hidden.dtype)
    else:
        logits = hidden @ weights["outer"]
    logits += weights["outer_bias"]
    # numpy tells where a row's maximum lies in a third of the time of the maximum itself
    logits -= np.take_along_axis(logits, logits.argmax(axis=1)[:, None], axis=1)
    return logits, hidden


def log_probabilities(
    weights: dict[str, np.ndarray], seen: np.ndarray, added: np.ndarray | None = None, exact: bool = False
) -> tuple[np.ndarray, np.ndarray]:
    """(log-probability of each class, hidden layer) for each column of ``seen``, see ``class_logits``."""
    logits, hidden = class_logits(weights, seen, added, exact)
    logits -= np.log(np.exp(logits).sum(axis=1, keepdims=True))
    return logits, hidden


def class_scores(
    weights: dict[str, np.ndarray], seen: np.ndarray, classes: np.ndarray, added: np.ndarray | None = None
) -> tuple[np.ndarray, np.ndarray]:
    """(log-probability of the one of ``classes``, hidden layer) for each column of ``seen``.

    As ``exact`` ``log_probabilities`` gives them, in parts whose logits of all classes stay in a processor's cache.
    """
    total = seen.shape[1]
    logs, hidden = np.empty(total, dtype=np.float32), np.empty((total, HIDDEN), dtype=np.float32)
    for at in range(0, total, PART):
        part = slice(at, min(at + PART, total))
        logits, hidden[part] = class_logits(weights, seen[:, part], None if added is None else added[part], exact=True)
        own = logits[np.arange(len(logits)), classes[part]]
        np.exp(logits, out=logits)
        logs[part] = own - np.log(logits.sum(axis=1))
    return logs, hidden


class Trainer:
    """Adam on the negative log-probability of the class in the middle, with ``tokens`` on that of the token itself."""

    def __init__(self, weights: dict[str, np.ndarray], rate: float = 0.01, tokens: Tokens | None = None):
        self.known = tokens
        self.weights = {name: value.astype(np.float32) for name, value in weights.items()}
        self.moments = {name: (np.zeros_like(value), np.zeros_like(value)) for name, value in self.weights.items()}
        self.rate, self.steps, self.tokens = rate, 0, 0

    def learn(self, seen: np.ndarray, classes: np.ndarray, places: np.ndarray | None = None, rows: np.ndarray | None = None) -> None:
        """A step on some places; with tokens, on a run of them, ``rows`` being ``around`` it."""
        known, held = self.known, seen != CLASSES
        off, hidden = class_logits(self.weights, seen, known and known.added(rows, held))
        total = len(classes)
        np.exp(off, out=off)
        off /= off.sum(axis=1, keepdims=True)
        off[np.arange(total), classes] -= 1
        back = off @ self.weights["outer"].T
        if known:
            back += known.learn_cuts(hidden, classes, places)
        back *= 1 - hidden**2
        if known:
            known.learn_near(rows, held, back)
        off /= total
        back /= total
        inner = np.zeros(_SHAPES["inner"], dtype=np.float32)
        for place in range(len(PLACES)):
            order = np.argsort(seen[place].astype(np.uint8), kind="stable")
            keys = seen[place][order]
            starts = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
            inner[place][keys[starts]] = np.add.reduceat(back.take(order, axis=0), starts, axis=0)
        self.steps += 1
        self.tokens += total
        slopes = {"inner": inner, "inner_bias": back.sum(axis=0), "outer": hidden.T @ off, "outer_bias": off.sum(axis=0)}
        for name, slope in slopes.items():
            m, v = self.moments[name]
            m *= 0.9
            m += 0.1 * slope
            v *= 0.999
            v += 0.001 * slope**2
            self.weights[name] -= self.rate * (m / (1 - 0.9**self.steps)) / (np.sqrt(v / (1 - 0.999**self.steps)) + 1e-8)


def _flat(weights: dict[str, np.ndarray]) -> np.ndarray:
    return np.concatenate([weights[name].ravel().astype(np.float64) for name in _SHAPES])


def _shaped(flat: np.ndarray) -> dict[str, np.ndarray]:
    made, at = {}, 0
    for name, shape in _SHAPES.items():
        size = int(np.prod(shape))
        made[name] = flat[at : at + size].reshape(shape)
        at += size
    return made


def train(docs: DataFrame, words: Vocabulary, rounds: int = ROUNDS) -> dict[str, np.ndarray]:
    """The network's weights after ``rounds`` passes over all documents."""
    context = docs.sparkSession.sparkContext
    texts = docs.select(F.col("text").cast("binary").alias("text"))
    classes = context.broadcast(words.classes)
    weights = start_weights(words.shares)
    for turn in range(rounds):
        start = weights

        def learnt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            trainer = Trainer(start, 0.01 / (turn + 1))
            draw = np.random.default_rng(turn)
            for batch in batches:
                for _, _, ids, doc in token_ids(batch.column(0)):
                    own = classes.value[ids].astype(np.int64)
                    seen = windows(own, doc)
                    order = draw.permutation(len(own))
                    for at in range(0, len(order), BATCH):
                        some = order[at : at + BATCH]
                        trainer.learn(seen[:, some], own[some])
            if trainer.tokens:
                flat = _flat(trainer.weights)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.arange(len(flat)), pa.int32()), pa.array(flat * trainer.tokens), pa.array(np.full(len(flat), trainer.tokens))],
                    ["place", "sum", "tokens"],
                )

        parts = texts.mapInArrow(learnt, "place int, sum double, tokens long")
        means = parts.groupBy("place").agg((F.sum("sum") / F.sum("tokens")).alias("mean")).toArrow().sort_by("place")
        if means.num_rows:
            weights = _shaped(means.column("mean").to_numpy())
    return weights


NEAR, CUTS, DENSE = range(3)
_LEARNT = "kind int, block int, rows binary, visits binary, values binary"


def train_tokens(docs: DataFrame, words: Vocabulary, known: Tree, rounds: int = ROUNDS) -> tuple[dict[str, np.ndarray], np.ndarray, np.ndarray]:
    """The network's weights, the ids' vectors and those of cuts after ``rounds`` passes over all documents."""
    context = docs.sparkSession.sparkContext
    texts = docs.select(F.col("text").cast("binary").alias("text"))
    shared = context.broadcast((words.classes, known))
    weights = start_weights(words.shares)
    widths = {NEAR: HIDDEN, CUTS: CUT_UNITS}
    tables = [np.zeros((known.known + 2, widths[kind]), dtype=np.float16) for kind in (NEAR, CUTS)]
    for turn in range(rounds):
        start = context.broadcast((weights, tables if turn else None))

        def learnt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            classes, known = shared.value
            weights, tables = start.value
            near, cuts = tables or [np.zeros((known.known + 2, widths[kind]), dtype=np.float16) for kind in (NEAR, CUTS)]
            tokens = Tokens(known, near, cuts, PLACES, TOKEN_RATE / (turn + 1))
            trainer = Trainer(weights, 0.01 / (turn + 1), tokens)
            for batch in batches:
                for _, _, ids, doc in token_ids(batch.column(0)):
                    own, places = classes.take(ids).astype(np.int64), known.places.take(ids)
                    seen = windows(own, doc)
                    for at in range(0, len(own), RUN):
                        end = min(at + RUN, len(own))
                        trainer.learn(seen[:, at:end], own[at:end], places[at:end], tokens.around(places, at, end))
            if trainer.tokens:
                count = np.array([trainer.tokens], dtype=np.int64).tobytes()
                yield _binary([(DENSE, 0, b"", count, _flat(trainer.weights).tobytes())], _LEARNT)
                for kind, table in ((NEAR, tokens.near), (CUTS, tokens.cuts)):
                    some = []
                    for block in table.blocks():
                        some.append((kind, *block))
                        if len(some) == 100:
                            yield _binary(some, _LEARNT)
                            some = []
                    yield _binary(some, _LEARNT)

        parts = texts.mapInArrow(learnt, _LEARNT).groupBy("kind", "block")
        means = parts.applyInArrow(_mean, "kind int, block int, rows binary, values binary").toArrow()
        for kind, block, rows, values in zip(*(means.column(k).to_pylist() for k in range(4))):
            if kind == DENSE:
                weights = _shaped(np.frombuffer(values))
            else:
                tables[kind][block * BLOCK + np.frombuffer(rows, dtype=np.uint16).astype(np.int64)] = np.frombuffer(values, dtype=np.float16).reshape(-1, widths[kind])
        start.destroy()
    shared.destroy()
    return weights, *tables


def _binary(rows: list[tuple], schema: str) -> pa.RecordBatch:
    names = [part.split()[0] for part in schema.split(", ")]
    types = [pa.int32() if part.endswith(" int") else pa.binary() for part in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([row[k] for row in rows], kind) for k, kind in enumerate(types)], names)


def _mean(table: pa.Table) -> pa.Table:
    """The mean of all tasks' weights of one block, added up in the same order whatever the order they come in."""
    kind, block = table.column("kind")[0].as_py(), table.column("block")[0].as_py()
    parts = sorted(zip(*(table.column(name).to_pylist() for name in ("rows", "visits", "values"))))
    if kind == DENSE:
        counts = [int(np.frombuffer(visits, dtype=np.int64)[0]) for _, visits, _ in parts]
        rows, values = b"", (sum(np.frombuffer(part[2]) * n for part, n in zip(parts, counts)) / sum(counts)).tobytes()
    else:
        rows, values = mean_rows(parts, HIDDEN if kind == NEAR else CUT_UNITS)
    return pa.Table.from_batches([_binary([(kind, block, rows, values)], "kind int, block int, rows binary, values binary")])


def count_ids(docs: DataFrame) -> np.ndarray:
    table = count_tokens(docs).toArrow()
    counts = np.zeros(TOKENS)
    counts[table.column("id").to_numpy()] = table.column("n").to_numpy()
    return counts


def fit(docs: DataFrame, rounds: int = ROUNDS) -> tuple[Vocabulary, dict[str, np.ndarray]]:
    """The vocabulary of all documents and a network of classes alone, trained on all of them: ids have their share of a class."""
    words = vocabulary(count_ids(docs))
    return words, train(docs, words, rounds)


def fit_tokens(docs: DataFrame, rounds: int = ROUNDS) -> tuple[Vocabulary, dict[str, np.ndarray], tuple[Tree, np.ndarray, np.ndarray]]:
    """The vocabulary of all documents and the network, trained on all of them; the last is the tree, ids' and cuts' vectors."""
    counts = count_ids(docs)
    words = vocabulary(counts)
    known = tree(counts, by_count(counts), words.classes, CLASSES)
    weights, near, cuts = train_tokens(docs, words, known, rounds)
    return words, weights, (known, near, cuts)


def text_scores(
    texts: pa.Array, words: Vocabulary, weights: dict[str, np.ndarray], tokens: Tokens | None = None
) -> tuple[np.ndarray, np.ndarray]:
    """(number of tokens, sum of log-probabilities) of each of the binary ``texts``; without ``tokens``, by shares of classes."""
    numbers, sums = np.zeros(len(texts), dtype=np.int64), np.zeros(len(texts))
    single = {name: value.astype(np.float32) for name, value in weights.items()}
    for first, end, ids, doc in token_ids(texts):
        own = words.classes.take(ids).astype(np.int64)
        seen = windows(own, doc)
        places = tokens and tokens.tree.places.take(ids)
        logs = np.empty(len(own))
        for at in range(0, len(own), 2 * RUN):
            part = slice(at, min(at + 2 * RUN, len(own)))
            added = tokens and tokens.added(tokens.around(places, at, part.stop), seen[:, part] != CLASSES)
            logs[part], hidden = class_scores(single, seen[:, part], own[part], added)
            logs[part] += tokens.within(hidden, own[part], places[part]) if tokens else words.within[ids[part]]
        numbers[first:end] = np.bincount(doc, minlength=end - first)
        sums[first:end] = np.bincount(doc, logs, end - first)
    return numbers, sums


def score(
    docs: DataFrame, words: Vocabulary, weights: dict[str, np.ndarray], tokens: tuple[Tree, np.ndarray, np.ndarray] | None = None
) -> DataFrame:
    """One row per document: doc_id, n_tokens, log_likelihood, mean_log_likelihood (null without tokens).

    A place's log-probability does not depend on what else is in a batch, and sums are in double precision and in the order of
    the text: equal texts have equal scores however they are batched.
    """
    if tokens:
        words = Vocabulary(words.classes, words.within[:0], words.shares)
    sent = docs.sparkSession.sparkContext.broadcast((words, weights, tokens))

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, weights, tokens = sent.value
        known = tokens and Tokens(*tokens, PLACES)
        for batch in batches:
            numbers, sums = text_scores(batch.column(1), words, weights, known)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(numbers),
                    pa.array(sums),
                    pa.array(sums / np.maximum(numbers, 1), mask=numbers == 0),
                ],
                ["doc_id", "n_tokens", "log_likelihood", "mean_log_likelihood"],
            )

    own = docs.select("doc_id", F.col("text").cast("binary").alias("text"))
    return own.mapInArrow(made, "doc_id long, n_tokens long, log_likelihood double, mean_log_likelihood double")


def pseudo_likelihood(docs: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """Scores of ``docs`` by a network trained on them, see ``score``.

    A null or empty text has no tokens and log_likelihood 0. Rows with null or repeated ids are scored like any other;
    an empty table gives no rows; other columns are ignored.
    """
    words, weights, tokens = fit_tokens(docs, rounds)
    return score(docs, words, weights, tokens)
