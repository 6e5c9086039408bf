"""Quality scores by a factorisation machine.

Inputs of a score are hashed words with damped, normalised counts, structure statistics of the whole text and, as
metadata, the stored character count. Every input i has a weight and a vector of ``FACTORS`` numbers; pairs of inputs
interact by the product of their vectors. Over all pairs that is half the difference between the square of the sum and
the sum of squares, so a text is scored in time linear in its words.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postweave.llm.words import groups, lower_ascii, word_hashes, word_spans

WORD_INPUTS = 1 << 16
FACTORS = 8
TRAINING_ROWS = 20_000
BATCH_ROWS = 1024
_BASE = 0x9E3779B97F4A7C15
_KINDS = np.zeros(256, dtype=np.uint8)  # 1 letters and bytes beyond ASCII, 2 digits, 3 space, 4 line ends, 0 the rest
_KINDS[65:91] = _KINDS[97:123] = _KINDS[128:] = 1
_KINDS[48:58] = 2
_KINDS[[9, 11, 12, 13, 32]] = 3
_KINDS[10] = 4
STATISTICS = 16


@dataclass
class Inputs:
    """Sparse word inputs (``row``, ``word``, ``value``; rows in order) and dense statistics of some texts."""

    row: np.ndarray
    word: np.ndarray
    value: np.ndarray
    dense: np.ndarray


@dataclass
class Machine:
    bias: float
    weights: np.ndarray
    vectors: np.ndarray
    dense_weights: np.ndarray
    dense_vectors: np.ndarray
    shift: np.ndarray
    scale: np.ndarray

    def standard(self, dense: np.ndarray) -> np.ndarray:
        return np.clip((dense - self.shift) / self.scale, -4, 4).astype(np.float32)

    def sums(self, given: Inputs) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(linear part, sum of vectors, sum of squared vectors) of each row."""
        rows = len(given.dense)
        dense = self.standard(given.dense)
        linear = dense @ self.dense_weights
        total = dense @ self.dense_vectors
        squares = (dense**2) @ (self.dense_vectors**2)
        if len(given.row):
            starts = np.flatnonzero(np.concatenate(([True], given.row[1:] != given.row[:-1])))
            where = given.row[starts]
            scaled = self.vectors[given.word] * given.value[:, None]
            linear[where] += np.add.reduceat(self.weights[given.word] * given.value, starts)
            total[where] += np.add.reduceat(scaled, starts, axis=0)
            squares[where] += np.add.reduceat(scaled**2, starts, axis=0)
        assert len(linear) == rows
        return linear, total, squares

    def score(self, given: Inputs) -> np.ndarray:
        linear, total, squares = self.sums(given)
        return _sigmoid(self.bias + linear + 0.5 * (total**2 - squares).sum(axis=1))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x.astype(np.float64), -30, 30)))


def inputs(texts: pa.Array, chars: pa.Array) -> Iterator[Inputs]:
    """The inputs of binary ``texts`` in groups of rows, in order. ``chars`` is the stored character count, or null."""
    stored = chars.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.float64)
    for first, end, data, offsets in groups(texts):
        rows = end - first
        low = lower_ascii(data)
        starts, ends, doc = word_spans(low, offsets)
        ids = (word_hashes(low, starts, ends, _BASE) % np.uint64(WORD_INPUTS)).astype(np.int64)
        keys, counts = np.unique(doc * WORD_INPUTS + ids, return_counts=True)
        row, word = keys // WORD_INPUTS, keys % WORD_INPUTS
        value = np.log1p(counts)
        norms = np.sqrt(np.bincount(row, value**2, rows))
        value = (value / norms[row]).astype(np.float32) if len(row) else value.astype(np.float32)
        yield Inputs(row, word, value, _statistics(data, offsets, starts, ends, doc, ids, row, stored[first:end]))


def _statistics(data, offsets, starts, ends, doc, ids, distinct_row, chars) -> np.ndarray:
    rows = len(offsets) - 1
    size = np.diff(offsets).astype(np.float64)
    owner = np.repeat(np.arange(rows), np.diff(offsets))
    kinds = np.bincount(owner * 5 + _KINDS[data], minlength=rows * 5).reshape(rows, 5)
    words = np.bincount(doc, minlength=rows).astype(np.float64)
    lengths = (ends - starts).astype(np.float64)
    some, many = np.maximum(words, 1), np.maximum(size, 1)
    mean = np.bincount(doc, lengths, rows) / some
    spread = np.sqrt(np.maximum(np.bincount(doc, lengths**2, rows) / some - mean**2, 0))
    upper = np.bincount(owner, (data >= 65) & (data <= 90), rows)
    last = _KINDS[data[ends - 1]] if len(ends) else np.zeros(0, np.uint8)
    bare = np.bincount(doc, last == 0, rows) if len(doc) else np.zeros(rows)
    single = np.bincount(doc, lengths == 1, rows) if len(doc) else np.zeros(rows)
    again = [np.bincount(doc[gap:], (ids[gap:] == ids[:-gap]) & (doc[gap:] == doc[:-gap]), rows) for gap in (1, 2)]
    lines = kinds[:, 4] + 1
    return np.column_stack(
        [
            np.log1p(size),
            np.log1p(words),
            mean,
            spread,
            kinds[:, 0] / many,
            kinds[:, 2] / many,
            kinds[:, 3] / many,
            np.log(some / lines),
            upper / many,
            bare / some,
            single / some,
            again[0] / some,
            again[1] / some,
            np.bincount(distinct_row, minlength=rows) / some,
            np.where(chars < 0, 0.0, np.log1p(np.maximum(chars, 0))),
            (chars < 0).astype(np.float64),
        ]
    )


def train(given: list[Inputs], labels: np.ndarray, passes: int = 10, batch: int = 256, seed: int = 7) -> Machine | None:
    """A machine fitted to 0/1 ``labels`` by Adam on the logistic loss; None unless both labels occur."""
    labels = labels.astype(np.float64)
    rows = len(labels)
    if not rows or labels.min() == labels.max():
        return None
    dense = np.concatenate([part.dense for part in given])
    sizes = np.concatenate([np.bincount(part.row, minlength=len(part.dense)) for part in given]).astype(np.int64)
    word = given[0].word if len(given) == 1 else np.concatenate([part.word for part in given])
    value = given[0].value if len(given) == 1 else np.concatenate([part.value for part in given])
    ends = np.cumsum(sizes)
    draw = np.random.default_rng(seed)
    scale = dense.std(axis=0)
    machine = Machine(
        float(np.log(labels.mean() / (1 - labels.mean()))),
        np.zeros(WORD_INPUTS, np.float32),
        (draw.standard_normal((WORD_INPUTS, FACTORS)) * 0.01).astype(np.float32),
        np.zeros(STATISTICS, np.float32),
        (draw.standard_normal((STATISTICS, FACTORS)) * 0.01).astype(np.float32),
        dense.mean(axis=0),
        np.where(scale > 1e-9, scale, 1.0),
    )
    moments = {name: [np.zeros_like(getattr(machine, name)), np.zeros_like(getattr(machine, name))] for name in ("weights", "vectors", "dense_weights", "dense_vectors")}
    bias_moments = [0.0, 0.0]
    step = 0
    for turn in range(passes):
        order = draw.permutation(rows)
        rate = 0.02 * (1 - turn / passes) + 0.001
        for at in range(0, rows, batch):
            chosen = order[at : at + batch]
            lengths = sizes[chosen]
            inner = np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)
            where = np.repeat(ends[chosen] - lengths, lengths) + inner
            part = Inputs(np.repeat(np.arange(len(chosen)), lengths), word[where], value[where], dense[chosen])
            linear, total, squares = machine.sums(part)
            off = (_sigmoid(machine.bias + linear + 0.5 * (total**2 - squares).sum(axis=1)) - labels[chosen]) / len(chosen)
            off = off.astype(np.float32)
            x = machine.standard(part.dense)
            step += 1

            def adam(name, grad, rows_at=slice(None)):
                held, (m, v) = getattr(machine, name), moments[name]
                m[rows_at] = 0.9 * m[rows_at] + 0.1 * grad
                v[rows_at] = 0.999 * v[rows_at] + 0.001 * grad**2
                held[rows_at] -= rate * (m[rows_at] / (1 - 0.9**step)) / (np.sqrt(v[rows_at] / (1 - 0.999**step)) + 1e-6)

            slope = (off[part.row] * part.value).astype(np.float32)
            pull = slope[:, None] * (total[part.row] - machine.vectors[part.word] * part.value[:, None])
            used, back = np.unique(part.word, return_inverse=True)
            weight_grad = np.bincount(back, slope, len(used)).astype(np.float32)
            vector_grad = np.stack([np.bincount(back, pull[:, f], len(used)) for f in range(FACTORS)], axis=1).astype(np.float32)
            dense_vector_grad = x.T @ (off[:, None] * total) - ((off[:, None] * x**2).sum(axis=0))[:, None] * machine.dense_vectors
            adam("weights", weight_grad + 1e-5 * machine.weights[used], used)
            adam("vectors", vector_grad + 1e-5 * machine.vectors[used], used)
            adam("dense_weights", x.T @ off)
            adam("dense_vectors", dense_vector_grad)
            slope = float(off.sum())
            bias_moments = [0.9 * bias_moments[0] + 0.1 * slope, 0.999 * bias_moments[1] + 0.001 * slope**2]
            machine.bias -= rate * (bias_moments[0] / (1 - 0.9**step)) / (np.sqrt(bias_moments[1] / (1 - 0.999**step)) + 1e-6)
    return machine


def held_out(doc_id):
    """Whether a row takes no part in learning: crc32 of the doc_id as text, modulo 3, is 1. Null ids do not learn either."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, rows: int = TRAINING_ROWS) -> Machine | None:
    """A machine for ``labels.quality``, learnt from labelled rows that are not held out.

    At most ``rows`` of them are taken, those of least hash, so the sample is the same wherever the rows lie; its
    inputs are computed by the executors and come to the driver (20,000 texts of 300 different words: 70 MB). A
    document with several labels takes the largest. None when the rows do not hold both labels.
    """
    known = labels.select("doc_id", "quality").filter("doc_id is not null and quality is not null")
    known = known.filter(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("quality").alias("quality"))
    sample = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    own = docs.select("doc_id", F.col("text").cast("binary").alias("text"), F.col("n_chars").cast("long").alias("n_chars"))
    chosen = own.join(F.broadcast(sample), "doc_id").select("doc_id", "quality", "text", "n_chars")

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            first = 0
            for part in inputs(batch.column(2), batch.column(3)):
                rows = len(part.dense)
                cuts = np.searchsorted(part.row, np.arange(rows + 1)).tolist()
                word, value = part.word.astype("<u4"), part.value.astype("<f4")
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(first, rows),
                        batch.column(1).slice(first, rows),
                        pa.array([word[a:b].tobytes() for a, b in zip(cuts, cuts[1:])], pa.binary()),
                        pa.array([value[a:b].tobytes() for a, b in zip(cuts, cuts[1:])], pa.binary()),
                        pa.array([row.tobytes() for row in part.dense], pa.binary()),
                    ],
                    ["doc_id", "quality", "word", "value", "dense"],
                )
                first += rows

    table = chosen.mapInArrow(made, "doc_id long, quality int, word binary, value binary, dense binary").toArrow()
    if not table.num_rows:
        return None
    table = table.sort_by("doc_id")
    word, sizes = _joined(table, "word", "<u4")
    value, _ = _joined(table, "value", "<f4")
    dense = _joined(table, "dense", "<f8")[0].reshape(-1, STATISTICS)
    row = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
    return train([Inputs(row, word, value, dense)], np.array(table.column("quality").to_pylist()))


def _joined(table: pa.Table, name: str, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """(numbers, how many of each row) of a column of packed numbers, without a copy where it is one chunk."""
    column = table.column(name).combine_chunks()
    if isinstance(column, pa.ChunkedArray):
        column = column.chunk(0) if column.num_chunks == 1 else pa.concat_arrays(column.chunks)
    _, at, data = column.buffers()
    offsets = np.frombuffer(at, np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    numbers = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]].view(kind) if data is not None else np.zeros(0, kind)
    return numbers, np.diff(offsets) // np.dtype(kind).itemsize


def _scores(machine: Machine | None, texts: pa.Array, chars: pa.Array) -> np.ndarray:
    """The probability of quality 1 of each of the binary ``texts``; 0.5 without a machine."""
    if machine is None:
        return np.full(len(texts), 0.5)
    parts = [machine.score(part) for part in inputs(texts, chars)]
    return np.concatenate(parts) if parts else np.zeros(0)


def score(docs: DataFrame, machine: Machine | None) -> DataFrame:
    """``doc_id`` and ``score``, the probability of quality 1; 0.5 without a machine.

    The whole text counts; a null text is empty, a null n_chars an input of its own.
    """
    sent = docs.sparkSession.sparkContext.broadcast(machine)

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = _scores(sent.value, batch.column(1), batch.column(2))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())], ["doc_id", "score"])

    own = docs.select("doc_id", F.col("text").cast("binary").alias("text"), F.col("n_chars").cast("long").alias("n_chars"))
    return own.mapInArrow(made, docs.select("doc_id").schema.add("score", "double"))


def assess(docs: DataFrame, labels: DataFrame, rows: int = TRAINING_ROWS) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted (1 from a score of 0.5 on).

    Without both labels among the rows to learn from, all scores are 0.5. Repeated rows repeat; rows with a null doc_id
    are scored and not held out; an empty table gives no rows; columns but doc_id, text and n_chars are ignored.
    """
    scored = score(docs, fit(docs, labels, rows))
    return scored.select(
        "doc_id",
        held_out(F.col("doc_id")).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )


def keep_good(docs: DataFrame, labels: DataFrame, rows: int = TRAINING_ROWS) -> DataFrame:
    """The rows of ``docs`` that score 0.5 or more, all columns kept.

    A row crosses to Python once, its text as the bytes that are scored; rows that go do not come back.
    """
    sent = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, rows))
    names = docs.columns
    text, chars = names.index("text"), names.index("n_chars")
    own = docs.select(*[F.col(f"`{name}`").cast("binary").alias(name) if name == "text" else F.col(f"`{name}`") for name in names])

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, BATCH_ROWS):
                part = batch.slice(first, BATCH_ROWS)
                good = _scores(sent.value, part.column(text), part.column(chars).cast(pa.int64())) >= 0.5
                yield part.filter(pa.array(good))

    kept = own.mapInArrow(made, own.schema)
    return kept.select(*[F.col("text").cast("string").alias("text") if name == "text" else F.col(f"`{name}`") for name in names])
