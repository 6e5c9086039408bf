"""Removal of repeated passages with a count-min prefilter.

A window is a run of ``WINDOW`` words of one document; every word that lies in a window whose words also start anywhere
else is removed. Comparing all windows would shuffle one row per word of the corpus, so a sketch goes first.

First pass: each partition counts into a sketch, which stores for each cell whether it was hit once or more often. What a
window counts under is the hash of its minimiser, the 16-word run of least hash inside it, at the place where it stands.
Equal windows have equal minimisers at places that differ, so a cell's count is never below the count of a window; runs are
shared by the windows around them, so about a tenth of all words are counted. Merged, the sketches are one bit per cell:
hit more than once. Its size follows the input, between ``MIN_CELLS`` and ``MAX_CELLS`` (64 MB of bits), which bounds what
is broadcast; a sketch that is too small only lets more windows pass.

Second pass: windows whose cell was hit more than once are grouped exactly, by 128 bits of hash. Within a task, equal windows
meet first and leave as one row, so the most frequent window has one row per block of a task, not one per place.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from postweave.llm.words import groups, mix, word_hashes, word_lists, word_spans

WINDOW = 35
RUN = 16
MIN_CELLS, MAX_CELLS = 1 << 20, 1 << 29
BLOCK_CELLS = 1 << 19
WORDS_AT_ONCE = 1 << 19
_BASES = (0x9E3779B97F4A7C15, 0xD1B54A32D192ED03)


def _rolled(hashes: np.ndarray, length: int, factor: int) -> np.ndarray:
    """A hash of every run of ``length`` values: a polynomial in ``factor``, put together from runs of doubling width."""
    total = len(hashes) - length + 1
    made = np.zeros(total, dtype=np.uint64)
    part, width, done = hashes, 1, 0
    while True:
        power = np.uint64(pow(factor, width, 1 << 64))
        if length & width:
            made = made * power + part[done : done + total]
            done += width
        if done == length:
            return mix(made)
        part = part[:-width] * power + part[width:]
        width *= 2


def _least(values: np.ndarray, length: int) -> np.ndarray:
    """The least of every ``length`` consecutive values."""
    width = 1
    while width * 2 <= length:
        values = np.minimum(values[:-width], values[width:])
        width *= 2
    rest = length - width
    return np.minimum(values[:-rest], values[rest:]) if rest else values


class _Windows:
    """The windows of a stretch of words: validity, and the place and hash of each one's minimiser."""

    def __init__(self, hashes: np.ndarray, doc: np.ndarray, window: int, run: int):
        self.count = max(0, len(hashes) - window + 1)
        if not self.count:
            return
        self.valid = doc[: self.count] == doc[window - 1 :]
        self.run_hashes = _rolled(hashes, run, _BASES[0])
        places = np.arange(len(self.run_hashes), dtype=np.uint64)
        low = np.uint64((1 << 24) - 1)
        self.place = (_least((self.run_hashes & ~low) | places, window - run + 1) & low).astype(np.int64)


def _stretches(column: pa.Array, window: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, words' hashes in two lanes, document, place in the document), overlapping by a window less one word."""
    for first, _, data, offsets in groups(column):
        starts, ends, doc = word_spans(data, offsets)
        if not len(starts):
            continue
        lanes = [word_hashes(data, starts, ends, base) for base in _BASES]
        opening = np.searchsorted(doc, doc, side="left")
        place = np.arange(len(doc)) - opening
        at = 0
        while True:
            end = min(len(doc), at + WORDS_AT_ONCE)
            yield first, lanes[0][at:end], lanes[1][at:end], doc[at:end], place[at:end]
            if end == len(doc):
                break
            at = end - window + 1


def _set_bits(bits: np.ndarray, cells: np.ndarray) -> None:
    """Set the bits of sorted ``cells``."""
    where = cells >> 3
    starts = np.flatnonzero(np.concatenate(([True], where[1:] != where[:-1])))
    bits[where[starts]] |= np.bitwise_or.reduceat((1 << (cells & 7)).astype(np.uint8), starts)


def _has_bit(bits: np.ndarray, cells: np.ndarray) -> np.ndarray:
    return bits[cells >> 3] >> (cells & 7).astype(np.uint8) & 1 != 0


def sketch(docs: DataFrame, cells: int, window: int = WINDOW, run: int = RUN) -> DataFrame:
    """(block, often): for each block of cells the bits of cells that were hit more than once, all partitions merged.

    Blocks in which no cell was are left out.
    """
    size = min(cells, BLOCK_CELLS)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        once, often = np.zeros(cells // 8, np.uint8), np.zeros(cells // 8, np.uint8)
        for batch in batches:
            for _, hashes, _, doc, _ in _stretches(batch.column(0), window):
                own = _Windows(hashes, doc, window, run)
                if not own.count or not own.valid.any():
                    continue
                # overlapping stretches share no window, but may share a minimiser's place: a count too high at most
                hits = own.run_hashes[np.unique(own.place[own.valid])] & np.uint64(cells - 1)
                hits, times = np.unique(hits.astype(np.int64), return_counts=True)
                again = hits[(times > 1) | _has_bit(once, hits)]
                if len(again):
                    _set_bits(often, again)
                _set_bits(once, hits)
        for block in range(cells // size):
            part = slice(block * size // 8, (block + 1) * size // 8)
            if once[part].any():
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([block], pa.int32()),
                        pa.array([zlib.compress(once[part].tobytes(), 1)], pa.binary()),
                        pa.array([zlib.compress(often[part].tobytes(), 1)], pa.binary()),
                    ],
                    ["block", "once", "often"],
                )

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, once, often = None, None, None

        def out() -> Iterator[pa.RecordBatch]:
            if now is not None and often.any():
                yield pa.RecordBatch.from_arrays(
                    [pa.array([now], pa.int32()), pa.array([zlib.compress(often.tobytes(), 1)], pa.binary())], ["block", "often"]
                )

        for batch in batches:
            for block, first, second in zip(*(column.to_pylist() for column in batch.columns)):
                first, second = (np.frombuffer(zlib.decompress(part), np.uint8) for part in (first, second))
                if block != now:
                    yield from out()
                    now, once, often = block, first.copy(), second.copy()
                else:
                    often |= second | (once & first)
                    once |= first
        yield from out()

    parts = docs.select(F.col("text").cast("binary").alias("text")).mapInArrow(counted, "block int, once binary, often binary")
    dealt = parts.repartition("block").sortWithinPartitions("block")
    return dealt.mapInArrow(merged, "block int, often binary")


def sketch_cells(docs: DataFrame) -> int:
    """About eight cells for each place counted: a word takes some six bytes, and a tenth of all words are places."""
    total = docs.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    cells = MIN_CELLS
    while cells < MAX_CELLS and cells < total * 8 / 60:
        cells *= 2
    return cells


def repeated_windows(docs: DataFrame, window: int = WINDOW, run: int = RUN) -> DataFrame:
    """(doc_id, sig, start, length): runs of words covered by windows that start elsewhere too; runs may overlap.

    ``sig`` is a hash of the text, which tells apart documents that share a doc_id.
    """
    run = min(run, window)
    cells = sketch_cells(docs)
    size = min(cells, BLOCK_CELLS)
    often = np.zeros(cells // 8, np.uint8)
    for block, part in sketch(docs, cells, window, run).collect():
        often[block * size // 8 : (block + 1) * size // 8] = np.frombuffer(zlib.decompress(bytes(part)), np.uint8)
    shared = docs.sparkSession.sparkContext.broadcast(zlib.compress(often.tobytes(), 1))

    def likely(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.frombuffer(zlib.decompress(shared.value), np.uint8)
        for batch in batches:
            ids, sigs = batch.column(0), batch.column(1)
            for first, lane_a, lane_b, doc, place in _stretches(batch.column(2), window):
                own = _Windows(lane_a, doc, window, run)
                if not own.count:
                    continue
                at = np.flatnonzero(own.valid)
                hits = (own.run_hashes[own.place[at]] & np.uint64(cells - 1)).astype(np.int64)
                at = at[_has_bit(bits, hits)]
                if not len(at):
                    continue
                h1 = _rolled(lane_a, window, _BASES[0])[at].view(np.int64)
                h2 = _rolled(lane_b, window, _BASES[1])[at].view(np.int64)
                order = np.lexsort((h2, h1))
                new = np.ones(len(at), dtype=bool)
                new[1:] = (h1[order][1:] != h1[order][:-1]) | (h2[order][1:] != h2[order][:-1])
                heads = np.flatnonzero(new)
                times = np.diff(np.concatenate((heads, [len(at)])))
                several = np.zeros(len(at), dtype=bool)
                several[order] = np.repeat(times > 1, times)
                # rows for grouping: windows met once, with their place; those met more often once, without
                single = ~several
                lead = order[heads[times > 1]]
                # what is known already, as runs of words
                known = at[several]
                breaks = np.ones(len(known), dtype=bool)
                breaks[1:] = (np.diff(known) > 1) | (doc[known[1:]] != doc[known[:-1]])
                begin = np.flatnonzero(breaks)
                run_starts = known[begin]
                run_ends = known[np.concatenate((begin[1:], [len(known)])) - 1] if len(known) else known
                rows = np.concatenate((at[single], np.full(len(lead), -1), run_starts))
                own_doc = np.where(rows >= 0, first + doc[rows], -1)
                index = pa.array(own_doc, mask=rows < 0)
                spread = mix(rows.astype(np.uint64) ^ h1[:1].view(np.uint64)).view(np.int64)[len(rows) - len(run_starts) :]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.concatenate((h1[single], h1[lead], spread))),
                        pa.array(np.concatenate((h2[single], h2[lead], np.arange(len(run_starts))))),
                        ids.take(index),
                        sigs.take(index),
                        pa.array(np.where(rows >= 0, place[rows], -1).astype(np.int32)),
                        pa.array(np.concatenate((np.full(len(rows) - len(run_starts), window), run_ends - run_starts + window)).astype(np.int32)),
                        pa.array(np.concatenate((np.ones(single.sum(), np.int8), np.full(len(lead), 2, np.int8), np.full(len(run_starts), 2, np.int8)))),
                    ],
                    ["h1", "h2", "doc_id", "sig", "start", "length", "times"],
                )

    keyed = docs.select("doc_id", F.hash("text").alias("sig"), F.col("text").cast("binary").alias("text"))
    found = keyed.mapInArrow(likely, "h1 long, h2 long, doc_id long, sig int, start int, length int, times byte")
    times = F.sum(F.col("times").cast("int")).over(Window.partitionBy("h1", "h2"))
    return found.withColumn("all", times).filter("all > 1 and start >= 0").select("doc_id", "sig", "start", "length")


def remove_repeats(docs: DataFrame, window: int = WINDOW, run: int = RUN, with_text: bool = False) -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, kept_sha256, and with ``with_text`` the kept words as text.

    Words are runs of bytes other than ASCII white space, unchanged; kept words are joined by one space. A null or
    empty text, or one shorter than a window, keeps all it has. Rows with a null doc_id count like any other, and
    full repeats of a row repeat each other's windows. An empty table gives no rows; other columns are ignored.
    """
    runs = repeated_windows(docs, window, run)
    runs = runs.groupBy("doc_id", "sig").agg(F.collect_list(F.struct("start", "length")).alias("runs"))
    runs = runs.select(F.col("doc_id").alias("run_id"), F.col("sig").alias("run_sig"), "runs.start", "runs.length")
    own = docs.select("doc_id", F.hash("text").alias("sig"), F.col("text").cast("binary").alias("text"))
    same = F.col("doc_id").eqNullSafe(F.col("run_id")) & F.col("sig").eqNullSafe(F.col("run_sig"))
    joined = own.join(runs, same, "left").select("doc_id", "text", "start", "length")
    names = ["doc_id", "n_words", "n_removed", "kept_sha256"] + ["text"] * with_text

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from hashlib import sha256

        for batch in batches:
            rows = [[], [], [], []]
            for text, starts, lengths in zip(*(batch.column(i) for i in (1, 2, 3))):
                digest = sha256()
                total = removed = 0
                kept_parts = []
                gone = _merged_runs(starts, lengths)
                glue = b""
                for words in word_lists(text.as_py() or b""):
                    kept, at, taken = [], 0, 0
                    for start, end in gone:
                        if end <= total or start >= total + len(words):
                            continue
                        low, high = max(start - total, 0), min(end - total, len(words))
                        kept += words[at:low]
                        taken += high - low
                        at = high
                    kept += words[at:]
                    total += len(words)
                    removed += taken
                    if kept:
                        digest.update(glue + b" ".join(kept))
                        glue = b" "
                        if with_text:
                            kept_parts.append(b" ".join(kept))
                rows[0].append(total)
                rows[1].append(removed)
                rows[2].append(digest.hexdigest())
                rows[3].append(b" ".join(kept_parts).decode("utf-8", "replace"))
            arrays = [batch.column(0), pa.array(rows[0], pa.int64()), pa.array(rows[1], pa.int64()), pa.array(rows[2], pa.string())]
            yield pa.RecordBatch.from_arrays(arrays + [pa.array(rows[3], pa.string())] * with_text, names)

    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", text string" * with_text
    return joined.mapInArrow(cut, schema)


def _merged_runs(starts: pa.Scalar, lengths: pa.Scalar) -> list[tuple[int, int]]:
    """The union of runs as sorted (start, end)."""
    if not starts.is_valid:
        return []
    low = starts.values.to_numpy(zero_copy_only=False).astype(np.int64)
    order = np.argsort(low, kind="stable")
    low = low[order]
    high = np.maximum.accumulate(low + lengths.values.to_numpy(zero_copy_only=False)[order])
    new = np.concatenate(([True], low[1:] > high[:-1]))
    at = np.flatnonzero(new)
    return list(zip(low[at].tolist(), high[np.concatenate((at[1:], [len(low)])) - 1].tolist()))
