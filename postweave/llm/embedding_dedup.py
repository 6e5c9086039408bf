"""Near-duplicate embeddings by collision-counting projections.

Vectors are scaled to length one and projected on many random directions. Each projection sorts the vectors of a label;
a pair collides in it when one lies in the window around the other. Pairs that collide in at least ``COLLISIONS`` of the
projections are verified by their exact cosine. The number of projections is calibrated: a pair just at the threshold
passes with probability ``RECALL`` at least, closer pairs are likelier to.

A window around one value holds a fixed share of all vectors, however narrow, so that sorted lists alone would cost the
square of the input. Each projection therefore has a few sign bits of further directions beside it, as many as the
label's size asks for, and sorts the vectors of each sign pattern by themselves.

A pair is judged in the first projection in which it collides, where all other projections of both vectors are known
too: no pair is ever a row. Lists give each vector's number of links, and the links of a spanning forest.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from math import acos, pi, sqrt
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postweave.llm.components import connected
from postweave.llm.stored import stored

COSINE = 0.93
RECALL = 0.999
COLLISIONS = 2
LIST_ROWS = 128
BLOCK = 256
WINDOW = 1.65  # half width, in standard deviations of the difference of a pair at the threshold
# projections are whole numbers, so that they come out alike in every task
_UNIT, _STEP = float(1 << 20), float(1 << 10)


@lru_cache(maxsize=64)
def calibrated(rows: int, cosine: float) -> tuple[int, int]:
    """(sign bits, projections) for a label of ``rows`` vectors."""
    bits = max(0, (rows // LIST_ROWS).bit_length())
    window = 2 * NormalDist().cdf(WINDOW) - 1
    hit = (1 - acos(cosine) / pi) ** bits * window
    tables = COLLISIONS
    while _passes(tables, hit) < RECALL:
        tables += 1
    return bits, tables


def _passes(tables: int, hit: float) -> float:
    """The probability of at least ``COLLISIONS`` hits."""
    missed, ways = 0.0, 1.0
    for k in range(COLLISIONS):
        missed += ways * hit**k * (1 - hit) ** (tables - k)
        ways = ways * (tables - k) / (k + 1)
    return 1 - missed


@lru_cache(maxsize=8)
def _directions(size: int, count: int) -> np.ndarray:
    return np.rint(np.random.default_rng((size, 20240101)).standard_normal((count, size)) * _STEP).T.copy()


def _projected(vectors: np.ndarray, rows: int, cosine: float) -> tuple[np.ndarray, np.ndarray, float]:
    """(sign pattern, position) of each vector in each projection, and the window's half width; exact whole numbers."""
    bits, tables = calibrated(rows, cosine)
    norms = np.sqrt(np.einsum("ij,ij->i", vectors, vectors, optimize=False))
    whole = np.rint(vectors / norms[:, None] * _UNIT)
    made = (whole @ _directions(vectors.shape[1], tables * (bits + 1))).reshape(len(vectors), tables, bits + 1)
    cells = ((made[:, :, 1:] >= 0) @ (1 << np.arange(bits, dtype=np.int64))).astype(np.int64)
    return cells, made[:, :, 0], WINDOW * sqrt(2 - 2 * cosine) * _UNIT * _STEP


def _matrix(column: pa.Array) -> np.ndarray:
    """Vectors of one size from a binary column of doubles."""
    return np.stack([np.frombuffer(cell, dtype=np.float64) for cell in column.to_pylist()])


def _lists(vectors: DataFrame, cosine: float) -> DataFrame:
    """A row for each vector and projection: label, size, part, cell, position, node, members, rows and the vector."""

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = batch.column(4).to_numpy()
            sizes = batch.column(1).to_numpy()
            for rows, size in sorted(set(zip(counts.tolist(), sizes.tolist()))):
                chosen = np.flatnonzero((counts == rows) & (sizes == size))
                for at in range(0, len(chosen), 1024):
                    part = batch.take(pa.array(chosen[at : at + 1024]))
                    cells, positions, _ = _projected(_matrix(part.column(5)), rows, cosine)
                    for table in range(cells.shape[1]):
                        same = len(part)
                        yield pa.RecordBatch.from_arrays(
                            [
                                part.column(0),
                                part.column(1),
                                pa.array(np.full(same, table), pa.int32()),
                                pa.array(cells[:, table], pa.int64()),
                                pa.array(positions[:, table], pa.float64()),
                                part.column(2),
                                part.column(3),
                                part.column(4),
                                part.column(5),
                            ],
                            _NAMES,
                        )

    return vectors.select("label", "size", "node", "members", "rows", "vector").mapInArrow(dealt, _LISTED)


_LISTED = "label long, size int, part int, cell long, position double, node long, members long, rows long, vector binary"
_NAMES = [field.split()[0] for field in _LISTED.split(", ")]


def _found(lists: DataFrame, cosine: float) -> DataFrame:
    """(a, b, n): links of a spanning forest with n null, and partial numbers of links n of node a with b null."""

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict | None = None  # the last rows of the list at hand, back to a window's width
        links: list[tuple[int, int]] = []
        numbers: dict[int, int] = {}
        roots: dict[int, int] = {}
        now = None

        def root(node: int) -> int:
            while roots.get(node, node) != node:
                roots[node] = roots.get(roots[node], roots[node])
                node = roots[node]
            return node

        def flush() -> Iterator[pa.RecordBatch]:
            if links or numbers:
                a = [link[0] for link in links] + list(numbers)
                b = [link[1] for link in links] + [None] * len(numbers)
                n = [None] * len(links) + list(numbers.values())
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (a, b, n)], ["a", "b", "n"])
            links.clear()
            numbers.clear()

        for batch in batches:
            keys = np.stack([batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(4)])
            cuts = np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1
            for start, end in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows]):
                key = tuple(keys[:, start].tolist())
                if key != now:
                    now, held = key, None
                    roots.clear()
                    if len(numbers) + len(links) > 50_000:
                        yield from flush()
                    if end - start == 1 and end < batch.num_rows:
                        continue
                part = batch.slice(start, end - start)
                vectors, rows, table = _matrix(part.column(8)), part.column(7)[0].as_py(), key[2]
                cells, positions, width = _projected(vectors, rows, cosine)
                own = {
                    "node": part.column(5).to_numpy(),
                    "members": part.column(6).to_numpy(),
                    "vectors": vectors,
                    "cells": cells,
                    "positions": positions,
                }
                old = 0
                if held is not None:
                    old = len(held["node"])
                    own = {name: np.concatenate((held[name], own[name])) for name in own}
                place = own["positions"][:, table]
                norms = np.sqrt(np.einsum("ij,ij->i", own["vectors"], own["vectors"]))
                for at in range(old, len(place), BLOCK):
                    stop = min(len(place), at + BLOCK)
                    low = int(np.searchsorted(place, place[at] - width))
                    # pairs (i, j) with j before i in the list and within its window
                    i, j = np.nonzero(np.arange(low, stop)[None, :] < np.arange(at, stop)[:, None])
                    i, j = i + at, j + low
                    near = place[i] - place[j] <= width
                    i, j = i[near], j[near]
                    for some in range(0, len(i), 1 << 16):
                        x, y = i[some : some + (1 << 16)], j[some : some + (1 << 16)]
                        count = np.zeros(len(x), dtype=np.int16)
                        first = np.ones(len(x), dtype=bool)
                        for t in range(own["cells"].shape[1]):
                            hit = (own["cells"][x, t] == own["cells"][y, t]) & (np.abs(own["positions"][x, t] - own["positions"][y, t]) <= width)
                            count += hit
                            if t < table:
                                first &= ~hit
                        x, y = x[first & (count >= COLLISIONS)], y[first & (count >= COLLISIONS)]
                        cosines = np.einsum("ij,ij->i", own["vectors"][x], own["vectors"][y]) / (norms[x] * norms[y])
                        x, y = x[cosines >= cosine], y[cosines >= cosine]
                        for ends, others in ((x, y), (y, x)):
                            at_rows, back = np.unique(ends, return_inverse=True)
                            sums = np.bincount(back, own["members"][others], len(at_rows)).astype(np.int64)
                            for node, n in zip(own["node"][at_rows].tolist(), sums.tolist()):
                                numbers[node] = numbers.get(node, 0) + n
                        for a, b in zip(own["node"][x].tolist(), own["node"][y].tolist()):
                            one, two = root(a), root(b)
                            if one != two:
                                roots[max(one, two)] = min(one, two)
                                links.append((a, b))
                keep = int(np.searchsorted(place, place[-1] - width))
                held = {name: values[keep:] for name, values in own.items()}
            if len(numbers) + len(links) > 50_000:
                yield from flush()
        yield from flush()

    dealt = lists.repartition("label", "size", "part", "cell").sortWithinPartitions("label", "size", "part", "cell", "position", "node")
    return dealt.mapInArrow(judged, "a long, b long, n long")


def near_duplicates(embeddings: DataFrame, cosine: float = COSINE) -> DataFrame:
    """One row per row of ``embeddings`` (vec_id, label, embedding): vec_id, n_links, component_id, kept.

    Two vectors are compared when their labels are equal and their sizes too. Vectors that are null or zero or hold null
    or non-finite components, and those without a label or a vec_id, link with nothing: n_links 0, component_id
    the own vec_id. Equal vectors of a label are one node; rows that repeat vec_id, label and vector are one vector
    and repeat in the result. ``kept`` is whether the row names its component (null without a vec_id). An empty table
    gives no rows; other columns are ignored.
    """
    rows = embeddings.select("vec_id", F.col("label").cast("long").alias("label"), F.col("embedding").cast("array<double>").alias("embedding"))
    sound = F.expr("forall(embedding, x -> x is not null and not isnan(x) and abs(x) < double('infinity')) and exists(embedding, x -> x <> 0)")
    usable = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.coalesce(sound, F.lit(False))
    single = rows.filter(usable).groupBy("label", "embedding", "vec_id").agg(F.lit(1).alias("one"))
    nodes = stored(single.groupBy("label", "embedding").agg(F.min("vec_id").alias("node"), F.count("*").alias("members")), "embedding-nodes")

    sized = nodes.withColumn("size", F.size("embedding"))
    counts = sized.groupBy("label", "size").agg(F.count("*").alias("rows"))
    packed = sized.join(counts, ["label", "size"]).mapInArrow(_pack, "label long, size int, node long, members long, rows long, vector binary")
    found = stored(_found(_lists(packed, cosine), cosine), "embedding-links")
    components = connected(found.filter("b is not null").select("a", "b"), "embedding-components")
    numbers = found.filter("b is null").groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("linked"))
    labelled = nodes.join(numbers, "node", "left").join(components, "node", "left")
    labelled = labelled.select(
        "label",
        "embedding",
        (F.col("members") - 1 + F.coalesce("linked", F.lit(0))).alias("n_links"),
        F.coalesce("component", "node").alias("component_id"),
    )
    linked = rows.filter(usable).join(labelled, ["label", "embedding"]).select("vec_id", "n_links", "component_id")
    alone = rows.filter(~usable).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.col("vec_id") == F.col("component_id"))


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Arrays of doubles as bytes."""
    names = ["label", "size", "node", "members", "rows", "vector"]
    for batch in batches:
        vectors = [np.array(cell, dtype="<f8").tobytes() for cell in batch.column(batch.schema.names.index("embedding")).to_pylist()]
        kept = [batch.column(batch.schema.names.index(name)) for name in names[:-1]]
        yield pa.RecordBatch.from_arrays([*kept, pa.array(vectors, pa.binary())], names)
