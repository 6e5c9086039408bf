"""SimHash near-duplicates by covering locality-sensitive hashing.

A text's fingerprint has 64 bits, each the majority of that bit over the hashes of its word shingles. Two texts are
linked when their fingerprints differ in at most ``RADIUS`` = 3 bits. To find all such pairs, every bit position gets
one of the 15 non-zero vectors of four bits, and each such vector v gives a mask: the positions whose vector has an odd
inner product with v. The vectors of three differing positions span less than the whole space, so some v is orthogonal
to them all and its mask hides every difference: each linked pair collides in one of 15 tables, whatever the bits are.

Equal fingerprints are one node. A table's bucket holds fingerprints that agree in about 34 bits; small ones are
compared at once. A larger bucket's rows pass through to a second level of 15 masks over the bits still free, after
which at most 16 bits are free: no bucket of that level can hold more than 2^16 fingerprints. Buckets give the links of a
spanning forest, not their pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from postweave.llm.components import connected
from postweave.llm.stored import stored
from postweave.llm.words import word_lists

RADIUS = 3
BITS = 64
BUCKET = 1024
_VECTORS = range(1, 1 << (RADIUS + 1))


def _masks(positions: list[int]) -> list[int]:
    """One mask per non-zero vector, over ``positions``."""
    given = {position: 1 + place % len(_VECTORS) for place, position in enumerate(positions)}
    return [sum(1 << p for p in positions if (given[p] & v).bit_count() % 2) for v in _VECTORS]


MASKS = _masks(list(range(BITS)))
SUB_MASKS = [[mask | sub for sub in _masks([p for p in range(BITS) if not mask >> p & 1])] for mask in MASKS]


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def fingerprint(text: bytes | None, words: int = 3) -> int:
    """The fingerprint of one text; zero without words."""
    from xxhash import xxh64_intdigest

    ones = np.zeros(BITS, dtype=np.int64)
    total = 0
    held: list[bytes] = []

    def count(hashes: list[int]) -> None:
        bits = np.unpackbits(np.array(hashes, dtype="<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones[:] += bits.sum(axis=0, dtype=np.int64)

    for more in word_lists((text or b"").lower()):
        held += more
        if len(held) < words:
            continue
        joined = b" ".join(held)
        ends = np.cumsum([len(word) + 1 for word in held]) - 1
        starts = np.concatenate(([0], ends[:-1] + 1))[: len(held) - words + 1].tolist()
        hashes = [xxh64_intdigest(joined[s:e], 42) for s, e in zip(starts, ends[words - 1 :].tolist())]
        total += len(hashes)
        count(hashes)
        held = held[len(held) - words + 1 :] if words > 1 else []
    if not total and held:
        total = 1
        count([xxh64_intdigest(b" ".join(held), 42)])
    return sum(1 << bit for bit in range(BITS) if 2 * ones[bit] > total)


def fingerprints(docs: DataFrame, words: int = 3, *keep: str) -> DataFrame:
    """``doc_id``, the columns named in ``keep`` and ``fp``, the fingerprint as a signed long."""
    fields = docs.select("doc_id", *keep).schema

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = [_signed(fingerprint(text.as_py(), words)) for text in batch.column(len(keep) + 1)]
            columns = [batch.column(i) for i in range(len(keep) + 1)] + [pa.array(fps, type=pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", *keep, "fp"])

    return docs.select("doc_id", *keep, F.col("text").cast("binary").alias("text")).mapInArrow(made, fields.add("fp", "long"))


def _spanning(fps: np.ndarray) -> list[tuple[int, int]]:
    """Links (first found, member) that connect what differs in at most ``RADIUS`` bits, by breadth-first search."""
    left = np.arange(len(fps))
    found = []
    while len(left) > 1:
        root, left = left[0], left[1:]
        front = np.array([root])
        while len(front) and len(left):
            near = np.zeros(len(left), dtype=bool)
            for at in range(0, len(front), 64):
                apart = np.bitwise_count(fps[front[at : at + 64], None] ^ fps[None, left])
                near |= (apart <= RADIUS).any(axis=0)
            front, left = left[near], left[~near]
            found += [(int(root), int(member)) for member in front]
    return found


def _bucket_links(rows: DataFrame, limit: int | None) -> DataFrame:
    """Links (a, b) within the buckets of ``rows`` (mask, key, fp); of larger buckets (mask, fp) instead, b null.

    Rows are dealt by bucket and sorted, so a bucket streams by; at most ``limit`` of its rows are held.
    """

    def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros((3, 0), dtype=np.int64)
        passing = None

        def out(masks, a, b) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array(masks, pa.int32()), pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["mask", "a", "b"]
            )

        def close(part: np.ndarray) -> Iterator[pa.RecordBatch]:
            """Whole buckets."""
            if not part.shape[1]:
                return
            new = np.flatnonzero((part[0, 1:] != part[0, :-1]) | (part[1, 1:] != part[1, :-1])) + 1
            starts = np.concatenate(([0], new))
            sizes = np.diff(np.concatenate((starts, [part.shape[1]])))
            fps = part[2].view(np.uint64)
            twos = starts[sizes == 2]
            twos = twos[np.bitwise_count(fps[twos] ^ fps[twos + 1]) <= RADIUS]
            a, b = [part[2, twos]], [part[2, twos + 1]]
            for start, size in zip(starts[sizes > 2].tolist(), sizes[sizes > 2].tolist()):
                own = np.array(_spanning(fps[start : start + size]), dtype=np.int64).reshape(-1, 2) + start
                a.append(part[2, own[:, 0]])
                b.append(part[2, own[:, 1]])
            a, b = np.concatenate(a), np.concatenate(b)
            if len(a):
                yield out(np.full(len(a), -1), a, b)

        for batch in batches:
            part = np.stack([batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(3)])
            part = np.concatenate((held, part), axis=1)
            if passing is not None:
                same = int(np.cumprod((part[0] == passing[0]) & (part[1] == passing[1])).sum())
                if same:
                    yield out(part[0, :same], part[2, :same], np.ma.masked_all(same, dtype=np.int64))
                part = part[:, same:]
                if part.shape[1]:
                    passing = None
            if not part.shape[1]:
                held = part
                continue
            last = int(np.flatnonzero((part[0] == part[0, -1]) & (part[1] == part[1, -1]))[0])
            whole, held = part[:, :last], part[:, last:]
            if limit is not None and whole.shape[1]:
                new = np.flatnonzero((whole[0, 1:] != whole[0, :-1]) | (whole[1, 1:] != whole[1, :-1])) + 1
                sizes = np.diff(np.concatenate(([0], new, [whole.shape[1]])))
                large = np.repeat(sizes > limit, sizes)
                if large.any():
                    yield out(whole[0, large], whole[2, large], np.ma.masked_all(int(large.sum()), dtype=np.int64))
                    whole = whole[:, ~large]
            yield from close(whole)
            if limit is not None and held.shape[1] > limit:
                yield out(held[0], held[2], np.ma.masked_all(held.shape[1], dtype=np.int64))
                passing, held = (held[0, 0], held[1, 0]), held[:, :0]
        yield from close(held)

    dealt = rows.repartition("mask", "key").sortWithinPartitions("mask", "key", "fp")
    return dealt.mapInArrow(linked, "mask int, a long, b long")


def links(distinct: DataFrame, limit: int = BUCKET) -> DataFrame:
    """Links (a, b) between the fingerprints ``fp`` of ``distinct`` that connect all pairs within the radius."""

    def table(index: int, mask: int):
        return F.struct(F.lit(index).alias("mask"), F.col("fp").bitwiseAND(F.lit(_signed(mask))).alias("key"))

    first = distinct.select("fp", F.explode(F.array(*[table(i, mask) for i, mask in enumerate(MASKS)])).alias("t"))
    found = stored(_bucket_links(first.select("t.mask", "t.key", "fp"), limit), "simhash-buckets")
    large = found.filter("mask >= 0").select("mask", F.col("a").alias("fp"))
    choice = F.create_map(
        *[
            part
            for i, subs in enumerate(SUB_MASKS)
            for part in (F.lit(i), F.array(*[table(i * 16 + j, mask) for j, mask in enumerate(subs)]))
        ]
    )
    second = large.select("fp", F.explode(choice[F.col("mask")]).alias("t")).select("t.mask", "t.key", "fp")
    close = _bucket_links(second, None).filter("mask = -1")
    return found.filter("mask = -1").select("a", "b").unionByName(close.select("a", "b"))


def _rooted(docs: DataFrame, words: int, *keep: str) -> tuple[DataFrame, DataFrame]:
    """(doc_id, the columns named in ``keep`` and fp of each row; fp, first and root of each fingerprint)."""
    own = stored(fingerprints(docs, words, *keep), "simhash")
    nodes = own.groupBy("fp").agg(F.min("doc_id").alias("first"))
    found = connected(links(nodes.select("fp")), "simhash-links")
    found = found.select(F.col("node").alias("fp"), F.col("component").alias("root"))
    return own, nodes.join(found, "fp", "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))


def components(docs: DataFrame, words: int = 3) -> DataFrame:
    """One row per document: doc_id, fingerprint (16 lower-case hex digits), component_id.

    ``component_id`` is the smallest doc_id that links reach, itself included; documents with a null doc_id link like
    any other but never name a component unless all its ids are null. Null and empty texts have the fingerprint
    zero. Repeated rows repeat in the result; an empty table gives no rows; other columns are ignored.
    """
    own, rooted = _rooted(docs, words)
    named = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    labels = rooted.join(named, "root").select("fp", "component_id")
    return own.join(labels, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, words: int = 3) -> DataFrame:
    """``docs`` without near-duplicates: of each component the row with the smallest doc_id stays, all columns kept.

    Rows that share a doc_id but not their text are documents of their own, each in its component. Where several rows of
    a component have its smallest doc_id, the one of least text hash stays, of those the one of least hash over all
    columns; of full repeats one stays. Rows with a null doc_id cannot be named and all stay.
    """
    columns = [F.col(f"`{name}`") for name in docs.columns]
    keys = [F.xxhash64("text").alias("sig"), F.xxhash64(*columns).alias("row"), F.xxhash64(F.lit(1), *columns).alias("row2")]
    own, rooted = _rooted(docs.select("doc_id", *keys, "text"), words, "sig", "row", "row2")
    # the least row of a fingerprint first: copies are many, fingerprints of a component few
    least = F.min(F.struct("doc_id", "sig", "row", "row2")).alias("least")
    best = own.filter("doc_id is not null").groupBy("fp").agg(least).join(rooted, "fp").groupBy("root").agg(F.min("least").alias("least"))
    best = best.select(F.col("least.row").alias("kept row"), F.col("least.row2").alias("kept row2"))
    named = docs.filter("doc_id is not null").withColumns({"kept row": F.xxhash64(*columns), "kept row2": F.xxhash64(F.lit(1), *columns)})
    kept = named.join(best, ["kept row", "kept row2"], "left_semi")
    place = F.row_number().over(Window.partitionBy("kept row", "kept row2").orderBy("doc_id"))
    once = kept.withColumn("kept place", place).filter("`kept place` = 1").select(*columns)
    return once.unionByName(docs.filter("doc_id is null"))
