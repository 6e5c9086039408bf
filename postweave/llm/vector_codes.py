"""Vector codes by product quantisation, the codebooks fitted by a member-resident Lloyd iteration.

Vectors become whole numbers and are cut into equal parts; every part position has a codebook of its own. Parts are dealt
once by (position, entry, salt), so that an entry's owners hold its members, and an entry with very many is owned by several
tasks. In each round owners sum the members that lie with them, the sums make the new codebooks, and owners look up every
member's nearest entry anew. Members that keep their entry stay in the file they are in; only parts that change it
migrate, in the next shuffle. The codebooks are the only thing all tasks share: entries times components numbers.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from postweave.llm.stored import stored
from postweave.operators.joins import join_groups
from postweave.sources.storage import fresh_folder

PARTS = 16
ENTRIES = 64
ROUNDS = 2
SCALE = 256
LARGEST = 1 << 26  # squared distances of parts of up to 512 components then fit 64 bits
SALT_ROWS = 2000
HOT_SHARE = 1000  # a label with over 1/1000 of the rows is hot: there are fewer than 1000 of them
CHUNK = 4096
_MEMBERS = "position int, entry int, salt long, row long, part binary"


@dataclass(frozen=True)
class Codes:
    """``rows``: row, vec_id, label, high, low (entries as bytes, eight positions each) and error. ``codebooks``: an array of
    (position, entry, component). ``migrated``: how many parts changed their entry after each round."""

    rows: DataFrame
    codebooks: np.ndarray
    migrated: tuple[int, ...]

    @property
    def sha256(self) -> str:
        return hashlib.sha256(",".join(map(str, self.codebooks.ravel().tolist())).encode()).hexdigest()


def whole_vectors(embeddings: DataFrame) -> DataFrame:
    """row, vec_id, label, size and vector (32-bit whole numbers) of the rows without null or non-finite components."""
    schema = T.StructType([embeddings.schema["vec_id"], embeddings.schema["label"]]).add("size", "integer").add("vector", "binary")

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(2)
            at = column.offsets.to_numpy().astype(np.int64)
            # a null component becomes not a number
            given = column.values.to_numpy(zero_copy_only=False).astype(np.float64)
            bad = np.concatenate(([0], np.cumsum(~np.isfinite(given))))
            kept = np.flatnonzero((bad[at[1:]] == bad[at[:-1]]) & ~column.is_null().to_numpy(zero_copy_only=False))
            # values that are no numbers are not in kept rows
            whole = np.floor(np.clip(np.nan_to_num(given) * SCALE, -LARGEST, LARGEST)).astype("<i4")
            cells = [whole[at[k] : at[k + 1]].tobytes() for k in kept.tolist()]
            chosen = pa.array(kept, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(chosen),
                    batch.column(1).take(chosen),
                    pa.array(np.diff(at)[kept].astype(np.int32)),
                    pa.array(cells, pa.binary()),
                ],
                ["vec_id", "label", "size", "vector"],
            )

    return embeddings.select("vec_id", "label", "embedding").mapInArrow(made, schema).withColumn("row", F.monotonically_increasing_id())


def _padded(cells: list[bytes], length: int) -> np.ndarray:
    return np.frombuffer(b"".join(cell.ljust(4 * length, b"\0") for cell in cells), dtype="<i4").reshape(len(cells), length)


def _nearest(parts: np.ndarray, positions: np.ndarray, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(entry, squared distance) of each part among its position's entries; ties go to the lower entry."""
    entry, error = np.empty(len(parts), np.int32), np.empty(len(parts), np.int64)
    for first in range(0, len(parts), CHUNK):
        here = slice(first, first + CHUNK)
        own, place = parts[here].astype(np.int64), positions[here]
        total = np.zeros((len(own), books.shape[1]), np.int64)
        for component in range(books.shape[2]):
            total += (own[:, component, None] - books[place, :, component]) ** 2
        entry[here] = total.argmin(axis=1)
        error[here] = total.min(axis=1)
    return entry, error


def _numbers(column: pa.Array, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype="<i4").reshape(len(column), width)


def _cells(parts: np.ndarray) -> pa.Array:
    data = np.ascontiguousarray(parts, dtype="<i4")
    at = np.arange(len(data) + 1, dtype=np.int32) * (4 * data.shape[1])
    return pa.Array.from_buffers(pa.binary(), len(data), [None, pa.py_buffer(at), pa.py_buffer(data)])


def _dealt(members: DataFrame) -> DataFrame:
    return members.repartition("position", "entry", "salt")


def _seeds(kept: DataFrame, entries: int, length: int) -> np.ndarray:
    """The codebooks to begin with: the parts of the vectors of the smallest ids; of rows that share an id, the least vector."""
    ids = kept.select("vec_id").distinct().orderBy(F.col("vec_id").asc_nulls_last()).limit(entries)
    own = join_groups(kept.select("vec_id", "vector"), ids, "vec_id", small=True).groupBy("vec_id").agg(F.min("vector").alias("vector"))
    rows = sorted(own.collect(), key=lambda row: (row.vec_id is None, row.vec_id))
    vectors = _padded([bytes(row.vector) for row in rows], length).astype(np.int64)
    return vectors.reshape(len(rows), PARTS, -1).transpose(1, 0, 2).copy()


def _first_members(kept: DataFrame, books: np.ndarray, salts: int) -> DataFrame:
    sent = kept.sparkSession.sparkContext.broadcast(books)
    width = books.shape[2]

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, 1024):
                part = batch.slice(first, 1024)
                vectors = _padded(part.column(1).to_pylist(), PARTS * width).reshape(-1, width)
                positions = np.tile(np.arange(PARTS, dtype=np.int32), part.num_rows)
                entry, _ = _nearest(vectors, positions, sent.value)
                rows = np.repeat(part.column(0).to_numpy(), PARTS)
                salt = (rows * 0x5851F42D4C957F2D >> 20) % salts
                yield pa.RecordBatch.from_arrays(
                    [pa.array(positions), pa.array(entry), pa.array(salt), pa.array(rows), _cells(vectors)],
                    ["position", "entry", "salt", "row", "part"],
                )

    return kept.select("row", "vector").mapInArrow(made, _MEMBERS)


def _updated(members: DataFrame, books: np.ndarray) -> np.ndarray:
    """Each entry replaced by the floor of its members' mean; an entry without members stays."""
    positions, entries, width = books.shape

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((positions * entries, width + 1), np.int64)
        for batch in batches:
            cell = batch.column(0).to_numpy().astype(np.int64) * entries + batch.column(1).to_numpy()
            parts = _numbers(batch.column(2), width)
            for component in range(width):
                # sums of one batch are whole numbers below 2^53
                sums[:, component] += np.bincount(cell, parts[:, component], len(sums)).astype(np.int64)
            sums[:, width] += np.bincount(cell, minlength=len(sums))
        owned = np.flatnonzero(sums[:, width])
        yield pa.RecordBatch.from_arrays([pa.array(owned), pa.array(sums[owned].tolist(), pa.list_(pa.int64()))], ["cell", "sums"])

    own = members.select("position", "entry", "part").mapInArrow(made, "cell long, sums array<bigint>")
    listed = own.select("cell", F.posexplode("sums").alias("place", "value")).groupBy("cell", "place").agg(F.sum("value").alias("value"))
    table = np.zeros((positions * entries, width + 1), np.int64)
    for cell, place, value in listed.collect():  # at most entries times components, and the counts
        table[cell, place] = value
    counts = table[:, width].reshape(positions, entries, 1)
    means = table[:, :width].reshape(books.shape) // np.maximum(counts, 1)
    return np.where(counts > 0, means, books)


def _migrated(members: DataFrame, books: np.ndarray) -> tuple[DataFrame, int]:
    """(members under the new codebooks, how many migrated): those that keep their entry are read where they lie."""
    spark = members.sparkSession
    sent = spark.sparkContext.broadcast(books)

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            entry, _ = _nearest(_numbers(batch.column(4), books.shape[2]), batch.column(0).to_numpy(), sent.value)
            moved = entry != batch.column(1).to_numpy()
            columns = [batch.column(0), pa.array(entry), *batch.columns[2:], pa.array(moved)]
            yield pa.RecordBatch.from_arrays(columns, ["position", "entry", "salt", "row", "part", "moved"])

    folder = fresh_folder(spark, "resident-members")
    schema = f"{_MEMBERS}, moved boolean"
    members.mapInArrow(made, schema).write.partitionBy("moved").parquet(folder)
    read = spark.read.schema(schema).parquet(folder)
    arrived = stored(_dealt(read.filter("moved").drop("moved")), "migrated-members")
    return read.filter("not moved").drop("moved").unionByName(arrived), arrived.count()


def _coded(members: DataFrame, books: np.ndarray) -> DataFrame:
    """row, high, low and error of each vector."""
    sent = members.sparkSession.sparkContext.broadcast(books)

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            positions = batch.column(0).to_numpy()
            entry, error = _nearest(_numbers(batch.column(2), books.shape[2]), positions, sent.value)
            byte = entry.astype(np.int64) << (8 * (7 - positions.astype(np.int64) % 8))
            high, low = np.where(positions < 8, byte, 0), np.where(positions < 8, 0, byte)
            yield pa.RecordBatch.from_arrays([batch.column(1), *map(pa.array, (high, low, error))], ["row", "high", "low", "error"])

    placed = members.select("position", "row", "part").mapInArrow(made, "row long, high long, low long, error long")
    return placed.groupBy("row").agg(F.bit_or("high").alias("high"), F.bit_or("low").alias("low"), F.sum("error").alias("error"))


def fit_codes(embeddings: DataFrame, entries: int = ENTRIES, rounds: int = ROUNDS, salt_rows: int = SALT_ROWS) -> Codes | None:
    """Codes of ``embeddings`` (vec_id, label, embedding: an array of numbers); None where no row is kept.

    Rows whose vector is null or holds null or non-finite components are dropped. Components become floor(256 x), at
    most 2^26 either way. Shorter vectors, and sizes that 16 does not divide, count as padded with zeros. The codebooks begin with the
    vectors of the ``entries`` (256 at most) smallest ids, all of them where there are fewer; a null id is the last.
    Rows that share an id are coded each. Other columns are ignored.
    """
    if not 1 <= entries <= 256:
        raise ValueError("entries must be 1 to 256, a code's byte")
    kept = stored(whole_vectors(embeddings), "whole-vectors")
    rows, size = kept.agg(F.count("*"), F.max("size")).first()
    if not rows:
        return None
    books = _seeds(kept, entries, PARTS * max(1, -(-size // PARTS)))
    members = stored(_dealt(_first_members(kept, books, max(1, rows // salt_rows))), "members")
    migrated = []
    for turn in range(rounds):
        books = _updated(members, books)
        if turn < rounds - 1:
            members, moved = _migrated(members, books)
            migrated.append(moved)
    coded = _coded(members, books).join(kept.select("row", "vec_id", "label"), "row")
    return Codes(coded.select("row", "vec_id", "label", "high", "low", "error"), books, tuple(migrated))


def with_label_errors(coded: DataFrame) -> DataFrame:
    """A stored table of ``coded`` with ``label_error``, the sum of error over equal labels, null equal to null."""
    totals = coded.groupBy("label").agg(F.sum("error").alias("label_error"), F.count("*").alias("held"))
    rows = coded.count()
    hot = totals.filter(F.col("held") * HOT_SHARE > rows).drop("held")
    rest = totals.filter(F.col("held") * HOT_SHARE <= rows).drop("held")
    often = join_groups(coded, hot, "label", small=True)
    seldom = join_groups(join_groups(coded, hot, "label", small=True, how="left_anti"), rest, "label")
    return often.unionByName(seldom)


def compress(embeddings: DataFrame) -> DataFrame:
    """The digest: vec_id, code, error, label_error and codebooks_sha256 of every kept row; no rows of an empty table."""
    codes = fit_codes(embeddings)
    if codes is None:
        ident = embeddings.schema["vec_id"].dataType.simpleString()
        return embeddings.sparkSession.createDataFrame([], f"vec_id {ident}, code string, error long, label_error long, codebooks_sha256 string")
    summed = with_label_errors(stored(codes.rows, "vector-codes"))
    code = F.lower(F.concat(F.lpad(F.hex("high"), 16, "0"), F.lpad(F.hex("low"), 16, "0")))
    return summed.select("vec_id", code.alias("code"), "error", "label_error", F.lit(codes.sha256).alias("codebooks_sha256"))


def _round(number: int) -> str:
    """SQL of one assignment and the codebooks after it."""
    return f"""
a{number} AS (
  SELECT r.vec_id, r.p, any_value(r.v) AS v, arg_min(c.e, list_sum(list_transform(list_zip(r.v, c.v), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) * 64 + c.e) AS e
  FROM parts r JOIN c{number} c USING (p) GROUP BY r.vec_id, r.p
),
m{number} AS (
  SELECT p, e, list(CAST(floor(s / n) AS BIGINT) ORDER BY i) AS v FROM (
    SELECT p, e, i, sum(v[i]) AS s, count(*) AS n FROM a{number}, steps GROUP BY 1, 2, 3
  ) GROUP BY 1, 2
),
c{number + 1} AS (SELECT c.p, c.e, coalesce(m.v, c.v) AS v FROM c{number} c LEFT JOIN m{number} m USING (p, e)),"""


SQL = f"""
WITH kept AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
width AS (SELECT max(len(v)) // 16 AS w FROM kept),
steps AS (SELECT unnest(range(1, w + 1)) AS i FROM width),
parts AS (SELECT vec_id, CAST(p AS INTEGER) AS p, v[p * w + 1:p * w + w] AS v FROM kept, width, range(16) r(p)),
seeds AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS e FROM kept QUALIFY e < 64),
c0 AS (SELECT p, e, v FROM parts JOIN seeds USING (vec_id)),{_round(0)}{_round(1)}
final AS (
  SELECT r.vec_id, r.p, list_sum(list_transform(list_zip(r.v, c.v), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS d, c.e
  FROM parts r JOIN c2 c USING (p)
),
best AS (SELECT vec_id, p, min(d) AS d, arg_min(e, d * 64 + e) AS e FROM final GROUP BY 1, 2),
coded AS (
  SELECT vec_id, string_agg(lpad(lower(hex(e)), 2, '0'), '' ORDER BY p) AS code, sum(d) AS error FROM best GROUP BY 1
),
book AS (
  SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM c2
)
SELECT vec_id, code, CAST(error AS BIGINT) AS error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256
FROM coded JOIN kept USING (vec_id), book
"""
