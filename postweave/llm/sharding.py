"""Proportional stratified interleaving: shards that all hold the mixture of sources.

Rows are shuffled by a seeded hash within each source; the row of rank r among a source's n rows gets the fractional
rank (r - 1/2) / n. Sorted by it, every stretch of the result holds all sources in proportion, so cutting the order
into equal runs gives shards of equal row counts (at most one apart) with the mixture of the whole.

No source is ranked in one task: rows fall into bins of the hash, counts per source and bin are summed first, and a
row's rank is the count of earlier bins plus its place within its own. The fractional ranks are ranked likewise.
Both kinds of bins are uniform whatever the sources' sizes are. DataFrame operations only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SHARDS = 16
BINS = 1024


def interleave(docs: DataFrame, shards: int = SHARDS, seed: str = "0", source: str = "source") -> DataFrame:
    """One row per document: doc_id, size, text_crc32, source, fraction, shard, slot.

    ``size`` is the UTF-8 length of the text plus 1, ``text_crc32`` unsigned; a null text counts as empty. Null sources
    are a source of their own. Rows with equal doc_id are ordered by text checksum and size; full repeats are
    interchangeable. ``slot`` counts from 0 within the shard. An empty table gives no rows; other columns are ignored.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    key = F.md5(F.concat(F.lit(seed + ":"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))))
    rows = docs.select(
        "doc_id",
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.concat(F.lit("s"), F.col(source).cast("string")).alias("stratum"),
        F.substring(key, 1, 16).alias("shuffled"),
    ).withColumn("stratum", F.coalesce("stratum", F.lit("none")))
    rows = rows.withColumn("bin", F.pmod(F.conv(F.substring("shuffled", 1, 4), 16, 10).cast("int"), F.lit(BINS)))
    rows = rows.withColumn("bin_order", F.substring("shuffled", 5, 12))

    ties = ["bin_order", "shuffled", "doc_id", "text_crc32", "size"]
    counts = rows.groupBy("stratum", "bin").agg(F.count("*").alias("here"))
    by_bin = Window.partitionBy("stratum").orderBy("bin")
    counts = counts.withColumns(
        {
            "before": F.sum("here").over(by_bin.rowsBetween(Window.unboundedPreceding, 0)) - F.col("here"),
            "in_stratum": F.sum("here").over(Window.partitionBy("stratum")),
        }
    ).drop("here")
    within = F.row_number().over(Window.partitionBy("stratum", "bin").orderBy(*ties))
    ranked = rows.withColumn("within", within).join(counts, ["stratum", "bin"])
    fraction = (F.col("before") + F.col("within") - 0.5) / F.col("in_stratum")
    ranked = ranked.withColumn("fraction", fraction).drop("before", "within", "in_stratum", "bin")

    sliced = ranked.withColumn("slice", F.least(F.floor(F.col("fraction") * BINS), F.lit(BINS - 1)).cast("int"))
    slices = sliced.groupBy("slice").agg(F.count("*").alias("here"))
    slices = slices.withColumns(
        {
            "before": F.sum("here").over(Window.orderBy("slice").rowsBetween(Window.unboundedPreceding, 0)) - F.col("here"),
            "rows": F.sum("here").over(Window.partitionBy()),
        }
    ).drop("here")
    place = F.row_number().over(Window.partitionBy("slice").orderBy("fraction", "stratum", *ties)) - 1
    placed = sliced.withColumn("place", place).join(F.broadcast(slices), "slice")
    placed = placed.withColumn("position", F.col("before") + F.col("place"))
    shard = F.expr(f"position * {shards} div rows")
    return placed.withColumn("shard", shard.cast("int")).select(
        "doc_id",
        "size",
        "text_crc32",
        F.when(F.col("stratum") != "none", F.expr("substring(stratum, 2)")).alias("source"),
        "fraction",
        "shard",
        # a shard's first position is the least p with p * shards >= shard * rows
        (F.col("position") - F.expr(f"(shard * rows + {shards - 1}) div {shards}")).cast("long").alias("slot"),
    )


def shard_rows(docs: DataFrame) -> DataFrame:
    """The shard digest: doc_id, size, text_crc32, law ("rows"), shard, slot and grown_shard (null under this law)."""
    return interleave(docs).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


SQL = """
WITH RECURSIVE steps(i, k, c) AS (
  SELECT i, 0, i FROM range(256) r(i)
  UNION ALL
  SELECT i, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM steps WHERE k < 8
),
crc AS (SELECT list(c ORDER BY i) AS t FROM steps WHERE k = 8),
made AS (
  SELECT doc_id, strlen(coalesce(text, '')) + 1 AS size, hex(encode(coalesce(text, ''))) AS bytes,
         coalesce('s' || source, 'none') AS stratum,
         substr(md5('0:' || coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 16) AS shuffled
  FROM documents
),
summed AS (
  SELECT doc_id, size, stratum, shuffled,
         xor(list_reduce(
           list_prepend(4294967295::BIGINT, list_transform(range(1, 2 * (size - 1), 2), lambda p: ('0x' || substr(bytes, p, 2))::BIGINT)),
           lambda c, b: xor(t[(xor(c, b) & 255) + 1], c >> 8)), 4294967295) AS text_crc32
  FROM made, crc
),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY ('0x' || substr(shuffled, 1, 4))::INT % 1024,
            substr(shuffled, 5), shuffled, doc_id, text_crc32, size) AS r,
         count(*) OVER (PARTITION BY stratum) AS n
  FROM summed
),
placed AS (
  SELECT *, row_number() OVER (ORDER BY (r - 0.5::DOUBLE) / n, stratum, substr(shuffled, 5), shuffled, doc_id, text_crc32, size) - 1 AS p,
         count(*) OVER () AS rows
  FROM ranked
)
SELECT doc_id, size, text_crc32, 'rows' AS law, CAST(p * 16 // rows AS INTEGER) AS shard,
       p - (p * 16 // rows * rows + 15) // 16 AS slot, CAST(NULL AS INTEGER) AS grown_shard
FROM placed
"""
