"""Line deduplication by a log-template tree of fixed depth.

A line's path in the tree is its number of tokens, then its ``LEADING`` first tokens; tokens that hold a digit count as the
variable ``<*>`` everywhere. In a leaf, lines that agree but for at most a fifth of their tokens share a template. A
line's tokens are cut into up to ten segments, and its templates are the line with one or two segments left open as
long as they hold no more than that fifth: lines that differ only within such segments have a template in common.

A template recurs when lines of two documents have it. A line with a recurring template is dropped, except in the document
with the smallest doc_id that has the template. All of it is grouping: no leaf is gathered in one task, and only
lines in leaves with lines of several documents go further. DataFrame operations only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postweave.llm.stored import stored

LEADING = 3
MIN_TOKENS = 3
SEGMENTS = 10
SIMILARITY = 0.8


def _lines(docs: DataFrame) -> DataFrame:
    """One row per line of MIN_TOKENS or more: doc_id, sig, line, tokens' number, leaf, exact and segment hashes."""
    own = docs.filter("doc_id is not null").select("doc_id", F.hash("text").alias("sig"), F.posexplode(F.split("text", "\n")).alias("line", "value"))
    tokens = "filter(split(value, '[\\\\x20\\\\x09-\\\\x0D]+'), t -> t <> '')"
    masked = f"if(value rlike '[0-9]', transform({tokens}, t -> if(t rlike '[0-9]', '<*>', t)), {tokens})"
    split = own.select("doc_id", "sig", "line", F.expr(masked).alias("tokens")).withColumn("n", F.size("tokens")).filter(F.col("n") >= MIN_TOKENS)
    split = split.withColumn("parts", F.least("n", F.lit(SEGMENTS)))
    segment = "xxhash64(s, slice(tokens, s * n div parts + 1, (s + 1) * n div parts - s * n div parts))"
    return split.select(
        "doc_id",
        "sig",
        "line",
        "n",
        F.expr(f"xxhash64(n, slice(tokens, 1, {LEADING}))").alias("leaf"),
        F.expr("xxhash64(n, tokens)").alias("exact"),
        F.expr(f"transform(sequence(0, cast(parts - 1 as int)), s -> {segment})").alias("segments"),
    )


def _templates(lines: DataFrame) -> DataFrame:
    """(exact, first, last, template) for each distinct line and each of its templates."""
    pairs = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in range(SEGMENTS) for j in range(i, SEGMENTS)])
    parts = F.size("segments")

    def length(s):
        return F.floor((s + 1) * F.col("n") / parts) - F.floor(s * F.col("n") / parts)

    whole = F.expr("aggregate(segments, 0L, (x, s) -> x ^ s)")
    made = lines.withColumn("whole", whole).withColumn("pair", F.explode(pairs)).select("*", "pair.i", "pair.j").filter(F.col("j") < parts)
    open_tokens = length(F.col("i")) + F.when(F.col("i") == F.col("j"), 0).otherwise(length(F.col("j")))
    made = made.filter(open_tokens <= F.floor(F.col("n") * (1 - SIMILARITY) + 1e-9))
    rest = F.expr("whole ^ segments[i] ^ if(i = j, 0L, segments[j])")
    return made.select("exact", "first", "last", F.xxhash64("leaf", "i", "j", rest).alias("template"))


def dropped_lines(docs: DataFrame) -> DataFrame:
    """(doc_id, sig, line): the lines to drop, by their place in the text. ``sig`` is a hash of the text."""
    lines = stored(_lines(docs), "lines")
    leaves = lines.groupBy("leaf").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"))
    shared = lines.join(leaves.filter("first < last").select("leaf"), "leaf", "left_semi")
    # the leaf is left out of the grouping, so that no step above the join needs a leaf's rows together and Spark can
    # split a large leaf; equal lines meet before they are shuffled again
    grouped = shared.groupBy("exact", "n", "segments")
    distinct = stored(
        grouped.agg(F.min("leaf").alias("leaf"), F.min("doc_id").alias("first"), F.max("doc_id").alias("last")), "distinct-lines"
    )
    mixed = distinct.groupBy("leaf").agg(F.min("exact").alias("low"), F.max("exact").alias("high")).filter("low <> high")
    made = _templates(distinct.join(mixed.select("leaf"), "leaf", "left_semi"))
    recurring = made.groupBy("template").agg(F.min("first").alias("first"), F.max("last").alias("last")).filter("first < last")
    by_template = made.select("exact", "template").join(recurring.select("template", "first"), "template").select("exact", "first")
    by_line = distinct.filter("first < last").select("exact", "first").unionByName(by_template)
    firsts = by_line.groupBy("exact").agg(F.min("first").alias("first"))
    return lines.select("doc_id", "sig", "line", "exact").join(firsts, "exact").filter("doc_id > first").select("doc_id", "sig", "line")


def drop_templates(docs: DataFrame) -> DataFrame:
    """``docs`` with ``text`` freed of recurring lines, and two more columns, n_lines and n_dropped.

    Lines end at \\n; the kept ones are joined by it again. Lines of fewer than MIN_TOKENS tokens stay. A text of which
    every line goes becomes empty; a null text stays null, with no lines. Rows with a null doc_id lose nothing and make
    nothing recur; rows that share a doc_id are one document. An empty table gives no rows. Columns n_lines and
    n_dropped of ``docs`` are replaced.
    """
    gone = dropped_lines(docs).groupBy("doc_id", "sig").agg(F.collect_set("line").alias("gone lines"))
    gone = gone.select(F.col("doc_id").alias("gone id"), F.col("sig").alias("gone sig"), "gone lines")
    others = [column for column in docs.columns if column not in ("text", "n_lines", "n_dropped")]
    same = (F.col("doc_id") == F.col("gone id")) & (F.hash("text") == F.col("gone sig"))
    lines = F.split("text", "\n")
    every = F.sequence(F.lit(0), F.size(lines) - 1)
    kept = F.transform(F.array_except(every, F.col("gone lines")), lambda i: F.get(F.col("all lines"), i))
    joined = docs.join(gone, same, "left").withColumn("all lines", lines)
    text = F.when(F.col("gone lines").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n"))
    return joined.select(
        *others,
        text.alias("text"),
        F.coalesce(F.size("all lines"), F.lit(0)).alias("n_lines"),
        F.coalesce(F.size("gone lines"), F.lit(0)).alias("n_dropped"),
    )


def line_digest(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_lines, n_dropped and the text that is left."""
    return drop_templates(docs.select("doc_id", "text")).select("doc_id", "n_lines", "n_dropped", "text")


def keep_first_lines(docs: DataFrame) -> DataFrame:
    """``docs`` with recurring lines dropped from ``text``; where there is an ``n_chars``, it is counted anew."""
    made = drop_templates(docs)
    if "n_chars" in docs.columns:
        made = made.withColumn("n_chars", F.when(F.col("n_dropped") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return made.select(*docs.columns)
