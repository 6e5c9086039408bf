"""How filters interact: for every order of five filters, what each removes, and what another had removed before it.

A document is one row. Its failed conditions are a set of bits:

A: under 50 words. B: under 65 different words in 100. C: more than 5 in 100 characters are A to Z. D: one of ``#$%&*|``
occurs. E: the text is identical to that of a smaller doc_id, anywhere in the table, whether removed or not.

E is an existential self-join: a row fails when the left-semi join on the text's hash, the text itself and a smaller
doc_id finds another. Only texts whose hash occurs under several ids take part, and the side that is searched holds each of
them once, with its smallest id. A hash with more than a thousandth of all rows is dealt over several tasks, its one
searched row repeated for each. The ids so found are united with the other failures, and the combinations of bits are
counted per part; orders, steps and Shapley sums follow from these counts, at most 32 per part.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postweave.llm.stored import stored

FILTERS = "ABCDE"
HOT_SHARE = 1000  # a hash with over 1/1000 of the rows is hot: there are fewer than 1000 of them
BROADCAST_HASHES = 500_000
_KEY = ["hash", "hash2"]


def _text():
    return F.coalesce(F.col("text"), F.lit(""))


def _hashes() -> list:
    return [F.xxhash64(_text()).alias("hash"), F.xxhash64(F.lit(1), _text()).alias("hash2")]


def own_failures(docs: DataFrame) -> DataFrame:
    """doc_id, part, hash, hash2 and ``bits``: A to D as 1, 2, 4 and 8."""
    # pieces between spaces: only the first and the last can be empty
    cut = docs.select(
        "doc_id",
        F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"),
        _text().alias("text"),
        F.split(_text(), r"[\x20\x09-\x0D]+").alias("pieces"),
    )
    first_bare, last_bare = F.expr("(pieces[0] = '')"), F.expr("(pieces[size(pieces) - 1] = '')")
    counted = cut.select(
        "doc_id",
        "part",
        "text",
        (F.size("pieces") - first_bare.cast("int") - (last_bare & (F.size("pieces") > 1)).cast("int")).alias("words"),
        (F.size(F.array_distinct("pieces")) - (first_bare | last_bare).cast("int")).alias("different"),
    )
    capitals = F.octet_length("text") - F.octet_length(F.regexp_replace("text", "[A-Z]+", ""))
    failed = [
        F.col("words") < 50,
        F.col("different").cast("long") * 100 < F.col("words").cast("long") * 65,
        capitals.cast("long") * 100 > F.length("text").cast("long") * 5,
        F.col("text").rlike("[#$%&*|]"),
    ]
    bits = sum((condition.cast("int") * (1 << place) for place, condition in enumerate(failed)), F.lit(0))
    return counted.select("doc_id", "part", *_hashes(), bits.alias("bits"))


def later_copies(docs: DataFrame, failures: DataFrame) -> DataFrame:
    """doc_id, part, hash and hash2 of the rows whose text a smaller doc_id has; ``failures`` is their stored table."""
    rows = failures.count()
    several = failures.groupBy(*_KEY).agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"), F.count("*").alias("held"))
    several = stored(several.filter("low < high").select(*_KEY, "held"), "repeated-hashes")
    few = several.count() <= BROADCAST_HASHES
    deals = F.expr(f"cast(ceil(held * {HOT_SHARE} / {max(rows, 1)}) as int)")
    hot = several.filter(F.col("held") * HOT_SHARE > rows).select(*_KEY, deals.alias("deals"))

    texts = docs.select("doc_id", F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"), _text().alias("text"), *_hashes())
    texts = texts.filter("doc_id is not null").join(F.broadcast(several) if few else several, _KEY, "left_semi")
    dealt = texts.join(F.broadcast(hot), _KEY, "left").withColumn("deal", F.expr("pmod(xxhash64(doc_id), coalesce(deals, 1))"))
    firsts = texts.groupBy(*_KEY, "text").agg(F.min("doc_id").alias("least")).join(F.broadcast(hot), _KEY, "left")
    firsts = firsts.withColumn("deal", F.explode(F.expr("sequence(0L, cast(coalesce(deals, 1) - 1 as bigint))")))
    left, right = dealt.alias("l"), firsts.alias("r")
    same = [F.col(f"l.{name}") == F.col(f"r.{name}") for name in (*_KEY, "deal", "text")]
    smaller = F.col("r.least") < F.col("l.doc_id")
    return left.join(right, [*same, smaller], "left_semi").select("doc_id", "part", *_KEY)


def combinations(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, bits, documents, good, toxic: how many rows fail exactly these conditions, and their labels' counts."""
    failures = stored(own_failures(docs), "failures")
    copies = later_copies(docs, failures).select("*", F.lit(16).alias("bits"), F.lit(0).alias("one"))
    # rows that share id, part and text are one group with as many rows
    united = failures.select("doc_id", "part", *_KEY, "bits", F.lit(1).alias("one")).unionByName(copies)
    combined = united.groupBy("doc_id", "part", *_KEY).agg(F.bit_or("bits").alias("bits"), F.sum("one").alias("documents"))
    combined = stored(combined.select("doc_id", "part", "bits", "documents"), "combinations")

    none = F.lit(0).cast("long")
    counted = combined.groupBy("part", "bits").agg(F.sum("documents").alias("documents"))
    marks = labels.select("doc_id", "quality", "toxic").groupBy("doc_id")
    marks = marks.agg(*[F.max((F.col(name) == 1).cast("int")).alias(out) for name, out in (("quality", "good"), ("toxic", "toxic"))])
    marked = combined.groupBy("doc_id", "part", "bits").agg(F.sum("documents").alias("documents")).join(marks, "doc_id")
    marked = marked.groupBy("part", "bits").agg(
        *[F.sum(F.col("documents") * F.coalesce(name, F.lit(0))).alias(name) for name in ("good", "toxic")]
    )
    both = counted.select("*", none.alias("good"), none.alias("toxic")).unionByName(marked.select("*", none.alias("documents")))
    return both.groupBy("part", "bits").agg(*[F.sum(name).alias(name) for name in ("documents", "good", "toxic")])


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """A row per part, filter_order and step: kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley.

    ``part`` is the source, null as the empty string. Counts are of rows: repeated rows count each, and as a document of
    one doc_id is no copy of itself, rows that share id and text do not fail E for that. A null text is empty, a text without
    words passes B. Rows with a null doc_id fail E never and make no other fail it, and have no label. A document with
    several labels is good, or toxic, if one of them says so. An empty table gives no rows; other columns are ignored.
    """
    orders = " ".join(map("".join, permutations(FILTERS)))
    bit = [f"if(instr(left(filter_order, step - 1), '{f}') > 0, {1 << place}, 0)" for place, f in enumerate(FILTERS)]
    counted = combinations(docs, labels)
    placed = counted.withColumn("filter_order", F.explode(F.split(F.lit(orders), " ")))
    placed = placed.withColumn("step", F.explode(F.expr("sequence(1, 5)")))
    own = F.expr(f"shiftleft(1, instr('{FILTERS}', substring(filter_order, step, 1)) - 1)")
    placed = placed.withColumns({"own": own, "before": F.expr(" + ".join(bit))})
    fails, earlier = "(bits & own) <> 0", "(bits & before) <> 0"
    here = f"{fails} AND NOT {earlier}"

    def total(condition: str, counts: str = "documents"):
        return F.sum(F.expr(f"if({condition}, {counts}, 0L)"))

    return placed.groupBy("part", "filter_order", "step").agg(
        total(f"NOT {fails} AND NOT {earlier}").alias("kept"),
        total(here).alias("removed"),
        total(f"{fails} AND {earlier}").alias("redundant"),
        total("bits = own").alias("unique_fails"),
        total(here, "good").alias("good_lost"),
        total(here, "toxic").alias("toxic_lost"),
        # of the orders, each failing filter comes first equally often
        total(fails, "documents * (120 div bit_count(bits))").alias("shapley"),
    )


SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text FROM documents
),
w AS (
  SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words, min(doc_id) OVER (PARTITION BY text) AS least FROM d
),
f AS (
  SELECT doc_id, part,
         CASE WHEN len(words) < 50 THEN 1 ELSE 0 END
         + CASE WHEN 100 * len(list_distinct(words)) < 65 * len(words) THEN 2 ELSE 0 END
         + CASE WHEN 100 * len(regexp_replace(text, '[^A-Z]', '', 'g')) > 5 * length(text) THEN 4 ELSE 0 END
         + CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 8 ELSE 0 END
         + CASE WHEN least < doc_id THEN 16 ELSE 0 END AS bits
  FROM w
),
l AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY 1),
c AS (
  SELECT part, bits, count(*) AS n, coalesce(sum(good), 0) AS good, coalesce(sum(toxic), 0) AS toxic
  FROM f LEFT JOIN l USING (doc_id) GROUP BY 1, 2
),
letters AS (SELECT * FROM (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)) v(letter, bit)),
orders AS (
  SELECT v.letter || w.letter || x.letter || y.letter || z.letter AS filter_order, [v.bit, w.bit, x.bit, y.bit, z.bit] AS bits
  FROM letters v, letters w, letters x, letters y, letters z
  WHERE v.bit + w.bit + x.bit + y.bit + z.bit = 31 AND len(list_distinct([v.bit, w.bit, x.bit, y.bit, z.bit])) = 5
),
steps AS (
  SELECT filter_order, CAST(s AS INTEGER) AS step, bits[s] AS own, CAST(coalesce(list_sum(bits[1:s - 1]), 0) AS INTEGER) AS before
  FROM orders, range(1, 6) r(s)
),
cases AS (
  SELECT *, (bits & own) <> 0 AS fails, (bits & before) <> 0 AS gone FROM c, steps
),
removed AS (
  SELECT part, own, sum(CASE WHEN fails AND NOT gone THEN n ELSE 0 END) AS shapley FROM cases GROUP BY 1, 2
)
SELECT part, filter_order, step,
       CAST(sum(CASE WHEN NOT fails AND NOT gone THEN n ELSE 0 END) AS BIGINT) AS kept,
       CAST(sum(CASE WHEN fails AND NOT gone THEN n ELSE 0 END) AS BIGINT) AS removed,
       CAST(sum(CASE WHEN fails AND gone THEN n ELSE 0 END) AS BIGINT) AS redundant,
       CAST(sum(CASE WHEN bits = own THEN n ELSE 0 END) AS BIGINT) AS unique_fails,
       CAST(sum(CASE WHEN fails AND NOT gone THEN good ELSE 0 END) AS BIGINT) AS good_lost,
       CAST(sum(CASE WHEN fails AND NOT gone THEN toxic ELSE 0 END) AS BIGINT) AS toxic_lost,
       CAST(any_value(shapley) AS BIGINT) AS shapley
FROM cases JOIN removed USING (part, own) GROUP BY 1, 2, 3
"""
