"""Term weights."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postweave.operators.joins import dealt_join, join_groups
from postweave.operators.scalars import attach


def tf_idf(counts: DataFrame, term: str, doc: str, n: str, few_docs: bool = False) -> DataFrame:
    """Add tf (share of the document), idf (ln of documents over documents with the term), tf_idf.

    ``counts`` has one row per document and term; a missing document or term counts as one. ``few_docs`` broadcasts the documents' totals. The
    rows of a document with many terms, and those of a term in many documents, are dealt over several tasks.
    """
    totals = counts.groupBy(doc).agg(F.sum(n).alias("_total"), F.count(F.lit(1)).alias("_rows"))
    documents = totals.agg(F.count(F.lit(1)).alias("_documents"))
    holders = counts.groupBy(term).agg(F.count(F.lit(1)).alias("_holders"))
    sized = totals.drop("_rows")
    whole = join_groups(counts, sized, doc, True) if few_docs else dealt_join(counts, sized, totals, doc, [term])
    joined = dealt_join(whole, holders, holders.withColumnRenamed("_holders", "_rows"), term, [doc])
    weighed = attach(joined, documents).withColumns(
        {"tf": F.col(n) / F.col("_total"), "idf": F.ln(F.col("_documents") / F.col("_holders"))}
    )
    return weighed.select(*counts.columns, "tf", "idf", (F.col("tf") * F.col("idf")).alias("tf_idf"))


def two_way_tf_idf(tokens: DataFrame, term: str, doc: str, first: str, second: str) -> DataFrame:
    """``tf_idf`` of token rows that fall into at most two documents, named ``first`` and ``second``.

    Both counts of a term sit in one row, so its document frequency needs no join: the tokens are
    shuffled once, after map-side counting.
    """
    counts = tokens.groupBy(term).agg(
        F.count_if(F.col(doc) == first).alias("_first"), F.count_if(F.col(doc) == second).alias("_second")
    )
    totals = counts.agg(F.sum("_first").alias("_firsts"), F.sum("_second").alias("_seconds"))
    documents = (F.col("_firsts") > 0).cast("int") + (F.col("_seconds") > 0).cast("int")
    holders = (F.col("_first") > 0).cast("int") + (F.col("_second") > 0).cast("int")
    sides = F.array(
        F.struct(F.lit(first).alias(doc), F.col("_first").alias("n"), F.col("_firsts").alias("_total")),
        F.struct(F.lit(second).alias(doc), F.col("_second").alias("n"), F.col("_seconds").alias("_total")),
    )
    idf = F.ln(F.try_divide(documents, holders)).alias("idf")
    rows = attach(counts, totals).select(term, idf, F.inline(sides)).filter(F.col("n") > 0)
    weighed = rows.withColumn("tf", F.col("n") / F.col("_total"))
    return weighed.select(doc, term, "n", "tf", "idf", (F.col("tf") * F.col("idf")).alias("tf_idf"))
