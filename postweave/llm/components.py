"""Connected components of a table of links, labelled by their smallest node."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postweave.llm.stored import stored


def connected(links: DataFrame, name: str = "components") -> DataFrame:
    """``links`` (columns a and b, one type that orders) to (node, component) for all nodes that have a link.

    Alternates two steps until the links no longer change: each node's larger neighbours are linked to the smallest
    node around it, then its smaller ones. Links end as stars around each component's smallest node; they never
    grow in number. Each round is written to the shared folder, so neither lineage nor the driver grows.
    Links of a node with itself, or with a null end, count for nothing.
    """
    links = links.select("a", "b").filter("a <> b").distinct()
    links = stored(links, name)
    before = None
    while True:
        links = stored(_small_star(_large_star(links)), name)
        after = tuple(links.agg(F.count("*"), F.expr("coalesce(bit_xor(xxhash64(a, b)), 0)")).first())
        if after == before or not after[0]:
            break
        before = after
    roots = links.select(F.col("b").alias("component")).distinct()
    return links.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
        roots.select(F.col("component").alias("node"), "component")
    )


def _large_star(links: DataFrame) -> DataFrame:
    """Links (a, b), b the smaller end: every node's larger neighbours point to the smallest of it and its neighbours."""
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(links: DataFrame) -> DataFrame:
    """Every node and its smaller neighbours point to the smallest of them."""
    down = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct()
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = down.join(least, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.select("a", F.col("m").alias("b"))).filter("a <> b").distinct()
