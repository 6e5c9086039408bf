"""Topic models over (document, term, n) counts.

The model is latent Dirichlet allocation, fitted by expectation maximisation of the posterior mode
(Asuncion, Welling, Smyth, Teh: "On smoothing and inference for topic models", 2009). Spark ML's LDA
needs each document as one vector and holds a matrix of the whole vocabulary on the driver. Here a
document is a time bucket, which may hold a third of all posts, and the vocabulary is every n-gram;
so the fit stays on the count rows. These are shuffled by term once, into blocks of a bucketed table that is
never written again; the rows and what was shuffled go once the blocks are stored. What an iteration carries on is not how each
cell is divided but the sums per term and per time bucket that the division follows from. The sums per term lie in blocks of
the same buckets, joined to the cells where they lie; each block's sums per time bucket are added up in a shuffle, come to the
driver and are broadcast. Where these are too many, cells stay rows and the sums per time bucket are joined to them.
"""

from __future__ import annotations

import functools
import operator
from collections.abc import Iterator, Sequence
from contextlib import contextmanager
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from postweave.operators import topic_blocks
from postweave.operators.counts import count_by
from postweave.operators.lookup_joins import BROADCAST_BYTES
from postweave.operators.ranking import LISTED, top_n_by_group
from postweave.operators.scalars import attach
from postweave.params import at_least
from postweave.sources.storage import fresh_folder

BUCKET_ROWS = 1_000_000
# of tables whose values do not recur, and of those written once
PLAIN = {"parquet.enable.dictionary": "false"}
SMALL = {"compression": "zstd"}
SHUFFLES_GO = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def document_terms(tokens: DataFrame, document: str = "bucket", term: str = "ngram") -> DataFrame:
    """The document-term matrix as its non-zero cells: (document, term, n)."""
    return count_by(tokens, document, term)


@dataclass(frozen=True)
class TopicModel:
    """Expected counts in columns ``p0`` to ``p{k-1}``, per term and per document, and the priors.

    ``terms`` has one row per n-gram, ``documents`` one per bucket; both are stored tables below ``folder``, which
    ``drop`` removes. The fit took ``iterations``, the last of which moved the share ``moved`` of all counts
    (None without an iteration); ``converged`` says whether that was below the tolerance.
    """

    terms: DataFrame
    documents: DataFrame
    k: int
    vocabulary: int
    document_prior: float
    term_prior: float
    folder: str
    iterations: int
    moved: float | None
    converged: bool

    def drop(self) -> None:
        """Remove the stored tables; ``terms`` and ``documents`` cannot be read afterwards."""
        path = self.terms.sparkSession._jvm.org.apache.hadoop.fs.Path(self.folder)
        path.getFileSystem(self.terms.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def fit_topics(
    counts: DataFrame,
    k: int = 4,
    iterations: int = 100,
    seed: int = 0,
    tolerance: float = 1e-3,
    document_prior: float | None = None,
    term_prior: float = 0.1,
) -> TopicModel:
    """Fit ``k`` topics to (bucket, ngram, n) counts.

    The fit ends after ``iterations``, or when an iteration moves less than the share ``tolerance``
    of all counts from one topic to another within their buckets. The priors are what is added to
    each expected count (a Dirichlet parameter less one); ``document_prior`` is 50/k by default.

    The start is a hash of seed, bucket and n-gram, so a fit is repeatable whatever the
    partitioning. Each iteration's sums are written as tables to the shared folder, and those of the
    iteration before go then: a lost executor repeats one iteration at most. These tables are in a database
    of their own, dropped with its files at the end.
    """
    at_least("k", k, 2)
    at_least("iterations", iterations, 0)
    spark = counts.sparkSession
    home = fresh_folder(spark, "topics")
    prior = 50.0 / k if document_prior is None else document_prior

    with work_tables(spark, home) as stored:
        # the counts are stored first, so that their number can size the buckets
        counted = stored(counts.dropna(subset=["bucket", "ngram"]), "counts", **SMALL)
        rows, found = counted.count(), counted.select("bucket").distinct()
        if _few(found.count(), k):
            listed, held, vocabulary, taken, moved = _fit_blocks(stored, counted, rows, found, k, iterations, seed, tolerance, prior, term_prior)
        else:
            listed, held, vocabulary, taken, moved = _fit_rows(stored, counted, rows, k, iterations, seed, tolerance, prior, term_prior)
        terms = kept_table(listed, home, "terms")
        documents = kept_table(held, home, "documents")
    converged = moved is not None and moved < tolerance
    return TopicModel(terms, documents, k, vocabulary, prior, term_prior, home, taken, moved, converged)


def _fit_blocks(stored, counted, rows, found, k, iterations, seed, tolerance, prior, term_prior):
    """Sums per term and per bucket of a fit with few buckets: a pass over blocks of cells for each iteration.

    The numbers per bucket, which each task needs, come to the driver and are broadcast.
    """
    context = counted.sparkSession.sparkContext
    buckets = _bucket_number(rows * -(-k // 8), context.defaultParallelism)
    numbered = found.select("bucket", (F.row_number().over(Window.orderBy("bucket")) - 1).alias("document"))
    numbered = stored(numbered, "held_even")
    names = [row["bucket"] for row in numbered.orderBy("document").collect()]
    weights = topic_blocks.start_weights(names, seed, k)
    documents = context.broadcast((names, weights))
    # a matrix per document is broadcast too, where these are small enough
    apart = k <= 8 and len(names) * (k + 1) ** 2 * 8 <= BROADCAST_BYTES
    powers = np.tile(np.eye(k + 1), (len(names) if apart else 0, 1, 1))
    blocks = topic_blocks.make_blocks(counted.join(F.broadcast(numbered), "bucket"), buckets, documents, seed, k, apart)
    cells = stored(blocks, "cells", buckets, **PLAIN, **SMALL)
    stored.drop("counts")
    state = stored(topic_blocks.start(cells, documents, seed, k), "terms_even", buckets, **PLAIN)
    documents.destroy()
    vocabulary = cells.agg(F.sum(F.size("names"))).first()[0] or 0
    held = _held_numbers(state, k)
    hint = "shuffle_hash" if rows <= buckets * BUCKET_ROWS else "merge"
    taken, moved = 0, None
    for step in range(1, iterations + 1):
        numbers = (held + prior) / (held.sum(axis=0) + term_prior * vocabulary)
        powers = topic_blocks.carried(powers, numbers, term_prior) if apart else powers
        factors = context.broadcast((numbers, powers, weights))
        turn, last = ("odd", "even") if step % 2 else ("even", "odd")
        state = stored(_iterate(cells, state, factors, k, term_prior, hint), f"terms_{turn}", buckets, **PLAIN)
        stored.drop(f"terms_{last}")
        before, held = held, _held_numbers(state, k)
        factors.destroy()
        taken, moved = step, _moved(before, held, k)
        if moved < tolerance:
            break
    named = cells.join(state.select("ngram", "sums").hint(hint), "ngram")
    sums = numbered.join(topic_blocks.held_by_document(state, k), "document").select("bucket", *_columns(k))
    return topic_blocks.held_by_term(named, context.broadcast((held, powers, weights)), k), sums, vocabulary, taken, moved


def _held_numbers(state: DataFrame, k: int) -> np.ndarray:
    """The sums per bucket, a row each, in the order of their numbers."""
    table = topic_blocks.held_by_document(state, k).toArrow().sort_by("document")
    return np.stack([table.column(p).to_numpy() for p in _columns(k)], axis=1)


def _iterate(cells: DataFrame, state: DataFrame, factors, k: int, term_prior: float, hint: str = "shuffle_hash") -> DataFrame:
    """Divide the counts of each block anew, by its terms' and documents' sums; blocks and sums lie in the same buckets.

    They are joined by a hash of the bucket's sums, or with ``hint`` "merge" by sorting.
    """
    blocks = cells.select("ngram", "own", "place", "n", "cells", "drawn")
    return topic_blocks.step(blocks.join(state.select("ngram", "sums").hint(hint), "ngram"), factors, k, term_prior)


def _fit_rows(stored, counted, rows, k, iterations, seed, tolerance, prior, term_prior):
    """The same fit with any number of buckets, whose sums are joined to the cells."""
    buckets = _bucket_number(rows, counted.sparkSession.sparkContext.defaultParallelism)
    cells = stored(counted.repartition(buckets, "ngram"), "cells", buckets)
    stored.drop("counts")
    divided = _divided(cells, [_start_weight(seed, topic) for topic in range(k)])
    listed, held = stored(_sums(divided, "ngram", k), "terms_even", buckets), stored(_sums(divided, "bucket", k), "held_even")
    vocabulary = listed.count()
    hint = "shuffle_hash" if rows <= buckets * BUCKET_ROWS else "merge"
    taken, moved = 0, None
    for step in range(1, iterations + 1):
        turn = "odd" if step % 2 else "even"
        factors = _document_factors(held, k, prior, term_prior, vocabulary)
        divided = _iterate_rows(cells, listed, factors, k, term_prior, hint)
        listed = stored(_sums(divided, "ngram", k), f"terms_{turn}", buckets)
        before, held = held, stored(_sums(divided, "bucket", k), f"held_{turn}")
        taken, moved = step, _moved_rows(before, held, k)
        if moved < tolerance:
            break
    return listed, held, vocabulary, taken, moved


class WorkTables:
    """Stores tables of a database, in buckets of n-grams if asked."""

    def __init__(self, spark: SparkSession, database: str) -> None:
        self._spark, self._database = spark, database

    def __call__(self, table: DataFrame, name: str, buckets: int = 0, parts: Sequence[str] = (), **options: str) -> DataFrame:
        writer = table.write.mode("overwrite").format("parquet").options(**options)
        writer = writer.partitionBy(*parts) if parts else writer
        (writer.bucketBy(buckets, "ngram") if buckets else writer).saveAsTable(f"{self._database}.{name}")
        return self._spark.table(f"{self._database}.{name}")

    def drop(self, name: str) -> None:
        """Remove a table no longer read, files included."""
        self._spark.sql(f"DROP TABLE IF EXISTS {self._database}.{name}")


@contextmanager
def work_tables(spark: SparkSession, home: str) -> Iterator[WorkTables]:
    """Stored tables below ``home``, which all go at the end.

    What is shuffled for a table is removed once that is stored: otherwise it stays on the executors' disks until the
    driver collects its garbage, beside all that later tables shuffle.
    """
    database = home.rsplit("/", 1)[1].replace("-", "_")
    before = spark.conf.get(SHUFFLES_GO, None)
    spark.sql(f"CREATE DATABASE {database} LOCATION '{home}/iterations'")
    try:
        spark.conf.set(SHUFFLES_GO, "true")
        yield WorkTables(spark, database)
    finally:
        spark.conf.unset(SHUFFLES_GO) if before is None else spark.conf.set(SHUFFLES_GO, before)
        spark.sql(f"DROP DATABASE {database} CASCADE")


def kept_table(table: DataFrame, home: str, name: str) -> DataFrame:
    table.write.parquet(f"{home}/{name}")
    return table.sparkSession.read.schema(table.schema).parquet(f"{home}/{name}")


def topic_terms(model: TopicModel, top: int = 5) -> DataFrame:
    """The ``top`` terms of each topic, as (topic, term, beta); a topic's betas sum to one over all terms.

    Terms tie when their expected counts agree to a millionth of an occurrence: sums of parts, taken in any order, do.
    Only terms near a topic's ``top``-th largest sum are rounded and ranked.
    """
    return top_n_by_group(_listed_terms(model, top), "topic", "expected", top, few_groups=True).drop("expected")


def all_topic_terms(model: TopicModel) -> DataFrame:
    """Every term's share of every topic, as (topic, term, beta)."""
    return _listed_terms(model).drop("expected")


def _listed_terms(model: TopicModel, top: int | None = None) -> DataFrame:
    """Every term's share of every topic; with ``top``, terms that are among so many of no topic may be left out."""
    terms = model.terms
    if top is not None and 0 < top <= LISTED:
        edges = [(p, terms.select(p).orderBy(F.desc(p)).limit(top).agg(F.min(p)).scalar()) for p in _columns(model.k)]
        # rounded sums tie if the sums differ by less than a millionth
        near = [F.col(p) >= edge - 2e-6 for p, edge in edges]
        terms = terms.filter(functools.reduce(operator.or_, near))
    spread = model.term_prior * model.vocabulary
    shares = [
        F.struct(
            F.lit(topic + 1).alias("topic"),
            ((F.col(p) + model.term_prior) / (F.col(f"total_{p}") + spread)).alias("beta"),
            F.round(p, 6).alias("expected"),
        )
        for topic, p in enumerate(_columns(model.k))
    ]
    listed = attach(terms, _totals(model.documents, model.k))
    return listed.select(F.col("ngram").alias("term"), F.inline(F.array(*shares))).select("topic", "term", "beta", "expected")


def topic_documents(model: TopicModel) -> DataFrame:
    """Share of each topic in each document, as (document, topic, gamma)."""
    total = sum((F.col(p) for p in _columns(model.k)), F.lit(0.0))
    prior = F.lit(model.document_prior)
    shares = [
        F.struct(F.lit(topic + 1).alias("topic"), ((F.col(p) + prior) / (total + prior * model.k)).alias("gamma"))
        for topic, p in enumerate(_columns(model.k))
    ]
    return model.documents.select(F.col("bucket").alias("document"), F.inline(F.array(*shares)))


def _columns(k: int) -> list[str]:
    return [f"p{topic}" for topic in range(k)]


def _start_weight(seed: int, topic: int) -> Column:
    """A weight of the bucket times one of the cell.

    Cells alone would average out over a bucket, and the fit would be slow to leave an even mix.
    """

    def weight(*names: str) -> Column:
        # 16 bits of the digest per topic, eight topics per digest
        digest = F.md5(F.concat_ws("|", F.lit(f"{seed}.{topic // 8}"), *names))
        return F.conv(F.substring(digest, 4 * (topic % 8) + 1, 4), 16, 10).cast("double") + 1

    return weight("bucket") * weight("bucket", "ngram")


def _divided(cells: DataFrame, weights: list[Column]) -> DataFrame:
    """Each cell's count, divided among the topics in proportion to the weights."""
    # the weights are projected first: each is used in every topic's share
    weighed = cells.select("bucket", "ngram", "n", *[w.alias(f"w{topic}") for topic, w in enumerate(weights)])
    names = [F.col(f"w{topic}") for topic in range(len(weights))]
    total = sum(names[1:], names[0])
    return weighed.select(
        "bucket", "ngram", "n", *[(F.col("n") * w / total).alias(f"p{topic}") for topic, w in enumerate(names)]
    )


def _sums(cells: DataFrame, key: str, k: int) -> DataFrame:
    return cells.groupBy(key).agg(*[F.sum(p).alias(p) for p in _columns(k)])


def _totals(held: DataFrame, k: int) -> DataFrame:
    return held.agg(*[F.sum(p).alias(f"total_{p}") for p in _columns(k)])


def _bucket_number(rows: int, cores: int) -> int:
    """A bucket per core while each holds 50,000 rows, then one per million, within Spark's limit."""
    return max(1, min(max(min(cores, rows // 50_000), -(-rows // BUCKET_ROWS)), 100_000))


def _few(documents: int, k: int) -> bool:
    """Whether one row of k numbers per document is small enough to broadcast."""
    return documents * (k + 4) * 8 <= BROADCAST_BYTES


def _document_factors(held: DataFrame, k: int, document_prior: float, term_prior: float, vocabulary: int) -> DataFrame:
    """What a document and the topics' sizes contribute to a cell's weights, in ``b0`` to ``b{k-1}``."""
    spread = term_prior * vocabulary
    factors = [
        ((F.col(p) + document_prior) / (F.col(f"total_{p}") + spread)).alias(f"b{topic}")
        for topic, p in enumerate(_columns(k))
    ]
    return attach(held, _totals(held, k)).select("bucket", *factors)


def _moved(before, after, k: int) -> float:
    """The share of all counts that changed topic within their bucket; zero without counts."""
    if isinstance(before, DataFrame):
        return _moved_rows(before, after, k)
    total = after.sum()
    return float(np.abs(after - before).sum() / (2 * total)) if total else 0.0


def _moved_rows(before: DataFrame, after: DataFrame, k: int) -> float:
    both = before.alias("b").join(after.alias("a"), "bucket")
    moved = sum((F.abs(F.col(f"a.{p}") - F.col(f"b.{p}")) for p in _columns(k)), F.lit(0.0))
    held = sum((F.col(f"a.{p}") for p in _columns(k)), F.lit(0.0))
    return both.agg(F.try_divide(F.sum(moved), 2 * F.sum(held))).first()[0] or 0.0


def _iterate_rows(cells: DataFrame, terms: DataFrame, factors: DataFrame, k: int, term_prior: float, hint: str = "shuffle_hash") -> DataFrame:
    """Divide each cell's count anew, by its term's and its document's sums.

    Cells and terms lie in the same buckets and are joined there: by a hash of the bucket's terms, of which a bucket of
    bounded size has one row each, or with ``hint`` "merge" by sorting.
    """
    summed = terms.select("ngram", *[F.col(p).alias(f"t{topic}") for topic, p in enumerate(_columns(k))])
    joined = cells.select("bucket", "ngram", "n").join(summed.hint(hint), "ngram")
    joined = joined.join(factors, "bucket")
    return _divided(joined, [(F.col(f"t{topic}") + term_prior) * F.col(f"b{topic}") for topic in range(k)])
