import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from postweave.operators import topic_blocks, topics


def test_small_blocks_give_the_fit_of_rows(spark, monkeypatch):
    """Blocks end between n-grams, whatever their size and that of the batches."""
    cells = [(f"d{(i * 7 + j) % 5}", f"t{i}", 1 + (i * j) % 4) for i in range(40) for j in range(1 + i % 5)] + [(None, "t0", 1), ("d0", None, 2)]
    counts = spark.createDataFrame(cells, "bucket string, ngram string, n bigint")
    seen = []
    iterate = topics._iterate
    monkeypatch.setattr(topics, "_iterate", lambda *args: seen.append(args[0].agg(F.count("*"), F.sum(F.size("names"))).first()) or iterate(*args))
    monkeypatch.setattr(topic_blocks, "BLOCK_CELLS", 7)
    kept = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        blocks = topics.fit_topics(counts, 3, 2, tolerance=0)
        terms = {r[0]: r[1:] for r in blocks.terms.collect()}
        documents = {r[0]: r[1:] for r in blocks.documents.collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", kept)
    assert 5 < seen[0][0] < 40 and seen[0][1] == blocks.vocabulary == 40
    monkeypatch.setattr(topics, "BROADCAST_BYTES", 0)
    rows = topics.fit_topics(counts, 3, 2, tolerance=0)
    assert terms == {r[0]: pytest.approx(r[1:]) for r in rows.terms.collect()}
    assert documents == {r[0]: pytest.approx(r[1:]) for r in rows.documents.collect()}
    assert blocks.moved == pytest.approx(rows.moved)


def _shuffled(spark):
    """Bytes of shuffle files on the disk."""
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return sum(file.length() for file in (files.apply(at) for at in range(files.size())) if file.getName().startswith("shuffle_"))


def test_a_fit_keeps_on_disk_only_what_it_still_reads(spark, monkeypatch, tmp_path):
    """No counts, no shuffles and one table of sums beside the cells, which hold no sums, when an iteration begins."""
    monkeypatch.setattr(topics, "fresh_folder", lambda session, name: str(tmp_path / "topics-3"))
    found = []
    iterate = topics._iterate

    def spy(cells, *args):
        tables = sorted(p.name for p in (tmp_path / "topics-3" / "iterations").iterdir() if p.name.startswith(("counts", "terms")))
        for _ in range(100):
            if _shuffled(spark) <= before + 100_000:
                break
            time.sleep(0.1)
        found.append((tables, set(cells.columns) & {"sums", "held"}, _shuffled(spark) - before))
        return iterate(cells, *args)

    monkeypatch.setattr(topics, "_iterate", spy)
    tokens = spark.range(200_000).select((F.col("id") % 7).cast("string").alias("bucket"), F.md5(F.col("id").cast("string")).alias("ngram"))
    before = _shuffled(spark)
    topics.fit_topics(topics.document_terms(tokens), 2, 2, tolerance=0)
    assert [tables for tables, _, _ in found] == [["terms_even"], ["terms_odd"]]
    assert all(not held and left <= 100_000 for _, held, left in found), found
    assert spark.conf.get(topics.SHUFFLES_GO, None) is None


def test_numbers_of_a_block_are_kept_whole():
    for values in ([], [0, 255], [0, 256], [70_000, 1], [2**32, 1], [0.5, 3.0], [-1.0, 2.0]):
        kept = topic_blocks._binary(topic_blocks._narrow(np.array(values)))[0]
        assert topic_blocks._wide(kept).tolist() == values


def test_chunks_of_a_block_cover_it(monkeypatch):
    monkeypatch.setattr(topic_blocks, "CHUNK_CELLS", 5)
    cells = np.array([1, 9, 1, 1, 2, 12, 3, 1])
    ends = np.cumsum(cells)
    seen = list(topic_blocks._chunks(cells))
    assert len(seen) > 2 and [i for some, _, _ in seen for i in range(some.start, some.stop)] == list(range(8))
    for some, at, within in seen:
        assert (within.start, within.stop) == (ends[some.start] - cells[some.start], ends[some.stop - 1])
        assert at.tolist() == (ends - cells - within.start)[some].tolist()


def test_ngrams_that_occur_once_keep_no_sums(spark, monkeypatch):
    """Their shares after many iterations are those of a fit that carries the sums of all n-grams."""
    cells = [(f"d{i % 6}", f"once {i}", 1) for i in range(60)] + [(f"d{i % 6}", f"more {i % 9}", 1 + i % 3) for i in range(30)] + [("d7", "alone", 1)]
    cells += [("d1", "twice", 2)]
    counts = spark.createDataFrame(cells, "bucket string, ngram string, n bigint").groupBy("bucket", "ngram").agg(F.sum("n").alias("n"))
    single = counts.groupBy("ngram").agg(F.sum("n").alias("n")).filter("n = 1").count()
    seen = []
    iterate = topics._iterate
    monkeypatch.setattr(topics, "_iterate", lambda *args: seen.append(args[1].agg(F.sum(F.octet_length("sums"))).first()[0]) or iterate(*args))
    blocks = topics.fit_topics(counts, 3, 25, tolerance=0, document_prior=0.5, term_prior=0.01)
    assert single == 61 and blocks.vocabulary == 71
    assert seen == [10 * 3 * 8] * 25
    terms, documents = ({r[0]: r[1:] for r in table.collect()} for table in (blocks.terms, blocks.documents))
    monkeypatch.setattr(topics, "BROADCAST_BYTES", 0)
    rows = topics.fit_topics(counts, 3, 25, tolerance=0, document_prior=0.5, term_prior=0.01)
    assert terms == {r[0]: pytest.approx(r[1:], rel=1e-9) for r in rows.terms.collect()}
    assert documents == {r[0]: pytest.approx(r[1:], rel=1e-9) for r in rows.documents.collect()}


def test_many_documents_carry_all_sums(spark, monkeypatch):
    """Where a matrix per document is too much to broadcast, the fit is the same."""
    cells = [(f"d{i % 6}", f"once {i}", 1) for i in range(30)] + [(f"d{i % 6}", f"more {i % 4}", 1 + i % 3) for i in range(30)]
    counts = spark.createDataFrame(cells, "bucket string, ngram string, n bigint").groupBy("bucket", "ngram").agg(F.sum("n").alias("n"))
    fits = []
    for most in (topics.BROADCAST_BYTES, 6 * 8 * 8):
        monkeypatch.setattr(topics, "BROADCAST_BYTES", most)
        fits.append({r[0]: r[1:] for r in topics.fit_topics(counts, 3, 5, tolerance=0).terms.collect()})
    assert fits[0] == {name: pytest.approx(sums, rel=1e-9) for name, sums in fits[1].items()}
