"""Where intermediate tables go, and how scans are spread."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor can reach, as ``spark.checkpoint.dir`` names it.

    A machine-local folder is made only for a local master, as in tests; on a cluster the setting
    must be there. ``DataFrame.checkpoint`` works after this call.
    """
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not folder:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="postweave-")
    if not context.getCheckpointDir():
        context.setCheckpointDir(folder)
    return folder


def fresh_folder(spark: SparkSession, name: str) -> str:
    """A path below the shared folder that no other run uses."""
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


# A split of a scan holds at most about so many bytes of text.
SPLIT_BYTES = 32 * 1024 * 1024


def spread(scan: DataFrame, *keys: str) -> DataFrame:
    """Redistribute a scan that has fewer splits than the cluster has cores, or too few for its text.

    A table in one small file would otherwise be tokenised by one task. Splits are cut by the bytes of files, in which texts
    are compressed: the words and n-grams of one of them, counted before a shuffle, would outgrow a task's memory and be
    spilled, so the bytes of column ``text`` are added up first, where there is one. A scan with enough splits is returned
    as it is: no text is shuffled then. Pass a scan without joins or aggregations, so that counting its splits runs nothing.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    wanted = cores
    if "text" in scan.columns:
        held = scan.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        wanted = max(cores, -(-held // SPLIT_BYTES))
    if scan.rdd.getNumPartitions() >= wanted:
        return scan
    return scan.repartition(wanted, *keys)
