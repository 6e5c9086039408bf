"""From raw documents to packed sequences.

Each stage takes (spark, docs, sf_dir) and works on all rows the stage before it kept; what it decides takes effect in
what it returns. All stages but the last return the columns of ``documents``.

1. quality: documents that the factorisation machine scores below 0.5 go.
2. line deduplication: lines of recurring templates are dropped; the document with the smallest doc_id keeps them.
   A document of which every line is dropped stays, with an empty text.
3. near-duplicates: of the documents whose SimHash fingerprints (three-word shingles) differ in at most three bits,
   directly or through others, the smallest doc_id stays.
4. decontamination: documents that hold a benchmark item go.
5. packing: the rest is cut into pieces of power-of-two lengths.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from postweave.llm import decontamination, line_dedup, packing, quality, registry, simhash
from postweave.llm.stored import stored


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_recurring_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return line_dedup.keep_first_lines(docs)


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.keep_one(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontamination.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, registry.tokenizer_path())


STAGES = [
    ("quality", keep_good),
    ("lines", drop_recurring_lines),
    ("near-duplicates", keep_one_of_each),
    ("decontamination", drop_contaminated),
    ("packing", pack),
]

# a trained model, a hashed fingerprint and a tokenizer are beyond SQL; tests/llm holds the stages against plain versions
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed pieces of ``documents``; what each stage keeps is written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
