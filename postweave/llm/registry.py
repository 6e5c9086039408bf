"""The queries of this package over the test tables, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from postweave.llm import chat_format, decontamination, embedding_dedup, filter_audit, line_dedup, lm_scoring, packing, quality, sharding, simhash, substring_dedup, vector_codes, warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {
    "op2_capture_histories": warc.SQL,
    "op6_interleave": sharding.SQL,
    "op11_turn_machine": chat_format.SQL,
    "op12_resident_lloyd": vector_codes.SQL,
    "op13_existential_self_join": filter_audit.SQL,
}


def _query(function: Callable[[SparkSession, str], DataFrame]):
    QUERIES[function.__name__] = function
    return function


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@_query
def op1_masked_pseudo_likelihood(spark, sf_dir):
    return lm_scoring.pseudo_likelihood(_table(spark, sf_dir, "documents"))


@_query
def op2_capture_histories(spark, sf_dir):
    made = warc.capture_histories(_table(spark, sf_dir, "pages"))
    return made.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@_query
def op3_covering_simhash(spark, sf_dir):
    return simhash.components(_table(spark, sf_dir, "documents"))


@_query
def op4_template_windows(spark, sf_dir):
    return decontamination.contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


@_query
def op5_collision_counting(spark, sf_dir):
    return embedding_dedup.near_duplicates(_table(spark, sf_dir, "embeddings"))


@_query
def op6_interleave(spark, sf_dir):
    return sharding.shard_rows(_table(spark, sf_dir, "documents"))


@_query
def op7_log_templates(spark, sf_dir):
    return line_dedup.line_digest(_table(spark, sf_dir, "documents"))


@_query
def op8_factorisation_machine(spark, sf_dir):
    return quality.assess(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


@_query
def op9_power_of_two(spark, sf_dir):
    return packing.pack(_table(spark, sf_dir, "documents"), tokenizer_path())


@_query
def op10_repeated_windows(spark, sf_dir):
    return substring_dedup.remove_repeats(_table(spark, sf_dir, "documents"))


@_query
def op11_turn_machine(spark, sf_dir):
    return chat_format.digest(_table(spark, sf_dir, "conversations"))


@_query
def op12_resident_lloyd(spark, sf_dir):
    return vector_codes.compress(_table(spark, sf_dir, "embeddings"))


@_query
def op13_existential_self_join(spark, sf_dir):
    return filter_audit.audit(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))
