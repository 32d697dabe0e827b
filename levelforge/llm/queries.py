"""Queries of the numbered operators, one each, with production parameters over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

WORD_TOKENIZER = "word_bpe_49k.json"
BYTE_TOKENIZER = "byte_bpe_50k.json"

SHARD_BYTES = 1 << 20


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack, token_pieces

    return pack(token_pieces(table(spark, sf_dir, "documents"), tokenizer_path(WORD_TOKENIZER)))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .language import identify, train

    return identify(table(spark, sf_dir, "pages"), *train(table(spark, sf_dir, "documents")))


def op3_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .simhash import simhash_components

    return simhash_components(table(spark, sf_dir, "documents"))


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .suffix_dedup import drop_repeats

    return drop_repeats(table(spark, sf_dir, "documents"))


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sharding import read_shards, write_shards

    rows = read_shards(spark, *(at := write_shards(table(spark, sf_dir, "documents"), byte_limit=SHARD_BYTES)))
    shard, n_bytes = F.col(at[1]), F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")
    each = rows.select("doc_id", n_bytes.alias("n_bytes"), shard["depth"].alias("depth"), shard["prefix"].alias("prefix"), shard["page"].alias("page"))
    sums = each.groupBy("depth", "prefix").agg(F.sum("n_bytes").alias("shard_bytes"))
    return each.join(sums, ["depth", "prefix"]).select("doc_id", "n_bytes", "depth", "prefix", "page", "shard_bytes")


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .token_files import read_token_files, write_token_files

    return read_token_files(write_token_files(table(spark, sf_dir, "documents"), tokenizer_path(BYTE_TOKENIZER)))


def op7_warc_writer(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .warc import read_archives, write_archives

    return read_archives(write_archives(table(spark, sf_dir, "pages")))


def op8_tool_call_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .chat import ASK_SCHEMA, as_tool_chats, link, messages

    linked = link(*messages(as_tool_chats(table(spark, sf_dir, "conversations"))), {"ask": ASK_SCHEMA})
    return linked.withColumn("errors", F.array_join("errors", "; "))


def op9_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontaminate import contaminated

    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import quality

    return quality(table(spark, sf_dir, "documents"))


def op11_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .fingerprints import document_fingerprints

    return document_fingerprints(table(spark, sf_dir, "documents"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .tries import prefix_trie

    return prefix_trie(table(spark, sf_dir, "conversations"))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .merkle import manifest, tampered_text

    return manifest(table(spark, sf_dir, "documents"), tampered_text())


def queries():
    return {name: f for name, f in globals().items() if name.startswith("op")}


def oracle_sql() -> dict[str, str]:
    from .sql import ORACLES

    return dict(ORACLES)
