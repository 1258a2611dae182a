"""Queries over the documents of a data folder, one for each operator here."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, decontaminate, jaccard_join, language_id, line_dedup, quality_rules, sharding, suffix_dedup, token_counts, token_store
from .common import documents, shared_dir


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def vocabulary(name: str) -> str:
    """Where a public tokenizer's file lies."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(documents(spark, sf_dir), vocabulary("byte_bpe_50k.json"), "doc_id")


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(documents(spark, sf_dir), vocabulary("byte_bpe_50k.json"), "doc_id")


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    shards = sharding.write_shards(documents(spark, sf_dir).select("doc_id", "text"), 16, shared_dir(spark, "shards"))
    return shards.select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("bigint").alias("size"),
        F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"),
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.components(documents(spark, sf_dir).select("doc_id", "text"))


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = suffix_dedup.remove_repeats(documents(spark, sf_dir).select("doc_id", "text"), "doc_id", length=200, keep="none")
    removed = F.coalesce(F.aggregate("spans", F.lit(0).cast("bigint"), lambda n, s: n + s["e"] - s["b"]), F.lit(0).cast("bigint"))
    return cut.select(
        "doc_id",
        (F.length("kept") + removed).cast("bigint").alias("n_bytes"),
        removed.alias("n_removed"),
        F.size("spans").cast("bigint").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


def op7_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = token_store.write_store(documents(spark, sf_dir), vocabulary("word_bpe_49k.json"), shared_dir(spark, "tokens"))
    return token_store.read_store(manifest).select("doc_id", "start", "n_tokens", "ids_crc32")


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "lang", "text")
    fold = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4))
    docs = docs.withColumn("held_out", F.coalesce(fold == 2, F.lit(False)))
    profiles = language_id.train(docs.where("not held_out"))
    return language_id.predict(docs, profiles, "doc_id", "held_out")


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = line_dedup.remove_duplicate_lines(documents(spark, sf_dir).select("doc_id", "text"), "doc_id")
    return cut.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    found = decontaminate.hits(documents(spark, sf_dir), benchmark, "doc_id")
    n_hit = F.size("hit").cast("bigint")
    return found.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("bigint").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    rules = quality_rules.fit(docs, _labels(spark, sf_dir))
    columns = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    return quality_rules.apply(docs, rules).select(*columns)


QUERIES = {f.__name__: f for f in (op1_token_counts, op2_language_id, op3_bpe, op4_sharding, op5_jaccard_join, op6_suffix_dedup, op7_token_store, op8_line_dedup, op9_decontamination, op10_quality_rules)}
ORACLE_SQL: dict[str, str] = {"op5_jaccard_join": jaccard_join.ORACLE_SQL, "op6_suffix_dedup": suffix_dedup.ORACLE_SQL, "op9_decontamination": decontaminate.ORACLE_SQL}
