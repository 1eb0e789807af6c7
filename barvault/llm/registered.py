"""The registered query of each operator: production parameters, whole tables, the columns of its contract."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barvault.llm import (
    conversations,
    decontaminate,
    licenses,
    line_dedup,
    mixing,
    piece_bpe,
    quality,
    sharding,
    simhash,
    spelling,
    suffix_dedup,
    topk,
    toxicity,
)
from barvault.llm.support import table

Query = Callable[[SparkSession, str], DataFrame]


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and group of every document."""
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "fingerprint", "component_id")


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score of every document."""
    return toxicity.score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document without the strings of 200 bytes that occur twice."""
    found = suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"))
    removed = F.aggregate(F.zip_with("ends", "starts", lambda e, s: e - s), F.lit(0).cast("bigint"), lambda a, b: a + b)
    return found.select(
        "doc_id",
        "n_bytes",
        removed.alias("n_removed"),
        F.size("starts").cast("bigint").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shard of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.xxhash64("text").alias("content"))
    return sharding.assign_shards(docs, "doc_id", "content").select("doc_id", "shard")


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document without the lines that ten documents share."""
    kept = line_dedup.dedup_lines(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document that it shares with benchmark items."""
    found = decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    listed = F.concat_ws(",", "items").cast("binary")
    return found.select(
        F.col("key").alias("doc_id"),
        "n_words",
        "n_hit",
        F.size("items").cast("bigint").alias("n_items"),
        F.sha2(listed, 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words the mix takes of every document."""
    mix = mixing.mix_sources(table(spark, sf_dir, "documents"))
    return mix.select(F.col("key").alias("doc_id"), "size", "source", "source_size", "target", "taken")


def op8_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licences of every document."""
    found = licenses.scan_licenses(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id", "n_known", F.concat_ws(",", "licenses").alias("licenses"), F.size("matches").alias("n_matches")
    )


def op9_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest vectors by inner product for every fiftieth vector."""
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Importance weight of every document, and whether it is selected."""
    chosen = quality.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return chosen.select(F.col("key").alias("doc_id"), "log_weight", "perturbed", "selected")


def op11_sentencepiece(spark: SparkSession, sf_dir: str, model: str | None = None) -> DataFrame:
    """Piece ids of every document and the text they decode to; ``model`` is the path of a BPE model."""
    if model is None:
        import public_tokenizers

        model = public_tokenizers.path("piece_bpe_32k.model")
    coded = piece_bpe.with_pieces(table(spark, sf_dir, "documents").select("doc_id", "text"), piece_bpe.read_model(model))
    listed = F.array_join(F.transform("ids", lambda i: i.cast("string")), " ")
    return coded.select(
        "doc_id",
        F.size("ids").cast("bigint").alias("n_tokens"),
        F.sha2(listed.cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults of every damaged conversation and the cheapest edits that repair it."""
    rows = conversations.damaged(table(spark, sf_dir, "conversations"))
    return conversations.repair_report(rows, absent="absent")


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Form and root of every word of the documents."""
    return spelling.group_spellings(table(spark, sf_dir, "documents"))


REGISTERED: dict[str, Query] = {
    "op1_simhash": op1_simhash,
    "op2_toxicity": op2_toxicity,
    "op3_suffix_dedup": op3_suffix_dedup,
    "op4_sharding": op4_sharding,
    "op5_line_dedup": op5_line_dedup,
    "op6_decontamination": op6_decontamination,
    "op7_mixing": op7_mixing,
    "op8_licenses": op8_licenses,
    "op9_topk": op9_topk,
    "op10_quality": op10_quality,
    "op11_sentencepiece": op11_sentencepiece,
    "op12_conversation_repair": op12_conversation_repair,
    "op13_spelling_variants": op13_spelling_variants,
}
