"""The registered queries of this subpackage and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import chain_dedup, decontaminate, importance, jpeg_media, license_scan, main_text, mixture, pivot_codes, pu_quality, signature_join, unigram_count, virtual_slots, warc_convert


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_warc_from_arc(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = warc_convert.archived(_table(spark, sf_dir, "pages"))
    return got.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op2_pu_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pu_quality.classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op3_signature_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signature_join.components(_table(spark, sf_dir, "documents"))


def op4_unigram_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return unigram_count.count_tokens(_table(spark, sf_dir, "documents"), unigram_count.load_pieces())


def op5_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text.extract(_table(spark, sf_dir, "pages"))


def op6_collinear_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chain_dedup.passages(_table(spark, sf_dir, "documents"))


def op7_jpeg_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jpeg_media.features(jpeg_media.encode(_table(spark, sf_dir, "documents")))


def op8_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.decontaminate(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op9_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    chosen = mixture.mix(_table(spark, sf_dir, "documents"), mixture.WEIGHTS)
    return chosen.select("doc_id", "domain", "lang", "source", "n_tokens", "epoch")


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(_table(spark, sf_dir, "documents"))


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.resample(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op12_virtual_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return virtual_slots.shard(_table(spark, sf_dir, "documents"))


def op13_pivot_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pivot_codes.compress(_table(spark, sf_dir, "embeddings"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, f in globals().items() if k.startswith("op") and callable(f)}


def oracle_sql() -> dict[str, str]:
    return {
        "op1_warc_from_arc": warc_convert.ARCHIVED_SQL,
        "op3_signature_trees": signature_join.COMPONENTS_SQL,
        "op8_benchmark_decontamination": decontaminate.DECONTAMINATE_SQL,
        "op9_mixture": mixture.MIX_SQL,
        "op11_importance_resampling": importance.RESAMPLE_SQL,
        "op12_virtual_slots": virtual_slots.SHARD_SQL,
        "op13_pivot_codes": pivot_codes.COMPRESS_SQL,
    }
