"""From raw documents to a training mixture, in stages; each is written as Parquet and read again by the next."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from barloom.llm import chain_dedup, common, decontaminate, mixture, pu_quality, signature_join


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts.

    A null or empty text is scored like any other. Rows without an id stay, as no label can speak of them; rows that share an
    id go if any of them is rejected. Null labels are none; without labels every score is a half, and all stay.
    """
    common.release(spark)
    return pu_quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the smallest id, of each group of near duplicates.

    Null and empty texts are linked with nothing and stay, as do rows without an id. Rows that share id and text stay once.
    """
    common.release(spark)
    return signature_join.keep_first(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without passages of 50 words or more that an earlier document has; ``n_chars`` follows.

    Texts without such a passage are unchanged, null and empty ones too; one of which nothing but white space is left goes.
    Rows without an id neither give nor lose passages; rows that share an id are taken for one document.
    """
    common.release(spark)
    return chain_dedup.remove_repeats(docs)


def benchmark_free(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window of ten words of any benchmark item.

    Null and empty texts have no words and stay, and so does all if there is no item with words. Each row is judged for itself.
    """
    common.release(spark)
    return decontaminate.keep_clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents by target weights, with ``domain, n_tokens, epoch``.

    A null language or source is a leaf of its own; texts without tokens use no budget. Of documents with equal places in the
    seeded order, the id and then the text decide. A column that is named like a new one is replaced by it.
    """
    common.release(spark)
    return mixture.mix(docs, mixture.WEIGHTS)


STAGES = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("benchmark_free", benchmark_free),
    ("mixed", mixed),
]

#: None: the learned classifier, the components and the chains have no SQL; tests/llm/test_pipeline.py holds each stage
#: against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; what is returned lies in the shared folder."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        path = f"{common.shared_dir(spark)}/pipeline-{name}-{uuid.uuid4().hex}"
        stage(spark, docs, sf_dir).write.parquet(path)
        if before:
            common.drop_path(spark, before)
        docs, before = spark.read.parquet(path), path
    common.release(spark)
    return docs
