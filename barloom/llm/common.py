"""Shared helpers: the scratch folder, stage tables, connected components."""

from __future__ import annotations

import time
import uuid

import numpy as np
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.places import shared_dir

_scratch: list[str] = []
TIDY_S = 3.0
_tidied = 0.0


def new_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _scratch.append(path)
    return path


def drop_path(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    if path in _scratch:
        _scratch.remove(path)


def drop_staged(df: DataFrame) -> None:
    """Delete the stage table that ``df`` is, once nothing reads it any more."""
    if files := df.inputFiles():
        drop_path(df.sparkSession, files[0].rsplit("/", 1)[0])


def release(spark: SparkSession) -> None:
    """Delete every scratch table made so far.

    Only for callers that have written all results drawn from them, as the pipeline does between stages.
    """
    for path in list(_scratch):
        drop_path(spark, path)


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: cuts lineage and survives lost executors.

    The shuffles behind it are not read again. Executors delete their files once the driver has collected the garbage that
    refers to them, which it may not do for as long as its memory lasts; so it is asked to, at most once in ``TIDY_S`` seconds.
    """
    global _tidied
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    if time.monotonic() - _tidied > TIDY_S:
        spark.sparkContext._jvm.System.gc()
        _tidied = time.monotonic()
    return spark.read.schema(df.schema).parquet(path)


def word_hashes(text: str | None) -> np.ndarray:
    """64-bit hashes of the words between ASCII white space, A-Z lowered."""
    digests = b"".join(map(xxhash.xxh3_64_digest, (text or "").encode("utf-8", "surrogatepass").lower().split()))
    return np.frombuffer(digests, ">u8").astype(np.uint64) | np.uint64(1)


def rolling(a: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of k words; none if there are fewer."""
    h = np.full(max(len(a) - k + 1, 0), k, np.uint64)
    for i in range(k):
        h = (h ^ a[i : len(a) - k + 1 + i]) * np.uint64(0x9E3779B97F4A7C15) if len(h) else h
        h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def connected_components(edges: DataFrame, max_rounds: int = 40) -> DataFrame:
    """Smallest id reachable from each node: ``(id, component)`` for every node named in ``edges(a, b)``.

    Alternates large-star and small-star steps (Kiveris et al., 2014). Hubs do not gather neighbours into one row:
    each step is an aggregated minimum joined back to the edges. Nodes are 64-bit integers; null ends and self
    loops are dropped. No rows give no rows. Each round is written to the shared folder.
    """
    e = staged(
        edges.where("a is not null and b is not null and a <> b")
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .distinct(),
        "edges",
    )
    first = e
    before = None
    for _ in range(max_rounds):
        both = e.select("a", "b").union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        # large star: each larger neighbour of a node moves to the smallest node around it
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        # small star: smaller neighbours, and the node itself, move to the smallest of them
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b"))).distinct()
        n = staged(small, "edges")
        now = n.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if e is not first:
            drop_staged(e)
        e = n
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("components did not settle")
    tops = e.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct()
    return e.select(F.col("a").alias("id"), F.col("b").alias("component")).union(tops)
