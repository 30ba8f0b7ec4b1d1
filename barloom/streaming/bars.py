"""Bars, alerts and outcomes as streams of files."""

from __future__ import annotations

import uuid

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

from ..sources.places import shared_dir


def folder(spark: SparkSession, name: str) -> str:
    """A new place in the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def drain(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Run a stream over all there is and return what it wrote."""
    spark = stream.sparkSession
    out, state = folder(spark, name), folder(spark, f"{name}-state")
    stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", state).outputMode(mode).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


def event_bars(events: DataFrame, width: str = "1 hour", late: str = "1 day") -> DataFrame:
    """Tumbling bars of an event stream: high, low, volume and the value sum, closed once the watermark has passed."""
    ts = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return ts.groupBy(F.window("ts", width).alias("w"), F.col("event_type").alias("symbol")).agg(F.max("value").alias("high"), F.min("value").alias("low"), F.count("*").alias("volume"), F.sum("value").alias("total")).select("symbol", F.unix_millis("w.start").alias("open_time"), "high", "low", "volume", "total")


def files(spark: SparkSession, path: str, name: str, schema) -> DataFrame:
    """The Parquet files of that name (a pattern) in a folder, as a stream."""
    return spark.readStream.schema(schema).option("pathGlobFilter", name).parquet(path)


def all_bars(spark: SparkSession, path: str, name: str, schema, width: str = "1 hour") -> DataFrame:
    """The stream of ``path`` as bars, the last windows too.

    Each batch writes the bars it changed to a place of its own, by the batch's number, so that a batch that is tried again
    writes the same place; of a bar in several places the one of the latest batch counts.
    """
    out = folder(spark, "bars")
    s = files(spark, path, name, schema)
    parts = s.groupBy(F.window(F.col("ts").cast("timestamp"), width).alias("w"), F.col("event_type").alias("symbol")).agg(F.max("value").alias("high"), F.min("value").alias("low"), F.count("*").alias("volume"), F.sum("value").alias("total")).select("symbol", F.unix_millis("w.start").alias("open_time"), "high", "low", "volume", "total")

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    parts.writeStream.outputMode("update").option("checkpointLocation", folder(spark, "bars-state")).foreachBatch(put).trigger(availableNow=True).start().awaitTermination()
    rows = spark.read.schema(f"{parts.schema.simpleString()[7:-1].replace(',', ', ').replace(':', ' ')}, batch long").parquet(out)
    values = [c for c in parts.columns if c not in ("symbol", "open_time")]
    return rows.groupBy("symbol", "open_time").agg(F.max_by(F.struct(*values), "batch").alias("b")).select("symbol", "open_time", "b.*")


def fresh_alerts(signals: DataFrame, keys: list[str]) -> DataFrame:
    """Signals newer than the last one sent for their key: exactly one per key and bar, state kept by key.

    Of a batch's rows only the distinct new ones of a key are held.
    """
    names = [f.name for f in signals.schema]
    at = names.index("open_time")

    def run(key, frames, state):
        last = state.get[0] if state.exists else -1
        rows = sorted({r for f in frames for r in f.itertuples(index=False, name=None) if r[at] > last}, key=lambda r: r[at])
        out = []
        for r in rows:
            if r[at] > last:
                last = r[at]
                out.append(r)
        state.update((last,))
        yield pd.DataFrame(out, columns=names)

    return signals.groupBy(*keys).applyInPandasWithState(run, signals.schema, "last long", "append", GroupStateTimeout.NoTimeout)
