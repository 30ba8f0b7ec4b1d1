"""Bar tables that grow by pages, and series that their provider restates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .places import exists
from .tables import SERIES

#: How far the close of the bar that two fetches share may move before its series is on another basis.
TOLERANCE = 0.01
_BAR = ("open_time", "open", "high", "low", "close", "volume")
_ROWS = "symbol string, timeframe string, open_time long, open double, high double, low double, close double, volume double, restated boolean, page int"


def stored(spark: SparkSession, path: str, before: int | None = None) -> DataFrame | None:
    """The bars at ``path``: of each series what the newest page that restated it began with, then the newest row of each bar.

    ``before`` leaves out that page and later ones; None if there is no page then. Pages lie in folders by their number. A page
    is written whole or not at all, over what an earlier try left, so trying again changes nothing.
    """
    if not exists(spark, path):
        return None
    rows = spark.read.schema(_ROWS).parquet(path)
    if before is not None:
        rows = rows.where(F.col("page") < before)
        if not rows.take(1):
            return None
    base = F.max(F.when(F.col("restated"), F.col("page"))).over(Window.partitionBy(*SERIES))
    rows = rows.withColumn("_base", base).where("_base is null or page >= _base")
    return rows.groupBy(*SERIES, "open_time").agg(F.max_by(F.struct(*_BAR[1:]), "page").alias("b")).select(*SERIES, "open_time", "b.*")


def newest(bars: DataFrame) -> DataFrame:
    """``symbol, timeframe, latest, close``: the last stored bar of each series, from which its next page has to begin."""
    return bars.groupBy(*SERIES).agg(F.max("open_time").alias("latest"), F.max_by("close", "open_time").alias("close"))


def restated(bars: DataFrame, page: DataFrame, tolerance: float = TOLERANCE) -> DataFrame:
    """``symbol, timeframe, latest, before, after`` of the series whose overlap bar came back on another basis.

    A missing close, or one of 0 or less, tells nothing, and the series is taken to go on as it was.
    """
    last = newest(bars).withColumnRenamed("close", "before")
    both = last.join(page.select(*SERIES, F.col("open_time").alias("latest"), F.col("close").alias("after")), [*SERIES, "latest"])
    return both.where((F.col("before") > 0) & (F.abs(F.col("after") / F.col("before") - 1) > tolerance))


def sync(spark: SparkSession, path: str, page: DataFrame, history: DataFrame, number: int, tolerance: float = TOLERANCE) -> DataFrame:
    """Store page ``number`` of new bars and return the table of all bars.

    ``page`` begins, for each series, with its last stored bar, which is overwritten: it may have been stored before it closed.
    Where that bar's close moved by more than ``tolerance``, the provider has changed the basis of the whole series (a split), so all
    of it is taken from ``history`` instead, from the first stored bar on, and replaces what is stored; other series are not
    touched. Series that are not stored yet begin with their page. Pages go in order; the same one may be stored again.
    """
    out = f"{path.rstrip('/')}/page={number}"
    rows = page.select(*SERIES, *_BAR)
    old = stored(spark, path, number)
    if old is None:
        fresh = rows.withColumn("restated", F.lit(False))
    else:
        moved = restated(old, rows, tolerance).select(*SERIES)
        first = old.groupBy(*SERIES).agg(F.min("open_time").alias("first"))
        again = history.select(*SERIES, *_BAR).join(moved, list(SERIES), "left_semi").join(first, list(SERIES)).where("open_time >= first").drop("first")
        fresh = rows.join(moved, list(SERIES), "left_anti").withColumn("restated", F.lit(False)).unionByName(again.withColumn("restated", F.lit(True)))
    fresh.write.mode("overwrite").parquet(out)
    return stored(spark, path)
