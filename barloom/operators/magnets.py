"""Open gaps as levels that draw prices, declines from a peak, and the scores of both, each a day behind."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import SERIES, series
from .search import first_touch


def gaps(bars: DataFrame, least_sigma: float = 0.5) -> DataFrame:
    """Gaps of at least so many deviations, from bars with ``sigma``: ``idx, level, up, filled_idx``.

    The level is the close before, at which a gap is filled; ``filled_idx`` is the first bar, the gap's own included, that
    reaches it, null if none does to the end of the series.
    """
    w = series()
    b = bars.withColumns({"idx": F.row_number().over(w), "level": F.lag("close").over(w)})
    at = b.select(*SERIES, F.col("open_time").alias("_t"), F.col("idx").alias("filled_idx"))
    g = b.where("level > 0 and sigma > 0").withColumn("gap", F.col("open") / F.col("level") - 1).where(F.abs("gap") >= least_sigma * F.col("sigma"))
    g = g.select(*SERIES, "idx", "open_time", "level", (F.col("gap") > 0).alias("up")).withColumns({"_below": F.when(F.col("up"), F.col("level")), "_above": F.when(~F.col("up"), F.col("level"))})
    g = first_touch(bars, g, "open_time", "_below", "_above").withColumn("_t", F.col("x.open_time")).drop("x", "_below", "_above")
    return g.join(at, [*SERIES, "_t"], "left").drop("_t")


def fill_shares(g: DataFrame, horizons: tuple[int, ...] = (1, 5, 20, 60)) -> DataFrame:
    """Per series: number of gaps, share of those upwards, and share filled within each number of bars."""
    took = F.col("filled_idx") - F.col("idx") + 1
    return g.groupBy(*SERIES).agg(F.count("*").alias("n_gaps"), F.avg(F.col("up").cast("double")).alias("up_share"), *(F.avg(F.coalesce(took <= h, F.lit(False)).cast("double")).alias(f"fill_{h}") for h in horizons))


def magnets(bars: DataFrame, most_sigma: float = 2.0, least_sigma: float = 0.5, max_age: int = 60) -> DataFrame:
    """Bars with ``level``, the open gap under ``max_age`` bars old that is nearest to the close (of equal ones the oldest), and
    ``magnet``: how near in deviations, from 1 at the close to 0 at ``most_sigma``, below zero for levels under the close."""
    b = bars.withColumn("idx", F.row_number().over(series()))
    g = gaps(bars, least_sigma).withColumn("_last", F.least(F.col("idx") + max_age - 1, F.coalesce(F.col("filled_idx") - 1, F.col("idx") + max_age)))
    days = g.where("_last >= idx").select(*SERIES, F.col("idx").alias("made"), "level", F.explode(F.sequence("idx", "_last")).alias("idx"))
    near = days.join(b.select(*SERIES, "idx", "close"), [*SERIES, "idx"]).groupBy(*SERIES, "idx").agg(F.min_by("level", F.struct(F.abs(F.col("level") - F.col("close")), "made")).alias("level"))
    out = b.join(near, [*SERIES, "idx"], "left")
    dist = F.try_divide(F.col("level") - F.col("close"), F.col("close") * F.col("sigma"))
    return out.withColumn("magnet", F.signum(dist) * F.greatest(F.lit(0.0), 1 - F.abs(dist) / most_sigma)).drop("idx")


def lagged(p: DataFrame, value: str) -> DataFrame:
    """The value of the day before, so that what it sizes was known."""
    return p.withColumn(value, F.lag(value).over(Window.partitionBy("symbol").orderBy("date")))


def declines(p: DataFrame, lookback: int = 60, min_depth: float = 0.1, min_duration: int = 3) -> DataFrame:
    """Adds ``depth`` under the highest close of the window, ``duration`` since it (of equal peaks the first), and their ratio
    ``velocity``; null without a full window, or if a decline is shallow or short."""
    w = Window.partitionBy("symbol").orderBy("date")
    past = w.rowsBetween(1 - lookback, 0)
    p = p.withColumn("_k", F.row_number().over(w))
    p = p.withColumns({"_peak": F.max("close").over(past), "_at": F.max_by("_k", F.struct("close", -F.col("_k"))).over(past)})
    depth, duration = (F.col("_peak") - F.col("close")) / F.col("_peak"), F.col("_k") - F.col("_at")
    ok = (F.col("_k") >= lookback) & (depth >= min_depth) & (duration >= min_duration)
    p = p.withColumns({"depth": F.when(ok, depth), "duration": F.when(ok, duration.cast("double"))})
    return p.withColumn("velocity", F.col("depth") / F.col("duration")).drop("_k", "_peak", "_at")


def eligible(p: DataFrame, score: str = "velocity") -> DataFrame:
    """Per date: how many symbols have the score."""
    return p.groupBy("date").agg(F.count(score).alias("n"))


def sideways(market: DataFrame, window: int = 20, sigma: float = 1.0) -> DataFrame:
    """``market(date, ret)`` with ``sideways``: up to the day before, the market moved less than its own deviations explain."""
    w = Window.orderBy("date")  # a row a date
    past = w.rowsBetween(1 - window, 0)
    full = F.count("ret").over(past) >= window
    m = market.withColumn("_flat", full & (F.abs(F.sum("ret").over(past)) < sigma * F.stddev_samp("ret").over(past) * F.sqrt(F.lit(float(window)))))
    return m.withColumn("sideways", F.coalesce(F.lag("_flat").over(w), F.lit(False))).drop("_flat")


def reversal(p: DataFrame) -> Column:
    """The last return against its deviation, signed for a turn; ``p`` has ``ret`` and ``sigma``."""
    return F.try_divide(-F.col("ret"), F.col("sigma"))
