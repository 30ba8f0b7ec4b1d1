"""Swings of a series and what breaks them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import SERIES, series
from .search import first_touch


def swings(bars: DataFrame, n: int = 5) -> DataFrame:
    """Bars that are the extreme of the n on either side: ``idx, side (H or L), price, confirmed``, the last being the
    open time of the bar that ends the window, when the swing can first be known."""
    around = series().rowsBetween(-n, n)
    b = bars.withColumns({"idx": F.row_number().over(series()), "_k": F.count("*").over(around), "_hi": F.max("high").over(around), "_lo": F.min("low").over(around), "confirmed": F.lead("open_time", n).over(series())})
    b = b.where(F.col("_k") == 2 * n + 1)
    sides = F.array(F.struct(F.lit("H").alias("side"), F.col("high").alias("price"), (F.col("high") == F.col("_hi")).alias("is")), F.struct(F.lit("L").alias("side"), F.col("low").alias("price"), (F.col("low") == F.col("_lo")).alias("is")))
    return b.withColumn("x", F.explode(sides)).where("x.is").select(*SERIES, "idx", "open_time", "x.side", "x.price", "confirmed")


def market_structure(bars: DataFrame, n: int = 5, min_swing_pct: float = 0.005) -> DataFrame:
    """Higher highs and lower lows: a break of structure, or a change of character against the last such event."""
    w = Window.partitionBy(*SERIES).orderBy("idx", "side").rowsBetween(Window.unboundedPreceding, -1)
    high = F.col("side") == "H"
    s = swings(bars, n).withColumns({"sh": F.last(F.when(high, F.col("price")), True).over(w), "sl": F.last(F.when(~high, F.col("price")), True).over(w)})
    s = s.withColumn("event", F.when(high & (F.col("price") > F.col("sh")), "up").when(~high & (F.col("price") < F.col("sl")), "down"))
    s = s.withColumn("trend", F.last("event", True).over(w)).where("event is not null")
    long = F.col("event") == "up"
    other = F.coalesce(F.when(long, F.col("sl")).otherwise(F.col("sh")), F.lit(0.0))
    size = F.when(F.col("price") > 0, F.when(long, F.col("price") - other).otherwise(other - F.col("price")) / F.col("price")).otherwise(0.0)
    turned = F.coalesce(F.col("trend") != F.col("event"), F.lit(False))
    reason = F.format_string("%s_%s@%.2f", F.when(turned, "choch").otherwise("bos"), F.when(long, "long").otherwise("short"), "price")
    s = s.where(size >= min_swing_pct).withColumn("_n", F.row_number().over(Window.partitionBy(*SERIES, "idx").orderBy("side"))).where("_n = 1")
    return s.select(*SERIES, F.col("confirmed").alias("open_time"), F.when(long, "long").otherwise("short").alias("direction"), reason.alias("reason"), other.alias("sl_price"), F.lit(False).alias("low_volume"), F.lit(None).cast("double").alias("tp_price"))


def gap_zones(bars: DataFrame, min_gap_pct: float = 0.001) -> DataFrame:
    """All three-bar gaps of a series as boxes, with the time their midpoint was first crossed, to the end of the series."""
    w = series()
    b = bars.withColumns({"_ph": F.lag("high").over(w), "_pl": F.lag("low").over(w), "_nl": F.lead("low").over(w), "_nh": F.lead("high").over(w), "_next": F.lead("open_time").over(w)})
    b = b.withColumn("side", F.when(F.col("_ph") < F.col("_nl"), "bull").when(F.col("_pl") > F.col("_nh"), "bear")).where("side is not null")
    b = b.withColumns({"bottom": F.when(F.col("side") == "bull", F.col("_ph")).otherwise(F.col("_nh")), "top": F.when(F.col("side") == "bull", F.col("_nl")).otherwise(F.col("_pl"))})
    b = b.where((F.col("top") - F.col("bottom")) >= min_gap_pct * (F.col("top") + F.col("bottom")) / 2)
    mid = (F.col("top") + F.col("bottom")) / 2
    asks = b.select(*SERIES, "open_time", "side", "bottom", "top", (F.col("_next") + 1).alias("_from"), F.when(F.col("side") == "bull", mid).alias("_below"), F.when(F.col("side") == "bear", mid).alias("_above"))
    got = first_touch(bars, asks, "_from", "_below", "_above")
    return got.select(*SERIES, "open_time", "side", "bottom", "top", F.col("x.open_time").alias("crossed_at")).withColumn("active", F.col("crossed_at").isNull())
