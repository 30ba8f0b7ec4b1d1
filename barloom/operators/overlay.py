"""An overlay's arms summed up, and its state at the last close."""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.statistics import drawdown_stats
from ..sources import calendar

#: The windows of both legs, the daily volatility that a full weight stands for, and the hour (UTC) from which a bar of the day has closed.
MA, VOL, SIGMA, CLOSED_HOUR = 200, 20, 0.00709, 21


def summaries(arms: DataFrame, keys: list[str], days: float = 252.0) -> DataFrame:
    """Per key of ``arms(keys, date, ret, weight)``: ``years, ann_return, ann_vol, sharpe, ulcer, max_drawdown, longest_under_water,
    switches_a_year, in_market, turnover_a_year``. A null weight is a full one; a null return is no session."""
    rows = arms.where("ret is not null").withColumn("weight", F.coalesce("weight", F.lit(1.0)))
    step = F.abs(F.col("weight") - F.lag("weight").over(Window.partitionBy(*keys).orderBy("date")))
    rows = rows.withColumn("_step", F.coalesce(step, F.lit(0.0)))
    g = rows.groupBy(*keys).agg(
        (F.datediff(F.max("date"), F.min("date")) / 365.25).alias("years"), F.sum(F.log1p("ret")).alias("_log"), F.avg("ret").alias("_mean"), F.stddev_samp("ret").alias("_sd"),
        F.sum((F.col("_step") > 0).cast("int")).alias("_switches"), F.avg("weight").alias("in_market"), F.sum("_step").alias("_turnover"),
    )
    g = g.withColumns({
        "ann_return": F.exp(F.try_divide(F.col("_log"), F.col("years"))) - 1, "ann_vol": F.col("_sd") * F.sqrt(F.lit(days)), "sharpe": F.try_divide("_mean", "_sd") * F.sqrt(F.lit(days)),
        "switches_a_year": F.try_divide("_switches", "years"), "turnover_a_year": F.try_divide("_turnover", "years"),
    })
    under = drawdown_stats(rows, keys).select(*keys, (F.col("ulcer") * 100).alias("ulcer"), "max_drawdown", "longest_under_water")
    return g.join(under, keys).select(*keys, "years", "ann_return", "ann_vol", "sharpe", "ulcer", "max_drawdown", "longest_under_water", "switches_a_year", "in_market", "turnover_a_year")


def completed(closes: DataFrame, now: datetime.datetime) -> DataFrame:
    """``closes(symbol, date, close)`` without bars of today that have not closed by ``now`` (UTC), or of later days."""
    return closes.where(F.col("date") <= F.lit(now.date()) if now.hour >= CLOSED_HOUR else F.col("date") < F.lit(now.date()))


def state(closes: DataFrame, target: float = SIGMA, days: float = 252.0) -> DataFrame:
    """At the last close of each symbol: ``as_of, close, sma, ma_in, sessions_in_state, flip_level, sigma_ann, vm_weight, exposure``.

    ``flip_level`` is the next close at which the mean's leg changes: a close is above the mean that includes it exactly if
    it is above the mean of the 199 before. Symbols with too few closes for either leg give no row.
    """
    w = Window.partitionBy("symbol").orderBy("date")
    p = closes.where("close is not null").withColumns({"_n": F.row_number().over(w), "_ret": F.col("close") / F.lag("close").over(w) - 1})
    last = lambda n: w.rowsBetween(1 - n, 0)
    p = p.withColumns({"sma": F.avg("close").over(last(MA)), "flip_level": F.avg("close").over(last(MA - 1)), "_sd": F.stddev_samp("_ret").over(last(VOL))}).where(F.col("_n") >= max(MA, VOL + 1))
    p = p.withColumn("ma_in", F.col("close") > F.col("sma"))
    p = p.withColumn("_since", F.max(F.when(F.coalesce(F.lag("ma_in").over(w) != F.col("ma_in"), F.lit(True)), F.col("_n"))).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    p = p.withColumn("_newest", F.max("_n").over(Window.partitionBy("symbol"))).where("_n = _newest")
    weight = F.coalesce(F.least(F.try_divide(F.lit(target), F.col("_sd")), F.lit(1.0)), F.lit(0.0))
    p = p.withColumns({"sessions_in_state": (F.col("_n") - F.col("_since") + 1).cast("int"), "sigma_ann": F.col("_sd") * F.sqrt(F.lit(days)), "vm_weight": weight})
    return p.select("symbol", F.col("date").alias("as_of"), "close", "sma", "ma_in", "sessions_in_state", "flip_level", "sigma_ann", "vm_weight", F.when(F.col("ma_in"), F.col("vm_weight")).otherwise(0.0).alias("exposure"))


def missing(states: DataFrame, now: datetime.datetime) -> DataFrame:
    """``symbol, date``: sessions after a state's ``as_of`` that have closed by ``now`` (UTC) and have no bar. Any means that the state is old."""
    last = now.date() if now.hour >= CLOSED_HOUR else now.date() - datetime.timedelta(days=1)
    gaps = states.select("symbol", F.explode(F.when(F.col("as_of") < F.lit(last), F.sequence(F.date_add("as_of", 1), F.lit(last)))).alias("date"))
    span = states.agg(F.min("as_of").alias("first"), F.lit(last).alias("last"))
    return gaps.join(calendar.days(span).where("session").select("date"), "date", "left_semi").select("symbol", "date")
