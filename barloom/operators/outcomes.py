"""The outcome ledger: resolving alerts on later bars, and reports on it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.tables import SERIES
from .exits import behind


def resolve(bars: DataFrame, alerts: DataFrame, max_hold: int = 48) -> DataFrame:
    """Alerts ``(symbol, timeframe, open_time, direction, entry, sl, tp)`` with outcome and R.

    The first bar after the alert's that touches a level decides, the stop first; after ``max_hold`` bars without a
    touch the alert is expired at the last close; with fewer bars it stays open (nulls).
    """
    a = alerts.join(behind(bars, alerts, max_hold).withColumnRenamed("_w", "_ahead"), [*SERIES, "open_time"])
    a = a.withColumn("_long", F.col("direction") == "long")
    a = a.withColumn("_x", F.expr("try_element_at(filter(_ahead, x -> if(_long, x.low <= sl or x.high >= tp, x.high >= sl or x.low <= tp)), 1)"))
    stop = F.expr("if(_long, _x.low <= sl, _x.high >= sl)")
    a = a.withColumn("outcome", F.when(F.col("_x").isNotNull(), F.when(stop, "loss").otherwise("win")).when(F.size("_ahead") >= max_hold, "expired"))
    price = F.when(F.col("outcome") == "loss", F.col("sl")).when(F.col("outcome") == "win", F.col("tp")).when(F.col("outcome") == "expired", F.expr("try_element_at(_ahead, -1).close"))
    sign = F.when(F.col("_long"), 1.0).otherwise(-1.0)
    r = F.try_divide((price - F.col("entry")) * sign, F.abs(F.col("entry") - F.col("sl")))
    return a.withColumn("outcome_r", r).withColumn("resolved_at", F.when(F.col("outcome") == "expired", F.expr("try_element_at(_ahead, -1).open_time")).otherwise(F.col("_x.open_time"))).select(*alerts.columns, "outcome", "outcome_r", "resolved_at")


def totals(ledger: DataFrame) -> DataFrame:
    """One row of counts by state."""
    is_ = lambda o: F.count_if(F.col("outcome") == o)
    return ledger.agg(F.count("*").alias("total_rows"), F.count("outcome").alias("resolved"), F.count_if(F.col("outcome").isNull()).alias("open_rows"), is_("win").alias("wins"), is_("loss").alias("losses"), is_("expired").alias("expired"))


def cells(ledger: DataFrame, keys: list[str], least: int = 1) -> DataFrame:
    """Resolved rows per cell; the win rate leaves expired ones out."""
    is_ = lambda o: F.count_if(F.col("outcome") == o)
    win = F.avg(F.when(F.col("outcome") == "win", 1.0).when(F.col("outcome") == "loss", 0.0))
    out = ledger.where("outcome is not null").groupBy(*keys).agg(F.count("*").alias("n"), is_("win").alias("wins"), is_("loss").alias("losses"), is_("expired").alias("expired"), win.alias("win_rate"), F.avg("outcome_r").alias("avg_r"))
    return out.where(F.col("n") >= least)


def marked(ledger: DataFrame, bars: DataFrame) -> DataFrame:
    """Open rows at the newest close of their symbol: unrealised R and the distance to both levels in R."""
    marks = bars.groupBy("symbol").agg(F.max_by("close", F.struct("open_time", "timeframe")).alias("mark"))
    sign, risk = F.when(F.col("direction") == "long", 1.0).otherwise(-1.0), F.abs(F.col("entry") - F.col("sl"))
    o = ledger.where("outcome is null").join(marks, "symbol", "left")
    return o.select(*[c for c in ledger.columns if c not in ("outcome", "outcome_r", "resolved_at")], "mark", F.try_divide((F.col("mark") - F.col("entry")) * sign, risk).alias("open_r"), F.try_divide((F.col("mark") - F.col("sl")) * sign, risk).alias("to_stop"), F.try_divide((F.col("tp") - F.col("mark")) * sign, risk).alias("to_target"))
