"""What a gate would have dropped: trades under the regime of their entry, and whether to turn the gate on."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.resampling import audit_cells
from ..sources.tables import as_of

UNKNOWN = "unknown"
FLIP, BLOCKED, HOLD = "FLIP justified", "DO NOT FLIP", "HOLD"


def annotate_regime(trades: DataFrame, regimes: DataFrame, at: str = "entry_time") -> DataFrame:
    """Trades with ``regime``: that of the last bar of their symbol that had closed at entry, one back from the bar that holds it.

    ``regimes`` has ``symbol, open_time, regime``. Found by place among the bars, not by rounding times, so any grid will do;
    entries before the second bar, and bars without a label, are ``unknown``.
    """
    x = as_of(trades, regimes.select("symbol", "open_time", F.col("regime").alias("_regime")), ["symbol"], at, "open_time", ["_regime"], lag=1)
    return x.withColumn("regime", F.coalesce("_regime", F.lit(UNKNOWN))).drop("_regime", "matched_time")


def annotate_suppression(trades: DataFrame, allowed: dict[str, list[str]]) -> DataFrame:
    """Trades with ``suppressed``: their strategy is not among those ``allowed`` in their regime; an unknown regime drops nothing.

    A regime that ``allowed`` doesn't name allows all.
    """
    dropped = F.lit(False)
    for regime, names in sorted(allowed.items()):
        dropped = F.when(F.col("regime") == regime, ~F.col("strategy").isin(*names) if names else F.lit(True)).otherwise(dropped)
    return trades.withColumn("suppressed", F.coalesce((F.col("regime") != UNKNOWN) & dropped, F.lit(False)))


def kept_and_dropped(trades: DataFrame, keys: tuple[str, ...] = ("strategy", "regime"), value: str = "pnl_r") -> DataFrame:
    """Per cell and side of the gate: count, mean and share of gains."""
    return trades.where(F.col(value).isNotNull()).groupBy(*keys, "suppressed").agg(F.count("*").alias("n"), F.avg(value).alias("avg_r"), F.avg((F.col(value) > 0).cast("double")).alias("win_rate"))


def flip(trades: DataFrame, day: str = "day", value: str = "pnl_r", **how) -> DataFrame:
    """The verdict of each strategy's cell, with ``flip``, the same for all: whether to turn the gate on.

    One switch turns it on for all, so a single cell whose dropped trades reliably win blocks it; else a single one whose
    dropped trades reliably lose is enough. ``how`` goes to ``audit_cells``.
    """
    cells = audit_cells(trades, ["strategy"], "suppressed", day, value, **how)
    all_ = Window.partitionBy()  # a row a strategy
    has = lambda *names: F.max(F.col("decision").isin(*names).cast("int")).over(all_) == 1
    return cells.withColumn("flip", F.when(has("DISABLE", "CONCENTRATE"), BLOCKED).when(has("ENABLE"), FLIP).otherwise(HOLD))
