"""Alerts under other exits: replay of policies over the bars after each, excursions, cohorts."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import SERIES, series


@dataclass(frozen=True)
class Policy:
    """A target in R, a time stop after ``hold`` bars, a stop moved to the entry from the bar after ``breakeven_r`` is
    reached, and a part of the position taken off at ``partial_r``."""

    name: str
    tp_r: float
    hold: int
    breakeven_r: float | None = None
    partial: float = 0.0
    partial_r: float = 0.0

    def __post_init__(self) -> None:
        if self.tp_r <= 0 or self.hold <= 0 or not 0 <= self.partial < 1 or self.partial and self.partial_r <= 0 or self.breakeven_r is not None and self.breakeven_r <= 0:
            raise ValueError(f"bad policy {self}")


def behind(bars: DataFrame, alerts: DataFrame, n: int) -> DataFrame:
    """``symbol, timeframe, open_time, _w``: the next ``n`` bars of each alert that stands at a bar.

    Bars that no alert needs go before the alerts' own are collected.
    """
    w = series()
    rows = bars.select(*SERIES, "open_time", F.struct("open_time", "high", "low", "close").alias("_bar"), F.row_number().over(w).alias("_k"))
    marks = alerts.select(*SERIES, "open_time").distinct().withColumn("_mark", F.lit(True))
    rows = rows.join(marks, [*SERIES, "open_time"], "left").withColumn("_since", F.last(F.when(F.col("_mark"), F.col("_k")), True).over(w))
    rows = rows.where(F.col("_k") - F.col("_since") <= n)  # none before the first alert
    return rows.withColumn("_w", F.collect_list("_bar").over(w.rowsBetween(1, n))).where("_mark").select(*SERIES, "open_time", "_w")


def _after(bars: DataFrame, alerts: DataFrame, n: int) -> DataFrame:
    """Alerts with the next ``n`` bars as ``_w``; those without any are left out."""
    return alerts.join(behind(bars, alerts, n), [*SERIES, "open_time"]).where("size(_w) > 0")


def replay_all(bars: DataFrame, alerts: DataFrame, policies: list[Policy], tp_r: Column | None = None) -> DataFrame:
    """Alerts ``(symbol, timeframe, open_time, direction, entry, sl)`` with ``policy, outcome, realized_r, exit_bar, partial_taken``, a row a policy.

    On one bar the stop comes first, then the part, then the target, then the time stop. Without an exit the last bar's close
    counts. ``exit_bar`` counts from 0 after the alert. Alerts without risk or without later bars give no row. ``tp_r`` as a
    column stands for the policies'. The bars behind an alert are collected once, for the longest policy.
    """
    table = F.array(*(F.struct(F.lit(p.name).alias("name"), F.lit(p.tp_r).cast("double").alias("tp_r"), F.lit(p.hold).alias("hold"), F.lit(p.breakeven_r).cast("double").alias("even"), F.lit(p.partial).cast("double").alias("part"), F.lit(p.partial_r).cast("double").alias("part_r")) for p in policies))
    a = _after(bars, alerts.withColumn("_own", F.lit(None).cast("double") if tp_r is None else tp_r), max(p.hold for p in policies))
    a = a.withColumns({"_s": F.when(F.col("direction") == "long", 1.0).otherwise(-1.0), "_risk": F.abs(F.col("entry") - F.col("sl"))}).where("_risk > 0")
    a = a.withColumn("_p", F.explode(table)).withColumn("_tp", F.coalesce("_own", "_p.tp_r"))
    a = a.withColumn("_r", F.expr("transform(slice(_w, 1, _p.hold), (x, i) -> struct(if(_s > 0, x.high - entry, entry - x.low) / _risk as fav, if(_s > 0, x.low - entry, entry - x.high) / _risk as adv, (x.close - entry) * _s / _risk as c, i as i))"))
    eps = "1e-12D"
    took = f"(_p.part > 0 and not a.part and x.fav >= _p.part_r - {eps})"
    left, got = f"(a.left_ - if({took}, _p.part, 0D))", f"(a.got + if({took}, _p.part * _p.part_r, 0D))"
    stop = f"if(_p.even is not null and x.fav >= _p.even - {eps}, greatest(a.stop, 0D), a.stop)"

    def state(stop_at: str, part: str, rest: str, sum_: str, out: str, bar: str) -> str:
        return f"named_struct('stop', {stop_at}, 'part', {part}, 'left_', {rest}, 'got', {sum_}, 'out', {out}, 'bar', {bar})"

    step = f"""case when a.out is not null then a
      when x.adv <= a.stop + {eps} then {state('a.stop', 'a.part', 'a.left_', 'a.got + a.left_ * a.stop', "if(a.stop <= -1 + 1e-9D, 'loss', 'breakeven')", 'x.i')}
      when x.fav >= _tp - {eps} then {state('a.stop', f'(a.part or {took})', left, f'{got} + {left} * _tp', "'win'", 'x.i')}
      when x.i + 1 >= size(_r) then {state('a.stop', f'(a.part or {took})', left, f'{got} + {left} * x.c', "'expired'", 'x.i')}
      else {state(stop, f'(a.part or {took})', left, got, 'cast(null as string)', '-1')} end"""
    begin = state("-1D", "false", "1D", "0D", "cast(null as string)", "-1")
    a = a.withColumn("_x", F.expr(f"aggregate(_r, {begin}, (a, x) -> {step})"))
    return a.select(*alerts.columns, F.col("_p.name").alias("policy"), F.col("_x.out").alias("outcome"), F.col("_x.got").alias("realized_r"), F.col("_x.bar").alias("exit_bar"), F.col("_x.part").alias("partial_taken"))


def replay(bars: DataFrame, alerts: DataFrame, policy: Policy, tp_r: Column | None = None) -> DataFrame:
    """``replay_all`` under one policy."""
    return replay_all(bars, alerts, [policy], tp_r)


def compare(bars: DataFrame, alerts: DataFrame, policies: list[Policy], keys: list[str]) -> DataFrame:
    """Per policy and cell: trades, mean and deviation of R, share of gains, and the mean gain over the first policy."""
    rows = replay_all(bars, alerts, policies).select(*SERIES, "open_time", "direction", *(k for k in keys if k not in (*SERIES, "direction")), "policy", "realized_r")
    base = F.max(F.when(F.col("policy") == policies[0].name, F.col("realized_r"))).over(Window.partitionBy(*SERIES, "open_time", "direction"))
    rows = rows.withColumn("_base", base)
    return rows.groupBy("policy", *keys).agg(F.count("*").alias("n"), F.avg("realized_r").alias("avg_r"), F.stddev_samp("realized_r").alias("sd_r"), F.avg((F.col("realized_r") > 0).cast("double")).alias("win_rate"), F.avg(F.col("realized_r") - F.col("_base")).alias("gain"))


def implied_tp_r(entry: Column, sl: Column, tp: Column, declared: Column, long: Column) -> Column:
    """The multiple of risk that a target is at; the declared one where there is no target, or none on its side, or no risk."""
    r = F.try_divide((tp - entry) * F.when(long, 1.0).otherwise(-1.0), F.abs(entry - sl))
    return F.when(r > 0, r).otherwise(declared)


def excursions(bars: DataFrame, ledger: DataFrame, hold: int, rr: float = 2.0) -> DataFrame:
    """Resolved alerts with the largest move for and against them, in R, up to the bar that resolved them, and bars held.

    Before a stop, the exit bar's move for an alert doesn't count; a target reached counts as such. Rows without risk or bars
    are left out.
    """
    a = _after(bars, ledger.where("outcome is not null"), hold).withColumns({"_long": F.col("direction") == "long", "_risk": F.abs(F.col("entry") - F.col("sl"))})
    a = a.withColumn("_w", F.expr("filter(_w, x -> x.open_time <= resolved_at)")).where("_risk > 0 and size(_w) > 0")
    a = a.withColumns({"_f": F.expr("transform(_w, x -> if(_long, x.high - entry, entry - x.low) / _risk)"), "_a": F.expr("transform(_w, x -> if(_long, entry - x.low, x.high - entry) / _risk)")})
    a = a.withColumn("tp_r", implied_tp_r(F.col("entry"), F.col("sl"), F.col("tp"), F.lit(rr), F.col("_long")))
    before = F.coalesce(F.array_max(F.expr("slice(_f, 1, size(_f) - 1)")), F.lit(0.0))
    mfe = F.when(F.col("outcome") == "loss", before).when(F.col("outcome") == "win", F.greatest(before, F.col("tp_r"))).otherwise(F.array_max("_f"))
    return a.select(*ledger.columns, "tp_r", F.greatest(mfe, F.lit(0.0)).alias("mfe_r"), F.greatest(F.array_max("_a"), F.lit(0.0)).alias("mae_r"), F.size("_w").alias("bars_held"))


def cohorts(rows: DataFrame, by: list[str], least: int = 30) -> DataFrame:
    """Per outcome and cell of enough rows: means and medians of excursions, how many reached half and all of the risk."""
    reach = lambda x: F.avg((F.col("mfe_r") >= x).cast("double"))
    out = rows.groupBy("outcome", *by).agg(
        F.count("*").alias("n"), F.avg("mfe_r").alias("mfe_mean"), F.median("mfe_r").alias("mfe_p50"), F.avg("mae_r").alias("mae_mean"), F.median("mae_r").alias("mae_p50"),
        reach(0.5).alias("reach_05"), reach(1.0).alias("reach_10"), F.median("tp_r").alias("tp_r_p50"), F.median("bars_held").alias("bars_held_p50"), F.avg("outcome_r").alias("outcome_r_mean"),
    )
    return out.where(F.col("n") >= least)
