"""Indicators of bar series: windows where rows suffice, a fold over the series where each value needs the last."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import SERIES, series


def ema(bars: DataFrame, spans: dict[str, int], value: str = "close") -> DataFrame:
    """Adds exponential means (weight 2 / (span + 1), first value as seed), one column per name."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in bars.schema) + "".join(f", `{n}` double" for n in spans)

    def run(one: pd.DataFrame) -> pd.DataFrame:
        one = one.sort_values("open_time")
        return one.assign(**{n: one[value].ewm(span=s, adjust=False).mean() for n, s in spans.items()})

    return bars.groupBy(*SERIES).applyInPandas(run, schema)


def wilder_atr(bars: DataFrame, period: int = 14, name: str = "atr") -> DataFrame:
    """Adds Wilder's mean of true ranges; the first range is high minus low."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in bars.schema) + f", `{name}` double"

    def run(one: pd.DataFrame) -> pd.DataFrame:
        one = one.sort_values("open_time")
        last = one["close"].shift()
        tr = pd.concat([one["high"] - one["low"], (one["high"] - last).abs(), (one["low"] - last).abs()], axis=1).max(axis=1)
        return one.assign(**{name: tr.ewm(alpha=1 / period, adjust=False).mean()})

    return bars.groupBy(*SERIES).applyInPandas(run, schema)


def true_range() -> Column:
    """Null on the first bar of a series."""
    last = F.lag("close").over(series())
    return F.when(last.isNotNull(), F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - last), F.abs(F.col("low") - last)))


def atr_mean(bars: DataFrame, period: int = 14, name: str = "atr14") -> DataFrame:
    """Adds the plain mean of up to ``period`` true ranges; null on the first bar or where it isn't positive."""
    out = bars.withColumn("_tr", true_range())
    mean = F.avg("_tr").over(series().rowsBetween(1 - period, 0))
    return out.withColumn(name, F.when(mean > 0, mean)).drop("_tr")


def volume_flags(bars: DataFrame, lookback: int = 20) -> DataFrame:
    """Adds ``vol_ok`` (at least 1.5 times the mean of prior bars, or none known), ``low_volume`` and ``volume_spike``."""
    mean = F.avg("volume").over(series().rowsBetween(-lookback, -1))
    known = F.coalesce(mean, F.lit(0.0)) > 0
    v = F.col("volume")
    return bars.withColumns({"vol_ok": ~known | (v >= 1.5 * mean), "low_volume": known & (v < 1.5 * mean), "volume_spike": known & (v > 3 * mean)}).fillna(False, ["low_volume", "volume_spike"]).fillna(True, ["vol_ok"])


def regime(bars: DataFrame, slope_threshold: float = 0.005, window: int = 630, least: int = 50) -> DataFrame:
    """Adds ``regime``: range, trend where the 50-bar mean moved enough in ten bars, high_vol where ATR% is at or above
    its rolling 80th percentile, unknown where either isn't known."""
    x = wilder_atr(ema(bars, {"ema50": 50}))
    before = F.lag("ema50", 10).over(series())
    x = x.withColumns({"slope": (F.col("ema50") - before) / before, "atr_pct": F.col("atr") / F.col("close")})
    trailing = series().rowsBetween(1 - window, 0)
    x = x.withColumn("p80", F.when(F.count("atr_pct").over(trailing) >= least, F.expr("percentile(atr_pct, 0.8)").over(trailing)))
    label = F.when(F.col("slope").isNull() | F.col("p80").isNull() | F.col("atr_pct").isNull(), "unknown").when(F.col("atr_pct") >= F.col("p80"), "high_vol").when(F.abs("slope") >= slope_threshold, "trend").otherwise("range")
    return x.withColumn("regime", label)


def ema_slope(bars: DataFrame, period: int = 50, lookback: int = 10) -> DataFrame:
    """Adds ``slope``: the relative change of an exponential mean over some bars, null before they are there."""
    before = F.lag("_ema", lookback).over(series())
    return ema(bars, {"_ema": period}).withColumn("slope", F.try_divide(F.col("_ema") - before, before)).drop("_ema")


def day_of(open_time: str = "open_time", zone: str = "UTC", shift_hours: int = 0) -> Column:
    ts = F.timestamp_millis(F.col(open_time) + shift_hours * 3_600_000)
    return F.to_date(F.from_utc_timestamp(ts, zone) if zone != "UTC" else ts)


def seasonality(bars: DataFrame) -> DataFrame:
    """Mean return in percent, win rate and count by weekday (Monday 0), hour and week of the month, in UTC."""
    ts = F.timestamp_millis("open_time")
    ret = (F.col("close") / F.lag("close").over(series()) - 1) * 100
    rows = bars.select(*SERIES, ret.alias("ret"), F.weekday(ts).alias("weekday"), F.hour(ts).alias("hour"), (F.floor((F.dayofmonth(ts) - 1) / 7) + 1).cast("int").alias("week")).where("ret is not null")
    keyed = rows.select(*SERIES, "ret", F.expr("stack(3, 'weekday', weekday, 'hour', hour, 'week_of_month', week) as (kind, bucket)"))
    return keyed.groupBy(*SERIES, "kind", "bucket").agg(F.avg("ret").alias("avg_return"), F.avg((F.col("ret") > 0).cast("double")).alias("win_rate"), F.count("*").alias("n"))


def rolling_beta(panel: DataFrame, window: int, y: str = "ret", x: str = "market") -> Column:
    """Trailing covariance over variance, null before the window is full."""
    w = Window.partitionBy("symbol").orderBy("date").rowsBetween(1 - window, 0)
    return F.when(F.count(F.col(y) * F.col(x)).over(w) >= window, F.covar_samp(y, x).over(w) / F.var_samp(x).over(w))
