"""Daily factor books: causal signals on long panels of closes, cross-sectional weights, returns."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import SERIES


def panel(bars: DataFrame) -> DataFrame:
    """``date, symbol, close, ret`` of daily bars; the return is over the series' own last bar."""
    p = bars.select(F.to_date(F.timestamp_millis("open_time")).alias("date"), "symbol", "close")
    return p.withColumn("ret", F.col("close") / F.lag("close").over(Window.partitionBy("symbol").orderBy("date")) - 1)


def _past(n: int) -> Window:
    return Window.partitionBy("symbol").orderBy("date").rowsBetween(1 - n, 0)


def full(c: str, n: int, f) -> Column:
    """A trailing aggregate, null until n values are there."""
    return F.when(F.count(c).over(_past(n)) >= n, f(c).over(_past(n)))


def momentum(p: DataFrame, lookback: int, skip: int) -> DataFrame:
    """Return from ``lookback`` to ``skip`` bars ago."""
    w = Window.partitionBy("symbol").orderBy("date")
    return p.withColumn("signal", F.lag("close", skip).over(w) / F.lag("close", lookback).over(w) - 1)


def zscore(p: DataFrame, value: str = "signal") -> DataFrame:
    """Adds ``z``: the value among those of its date."""
    w = Window.partitionBy("date")
    sd = F.stddev_samp(value).over(w)
    return p.withColumn("z", F.when(sd > 0, (F.col(value) - F.avg(value).over(w)) / sd))


def weights(p: DataFrame, value: str = "z", gross: float = 1.0) -> DataFrame:
    """Adds ``weight``: demeaned values scaled to a gross exposure on each date."""
    w = Window.partitionBy("date")
    raw = F.col(value) - F.avg(value).over(w)
    p = p.withColumn("_raw", raw)
    return p.withColumn("weight", F.coalesce(F.try_divide(F.col("_raw") * gross, F.sum(F.abs("_raw")).over(w)), F.lit(0.0))).drop("_raw")


def book_returns(p: DataFrame) -> DataFrame:
    """Per date: the return of the last bar's weights, gross exposure and turnover."""
    w = Window.partitionBy("symbol").orderBy("date")
    p = p.withColumn("_held", F.coalesce(F.lag("weight").over(w), F.lit(0.0)))
    return p.groupBy("date").agg(F.sum(F.col("_held") * F.coalesce("ret", F.lit(0.0))).alias("ret"), F.sum(F.abs("_held")).alias("gross"), F.sum(F.abs(F.col("weight") - F.col("_held"))).alias("turnover"), F.count("*").alias("n"))


def trend_filter(p: DataFrame, n: int = 200) -> DataFrame:
    """Adds the mean of the last n closes and whether the close of the bar before was above it."""
    p = p.withColumn("sma", full("close", n, F.avg))
    return p.withColumn("risk_on", F.lag(F.col("close") > F.col("sma")).over(Window.partitionBy("symbol").orderBy("date")))


def low_volatility(p: DataFrame, n: int = 60, q: float = 0.5) -> DataFrame:
    """Symbols at or under the quantile of trailing volatility on each date, equal weights."""
    p = p.withColumn("vol", full("ret", n, F.stddev_samp)).where("vol is not null")
    p = p.withColumn("cut", F.percentile("vol", q).over(Window.partitionBy("date"))).where("vol <= cut")
    return p.withColumn("weight", 1.0 / F.count("*").over(Window.partitionBy("date")))


def turn_of_month(p: DataFrame, last: int = 1, first: int = 3) -> DataFrame:
    """Mean return on the last and first bars of a month against the rest, per symbol."""
    month = [F.col("symbol"), F.trunc("date", "month")]
    up, down = Window.partitionBy(*month).orderBy("date"), Window.partitionBy(*month).orderBy(F.desc("date"))
    p = p.withColumn("in_turn", (F.row_number().over(up) <= first) | (F.row_number().over(down) <= last)).where("ret is not null")
    return p.groupBy("symbol", "in_turn").agg(F.avg("ret").alias("mean"), F.stddev_samp("ret").alias("sd"), F.count("*").alias("n"))


def gap_fades(bars: DataFrame, least: float = 0.01) -> DataFrame:
    """Opening gaps: size against the close before, and whether the bar traded back to it."""
    before = F.lag("close").over(Window.partitionBy(*SERIES).orderBy("open_time"))
    b = bars.withColumn("prev", before).withColumn("gap", F.col("open") / F.col("prev") - 1).where(F.abs("gap") >= least)
    filled = F.when(F.col("gap") > 0, F.col("low") <= F.col("prev")).otherwise(F.col("high") >= F.col("prev"))
    return b.groupBy(*SERIES, (F.col("gap") > 0).alias("up")).agg(F.count("*").alias("n"), F.avg(filled.cast("double")).alias("filled"), F.avg("gap").alias("mean_gap"))


def seasonal_surprise(eps: DataFrame, history: int = 8, least: int = 4) -> DataFrame:
    """Change of earnings over the same quarter a year before, over its trailing deviation before it."""
    a, b = eps.alias("a"), eps.alias("b")
    d = a.join(b, (F.col("a.symbol") == F.col("b.symbol")) & (F.col("a.fp") == F.col("b.fp")) & (F.col("a.fy") == F.col("b.fy") + 1)).select("a.symbol", "a.fy", "a.fp", (F.col("a.eps") - F.col("b.eps")).alias("change"))
    past = Window.partitionBy("symbol").orderBy("fy", "fp").rowsBetween(-history, -1)
    sd = F.when(F.count("change").over(past) >= least, F.stddev_samp("change").over(past))
    return d.withColumn("sue", F.try_divide("change", sd))


def insider_classes(txns: DataFrame) -> DataFrame:
    """``routine`` if the owner traded in the same month of the three years before, ``opportunistic`` if they traded in
    all three but not in that month, else ``unclassified``."""
    t = txns.withColumns({"y": F.year("date"), "m": F.month("date")})
    seen = t.groupBy("owner").agg(F.collect_set("y").alias("years"), F.collect_set(F.col("y") * 100 + F.col("m")).alias("months"))
    t = t.join(seen, "owner")
    same = F.expr("forall(sequence(y - 3, y - 1), v -> array_contains(months, v * 100 + m))")
    each = F.expr("forall(sequence(y - 3, y - 1), v -> array_contains(years, v))")
    return t.withColumn("class", F.when(same, "routine").when(each, "opportunistic").otherwise("unclassified")).select(*txns.columns, "class")


#: Fast and slow spans of the crossovers with the scalars that bring each to a mean size of ten.
SPEEDS = ((8, 32, 5.3), (16, 64, 3.75), (32, 128, 2.65), (64, 256, 1.91))


def forecasts(p: DataFrame, speeds: tuple = SPEEDS, vol_span: int = 32, fdm: float = 1.25, cap: float = 20.0, weights: tuple[float, ...] | None = None) -> DataFrame:
    """Adds ``vol``, the deviation of returns with exponential weights up to the day before, and ``forecast``: crossovers in
    units of price volatility, scaled and capped, their weighted mean times ``fdm``, capped. Null until the volatility is known.
    """
    spans = sorted({n for f, s, _ in speeds for n in (f, s)})
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in p.schema) + "".join(f", _e{n} double" for n in spans) + ", vol double"

    def run(one: pd.DataFrame) -> pd.DataFrame:
        one = one.sort_values("date")
        vol = (one["close"] / one["close"].shift() - 1).ewm(span=vol_span, min_periods=vol_span).std().shift()
        return one.assign(**{f"_e{n}": one["close"].ewm(span=n, adjust=False).mean() for n in spans}, vol=vol)

    x = p.groupBy("symbol").applyInPandas(run, schema)
    clip = lambda c: F.greatest(F.least(c, F.lit(cap)), F.lit(-cap))
    w = weights or (1.0,) * len(speeds)
    parts = [clip(F.try_divide(F.col(f"_e{f}") - F.col(f"_e{s}"), F.col("vol") * F.col("close")) * k) * v for (f, s, k), v in zip(speeds, w, strict=True)]
    return x.withColumn("forecast", F.when(F.col("vol").isNotNull(), clip(sum(parts[1:], parts[0]) / sum(w) * fdm))).drop(*(f"_e{n}" for n in spans))


def sized(f: DataFrame, target: float = 0.2, cost: float = 0.0003, days: float = 252.0, long_only: bool = False) -> DataFrame:
    """Adds ``leverage``, the day before's forecast at a yearly volatility target, and ``gross``, ``cost`` of its change, ``net``."""
    w = Window.partitionBy("symbol").orderBy("date")
    held = F.lag(F.greatest("forecast", F.lit(0.0)) if long_only else "forecast").over(w)
    f = f.withColumn("leverage", F.try_divide(held / 10 * target, F.col("vol") * F.sqrt(F.lit(days))))
    f = f.withColumns({"gross": F.col("leverage") * F.col("ret"), "cost": F.abs(F.col("leverage") - F.coalesce(F.lag("leverage").over(w), F.lit(0.0))) * cost})
    return f.withColumn("net", F.col("gross") - F.col("cost"))


def governed(s: DataFrame, target: float = 0.2, window: int = 64, least: float = 0.5, most: float = 1.5, days: float = 252.0, keys: tuple[str, ...] = (), total=F.avg) -> DataFrame:
    """Per date: the ``total`` (mean or sum) of the net returns of the symbols that have one, and the same scaled to the volatility
    target by the book's own trailing volatility up to the day before; nothing is held until that is known. ``keys`` tell books apart."""
    b = s.groupBy(*keys, "date").agg(F.coalesce(total("net"), F.lit(0.0)).alias("pre"), F.count("net").alias("active"))
    w = Window.partitionBy(*keys).orderBy("date")  # a row a date and book
    vol = F.when(F.count("pre").over(w.rowsBetween(1 - window, 0)) == window, F.stddev_samp("pre").over(w.rowsBetween(1 - window, 0)))
    b = b.withColumn("_vol", vol).withColumn("governor", F.greatest(F.least(F.try_divide(F.lit(target), F.lag("_vol").over(w) * F.sqrt(F.lit(days))), F.lit(most)), F.lit(least)))
    b = b.withColumn("governor", F.when(F.lag("_vol").over(w).isNotNull(), F.col("governor")))
    return b.withColumn("ret", F.coalesce(F.col("governor"), F.lit(0.0)) * F.col("pre")).drop("_vol")


def cross_sectional(f: DataFrame, target: float = 0.2, cost: float = 0.0003, days: float = 252.0, neutral: bool = False) -> DataFrame:
    """Forecasts as a long-short book: demeaned over the date's symbols, held from the day after, each sized to the volatility
    target; ``neutral`` also centres the sizes, so that they sum to nothing on each date. Adds ``leverage, gross, cost, net``.

    ``f`` has ``date, symbol, ret, vol, forecast``; what a symbol earns is ``ret``, whatever its forecast was made of.
    """
    x = sized(demeaned(f), target, cost, days)
    if neutral:
        w = Window.partitionBy("symbol").orderBy("date")
        x = x.withColumn("leverage", F.col("leverage") - F.avg("leverage").over(Window.partitionBy("date")))
        x = x.withColumns({"gross": F.col("leverage") * F.col("ret"), "cost": F.abs(F.col("leverage") - F.coalesce(F.lag("leverage").over(w), F.lit(0.0))) * cost})
        x = x.withColumn("net", F.col("gross") - F.col("cost"))
    return x


def residual_closes(p: DataFrame, window: int = 252, least: int = 3, most: float = 0.99) -> DataFrame:
    """``residuals`` with the price path that what the market doesn't explain would give as ``close``, and ``own``, the symbol's return.

    Dates with residuals of fewer than ``least`` symbols are left out: of one or two, the market explains all. The path moves by
    at most ``most`` a day, so that it stays above zero.
    """
    up = Window.partitionBy("symbol").orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    r = residuals(p, window).where("resid is not null").withColumn("_n", F.count("*").over(Window.partitionBy("date"))).where(F.col("_n") >= least)
    return r.select("date", "symbol", F.exp(F.sum(F.log1p(F.greatest(F.least(F.col("resid"), F.lit(most)), F.lit(-most)))).over(up)).alias("close"), F.col("resid").alias("ret"), F.col("ret").alias("own"))


def demeaned(f: DataFrame, value: str = "forecast", by: tuple[str, ...] = ()) -> DataFrame:
    """The value less its mean on the date, within groups such as sectors."""
    w = Window.partitionBy("date", *by)
    return f.withColumn(value, F.col(value) - F.avg(value).over(w))


def residuals(p: DataFrame, window: int = 252) -> DataFrame:
    """Adds ``market``, the mean return of the date, ``beta``, of the window up to the day before, and ``resid``, what the market
    times beta doesn't explain."""
    w = Window.partitionBy("symbol").orderBy("date")
    p = p.where("ret is not null").withColumn("market", F.avg("ret").over(Window.partitionBy("date")))
    past = w.rowsBetween(-window, -1)
    p = p.withColumn("beta", F.when(F.count("ret").over(past) >= window, F.try_divide(F.covar_samp("ret", "market").over(past), F.var_samp("market").over(past))))
    return p.withColumn("resid", F.col("ret") - F.col("beta") * F.col("market"))


def beta_neutral(p: DataFrame, score: str = "signal", gross: float = 1.0) -> DataFrame:
    """Adds ``weight``: the score demeaned and then made free of beta on each date, scaled to a gross exposure; nothing is held
    where beta explains all of it, as with two symbols."""
    w = Window.partitionBy("date")
    p = p.where(F.col(score).isNotNull() & F.col("beta").isNotNull())
    p = p.withColumns({"_s": F.col(score) - F.avg(score).over(w), "_b": F.col("beta") - F.avg("beta").over(w)})
    slope = F.try_divide(F.sum(F.col("_s") * F.col("_b")).over(w), F.sum(F.col("_b") * F.col("_b")).over(w))
    p = p.withColumn("_raw", F.col("_s") - F.coalesce(slope, F.lit(0.0)) * F.col("_b"))
    all_ = F.sum(F.abs("_raw")).over(w)
    return p.withColumn("weight", F.when(all_ > 1e-9 * F.sum(F.abs("_s")).over(w), F.col("_raw") * gross / all_).otherwise(0.0)).drop("_s", "_b", "_raw")


def subperiods(rets: DataFrame, n: int = 4, days: float = 252.0) -> DataFrame:
    """Mean, deviation and yearly Sharpe ratio of a book's returns in equal parts of its dates."""
    r = rets.withColumn("part", F.ntile(n).over(Window.orderBy("date")))
    return r.groupBy("part").agg(F.min("date").alias("first"), F.count("*").alias("n"), F.avg("ret").alias("mean"), F.stddev_samp("ret").alias("sd")).withColumn("sharpe", F.try_divide("mean", "sd") * F.sqrt(F.lit(days)))


def vol_overlay(p: DataFrame, target: float = 0.1, window: int = 20, most: float = 1.0, n: int = 200, days: float = 252.0) -> DataFrame:
    """Adds ``weight``: on where the close of the day before was above its mean of ``n``, at most ``most``, sized to a volatility
    target by the window up to the day before; and ``arm``, the return that gives."""
    w = Window.partitionBy("symbol").orderBy("date")
    p = trend_filter(p, n).withColumn("_vol", full("ret", window, F.stddev_samp))
    size = F.least(F.try_divide(F.lit(target), F.lag("_vol").over(w) * F.sqrt(F.lit(days))), F.lit(most))
    p = p.withColumn("weight", F.when(F.col("risk_on") & F.lag("_vol").over(w).isNotNull(), size).otherwise(0.0))
    return p.withColumn("arm", F.col("weight") * F.coalesce("ret", F.lit(0.0))).drop("_vol")


def drawdown(rets: DataFrame, order: str = "date", keys: tuple[str, ...] = ()) -> DataFrame:
    """Running wealth, its peak and drawdown of a return series."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    r = rets.withColumn("wealth", F.exp(F.sum(F.log1p("ret")).over(w)))
    r = r.withColumn("peak", F.greatest(F.lit(1.0), F.max("wealth").over(w)))
    return r.withColumn("drawdown", F.col("wealth") / F.col("peak") - 1)
