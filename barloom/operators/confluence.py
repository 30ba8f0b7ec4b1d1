"""Signals that fire together: on one clock, across timeframes, and the best known pairs."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import SERIES
from .simulate import Rules, metrics, simulate


def cofire(bars: DataFrame, a: DataFrame, b: DataFrame, window: int = 5) -> DataFrame:
    """Pairs of same-direction signals at most ``window`` bars apart, each used once.

    Signals of ``a`` choose in order the nearest free one of ``b``, ties the earlier: greedy, so a fold per series and
    direction. The pair stands at the later signal's bar, with its stop.
    """
    at = bars.select(*SERIES, "open_time", F.row_number().over(Window.partitionBy(*SERIES).orderBy("open_time")).alias("idx"))
    cols = [*SERIES, "direction", "open_time", "idx", "sl_price"]
    left, right = (x.join(at, [*SERIES, "open_time"]).select(*cols).toDF(*cols) for x in (a, b))

    def run(x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        x, y = x.sort_values("idx"), y.sort_values("idx").reset_index(drop=True)
        free, out = [True] * len(y), []
        at = y["idx"].to_numpy()
        for r in x.itertuples():
            lo, hi = at.searchsorted(r.idx - window), at.searchsorted(r.idx + window, "right")
            best = min(((abs(at[j] - r.idx), j) for j in range(lo, hi) if free[j]), default=None)
            if best:
                free[best[1]] = False
                other = y.iloc[best[1]]
                later = r if r.idx >= other["idx"] else other
                get = (lambda k: getattr(later, k)) if later is r else (lambda k: later[k])  # noqa: B023
                out.append((r.symbol, r.timeframe, r.direction, get("open_time"), get("sl_price"), int(r.idx), int(other["idx"])))
        return pd.DataFrame(out, columns=["symbol", "timeframe", "direction", "open_time", "sl_price", "idx_a", "idx_b"])

    return left.groupBy(*SERIES, "direction").cogroup(right.groupBy(*SERIES, "direction")).applyInPandas(run, "symbol string, timeframe string, direction string, open_time long, sl_price double, idx_a int, idx_b int")


def cross_timeframe(high: DataFrame, low: DataFrame, window_ms: int) -> DataFrame:
    """Lower-timeframe signals with a same-direction signal of the higher one in the ``window_ms`` before or at them.

    Only the latest higher signal matters, so both go in one sorted stream and nothing is paired.
    """
    w = Window.partitionBy("symbol", "direction").orderBy("open_time", "_side").rowsBetween(Window.unboundedPreceding, 0)
    both = low.withColumn("_side", F.lit(1)).unionByName(high.select("symbol", "direction", "open_time").withColumn("_side", F.lit(0)), allowMissingColumns=True)
    both = both.withColumn("_last", F.last(F.when(F.col("_side") == 0, F.col("open_time")), True).over(w))
    return both.where((F.col("_side") == 1) & (F.col("_last") >= F.col("open_time") - window_ms)).select(*low.columns)


def best_pairs(combos: DataFrame) -> DataFrame:
    """Best mean R per (symbol, timeframe, unordered pair)."""
    pair = F.array_sort(F.array("strategy_a", "strategy_b"))
    return combos.groupBy("symbol", "timeframe", pair[0].alias("first"), pair[1].alias("second")).agg(F.max("avg_r").alias("best_avg_r"), F.count("*").alias("n"))


def alive(signals: DataFrame, least: int = 3) -> DataFrame:
    """Signals of the series that have enough of them."""
    enough = signals.groupBy(*SERIES).agg(F.count("*").alias("_n")).where(F.col("_n") >= least)
    return signals.join(enough.select(*SERIES), list(SERIES), "left_semi")


def backtest_pair(bars: DataFrame, a: DataFrame, b: DataFrame, name: str, window: int = 5, rules: Rules = Rules(), least: int = 3) -> DataFrame:
    """Metrics of trades on signals of ``a`` and ``b`` that fire together; series where either has under ``least`` have none."""
    x, y = alive(a, least), alive(b, least)
    return metrics(simulate(bars, cofire(bars, x, y, window).withColumn("strategy", F.lit(name)), rules))


def backtest_cross(low_bars: DataFrame, high: DataFrame, low: DataFrame, name: str, window_ms: int, rules: Rules = Rules(), least: int = 3) -> DataFrame:
    """Metrics of trades on lower-timeframe signals that a higher one stands behind, on the lower one's bars."""
    x, y = alive(high, least), alive(low, least)
    return metrics(simulate(low_bars, cross_timeframe(x, y, window_ms).withColumn("strategy", F.lit(name)), rules))


def live_cofire(bars: DataFrame, signals: DataFrame, lookup: DataFrame, window: int = 5, least: float = 0.0) -> DataFrame:
    """For each bar and direction with signals, the best pair that one of them makes with another strategy's signal.

    ``symbol, timeframe, direction, open_time, strategy, co_strategy, candles_ago, avg_r, closed_trades, win_rate``. The other stands at the
    same bar or up to ``window`` bars before, in the same direction; ``lookup(symbol, timeframe, first, second, avg_r, closed_trades, win_rate)``
    knows what a pair, by names in order, was worth, ``least`` or more. Of equal ones the most recent wins, then names. A signal
    is put to the bars that it can still pair at, so partners meet by equal bar numbers.
    """
    at = bars.select(*SERIES, "open_time", F.row_number().over(Window.partitionBy(*SERIES).orderBy("open_time")).alias("idx"))
    s = signals.select(*SERIES, "direction", "open_time", "strategy").distinct().join(at, [*SERIES, "open_time"])
    past = s.select(*SERIES, "direction", F.col("strategy").alias("co_strategy"), F.col("idx").alias("_from"), F.explode(F.sequence("idx", F.col("idx") + window)).alias("idx"))
    past = past.groupBy(*SERIES, "direction", "co_strategy", "idx").agg((F.col("idx") - F.max("_from")).cast("int").alias("candles_ago"))
    both = s.join(past, [*SERIES, "direction", "idx"]).where("strategy <> co_strategy")
    both = both.where("candles_ago > 0 or strategy < co_strategy")  # at one bar each pair stands once
    pair = lookup.where(F.col("avg_r") >= least).select(*SERIES, "first", "second", "avg_r", "closed_trades", "win_rate")
    both = both.withColumns({"first": F.least("strategy", "co_strategy"), "second": F.greatest("strategy", "co_strategy")}).join(pair, [*SERIES, "first", "second"])
    best = F.min_by(F.struct("strategy", "co_strategy", "candles_ago", "avg_r", "closed_trades", "win_rate"), F.struct(-F.col("avg_r"), "candles_ago", "strategy", "co_strategy"))
    return both.groupBy(*SERIES, "direction", "open_time").agg(best.alias("b")).select(*SERIES, "direction", "open_time", "b.*")


def live_cross(low: DataFrame, high: DataFrame, lookup: DataFrame, window_ms: int, low_ms: int, least: float = 0.0) -> DataFrame:
    """For each lower-timeframe time and direction, the best pair with a higher timeframe's signal in the ``window_ms`` up to it.

    ``symbol, timeframe, direction, open_time, strategy, co_timeframe, co_strategy, candles_ago, avg_r, closed_trades, win_rate``, ``candles_ago`` in
    bars of ``low_ms``. ``lookup(symbol, high, low, strategy_high, strategy_low, ...)`` has the worth of pairs. Only a strategy's
    latest signal can count, so both sides are cut in buckets as wide as the window and meet in two of them.
    """
    h = high.select("symbol", F.col("timeframe").alias("co_timeframe"), "direction", F.col("strategy").alias("co_strategy"), F.col("open_time").alias("_at")).distinct()
    h = h.withColumn("_bucket", F.expr(f"_at div {window_ms}"))
    x = low.select(*SERIES, "direction", "open_time", "strategy").distinct().withColumn("_bucket", F.explode(F.expr(f"array(open_time div {window_ms}, open_time div {window_ms} - 1)")))
    both = x.join(h, ["symbol", "direction", "_bucket"]).where(f"_at between open_time - {window_ms} and open_time")
    both = both.groupBy(*SERIES, "direction", "open_time", "strategy", "co_timeframe", "co_strategy").agg(F.max("_at").alias("_at"))
    pair = lookup.where(F.col("avg_r") >= least).select("symbol", F.col("high").alias("co_timeframe"), F.col("low").alias("timeframe"), F.col("strategy_high").alias("co_strategy"), F.col("strategy_low").alias("strategy"), "avg_r", "closed_trades", "win_rate")
    both = both.join(pair, ["symbol", "timeframe", "co_timeframe", "strategy", "co_strategy"]).withColumn("candles_ago", F.expr(f"cast((open_time - _at) div {low_ms} as int)"))
    best = F.min_by(F.struct("strategy", "co_timeframe", "co_strategy", "candles_ago", "avg_r", "closed_trades", "win_rate"), F.struct(-F.col("avg_r"), "candles_ago", "co_timeframe", "strategy", "co_strategy"))
    return both.groupBy(*SERIES, "direction", "open_time").agg(best.alias("b")).select(*SERIES, "direction", "open_time", "b.*")
