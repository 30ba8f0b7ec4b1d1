"""Path cones: how the close moved within a day's session or a week, in units of the mean range before it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import HOUR_MS, SERIES

BANDS = (0.1, 0.25, 0.5, 0.75, 0.9)
WEEKDAYS = ("mon", "tue", "wed", "thu", "fri", "sat", "sun")


def _period(kind: str, ms: Column) -> Column:
    return F.to_date(F.date_trunc(kind, F.timestamp_millis(ms)))


def session(bars: DataFrame, first_hour: int = 13, hours: int = 7) -> DataFrame:
    """Hourly bars of the session's hours in UTC."""
    return bars.where(F.hour(F.timestamp_millis("open_time")).between(first_hour, first_hour + hours - 1))


def _complete(bars: DataFrame, kind: str, size: int, window: int, before: Column | None) -> DataFrame:
    """Complete periods with their bars ``p``, and ``scale``, the mean range of the ``window`` complete ones before."""
    g = bars.groupBy(*SERIES, _period(kind, F.col("open_time")).alias("period")).agg(F.array_sort(F.collect_list(F.struct("open_time", "open", "high", "low", "close"))).alias("p"))
    g = g.where(F.size("p") == size).withColumns({"o": F.col("p")[0]["open"], "c": F.element_at("p", -1)["close"], "hi": F.array_max(F.col("p.high")), "lo": F.array_min(F.col("p.low"))}).where("o > 0")
    if before is not None:
        g = g.where(F.col("period") < before)
    past = Window.partitionBy(*SERIES).orderBy("period").rowsBetween(-window, -1)
    r = (F.col("hi") - F.col("lo")) / F.col("o")
    return g.withColumn("r", r).withColumn("scale", F.when(F.count("r").over(past) == window, F.avg("r").over(past)))


def records(bars: DataFrame, kind: str = "day", size: int = 7, window: int = 14, now_ms: int | None = None) -> DataFrame:
    """A row per complete day or week with ``window`` complete ones before it, in order.

    ``direction`` is bull, bear or doji; ``path`` holds the closes less the open in units of open and mean range;
    ``low_step`` and ``high_step`` tell the bar, from 1, that first made an extreme; ``mae`` and ``mfe`` are the ends of the
    path, ``high_mag`` and ``low_mag`` the extremes' distances from the open. The period of ``now_ms`` and later ones are out.
    """
    g = _complete(bars, kind, size, window, None if now_ms is None else _period(kind, F.lit(now_ms))).where("scale > 0")
    unit = F.col("o") * F.col("scale")
    g = g.withColumn("path", F.expr("transform(p.close, x -> (x - o) / (o * scale))"))
    return g.select(
        *SERIES, "period", F.element_at(F.array(*map(F.lit, WEEKDAYS)), F.weekday("period") + 1).alias("weekday"),
        F.when(F.col("c") > F.col("o"), "bull").when(F.col("c") < F.col("o"), "bear").otherwise("doji").alias("direction"), "path",
        F.expr("array_position(p.low, lo)").cast("int").alias("low_step"), F.expr("array_position(p.high, hi)").cast("int").alias("high_step"),
        F.array_min("path").alias("mae"), F.array_max("path").alias("mfe"), ((F.col("hi") - F.col("o")) / unit).alias("high_mag"), ((F.col("o") - F.col("lo")) / unit).alias("low_mag"),
    )


def combos(rec: DataFrame, by_weekday: bool = True) -> tuple[DataFrame, list[str]]:
    """Records once for each slice they belong to: all or their direction (doji: all only), all or their weekday (not of a
    week end); and the names of the slices' columns."""
    x = rec.withColumn("direction", F.explode(F.when(F.col("direction") == "doji", F.array(F.lit("all"))).otherwise(F.array(F.lit("all"), "direction"))))
    if not by_weekday:
        return x, [*SERIES, "direction"]
    week = F.when(F.col("weekday").isin("sat", "sun"), F.array(F.lit("all"))).otherwise(F.array(F.lit("all"), "weekday"))
    return x.withColumn("weekday", F.explode(week)), [*SERIES, "direction", "weekday"]


def _quantiles(c: str, ps: tuple[float, ...], name: str) -> list[Column]:
    return [F.percentile(c, p).alias(f"{name}{round(p * 100)}") for p in ps]


def bands(rec: DataFrame, by_weekday: bool = True) -> DataFrame:
    """Per slice and step: quantiles of the path."""
    x, keys = combos(rec, by_weekday)
    x = x.select(*keys, F.posexplode("path").alias("step", "v")).withColumn("step", F.col("step") + 1)
    return x.groupBy(*keys, "step").agg(F.count("*").alias("n"), *_quantiles("v", BANDS, "p"))


def timing(rec: DataFrame, by_weekday: bool = True) -> DataFrame:
    """Per slice and step: the share of periods whose low, or high, was made by then."""
    x, keys = combos(rec, by_weekday)
    x = x.withColumn("step", F.explode(F.sequence(F.lit(1), F.size("path"))))
    by = lambda c: F.avg((F.col(c) <= F.col("step")).cast("double"))
    return x.groupBy(*keys, "step").agg(F.count("*").alias("n"), by("low_step").alias("low_in_by"), by("high_step").alias("high_in_by"))


def excursions(rec: DataFrame, by_weekday: bool = True) -> DataFrame:
    """Per slice: quantiles of the path's ends and of the extremes' distances."""
    x, keys = combos(rec, by_weekday)
    q = [c for name in ("mae", "mfe") for c in _quantiles(name, (0.1, 0.5, 0.9), f"{name}_p")] + [c for name in ("high_mag", "low_mag") for c in _quantiles(name, (0.5, 0.8), f"{name}_p")]
    return x.groupBy(*keys).agg(F.count("*").alias("n"), *q)


def current_path(bars: DataFrame, now_ms: int, kind: str = "day", size: int = 7, window: int = 14) -> DataFrame:
    """The forming period's closes in the units of ``records``, with the number of finished hours, the scale and the open.

    Series without a bar in it, or with under ``window`` complete periods before, give no row.
    """
    now = _period(kind, F.lit(now_ms))
    last = Window.partitionBy(*SERIES).orderBy(F.desc("period"))
    scale = _complete(bars, kind, size, window, now).withColumn("_n", F.row_number().over(last)).where(F.col("_n") <= window).groupBy(*SERIES).agg(F.avg("r").alias("scale"), F.count("*").alias("_k")).where((F.col("_k") == window) & (F.col("scale") > 0))
    cur = bars.where(_period(kind, F.col("open_time")) == now).groupBy(*SERIES).agg(F.array_sort(F.collect_list(F.struct("open_time", "open", "close"))).alias("p"), F.count_if(F.col("open_time") + HOUR_MS <= now_ms).alias("elapsed"))
    cur = cur.withColumn("period_open", F.col("p")[0]["open"]).where("period_open > 0").join(scale, list(SERIES))
    return cur.select(*SERIES, F.expr("transform(p.close, x -> (x - period_open) / (period_open * scale))").alias("points"), F.least(F.col("elapsed"), F.lit(size)).cast("int").alias("elapsed"), "scale", "period_open")
