"""Books of events: cohorts formed by the filings of a month, and drifts after announcements."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import as_of
from .simulate import Costs

BUY, SELL = "P", "S"


def sessions(panel: DataFrame) -> DataFrame:
    """``date, i``: the dates of a panel, numbered from 1; a row a date."""
    return panel.select("date").distinct().withColumn("i", F.row_number().over(Window.orderBy("date")))


def liquidity(panel: DataFrame, days: int = 20) -> DataFrame:
    """Adds ``adv``, the trailing mean of ``dollars``, and ``sigma``, the trailing deviation of ``ret`` (three at least), up to the day itself."""
    w = Window.partitionBy("symbol").orderBy("date").rowsBetween(1 - days, 0)
    return panel.withColumns({"adv": F.avg("dollars").over(w), "sigma": F.when(F.count("ret").over(w) >= 3, F.stddev_samp("ret").over(w))})


def month_ends(panel: DataFrame) -> DataFrame:
    """``month, formed``: the last date of a panel in each month."""
    return panel.groupBy(F.trunc("date", "month").alias("month")).agg(F.max("date").alias("formed"))


def cohort_weights(labelled: DataFrame, panel: DataFrame) -> DataFrame:
    """``label, code, month, symbol, weight``: the names that a kind of insider filed a kind of trade in, in a month.

    ``labelled`` has ``symbol, code, label, filed``. A name weighs by its ``adv`` at the month's last date and a cohort sums to
    1; a name without a volume then is no position, nor is a row without a filing date.
    """
    names = labelled.where(F.col("filed").isNotNull()).select("label", "code", "symbol", F.trunc("filed", "month").alias("month")).distinct()
    priced = panel.withColumn("month", F.trunc("date", "month")).join(month_ends(panel), "month").where((F.col("date") == F.col("formed")) & (F.col("adv") > 0))
    c = names.join(priced.select("month", "symbol", "adv"), ["month", "symbol"])
    return c.select("label", "code", "month", "symbol", (F.col("adv") / F.sum("adv").over(Window.partitionBy("label", "code", "month"))).alias("weight"))


def daily_weights(cohorts: DataFrame, panel: DataFrame, hold: int) -> DataFrame:
    """``label, code, date, symbol, weight``: each cohort held over the ``hold`` months after its own, at one part in ``hold``.

    So ``hold`` cohorts overlap, and in the first months fewer are funded. A cohort meets its dates by the name of the month, not
    by a range: it first earns on the first date of the month after it was formed.
    """
    held = cohorts.withColumn("month", F.explode(F.transform(F.sequence(F.lit(1), F.lit(hold)), lambda k: F.add_months("month", k))))
    dates = panel.select("date", F.trunc("date", "month").alias("month")).distinct()
    return held.join(dates, "month").groupBy("label", "code", "date", "symbol").agg((F.sum("weight") / hold).alias("weight"))


def legs(weights: DataFrame) -> DataFrame:
    """``label, arm, date, symbol, weight``: ``long_only`` holds what was bought, ``long_short`` that less what was sold."""
    w = weights.where(F.col("code").isin(BUY, SELL)).withColumn("arm", F.explode(F.when(F.col("code") == BUY, F.array(F.lit("long_only"), F.lit("long_short"))).otherwise(F.array(F.lit("long_short")))))
    return w.groupBy("label", "arm", "date", "symbol").agg(F.sum(F.when(F.col("code") == BUY, F.col("weight")).otherwise(-F.col("weight"))).alias("weight"))


def spread_cost(adv: Column, costs: Costs) -> Column:
    """Half spread by bucket of daily volume, as a fraction; an unknown volume is in the least liquid one."""
    at = F.lit(costs.half_spread_bps[0])
    for floor, bps in zip(costs.floors, costs.half_spread_bps[1:], strict=True):
        at = F.when(adv >= floor, bps).otherwise(at)
    return at / 10_000.0


def booked(weights: DataFrame, panel: DataFrame, keys: list[str], costs: Costs = Costs(), days: float = 252.0) -> DataFrame:
    """``keys, date, gross, cost, borrow, net, active``: what daily weights earn, net of what it costs to hold and change them.

    A change is what differs from the weight on the date before, so leaving a name costs too: each weight is also put to the next
    date as the one before, and both sums meet by date and name. Spread and square-root impact are charged on changes by the
    name's own volume, borrow on what is short. A name without a bar earns nothing that day.
    """
    s = sessions(panel)
    w = weights.join(s, "date").select(*keys, "symbol", "i", "weight")
    both = w.withColumn("before", F.lit(0.0)).unionByName(w.select(*keys, "symbol", (F.col("i") + 1).alias("i"), F.lit(0.0).alias("weight"), F.col("weight").alias("before")))
    both = both.groupBy(*keys, "symbol", "i").agg(F.sum("weight").alias("weight"), F.sum("before").alias("before")).join(s, "i")
    x = both.join(panel.select("date", "symbol", "ret", "adv", "sigma"), ["date", "symbol"], "left")
    known = F.col("adv") > 0
    impact = F.when(known & (F.col("sigma") > 0), costs.impact * F.col("sigma") * F.sqrt(costs.notional / F.col("adv"))).otherwise(0.0)
    x = x.withColumns({
        "gross": F.col("weight") * F.coalesce("ret", F.lit(0.0)),
        "cost": F.abs(F.col("weight") - F.col("before")) * (spread_cost(F.when(known, F.col("adv")), costs) + impact),
        "borrow": F.greatest(-F.col("weight"), F.lit(0.0)) * costs.borrow_a_year / days,
    })
    g = x.groupBy(*keys, "date").agg(F.sum("gross").alias("gross"), F.sum("cost").alias("cost"), F.sum("borrow").alias("borrow"), F.count_if(F.abs("weight") > 1e-15).alias("active"))
    return g.withColumn("net", F.col("gross") - F.col("cost") - F.col("borrow"))


def insider_book(labelled: DataFrame, panel: DataFrame, hold: int = 3, costs: Costs = Costs()) -> DataFrame:
    """The books of every label, long only and long-short. ``panel`` has ``date, symbol, ret, dollars``."""
    p = liquidity(panel, round(costs.window_days))
    return booked(legs(daily_weights(cohort_weights(labelled, p), p, hold)), p, ["label", "arm"], costs)


def first_sessions(panel: DataFrame) -> DataFrame:
    """``day, first``: for each calendar day from the first date of a panel to the day before its last, the number of the next date."""
    s = sessions(panel).withColumn("to", F.lead("date").over(Window.orderBy("date")))
    return s.where("to is not null").select(F.explode(F.expr("sequence(date, to - interval 1 day)")).alias("day"), (F.col("i") + 1).alias("first"))


def active_surprises(events: DataFrame, panel: DataFrame, window: int = 60, long_only: bool = False) -> DataFrame:
    """``date, symbol, i, sue``: the surprise that a name is held on, for ``window`` dates from the first after its announcement.

    ``events`` has ``symbol, announced, sue``; a later announcement takes over. Those without a surprise, or for ``long_only``
    without a positive one, start nothing and take nothing over; so do those on or after the panel's last date. The one that
    counts is found as of the date's number, and its age limits it.
    """
    ok = F.col("sue").isNotNull() & ~F.isnan("sue") & (F.abs("sue") < F.lit(float("inf")))
    e = events.where(ok & (F.col("sue") > 0) if long_only else ok)
    start = panel.agg(F.min("date").alias("start"))
    at = e.crossJoin(F.broadcast(start)).join(first_sessions(panel), F.col("announced") == F.col("day"), "left")  # start: one row
    at = at.withColumn("first", F.when(F.col("announced") < F.col("start"), 1).otherwise(F.col("first"))).where("first is not null")
    at = at.groupBy("symbol", "first").agg(F.max_by("sue", "announced").alias("sue"))
    rows = panel.select("date", "symbol").join(sessions(panel), "date")
    return as_of(rows, at, ["symbol"], "i", "first", ["sue"]).where(F.col("i") < F.col("matched_time") + window).select("date", "symbol", "i", "sue")


def surprise_book(events: DataFrame, panel: DataFrame, window: int = 60, long_only: bool = False, target: float = 0.2, cost: float = 0.0003, days: float = 252.0) -> DataFrame:
    """``date, symbol, sue, leverage, net``: names held on their surprise, sized to a volatility target; long-short books are
    demeaned on each date, so that they sum to nothing. ``panel`` has ``date, symbol, ret, vol``, the vol known the day before."""
    x = active_surprises(events, panel, window, long_only).drop("i")
    x = panel.join(x, ["date", "symbol"], "left").withColumn("leverage", F.try_divide(F.col("sue") * target, F.col("vol") * F.sqrt(F.lit(days))))
    if not long_only:
        x = x.withColumn("leverage", F.col("leverage") - F.avg("leverage").over(Window.partitionBy("date")))
    held = F.coalesce("leverage", F.lit(0.0))
    x = x.withColumn("_held", held).withColumn("_before", F.coalesce(F.lag("_held").over(Window.partitionBy("symbol").orderBy("date")), F.lit(0.0)))
    return x.select("date", "symbol", "sue", "leverage", (F.col("_held") * F.coalesce("ret", F.lit(0.0)) - F.abs(F.col("_held") - F.col("_before")) * cost).alias("net"))
