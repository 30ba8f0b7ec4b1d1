"""The sessions of the New York exchange, from its rules: which days, when they open and when they close."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ZONE = "America/New_York"
# fixed values: days on which the exchange was closed beyond its rules, and Fridays after a Thursday holiday that closed early
CLOSED = ("1994-04-27", "2001-09-11", "2001-09-12", "2001-09-13", "2001-09-14", "2004-06-11", "2007-01-02", "2012-10-29", "2012-10-30", "2018-12-05", "2025-01-09")
SHORT_FRIDAYS = ("1996-07-05", "2002-07-05")


def easter(year: Column) -> Column:
    """Easter Sunday of a year in the Gregorian calendar, by the anonymous rule of whole divisions."""
    c, y = F.floor(year / 100), year % 100
    golden = year % 19
    epact = (19 * golden + c - F.floor(c / 4) - F.floor((c - F.floor((c + 8) / 25) + 1) / 3) + 15) % 30
    week = (32 + 2 * (c % 4) + 2 * F.floor(y / 4) - epact - y % 4) % 7
    late = F.floor((golden + 11 * epact + 22 * week) / 451)
    n = epact + week - 7 * late + 114
    return F.make_date(year.cast("int"), F.floor(n / 31).cast("int"), (n % 31 + 1).cast("int"))


def days(span: DataFrame) -> DataFrame:
    """``date, session, early`` for every day of ``span(first, last)``, one row, both included.

    A day is a session unless it is a weekend, a holiday or the day it is kept on, or one of the few closed beyond the rules.
    Sessions before Independence Day and Christmas, and after Thanksgiving, close early.
    """
    d = span.where("first is not null and last is not null").select(F.explode(F.expr("sequence(cast(first as date), cast(last as date))")).alias("date"))
    day, month, year, dow = F.dayofmonth("date"), F.month("date"), F.year("date"), F.weekday("date")  # 0: Monday
    monday, friday = dow == 0, dow == 4
    kept = lambda m, n: (month == m) & (((day == n) & (dow < 5)) | ((day == n - 1) & friday) | ((day == n + 1) & monday))
    nth = lambda m, w, first: (month == m) & (dow == w) & day.between(first, first + 6)
    holiday = (
        ((month == 1) & (((day == 1) & (dow < 5)) | ((day == 2) & monday)))  # not kept on the Friday before
        | (nth(1, 0, 15) & (year >= 1998))
        | nth(2, 0, 15)
        | (F.col("date") == F.date_sub(easter(year), 2))
        | nth(5, 0, 25)
        | (kept(6, 19) & (year >= 2022))
        | kept(7, 4)
        | nth(9, 0, 1)
        | nth(11, 3, 22)
        | kept(12, 25)
    )
    d = d.withColumn("session", (dow < 5) & ~holiday & ~F.col("date").isin(*(F.to_date(F.lit(x)) for x in CLOSED)))
    before_fourth = (month == 7) & (day == 3) & (dow < 4) & ((dow != 2) | (year >= 2013)) & (year >= 1995)
    after_thanks = (month == 11) & friday & day.between(23, 29) & (year >= 1993)
    before_christmas = (month == 12) & (day == 24) & (dow < 4) & (year >= 1993)
    early = before_fourth | after_thanks | before_christmas | F.col("date").isin(*(F.to_date(F.lit(x)) for x in SHORT_FRIDAYS))
    return d.withColumn("early", F.col("session") & early)


def bounds(span: DataFrame) -> DataFrame:
    """``date, open_ms, close_ms, early`` of every session in ``span(first, last)``: 9:30 to 16:00, or 13:00, in New York."""
    d = days(span).where("session")
    at = lambda h: F.unix_millis(F.to_utc_timestamp(F.concat_ws(" ", F.col("date").cast("string"), h), ZONE))
    return d.select("date", at(F.lit("09:30:00")).alias("open_ms"), at(F.when(F.col("early"), "13:00:00").otherwise("16:00:00")).alias("close_ms"), "early")


def elapsed(newest: DataFrame, now: str = "now", date: str = "date") -> DataFrame:
    """Adds ``sessions_elapsed``: sessions after the day of ``date``, up to the day of ``now``; 0 if that isn't later.

    Counted by the running number of sessions at both days, so nothing is joined by range; the calendar is a row a day. The
    day of ``date`` itself never counts, whether it is a session or not, but if it is none, the next one is taken for it.
    """
    from pyspark.sql import Window

    span = newest.agg(F.least(F.min(date), F.min(now)).alias("first"), F.greatest(F.max(date), F.max(now)).alias("last"))
    count = F.sum(F.col("session").cast("int"))
    c = days(span).withColumn("_upto", count.over(Window.orderBy("date").rowsBetween(Window.unboundedPreceding, 0)))
    a = c.select(F.col("date").alias(date), (F.col("_upto") - F.col("session").cast("int")).alias("_a"))
    b = c.select(F.col("date").alias(now), F.col("_upto").alias("_b"))
    out = newest.join(a, date, "left").join(b, now, "left")
    n = F.when(F.col(now) > F.col(date), F.greatest(F.lit(0), F.col("_b") - F.col("_a") - 1)).otherwise(0)
    return out.withColumn("sessions_elapsed", n.cast("int")).drop("_a", "_b")
