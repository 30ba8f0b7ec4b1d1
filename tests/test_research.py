"""Resampling, gates, warnings, event books, the calendar, catch-up, calls and restated tables: plain versions and odd rows."""

import datetime
import hashlib
import math
import random
import statistics as st

import numpy as np
import pytest

from barloom.functions import resampling
from barloom.functions.statistics import spread
from barloom.operators import calls, candles, cohorts, confluence, overlay, replays, search, similar
from barloom.sources import calendar, sync
from barloom.streaming import bars as streams
from barloom.streaming import catchup

HOUR = 3_600_000
BARS = "symbol string, timeframe string, open_time long, open double, high double, low double, close double, volume double"


def bars_of(spark, rows, symbol="a"):
    """Hourly bars of (open, high, low, close) rows."""
    return spark.createDataFrame([(symbol, "1h", i * HOUR, *map(float, r), 1.0) for i, r in enumerate(rows)], BARS)


# ---- resampling


def draws_of(n, d, seed, block, method):
    """The days of one draw, by the same digests."""
    runs = math.ceil(n / block) if method == "circular" else math.ceil(n / block + 6 * math.sqrt(n / block)) + 10
    out = []
    for k in range(runs):
        h = hashlib.md5(f"{seed}|{n}|{d}|{k}".encode()).hexdigest()
        u, v = int(h[:8], 16) / 2**32, int(h[8:16], 16) / 2**32
        free = n - len(out)
        length = block if method == "circular" else 1 if block <= 1 else 1 + math.floor(math.log(1 - v) / math.log(1 - 1 / block))
        m = free if method == "stationary" and k == runs - 1 else min(free, length)
        out += [(math.floor(u * n) + j) % n for j in range(m)]
    return out


@pytest.mark.parametrize("method", ["stationary", "circular"])
def test_bootstrap_is_that_of_the_resamples(spark, method):
    rng = random.Random(1)
    data = {"a": [rng.gauss(0.1, 1) for _ in range(60)], "b": [rng.gauss(0, 1) for _ in range(60)], "c": [1.0, 2.0], "d": [5.0], "flat": [2.0] * 9}
    rows = [(k, i, v) for k, vs in data.items() for i, v in enumerate(vs)] + [("a", 99, None)]
    got = {r.key: r for r in resampling.block_bootstrap(spark.createDataFrame(rows, "key string, i int, v double"), ["key"], "i", "v", draws=250, method=method).collect()}
    assert set(got) == {"a", "b", "c", "flat"} and got["flat"].sharpe is None and got["flat"].n_valid == 0
    for key in ("a", "b", "c"):
        v, n = np.array(data[key]), len(data[key])
        block = max(1, min(round(n ** (1 / 3)), n - 1))
        each = [v[draws_of(n, d, 7, block, method)] for d in range(250)]
        assert all(len(x) == n for x in each) and got[key].block == block
        means = [x.mean() for x in each]
        assert np.allclose([got[key].mean_lo, got[key].mean_hi], np.quantile(means, [0.025, 0.975]))
        sharpes = [x.mean() / x.std(ddof=1) * math.sqrt(252) for x in each if x.std(ddof=1) > 1e-12]
        assert got[key].n_valid == len(sharpes) and np.allclose([got[key].sharpe_lo, got[key].sharpe_hi], np.quantile(sharpes, [0.025, 0.975]))
        assert math.isclose(got[key].mean, v.mean()) and math.isclose(got[key].sharpe, v.mean() / v.std(ddof=1) * math.sqrt(252))
    assert resampling.block_bootstrap(spark.createDataFrame([], "key string, i int, v double"), ["key"], "i", "v", draws=8).count() == 0


def test_serial_dependence_widens_the_interval(spark):
    rng = random.Random(2)
    x, rows = 0.0, []
    for i in range(400):
        x = 0.9 * x + rng.gauss(0, 1)
        rows.append(("k", i, x))
    df = spark.createDataFrame(rows, "key string, i int, v double")
    wide, narrow = (resampling.block_bootstrap(df, ["key"], "i", "v", draws=400, block=b).first() for b in (30, 1))
    assert wide.mean_hi - wide.mean_lo > 2 * (narrow.mean_hi - narrow.mean_lo)


def test_breach_curve_against_folded_paths(spark):
    rng = random.Random(3)
    r = [rng.gauss(0.001, 0.01) for _ in range(50)]
    df = spark.createDataFrame([("k", i, x) for i, x in enumerate(r)] + [("one", 0, 0.1)], "key string, i int, v double")
    got = {(x.key, x.depth): x.odds for x in resampling.breach_curve(df, ["key"], "i", "v", (0.05, 0.1, 0.2), horizon=120, paths=150, block=20).collect()}
    hits = {0.05: 0, 0.1: 0, 0.2: 0}
    for d in range(150):
        runs, path = math.ceil(6 + 6 * math.sqrt(6)) + 10, []
        for k in range(runs):
            h = hashlib.md5(f"7|50|{d}|{k}".encode()).hexdigest()
            u, v = int(h[:8], 16) / 2**32, int(h[8:16], 16) / 2**32
            free = 120 - len(path)
            m = free if k == runs - 1 else min(free, 1 + math.floor(math.log(1 - v) / math.log(1 - 1 / 20)))
            path += [(math.floor(u * 50) + j) % 50 for j in range(m)]
        wealth = np.cumprod([1 + r[i] for i in path])
        worst = (wealth / np.maximum.accumulate(np.maximum(wealth, 1)) - 1).min()
        for depth in hits:
            hits[depth] += worst <= -depth
    assert got == {("k", depth): n / 150 for depth, n in hits.items()} and got["k", 0.05] > got["k", 0.2]


def test_required_sharpe_is_where_the_odds_reach_the_target(spark):
    rows = [(100, 0.0, 0.0, 3.0), (100, 0.1, -0.5, 6.0), (2, 2.0, 0.0, 3.0), (1, 0.0, 0.0, 3.0), (50, None, 0.0, 3.0), (1000, 0.5, 0.3, 4.0), (40, -1.0, 0.0, 3.0)]
    got = [r.required for r in resampling.required_sharpe(spark.createDataFrame(rows, "n long, benchmark double, skew double, kurt double")).collect()]
    assert got[2] is None and got[3] is None and got[4] is None and got[6] < 1e-12
    for (n, bench, skew, kurt), sr in zip(rows, got, strict=True):
        if sr and sr > 1e-12:
            z = (sr - bench) * math.sqrt(n - 1) / math.sqrt(1 - skew * sr + (kurt - 1) / 4 * sr * sr)
            assert math.isclose(st.NormalDist().cdf(z), 0.95, rel_tol=1e-9)


def test_effective_counts_and_clusters(spark):
    rows = [("one", 1, v) for v in (1.0, 2.0, 3.0)] + [("own", i, float(i)) for i in range(4)] + [("flat", i % 2, 1.0) for i in range(6)] + [("same", i // 5, float(i // 5)) for i in range(20)] + [("same", None, None)]
    got = {r.key: r for r in resampling.cluster_stats(spark.createDataFrame(rows, "key string, c int, v double"), ["key"], "c", "v").collect()}
    assert (got["one"].icc, got["one"].n_eff) == (1.0, 1.0) and (got["own"].icc, got["own"].n_eff) == (0.0, 4.0)
    assert (got["flat"].icc, got["flat"].n_eff) == (0.0, 6.0) and (got["same"].icc, got["same"].n_eff) == (1.0, 4.0)


def test_gate_cells(spark):
    rng, rows = random.Random(4), []
    for day in range(300):
        for cell, out, mean in (("loses", True, -0.5), ("loses", False, 0.1), ("wins", True, 0.5), ("wins", False, 0.1), ("better", True, 0.5), ("better", False, 1.5), ("nothing", True, 0.0), ("nothing", False, 0.0)):
            rows.append((cell, out, day, mean + rng.gauss(0, 0.2 if cell == "nothing" else 0.5)))
    rows += [("few", True, d, -1.0) for d in range(5)] + [("one_day", True, 0, -1.0 + d / 100) for d in range(40)] + [("none", False, 0, 1.0), ("loses", None, 0, 1.0), ("loses", True, 0, None)]
    got = {r.cell: r for r in resampling.audit_cells(spark.createDataFrame(rows, "cell string, out boolean, day int, r double"), ["cell"], "out", "day", "r", draws=400).collect()}
    assert {k: r.decision for k, r in got.items()} == {"loses": "ENABLE", "wins": "DISABLE", "better": "CONCENTRATE", "nothing": "INSUFFICIENT", "few": "INSUFFICIENT", "one_day": "INSUFFICIENT", "none": "INSUFFICIENT"}
    assert got["nothing"].powered_null and not got["few"].powered_null and got["few"].p is None and got["one_day"].lo is None and got["loses"].n_tests == 5 and got["loses"].n_supp == 300


def test_lifts(spark):
    rng = random.Random(5)
    rows = [("k", i, i % 2 == 0, (1.0 if i % 2 == 0 else 0.0) + rng.gauss(0, 1)) for i in range(400)] + [("small", 1, True, 1.0), ("small", 2, False, 1.0), ("small", 3, False, 1.0)]
    got = {r.key: r for r in resampling.lift_interval(spark.createDataFrame(rows, "key string, id int, f boolean, v double"), ["key"], "f", "id", "v", draws=1000).collect()}
    a, b = ([v for k, _, f, v in rows if k == "k" and f == x] for x in (True, False))
    se = math.sqrt(np.var(a, ddof=1) / len(a) + np.var(b, ddof=1) / len(b))
    assert math.isclose(got["k"].lift, np.mean(a) - np.mean(b)) and got["small"].lift is None and got["small"].lift_lo is None
    assert abs(got["k"].lift_hi - got["k"].lift_lo - 2 * 1.96 * se) < 0.2 * se * 3.92


def test_few_rows_are_spread(spark):
    assert spread(spark.range(100), "id").rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))


# ---- candle warnings


def plain_flags(rows, i, direction):
    o, h, low, c = rows[i]
    body, size = abs(c - o), h - low
    doji = size != 0 and body / size <= 0.1
    up, down = h - max(o, c), min(o, c) - low
    past = rows[max(0, i - 10) : i]
    levels = sorted(x[2] for x in past if x[2] < c) if direction == "long" else sorted(x[1] for x in past if x[1] > c)
    last = rows[i - 2 : i + 1] if i >= 2 else []
    return (
        not doji and body != 0 and up / body <= 0.1 and down / body <= 0.1,
        any(b - a <= c * 0.0015 for a, b in zip(levels, levels[1:], strict=False)),
        not doji and size != 0 and (up if direction == "long" else down) / size > 0.4,
        len(last) == 3 and all(x[3] > x[0] if direction == "long" else x[3] < x[0] for x in last),
        doji,
        h <= rows[i - 1][1] and low >= rows[i - 1][2],
    )


def test_candle_warnings_against_plain_rules(spark):
    rng, rows = random.Random(6), []
    for _ in range(150):
        o, c = (round(100 + rng.gauss(0, 2), 1) for _ in range(2))
        rows.append((o, max(o, c) + rng.choice([0, 0.1, 1.7, 3.3]), min(o, c) - rng.choice([0, 0.1, 1.7, 3.3]), rng.choice([c, c, o])))
    rows[7] = (100.0, 100.0, 100.0, 100.0)
    got = {(r.open_time // HOUR, r.direction): tuple(r[n] for n in candles.NAMES) for r in candles.candle_warnings(bars_of(spark, rows)).collect()}
    assert got == {(i, d): plain_flags(rows, i, d) for i in range(1, 150) for d in ("long", "short")}
    assert candles.candle_warnings(bars_of(spark, rows[:1])).count() == 0


# ---- books of events


def day(n):
    return datetime.date(2020, 1, 1) + datetime.timedelta(n)


def test_cohorts_overlap_and_cost_when_they_leave(spark):
    dates = [day(i) for i in range(0, 200) if day(i).weekday() < 5]
    panel = spark.createDataFrame([(d, s, 0.01 if s == "x" else -0.02, 100.0 if s == "x" else 300.0) for d in dates for s in ("x", "y")] + [(dates[-1], "z", 0.0, None)], "date date, symbol string, ret double, dollars double")
    filed = [("x", "P", "o", day(5)), ("y", "P", "o", day(6)), ("x", "P", "o", day(7)), ("x", "S", "o", day(40)), ("z", "P", "o", day(41)), ("y", "P", "o", None), ("y", "M", "o", day(8))]
    labelled = spark.createDataFrame(filed, "symbol string, code string, label string, filed date")
    p = cohorts.liquidity(panel)
    w = {(r.arm, r.date, r.symbol): r.weight for r in cohorts.legs(cohorts.daily_weights(cohorts.cohort_weights(labelled, p), p, 2)).collect()}
    held = lambda month, arm, s: {round(v, 9) for (a, d, x), v in w.items() if a == arm and x == s and d.month == month}
    assert held(1, "long_only", "x") == set() and held(2, "long_only", "x") == {0.125} and held(2, "long_only", "y") == {0.375} and held(3, "long_only", "x") == {0.125} and held(4, "long_only", "x") == set()
    assert held(2, "long_short", "x") == {0.125} and held(3, "long_short", "x") == {-0.375} and held(4, "long_short", "x") == {-0.5}
    book = {(r.arm, r.date): r for r in cohorts.insider_book(labelled, panel, hold=2).collect()}
    leaves = min(d for d in dates if d.month == 4)
    assert book["long_only", leaves].gross == 0 and book["long_only", leaves].cost > 0 and book["long_only", leaves].active == 0
    assert math.isclose(book["long_only", min(d for d in dates if d.month == 2)].gross, 0.125 * 0.01 - 0.375 * 0.02)
    assert book["long_short", leaves].borrow > 0 and ("long_only", min(d for d in dates if d.month == 6)) not in book
    assert cohorts.insider_book(labelled.limit(0), panel).count() == 0


def test_surprises_are_held_from_the_next_session(spark):
    dates = [day(i) for i in range(0, 30) if day(i).weekday() < 5]
    panel = spark.createDataFrame([(d, s, 0.01, 0.02) for d in dates for s in ("x", "y")], "date date, symbol string, ret double, vol double")
    events = [("x", day(3), 2.0), ("x", day(9), -1.0), ("x", day(9), None), ("y", day(-5), 1.0), ("y", dates[-1], 9.0), ("y", day(12), float("inf"))]
    e = spark.createDataFrame(events, "symbol string, announced date, sue double")
    at = {(r.symbol, r.date): r.sue for r in cohorts.active_surprises(e, panel, window=5).collect()}
    x = [at.get(("x", d)) for d in dates]
    first, second = next(i for i, d in enumerate(dates) if d > day(3)), next(i for i, d in enumerate(dates) if d > day(9))
    want = [None] * len(dates)
    want[first : first + 5] = [2.0] * 5
    want[second : second + 5] = [-1.0] * 5
    assert x == want and [at.get(("y", d)) for d in dates] == [1.0] * 5 + [None] * (len(dates) - 5)
    only = {(r.symbol, r.date): r.sue for r in cohorts.active_surprises(e, panel, window=5, long_only=True).collect()}
    assert [only.get(("x", d)) for d in dates][second] == (2.0 if second < first + 5 else None)
    both = cohorts.surprise_book(e, panel, window=5).where("leverage is not null").collect()
    for d in dates:
        assert abs(sum(r.leverage for r in both if r.date == d)) < 1e-9


# ---- live confluence


def test_best_live_pair(spark):
    b = bars_of(spark, [(1, 1, 1, 1)] * 20)
    s = [("p", 3, "long"), ("q", 5, "long"), ("r", 5, "short"), ("q", 9, "long"), ("p", 9, "long"), ("r", 12, "long"), ("p", 15, "long")]
    signals = spark.createDataFrame([("a", "1h", i * HOUR, d, n) for n, i, d in s], "symbol string, timeframe string, open_time long, direction string, strategy string")
    lookup = spark.createDataFrame([("a", "1h", "p", "q", 1.0, 10, 0.5), ("a", "1h", "p", "r", 2.0, 5, 0.6), ("a", "1h", "q", "r", -3.0, 5, 0.6)], "symbol string, timeframe string, first string, second string, avg_r double, closed_trades long, win_rate double")
    got = {(r.open_time // HOUR, r.direction): (r.strategy, r.co_strategy, r.candles_ago, r.avg_r) for r in confluence.live_cofire(b, signals, lookup, window=4).collect()}
    assert got == {(5, "long"): ("q", "p", 2, 1.0), (9, "long"): ("p", "q", 0, 1.0), (12, "long"): ("r", "p", 3, 2.0), (15, "long"): ("p", "r", 3, 2.0)}
    assert confluence.live_cofire(b, signals, lookup, window=4, least=5.0).count() == 0 and confluence.live_cofire(b, signals.limit(0), lookup).count() == 0


def test_live_pairs_across_timeframes(spark):
    kind = "symbol string, timeframe string, open_time long, direction string, strategy string"
    low = spark.createDataFrame([("a", "1h", t * HOUR, d, n) for t, d, n in ((10, "long", "p"), (13, "long", "p"), (30, "long", "q"), (30, "short", "p"))], kind)
    high = spark.createDataFrame([("a", "4h", t * HOUR, "long", n) for t, n in ((1, "u"), (6, "u"), (10, "v"), (18, "u"), (31, "v"))], kind)
    lookup = spark.createDataFrame([("a", "4h", "1h", "u", "p", 1.0, 9, 0.5), ("a", "4h", "1h", "v", "p", 0.5, 9, 0.5), ("a", "4h", "1h", "u", "q", 0.7, 9, 0.5)], "symbol string, high string, low string, strategy_high string, strategy_low string, avg_r double, closed_trades long, win_rate double")
    got = {(r.open_time // HOUR, r.direction): (r.co_strategy, r.candles_ago) for r in confluence.live_cross(low, high, lookup, 6 * HOUR, HOUR).collect()}
    assert got == {(10, "long"): ("u", 4), (13, "long"): ("v", 3)}


# ---- the exchange's calendar


def test_known_sessions(spark):
    span = spark.createDataFrame([(datetime.date(1990, 1, 1), datetime.date(2026, 12, 31))], "first date, last date")
    got = {r.date: r for r in calendar.bounds(span).collect()}
    d = datetime.date.fromisoformat
    closed = "2024-03-29 2023-04-07 2000-04-21 2024-01-15 1998-01-19 2024-06-19 2022-06-20 2021-07-05 2020-07-03 2021-12-24 2022-12-26 2023-01-02 2001-09-11 2012-10-29 2024-11-28 2024-09-02 2018-12-05 2025-01-09 2024-05-27".split()
    opened = "1997-01-20 2021-06-18 2021-12-31 2010-12-31 2024-03-28 2001-09-17 2022-01-03 2024-12-24 2024-07-05".split()
    assert not any(d(x) in got for x in closed) and all(d(x) in got for x in opened)
    per_year = {y: sum(x.year == y for x in got) for y in (1996, 2001, 2012, 2020, 2022, 2024)}
    assert per_year == {1996: 254, 2001: 248, 2012: 250, 2020: 253, 2022: 251, 2024: 252}
    assert {x for x in got if got[x].early and x.year == 2024} == {d("2024-07-03"), d("2024-11-29"), d("2024-12-24")}
    utc = lambda ms: datetime.datetime.fromtimestamp(ms / 1000, datetime.UTC).strftime("%H:%M")
    assert (utc(got[d("2024-01-02")].open_ms), utc(got[d("2024-01-02")].close_ms)) == ("14:30", "21:00")
    assert (utc(got[d("2024-07-03")].open_ms), utc(got[d("2024-07-03")].close_ms)) == ("13:30", "17:00")
    assert calendar.bounds(spark.createDataFrame([(None, None)], "first date, last date")).count() == 0


def test_sessions_elapsed(spark):
    d = datetime.date.fromisoformat
    rows = [(d("2024-03-28"), d("2024-04-02")), (d("2024-03-28"), d("2024-03-28")), (d("2024-03-29"), d("2024-04-02")), (d("2024-04-05"), d("2024-04-01"))]
    got = calendar.elapsed(spark.createDataFrame(rows, "date date, now date")).collect()
    assert {(r.date, r.now): r.sessions_elapsed for r in got} == {rows[0]: 2, rows[1]: 0, rows[2]: 1, rows[3]: 0}


# ---- catch-up


def test_bars_are_replayed_once_over_restarts(spark, tmp_path):
    src, out, state = (f"file://{tmp_path}/{x}" for x in ("src", "out", "state"))
    kind = f"{BARS}, seen_ms long"

    def put(bars, seen):
        spark.createDataFrame([("a", "1h", t * HOUR, 1.0, 2.0, 0.5, c, 1.0, int(seen * HOUR)) for t, c in bars], kind).coalesce(1).write.mode("append").parquet(src)

    def run():
        rows = spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).parquet(src)
        catchup.catch_up(rows, keep=3).writeStream.format("parquet").option("path", out).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
        return sorted((r.open_time // HOUR, r.status, [b.open_time // HOUR for b in r.context], r.context[-1].close if r.context else None) for r in spark.read.parquet(out).collect())

    put([(0, 1.0), (1, 1.0), (2, 1.0), (3, 9.0)], 3.5)  # bar 3 is forming; a cold series fires its newest closed bar only
    assert run() == [(2, "alert", [0, 1, 2], 1.0)]
    assert run() == [(2, "alert", [0, 1, 2], 1.0)]  # nothing new, nothing again
    put([(3, 1.5), (4, 1.0), (5, 1.0), (6, 1.0)], 7.0)  # three closed meanwhile, and bar 3 with its last close
    put([(6, 1.0)], 7.5)  # the same bar again
    want = [(2, "alert", [0, 1, 2], 1.0), (3, "backfill", [1, 2, 3], 1.5), (4, "backfill", [2, 3, 4], 1.0), (5, "backfill", [3, 4, 5], 1.0), (6, "alert", [4, 5, 6], 1.0)]
    assert run() == want
    put([(5, 4.0), (7, 1.0)], 8.0)  # bar 5 is restated: told, in the context of what follows, not replayed
    spark2 = run()
    assert spark2 == sorted([*want, (5, "late", [], None), (7, "alert", [5, 6, 7], 1.0)])
    last = next(r for r in spark.read.parquet(out).collect() if r.open_time == 7 * HOUR)
    assert [b.close for b in last.context] == [4.0, 1.0, 1.0]


def test_young_bars_alert_too(spark, tmp_path):
    src = f"file://{tmp_path}/src"
    rows = spark.createDataFrame([(s, "1h", t * HOUR, 1.0, 1.0, 1.0, 1.0, 1.0, part, seen * HOUR) for s in ("a", "b") for t, part, seen in ((0, 0, 1), (1, 1, 30), (20, 1, 30), (29, 1, 30))], f"{BARS}, part int, seen_ms long")
    catchup.in_batches(rows, "part", src)
    stream = spark.readStream.schema(rows.drop("part").schema).option("maxFilesPerTrigger", 1).parquet(src)
    got = sorted((r.symbol, r.open_time // HOUR, r.status) for r in streams.drain(catchup.catch_up(stream, max_age_hours=12.0), "x").collect())
    assert got == [(s, t, x) for s in ("a", "b") for t, x in ((0, "alert"), (1, "backfill"), (20, "alert"), (29, "alert"))]


# ---- similar entries


def plain_similar(claims, entries, top=3):
    out = []
    for i, lv, tm in claims:
        hits = sorted((-(3 * len(lv & x) + 10 * len(tm & y) / max(min(len(tm), len(y)), 8)), j) for j, x, y in entries if i is not None and j is not None)
        out += [(i, j, k + 1, round(-s, 3)) for k, (s, j) in enumerate(h for h in hits if h[0] <= -3)][:top]
    return sorted(out)


@pytest.mark.parametrize("common", [1000, 3])
def test_similar_entries_against_all_pairs(spark, common):
    rng = random.Random(common)
    words = ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(40)]
    def item(i):  # noqa: E306
        lv, tm = {rng.choice([100, 200, 5000, 6123]) for _ in range(rng.randint(0, 3))}, set(rng.sample(words, rng.randint(0, 12)))
        return i, lv, tm, " ".join([*map(str, lv), *tm])
    a, b = ([item(i) for i in range(n)] for n in (40, 120))
    b += [(200 + i, *b[0][1:]) for i in range(6)]
    a.append((99, *a[0][1:]))
    df = lambda rows: spark.createDataFrame([(i, t) for i, *_, t in rows] + [(None, "5000"), (7000, None), (7001, "")], "id long, text string")
    got = sorted((r.claim_id, r.entry_id, r["rank"], r.score) for r in similar.find_similar(df(a), df(b), common=common).collect())
    assert got == plain_similar([r[:3] for r in a], [r[:3] for r in b])


def test_texts_of_entries_are_read_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    df = spark.createDataFrame([(i, f"level 500{i % 7} alpha bravo charlie") for i in range(50)], "id long, text string")
    assert similar.find_similar(df.where("id < 9"), df.mapInArrow(counted, df.schema), common=3).count() == 27
    assert seen.value == 50


def test_levels_and_words(spark):
    rows = ["buy 28k stop 1,982.10 by 2024-05-01, 5% off, 2024 or June 3, 2150 or 2,050.5 http://x/999 and 99", None, "With THIS Breakout that breakout is"]
    got = spark.createDataFrame([(r,) for r in rows], "t string").select(similar.levels(spark_col("t")).alias("l"), similar.terms(spark_col("t")).alias("w")).collect()
    assert [r.l for r in got] == [[1982.1, 2050.5, 28000.0], [], []] and got[2].w == ["breakout"] and got[1].w == []


def spark_col(name):
    from pyspark.sql import functions as F

    return F.col(name)


# ---- scored calls


def test_calls_trigger_gap_and_end(spark):
    rows = [(10, 11, 9, 10), (10, 12, 9, 11), (13, 14, 12.5, 13), (13, 13.5, 12, 12), (8, 9, 7, 8), (8, 20, 7.5, 19), (19, 19, 19, 19)]
    b = bars_of(spark, rows)
    def one(direction, call, entry, stop, target, window=100, now=100, expected=None):  # noqa: E306
        c = spark.createDataFrame([("a", "1h", direction, int(call * HOUR), entry, stop, target, window * HOUR)], "symbol string, timeframe string, direction string, call_ms long, entry double, stop double, target double, window_ms long")
        r = calls.score_calls(c, b, now * HOUR, None if expected is None else expected * HOUR).collect()[0]
        return r.state, r.fill, None if r.fill_ms is None else r.fill_ms // HOUR, r.exit, None if r.exit_ms is None else r.exit_ms // HOUR, r.r
    assert one("long", 1.0, None, 9.5, 13.0) == ("LOSS", 10.0, 1, 9.5, 1, -1.0)  # at the market; the fill's bar reaches the stop
    assert one("long", 1.0, 12.2, 10.0, 15.0)[:5] == ("LOSS", 13.0, 2, 8.0, 4)  # gaps over the entry, then through the stop
    assert one("short", 1.0, 13.0, 15.0, 9.0)[:5] == ("WIN", 13.0, 2, 8.0, 4)  # gaps through the target, at the open
    assert one("long", 4.0, 7.2, 5.0, 18.0)[:5] == ("WIN", 7.2, 4, 18.0, 5)
    assert one("long", 4.0, 3.0, 2.0, 18.0, window=2)[0] == "NOT_TRIGGERED" and one("long", 4.0, 3.0, 2.0, 18.0)[0] == "STALE" and one("long", 4.0, 3.0, 2.0, 18.0, expected=7)[0] == "OPEN"
    assert one("long", 4.0, 8.0, 2.0, None, window=2) == ("WIN", 8.0, 4, 19.0, 6, pytest.approx(11 / 6))  # ends with its window
    assert one("long", 4.0, 8.0, 9.0, 18.0)[0] == "UNSCORED" and one("flat", 4.0, 8.0, 9.0, 18.0)[0] == "UNSCORED" and one(None, 4.0, 8.0, 9.0, 18.0)[0] == "UNSCORED"
    assert one("long", 0.5, 8.0, 7.0, 18.0)[0] == "UNRESOLVABLE" and one("long", 5.5, None, None, None, now=6, expected=7)[:3] == ("OPEN", 19.0, 6)


# ---- restated tables


def test_three_pages_and_a_split(spark, tmp_path):
    path = f"file://{tmp_path}/bars"
    make = lambda times, m, tail=1.0: spark.createDataFrame([(s, "1h", t * HOUR, *(float(10 + t) * k for _ in range(4)), 5.0) for s, k in (("a", 1.0), ("b", m)) for t in times], BARS)
    one = sync.sync(spark, path, make(range(4), 1.0), make(range(9), 1.0), 1)
    assert one.count() == 8
    for _ in range(2):  # tried again
        two = sync.sync(spark, path, make(range(3, 7), 0.5), make(range(7), 0.5), 2)
        assert {(r.symbol, r.open_time // HOUR): r.close for r in two.collect()} == {(s, t): (10 + t) * k for s, k in (("a", 1.0), ("b", 0.5)) for t in range(7)}
    three = sync.sync(spark, path, make(range(6, 9), 0.504), make(range(9), 0.504), 3)  # within the tolerance: goes on
    assert {(r.symbol, r.open_time // HOUR): round(r.close, 6) for r in three.collect()} == {(s, t): round((10 + t) * (1.0 if s == "a" else 0.5 if t < 6 else 0.504), 6) for s in "ab" for t in range(9)}
    assert sync.stored(spark, f"{path}-none") is None


# ---- replays and the overlay


def test_trades_under_the_regime_of_their_entry(spark):
    regimes = spark.createDataFrame([("a", t * 4 * HOUR, r) for t, r in enumerate(["range", "high_vol", "trend", None, "range"])], "symbol string, open_time long, regime string")
    trades = spark.createDataFrame([("a", "p", t * HOUR, 1.0) for t in (1, 5, 9, 13, 17, 25)] + [("b", "p", 9 * HOUR, 1.0)], "symbol string, strategy string, entry_time long, pnl_r double")
    x = replays.annotate_suppression(replays.annotate_regime(trades, regimes), {"high_vol": [], "trend": ["q"]})
    got = {(r.symbol, r.entry_time // HOUR): (r.regime, r.suppressed) for r in x.collect()}
    assert got == {("a", 1): ("unknown", False), ("a", 5): ("range", False), ("a", 9): ("high_vol", True), ("a", 13): ("trend", True), ("a", 17): ("unknown", False), ("a", 25): ("unknown", False), ("b", 9): ("unknown", False)}
    assert {(r.regime, r.suppressed, r.n) for r in replays.kept_and_dropped(x).collect()} == {("unknown", False, 4), ("range", False, 1), ("high_vol", True, 1), ("trend", True, 1)}


@pytest.mark.parametrize(("means", "want"), [((-1.0, 0.0), "FLIP justified"), ((-1.0, 1.0), "DO NOT FLIP"), ((0.0, 0.0), "HOLD")])
def test_one_winning_cell_blocks_the_gate(spark, means, want):
    rng = random.Random(8)
    rows = [(f"s{k}", bool(i % 2), i // 2, (m if i % 2 else 0.1) + rng.gauss(0, 0.4)) for k, m in enumerate(means) for i in range(160)]
    got = replays.flip(spark.createDataFrame(rows, "strategy string, suppressed boolean, day int, pnl_r double"), draws=200).collect()
    assert len(got) == 2 and {r.flip for r in got} == {want}


def test_overlay_state_and_gaps(spark):
    dates = [day(i) for i in range(400) if day(i).weekday() < 5]
    rng, close, rows = random.Random(9), 100.0, []
    for d in dates:
        close *= 1 + rng.gauss(0, 0.01)
        rows.append(("m", d, close))
    df = spark.createDataFrame([*rows, ("short", dates[0], 1.0)], "symbol string, date date, close double")
    (r,) = overlay.state(df).collect()
    c = np.array([x[2] for x in rows])
    above = [c[i] > c[i - 199 : i + 1].mean() for i in range(199, len(c))]
    held = next((k for k, x in enumerate(reversed(above)) if x != above[-1]), len(above))
    sd = np.std(c[-20:] / c[-21:-1] - 1, ddof=1)
    assert (r.symbol, r.as_of, r.ma_in, r.sessions_in_state) == ("m", dates[-1], above[-1], held)
    assert np.allclose([r.sma, r.flip_level, r.sigma_ann, r.vm_weight], [c[-200:].mean(), c[-199:].mean(), sd * math.sqrt(252), min(0.00709 / sd, 1)]) and r.exposure == (r.vm_weight if r.ma_in else 0)
    now = datetime.datetime.combine(dates[-1], datetime.time(12))
    assert overlay.completed(df, now).agg({"date": "max"}).first()[0] == dates[-2] and overlay.completed(df, now.replace(hour=21)).count() == df.count()
    s = spark.createDataFrame([("m", datetime.date(2024, 3, 27)), ("n", datetime.date(2024, 4, 2))], "symbol string, as_of date")
    assert sorted((r.symbol, str(r.date)) for r in overlay.missing(s, datetime.datetime(2024, 4, 2, 12)).collect()) == [("m", "2024-03-28"), ("m", "2024-04-01")]


def test_arms_are_summed_up(spark):
    rows = [("k", day(i), r, w) for i, (r, w) in enumerate([(0.1, 1.0), (-0.5, 1.0), (0.2, 0.0), (0.0, 0.5), (None, 0.5)])]
    (r,) = overlay.summaries(spark.createDataFrame(rows, "k string, date date, ret double, weight double"), ["k"]).collect()
    years = 3 / 365.25
    assert np.allclose([r.max_drawdown, r.turnover_a_year, r.in_market, r.switches_a_year], [-0.5, 1.5 / years, 0.625, 2 / years]) and r.longest_under_water == 3


def test_sweep_verdicts(spark):
    rng = random.Random(10)
    rows = [(f"t{k}", i, (0.5 if k == 0 else 0.0) + rng.gauss(0, 1)) for k in range(8) for i in range(200)] + [("few", i, i % 2 - 0.5) for i in range(4)] + [("flat", i, 0.0) for i in range(40)]
    got = {r.trial: r for r in resampling.commit_gate(spark.createDataFrame(rows, "trial string, at long, r double"), "trial", "at", "r").collect()}
    assert got["t0"].decision == "COMMIT" and got["t0"].failed == "" and got["few"].decision == "INSUFFICIENT" and got["few"].dsr is None
    assert got["flat"].sharpe == 0 and "dsr" in got["flat"].failed and "min_n" in got["flat"].failed and {r.decision for k, r in got.items() if k in ("t1", "t2", "t3")} == {"DO_NOT_COMMIT"}
    alone = resampling.commit_gate(spark.createDataFrame(rows[:200], "trial string, at long, r double"), "trial", "at", "r").collect()
    assert [r.decision for r in alone] == ["INSUFFICIENT"]


def test_a_sweep_of_equal_results_has_no_ratio(spark):
    rows = [("won", i, (2.0, 2.0000000000000004, 1.9999999999999998)[i % 3]) for i in range(60)] + [("t", i, i % 5 - 1.5) for i in range(60)]
    got = {r.trial: r for r in resampling.commit_gate(spark.createDataFrame(rows, "trial string, at long, r double"), "trial", "at", "r").collect()}
    assert got["won"].sharpe == 0 and got["t"].dsr > 0.5


# ---- searches over large blocks


def test_first_touch_over_gaps_and_large_blocks(spark, monkeypatch):
    monkeypatch.setattr(search, "BARS_A_BLOCK", 3)
    rng = random.Random(11)
    times = sorted(rng.sample(range(0, 600), 160)) + list(range(5000, 5020))
    bars = [(s, t, round(rng.uniform(90, 110), 1)) for s in ("a", "b") for t in times]
    b = spark.createDataFrame([(s, "1h", t * HOUR, m, m + 1, m - 1, m, 1.0) for s, t, m in bars], BARS)
    asks = [(s, rng.choice([-50, 0, 700, 4000, 6000, *times, *times]), rng.choice([None, 60.0, 85.0, 90.0]), rng.choice([None, 140.0, 113.0, 110.0])) for s in ("a", "b", "c") for _ in range(150)] + [("a", None, 90.0, 95.0)]
    a = spark.createDataFrame([(i, s, "1h", None if t is None else t * HOUR, lo, hi) for i, (s, t, lo, hi) in enumerate(asks)], "id int, symbol string, timeframe string, st long, lo double, hi double")
    got = {r.id: None if r.x is None else r.x.open_time // HOUR for r in search.first_touch(b, a, "st", "lo", "hi").collect()}
    for i, (s, t, lo, hi) in enumerate(asks):
        want = next((u for x, u, m in bars if t is not None and x == s and u >= t and (lo is not None and m - 1 <= lo or hi is not None and m + 1 >= hi)), None)
        assert got[i] == want
    assert len(got) == len(asks)
