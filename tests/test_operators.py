"""What SQL can't tell: greedy folds, exits, overfitting, streams, odd rows."""

import itertools
import random

import numpy as np

from barloom.functions import statistics
from barloom.operators import cones, confluence, detectors, exits, quality, reports, simulate, zones
from barloom.streaming import bars as streams

BAR = "symbol string, timeframe string, open_time long, open double, high double, low double, close double, volume double"
HOUR = 3_600_000


def frame(spark, rows):
    return spark.createDataFrame([("X", "1h", i * HOUR, *map(float, r)) for i, r in enumerate(rows)], BAR)


def signals(spark, rows):
    return spark.createDataFrame([("X", "1h", "s", t * HOUR, side, sl) for t, side, sl in rows], "symbol string, timeframe string, strategy string, open_time long, direction string, sl_price double")


def test_exits(spark):
    flat = (100, 101, 99, 100, 1)
    bars = frame(spark, [flat, flat, (100, 105, 90, 100, 1), flat, flat, (80, 81, 79, 80, 1), flat, flat])
    got = {(r.signal_time // HOUR, r.direction): (r.outcome, r.exit, r.pnl_r) for r in simulate.simulate(bars, signals(spark, [(0, "long", 95.0), (3, "long", 97.0), (5, "short", 200.0), (7, "long", 90.0), (99, "long", 1.0)]), tp_r=1.0).collect()}
    assert got == {(0, "long"): ("loss", 95.0, -1.0), (3, "long"): ("loss", 80.0, -20 / 3), (5, "short"): ("open", None, None)}


def test_exits_are_found_however_far_off(spark):
    rows = [(100, 101, 99, 100, 1)] * 1500 + [(100, 140, 99, 120, 1)]
    bars = frame(spark, rows)
    asks = signals(spark, [(0, "long", 90.0), (900, "long", 90.0), (1490, "short", 130.0), (3, "short", 50.0)])
    got = {(r.signal_time // HOUR, r.direction): (r.outcome, r.exit, (r.exit_time or 0) // HOUR) for r in simulate.simulate(bars, asks).collect()}
    assert got == {(0, "long"): ("win", 120.0, 1500), (900, "long"): ("win", 120.0, 1500), (1490, "short"): ("loss", 130.0, 1500), (3, "short"): ("loss", 50.0, 4)}


def test_rules_of_stops_and_costs(spark):
    rows = [(100, 102, 98, 100, 1000)] * 30 + [(100, 103, 97, 100, 10)] * 10
    bars = frame(spark, rows)
    one = lambda **rules: {(r.signal_time // HOUR, r.direction): r for r in simulate.simulate(bars, signals(spark, [(25, "long", 99.5), (25, "short", None), (35, "long", 99.0)]), **rules).collect()}
    plain = one()
    assert plain[25, "long"].sl == 99.5 and plain[25, "long"].tp == 101.0 and plain[25, "short"].sl == 102.0 and plain[25, "short"].exit == 102.0
    assert one(min_sl_pct=0.02)[25, "long"].sl == 98.0 and one(tp_r_long=4.0)[25, "long"].tp == 102.0 and one(tp_r_long=4.0)[25, "short"].tp == plain[25, "short"].tp
    assert one(atr_multiple=2.0)[25, "short"].sl == 108.0 and one(atr_multiple=2.0)[25, "long"].sl == 99.5 and one(atr_multiple=2.0, atr_floor=True)[25, "long"].sl == 92.0
    assert (35, "long") not in one(suppress=True) and (35, "long") in one(suppress=True, suppress_long=False) and (25, "long") not in one(suppress_long=True)
    r = one(costs=simulate.Costs())[25, "long"]
    assert abs(r.spread_r - 2 * 20 / 10_000 * 100 / 0.5) < 1e-12 and r.impact_r == 0 and r.borrow_r == 0 and abs(r.pnl_r - ((r.exit - r.entry) / 0.5 - r.cost_r)) < 1e-12


def test_gates_of_higher_timeframes(spark):
    s = signals(spark, [(t, side, None) for t in (5, 9, 13) for side in ("long", "short")])
    high = spark.createDataFrame([("X", i * 4 * HOUR, r, v) for i, (r, v) in enumerate([("trend", 0.1), ("range", -0.1), ("unknown", None)])], "symbol string, open_time long, regime string, slope double")
    kept = lambda df: {(r.open_time // HOUR, r.direction) for r in df.collect()}
    assert kept(simulate.regime_gate(s, high, {"s": ["range"]})) == {(9, "long"), (9, "short"), (13, "long"), (13, "short")}
    assert kept(simulate.trend_gate(s, high, 0.05)) == {(5, "long"), (9, "short"), (13, "short")}
    assert kept(simulate.trend_gate(s, high, 0.5)) == kept(s) and kept(simulate.regime_gate(s, high.limit(0), {"s": []})) == kept(s)


def test_replayed_exits(spark):
    bars = frame(spark, [(100, 100, 100, 100, 1), (100, 106, 100, 105, 1), (105, 106, 99, 101, 1), (101, 125, 101, 120, 1)])
    alerts = spark.createDataFrame([("X", "1h", 0, "long", 100.0, 95.0), ("X", "1h", 0, "short", 100.0, 95.0), ("X", "1h", 3 * HOUR, "long", 100.0, 95.0)], "symbol string, timeframe string, open_time long, direction string, entry double, sl double")
    one = lambda **p: [(r.outcome, r.realized_r, r.exit_bar, r.partial_taken) for r in exits.replay(bars, alerts.where("direction = 'long'"), exits.Policy("p", **p)).collect()]
    assert one(tp_r=3.0, hold=10) == [("win", 3.0, 2, False)]
    assert one(tp_r=3.0, hold=10, breakeven_r=1.0) == [("breakeven", 0.0, 1, False)]
    assert one(tp_r=3.0, hold=10, breakeven_r=1.0, partial=0.5, partial_r=1.0) == [("breakeven", 0.5, 1, True)]
    assert one(tp_r=3.0, hold=2) == [("expired", 0.2, 1, False)] and one(tp_r=9.0, hold=10, partial=0.5, partial_r=1.0) == [("expired", 0.5 + 0.5 * 4.0, 2, True)]
    assert exits.replay(bars, alerts.limit(0), exits.Policy("p", 1.0, 3)).count() == 0


def test_cones_of_sessions(spark):
    rng = np.random.default_rng(6)
    rows = [("X", "1h", (d * 24 + 13 + h) * HOUR, *(100 + rng.random(4) * [0, 5, -5, 2]), 1.0) for d in range(40) for h in range(7) if (d, h) != (20, 3)]
    bars = spark.createDataFrame([tuple(float(v) if i > 2 else v for i, v in enumerate(r)) for r in rows], BAR)
    rec = cones.records(cones.session(bars)).collect()
    assert len(rec) == 39 - 14 and all(len(r.path) == 7 and r.mae <= r.mfe and r.high_mag >= 0 for r in rec)
    now = (39 * 24 + 15) * HOUR
    cur = cones.current_path(bars.where(f"open_time <= {now}"), now).first()
    assert cur.elapsed == 2 and len(cur.points) == 3 and cones.records(bars, now_ms=now).count() == 24 and cones.current_path(bars.limit(0), now).count() == 0
    assert cones.records(bars.where("symbol = 'X'"), "week", 49, 2).count() > 0  # a session on every day of the week


def test_cooldown_is_from_the_last_kept(spark):
    rows = signals(spark, [(t, "long", None) for t in (0, 3, 5, 9, 11)])
    assert sorted(r.open_time // HOUR for r in simulate.cooldown(rows, 5, HOUR).collect()) == [0, 5, 11]


def test_cofire_uses_each_signal_once(spark):
    bars = frame(spark, [(1, 2, 0.5, 1, 1)] * 20)
    a, b = signals(spark, [(2, "long", 1.0), (4, "long", 2.0), (15, "long", 3.0)]), signals(spark, [(3, "long", 9.0), (8, "long", 8.0), (15, "short", 7.0)])
    assert {(r.idx_a, r.idx_b, r.open_time // HOUR, r.sl_price) for r in confluence.cofire(bars, a, b, 5).collect()} == {(3, 4, 3, 9.0), (5, 9, 8, 8.0)}


def test_checks_and_empty_series(spark):
    bars = frame(spark, [(1, 2, 0.5, 1, 5), (1, 0.5, 2, 1, 5), (-1, 1, -2, 1, 5), (1, 5, 1, 4, 0), (4, 4, 4, 4, 0), (4, 4, 4, 4, 0)])
    r = quality.check(bars).orderBy("open_time").collect()
    assert [x.bad_geometry for x in r] == [False, True, False, False, False, False] and [x.frozen for x in r] == [False] * 4 + [True, True] and r[3].split_like and r[2].non_positive
    clean, bad = quality.quarantine(quality.check(bars))
    assert clean.count() == 4 and bad.count() == 2
    none = bars.limit(0)
    assert detectors.detect_all(none).count() == 0 and reports.adr(none).count() == 0 and simulate.simulate(none, signals(spark, [(0, "long", 1.0)])).count() == 0


def test_overfit_odds(spark):
    rng = np.random.default_rng(0)

    def odds(matrix):
        rows = [(f"t{k:02d}", i, float(v)) for (i, k), v in np.ndenumerate(matrix)]
        return statistics.backtest_overfitting(spark.createDataFrame(rows, "t string, at long, r double"), "t", "at", "r", bins=32, splits=8).first()

    def plain(matrix, parts):
        low = []
        for c in itertools.combinations(range(8), 4):
            inside = sum(parts[i] for i in c)
            outside = sum(parts[i] for i in range(8) if i not in c)
            own = outside[inside.argmax()]
            low.append(((outside < own).sum() + 0.5 * ((outside == own).sum() - 1) + 1) / (len(outside) + 1) < 0.5)
        return np.mean(low)

    noise = rng.normal(size=(64, 20))
    got = odds(noise)
    block = np.minimum(np.arange(64) * 32 // 63, 31) * 8 // 32
    assert got.trials == 20 and abs(got.pbo - plain(noise, [noise[block == i].sum(0) for i in range(8)])) < 1e-12
    noise[:, 3] += 2
    assert odds(noise).pbo == 0


def test_bootstrap_covers_the_mean(spark):
    rng = np.random.default_rng(1)
    rows = [("a", i % 50, float(v)) for i, v in enumerate(rng.normal(1.0, 1.0, 500))]
    r = statistics.bootstrap_mean(spark.createDataFrame(rows, "k string, c long, v double"), ["k"], "c", "v").first()
    assert r.lo < r["mean"] < r.hi and 0.1 < r.hi - r.lo < 0.3


def test_deflated_sharpe_is_below_the_odds(spark):
    rng = np.random.default_rng(2)
    rows = [(f"t{k}", float(v)) for k in range(10) for v in rng.normal(0.05 * k, 1.0, 100)]
    df = spark.createDataFrame(rows, "t string, v double")
    odds = {r.t: r.psr for r in statistics.sharpe_odds(df, ["t"], "v").collect()}
    deflated = {r.t: r.dsr for r in statistics.deflated_sharpe(df, ["t"], "v").collect()}
    assert all(0 <= deflated[t] <= odds[t] <= 1 for t in odds)


def test_stream_sends_each_alert_once(spark, tmp_path):
    schema = "symbol string, open_time long"
    for k, rows in enumerate([[("a", 1), ("a", 2), ("b", 5)], [("a", 2), ("a", 3), ("b", 4)]]):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / f"in{k}"))
    s = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path))
    got = [(r.symbol, r.open_time) for r in streams.drain(streams.fresh_alerts(s, ["symbol"]), "alerts").collect()]
    assert len(got) == len(set(got)) and ("a", 3) in got and ("b", 5) in got


def test_zones_of_empty_and_short_series(spark):
    few = frame(spark, [(1, 2, 0.5, 1, 1)] * 5)
    for f in (zones.gap_boxes, zones.order_blocks, zones.structure_levels, zones.swing_points, zones.equal_pools, zones.golden_box, zones.ote_box):
        assert f(few).count() == 0 and f(few.limit(0)).count() == 0


def test_equal_pools_at_a_price_of_zero(spark):
    lows = {8: 0.0, 20: 0.0, 32: 40.0, 44: 40.1}
    got = zones.equal_pools(frame(spark, [(100, 101, lows.get(i, 90 + i * 0.01), 100, 1) for i in range(60)])).where("zone_type = 'eql'").collect()
    assert [(r.start_ms // HOUR, r.zone_low, r.active) for r in got] == [(32, 40.05, True)]


def test_drawdowns_are_averaged_exactly(spark):
    rng = random.Random(11)
    fifths = [rng.randint(0, 9000) for _ in range(128)]  # of R; their mean lies half way between two sixth places
    df = spark.createDataFrame([("s", 9, 0.1, x / 5, 1.0) for x in fifths], "strategy string, closed_trades long, avg_r double, max_drawdown_r double, recovery_factor double").coalesce(1)
    assert reports.recovery(df).first().avg_max_dd_r == sum(fifths) / 640


def test_structure_of_bars(spark):
    rng = np.random.default_rng(4)
    p = 100 + rng.normal(size=300).cumsum()
    rows = [(a, max(a, b) + 0.5, min(a, b) - 0.5, b, 1) for a, b in itertools.pairwise(p)]
    bars = frame(spark, rows)
    for name, detect in detectors.REGISTRY.items():
        r = detect(bars).collect()
        assert all(x.direction in ("long", "short") for x in r) and len({x.open_time for x in r}) == len(r) or name == "orb_breakout"
