"""Closed bars as a stream that can fall behind: each is replayed once, with the bars before it."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

from ..sources.tables import TF_MS

VALUES = ("open_time", "open", "high", "low", "close", "volume")
BAR = "struct<open_time: long, open: double, high: double, low: double, close: double, volume: double>"
#: Bars that detectors see, the one they are asked about included.
KEEP = 200


def catch_up(bars: DataFrame, keep: int = KEEP, max_age_hours: float = 0.0) -> DataFrame:
    """Replay each closed bar of a stream once: ``symbol, timeframe, open_time, status, now_ms, context``.

    ``bars`` has the bar's values and ``seen_ms``, when a row arrived; the latest arrival of a series is its clock, so a batch that is
    tried again gives the same rows. A bar that hasn't closed by that clock waits. Of a series seen for the first time only the
    newest closed bar is replayed; after that, all that are newer than the last one. ``alert`` is the newest, or one that closed
    within ``max_age_hours``; the rest are ``backfill``, for the ledger alone. A bar that comes late, or is restated after it was
    replayed, is ``late``: it mends the context of the bars to come and is told, but not replayed; the same bar again is nothing.
    ``context`` has the last ``keep`` bars up to the replayed one; state holds as many of each series, and those that wait.
    """
    names = ["symbol", "timeframe", "open_time", "status", "now_ms", "context"]

    def run(key, frames, state):
        mark, now, raw = state.get if state.exists else (None, 0, b"")
        held = {int(r[0]): tuple(r[1:]) for r in np.frombuffer(raw).reshape(-1, len(VALUES)).tolist()}
        width, out = TF_MS[key[1]], []
        for frame in frames:
            now = max(now, int(frame["seen_ms"].max()))
            for t, *values in sorted(frame[list(VALUES)].itertuples(index=False, name=None)):
                t, values = int(t), tuple(map(float, values))
                if mark is not None and t <= mark and held.get(t) != values:
                    out.append((*key, t, "late", now, []))
                held[t] = values
        times = sorted(held)
        closed = [t for t in times if t + width <= now]
        for n, t in enumerate(closed):
            if t > mark if mark is not None else t == closed[-1]:
                young = max_age_hours > 0 and now - (t + width) <= max_age_hours * 3_600_000
                seen = [dict(zip(VALUES, (x, *held[x]), strict=True)) for x in closed[max(0, n + 1 - keep) : n + 1]]
                out.append((*key, t, "alert" if young or t == closed[-1] else "backfill", now, seen))
        if closed:
            mark = max(closed[-1], mark or closed[-1])
        kept = closed[-keep:] + [t for t in times if t + width > now]
        state.update((mark, now, np.array([(t, *held[t]) for t in kept], float).tobytes()))
        yield pd.DataFrame(out, columns=names)

    rows = bars.select("symbol", "timeframe", *(F.col(c).cast("double").alias(c) if c != "open_time" else F.col(c) for c in VALUES), "seen_ms")
    return rows.groupBy("symbol", "timeframe").applyInPandasWithState(run, f"symbol string, timeframe string, open_time long, status string, now_ms long, context array<{BAR}>", "mark long, now long, held binary", "append", GroupStateTimeout.NoTimeout)


def last_bar(replayed: DataFrame) -> DataFrame:
    """Replayed bars with the values of the bar itself, for detectors that need no more; late ones have none."""
    x = replayed.withColumn("_b", F.get("context", F.size("context") - 1))
    return x.select("symbol", "timeframe", "open_time", "status", F.size("context").alias("n_context"), *(F.col("_b")[c].alias(c) for c in VALUES[1:]))


def in_batches(table: DataFrame, part: str, path: str) -> None:
    """Write a table as one file for each value of ``part``, in order: what a stream would have found, a file a batch."""
    for (value,) in table.select(part).distinct().orderBy(part).collect():  # one row a batch
        table.where(F.col(part) == value).drop(part).coalesce(1).write.mode("append").parquet(path)
