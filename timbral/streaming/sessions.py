"""Streams: windowed signal levels and the keyed state of verification sessions."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

SESSION = "session string, state string, attempts int"


def windowed_levels(samples: DataFrame, width: str = "1 second", slide: str = "128 milliseconds", late: str = "10 seconds") -> DataFrame:
    """Rms, peak and count per device over sliding windows of samples (device, ts, x);
    works on a stream and on a table. Samples later than `late` are dropped by the watermark."""
    rows = samples.withWatermark("ts", late) if samples.isStreaming else samples
    levels = rows.groupBy("device", F.window("ts", width, slide).alias("w")).agg(F.sqrt(F.avg(F.col("x") * F.col("x"))).alias("rms"), F.max(F.abs("x")).alias("peak"), F.count("*").alias("n"))
    return levels.select("device", F.col("w.start").alias("start"), "rms", "peak", "n")


def step(state: str, attempts: int, outcomes: list[bool], retries: int) -> tuple[str, int]:
    """What a pending session becomes after some outcomes; verified and failed stay."""
    for ok in outcomes:
        if state != "pending":
            break
        attempts += 1
        state = "verified" if ok else "failed" if attempts > retries else "pending"
    return state, attempts


def session_stream(attempts: DataFrame, retries: int = 3, ttl: str = "120 seconds", late: str = "10 seconds") -> DataFrame:
    """(session, state, attempts) updates of a stream (session, seq, ok, ts).

    A session expires ttl after its first attempt in event time, whatever comes in between:
    attempts from then on do not count, and a pending session becomes expired as soon as the
    watermark (`late` behind the newest attempt) or a later attempt of its own passes that time. A
    session that has ended is kept until then, so that late attempts change nothing, is reported
    once, and is forgotten afterwards.
    """
    limit = int(pd.Timedelta(ttl).total_seconds() * 1000)
    shape = "state string, attempts int, until long"

    def row(key: tuple, state: str, n: int) -> pd.DataFrame:
        return pd.DataFrame({"session": [key[0]], "state": [state], "attempts": [n]})

    def advance(key: tuple, parts: Iterator[pd.DataFrame], group: GroupState) -> Iterator[pd.DataFrame]:
        if group.hasTimedOut:
            state, n, _ = group.get
            group.remove()
            if state == "pending":
                yield row(key, "expired", n)
            return
        rows = pd.concat(list(parts)).sort_values("seq")
        at = rows["ts"].map(lambda t: int(t.timestamp() * 1000))
        before = group.get if group.exists else ("pending", 0, int(at.min()) + limit)
        state, n = step(before[0], before[1], rows["ok"][at < before[2]].tolist(), retries)
        if state == "pending" and (at >= before[2]).any():
            state = "expired"
        passed = before[2] <= group.getCurrentWatermarkMs()
        if state == "pending" and passed:
            state = "expired"
        if passed:
            group.remove()
        else:
            group.update((state, n, before[2]))
            group.setTimeoutTimestamp(before[2])
        if (state, n) != before[:2]:
            yield row(key, state, n)

    timed = attempts.withWatermark("ts", late)
    return timed.groupBy("session").applyInPandasWithState(advance, SESSION, shape, "update", GroupStateTimeout.EventTimeTimeout)
