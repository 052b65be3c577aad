"""Structured Streaming forms of the window operators."""

from __future__ import annotations

import bisect
import heapq
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..sources.shipping import ship


def event_time(events: DataFrame, ts: str = "ms") -> DataFrame:
    """``events`` with ``at``, their time as a timestamp."""
    return events.withColumn("at", F.timestamp_millis(F.col(ts)))


def once(events: DataFrame, event_id: str, late: str) -> DataFrame:
    """Repeated deliveries within the watermark ``late`` folded to the first."""
    return events.withWatermark("at", late).dropDuplicatesWithinWatermark([event_id])


def minute_bursts(events: DataFrame, key: str, late: str = "1 day") -> DataFrame:
    """Rows of each key in each minute, updated while late rows may come."""
    minute = F.window("at", "1 minute")
    return events.withWatermark("at", late).groupBy(key, minute).agg(F.count("*").alias("n")).select(key, F.col("window.start").alias("minute"), "n")


def live_sessions(events: DataFrame, key: str, gap: str = "30 minutes", late: str = "1 day") -> DataFrame:
    """Sessions by inactivity, emitted when the watermark has passed their end."""
    s = F.session_window("at", gap)
    out = events.withWatermark("at", late).groupBy(key, s).agg(F.count("*").alias("events"), F.min("at").alias("started"), F.max("at").alias("ended"))
    return out.select(key, "started", "ended", "events")


def rolling_members(events: DataFrame, key: str, member: str, ms: str, window_ms: int, late: str = "1 hour") -> DataFrame:
    """Live members of each key after each row: every row keeps its member alive for ``window_ms``.

    ``events`` has ``at`` (:func:`event_time`). Rows wait in the state until the watermark, ``late`` behind the latest row,
    has passed them, and are then taken in order of time, so rows that come late count as if they had come in time; rows
    that are later than that are left out. State is one expiry for each live member of a key and the rows that
    wait; members leave through a queue ordered by expiry, and a key that falls quiet is dropped. Null keys, members and
    times take no part.
    """
    kinds = dict(events.dtypes)

    def step(k: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        names, ends, waiting, due = state.get if state.exists else ([], [], [], [])
        now = state.getCurrentWatermarkMs()
        rows = list(zip(due, waiting, strict=True))
        if not state.hasTimedOut:
            for p in parts:
                rows += [(int(t), m) for m, t in zip(p[member], p[ms], strict=True) if t >= now]
        rows.sort()
        live = dict(zip(names, ends, strict=True))
        queue = sorted(zip(ends, names, strict=True))
        out = []
        taken = bisect.bisect_left(rows, (now,))
        for t, m in rows[:taken]:
            while queue and queue[0][0] <= t:
                end, gone = heapq.heappop(queue)
                if live.get(gone) == end:  # else it was seen again
                    del live[gone]
            live[m] = t + window_ms
            heapq.heappush(queue, (t + window_ms, m))
            out.append((k[0], m, t, len(live)))
        rows = rows[taken:]
        live = {m: e for m, e in live.items() if e > now}
        if rows or live:
            state.update((list(live), list(live.values()), [m for _, m in rows], [t for t, _ in rows]))
            state.setTimeoutTimestamp(max(now, min(rows[0][0] if rows else now + window_ms, max(live.values(), default=now + window_ms))) + 1)
        elif state.exists:
            state.remove()
        yield pd.DataFrame(out, columns=[key, member, ms, "live"])

    ship(events.sparkSession)
    known = events.where(F.col(key).isNotNull() & F.col(member).isNotNull() & F.col(ms).isNotNull()).withColumn(member, F.col(member).cast("string"))
    schema = f"{key} {kinds[key]}, {member} string, {ms} bigint, live bigint"
    kept = "names array<string>, ends array<bigint>, waiting array<string>, due array<bigint>"
    return known.withWatermark("at", late).groupBy(key).applyInPandasWithState(step, schema, kept, "append", GroupStateTimeout.EventTimeTimeout)


def in_batches(stream: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str):
    """Runs a batch operator (identification, maintenance, upserts) on each micro-batch of a stream."""
    return stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
