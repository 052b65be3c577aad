"""Sessions by inactivity gap, from occupancy bitmaps closed by doubling shifts.

An entity's time stamps are the set bits of a bitmap with one bit for each millisecond. A gap of at most ``gap`` means
that dilating every bit by ``gap`` positions joins its neighbours; runs of the dilated bitmap, with the dilation taken
off their ends again, are the sessions. A bit for each millisecond would be mostly zeros, so the bitmap is kept run-length
coded (start and end of each run of ones); OR-ing it with a copy of itself shifted by ``w`` is then a merge of runs, and
log2(gap) shifts of doubling width give the whole dilation.

Distribution: rows are placed by (entity, slice of time), so an entity that holds a third of all rows is spread over all
its slices. Each Arrow batch is turned into fragments at once (nothing is gathered for an entity); fragments that touch
across batch or slice borders are stitched by one window over the fragments, of which an entity has at most one for each
gap and slice of time, however many rows it has.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shipping import map_arrow
from pyspark.sql.window import Window


def dilate(starts: np.ndarray, ends: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Runs of the bitmap dilated forward to ``width`` positions for each bit, by shifts that double.

    ``starts`` ascend; runs are inclusive and don't overlap. Runs that touch become one.
    """
    have = 1
    while True:
        head = np.ones(len(starts), dtype=bool)
        head[1:] = starts[1:] > ends[:-1] + 1
        tail = np.ones(len(starts), dtype=bool)
        tail[:-1] = head[1:]
        starts, ends = starts[head], ends[tail]
        if have == width:
            return starts, ends
        shift = min(have, width - have)
        ends = ends + shift  # a run is at least `have` long, so it and its shifted copy are one run
        have += shift


def _fragments(gap: int, slice_ms: int):
    stride = slice_ms + 2 * gap + 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            entity = batch.column("entity")
            ms = batch.column("ms").to_numpy(zero_copy_only=False)
            ids = batch.column("event_id")
            known = np.asarray(ids.is_valid())
            event = ids.fill_null(0).to_numpy(zero_copy_only=False)
            code = entity.dictionary_encode().indices.to_numpy(zero_copy_only=False)
            piece = ms // slice_ms
            # Rows are sorted by entity, slice, time and event: a repeated delivery follows its first.
            same = np.zeros(len(ms), dtype=bool)
            same[1:] = (code[1:] == code[:-1]) & (ms[1:] == ms[:-1]) & (event[1:] == event[:-1]) & known[1:] & known[:-1]
            first = (entity[0].as_py(), int(ms[0]), int(event[0]), bool(known[0]))
            same[0] = first[3] and first == last
            last = (entity[len(ms) - 1].as_py(), int(ms[-1]), int(event[-1]), bool(known[-1]))
            keep = np.flatnonzero(~same)
            if not len(keep):
                continue
            ms, code, piece = ms[keep], code[keep], piece[keep]
            turn = np.ones(len(ms), dtype=bool)
            turn[1:] = (code[1:] != code[:-1]) | (piece[1:] != piece[:-1])
            # One bitmap for the batch: each (entity, slice) has its own stretch, further apart than a gap.
            at = (np.cumsum(turn) - 1) * stride + (ms - piece * slice_ms)
            bits = np.ones(len(at), dtype=bool)
            bits[1:] = at[1:] != at[:-1]
            starts, ends = dilate(at[bits], at[bits], gap)
            lo = np.searchsorted(at, starts, side="left")
            counts = np.diff(np.append(lo, len(at)))
            first_ms = ms[lo]
            last_ms = first_ms + (ends - (gap - 1) - starts)
            yield pa.RecordBatch.from_arrays(
                [entity.take(pa.array(keep[lo])), pa.array(first_ms), pa.array(last_ms), pa.array(counts)],
                names=["entity", "start_ms", "end_ms", "events"],
            )

    return run


def sessions(events: DataFrame, entity: str, ms: str, event_id: str, gap_ms: int, slice_ms: int = 6 * 3_600_000) -> DataFrame:
    """Sessions ``(entity, start_ms, end_ms, duration_ms, events)``: neighbours at most ``gap_ms`` apart belong together.

    Defined cases: rows whose entity or time is null take no part; equal times count each event; rows with the same
    ``event_id`` at the same time of an entity are one event; a null ``event_id`` is never a repeat, so each such row
    counts; a single event is a session of duration 0; an empty input gives no rows; other columns of ``events`` are
    ignored, whatever their names. ``gap_ms`` is at least 1, ``slice_ms`` only steers distribution.
    """
    if gap_ms < 1 or slice_ms < 1:
        raise ValueError("gap_ms and slice_ms must be positive")
    rows = events.select(
        F.col(entity).cast("string").alias("entity"), F.col(ms).cast("bigint").alias("ms"), F.col(event_id).cast("bigint").alias("event_id")
    ).where("entity is not null and ms is not null")
    placed = rows.withColumn("slice", F.floor(F.col("ms") / F.lit(slice_ms))).repartition("entity", "slice")
    parts = placed.sortWithinPartitions("entity", "slice", "ms", "event_id").select("entity", "ms", "event_id")
    fragments = map_arrow(parts, _fragments(gap_ms, slice_ms), "entity string, start_ms bigint, end_ms bigint, events bigint")
    order = Window.partitionBy("entity").orderBy("start_ms", "end_ms")
    opens = F.col("start_ms") - F.lag("end_ms").over(order) > F.lit(gap_ms)
    numbered = fragments.withColumn("opens", F.coalesce(opens, F.lit(True)).cast("bigint")).withColumn("session", F.sum("opens").over(order))
    return numbered.groupBy("entity", "session").agg(
        F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms"), F.sum("events").alias("events")
    ).select("entity", "start_ms", "end_ms", (F.col("end_ms") - F.col("start_ms")).alias("duration_ms"), "events")
