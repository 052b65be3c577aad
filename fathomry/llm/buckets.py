"""Candidate pairs from rows that share a bucket, filtered by the Hamming distance of 128-bit codes.

Rows ``(key, id, c1, c2)`` are placed and sorted by key; each run of one key is compared within itself, a vector at a
time, while it streams by. Up to ``limit`` rows of a bucket are compared all with all, which is work in proportion to the
rows. A larger bucket isn't cut: its rows come out as they are (``b`` null) for the caller's exact way, and with ``stars``
each of them is compared with the bucket's first row. Where only connections count, buckets full of near pairs go that way,
too, so that groups of any size give pairs in proportion to their rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.fragment import skewed_join
from ..sources.shipping import map_arrow

#: Rows of a bucket that are compared all with all; near pairs for each row from which on stars take their place.
LIMIT, DENSE = 4096, 16
SCHEMA = "key bigint, a bigint, b bigint, c1 bigint, c2 bigint"
#: Whether two rows may be similar: (c1, c2 of one, c1, c2 of the other) as arrays of uint64.
Near = Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray], np.ndarray]


def within(radius: int) -> Near:
    def near(p1, p2, q1, q2):
        return np.bitwise_count(p1 ^ q1).astype(np.int16) + np.bitwise_count(p2 ^ q2) <= radius

    return near


def _pairs(rows: np.ndarray, begin: np.ndarray, size: np.ndarray, near: Near, dense: int | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row numbers of near pairs within runs, and which runs have more than ``dense`` of them for each row.

    Such runs are given up as soon as that shows; their pairs are left out.
    """
    at = np.arange(rows.shape[1])
    run = np.repeat(np.arange(len(size)), size)
    end = np.repeat(begin + size, size)
    c1, c2 = rows[2].view(np.uint64), rows[3].view(np.uint64)
    left, right, step = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)], 1
    full, found = np.zeros(len(size), dtype=bool), np.zeros(len(size), dtype=np.int64)
    live = at[at + 1 < end]
    while len(live):
        other = live + step
        hit = near(c1[live], c2[live], c1[other], c2[other])
        left.append(live[hit])
        right.append(other[hit])
        step += 1
        live = live[live + step < end[live]]
        if dense is not None:
            found += np.bincount(run[left[-1]], minlength=len(size))
            full |= found > dense * size
            live = live[~full[run[live]]]
    i, j = np.concatenate(left), np.concatenate(right)
    kept = ~full[run[i]]
    return i[kept], j[kept], full


def _stream(near: Near, limit: int, stars: bool, dense: int | None):
    def pairs_out(i: np.ndarray, j: np.ndarray) -> pa.RecordBatch:
        none = pa.nulls(len(i), pa.int64())
        return pa.RecordBatch.from_arrays([none, pa.array(np.minimum(i, j)), pa.array(np.maximum(i, j)), none, none], names=["key", "a", "b", "c1", "c2"])

    def large(rows: np.ndarray, first: np.ndarray) -> Iterator[pa.RecordBatch]:
        n = rows.shape[1]
        yield pa.RecordBatch.from_arrays(
            [pa.array(rows[0]), pa.array(rows[1]), pa.nulls(n, pa.int64()), pa.array(rows[2]), pa.array(rows[3])], names=["key", "a", "b", "c1", "c2"]
        )
        if stars:
            f = first.view(np.uint64)
            c1, c2 = rows[2].view(np.uint64), rows[3].view(np.uint64)
            hit = near(np.full(n, f[2]), np.full(n, f[3]), c1, c2) & (rows[1] != first[1])
            if hit.any():
                yield pairs_out(np.full(int(hit.sum()), first[1]), rows[1][hit])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_ = np.zeros((4, 0), dtype=np.int64)
        passing: np.ndarray | None = None  # first row of a large bucket that is streaming by
        for b in batches:
            if not b.num_rows:
                continue
            rows = np.concatenate([open_, np.stack([c.to_numpy(zero_copy_only=False) for c in b.columns])], axis=1)
            turn = np.flatnonzero(np.concatenate([[True], rows[0][1:] != rows[0][:-1]]))
            size = np.diff(np.append(turn, rows.shape[1]))
            if passing is not None:
                if rows[0][0] == passing[0]:
                    yield from large(rows[:, : size[0]], passing)
                    rows, turn, size = rows[:, size[0] :], turn[1:] - size[0], size[1:]
                    if len(size) == 0:
                        open_ = rows
                        continue
                passing = None
            # The last bucket may go on in the next batch.
            last = int(turn[-1])
            open_, rows, turn, size = rows[:, last:], rows[:, :last], turn[:-1], size[:-1]
            if open_.shape[1] > limit:
                passing = open_[:, 0].copy()
                yield from large(open_, passing)
                open_ = open_[:, :0]
            yield from settle(rows, turn, size)
        if open_.shape[1]:
            yield from settle(open_, np.zeros(1, dtype=np.int64), np.array([open_.shape[1]]))

    def settle(rows: np.ndarray, turn: np.ndarray, size: np.ndarray) -> Iterator[pa.RecordBatch]:
        for k in np.flatnonzero(size > limit):
            part = rows[:, turn[k] : turn[k] + size[k]]
            yield from large(part, part[:, 0].copy())
        several = (size > 1) & (size <= limit)
        if several.any():
            keep = np.repeat(several, size)
            rows, size = np.ascontiguousarray(rows[:, keep]), size[several]
            begin = np.cumsum(size) - size
            i, j, full = _pairs(rows, begin, size, near, dense)
            for k in np.flatnonzero(full):
                part = rows[:, begin[k] : begin[k] + size[k]]
                yield from large(part, part[:, 0].copy())
            differ = rows[1][i] != rows[1][j]
            i, j = rows[1][i[differ]], rows[1][j[differ]]
            if len(i):
                yield pairs_out(i, j)

    return run


def bucket_pairs(rows: DataFrame, near: Near, limit: int = LIMIT, stars: bool = False, dense: int | None = None) -> DataFrame:
    """Near pairs ``a < b`` (``key`` null; a pair comes once for each bucket it shares) and rows of larger buckets.

    With ``dense`` a bucket that has more than so many near pairs for each of its rows counts as a large one, too.
    """
    placed = rows.select("key", "id", "c1", "c2").repartition("key").sortWithinPartitions("key", "id")
    return map_arrow(placed, _stream(near, limit, stars, dense), SCHEMA)


def distinct_pairs(found: DataFrame) -> DataFrame:
    return found.where(F.col("b").isNotNull()).select("a", "b").distinct()


def popcount(p: str, q: str):
    return F.bit_count(F.col(p).bitwiseXOR(F.col(q)))


def overlap_at_least(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """Pairs ``(a, b)`` whose sets ``(id, items array)`` have at least ``num / den`` of their elements in common.

    A set with many partners is spread over tasks by load. ``pairs`` should be stored, as it is counted, too.
    """
    left = sets.select(F.col("id").alias("a"), F.col("items").alias("x"))
    right = sets.select(F.col("id").alias("b"), F.col("items").alias("y"))
    both = F.size(F.array_intersect("x", "y"))
    checked = skewed_join(skewed_join(pairs, left, "a", "left"), right, "b", "left").withColumn("both", both)
    return checked.where(F.col("both") * (den + num) >= (F.size("x") + F.size("y")) * num).select("a", "b")
