"""Distinct counts by mergeable registers with a tunable logarithmic base.

A sketch has ``m`` registers. An identifier's hash picks a register and a level ``k >= 1`` with ``P(level > k) = base**-k``;
a register keeps the greatest level, so sketches merge by maximum, in any order and any grouping. A base near 1 gives
finer levels (and more register values), which matters for comparing sketches; the error is about ``1 / sqrt(m)``.

Estimates are maximum likelihood under Poisson arrivals: a register is at most ``k`` with probability
``exp(-x * base**-k)``, where ``x`` is identifiers per register, from empty to full sketches in one model. Two sketches
share ``g`` of ``a`` and ``b`` identifiers per register with
``P(A <= i, B <= j) = exp(-((a - g) * base**-i + (b - g) * base**-j + g * base**-min(i, j)))``; ``a``, ``b`` and ``g`` are found together by
maximum likelihood over all registers, which gives union, intersection and Jaccard with their errors.

Stored sparsely: a sketch is the list of its non-empty registers (4 bytes each), so a group of three identifiers takes 12
bytes and the largest group ``4 * m`` for each counted column.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.shipping import map_arrow


@dataclass(frozen=True)
class Registers:
    """``m`` registers (a power of two up to 2**14) for each counted column, base between 1.001 and 4."""

    m: int = 4096
    base: float = 1.08

    def __post_init__(self):
        if self.m & (self.m - 1) or not 16 <= self.m <= 1 << 14 or not 1.001 <= self.base <= 4:
            raise ValueError("m must be a power of two in 16 .. 16384 and base in 1.001 .. 4")

    def levels(self, hashed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Register and level of each 64-bit hash: low bits pick the register, the upper 50 the level."""
        h = hashed.astype(np.int64).view(np.uint64)
        u = ((h >> np.uint64(14)).astype(np.float64) + 0.5) / 2.0**50
        return (h & np.uint64(self.m - 1)).astype(np.int64), np.floor(-np.log(u) / math.log(self.base)).astype(np.int64) + 1

    def estimate(self, row: np.ndarray, level: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
        """Count and its standard error for each of ``rows`` sketches, given their non-empty registers."""
        low = self.base ** -level.astype(np.float64)
        step = (self.base - 1) * low
        filled = np.bincount(row, minlength=rows).astype(np.float64)
        rest = self.m - filled + np.bincount(row, low, rows)
        # The derivative of the log-likelihood falls and is convex in x: Newton from below goes up to its root.
        x = filled / np.maximum(rest + np.bincount(row, step, rows) / 2, 1e-300)
        slope = np.ones(rows)
        for _ in range(12):
            t = step * x[row]
            grown = np.expm1(np.maximum(t, 1e-300))
            value = np.bincount(row, step / grown, rows) - rest
            slope = np.bincount(row, step * step * (grown + 1) / (grown * grown), rows)
            moved = np.where(filled > 0, value / np.maximum(slope, 1e-300), 0)
            x = x + moved
            if np.all(np.abs(moved) <= 1e-10 * x):
                break
        count = self.m * x
        # The model's variance holds that of the Poisson number of identifiers, which is no error of the estimate.
        error = np.sqrt(np.maximum(self.m**2 / np.maximum(slope, 1e-300) - count, 0))
        return count, np.where(filled > 0, error, 0.0)

    def joint(self, a: np.ndarray, b: np.ndarray) -> tuple[float, float, float, float, float, float]:
        """Union, intersection and Jaccard, each followed by its standard error, for two dense register arrays (0: empty).

        The numbers only in one set, only in the other and in both are fitted together, by Fisher scoring on their logarithms;
        the errors come from the inverse of the information matrix.
        """
        levels, times = np.unique(np.stack([a, b]), axis=1, return_counts=True)
        i, j = levels.astype(np.float64)
        alone = [self._rate(x) for x in (a, b)]
        if min(alone) == 0:
            size, error = self.estimate(*self._entries(np.maximum(a, b)), 1)
            return float(size[0]), float(error[0]), 0.0, 0.0, 0.0, 0.0
        corner = []
        for di, dj, sign in ((0, 0, 1), (1, 0, -1), (0, 1, -1), (1, 1, 1)):
            there = (i >= di) & (j >= dj)
            low, other = self.base ** -(i - di), self.base ** -(j - dj)
            corner.append((there * sign, np.stack([low, other, np.maximum(low, other)])))

        def fit(rates: np.ndarray) -> tuple[float, np.ndarray]:
            """Log-likelihood, and the relative derivatives of each pair of levels' probability by the rates."""
            p, d = np.zeros(len(times)), np.zeros((3, len(times)))
            for sign, power in corner:
                f = sign * np.exp(-(rates @ power))
                p += f
                d -= f * power
            p = np.maximum(p, 1e-300)
            return float(times @ np.log(p)), d / p

        both = max(sum(alone) - self._rate(np.maximum(a, b)), 1e-3 * min(alone))
        rates = np.array([max(alone[0] - both, 1e-3 * alone[0]), max(alone[1] - both, 1e-3 * alone[1]), min(both, 0.999 * min(alone))])
        least = 1e-7 * sum(alone)
        now, slope = fit(rates)
        for _ in range(60):
            own = slope * rates[:, None]
            move = np.linalg.lstsq((own * times) @ own.T + 1e-9 * np.eye(3), own @ times, rcond=None)[0]
            step, better = 1.0, False
            while step > 1e-4 and not better:
                tried = np.maximum(rates * np.exp(np.clip(step * move, -3, 3)), least)
                value, new = fit(tried)
                better, step = value >= now, step / 2
            if not better:
                break
            gain, rates, now, slope = value - now, tried, value, new
            if gain < 1e-9:
                break
        # The model's variance holds that of the Poisson numbers of identifiers, which is no error of the estimate.
        spread = self.m**2 * np.linalg.pinv((slope * times) @ slope.T) - np.diag(self.m * rates)
        size = rates * self.m
        union = float(size.sum())
        turn = np.array([0.0, 0.0, 1 / union]) - size[2] / union**2
        error = [math.sqrt(max(float(v @ spread @ v), 0.0)) for v in (np.ones(3), np.array([0.0, 0.0, 1.0]), turn)]
        return union, error[0], float(size[2]), error[1], float(size[2]) / union, error[2]

    def _entries(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return np.zeros(int((x > 0).sum()), np.int64), x[x > 0]

    def _rate(self, x: np.ndarray) -> float:
        return float(self.estimate(*self._entries(x), 1)[0][0]) / self.m


def _pack(group: np.ndarray, slot: np.ndarray, level: np.ndarray, groups: int) -> pa.Array:
    """One binary value for each group: its greatest level by slot."""
    order = np.argsort((group << 33) | (slot << 16) | level, kind="stable")
    group, slot, level = group[order], slot[order], level[order]
    last = np.ones(len(group), dtype=bool)
    last[:-1] = (group[1:] != group[:-1]) | (slot[1:] != slot[:-1])
    packed = (slot[last] << 16 | level[last]).astype("<u4")
    ends = np.concatenate([[0], np.cumsum(np.bincount(group[last], minlength=groups))]) * 4
    if ends[-1] >= 2**31:
        raise ValueError("a batch of sketches is too large")
    return pa.Array.from_buffers(pa.binary(), groups, [None, pa.py_buffer(ends.astype("<i4").tobytes()), pa.py_buffer(packed.tobytes())])


def _unpack(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, slot and level of every entry of a binary column."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    ends = np.frombuffer(column.buffers()[1], dtype="<i4")[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(column.buffers()[2], dtype=np.uint8)[ends[0] : ends[-1]] if column.buffers()[2] else np.zeros(0, np.uint8)
    packed = data.copy().view("<u4").astype(np.int64)
    return np.repeat(np.arange(len(column)), np.diff(ends) // 4), packed >> 16, packed & 0xFFFF


def _groups(table: pa.Table, keys: list[str]) -> tuple[np.ndarray, np.ndarray, int]:
    """Number of each row's group, a row of each group, and how many there are. Null is a value like any other."""
    code = np.zeros(table.num_rows, dtype=np.int64)
    for k in keys:
        d = table.column(k).combine_chunks().dictionary_encode(null_encoding="encode")
        d = d.combine_chunks() if isinstance(d, pa.ChunkedArray) else d
        _, code = np.unique(code * (len(d.dictionary) + 1) + d.indices.to_numpy(zero_copy_only=False), return_inverse=True)
    _, first, group = np.unique(code, return_index=True, return_inverse=True)
    return group, first, len(first)


#: Rows (or bytes of sketches) that are combined at once before they are moved.
CHUNK_ROWS, CHUNK_BYTES = 400_000, 64_000_000


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    held, rows, size = [], 0, 0
    for b in batches:
        held.append(b)
        rows, size = rows + b.num_rows, size + b.nbytes
        if rows >= CHUNK_ROWS or size >= CHUNK_BYTES:
            yield pa.Table.from_batches(held)
            held, rows, size = [], 0, 0
    if rows:
        yield pa.Table.from_batches(held)


def _build(r: Registers, keys: list[str], counted: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _chunks(batches):
            group, first, n = _groups(t, keys)
            g, s, k = [], [], []
            for c in range(counted):
                col = t.column(f"__h{c}").combine_chunks()
                there = np.flatnonzero(np.asarray(col.is_valid()))
                slot, level = r.levels(col.fill_null(0).to_numpy(zero_copy_only=False)[there])
                g.append(group[there])
                s.append(slot + c * r.m)
                k.append(level)
            sketch = _pack(np.concatenate(g), np.concatenate(s), np.concatenate(k), n)
            yield from t.select(keys).take(pa.array(first)).append_column("sketch", sketch).combine_chunks().to_batches()

    return run


def _combine(keys: list[str]):
    """Merges within chunks; rows of a group may stay apart."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _chunks(batches):
            group, first, n = _groups(t, keys)
            row, slot, level = _unpack(t.column("sketch"))
            sketch = _pack(group[row], slot, level, n)
            yield from t.select(keys).take(pa.array(first)).append_column("sketch", sketch).combine_chunks().to_batches()

    return run


def _finish(keys: list[str]):
    """Merges rows that are sorted by key; only the last group is held over from one batch to the next."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_: pa.Table | None = None
        for b in batches:
            if not b.num_rows:
                continue
            t = pa.Table.from_batches([b])
            t = pa.concat_tables([open_, t]).combine_chunks() if open_ is not None else t
            group, first, n = _groups(t, keys)
            row, slot, level = _unpack(t.column("sketch"))
            done = t.select(keys).take(pa.array(first)).append_column("sketch", _pack(group[row], slot, level, n))
            at = int(group[-1])
            open_ = done.slice(at, 1)
            rest = pa.concat_tables([done.slice(0, at), done.slice(at + 1)]).combine_chunks()
            if rest.num_rows:
                yield from rest.to_batches()
        if open_ is not None:
            yield from open_.combine_chunks().to_batches()

    return run


def _schema(df: DataFrame, keys: list[str]) -> str:
    kinds = dict(df.dtypes)
    return ", ".join([*(f"`{k}` {kinds[k]}" for k in keys), "sketch binary"])


def _settle(partial: DataFrame, keys: list[str]) -> DataFrame:
    return map_arrow(partial.repartition(*keys).sortWithinPartitions(*keys), _finish(keys), _schema(partial, keys))


def sketches(df: DataFrame, keys: list[str], counted: list[Column | str], r: Registers = Registers()) -> DataFrame:
    """``(keys..., sketch)``: one sketch for each group, holding the registers of all ``counted`` columns.

    Rows become registers where they are read, are combined there, and only these partial sketches are moved: a group has
    at most one of bounded size for each chunk of input, however many rows it has.

    Defined cases: a null identifier isn't counted; a null key is a group; repeated rows and repeated deliveries change
    nothing; an empty input gives no rows; columns not named are ignored.
    """
    if len(counted) * r.m > 1 << 15:
        raise ValueError("at most 2**15 registers in a sketch")
    hashed = [F.when(c.isNotNull(), F.xxhash64(c)).alias(f"__h{i}") for i, c in enumerate(F.col(c) if isinstance(c, str) else c for c in counted)]
    rows = df.select(*keys, *hashed)
    return _settle(map_arrow(rows, _build(r, keys, len(counted)), _schema(rows, keys)), keys)


def merge_sketches(df: DataFrame, keys: list[str]) -> DataFrame:
    """``(keys..., sketch)``: the sketches of coarser groups, from partial results by maximum."""
    rows = df.select(*keys, "sketch")
    return _settle(map_arrow(rows, _combine(keys), _schema(rows, keys)), keys)


def estimates(df: DataFrame, names: list[str], r: Registers = Registers()) -> DataFrame:
    """Replaces ``sketch`` by ``<name> double`` and ``<name>_error double`` (standard error) for each counted column."""
    keys = [c for c in df.columns if c != "sketch"]
    kinds = dict(df.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            row, slot, level = _unpack(b.column(b.num_columns - 1))
            out = []
            for c in range(len(names)):
                own = slot // r.m == c
                out += [pa.array(x) for x in r.estimate(row[own], level[own], b.num_rows)]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], *out], names=[*keys, *(x for n in names for x in (n, f"{n}_error"))])

    schema = ", ".join([*(f"`{k}` {kinds[k]}" for k in keys), *(f"{n} double, {n}_error double" for n in names)])
    return map_arrow(df.select(*keys, "sketch"), run, schema)


def overlaps(pairs: DataFrame, left: str, right: str, counted: int = 0, r: Registers = Registers()) -> DataFrame:
    """Replaces the sketches ``left`` and ``right`` by union, intersection and Jaccard of one counted column.

    Columns ``union_size, union_error, common, common_error, jaccard, jaccard_error``; errors are standard errors.
    """
    keys = [c for c in pairs.columns if c not in (left, right)]
    kinds = dict(pairs.dtypes)
    names = ["union_size", "union_error", "common", "common_error", "jaccard", "jaccard_error"]

    def dense(column: pa.Array) -> Iterator[np.ndarray]:
        row, slot, level = _unpack(column)
        ends = np.searchsorted(row, np.arange(len(column) + 1))
        for at, end in zip(ends[:-1], ends[1:], strict=True):
            all_ = np.zeros((slot[at:end].max(initial=0) // r.m + counted + 1) * r.m, dtype=np.int64)
            all_[slot[at:end]] = level[at:end]
            yield all_[counted * r.m : (counted + 1) * r.m]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [r.joint(x, y) for x, y in zip(dense(b.column(b.num_columns - 2)), dense(b.column(b.num_columns - 1)), strict=True)]
            cols = [pa.array([f[x] for f in found], pa.float64()) for x in range(len(names))]
            yield pa.RecordBatch.from_arrays([*b.columns[:-2], *cols], names=[*keys, *names])

    schema = ", ".join([*(f"`{k}` {kinds[k]}" for k in keys), *(f"{n} double" for n in names)])
    return map_arrow(pairs.select(*keys, left, right), run, schema)
