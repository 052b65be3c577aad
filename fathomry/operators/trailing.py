"""Trailing windows over a log: distinct members, event counts, latest rows, bursts.

A row enters a trailing window at its time and leaves it later; the number inside at any time is the running sum of these
changes. That needs no set and no frame, and the running sum is taken in two steps, within slices of time and over the
slices' totals, so a key with a third of all rows is worked on by as many tasks as it has slices.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.lineage import cut

SLICE_MS = 6 * 3_600_000


def _sliced(df: DataFrame, slice_ms: int) -> DataFrame:
    return df.withColumn("__slice", F.floor(F.col("ts") / F.lit(slice_ms)))


def with_next(df: DataFrame, keys: list[str], slice_ms: int = SLICE_MS) -> DataFrame:
    """Distinct ``(keys, ts)`` with ``next``, the time after it within the keys (null for the last)."""
    rows = cut(_sliced(df.select(*keys, "ts").distinct(), slice_ms))  # read for the slices and for their heads
    inside = F.lead("ts").over(Window.partitionBy(*keys, "__slice").orderBy("ts"))
    heads = rows.groupBy(*keys, "__slice").agg(F.min("ts").alias("__head"))
    ahead = heads.withColumn("__ahead", F.lead("__head").over(Window.partitionBy(*keys).orderBy("__slice"))).drop("__head")
    return rows.withColumn("__inside", inside).join(ahead, [*keys, "__slice"]).select(*keys, "ts", F.coalesce("__inside", "__ahead").alias("next"))


def running(changes: DataFrame, key: str, sums: Sequence[str], slice_ms: int = SLICE_MS, marks: Sequence[str] = ()) -> DataFrame:
    """``(key, ts, sums..., marks...)``: for each time of a key, the sums of all its changes up to and with that time.

    ``marks`` are summed for the time alone.
    """
    at = cut(_sliced(changes.groupBy(key, "ts").agg(*[F.sum(c).alias(c) for c in (*sums, *marks)]), slice_ms))  # read for sums and totals
    totals = at.groupBy(key, "__slice").agg(*[F.sum(c).alias(f"__t_{c}") for c in sums])
    before = Window.partitionBy(key).orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(key, "__slice", *[F.coalesce(F.sum(f"__t_{c}").over(before), F.lit(0)).alias(f"__o_{c}") for c in sums])
    inside = Window.partitionBy(key, "__slice").orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)
    summed = at.select(key, "__slice", "ts", *marks, *[F.sum(c).over(inside).alias(c) for c in sums])
    return summed.join(offsets, [key, "__slice"]).select(key, "ts", *marks, *[(F.col(c) + F.col(f"__o_{c}")).alias(c) for c in sums])


def trailing_distinct(events: DataFrame, key: str, member: str, ts: str, windows: dict[str, int], closed: bool = True) -> DataFrame:
    """``(key, ts, <name>...)`` for each time of each key: distinct members seen in the ``windows[name]`` before it.

    A member counts at time ``t`` if it was seen in ``[t - w, t]``; with ``closed`` false in ``(t - w, t]``. Defined cases:
    rows whose key, member or time is null take no part; rows at one time see each other; repeated rows change nothing; an
    empty input gives no rows; other columns are ignored.
    """
    rows = events.select(F.col(key).alias("key"), F.col(member).alias("member"), F.col(ts).alias("ts"))
    seen = with_next(rows.where("key is not null and member is not null and ts is not null"), ["key", "member"])
    names = list(windows)
    enter = F.struct("ts", F.lit(1).alias("here"), *[F.lit(1).alias(n) for n in names])
    leave = []
    for n, w in windows.items():
        end = F.col("ts") + F.lit(w + 1 if closed else w)
        leave.append(F.struct(F.least(end, F.coalesce("next", end)).alias("ts"), F.lit(0).alias("here"), *[F.lit(-1 if m == n else 0).alias(m) for m in names]))
    changes = seen.select("key", F.inline(F.array(enter, *leave)))
    sums = running(changes, "key", names, marks=["here"])
    return sums.where("here > 0").drop("here").withColumnsRenamed({"key": key, "ts": ts})


def trailing_count(events: DataFrame, key: str, ts: str, window: int, name: str = "n") -> DataFrame:
    """``(key, ts, <name>)``: the number of rows of the key in ``[t - window, t]``, for each of its times.

    Defined cases as for :func:`trailing_distinct`, except that repeated rows count.
    """
    rows = events.select(F.col(key).alias("key"), F.col(ts).alias("ts")).where("key is not null and ts is not null")
    at = rows.groupBy("key", "ts").agg(F.count("*").alias("n"))
    leave = F.struct((F.col("ts") + window + 1).alias("ts"), (-F.col("n")).alias("n"), F.lit(0).alias("here"))
    changes = at.select("key", F.inline(F.array(F.struct("ts", "n", F.lit(1).alias("here")), leave)))
    sums = running(changes, "key", ["n"], marks=["here"]).where("here > 0").drop("here")
    return sums.withColumnsRenamed({"key": key, "ts": ts, "n": name})


def scoped(*scopes: tuple[str, DataFrame, str, str, str]) -> DataFrame:
    """``(key, member, ts)`` of several logs in one: each ``(scope, rows, key, member, ts)`` with its keys under its scope's name."""
    parts = [rows.where(F.col(k).isNotNull()).select(F.concat(F.lit(f"{name}:"), F.col(k).cast("string")).alias("key"), F.col(m).cast("string").alias("member"), F.col(t).alias("ts")) for name, rows, k, m, t in scopes]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def rate_bands(verdicts: DataFrame, id_: str, fresh: str, ts_s: str, scopes: dict[str, tuple[str, tuple[int, int]]], window: int) -> DataFrame:
    """``(<id>, <name>...)``: band of the number of new devices in the ``window`` seconds before, for each scope.

    ``scopes``: name of the result, its key column and the bounds of its bands. Only rows whose ``fresh`` is true are
    counted and rated; all others, and rows without key, are ``low``.
    """
    out = verdicts.select(id_, fresh, F.col(ts_s).alias("__s"), *[k for k, _ in scopes.values()])
    for name, (key, bounds) in scopes.items():
        n = trailing_count(verdicts.where(F.col(fresh)), key, ts_s, window, "__n").withColumnsRenamed({ts_s: "__s"})
        out = out.join(n, [key, "__s"], "left")
        out = out.withColumn(name, F.when(F.col(fresh) & F.col("__n").isNotNull(), band(F.col("__n"), *bounds)).otherwise("low")).drop("__n")
    return out.select(id_, *scopes)


def latest(events: DataFrame, key: str, order: list[str], n: int) -> DataFrame:
    """The last ``n`` rows of each key with their ``rank`` (1: the last); ranks are cut before the shuffle, too."""
    by = Window.partitionBy(key).orderBy(*[F.col(c).desc_nulls_last() for c in order])
    return events.where(F.col(key).isNotNull()).withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= n)


def churn(events: DataFrame, key: str, member: str, order: list[str], n: int = 20) -> DataFrame:
    """``(key, sampled, members, rate)``: distinct members among the last ``n`` rows of each key, and their share."""
    last = latest(events, key, order, n).groupBy(key).agg(F.count("*").alias("sampled"), F.count_distinct(member).alias("members"))
    return last.withColumn("rate", F.col("members") / F.col("sampled"))


def regularity(events: DataFrame, key: str, ts: str, order: list[str], n: int = 10) -> DataFrame:
    """``(key, gaps, regularity)`` of the last ``n`` rows: 1 / (1 + deviation / mean) of the gaps between them.

    Fewer than two gaps give 0, gaps that are all zero give 1.
    """
    last = latest(events.where(F.col(ts).isNotNull()), key, order, n)
    times = last.groupBy(key).agg(F.array_sort(F.collect_list(ts)).alias("t"))  # at most n values
    gaps = F.zip_with(F.slice("t", 2, n), F.slice("t", 1, n), lambda b, a: (b - a).cast("double"))
    kept = times.select(key, F.filter(gaps, lambda g: g.isNotNull()).alias("g"))
    size = F.size("g")
    mean = F.aggregate("g", F.lit(0.0), lambda a, x: a + x) / size
    var = F.aggregate("g", F.lit(0.0), lambda a, x: a + (x - F.col("mean")) * (x - F.col("mean"))) / size
    out = kept.withColumn("mean", F.when(size > 0, mean)).withColumn("deviation", F.sqrt(F.when(size > 0, var)))
    value = F.when(size < 2, 0.0).when(F.col("mean") == 0, 1.0).otherwise(1 / (1 + F.col("deviation") / F.col("mean")))
    return out.select(key, size.alias("gaps"), value.alias("regularity"))


def bursts(events: DataFrame, key: str, ts: str, bucket_ms: int = 60_000) -> DataFrame:
    """``(key, bucket, n)``: rows of a key in each bucket of time, ``bucket`` being its start."""
    start = F.col(ts) - F.pmod(F.col(ts), F.lit(bucket_ms))
    return events.where(F.col(key).isNotNull() & F.col(ts).isNotNull()).groupBy(F.col(key), start.alias("bucket")).agg(F.count("*").alias("n"))


def band(n, medium: int, high: int):
    """``low``, ``medium`` from ``medium`` on, ``high`` from ``high`` on."""
    return F.when(n >= high, "high").when(n >= medium, "medium").otherwise("low")


#: Bands of new devices for each address, and for each class of handshake, in an hour.
IP_BAND, CLASS_BAND, RATE_WINDOW_S = (5, 20), (100, 400), 3600


def purge(events: DataFrame, ts: str, before: int) -> DataFrame:
    """Rows not older than ``before``; a null time is kept."""
    return events.where(F.col(ts).isNull() | (F.col(ts) >= before))
