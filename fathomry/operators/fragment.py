"""Per-key work without imbalance: fragment-and-replicate by estimated load.

1. Estimate: a pass over the key column counts hash buckets, and another one the keys of the few buckets that hold more
   than a key may. Only these bounded counts reach the driver.
2. Pack: keys heavier than a share of one task are split into shards in proportion to their load; shards and buckets of
   light keys are packed onto tasks, heaviest first, always onto the least loaded task.
3. Place: each row goes to its key's (and, for a heavy key, its shard's) task by a direct partition id; the matching side
   of a join is replicated to the shards of its key and nowhere else. Where a key is heavy on both sides of a join, its
   shards form a grid: rows of the left side go to all tasks of their line, rows of the right side to all of their column.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shipping import map_arrow

#: Least number of hash buckets of light keys, and buckets for each task; also the most rows the load summary sends to the driver.
BUCKETS, PER_TASK = 4096, 8
#: A key is split when it holds more than this share of what one task should get.
SPLIT_ABOVE = 0.5


@dataclass
class Placement:
    """Which task gets what.

    ``heavy`` maps a key to its grid: the number of lines and the tasks, line by line; ``light`` a hash bucket to its task.
    """

    tasks: int
    heavy: dict[str, tuple[int, list[int]]]
    light: list[int]
    loads: list[float]


def buckets_for(tasks: int) -> int:
    return max(BUCKETS, PER_TASK * tasks)


def pack(heavy: dict[str, tuple[float, float]], light: dict[int, float], tasks: int) -> Placement:
    """Bin-pack by load. ``heavy``: left and right loads of frequent keys; ``light``: loads of buckets, without the frequent keys."""
    total = sum(p + q for p, q in heavy.values()) + sum(light.values())
    share = max(1, int(total / tasks * SPLIT_ABOVE))
    items: list[tuple[float, str | int, int]] = []
    plan: dict[str, tuple[int, list[int]]] = {}
    for key, (p, q) in heavy.items():
        lines = min(tasks, max(1, -(-int(p) // share)))
        columns = min(max(1, tasks // lines), max(1, -(-int(q) // share)))
        plan[key] = (lines, [0] * (lines * columns))
        items += [(p / lines + q / columns, key, i) for i in range(lines * columns)]
    place = [0] * buckets_for(tasks)
    items += [(load, b, -1) for b, load in light.items()]
    bins = [(0.0, t) for t in range(tasks)]
    loads = [0.0] * tasks
    for load, what, shard in sorted(items, key=lambda x: (-x[0], str(x[1]), x[2])):
        full, t = heapq.heappop(bins)
        if shard < 0:
            place[what] = t
        else:
            plan[what][1][shard] = t
        loads[t] = full + load
        heapq.heappush(bins, (full + load, t))
    return Placement(tasks, plan, place, loads)


def bucket_of(key: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key.cast("string")), F.lit(buckets)).cast("int")


def estimate(df: DataFrame, key: str, tasks: int, right: DataFrame | None = None) -> tuple[dict[str, tuple[float, float]], dict[int, float]]:
    """Loads of the frequent keys (on the left, on the right) and of the hash buckets of all others, exactly.

    Only buckets that hold more than a key may are looked into; at most ``tasks / SPLIT_ABOVE`` keys of a side can be
    frequent, so the driver gets that many rows and one for each bucket more.
    """
    side = lambda d, n: d.select(F.col(key).cast("string").alias("k"), F.lit(n).alias("r")).where("k is not null")
    keys = side(df, 0) if right is None else side(df, 0).unionByName(side(right, 1))
    keys = keys.withColumn("b", bucket_of(F.col("k"), buckets_for(tasks)))
    counts = [F.count_if(F.col("r") == 0).alias("p"), F.count_if(F.col("r") == 1).alias("q")]
    sizes = keys.groupBy("b").agg(*counts).collect()
    most = [sum(x) / tasks * SPLIT_ABOVE for x in zip(*((r.p, r.q) for r in sizes), strict=True)] or [0, 0]
    light = {r.b: float(r.p + r.q) for r in sizes}
    full = [r.b for r in sizes if r.p > most[0] or r.q > most[1]]
    heavy = {}
    if full:
        found = keys.where(F.col("b").isin(full)).groupBy("b", "k").agg(*counts)
        for r in found.where((F.col("p") > most[0]) | (F.col("q") > most[1])).collect():
            heavy[r.k] = (float(r.p), float(r.q))
            light[r.b] -= r.p + r.q
    return heavy, light


def placement(df: DataFrame, key: str, tasks: int | None = None, right: DataFrame | None = None) -> Placement:
    """The plan for ``df`` (and a side that is joined with it) by ``key``; ``tasks`` defaults to the session's shuffle partitions."""
    tasks = tasks or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return pack(*estimate(df, key, tasks, right), tasks)


def _placed(df: DataFrame, key: str, plan: Placement, of_heavy: Column, several: bool) -> DataFrame:
    """``df`` with ``__task``; ``of_heavy`` gives the tasks of a frequent key's row from ``__lines`` and ``__tasks``, as an array if ``several``.

    The frequent keys (at most ``tasks / SPLIT_ABOVE`` for each side) are broadcast, the buckets are one literal.
    """
    rows = [(k, lines, tasks) for k, (lines, tasks) in sorted(plan.heavy.items())]
    heavy = df.sparkSession.createDataFrame(rows, "__key string, __lines int, __tasks array<int>")
    light = F.split(F.lit(",".join(map(str, plan.light))), ",").cast("array<int>")  # folds to one literal
    one = F.element_at(light, bucket_of(F.col(key), len(plan.light)) + 1)
    is_heavy = F.col("__tasks").isNotNull()
    at = F.explode(F.when(is_heavy, F.array_distinct(of_heavy)).otherwise(F.array(one))) if several else F.when(is_heavy, of_heavy).otherwise(one)
    out = df.join(F.broadcast(heavy), F.col(key).cast("string") == F.col("__key"), "left").withColumn("__task", at)
    return out.drop("__key", "__lines", "__tasks")


def _pick(spread: Column, n: Column) -> Column:
    return F.pmod(F.xxhash64(spread), n).cast("int")


def fragment(df: DataFrame, key: str, spread: Column, plan: Placement) -> DataFrame:
    """The left side with ``__task``: a row of a light key on its task, of a heavy one on those of one line, picked by ``spread``."""
    if all(len(tasks) == lines for lines, tasks in plan.heavy.values()):
        return _placed(df, key, plan, F.element_at("__tasks", _pick(spread, F.col("__lines")) + 1), False)
    columns = (F.size("__tasks") / F.col("__lines")).cast("int")
    return _placed(df, key, plan, F.slice("__tasks", _pick(spread, F.col("__lines")) * columns + 1, columns), True)


def replicate(df: DataFrame, key: str, plan: Placement, spread: Column | None = None) -> DataFrame:
    """The matching side with ``__task``: each row once for each distinct task of its key's column, picked by ``spread``."""
    columns = (F.size("__tasks") / F.col("__lines")).cast("int")
    own = _pick(F.lit(0) if spread is None else spread, columns)
    return _placed(df, key, plan, F.filter("__tasks", lambda _, i: i % columns == own), True)


def _fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Distinct rows of each batch: repeats that lie together don't reach the shuffle."""
    for b in batches:
        t = pa.Table.from_batches([b])
        yield from t.group_by(t.column_names, use_threads=False).aggregate([]).select(t.column_names).combine_chunks().to_batches()


def distinct_per_key(df: DataFrame, key: str, member: str, tasks: int | None = None) -> DataFrame:
    """``(key, members)``: the number of distinct members of each key, balanced whatever the keys' sizes.

    A heavy key's members are split by hash, so its shards hold disjoint members and their counts add up.

    Defined cases: rows with a null key or member take no part; repeated rows count once (and are folded within each
    batch before they are moved); an empty input gives no rows; other columns are ignored.
    """
    pairs = df.select(F.col(key).cast("string").alias("key"), F.col(member).cast("string").alias("member")).where(
        "key is not null and member is not null"
    )
    plan = placement(pairs, "key", tasks)
    folded = map_arrow(pairs, _fold, "key string, member string")
    placed = fragment(folded, "key", F.col("member"), plan).repartitionById(plan.tasks, F.col("__task"))
    shards = placed.groupBy("__task", "key", "member").agg(F.lit(1).alias("one")).groupBy("__task", "key").agg(F.count("*").alias("members"))
    return shards.groupBy("key").agg(F.sum("members").alias("members"))


def _spread(df: DataFrame, key: str) -> Column:
    """All other columns' values as text: the same in every attempt of a task."""
    rest = [F.col(c).cast("string") for c in df.columns if c != key] or [F.lit("")]
    return F.concat_ws("\x1f", *[F.coalesce(x, F.lit("\x00")) for x in rest])


def skewed_join(left: DataFrame, right: DataFrame, key: str, how: str = "inner", tasks: int | None = None) -> DataFrame:
    """``left JOIN right USING (key)``, the left side fragmented by load and the right one replicated to its shards.

    ``how`` is ``inner``, ``left``, ``left_semi`` or ``left_anti`` (kinds in which only left rows may go unmatched, since a
    right row exists in several copies). An inner join splits keys that are heavy on the right, too; the other kinds plan by
    the left side only. Rows of a heavy key are spread by the hash of all other columns' values; rows that are equal in all
    columns stay together. Where no key is heavy it is a plain join. Both sides are read for the counts, too, so the caller
    should have stored what is dear to compute.

    Defined cases: a null key matches nothing; repeated rows on either side give the product, as in any join; empty sides
    are as in any join; the other columns of both sides must differ by name.
    """
    if how not in ("inner", "left", "left_semi", "left_anti"):
        raise ValueError(f"unsupported join: {how}")
    clash = (set(left.columns) & set(right.columns)) - {key}
    if clash and how in ("inner", "left"):
        raise ValueError(f"columns of both sides: {sorted(clash)}")
    if how in ("left_semi", "left_anti"):
        right = right.select(key).distinct()
    plan = placement(left, key, tasks, right if how == "inner" else None)
    if not plan.heavy:
        return left.join(right, key, how)
    a, b = left, right.where(F.col(key).isNotNull())
    if how == "inner":
        a = a.where(F.col(key).isNotNull())
    a = fragment(a, key, _spread(a, key), plan).repartitionById(plan.tasks, F.col("__task"))
    b = replicate(b, key, plan, _spread(b, key)).repartitionById(plan.tasks, F.col("__task"))
    return a.join(b, ["__task", key], how).drop("__task")
