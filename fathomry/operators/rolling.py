"""Trailing totals and distinct members over calendar days.

Daily totals are sparse: one row for each entity and active day. Sums come from range frames over integer day numbers, so
a missing day needs no row to be counted as zero; rows for inactive days are added only because they are wanted in the
result, and averages divide by the length of the period whatever was active.

Distinct members don't add up over days. A member seen on ``day`` and next on ``next`` is the latest sighting for windows
that end on ``day .. min(day + period, next) - 1``, so it adds one on ``day`` and takes one off on the day after; the
running sum of these changes is the number of distinct members, exactly, without ever holding a set.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def rolling_totals(
    events: DataFrame,
    entity: str,
    day: str,
    event_id: str,
    member: str,
    first_day: int,
    last_day: int,
    periods: Sequence[int] = (7, 30),
    least_total: int = 0,
) -> DataFrame:
    """``(entity, day, events, events_P, avg_P, members_P, ...)`` for each entity and day of ``first_day .. last_day``.

    ``events_P``, ``avg_P`` and ``members_P`` cover the ``P`` days that end with the day; ``avg_P`` divides by ``P``.
    Entities with fewer than ``least_total`` events in the whole calendar are left out (0: none are).

    Defined cases: rows without entity or day, or with a day outside the calendar, take no part; a null member counts as
    event but not as member; rows with one ``event_id`` are one event; each row with a null ``event_id`` is an event of
    its own; an entity without any event within the calendar has no rows; an empty input gives no rows; other columns
    are ignored. Members are compared by a 64-bit hash within an entity.

    Distribution: repeated deliveries are folded on (entity, member, day, event), whose hash spreads any hot entity or
    member, and each further grouping is pre-aggregated before its shuffle. A window partition holds one row for each
    day of the calendar at most (by member: of each active day), so it doesn't grow with the rows.
    """
    rows = events.select(
        F.col(entity).alias("entity"),
        F.col(day).cast("int").alias("day"),
        F.col(event_id).alias("event_id"),
        F.when(F.col(member).isNotNull(), F.xxhash64(F.col(member))).alias("member"),
    ).where(F.col("entity").isNotNull() & F.col("day").between(first_day, last_day))
    daily = rows.groupBy("entity", "member", "day").agg(
        (F.count_distinct("event_id") + F.count_if(F.col("event_id").isNull())).alias("n")
    )
    ahead = F.lead("day").over(Window.partitionBy("entity", "member").orderBy("day"))
    named = daily.withColumn("next", F.when(F.col("member").isNotNull(), ahead))
    steps = [
        F.struct(F.col("day"), F.col("n"), *[F.when(F.col("member").isNotNull(), 1).otherwise(0).alias(f"m{p}") for p in periods])
    ]
    for p in periods:
        leaves = F.when(F.col("member").isNotNull(), F.least(F.col("day") + p, F.coalesce("next", F.col("day") + p)))
        steps.append(
            F.struct(leaves.alias("day"), F.lit(0).cast("bigint").alias("n"), *[F.lit(-1 if q == p else 0).alias(f"m{q}") for q in periods])
        )
    changes = named.select("entity", F.inline(F.array(*steps))).where(F.col("day") <= last_day)
    sparse = changes.groupBy("entity", "day").agg(F.sum("n").alias("n"), *[F.sum(f"m{p}").alias(f"m{p}") for p in periods])
    by_day = Window.partitionBy("entity").orderBy("day")
    known = sparse.withColumn("next", F.lead("day").over(by_day)).withColumn("prior", F.lag("day").over(by_day))
    if least_total:
        known = known.withColumn("total", F.sum("n").over(Window.partitionBy("entity"))).where(F.col("total") >= least_total)
    since = F.when(F.col("prior").isNull(), F.lit(first_day)).otherwise(F.col("day"))
    until = F.coalesce(F.col("next") - 1, F.lit(last_day))
    full = known.withColumn("cal", F.explode(F.sequence(since, until)))
    real = F.col("cal") == F.col("day")
    dense = full.select("entity", F.col("cal").alias("day"), *[F.when(real, F.col(c)).otherwise(0).cast("bigint").alias(c) for c in ("n", *(f"m{p}" for p in periods))])
    out = [F.col("entity"), F.col("day"), F.col("n").alias("events")]
    for p in periods:
        total = F.sum("n").over(by_day.rangeBetween(1 - p, 0))
        out += [
            total.alias(f"events_{p}"),
            (total / F.lit(float(p))).alias(f"avg_{p}"),
            F.sum(f"m{p}").over(by_day.rangeBetween(Window.unboundedPreceding, 0)).alias(f"members_{p}"),
        ]
    return dense.select(*out)
