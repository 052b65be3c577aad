"""State of the library: folding observations into templates, eviction, retention, erasure."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import probe_digest


#: Records that are ranked in one task at most.
TIES = 10_000


@dataclass(frozen=True)
class Policy:
    """Bounds of what is kept; None is unbounded. Values, names and keys beyond theirs are dropped, known ones go on counting."""

    records: int | None = 1_000_000
    record_ttl_ms: int | None = None
    frequency_values: int | None = 1_000_000
    agreement_names: int | None = 1024
    velocity_keys: int | None = 1_000_000
    block: int = 1024


def fold_templates(components: DataFrame, seen: DataFrame, order: str = "ts", tie: str = "seq") -> DataFrame:
    """``(visitor_id, name, kind, cat, num, elems, fresh)``: the latest value of each component a visitor ever showed.

    ``components``: long form with ``id``; ``seen``: ``(id, visitor_id, <order>, <tie>)`` of the observations. Absent
    components keep what they had, with the time they had it from.
    """
    rows = components.join(seen.select("id", "visitor_id", order, tie), "id").where("visitor_id is not null")
    value = F.struct("kind", "cat", "num", "elems", F.col(order).alias("fresh"))
    last = rows.groupBy("visitor_id", "name").agg(F.max_by(value, F.struct(order, tie)).alias("v"))
    return last.select("visitor_id", "name", "v.*")


def counters(seen: DataFrame, order: str = "ts") -> DataFrame:
    """``(visitor_id, first_seen, last_seen, observation_count)``."""
    return seen.where("visitor_id is not null").groupBy("visitor_id").agg(
        F.min(order).alias("first_seen"), F.max(order).alias("last_seen"), F.count("*").alias("observation_count")
    )


def merged(old: DataFrame, new: DataFrame) -> DataFrame:
    """Templates ``(visitor_id, name, ..., fresh)`` after an increment: newer values replace, the rest stays."""
    both = old.unionByName(new)
    rest = [c for c in both.columns if c not in ("visitor_id", "name")]
    return both.groupBy("visitor_id", "name").agg(F.max_by(F.struct(*rest), "fresh").alias("v")).select("visitor_id", "name", "v.*")


def drift(members: DataFrame, incoming: DataFrame) -> DataFrame:
    """Raw members ``(visitor_id, name, value)`` overwritten by incoming ones, name by name; a null value overwrites, too."""
    kept = members.join(incoming.select("visitor_id", "name").distinct(), ["visitor_id", "name"], "left_anti")
    return kept.unionByName(incoming.select(*members.columns))


def expire(records: DataFrame, now: int, ttl: int) -> DataFrame:
    """Records seen within ``ttl`` before ``now`` (one seen exactly ``ttl`` ago stays)."""
    return records.where(F.lit(now) - F.col("last_seen") <= ttl)


def cap(records: DataFrame, most: int, current: DataFrame | None = None) -> DataFrame:
    """The ``most`` records seen last (of equal ones, the greatest id goes first); those of ``current (visitor_id)`` are never the ones to go.

    A global rank would need all rows in one task. The time from which on all fit is found by counting per time instead, and
    of the records right at that time, which may be very many, the part of the id up to which they fit, in the same
    way; only ``TIES`` records or fewer are ranked.
    """
    if current is not None:
        kept = records.join(current.select("visitor_id").distinct(), "visitor_id", "left_semi")
        rest = records.join(current.select("visitor_id").distinct(), "visitor_id", "left_anti")
        return kept.unionByName(cap(rest, max(0, most - kept.count())))
    if most <= 0:
        return records.limit(0)
    bounds = _cut_time(records.groupBy("last_seen").count(), most)
    if bounds is None:
        return records
    time, room = bounds
    newer = records.where(F.col("last_seen") > time)
    edge = records.where(F.col("last_seen") == time)
    # Ids in their own order, seven bytes at a time; -number puts the least id first.
    kept, skip = newer, 0
    while True:
        seven = F.rpad(F.substring(F.encode(F.col("visitor_id").cast("string"), "UTF-8"), skip + 1, 7), 7, F.lit(b"\0"))
        placed = edge.withColumn("__at", -F.conv(F.hex(seven), 16, 10).cast("bigint"))
        found = _cut_time(placed.groupBy(F.col("__at").alias("last_seen")).count(), room)
        if found is None:
            return kept.unionByName(edge)
        at, room = found
        kept = kept.unionByName(placed.where(F.col("__at") > at).drop("__at"))
        edge, skip = placed.where(F.col("__at") == at).drop("__at"), skip + 7
        if edge.count() <= TIES:
            return kept.unionByName(edge.orderBy("visitor_id").limit(room))


def _cut_time(per: DataFrame, most: int, fan: int = 1024) -> tuple[int, int] | None:
    """The time at which ``most`` records end, and how many of that time fit; None when all fit.

    Each round counts ``fan`` ranges of the interval that holds the time, and goes on within one of them.
    """
    total, lo, hi = per.agg(F.sum("count"), F.min("last_seen"), F.max("last_seen")).first()
    if not total or total <= most:
        return None
    newer = 0  # records later than the interval
    while lo < hi:
        width = (hi - lo) // fan + 1
        bucket = F.floor((F.col("last_seen") - lo) / F.lit(width)).cast("bigint").alias("b")
        counts = {r.b: r.n for r in per.where(F.col("last_seen").between(lo, hi)).groupBy(bucket).agg(F.sum("count").alias("n")).collect()}
        for b in sorted(counts, reverse=True):
            if newer + counts[b] >= most:
                lo, hi = lo + b * width, min(hi, lo + (b + 1) * width - 1)
                break
            newer += counts[b]
    return lo, most - newer


def tracked(rows: DataFrame, by: str, order: list[str], most: int | None) -> DataFrame:
    """Rows of the ``most`` values of ``by`` seen first (by ``order``, then value); None keeps all. Null values are none."""
    known = rows.where(F.col(by).isNotNull())
    if most is None:
        return known
    first = known.groupBy(by).agg(F.min(F.struct(*order)).alias("at")).orderBy("at", by).limit(most)
    return known.join(first.select(by), by, "left_semi")


def erase(rows: DataFrame, erased: DataFrame, by: str = "visitor_id") -> DataFrame:
    """Rows but those of erased ids; erasing an id that isn't there changes nothing."""
    return rows.join(erased.select(by).distinct(), by, "left_anti")


def retire(records: DataFrame, entries: DataFrame, before: int) -> tuple[DataFrame, DataFrame]:
    """Records last seen from ``before`` on, and index entries but those of the others; ``before <= 0`` keeps all."""
    if before <= 0:
        return records, entries
    gone = records.where(F.col("last_seen") < before).select("visitor_id")
    return records.where(F.col("last_seen") >= before), erase(entries, gone)


def issue(requests: DataFrame, key: str, at: str, secret: bytes, ttl_ms: int = 30_000) -> DataFrame:
    """``(<key>, nonce, expires_ms)``: a 128-bit token as hex for each request, derived from its key, so that a task that runs again gives the same one."""
    nonce = F.substring(probe_digest(secret, F.col(key).cast("string")), 1, 32)
    return requests.where(F.col(key).isNotNull()).select(key, nonce.alias("nonce"), (F.col(at) + ttl_ms).alias("expires_ms"))


def single_use(issued: DataFrame, uses: DataFrame, closed: bool = True) -> DataFrame:
    """``(nonce, used_ms, outcome)`` of each use of a one-time token, in order of time.

    ``unknown`` for tokens never issued; ``expired`` from the end of life on (``closed``; else only after it); ``valid`` for
    the first use in time; ``reused`` for the others. Uses with a null token are unknown.
    """
    first = uses.groupBy("nonce").agg(F.min(F.struct("used_ms", "use_id")).alias("first"))
    rows = uses.join(issued.groupBy("nonce").agg(F.max("expires_ms").alias("expires_ms")).join(first, "nonce"), "nonce", "left")
    late = F.col("used_ms") >= F.col("expires_ms") if closed else F.col("used_ms") > F.col("expires_ms")
    again = F.col("use_id") != F.col("first.use_id")
    outcome = F.when(F.col("expires_ms").isNull(), "unknown").when(late, "expired").when(again, "reused").otherwise("valid")
    return rows.select("nonce", "use_id", "used_ms", outcome.alias("outcome"))


def in_window(ts, now, skew: int):
    """Whether a time lies within ``skew`` of now, both ends included; null is outside."""
    return F.coalesce(F.abs(ts - now) <= skew, F.lit(False))
