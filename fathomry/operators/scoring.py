"""Fellegi-Sunter scoring of candidates against a library, as one relational plan.

What depends on the probe's value (its rarity ``u``) or on the name (its reliability ``m``) is attached to the probe's
components before they are packed; a pair is then scored inside one row, in order of names, so that sums of doubles are the
same wherever they run.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.canonical import prior_of
from ..functions.hashing import salted_hash
from ..functions.lineage import stored
from . import cells
from .maintenance import tracked

#: Bits for a match and for a review; overlap that counts as agreement; gap of a collision.
MATCH, REVIEW, AGREE, COLLISION_GAP = 12.0, 8.0, 0.5, 2.0
#: Rarity of sets; bounds of probabilities; weight of the prior; scale of margins; components of a full probe.
SET_RARITY, LEAST, MOST, PRIOR_WEIGHT, SCALE, FULL = 0.05, 1e-4, 0.9999, 20.0, 4.0, 8.0


def value_hash(salt: bytes) -> Column:
    """The hash under which a scalar is counted: numbers by the hash of their text, so names don't matter."""
    return F.coalesce(F.col("cat"), salted_hash(F.col("num").cast("string"), salt))


def frequency(components: DataFrame, salt: bytes) -> DataFrame:
    """``(value, hits)``: how often each scalar value was seen. Sets aren't counted."""
    return components.select(value_hash(salt).alias("value")).where("value is not null").groupBy("value").agg(F.count("*").alias("hits"))


def capped_frequency(components: DataFrame, salt: bytes, order: list[str], cap: int) -> DataFrame:
    """Frequencies of the ``cap`` values seen first (by ``order``, then value); later values are not counted at all."""
    seen = components.withColumn("value", value_hash(salt)).where("value is not null")
    counts = seen.groupBy("value").agg(F.min(F.struct(*order)).alias("at"), F.count("*").alias("hits"))
    return counts.orderBy("at", "value").limit(cap).select("value", "hits")


def agreement(confirmed: DataFrame) -> DataFrame:
    """``(name, agree, total)`` over compared components ``(name, sim)`` of confirmed pairs."""
    return confirmed.groupBy("name").agg(F.count_if(F.col("sim") >= AGREE).alias("agree"), F.count("*").alias("total"))


def capped_agreement(confirmed: DataFrame, order: list[str], cap: int | None) -> DataFrame:
    """:func:`agreement` of the ``cap`` names seen first; later names are not counted at all."""
    return agreement(tracked(confirmed, "name", order, cap))


def rate(hits: Column, total: Column) -> Column:
    """How often a value was seen among all sightings; 0 where there are none. Scoring has its own smoothed rarity."""
    return F.when(F.coalesce(total, F.lit(0)) == 0, 0.0).otherwise(F.coalesce(hits, F.lit(0)) / total)


def _clamp(c: Column) -> Column:
    return F.least(F.greatest(c, F.lit(LEAST)), F.lit(MOST))


def reliability(agree: Column, total: Column, prior: Column) -> Column:
    """Probability that a component agrees on the same device: the prior, moved by what was confirmed."""
    learned = _clamp((agree + PRIOR_WEIGHT * prior) / (total + PRIOR_WEIGHT))
    return F.when(F.coalesce(total, F.lit(0)) == 0, prior).otherwise(learned)


def overlap(a: Column, b: Column) -> Column:
    """Jaccard of two distinct arrays; two empty ones agree fully."""
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0).otherwise(both / (F.size(a) + F.size(b) - both))


def similarity(p: Column, t: Column) -> Column:
    """Agreement of two components of one name; null where their kinds differ."""
    j = overlap(p["elems"], t["elems"])
    sets = F.when(j >= AGREE, 1.0).otherwise(j)
    same = F.coalesce(p["cat"] == t["cat"], p["num"] == t["num"]).cast("double")
    return F.when(p["kind"] == t["kind"], F.when(p["kind"] == "set", sets).otherwise(same))


def weight(sim: Column, m: Column, u: Column) -> Column:
    return sim * F.log2(m / u) + (1.0 - sim) * F.log2((1.0 - m) / (1.0 - u))


def packed(components: DataFrame) -> DataFrame:
    """``(id, parts)``: an id's components by name."""
    part = F.struct("name", "kind", "cat", "num", "elems")
    return components.groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("name", part))).alias("parts"))


def probes(components: DataFrame, salt: bytes, counts: DataFrame, learned: DataFrame | None = None) -> DataFrame:
    """``(id, parts)``: a probe's components in order of names, each with its ``u`` and ``m``."""
    total = counts.select(F.coalesce(F.sum("hits"), F.lit(0))).scalar()
    rows = components.withColumn("value", value_hash(salt)).join(counts, "value", "left").withColumn("all_hits", total)
    u = F.when(F.col("kind") == "set", SET_RARITY).otherwise(_clamp((F.coalesce("hits", F.lit(0)) + 0.5) / (F.col("all_hits") + 1.0)))
    m = prior_of("name")
    if learned is not None:
        rows = rows.join(learned, "name", "left")
        m = reliability(F.col("agree"), F.col("total"), m)
    part = F.struct("name", "kind", "cat", "num", "elems", u.alias("u"), m.alias("m"))
    return rows.groupBy("id").agg(F.array_sort(F.collect_list(part)).alias("parts"))


def compared(pairs: DataFrame, probe: DataFrame, library: DataFrame) -> DataFrame:
    """``(id, visitor_id, weights)``: for each pair an array of ``(name, sim, w)`` of the components on both sides."""
    left = probe.select("id", F.col("parts").alias("p"))
    right = library.select(F.col("id").alias("visitor_id"), F.col("parts").alias("t"))
    rows = pairs.join(left, "id").join(right, "visitor_id")

    def one(x: Column) -> Column:
        sim = similarity(x, F.try_element_at(F.col("t"), x["name"]))
        return F.struct(x["name"].alias("name"), sim.alias("sim"), weight(sim, x["m"], x["u"]).alias("w"))

    return rows.select("id", "visitor_id", F.filter(F.transform("p", one), lambda x: x["sim"].isNotNull()).alias("weights"))


def scores(weights: DataFrame) -> DataFrame:
    """``(id, visitor_id, score, compared)``; weights are added in order of names."""
    total = F.aggregate("weights", F.lit(0.0), lambda a, x: a + x["w"])
    return weights.select("id", "visitor_id", total.alias("score"), F.size("weights").alias("compared"))


def _logistic(x: Column) -> Column:
    return 1.0 / (1.0 + F.exp(-x))


def confidence(decision: Column, score: Column, second: Column, n: Column) -> Column:
    """Confidence in a decision from its margin, the runner-up and how much could be compared."""
    whole = 0.5 + 0.5 * F.least(n / F.lit(FULL), F.lit(1.0))
    gap = F.when(second.isNull(), 1.0).otherwise(_logistic((score - second) / SCALE))
    match = 0.5 + 0.5 * F.least(_logistic((score - MATCH) / SCALE), gap)
    review = 0.25 + 0.25 * F.least(F.greatest((score - REVIEW) / (MATCH - REVIEW), F.lit(0.0)), F.lit(1.0))
    near = F.when(score.isNull(), 0.0).otherwise(_logistic((score - REVIEW) / SCALE))
    base = F.when(decision == "match", match).when(decision == "review", review).otherwise(0.5 + 0.5 * (1.0 - near))
    return F.least(F.greatest(base * whole, F.lit(0.0)), F.lit(1.0))


def decide(ids: DataFrame, scored: DataFrame) -> DataFrame:
    """One row for each probe of ``ids``: best candidate, decision, confidence and collision flag.

    Equal scores resolve to the least visitor id. Probes without candidate are new devices; the caller gives them an id
    (:func:`fathomry.functions.canonical.visitor_id`). Only the two best candidates of each probe and task are shuffled, as
    ranks above two are cut before.
    """
    place = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("score"), "visitor_id"))
    top = scored.withColumn("place", place).where(F.col("place") <= 2)
    first = lambda c: F.max(F.when(F.col("place") == 1, F.col(c))).alias(c)
    two = top.groupBy("id").agg(first("visitor_id"), first("score"), first("compared"), F.max(F.when(F.col("place") == 2, F.col("score"))).alias("second"))
    rows = ids.select("id").distinct().join(two, "id", "left").withColumn("compared", F.coalesce("compared", F.lit(0)))
    decision = F.when(F.col("score") >= MATCH, "match").when(F.col("score") >= REVIEW, "review").otherwise("new_device")
    rows = rows.withColumn("decision", decision)
    close = (F.col("decision") == "match") & (F.col("second") >= MATCH) & (F.col("score") - F.col("second") < COLLISION_GAP)
    known = F.when(F.col("decision") != "new_device", F.col("visitor_id"))
    return rows.select(
        "id", known.alias("visitor_id"), "decision", (F.col("decision") == "new_device").alias("is_new_device"), "score", "second", "compared",
        F.coalesce(close, F.lit(False)).alias("collision_risk"),
        confidence(F.col("decision"), F.col("score"), F.col("second"), F.col("compared")).alias("confidence"),
    )


def weighed(rows: DataFrame, keys: DataFrame, hits: Column, all_hits: Column, m: Column) -> DataFrame:
    """Probes' parts as records of :mod:`cells`, with what each adds to a score where it agrees and where it differs."""
    u = F.when(F.col("kind") == "set", SET_RARITY).otherwise(_clamp((F.coalesce(hits, F.lit(0)) + 0.5) / (all_hits + 1.0)))
    return cells.records(rows, keys, F.log2(m / u), F.log2((1.0 - m) / (1.0 - u)))


def probe_records(components: DataFrame, keys: DataFrame, salt: bytes, counts: DataFrame, learned: DataFrame | None = None) -> DataFrame:
    """Probes with their ``keys`` ``(id, key)``, ready for :func:`cells.scored`; ``counts`` stored."""
    total = counts.select(F.coalesce(F.sum("hits"), F.lit(0))).scalar()
    rows = cells.parts(components, value_hash(salt))
    # only numbers go to the counts and back; the parts with their sets stay where they are
    seen = rows.where("value is not null").select("id", "tag", "value").join(counts.select(F.xxhash64("value").alias("value"), "hits"), "value")
    seen = seen.groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("tag", "hits"))).alias("seen"))
    rows = rows.join(seen, "id", "left").withColumn("hits", F.try_element_at("seen", "tag")).drop("seen").withColumn("all_hits", total)
    m = prior_of("name")
    if learned is not None:
        rows = rows.join(F.broadcast(learned), "name", "left")  # a row for each name of a component
        m = reliability(F.col("agree"), F.col("total"), m)
    return weighed(rows, cells.hashed_keys(keys, "id"), F.col("hits"), F.col("all_hits"), m)


def library_records(components: DataFrame, blocks: DataFrame, salt: bytes) -> DataFrame:
    """Visitors with their entries ``(key, visitor_id)``, ready for :func:`cells.scored`; ``components`` has visitors for ids."""
    return cells.records(cells.parts(components, value_hash(salt)), cells.hashed_keys(blocks, "visitor_id"), F.lit(None), F.lit(None))


def block_scope(keys: DataFrame, library: DataFrame, components: DataFrame, salt: bytes) -> DataFrame:
    """``(id, visitor_id, score, compared)`` with rarities counted over each probe's own candidates instead of the library.

    ``keys`` and ``components`` of the probes; ``library``: stored :func:`library_records`. Candidates are found twice, once to
    count and once to score, so that nothing is kept for each pair.
    """
    rows, hashed = cells.parts(components, value_hash(salt)), cells.hashed_keys(keys, "id")
    seen = stored(cells.shared_values(cells.records(rows, hashed, F.lit(None), F.lit(None)), library))
    totals = seen.groupBy("id").agg(F.sum("all_hits").alias("all_hits"))
    hits = seen.select("id", F.inline(F.arrays_zip(F.col("tags").alias("tag"), F.col("hits").alias("hits")))).groupBy("id", "tag").agg(F.sum("hits").alias("hits"))
    rows = rows.join(hits, ["id", "tag"], "left").join(totals, "id", "left")
    probe = weighed(rows, hashed, F.col("hits"), F.coalesce("all_hits", F.lit(0)), prior_of("name"))
    return cells.scored(probe, library, AGREE)
