"""Mixing sources to target weights.

Records get hash-random keys; the range of the keys is cut into equal slices, so each source is sorted by key in parts of
equal expected size, whatever its size. Token sums of the slices give, by one window over a small table, the offset at
which each slice begins; within a slice a running sum does the rest. These prefix sums are cut at the source's budget.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.lineage import cut
from ..operators.fragment import skewed_join

#: Rows for each slice of a source, about; the most slices; the most plan rows that are broadcast.
SLICE_ROWS, MOST_SLICES, BROADCAST_ROWS = 50_000, 1 << 16, 100_000


def plan(sizes: DataFrame, targets: DataFrame, total: DataFrame) -> DataFrame:
    """What each mix takes of each source: ``target`` tokens wanted, ``epochs`` whole uses, ``rest`` tokens of one more.

    A source's target is its part of the mix's weights times the budget. It gives all it may where ``max_repeats`` uses
    don't reach the target; other sources don't fill in, so that none gets further from its own share.
    """
    wanted = targets.where("mix_id is not null and source is not null").groupBy("mix_id", "source").agg(
        F.sum(F.greatest(F.coalesce("weight", F.lit(0.0)), F.lit(0.0))).alias("weight"),
        F.max(F.greatest(F.coalesce("max_repeats", F.lit(0)), F.lit(0))).alias("max_repeats"),
        F.max(F.greatest(F.coalesce("budget_share", F.lit(0.0)), F.lit(0.0))).alias("budget_share"),
    )
    mix = Window.partitionBy("mix_id")
    every = F.sum("weight").over(mix)
    shared = wanted.withColumn("wanted", F.when(every > 0, F.col("weight") / every).otherwise(0.0))
    shared = shared.withColumn("budget_share", F.max("budget_share").over(mix)).withColumn("total", total.scalar())
    sized = shared.join(sizes, "source", "left").withColumn("available", F.coalesce("size", F.lit(0)).cast("bigint")).drop("size")
    goal = F.least(F.col("target"), (F.col("available") * F.col("max_repeats")).cast("double"))
    epochs = F.when(F.col("available") > 0, F.floor(goal / F.col("available"))).otherwise(0).cast("int")
    out = sized.withColumn("target", F.col("wanted") * F.col("budget_share") * F.col("total"))
    out = out.withColumn("goal", goal).withColumn("epochs", epochs)
    return out.withColumn("rest", F.when(F.col("epochs") < F.col("max_repeats"), F.col("goal") - F.col("epochs") * F.col("available")).otherwise(0.0))


def mixture(records: DataFrame, targets: DataFrame, key: str = "doc_id", tokens: str = "tokens", seed: int = 1) -> tuple[DataFrame, DataFrame]:
    """``(mix_id, source, <key>, tokens, repeats)`` of the records each mix uses, and the plan with what it reached.

    ``records`` has the key, ``source`` and tokens, ``targets`` the columns mix_id, source, weight, max_repeats and
    budget_share; sources are compared as they are. A record belongs to the cut-off part if its middle lies before the
    cut, so a source misses its goal by at most half a record.

    Defined cases: records without source or tokens are never chosen, but count in the total; null or negative weights,
    repeats and budgets are 0; several rows of a source in a mix add their weights and take the greatest cap; equal keys
    (repeated rows) are separate records in a fixed but arbitrary order; a source without records reaches 0; an empty
    input gives an empty mixture. ``records`` is read three times: pass a table or a checkpoint.
    """
    rows = records.select(F.col(key).alias("__key"), "source", F.coalesce(F.col(tokens), F.lit(0)).cast("bigint").alias("tokens"))
    total = rows.agg(F.coalesce(F.sum("tokens"), F.lit(0)).alias("total"))
    usable = rows.where("source is not null and tokens > 0")
    sizes = usable.groupBy("source").agg(F.sum("tokens").alias("size"))
    planned = cut(plan(sizes, targets, total))
    n = usable.count()
    bits = min(max(n // SLICE_ROWS, 16), MOST_SLICES).bit_length()
    keyed = usable.withColumn("__at", F.xxhash64(F.lit(seed), F.col("__key")))
    keyed = keyed.withColumn("__slice", F.shiftrightunsigned("__at", 64 - bits))
    slices = keyed.groupBy("source", "__slice").agg(F.sum("tokens").alias("__sum"))
    before = Window.partitionBy("source").orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = slices.select("source", "__slice", F.coalesce(F.sum("__sum").over(before), F.lit(0)).alias("__offset"))
    inside = Window.partitionBy("source", "__slice").orderBy("__at", "__key").rowsBetween(Window.unboundedPreceding, 0)
    running = keyed.withColumn("__end", F.sum("tokens").over(inside)).join(offsets, ["source", "__slice"])
    placed = running.select("source", "__key", "tokens", (F.col("__offset") + F.col("__end")).alias("__end"))
    wanted = planned.where("goal > 0").select("mix_id", "source", "epochs", "rest")
    if wanted.count() <= BROADCAST_ROWS:
        joined = placed.join(F.broadcast(wanted), "source")
    else:
        joined = skewed_join(placed, wanted, "source")
    used = F.col("epochs") + (F.col("__end") - F.col("tokens") / 2 < F.col("rest")).cast("int")
    chosen = joined.withColumn("repeats", used).where("repeats > 0")
    return chosen.select("mix_id", "source", F.col("__key").alias(key), "tokens", "repeats"), planned


def shares(chosen: DataFrame, planned: DataFrame) -> DataFrame:
    """The report: wanted and reached tokens and shares of each source in each mix."""
    got = chosen.groupBy("mix_id", "source").agg(
        F.sum(F.col("tokens") * F.col("repeats")).alias("reached"), F.count("*").alias("records"), F.max("repeats").alias("most_repeats")
    )
    all_ = planned.join(got, ["mix_id", "source"], "left").fillna(0, ["reached", "records", "most_repeats"])
    mix = F.sum("reached").over(Window.partitionBy("mix_id"))
    return all_.select(
        "mix_id", "source", "available", F.col("wanted").alias("wanted_share"), F.col("target").alias("target_tokens"),
        F.col("reached").alias("reached_tokens"), F.when(mix > 0, F.col("reached") / mix).otherwise(0.0).alias("reached_share"),
        F.when(F.col("target") > 0, F.col("reached") / F.col("target")).alias("of_target"), "records", "most_repeats",
    )
