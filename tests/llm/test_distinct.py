import numpy as np
import pytest
from pyspark.sql import functions as F

from fathomry.llm.distinct import Registers, estimates, merge_sketches, overlaps, sketches


@pytest.mark.parametrize("r", [Registers(1024, 2.0), Registers(4096, 1.08), Registers(256, 1.02)])
@pytest.mark.parametrize("n", [1, 5, 100, 3000, 200_000])
def test_error(r, n):
    rng = np.random.default_rng(n)
    rows, slots, levels = [], [], []
    for i in range(30):
        slot, level = r.levels(rng.integers(-(2**63), 2**63, n))
        best = np.zeros(r.m, dtype=np.int64)
        np.maximum.at(best, slot, level)
        at = np.flatnonzero(best)
        rows.append(np.full(len(at), i))
        slots.append(at)
        levels.append(best[at])
    count, error = r.estimate(np.concatenate(rows), np.concatenate(levels), 30)
    spread = np.sqrt(np.mean((count - n) ** 2))
    assert abs(count.mean() - n) <= 4 * spread / np.sqrt(30) + 0.02 * n
    assert spread <= 2.0 * error.mean() + 0.01 * n and error.mean() <= 1.3 * n / np.sqrt(r.m)


def dense_of(r, *sets):
    out = []
    for ids in sets:
        slot, level = r.levels(ids)
        best = np.zeros(r.m, dtype=np.int64)
        np.maximum.at(best, slot, level)
        out.append(best)
    return out


@pytest.mark.parametrize(("shared", "a", "b"), [(3000, 2000, 1000), (0, 5000, 5000), (50, 20, 30), (40_000, 0, 0), (500, 100, 60_000)])
def test_joint_errors_are_those_stated(shared, a, b):
    """Over many seeds nearly all estimates lie within three stated errors, and the errors are as large as the spread."""
    r, got = Registers(1024, 1.02), []
    for seed in range(60):
        ids = np.random.default_rng(seed).integers(-(2**63), 2**63, shared + a + b)
        got.append(r.joint(*dense_of(r, ids[: shared + a], np.concatenate([ids[:shared], ids[shared + a :]]))))
    got = np.array(got)
    n = shared + a + b
    for k, truth, small in ((0, n, 0.005 * n), (2, shared, 0.005 * n), (4, shared / n, 0.005)):
        off = np.abs(got[:, k] - truth)
        assert (off <= 3 * got[:, k + 1] + small).mean() >= 0.95, (k, off.mean(), got[:, k + 1].mean())
        spread = np.sqrt(np.mean(off**2))
        assert abs(got[:, k].mean() - truth) <= spread
        if shared and a + b:  # where sets are equal or have nothing in common the errors are upper bounds
            assert got[:, k + 1].mean() <= 2 * spread + 2 * small, (k, spread, got[:, k + 1].mean())


def test_joint_of_an_empty_set():
    r = Registers(256, 1.1)
    some, none = dense_of(r, np.arange(1000) * 7_919_000_000_001, np.zeros(0, np.int64))
    union, error, common, _, jaccard, _ = r.joint(some, none)
    assert union > 800 and error > 0 and common == jaccard == 0 and r.joint(none, none)[0] == 0


def test_partial_results_merge(spark):
    r = Registers(256, 1.2)
    df = spark.range(20_000).select(
        (F.col("id") % 3).alias("g"), F.when(F.col("id") % 5 > 0, (F.col("id") % 3000).cast("string")).alias("a"), (F.col("id") % 50).cast("string").alias("b"), F.lit("clash").alias("sketch")
    )
    fine = sketches(df.withColumn("h", F.col("a").substr(1, 1)), ["g", "h"], ["a", "b"], r)
    merged = {x.g: bytes(x.sketch) for x in merge_sketches(fine, ["g"]).collect()}
    whole = {x.g: bytes(x.sketch) for x in sketches(df.unionByName(df), ["g"], ["a", "b"], r).collect()}
    assert merged == whole and len(whole) == 3
    est = estimates(sketches(df, ["g"], ["a", "b"], r), ["a", "b"], r).collect()
    want = {x.g: (x.a, x.b) for x in df.groupBy("g").agg(F.count_distinct("a").alias("a"), F.count_distinct("b").alias("b")).collect()}
    for x in est:
        assert abs(x.a - want[x.g][0]) <= 5 * x.a_error and abs(x.b - want[x.g][1]) <= 5 * x.b_error + 1


def test_nulls_and_empty(spark):
    df = spark.createDataFrame([(None, "x"), (None, None), (1, None), (1, "")], "g int, a string")
    got = {x.g: (round(x.n), x.n_error) for x in estimates(sketches(df, ["g"], ["a"]), ["n"]).collect()}
    assert got[None][0] == 1 and got[1][0] == 1
    none = df.where("a is null")
    assert {round(x.n) for x in estimates(sketches(none, ["g"], ["a"]), ["n"]).collect()} == {0}
    assert estimates(sketches(df.where("false"), ["g"], ["a"]), ["n"]).count() == 0
    pairs = sketches(df, ["g"], ["a"]).withColumnRenamed("sketch", "p").withColumn("q", F.col("p"))
    assert {(x.g, round(x.jaccard)) for x in overlaps(pairs, "p", "q").collect()} == {(None, 1), (1, 1)}
