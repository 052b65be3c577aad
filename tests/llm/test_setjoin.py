import random
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from fathomry.llm.setjoin import calibrate, link_counts, similar_pairs


def records(n=260, seed=7):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    out = []
    for i in range(n):
        base = rng.sample(words, rng.randint(5, 25))
        for j in range(rng.randint(1, 4)):
            s = list(base)
            for _ in range(rng.randint(0, 3)):
                s[rng.randrange(len(s))] = rng.choice(words)
            out.append((f"r{i}_{j}", s + rng.choices(s, k=2)))
    return out


def brute(rows, num, den):
    sets = {}
    for k, s in rows:
        if k is not None and s and (v := frozenset(x for x in s if x is not None)):
            sets[k] = v
    return {(min(a, b), max(a, b)) for a, b in combinations(sets, 2) if len(sets[a] & sets[b]) * den >= len(sets[a] | sets[b]) * num}


@pytest.mark.parametrize("limit", [4096, 2])
def test_against_brute_force(spark, limit):
    rows = records() + [("copy1", ["x"]), ("copy2", ["x", "x", None]), ("none", None), ("empty", []), ("nulls", [None]), (None, ["x"])]
    df = spark.createDataFrame(rows + rows[:30], "name string, items array<string>").withColumn("key", F.lit(1)).withColumn("id", F.lit(1))
    got = similar_pairs(df, "name", "items", 4, 5, limit=limit).collect()
    assert {tuple(r) for r in got} == brute(rows, 4, 5) and len(got) == len(set(got))


def test_empty(spark):
    df = spark.createDataFrame([], "name string, items array<string>")
    assert similar_pairs(df, "name", "items").count() == 0


def test_calibration_bounds_misses():
    for n in (10, 10**5, 10**9):
        width, segments, radius = calibrate(n, 0.8, 1e-4)
        assert (1 - 0.9**width) ** segments <= 1e-4 and 20 < radius < 40


def test_link_counts(spark):
    rows = records(120) + [(f"copy{i}", ["x", "y"]) for i in range(50)] + [("alone", ["q"]), ("none", None)]
    df = spark.createDataFrame(rows + rows[:30], "name string, items array<string>").withColumn("links", F.lit(1))
    got = {r.key: (r.class_key, r.links) for r in link_counts(df, "name", "items").collect()}
    pairs = brute(rows, 4, 5)
    sets = {k: frozenset(s) for k, s in rows if s}
    first = {}
    for k in sorted(sets):
        first.setdefault(sets[k], k)
    assert got == {k: (first[s], sum(k in p for p in pairs)) for k, s in sets.items()}
    assert link_counts(df.where("false"), "name", "items").count() == 0


def test_large_buckets(spark):
    """Unlike sets that share buckets are dealt again; a cluster of like ones is compared in blocks, and all its pairs come out."""
    rng = random.Random(3)
    base = [f"b{i}" for i in range(40)]
    rows = [(f"v{i}", [x for x in base if x != f"b{i % 40}"] + [f"x{i}"]) for i in range(150)] + records(60)
    df = spark.createDataFrame(rows, "name string, items array<string>")
    got = {tuple(r) for r in similar_pairs(df, "name", "items", 4, 5, limit=8).collect()}
    assert got == brute(rows, 4, 5) and len(got) > 150 * 149 // 2


def test_set_of_a_third_of_all_records(spark):
    rows = [(f"c{i:03d}", ["x", "y", "z"]) for i in range(60)] + [(f"d{i:03d}", ["x", "y", "z", "q"] * 2 + [f"u{i}"]) for i in range(3)] + [(f"o{i}", [f"w{i}", "y"]) for i in range(100)]
    df = spark.createDataFrame(rows, "name string, items array<string>")
    got = [tuple(r) for r in similar_pairs(df, "name", "items", 3, 5).collect()]
    assert set(got) == brute(rows, 3, 5) and len(got) == len(set(got))
