import random

import numpy as np
from pyspark.sql import functions as F

from fathomry.operators.sessions import dilate, sessions

SCHEMA = "event_id long, who string, ms long"


def brute(rows, gap):
    seen, by = set(), {}
    for e, who, ms in rows:
        if who is None or ms is None or (e is not None and (who, ms, e) in seen):
            continue
        seen.add((who, ms, e))
        by.setdefault(who, []).append(ms)
    out = set()
    for who, times in by.items():
        times.sort()
        part = [times[0]]
        for t in [*times[1:], None]:
            if t is None or t - part[-1] > gap:
                out.add((who, part[0], part[-1], part[-1] - part[0], len(part)))
                part = []
            part.append(t)
    return out


def run(spark, rows, gap, **more):
    df = spark.createDataFrame(rows, SCHEMA).withColumn("entity", F.lit("clash")).withColumn("session", F.lit(1))
    got = sessions(df, "who", "ms", "event_id", gap, **more).collect()
    assert len(got) == len(set(got))
    return {tuple(r) for r in got}


def test_dilation_is_that_of_a_bitmap():
    rng = random.Random(1)
    for _ in range(200):
        bits = sorted(rng.sample(range(300), rng.randint(1, 30)))
        width = rng.randint(1, 40)
        s, e = dilate(np.array(bits), np.array(bits), width)
        wanted = np.zeros(400, dtype=bool)
        for b in bits:
            wanted[b : b + width] = True
        got = np.zeros(400, dtype=bool)
        for a, z in zip(s, e, strict=True):
            got[a : z + 1] = True
        assert (got == wanted).all() and (s[1:] > e[:-1] + 1).all()


def test_against_brute_force(spark):
    rng = random.Random(2)
    rows = [(rng.choice([None, *range(400)]), rng.choice(["a", "b", "c", None]), rng.choice([None, rng.randrange(0, 60_000)])) for _ in range(1200)]
    rows += rows[:100]
    fixed = {}
    rows = [r if r[0] is None else fixed.setdefault(r[0], r) for r in rows]  # an id has one content
    for gap, piece in ((1, 1000), (100, 700), (5000, 3000)):
        assert run(spark, rows, gap, slice_ms=piece) == brute(rows, gap)


def test_borders_and_ties(spark):
    rows = [(1, "a", 0), (2, "a", 1_800_000), (3, "a", 3_600_001), (4, "a", 3_600_001), (None, "a", 3_600_001), (None, "a", 3_600_001), (4, "a", 3_600_001)]
    assert run(spark, rows, 1_800_000) == {("a", 0, 1_800_000, 1_800_000, 2), ("a", 3_600_001, 3_600_001, 0, 4)}


def test_one_entity_over_many_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        rows = [(i, "hot", i * 10) for i in range(500)] + [(i, "hot", i * 10) for i in range(500)]
        assert run(spark, rows, 10, slice_ms=333) == {("hot", 0, 4990, 4990, 500)}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_empty(spark):
    assert run(spark, [], 5) == set()
