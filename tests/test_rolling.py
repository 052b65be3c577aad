import random

from pyspark.sql import functions as F

from fathomry.operators.rolling import rolling_totals

SCHEMA = "event_id long, acct string, vis string, d int"


def brute(rows, lo, hi, periods, least=0):
    known, own = {}, []
    for e, a, v, d in rows:
        if a is None or d is None or not lo <= d <= hi:
            continue
        if e is None:
            own.append((a, v, d))
        else:
            known[e] = (a, v, d)
    events = own + list(known.values())
    out = set()
    for a in {x[0] for x in events}:
        mine = [x for x in events if x[0] == a]
        if len(mine) < least:
            continue
        for day in range(lo, hi + 1):
            row = [a, day, sum(x[2] == day for x in mine)]
            for p in periods:
                w = [x for x in mine if day - p < x[2] <= day]
                row += [len(w), len(w) / p, len({x[1] for x in w} - {None})]
            out.add(tuple(row))
    return out


def run(spark, rows, *args, **more):
    df = spark.createDataFrame(rows, SCHEMA).withColumn("entity", F.lit(0)).withColumn("n", F.lit(0)).withColumn("day", F.lit(0))
    got = rolling_totals(df, "acct", "d", "event_id", "vis", *args, **more).collect()
    assert len(got) == len(set(got))
    return {tuple(r) for r in got}


def test_against_brute_force(spark):
    rng = random.Random(3)
    rows = [(i, rng.choice(["a", "b", None]), rng.choice(["v1", "v2", "v3", None]), rng.choice([None, rng.randint(-5, 50)])) for i in range(300)]
    rows += rows[:60] + [(None, "a", "v1", 4), (None, "a", "v1", 4), (900, "late", "v", 40)]
    assert run(spark, rows, 0, 40, (7, 30)) == brute(rows, 0, 40, (7, 30))
    assert run(spark, rows, 0, 40, (1, 3), least_total=20) == brute(rows, 0, 40, (1, 3), 20)


def test_empty(spark):
    assert run(spark, [], 0, 5) == set()
