import random

from pyspark.sql import functions as F

from fathomry.operators import maintenance, trailing


def log(n=600, seed=5):
    rng = random.Random(seed)
    return [(i, rng.choice(["k1", "k2", "hot", "hot", None]), rng.choice(["a", "b", "c", "d", None]), rng.choice([None, rng.randrange(5000)])) for i in range(n)]


def frame(spark, rows):
    return spark.createDataFrame(rows, "event_id long, who string, m string, at long").withColumn("__slice", F.lit(1))


def test_distinct_members(spark):
    rows = log()
    rows += rows[:50]
    good = [r for r in rows if None not in r]
    for closed in (True, False):
        want = set()
        for _, k, _, t in good:
            row = [k, t]
            for w in (100, 1500):
                row.append(len({m for _, k2, m, s in good if k2 == k and s <= t and (s >= t - w if closed else s > t - w)}))
            want.add(tuple(row))
        got = trailing.trailing_distinct(frame(spark, rows), "who", "m", "at", {"x": 100, "y": 1500}, closed).collect()
        assert {tuple(r) for r in got} == want and len(got) == len(want)


def test_slices_don_t_show(spark):
    rows = [r for r in log() if None not in r]
    df = frame(spark, rows).selectExpr("who as key", "m as member", "at as ts")
    a = trailing.with_next(df, ["key", "member"], 10)
    b = trailing.with_next(df, ["key", "member"], 10**9)
    assert set(a.collect()) == set(b.collect())


def test_counts(spark):
    rows = log()
    good = [(k, t) for _, k, _, t in rows if k is not None and t is not None]
    want = {(k, t, sum(k2 == k and t - 300 <= s <= t for k2, s in good)) for k, t in good}
    assert {tuple(r) for r in trailing.trailing_count(frame(spark, rows), "who", "at", 300).collect()} == want


def test_churn_and_regularity(spark):
    rows = [(i, "five", f"v{i}", i) for i in range(5)] + [(i, "same", "v", i) for i in range(4)] + [(i, "long", "old" if i < 10 else f"n{i % 2}", i) for i in range(30)]
    got = {r.who: (r.sampled, r.members, r.rate) for r in trailing.churn(frame(spark, rows), "who", "m", ["at", "event_id"]).collect()}
    assert got == {"five": (5, 5, 1.0), "same": (4, 1, 0.25), "long": (20, 2, 0.1)}
    times = {"even": range(0, 36_000_000, 3_600_000), "odd": [0, 1, 5000, 5001, 90_000, 95_000], "two": [1, 2], "still": [7, 7, 7]}
    df = spark.createDataFrame([(i, k, "m", t) for k, ts in times.items() for i, t in enumerate(ts)], "event_id long, who string, m string, at long")
    got = {r.who: (r.gaps, r.regularity) for r in trailing.regularity(df, "who", "at", ["at", "event_id"]).collect()}
    assert got["even"] == (9, 1.0) and got["odd"][1] < 0.7 and got["two"] == (1, 0.0) and got["still"] == (2, 1.0)


def test_bands_and_bursts(spark):
    df = spark.range(25).select("id", trailing.band(F.col("id"), *trailing.IP_BAND).alias("b"))
    got = {r.id: r.b for r in df.collect()}
    assert (got[4], got[5], got[19], got[20]) == ("low", "medium", "medium", "high")
    rows = [(1, "v", "a", 60_000), (2, "v", "a", 119_999), (3, "v", "b", 120_000), (4, None, "b", 1)]
    assert {tuple(r) for r in trailing.bursts(frame(spark, rows), "who", "at").collect()} == {("v", 60_000, 2), ("v", 120_000, 1)}


def test_maintenance(spark):
    r = spark.createDataFrame([("a", 1), ("b", 5), ("c", 5), ("d", 9), ("e", 5)], "visitor_id string, last_seen long")
    keep = lambda n: {x.visitor_id for x in maintenance.cap(r, n).collect()}
    assert [keep(n) for n in (1, 2, 3, 4, 5, 9)] == [{"d"}, {"d", "b"}, {"d", "b", "c"}, {"d", "b", "c", "e"}, set("abcde"), set("abcde")]
    assert {x.visitor_id for x in maintenance.expire(r, 10, 5).collect()} == {"b", "c", "d", "e"}
    entries = spark.createDataFrame([("k", "a"), ("k", "d")], "key string, visitor_id string")
    kept, index = maintenance.retire(r, entries, 5)
    assert kept.count() == 4 and [x.visitor_id for x in index.collect()] == ["d"]
    assert maintenance.retire(r, entries, 0)[0].count() == 5
    gone = spark.createDataFrame([("a",), ("zz",), ("a",)], "visitor_id string")
    assert maintenance.erase(r, gone).count() == 4
    issued = spark.createDataFrame([("n", 100), ("m", 100)], "nonce string, expires_ms long")
    uses = spark.createDataFrame([("n", 5, 1), ("n", 5, 2), ("m", 100, 3), ("x", 1, 4), (None, 1, 5)], "nonce string, used_ms long, use_id long")
    assert {x.use_id: x.outcome for x in maintenance.single_use(issued, uses).collect()} == {1: "valid", 2: "reused", 3: "expired", 4: "unknown", 5: "unknown"}
    assert {x.use_id: x.outcome for x in maintenance.single_use(issued, uses, closed=False).collect()}[3] == "valid"
    now = spark.createDataFrame([(1000,), (2000,), (999,), (2001,), (None,)], "t long").select(maintenance.in_window(F.col("t"), F.lit(1500), 500).alias("x"))
    assert [x.x for x in now.collect()] == [True, True, False, False, False]
    old = spark.createDataFrame([("a", "x", 1), ("b", "y", 1)], "k string, v string, at long")
    from fathomry.sources.ingest import upserted

    new = spark.createDataFrame([("a", "z", 1), ("c", "w", 0)], "k string, v string, at long")
    assert {tuple(x) for x in upserted(old, new, ["k"], "at").collect()} == {("a", "z", 1), ("b", "y", 1), ("c", "w", 0)}
