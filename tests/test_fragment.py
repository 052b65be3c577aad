import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from fathomry.operators.fragment import distinct_per_key, pack, placement, skewed_join


def skewed(n=6000):
    rng = random.Random(4)
    rows = [("hot" if rng.random() < 0.4 else "warm" if rng.random() < 0.2 else f"k{rng.randrange(800)}", f"v{rng.randrange(1500)}") for _ in range(n)]
    return rows + [("hot", "v1")] * 500 + [(None, "v1"), ("hot", None), (None, None), ("", "x"), ("hot", "")]


def test_packing_balances():
    plan = pack({"a": (1000.0, 0.0), "b": (300.0, 0.0)}, {i: 1.0 for i in range(700)}, 10)
    assert {k: (lines, len(tasks)) for k, (lines, tasks) in plan.heavy.items()} == {"a": (10, 10), "b": (3, 3)}
    assert max(plan.loads) <= 1.1 * sum(plan.loads) / 10


def test_heavy_keys_are_found_and_split(spark):
    df = spark.createDataFrame(skewed(), "key string, member string")
    plan = placement(df, "key", 8)
    assert set(plan.heavy) == {"hot", "warm"} and len(plan.heavy["hot"][1]) > len(plan.heavy["warm"][1]) >= 1


def test_distinct_per_key(spark):
    rows = skewed()
    df = spark.createDataFrame(rows, "key string, member string").withColumn("__task", F.lit(1)).withColumn("members", F.lit(1))
    got = distinct_per_key(df, "key", "member", 8).collect()
    want = Counter(k for k, v in {(k, v) for k, v in rows if k is not None and v is not None})
    assert {r.key: r.members for r in got} == dict(want) and len(got) == len(want)
    assert distinct_per_key(df.where("false"), "key", "member", 8).count() == 0


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_join_is_the_plain_join(spark, how):
    left = spark.createDataFrame(skewed(2000), "key string, member string")
    right = spark.createDataFrame([("hot", 1), ("hot", 2), ("k5", 3), ("zz", 4), (None, 5), ("k7", 6), ("k7", 6)], "key string, n int")
    got = Counter(map(tuple, skewed_join(left, right, "key", how, 8).collect()))
    assert got == Counter(map(tuple, left.join(right, "key", how).collect()))
    assert skewed_join(left.where("false"), right, "key", how, 8).count() == 0


def test_join_without_exchange_of_a_side_twice(spark):
    left = spark.createDataFrame(skewed(500), "key string, member string")
    right = spark.createDataFrame([("hot", 1)], "key string, n int")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        plan = skewed_join(left, right, "key", "inner", 8)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert plan.count("Exchange") - plan.count("BroadcastExchange") <= 2, plan


def test_keys_heavy_on_either_side(spark):
    """Rows of a key that is heavy on the right, or on both sides, meet each other once, on many tasks."""
    left = spark.createDataFrame([("both", i) for i in range(900)] + [("right", i) for i in range(3)] + [("left", i) for i in range(900)] + [(f"k{i}", i) for i in range(300)], "key string, m int")
    right = spark.createDataFrame([("both", i) for i in range(500)] + [("right", i) for i in range(800)] + [("left", 0), (None, 1)] + [(f"k{i}", i) for i in range(300)], "key string, n int")
    plan = placement(left, "key", 8, right)
    assert plan.heavy["both"][0] > 1 and len(plan.heavy["both"][1]) > plan.heavy["both"][0] and plan.heavy["right"][0] == 1 < len(plan.heavy["right"][1])
    got = Counter(map(tuple, skewed_join(left, right, "key", "inner", 8).collect()))
    assert got == Counter(map(tuple, left.join(right, "key").collect()))


def test_many_tasks_have_as_many_buckets():
    assert len(pack({}, {0: 1.0}, 2000).light) == 16_000
