import random

from pyspark.sql import functions as F

from fathomry.llm.mixing import mixture, shares

TARGETS = "mix_id int, source string, weight double, max_repeats int, budget_share double"


def run(spark, records, targets):
    df = spark.createDataFrame(records, "doc_id long, source string, tokens long").withColumn("repeats", F.lit(1)).withColumn("__at", F.lit(1))
    chosen, plan = mixture(df, spark.createDataFrame(targets, TARGETS))
    return chosen.collect(), {(r.mix_id, r.source): r for r in shares(chosen, plan).collect()}


def test_budgets_caps_and_gaps(spark):
    rng = random.Random(6)
    records = [(i, "big" if i % 10 < 7 else "small" if i % 10 < 9 else "tiny", rng.randint(1, 50)) for i in range(3000)]
    records += [(9000, None, 40), (9001, "big", None), (9002, "big", 0), (None, "big", 7)]
    total = sum(t or 0 for _, _, t in records)
    targets = [(1, "big", 1.0, 1, 0.5), (1, "small", 1.0, 3, 0.5), (1, "tiny", 2.0, 2, 0.5), (1, "gone", 1.0, 5, 0.5), (2, "small", 1.0, 9, 0.05), (2, "big", 0.0, 2, 0.05),
               (2, "big", None, 2, 0.05), (3, "tiny", -1.0, None, None), (None, "big", 1.0, 1, 1.0), (4, None, 1.0, 1, 1.0)]
    rows, report = run(spark, records, targets)
    size = lambda s: sum(t or 0 for _, x, t in records if x == s)
    goal = {(1, "big"): min(0.1 * total, size("big")), (1, "small"): min(0.1 * total, 3 * size("small")), (1, "tiny"): min(0.2 * total, 2 * size("tiny")),
            (1, "gone"): 0, (2, "small"): 0.05 * total, (2, "big"): 0, (3, "tiny"): 0}
    assert set(report) == set(goal)
    for k, g in goal.items():
        assert abs(report[k].reached_tokens - g) <= 25, k
    assert report[1, "tiny"].most_repeats == 2 and report[1, "tiny"].reached_tokens == 2 * size("tiny")
    assert all(r.tokens > 0 for r in rows) and len({(r.mix_id, r.doc_id) for r in rows}) == len(rows)
    assert sum(r.reached_share for k, r in report.items() if k[0] == 1) == 1.0 or abs(sum(r.reached_share for k, r in report.items() if k[0] == 1) - 1) < 1e-9


def test_repeated_rows_and_empty(spark):
    rows, report = run(spark, [(1, "a", 10)] * 8, [(1, "a", 1.0, 1, 0.5)])
    assert report[1, "a"].reached_tokens == 40 and len(rows) == 4
    rows, report = run(spark, [], [(1, "a", 1.0, 1, 0.5)])
    assert rows == [] and report[1, "a"].reached_tokens == 0 and report[1, "a"].of_target is None
