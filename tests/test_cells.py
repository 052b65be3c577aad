"""Scores found in cells of a grid: the same as of the relational form, and nothing on disk for each pair."""

import random
import subprocess

import pytest
from compare import compare, connect
from pyspark.sql import functions as F

from fathomry.functions import canonical, hashing
from fathomry.operators import blocking, cells, scoring
from fathomry.plans import catalog

SALT = hashing.salt_from_secret("cells")


def corpus(spark, n, hot=False):
    """Observations of ``n`` devices, two of each; if ``hot``, all have one key in common."""
    r = random.Random(7)
    words = [f"font {i}" for i in range(60)]
    rows = []
    for d in range(n):
        own = [r.choice(["g1", "g2", None]), r.choice(["p1", "p2"]), "t", r.choice(["a1", "a2", None]), r.choice([2, 4, 8]), r.choice([4, 8, None]), f"agent {d % 9}", f"canvas {d}"]
        if hot:
            own[:3] = ["g", "p", "t"]
        fonts = r.choice([None, []]) if d % 11 == 0 else r.sample(words, 20)
        for v in range(2):
            rows.append((2 * d + v, f"d{d}", v + 1, 1000 * d + v, *own, fonts if fonts is None or v == 0 else fonts[:-4] + ["new"]))
    return spark.createDataFrame(rows, "obs_id long, device_id string, visit_no int, ts long, webgl string, platform string, timezone string, audio string, cpu_cores long, device_memory long, user_agent string, canvas string, fonts array<string>")


@pytest.mark.parametrize("column, bits", [(1000, 4096), (5, 4096), (1000, 0), (7, 64)])
def test_scores_are_those_of_the_relational_form(spark, column, bits):
    long = canonical.from_columns(corpus(spark, 60), "obs_id", ["webgl", "platform", "timezone", "audio", "cpu_cores", "device_memory", "user_agent", "canvas", "fonts"], SALT)
    library, asked = long.where("id % 2 = 0").localCheckpoint(), long.where("id % 2 = 1").localCheckpoint()
    keys, counts = blocking.blocking_keys(asked, b"seed"), scoring.frequency(library, SALT)
    index = blocking.index(blocking.blocking_keys(library, b"seed").select("key", F.col("id").alias("visitor_id")), ["visitor_id"])
    want = scoring.scores(scoring.compared(blocking.candidates(keys, index), scoring.probes(asked, SALT, counts), scoring.packed(library)))
    probe, visitors = scoring.probe_records(asked, keys, SALT, counts), scoring.library_records(library, index, SALT)
    scored = {tuple(x) for x in want.collect()}
    assert len(scored) > 500 and {tuple(x) for x in cells.scored(probe, visitors, scoring.AGREE, column, bits).select("id", "visitor_id", "score", "compared").collect()} == scored
    top = cells.best(probe, visitors, scoring.AGREE, column, bits)
    decided = lambda s: {tuple(x) for x in scoring.decide(asked, s).collect()}
    assert decided(top) == decided(want)


def test_no_pairs(spark):
    none = canonical.from_columns(corpus(spark, 2), "obs_id", ["webgl"], SALT).where("false")
    keys = blocking.blocking_keys(none, b"seed")
    probe = scoring.probe_records(none, keys, SALT, scoring.frequency(none, SALT))
    visitors = scoring.library_records(none, keys.select("key", F.col("id").alias("visitor_id")), SALT)
    assert cells.scored(probe, visitors, 0.5).count() == cells.best(probe, visitors, 0.5).count() == cells.shared_values(probe, visitors).count() == 0


def on_disk(spark):
    """MB of shuffle files."""
    folders = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()
    return int(subprocess.run(["du", "-scB1", *folders], capture_output=True, text=True).stdout.split("\n")[-2].split("\t")[0]) / 1e6


@pytest.fixture(scope="module")
def hot(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("hot")
    corpus(spark, 200, hot=True).coalesce(1).write.parquet(f"{folder}/synthetic_observations.parquet")
    return str(folder)


@pytest.mark.parametrize("name", ["fs_candidate_scores", "score_decision", "score_block_scope", "agreement_rates", "score_learned", "identify_batches", "velocity_gate", "eval_rates"])
def test_nothing_is_moved_for_each_pair(spark, hot, name):
    """40,000 pairs of 200 probes and 200 visitors; moved with their components they were over 8 MB."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as on large tables
    try:
        began = on_disk(spark)
        assert compare(spark, connect(hot), hot, name, catalog.QUERIES[name], catalog.ORACLES[name]) == ""
        assert on_disk(spark) - began < 2
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
