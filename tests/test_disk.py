"""What the scored queries keep on disk: each side of the grid once, and rows that are stored compressed."""

from pathlib import Path

import pytest
from pyspark.sql import functions as F
from test_cells import SALT, corpus, hot, on_disk  # noqa: F401

from fathomry.functions import canonical, lineage
from fathomry.operators import blocking, cells, scoring
from fathomry.plans import catalog


def test_probes_and_visitors_are_moved_once_whatever_the_cells(spark):
    long = canonical.from_columns(corpus(spark, 150), "obs_id", ["webgl", "canvas", "user_agent", "fonts"], SALT)
    library, asked = long.where("id % 2 = 0").localCheckpoint(), long.where("id % 2 = 1").localCheckpoint()
    index = blocking.blocking_keys(library, b"seed").select("key", F.col("id").alias("visitor_id"))
    probe = scoring.probe_records(asked, blocking.blocking_keys(asked, b"seed"), SALT, scoring.frequency(library, SALT)).localCheckpoint()
    visitors = scoring.library_records(library, index, SALT).localCheckpoint()
    began = on_disk(spark)
    few = cells.best(probe, visitors, scoring.AGREE).count()
    once = on_disk(spark) - began
    assert cells.best(probe, visitors, scoring.AGREE, 8).count() > few
    many = on_disk(spark) - began - once
    assert many < once


def stored_mb(spark):
    return sum(p.stat().st_size for p in Path(spark.sparkContext.getCheckpointDir().removeprefix("file:")).rglob("*") if p.is_file()) / 1e6


@pytest.mark.parametrize("name", ["velocity_gate", "eval_rates"])
def test_what_is_stored_is_compressed(spark, hot, name):  # noqa: F811
    lineage.checkpoint_dir(spark)
    began = stored_mb(spark)
    assert catalog.QUERIES[name](spark, hot).count()
    assert stored_mb(spark) - began < 0.08
