"""State of the library, settings, tables and other small operators."""

import importlib
import time

import pytest
from pyspark.sql import functions as F

from fathomry.functions import hashing, lineage, settings
from fathomry.operators import blocking, maintenance, signals, trailing
from fathomry.sources import ingest


def test_drift_overwrites_by_name_and_null_overwrites_too(spark):
    old = spark.createDataFrame([("v", "a", "1"), ("v", "b", "2"), ("w", "a", "3")], "visitor_id string, name string, value string")
    new = spark.createDataFrame([("v", "b", None), ("v", "c", "4"), ("u", "a", "5")], "visitor_id string, name string, value string")
    got = {tuple(r) for r in maintenance.drift(old, new).collect()}
    assert got == {("v", "a", "1"), ("v", "b", None), ("v", "c", "4"), ("w", "a", "3"), ("u", "a", "5")}
    assert maintenance.drift(old.where("false"), new.where("false")).count() == 0


def test_merged_keeps_newer_values(spark):
    kind = "visitor_id string, name string, cat string, fresh long"
    old = spark.createDataFrame([("v", "a", "x", 5), ("v", "b", "y", 5)], kind)
    new = spark.createDataFrame([("v", "a", "z", 9), ("v", "b", "late", 1), ("w", "a", "q", 2)], kind)
    assert {tuple(r) for r in maintenance.merged(old, new).collect()} == {("v", "a", "z", 9), ("v", "b", "y", 5), ("w", "a", "q", 2)}


def test_without_visitors(spark):
    entries = spark.createDataFrame([("k", "a"), ("k", "b"), ("j", "a")], "key string, visitor_id string")
    gone = spark.createDataFrame([("a",), ("a",), (None,), ("zz",)], "visitor_id string")
    assert [tuple(r) for r in blocking.without_visitors(entries, gone).collect()] == [("k", "b")]


def test_recall_is_bounded_and_leaves_dangling_entries_out(spark):
    pairs = spark.createDataFrame([(1, f"v{i}") for i in range(7)] + [(2, "v1"), (2, "gone"), (3, "gone")], "id long, visitor_id string")
    templates = spark.createDataFrame([(f"v{i}",) for i in range(7)] * 2 + [(None,)], "visitor_id string")
    kept, counts = blocking.recall(pairs, templates, 4)
    assert {tuple(r) for r in kept.collect()} == {(1, "v0"), (1, "v1"), (1, "v2"), (1, "v3"), (2, "v1")}
    assert {tuple(r) for r in counts.collect()} == {(1, 4, 3), (2, 1, 0)}


def test_salts_and_digests(spark):
    assert len(hashing.random_salt()) == hashing.SALT_BYTES and hashing.random_salt() != hashing.random_salt()
    df = spark.createDataFrame([("ab", "AB"), ("ab", "ac"), ("ab", None)], "want string, got string")
    assert [r[0] for r in df.select(hashing.verified(F.col("want"), F.col("got"))).collect()] == [True, False, False]


def test_cap_with_many_equal_times_and_current_records(spark):
    rows = [(f"visitor{i:05d}", 7) for i in range(300)] + [("early", 1), ("late", 9)]
    df = spark.createDataFrame(rows, "visitor_id string, last_seen long")
    was, maintenance.TIES = maintenance.TIES, 20
    try:
        want = {"late"} | {f"visitor{i:05d}" for i in range(99)}
        assert {r.visitor_id for r in maintenance.cap(df, 100).collect()} == want
        now = spark.createDataFrame([("early",), ("early",)], "visitor_id string")
        assert {r.visitor_id for r in maintenance.cap(df, 100, now).collect()} == {"early", "late"} | {f"visitor{i:05d}" for i in range(98)}
        assert maintenance.cap(df, 0).count() == 0
    finally:
        maintenance.TIES = was


def test_issue(spark):
    df = spark.createDataFrame([(1, 5), (2, 6), (None, 7)], "id long, ts long")
    got = maintenance.issue(df, "id", "ts", b"s").collect()
    assert len(got) == 2 and all(len(r.nonce) == 32 for r in got) and {r.expires_ms for r in got} == {30_005, 30_006} and got[0].nonce != got[1].nonce


def test_consistent(spark):
    df = spark.createDataFrame([("mismatch",), ("degraded",), ("consistent",), (None,)], "s string")
    assert [r[0] for r in df.select(signals.consistent("s")).collect()] == [False, True, True, True]


def test_rate_bands_count_new_devices_only(spark):
    rows = [(i, True, "1.1.1.1", 100 + i) for i in range(6)] + [(6, False, "1.1.1.1", 107), (7, True, None, 108), (8, True, "1.1.1.1", 5000)]
    df = spark.createDataFrame(rows, "id long, fresh boolean, ip string, s long")
    got = {r.id: r.band for r in trailing.rate_bands(df, "id", "fresh", "s", {"band": ("ip", (3, 5))}, 3600).collect()}
    assert got == {0: "low", 1: "low", 2: "medium", 3: "medium", 4: "high", 5: "high", 6: "low", 7: "low", 8: "low"}


def test_settings_in_layers(tmp_path, spark):
    file = tmp_path / "s.toml"
    file.write_text('salt_secret = "file"\nblock_cap = 7\ntrust_proxy = true\n')
    env = {"FATHOMRY_BLOCK_CAP": "9", "FATHOMRY_SALT_SECRET": " ", "OTHER": "x"}
    s = settings.load(str(file), env)
    assert (s.salt_secret, s.block_cap, s.trust_proxy, s.nonce_ttl_ms) == ("file", 9, True, 30_000)
    spark.conf.set("spark.fathomry.block_cap", "11")
    try:
        assert settings.load(str(file), env, spark).block_cap == 11
    finally:
        spark.conf.unset("spark.fathomry.block_cap")
    assert settings.load(str(tmp_path / "none"), {}) == settings.Settings()
    file.write_text("unknown = 1")
    with pytest.raises(ValueError):
        settings.load(str(file), {})
    with pytest.raises(ValueError):
        settings.load(None, {"FATHOMRY_TRUST_PROXY": "maybe"})


def test_signed_rows(spark):
    df = spark.createDataFrame([("abc", 1_700_000_000_000)], "visitorId string, t long")
    r = ingest.signed(df, b"test-signing-secret", "t", ["visitorId"]).first()
    want = df.select(hashing.signature(b"test-signing-secret", "t", F.lit('{"visitorId":"abc"}'))).first()[0]
    assert (r.body, r.timestamp, r.signature) == ('{"visitorId":"abc"}', 1_700_000_000_000, want)


def test_layout_of_tables(spark, tmp_path):
    df = spark.createDataFrame([("k", "a"), ("j", "b")], "key string, visitor_id string")
    ingest.lay_out(df, "blocking_index", str(tmp_path / "b"))
    try:
        plan = spark.table("blocking_index").groupBy("key").count()._jdf.queryExecution().executedPlan().toString()
        assert "Exchange hashpartitioning" not in plan and spark.table("blocking_index").count() == 2
    finally:
        spark.sql("DROP TABLE blocking_index")


def test_checkpoints_need_a_shared_folder_and_go_away(spark, monkeypatch):
    class Elsewhere:
        master = "spark://host:7077"
        getCheckpointDir = staticmethod(lambda: None)

    class Session:
        sparkContext = Elsewhere()
        conf = spark.conf

    if spark.conf.get("spark.checkpoint.dir", None) is None:
        with pytest.raises(RuntimeError):
            lineage.checkpoint_dir(Session())
    folder = spark._jvm.org.apache.hadoop.fs.Path(lineage.checkpoint_dir(spark) and spark.sparkContext.getCheckpointDir())
    fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    before = len(fs.listStatus(folder))
    made = lineage.cut(spark.range(10))
    assert made.count() == 10 and len(fs.listStatus(folder)) >= 1
    del made
    importlib.import_module("gc").collect()
    for _ in range(20):
        spark._jvm.System.gc()
        time.sleep(0.5)
        if len(fs.listStatus(folder)) <= before:
            break
    assert len(fs.listStatus(folder)) <= before


def test_errors_inside_the_corpus_package_are_not_hidden():
    text = open(importlib.import_module("__spark_entry__").__file__).read()
    assert "except ImportError" not in text and "find_spec" in text
