import os

from pyspark.sql import functions as F

from fathomry.streaming import live


def stream(spark, tmp_path, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    return spark.readStream.schema(schema).parquet(str(tmp_path / "in"))


def drain(df, mode, tmp_path, name):
    q = df.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return df.sparkSession.table(name)


def test_minute_bursts_and_repeats(spark, tmp_path):
    rows = [(1, "v", 60_000), (2, "v", 61_000), (2, "v", 61_000), (3, "w", 125_000)]
    events = live.event_time(stream(spark, tmp_path, rows, "event_id long, who string, ms long"))
    got = drain(live.minute_bursts(live.once(events, "event_id", "1 hour"), "who", "1 hour").select("who", F.unix_millis("minute").alias("m"), "n"), "append", tmp_path, "bursts")
    assert {tuple(r) for r in got.collect()} <= {("v", 60_000, 2), ("w", 120_000, 1)}


def in_parts(spark, tmp_path, parts, schema):
    """A stream that takes one part (a list of rows) in each micro-batch."""
    for i, rows in enumerate(parts):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        for p in (tmp_path / "in").glob("part-*"):
            if not p.name.startswith("part-x"):
                p.rename(p.with_name(f"part-x{i}.parquet"))
                os.utime(p.with_name(f"part-x{i}.parquet"), (1_000_000 + i, 1_000_000 + i))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))


def test_rolling_members(spark, tmp_path):
    """Rows of later micro-batches that belong before rows already seen count as if they had come in time."""
    first = [("k", "a", 7), ("k", "b", 10), ("k", "c", 30), ("j", "a", 30), (None, "a", 1), ("k", None, 1)]
    late = [("k", "b", 20), ("k", "c", 1000), ("k", "d", 1040)]
    parts = [first, late, [("z", "end", 500_000)], [("k", "never", 5), ("z", "end", 900_000)]]
    events = live.event_time(in_parts(spark, tmp_path, parts, "who string, m string, ms long"))
    df = live.rolling_members(events, "who", "m", "ms", 100, "1 minute")
    got = sorted(tuple(r) for r in drain(df, "append", tmp_path, "members").collect() if r.who != "z")
    assert got == sorted([("k", "a", 7, 1), ("k", "b", 10, 2), ("k", "b", 20, 2), ("k", "c", 30, 3), ("k", "c", 1000, 1), ("k", "d", 1040, 2), ("j", "a", 30, 1)])


def test_live_sessions(spark, tmp_path):
    parts = [[("v", 0), ("v", 60_000), ("w", 5)], [("v", 30_000), ("v", 4_000_000)], [("z", 900_000_000)]]
    events = live.event_time(in_parts(spark, tmp_path, parts, "who string, ms long"))
    out = live.live_sessions(events, "who", "30 minutes", "2 hours").select("who", F.unix_millis("started").alias("s"), F.unix_millis("ended").alias("e"), "events")
    assert {tuple(r) for r in drain(out, "append", tmp_path, "sessions").collect()} == {("v", 0, 60_000, 3), ("v", 4_000_000, 4_000_000, 1), ("w", 5, 5, 1)}


def test_batches(spark, tmp_path):
    rows = [(1, "v", 60_000), (2, "v", 61_000)]
    seen = []
    q = live.in_batches(stream(spark, tmp_path, rows, "event_id long, who string, ms long"), lambda df, n: seen.append(df.count()), str(tmp_path / "cp2"))
    q.awaitTermination(120)
    assert sum(seen) == 2
