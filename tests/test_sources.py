import json

import pytest
from pyspark.sql import functions as F

from fathomry.sources.ingest import append, checkin_requests, claimed_agent, fixture, valid_objects


def test_requests(spark):
    good = {"accountId": "a", "action": "daily_checkin", "identify": {"visitorId": "v", "more": 1}}
    bodies = [good, good | {"ip": "1.2.3.4"}, good | {"accountId": ""}, good | {"action": "other"}, {"accountId": "a"}]
    rows = [(json.dumps(b), "9.9.9.9", 5) for b in bodies] + [("[1]", "x", 1), ("{oops", "x", 1), (None, "x", 1)]
    df = spark.createDataFrame(rows, "body string, ip string, ts long")
    assert [tuple(r) for r in checkin_requests(df, "body", "ip", "ts").collect()] == [("a", "v", "9.9.9.9", 5)]
    problems = [r.problem for r in valid_objects(df, "body", ["accountId", "action", "identify"], ["accountId", "identify"]).collect()]
    assert problems == [None, "unknown member", None, None, "missing member", "no object", "unreadable", "unreadable"]


def test_claimed_agent(spark):
    rows = [('{"ua": "c", "user_agent": "b", "userAgent": 3}',), ('{"ua": "c"}',), ('{"userAgent": "a", "ua": "c"}',), ("{}",), (None,), ("x",)]
    df = spark.createDataFrame(rows, "c string")
    assert [r.a for r in df.select(claimed_agent(F.col("c")).alias("a")).collect()] == ["b", "c", "a", None, None, None]


def test_fixture_and_append(spark, tmp_path):
    doc = {"description": "x", "devices": [{"deviceId": "d1", "observations": [{"webgl": "a"}, {"webgl": "b", "cpu_cores": 2}]}, {"deviceId": "d2", "observations": []}]}
    (tmp_path / "f.json").write_text(json.dumps(doc, indent=1))
    got = fixture(spark, str(tmp_path / "f.json")).orderBy("place", "visit").collect()
    assert [(r.device, r.visit, json.loads(r.components)) for r in got] == [("d1", 0, {"webgl": "a"}), ("d1", 1, {"webgl": "b", "cpu_cores": 2})]
    df = spark.createDataFrame([(1, "x"), (2, "y")], "id long, day string")
    append(df, str(tmp_path / "t"), ["day"])
    append(df, str(tmp_path / "t"), ["day"])
    assert spark.read.parquet(str(tmp_path / "t")).count() == 4 and spark.read.parquet(str(tmp_path / "t")).where("day = 'x'").count() == 2
    with pytest.raises(Exception):
        fixture(spark, str(tmp_path / "none.json")).count()
