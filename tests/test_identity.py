import hashlib
import json

import pytest
from pyspark.sql import functions as F

from fathomry.functions import canonical, hashing
from fathomry.operators import blocking, maintenance, replay, scoring, signals

# Secret, devices, ids and confidences that a result must equal.
SALT = hashing.salt_from_secret("fp-parity-vector-secret")
A = {"webgl": "ANGLE (Intel)", "platform": "Linux x86_64", "timezone": "Asia/Shanghai", "audio": "124.04", "cpu_cores": 8, "device_memory": 8,
     "fonts": ["Arial", "Helvetica", "Courier", "Times", "Verdana"], "user_agent": "Chrome/120"}
DRIFT = A | {"fonts": ["Arial", "Helvetica", "Courier", "Times", "Segoe"], "user_agent": "Chrome/121"}
B = {"webgl": "Apple GPU", "platform": "iPhone", "timezone": "America/New_York", "audio": "35.7", "cpu_cores": 6, "device_memory": 4,
     "fonts": ["SF Pro", "Menlo", "Georgia", "Palatino"], "user_agent": "Safari/17"}
THIN = {"webgl": "ANGLE (Intel)", "platform": "Linux x86_64", "timezone": "Asia/Shanghai", "cpu_cores": 8}
ID_A = "ab294a9621826a50d68e101b305c02f0260eff887d55ee18333bbbb3ad9d64d4"


def played(spark, *steps, ips=None):
    rows = [(i, 1000 * i, json.dumps(s), ips[i] if ips else None) for i, s in enumerate(steps)]
    df = spark.createDataFrame(rows, "id long, ts long, c string, ip string")
    long = canonical.from_json(df, "id", "c", SALT)
    seen = df.select("id", "ts", canonical.visitor_id("c").alias("minted"), "ip")
    out = replay.replay(replay.prepared(long, seen, SALT, b"seed")).collect()
    return sorted(out, key=lambda r: int(r.id))


def test_first_sight(spark):
    r = played(spark, A)[0]
    assert (r.visitor_id, r.decision, r.confidence) == (ID_A, "new_device", 0.5)


def test_drift_other_and_review(spark):
    r = played(spark, A, DRIFT)[1]
    assert (r.visitor_id, r.decision, r.is_new_device) == (ID_A, "match", False) and r.confidence == pytest.approx(0.8571488977696162, abs=1e-12)
    r = played(spark, A, B)[1]
    assert (r.decision, r.confidence) == ("new_device", 0.5) and r.visitor_id.startswith("fbc0a672")
    r = played(spark, A, THIN)[1]
    assert (r.visitor_id, r.decision) == (ID_A, "review") and r.confidence == pytest.approx(0.21689915986753416, abs=1e-12)


def distinct_probe(i):
    return {"webgl": f"G{i}", "platform": f"P{i}", "timezone": f"Z{i}", "audio": f"{i}", "cpu_cores": i, "device_memory": 100 + i, "user_agent": f"U{i}"}


def test_bursts_of_new_devices(spark):
    out = played(spark, *[distinct_probe(i) for i in range(21)], ips=["1.1.1.1"] * 20 + ["2.2.2.2"])
    assert [r.new_device_velocity for r in out[3:6]] == ["low", "medium", "medium"]
    assert out[19].new_device_velocity == "high" and out[19].confidence == pytest.approx(0.2)
    assert out[20].new_device_velocity == "low" and out[20].confidence == 0.5


def test_relational_scores_are_those_of_the_replay(spark):
    rows = [(i, json.dumps(c)) for i, c in enumerate([A, B, DRIFT, THIN, {}])]
    df = spark.createDataFrame(rows, "id long, c string")
    long = canonical.from_json(df, "id", "c", SALT)
    library, asked = long.where("id < 2"), long.where("id >= 2")
    keys = blocking.blocking_keys(long, b"seed")
    index = blocking.index(keys.where("id < 2").select("key", F.col("id").alias("visitor_id")), ["visitor_id"])
    pairs = blocking.candidates(keys.where("id >= 2"), index)
    probe = scoring.probes(asked, SALT, scoring.frequency(library.where("id = 0"), SALT))
    weights = scoring.compared(pairs, probe, scoring.packed(library))
    out = {r.id: r for r in scoring.decide(df.where("id >= 2"), scoring.scores(weights)).collect()}
    assert out[2].decision == "match" and out[2].confidence == pytest.approx(0.8571488977696162, abs=1e-12)
    assert out[3].decision == "review" and out[3].score == pytest.approx(8.6272, abs=1e-4)
    assert out[4].decision == "new_device" and out[4].score is None and out[4].confidence == 0.5


def test_components_of_json(spark):
    texts = ['{"webgl": null, "cpu_cores": 2.5, "screen": "8", "fonts": ["b", "a", 3, "a"], "plugins": "x", "canvas": {"x": 1}, "other": true}',
             '{"cpu_cores": {"value": -2.5, "duration": 1}, "fonts": {"value": [], "duration": 2}, "botd": {"bot": false}}', "[1]", "null", "", None, "{oops"]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, c string").withColumn("name", F.lit("clash"))
    got = {(r.id, r.name): (r.cat, r.num, r.elems) for r in canonical.from_json(df, "id", "c", SALT).collect()}
    h = lambda s: hashlib.sha256(SALT + s.encode()).hexdigest()
    assert got == {(0, "cpu_cores"): (None, 3, None), (0, "fonts"): (None, None, sorted([h("a"), h("b")])), (0, "other"): (h("true"), None, None),
                   (1, "cpu_cores"): (None, -3, None), (1, "fonts"): (None, None, [])}


def test_collector_names(spark):
    text = '{"hardwareConcurrency": {"value": 4}, "cpu_cores": {"value": 9}, "webGlBasics": {"value": "x"}, "webGlExtensions": {"value": "y"}, "fonts": {"value": "no"}, "extra": {"value": 1}, "bad": {"error": 1}, "raw": 3}'
    df = spark.createDataFrame([(1, text)], "id long, c string")
    got = {r.name: json.loads(r.v) for r in canonical.unwrapped(canonical.entries(df, "id", "c")).select("name", F.to_json("value").alias("v")).collect()}
    assert got == {"cpu_cores": 4, "webgl": "y", "extra": 1}


def test_digests(spark):
    row = spark.range(1).select(
        hashing.probe_digest(b"test-probe-secret", F.lit("fixed-nonce-000")).alias("p"),
        hashing.signature(b"test-signing-secret", F.lit(1_700_000_000_000), F.lit('{"visitorId":"abc"}')).alias("s"),
        hashing.probe_digest(b"x" * 100, F.lit("n")).alias("long"),
        F.hex(hashing.le64(F.lit(258))).alias("le"),
    ).first()
    import hmac

    assert row.p == "ad83144894f917b94072c2f7b3246af66d3bc5a450562ccf3671ed64d33137d0"
    assert row.s == "11e764ff987d7be6e4f9e272c9c9fbb9c29fc8c5e3dcc5b935dfa11b9c751792"
    assert row.long == hmac.new(b"x" * 100, b"n", "sha256").hexdigest() and row.le == "0201000000000000"


def test_signals(spark):
    browser, script = "t13d1516h2_a_b", "t13d0304h1_a_b"
    rows = [("Mozilla/5.0", browser, "34.120.5.6"), ("Mozilla/5.0", script, "198.51.100.7"), ("curl/8 Mozilla", browser, "10.1.2.3"), (None, script, "2001:db8::1"),
            ("Mozilla", "garbage", " 52.1.1.1 "), ("Mozilla", None, None), ("x", "q13d1516h3", "13.96.0.1"), ("Firefox", "t13d1516h1_x", "13.95.255.255"), ("x", "t13d", "999.1.1.1")]
    df = spark.createDataFrame(rows, "agent string, ja4 string, ip string")
    got = [(r.ip_risk, r.tls_consistency) for r in signals.signals(df, "agent", "ja4", "ip").collect()]
    assert got == [("high", "consistent"), ("low", "mismatch"), ("low", "mismatch"), ("low", "consistent"), ("high", "degraded"), ("low", "degraded"),
                   ("low", "consistent"), ("high", "mismatch"), ("low", "degraded")]
    blind = signals.signals(df, "agent", "ja4", "ip", F.lit(False)).select("ip_risk", "tls_consistency").distinct().collect()
    assert [tuple(r) for r in blind] == [("low", "degraded")]


def test_block_cap(spark):
    rows = [("k", f"v{i}", i) for i in range(5)] + [("k", "v0", 9), ("j", "v1", 0), (None, "v", 0), ("k", None, 0)]
    df = spark.createDataFrame(rows, "key string, visitor_id string, seq long")
    assert {tuple(r) for r in blocking.index(df, ["seq"], 2).collect()} == {("k", "v0"), ("k", "v1"), ("j", "v1")}


def test_capped_frequency(spark):
    rows = [(1, "a"), (2, "b"), (3, "a"), (4, "c"), (5, "b"), (6, "c")]
    df = spark.createDataFrame(rows, "seq long, cat string").withColumn("num", F.lit(None).cast("long"))
    got = {r.value: r.hits for r in scoring.capped_frequency(df, SALT, ["seq"], 2).collect()}
    assert got == {"a": 2, "b": 2}


def test_caps_of_names_and_keys_and_raw_rate(spark):
    rows = [(1, "a", 1.0), (2, "b", 0.0), (3, "a", 0.2), (4, "c", 1.0), (5, "b", 1.0), (6, None, 1.0)]
    df = spark.createDataFrame(rows, "seq long, name string, sim double")
    got = {r.name: (r.agree, r.total) for r in scoring.capped_agreement(df, ["seq"], 2).collect()}
    assert got == {"a": (1, 2), "b": (1, 2)}
    assert sorted(r.seq for r in maintenance.tracked(df, "name", ["seq"], 1).collect()) == [1, 3]
    assert maintenance.tracked(df, "name", ["seq"], None).count() == 5
    pairs = spark.createDataFrame([(1, 4), (None, 4), (0, 0), (None, None)], "hits long, total long")
    assert [r[0] for r in pairs.select(scoring.rate(F.col("hits"), F.col("total"))).collect()] == [0.25, 0.0, 0.0, 0.0]
    p = maintenance.Policy()
    assert (p.records, p.record_ttl_ms, p.frequency_values, p.agreement_names, p.velocity_keys, p.block) == (10**6, None, 10**6, 1024, 10**6, 1024)


def test_evaluation(spark):
    out = spark.createDataFrame([("1", "x"), ("2", "y"), ("3", "x"), ("4", "x"), ("5", "z")], "id string, visitor_id string")
    truth = spark.createDataFrame([(1, "d1", 1), (2, "d2", 2), (3, "d1", 3), (4, "d2", 4), (5, "d1", 5)], "id long, device string, ts long")
    r = replay.evaluate(out, truth).first()
    assert (r.observations, r.revisits, r.stable, r.collisions, r.minted) == (5, 3, 1, 1, 3)
    assert replay.evaluate(out.where("false"), truth).first().stability_rate == 1.0
    order = [r.place for r in replay.rounds(truth, "device", "ts").orderBy("place").select("place").collect()]
    assert order == [(0, "d1"), (0, "d2"), (1, "d1"), (1, "d2"), (2, "d1")]
