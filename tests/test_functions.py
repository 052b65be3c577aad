"""Reading rules: times, identifiers, addresses."""

import ipaddress

from pyspark.sql import functions as F

from fathomry.functions.cleaning import checkins, identifier
from fathomry.functions.net import canonical_ip, ipv4_number


def wanted(s):
    """An independent reading of the address rules."""
    s = s.strip(" \t\n\r\f\x0b").lower() if s is not None else ""
    if "%" in s or "/" in s:
        return None
    try:
        a = ipaddress.ip_address(s)
    except ValueError:
        if ":" not in s:
            return None
        try:
            a = ipaddress.ip_address(":".join(g.lstrip("0") or ("0" if g else "") for g in s.split(":")))
        except ValueError:
            return None
    if a.version == 6 and a.ipv4_mapped:
        a = a.ipv4_mapped
    return str(a)


CASES = [
    "1.2.3.4", " 203.0.113.77", "::ffff:203.0.113.77", "::FFFF:10.0.0.1", "2001:DB8:1:0:0:0:0:1", "2001:db8:0001::00a1", "::", "::1",
    "1::", "1:0:0:2:0:0:0:3", "1:0:0:2:0:0:3:4", "1:2:3:4:5:6:7:8", "1:2:3:4:5:6:7::", "0:2:3:4:5:6:7:8", "::ffff:0102:0304",
    "256.1.1.1", "1.2.3", "01.2.3.4", "unknown", "", " ", None, "1:2:3", "1:::2", ":1::2", "12345::", "g::1", "1::2::3", "1:2:3:4:5:6:7:8:9",
    "64:ff9b::1.2.3.4", "1:2:3:4:5:6:1.2.3.4", "::1.2.3.256", "1:2:3:4:5:6:7:1.2.3.4", "a.b.c.d", "0000:0000:0000:0000:0000:ffff:7f00:0001",
]


def test_canonical_ip(spark):
    df = spark.createDataFrame([(i, c) for i, c in enumerate(CASES)], "i int, s string")
    got = {r.i: r.c for r in df.select("i", canonical_ip("s").alias("c")).collect()}
    assert {CASES[i]: got[i] for i in got} == {c: wanted(c) for c in CASES}


def test_ipv4_number(spark):
    df = spark.createDataFrame([("0.0.0.0",), ("255.255.255.255",), ("1.2.3.4",), ("x",), (None,)], "s string")
    assert [r.n for r in df.select(ipv4_number("s").alias("n")).collect()] == [0, 2**32 - 1, 0x01020304, None, None]


def test_checkins_and_identifiers(spark):
    rows = [(1, "a", " ABC\t", "x", 1_756_684_800_000), (2, "", "", None, 1_756_684_800), (3, None, None, "", 0), (4, "b", "v", "", None), (5, "b", "v", "", -5)]
    df = spark.createDataFrame(rows, "event_id long, account_id string, visitor_id string, ip string, ts long").withColumn("day", F.lit("clash"))
    got = {r.event_id: (r.account, r.visitor, r.ms, r.day) for r in checkins(df).collect()}
    assert got == {1: ("a", "abc", 1_756_684_800_000, 20332), 2: (None, None, 1_756_684_800_000, 20332)}
    assert df.select(identifier("visitor_id").alias("v")).where("v is null").count() == 2
