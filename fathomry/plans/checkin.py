"""Queries over the check-in log: trailing windows, latest rows, bursts, addresses."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.cleaning import checkins
from ..functions.net import canonical_ip
from ..operators import signals, trailing
from ..sources import table
from .sql import ADDRESSES

HOUR, DAY = 3_600_000, 86_400_000


def log(spark: SparkSession, folder: str) -> DataFrame:
    """Check-ins, each delivered event once (events without id as they are)."""
    raw = checkins(table(spark, folder, "checkin_events")).drop("day").withColumnRenamed("ms", "ts")
    some = raw.where("event_id is not null").groupBy("event_id").agg(*[F.max(c).alias(c) for c in ("account", "visitor", "ip", "ts")])
    return some.unionByName(raw.where("event_id is null").select(*some.columns))


def addressed(spark: SparkSession, folder: str) -> DataFrame:
    return log(spark, folder).withColumn("ip", canonical_ip("ip"))


def fanout_per_event(spark: SparkSession, folder: str) -> DataFrame:
    """Accounts that a visitor's device checked in for within a day and a week, at each of its times."""
    return trailing.trailing_distinct(log(spark, folder), "visitor", "account", "ts", {"h24": DAY, "d7": 7 * DAY})


def devices_per_event(spark: SparkSession, folder: str) -> DataFrame:
    """Devices that an account used within a week and a month, at each of its times."""
    return trailing.trailing_distinct(log(spark, folder), "account", "visitor", "ts", {"d7": 7 * DAY, "d30": 30 * DAY})


def ip_accounts_per_event(spark: SparkSession, folder: str) -> DataFrame:
    """Accounts behind an address within an hour and a day, at each of its times."""
    return trailing.trailing_distinct(addressed(spark, folder), "ip", "account", "ts", {"h1": HOUR, "h24": DAY})


def rolling_members(spark: SparkSession, folder: str) -> DataFrame:
    """Accounts alive at a visitor's device when each keeps its place for an hour (the end excluded)."""
    return trailing.trailing_distinct(log(spark, folder), "visitor", "account", "ts", {"live": HOUR}, closed=False)


def rolling_scopes(spark: SparkSession, folder: str) -> DataFrame:
    """Members alive for an hour in three scopes of one log: visitors new at an address, accounts of a visitor, accounts behind an address."""
    rows = addressed(spark, folder)
    every = trailing.scoped(("nv", rows, "ip", "visitor", "ts"), ("v", rows, "visitor", "account", "ts"), ("ip", rows, "ip", "account", "ts"))
    return trailing.trailing_distinct(every, "key", "member", "ts", {"live": HOUR}, closed=False)


def _asof(spark: SparkSession, folder: str, key: str, member: str, windows: dict[str, int]) -> DataFrame:
    rows = log(spark, folder)
    at = rows.where(F.col(key).isNotNull()).withColumn("now", rows.select(F.max("ts")).scalar())
    counts = [F.count_distinct(F.when(F.col("ts") >= F.col("now") - w, F.col(member))).alias(n) for n, w in windows.items()]
    return at.groupBy(key).agg(*counts)


def fanout_asof(spark: SparkSession, folder: str) -> DataFrame:
    """Accounts of each visitor's device within a day and a week before the log's end."""
    return _asof(spark, folder, "visitor", "account", {"h24": DAY, "d7": 7 * DAY})


def device_count_asof(spark: SparkSession, folder: str) -> DataFrame:
    """Devices of each account within a week and a month before the log's end."""
    return _asof(spark, folder, "account", "visitor", {"d7": 7 * DAY, "d30": 30 * DAY})


def new_device_rate(spark: SparkSession, folder: str) -> DataFrame:
    """Distinct devices among each account's last 20 check-ins."""
    rows = log(spark, folder).where("visitor is not null")
    return trailing.churn(rows, "account", "visitor", ["ts", "event_id"], 20).withColumn("rate", F.round("rate", 6))


def regularity(spark: SparkSession, folder: str) -> DataFrame:
    """How even the gaps between each account's last ten check-ins are."""
    out = trailing.regularity(log(spark, folder), "account", "ts", ["ts", "event_id"], 10)
    return out.withColumn("regularity", F.round("regularity", 6))


def minute_burst(spark: SparkSession, folder: str) -> DataFrame:
    """Check-ins of each visitor in each minute."""
    return trailing.bursts(log(spark, folder), "visitor", "ts")


def minute_burst_ip(spark: SparkSession, folder: str) -> DataFrame:
    """Check-ins from each address in each minute."""
    return trailing.bursts(addressed(spark, folder), "ip", "ts")


def velocity_ip_band(spark: SparkSession, folder: str) -> DataFrame:
    """First check-ins of visitors from each address in the hour before each of them, with the band of their number."""
    first = addressed(spark, folder).where("visitor is not null").groupBy("visitor").agg(F.min(F.struct("ts", "ip")).alias("f"))
    seconds = first.select("f.ip", F.floor(F.col("f.ts") / 1000).alias("ts"))
    n = trailing.trailing_count(seconds, "ip", "ts", trailing.RATE_WINDOW_S)
    return n.withColumn("band", trailing.band(F.col("n"), *trailing.IP_BAND))


def address_risk(spark: SparkSession, folder: str) -> DataFrame:
    """Risk band of every address of the log by hosting networks."""
    known = addressed(spark, folder).where("ip is not null").select("ip").distinct()
    return known.withColumn("risk", signals.address_risk("ip", [*signals.HOSTING_BLOCKS, ("203.0.113.0", 24)]))


def retention(spark: SparkSession, folder: str) -> DataFrame:
    """Check-ins by whether a retention of 30 days before the log's end keeps them."""
    rows = log(spark, folder)
    now = rows.agg(F.max("ts")).first()[0] or 0
    kept = trailing.purge(rows, "ts", now - 30 * DAY)
    return kept.agg(F.count("*").alias("kept")).select("kept", (rows.select(F.count("*")).scalar() - F.col("kept")).alias("purged"))


def profile(spark: SparkSession, folder: str) -> DataFrame:
    """Each account's last check-in with all counts as they stood then: devices, accounts, churn, regularity, bursts."""
    rows = addressed(spark, folder).where("account is not null")
    last = rows.groupBy("account").agg(F.max_by(F.struct("visitor", "ip", "ts"), F.struct("ts", "event_id")).alias("l")).select("account", "l.*")
    every = addressed(spark, folder)
    minute = lambda c: (F.col(c) - F.pmod(F.col(c), F.lit(60_000))).alias("bucket")
    asked = last.select("account", "visitor", "ip", "ts", minute("ts"))

    def burst(key: str, name: str) -> DataFrame:
        in_minute = every.select(key, F.col("ts").alias("at"), minute("ts")).join(asked.where(F.col(key).isNotNull()).select(key, "bucket", "ts").distinct(), [key, "bucket"])
        return in_minute.where("at <= ts").groupBy(key, "ts").agg(F.count("*").alias(name))

    device = trailing.trailing_distinct(every, "visitor", "account", "ts", {"fanout_h24": DAY, "fanout_d7": 7 * DAY})
    at_last = every.select("account", F.col("ts").alias("at"), F.col("visitor").alias("seen")).join(asked.select("account", "ts"), "account")
    within = lambda days: F.count_distinct(F.when(F.col("at") >= F.col("ts") - days * DAY, F.col("seen")))
    own = at_last.groupBy("account").agg(within(7).alias("devices_d7"), within(30).alias("devices_d30"))
    behind = trailing.trailing_distinct(every, "ip", "account", "ts", {"ip_h1": HOUR, "ip_h24": DAY})
    known = every.where("visitor is not null")
    churned = trailing.churn(known, "account", "visitor", ["ts", "event_id"]).select("account", F.round("rate", 6).alias("rate"))
    even = trailing.regularity(every, "account", "ts", ["ts", "event_id"]).select("account", F.round("regularity", 6).alias("regularity"))
    out = asked.join(device, ["visitor", "ts"], "left").join(own, "account", "left").join(behind, ["ip", "ts"], "left")
    out = out.join(burst("visitor", "burst_visitor"), ["visitor", "ts"], "left").join(burst("ip", "burst_ip"), ["ip", "ts"], "left")
    out = out.join(churned, "account", "left").join(even, "account", "left").fillna(0)
    names = ["fanout_h24", "fanout_d7", "devices_d7", "devices_d30", "ip_h1", "ip_h24", "rate", "regularity", "burst_visitor", "burst_ip"]
    return out.select("account", "visitor", "ip", "ts", *names)


QUERIES = {
    "checkin_profile": profile,
    "checkin_fanout_per_event": fanout_per_event, "checkin_devices_per_event": devices_per_event, "checkin_ip_accounts_per_event": ip_accounts_per_event,
    "rolling_members": rolling_members, "rolling_scopes": rolling_scopes, "checkin_fanout_asof": fanout_asof, "checkin_device_count_asof": device_count_asof,
    "checkin_new_device_rate": new_device_rate, "checkin_regularity": regularity, "checkin_minute_burst": minute_burst,
    "checkin_minute_burst_ip": minute_burst_ip, "velocity_ip_band": velocity_ip_band, "ip_risk_cidr": address_risk, "retention_purge": retention,
}

_LOG = """
ev AS (
  SELECT event_id, max(nullif(account_id, '')) AS account, max(nullif(lower(trim(visitor_id)), '')) AS visitor, max(ip) AS raw,
    max(CASE WHEN ts >= 100000000000 THEN ts ELSE ts * 1000 END) AS ts
  FROM checkin_events WHERE ts > 0 GROUP BY event_id
)"""
_ADDR = f"{_LOG}, {ADDRESSES}, ea AS (SELECT ev.*, canon AS ip FROM ev LEFT JOIN ipc USING (raw))"


def _per_event(source: str, with_: str, key: str, member: str, windows: dict[str, int], closed: bool = True) -> str:
    at = f"SELECT {key}, {member}, ts FROM {source} WHERE {key} IS NOT NULL AND {member} IS NOT NULL"
    cols = ", ".join(f"count(DISTINCT {member}) OVER (PARTITION BY {key} ORDER BY ts RANGE BETWEEN {w if closed else w - 1} PRECEDING AND CURRENT ROW) AS {n}" for n, w in windows.items())
    return f"WITH {with_}, x AS ({at}) SELECT DISTINCT {key}, ts, {', '.join(windows)} FROM (SELECT {key}, ts, {cols} FROM x)"


def _at_end(key: str, member: str, windows: dict[str, int]) -> str:
    cols = ", ".join(f"count(DISTINCT {member}) FILTER (ts >= (SELECT max(ts) FROM ev) - {w}) AS {n}" for n, w in windows.items())
    return f"WITH {_LOG} SELECT {key}, {cols} FROM ev WHERE {key} IS NOT NULL GROUP BY {key}"


_OWN = " OR ".join(f"(n >> {32 - p}) = ({sum(int(x) << 24 - 8 * i for i, x in enumerate(a.split('.')))} >> {32 - p})" for a, p in signals.OWN_BLOCKS)
_HOSTED = " OR ".join(
    f"(n >> {32 - p}) = ({sum(int(x) << 24 - 8 * i for i, x in enumerate(a.split('.')))} >> {32 - p})" for a, p in [*signals.HOSTING_BLOCKS, ("203.0.113.0", 24)]
)
def _counted(key: str, member: str, window: int) -> str:
    """Distinct members of the last row's key in the window before it; 0 without key."""
    return f"(SELECT count(DISTINCT e.{member}) FROM ea e WHERE e.{key} = l.{key} AND e.ts BETWEEN l.ts - {window} AND l.ts)"


ORACLES = {
    "checkin_profile": f"""WITH {_ADDR}, l AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY account ORDER BY ts DESC, event_id DESC) AS k FROM ea WHERE account IS NOT NULL) WHERE k = 1),
        r AS (SELECT account, ts, visitor, row_number() OVER (PARTITION BY account ORDER BY ts DESC, event_id DESC) AS k,
          row_number() OVER (PARTITION BY account, visitor IS NULL ORDER BY ts DESC, event_id DESC) AS kv FROM ea WHERE account IS NOT NULL),
        c AS (SELECT account, round(count(DISTINCT visitor) / count(*), 6) AS rate FROM r WHERE visitor IS NOT NULL AND kv <= 20 GROUP BY account),
        g AS (SELECT account, ts - lag(ts) OVER (PARTITION BY account ORDER BY ts, k DESC) AS g FROM r WHERE k <= 10),
        e AS (SELECT account, round(CASE WHEN count(g) < 2 THEN 0 WHEN avg(g) = 0 THEN 1 ELSE 1 / (1 + stddev_pop(g) / avg(g)) END, 6) AS regularity FROM g GROUP BY account)
        SELECT l.account, l.visitor, l.ip, l.ts,
          CASE WHEN l.visitor IS NULL THEN 0 ELSE {_counted('visitor', 'account', DAY)} END AS fanout_h24, CASE WHEN l.visitor IS NULL THEN 0 ELSE {_counted('visitor', 'account', 7 * DAY)} END AS fanout_d7,
          {_counted('account', 'visitor', 7 * DAY)} AS devices_d7, {_counted('account', 'visitor', 30 * DAY)} AS devices_d30,
          {_counted('ip', 'account', HOUR)} AS ip_h1, {_counted('ip', 'account', DAY)} AS ip_h24, coalesce(rate, 0) AS rate, regularity,
          (SELECT count(*) FROM ea e WHERE e.visitor = l.visitor AND e.ts BETWEEN l.ts - l.ts % 60000 AND l.ts) AS burst_visitor,
          (SELECT count(*) FROM ea e WHERE e.ip = l.ip AND e.ts BETWEEN l.ts - l.ts % 60000 AND l.ts) AS burst_ip
        FROM l LEFT JOIN c USING (account) LEFT JOIN e USING (account)""",
    "checkin_fanout_per_event": _per_event("ev", _LOG, "visitor", "account", {"h24": DAY, "d7": 7 * DAY}),
    "checkin_devices_per_event": _per_event("ev", _LOG, "account", "visitor", {"d7": 7 * DAY, "d30": 30 * DAY}),
    "checkin_ip_accounts_per_event": _per_event("ea", _ADDR, "ip", "account", {"h1": HOUR, "h24": DAY}),
    "rolling_members": _per_event("ev", _LOG, "visitor", "account", {"live": HOUR}, closed=False),
    "rolling_scopes": _per_event("sc", f"""{_ADDR}, sc AS (SELECT 'nv:' || ip AS key, visitor AS member, ts FROM ea UNION ALL SELECT 'v:' || visitor, account, ts FROM ea
        UNION ALL SELECT 'ip:' || ip, account, ts FROM ea)""", "key", "member", {"live": HOUR}, closed=False),
    "checkin_fanout_asof": _at_end("visitor", "account", {"h24": DAY, "d7": 7 * DAY}),
    "checkin_device_count_asof": _at_end("account", "visitor", {"d7": 7 * DAY, "d30": 30 * DAY}),
    "checkin_new_device_rate": f"""WITH {_LOG}, r AS (SELECT *, row_number() OVER (PARTITION BY account ORDER BY ts DESC, event_id DESC) AS k FROM ev
        WHERE account IS NOT NULL AND visitor IS NOT NULL)
        SELECT account, count(*) AS sampled, count(DISTINCT visitor) AS members, round(count(DISTINCT visitor) / count(*), 6) AS rate FROM r WHERE k <= 20 GROUP BY account""",
    "checkin_regularity": f"""WITH {_LOG}, r AS (SELECT account, ts, row_number() OVER (PARTITION BY account ORDER BY ts DESC, event_id DESC) AS k FROM ev WHERE account IS NOT NULL),
        g AS (SELECT account, ts - lag(ts) OVER (PARTITION BY account ORDER BY ts, k DESC) AS g FROM r WHERE k <= 10)
        SELECT account, CAST(count(g) AS INT) AS gaps, round(CASE WHEN count(g) < 2 THEN 0 WHEN avg(g) = 0 THEN 1 ELSE 1 / (1 + stddev_pop(g) / avg(g)) END, 6) AS regularity
        FROM g GROUP BY account""",
    "checkin_minute_burst": f"WITH {_LOG} SELECT visitor, ts - ts % 60000 AS bucket, count(*) AS n FROM ev WHERE visitor IS NOT NULL GROUP BY 1, 2",
    "checkin_minute_burst_ip": f"WITH {_ADDR} SELECT ip, ts - ts % 60000 AS bucket, count(*) AS n FROM ea WHERE ip IS NOT NULL GROUP BY 1, 2",
    "velocity_ip_band": f"""WITH {_ADDR}, f AS (SELECT visitor, min(ts) AS ts, arg_min(coalesce(ip, ''), (ts, coalesce(ip, ''))) AS ip FROM ea WHERE visitor IS NOT NULL GROUP BY visitor),
        s AS (SELECT ip, ts // 1000 AS ts FROM f WHERE ip <> ''),
        c AS (SELECT DISTINCT ip, ts, count(*) OVER (PARTITION BY ip ORDER BY ts RANGE BETWEEN 3600 PRECEDING AND CURRENT ROW) AS n FROM s)
        SELECT *, CASE WHEN n >= 20 THEN 'high' WHEN n >= 5 THEN 'medium' ELSE 'low' END AS band FROM c""",
    "ip_risk_cidr": f"""WITH {_ADDR}, a AS (SELECT DISTINCT ip FROM ea WHERE ip IS NOT NULL),
        q AS (SELECT ip, CASE WHEN NOT contains(ip, ':') THEN list_sum(list_transform(string_split(ip, '.'), lambda x, i: x::BIGINT << (32 - 8 * i)::INT))::BIGINT END AS n FROM a)
        SELECT ip, CASE WHEN n IS NOT NULL AND NOT ({_OWN}) AND ({_HOSTED}) THEN 'high' ELSE 'low' END AS risk FROM q""",
    "retention_purge": f"WITH {_LOG}, m AS (SELECT max(ts) - {30 * DAY} AS t FROM ev) SELECT count(*) FILTER (ts >= t) AS kept, count(*) FILTER (ts < t) AS purged FROM ev, m",
}
