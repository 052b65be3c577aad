"""Queries on check-in sessions, trailing totals and skewed keys (problems 1, 2 and 5)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.cleaning import checkins, day_text, identifier
from ..operators.fragment import distinct_per_key
from ..operators.rolling import rolling_totals
from ..operators.sessions import sessions
from ..sources import table

GAP_MS = 1_800_000
#: 2025-09-01 and 2025-10-30 as day numbers: the calendar of the check-in log.
FIRST_DAY, LAST_DAY = 20332, 20391


def p1_sessions(spark: SparkSession, folder: str) -> DataFrame:
    """All sessions of all visitors."""
    events = checkins(table(spark, folder, "checkin_events"))
    return sessions(events, "visitor", "ms", "event_id", GAP_MS).withColumnRenamed("entity", "visitor_id")


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    """Sessions of at least five check-ins."""
    return p1_sessions(spark, folder).where("events >= 5").select("visitor_id", "start_ms", "end_ms")


def _rolling(spark: SparkSession, folder: str, least_total: int = 0) -> DataFrame:
    events = checkins(table(spark, folder, "checkin_events"))
    return rolling_totals(events, "account", "day", "event_id", "visitor", FIRST_DAY, LAST_DAY, (7, 30), least_total)


def p2_rolling(spark: SparkSession, folder: str) -> DataFrame:
    """Trailing 7 and 30 days of each account and calendar day."""
    r = _rolling(spark, folder)
    return r.select(
        F.col("entity").alias("account_id"), day_text("day").alias("utc_day"), "events",
        "events_7", F.round("avg_7", 6).alias("avg_7"), F.col("members_7").alias("visitors_7"),
        "events_30", F.round("avg_30", 6).alias("avg_30"), F.col("members_30").alias("visitors_30"),
    )


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    """Account-days whose last week is at least three times as busy as their last month."""
    r = _rolling(spark, folder, least_total=20)  # no window of 7 days holds more than an account has
    busy = (F.col("events_7") >= 20) & (F.col("events_7") * 30 >= F.col("events_30") * 21) & (F.col("members_7") >= 4)
    return r.where(busy).select(F.col("entity").alias("account_id"), day_text("day").alias("utc_day"))


def p5_shares(spark: SparkSession, folder: str) -> DataFrame:
    """Distinct visitors of each key and their share of all distinct pairs."""
    raw = table(spark, folder, "blocking_index")
    pairs = raw.select(identifier("key").alias("key"), identifier("visitor_id").alias("visitor"))
    counts = distinct_per_key(pairs, "key", "visitor")
    total = counts.select(F.sum("members")).scalar()
    return counts.select("key", F.col("members").alias("visitors"), (F.col("members") / total).alias("share"))


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    """Keys with at least one percent of all distinct pairs."""
    return p5_shares(spark, folder).where("share >= 0.01").select("key")


QUERIES = {"p1_sessions": p1_sessions, "p1_found": p1_found, "p2_rolling": p2_rolling, "p2_found": p2_found, "p5_shares": p5_shares, "p5_found": p5_found}

_EVENTS = """
ev AS (
  SELECT DISTINCT event_id, nullif(account_id, '') AS account, nullif(lower(trim(visitor_id)), '') AS visitor,
         CASE WHEN ts >= 100000000000 THEN ts ELSE ts * 1000 END AS ms
  FROM checkin_events WHERE ts > 0
)"""
_SESSIONS = f"""
WITH {_EVENTS},
flagged AS (
  SELECT visitor, ms, CASE WHEN ms - lag(ms) OVER w <= {GAP_MS} THEN 0 ELSE 1 END AS opens
  FROM ev WHERE visitor IS NOT NULL WINDOW w AS (PARTITION BY visitor ORDER BY ms, event_id)
),
numbered AS (SELECT visitor, ms, sum(opens) OVER (PARTITION BY visitor ORDER BY ms ROWS UNBOUNDED PRECEDING) AS s FROM flagged),
numbered2 AS (SELECT visitor, ms, max(s) OVER (PARTITION BY visitor, ms) AS s FROM numbered),
sess AS (
  SELECT visitor AS visitor_id, min(ms) AS start_ms, max(ms) AS end_ms, max(ms) - min(ms) AS duration_ms, count(*) AS events
  FROM numbered2 GROUP BY visitor, s
)"""
_ROLLING = f"""
WITH {_EVENTS},
e AS (SELECT account, visitor, CAST(floor(ms / 86400000) AS INT) AS day FROM ev
      WHERE account IS NOT NULL AND floor(ms / 86400000) BETWEEN {FIRST_DAY} AND {LAST_DAY}),
cal AS (SELECT account, unnest(generate_series({FIRST_DAY}, {LAST_DAY})) AS day FROM (SELECT DISTINCT account FROM e)),
r AS (
  SELECT c.account AS account_id, strftime(DATE '1970-01-01' + CAST(c.day AS INT), '%Y-%m-%d') AS utc_day,
    count(*) FILTER (e.day = c.day) AS events,
    count(*) FILTER (e.day > c.day - 7) AS events_7,
    round(count(*) FILTER (e.day > c.day - 7) / 7.0, 6) AS avg_7,
    count(DISTINCT e.visitor) FILTER (e.day > c.day - 7) AS visitors_7,
    count(e.day) AS events_30, round(count(e.day) / 30.0, 6) AS avg_30, count(DISTINCT e.visitor) AS visitors_30
  FROM cal c LEFT JOIN e ON e.account = c.account AND e.day BETWEEN c.day - 29 AND c.day GROUP BY c.account, c.day
)"""
_SHARES = """
WITH p AS (
  SELECT DISTINCT nullif(lower(trim(key)), '') AS key, nullif(lower(trim(visitor_id)), '') AS v FROM blocking_index
),
s AS (SELECT key, count(*) AS visitors, count(*) / sum(count(*)) OVER () AS share
      FROM p WHERE key IS NOT NULL AND v IS NOT NULL GROUP BY key)"""
ORACLES = {
    "p1_sessions": _SESSIONS + " SELECT * FROM sess",
    "p1_found": _SESSIONS + " SELECT visitor_id, start_ms, end_ms FROM sess WHERE events >= 5",
    "p2_rolling": _ROLLING + " SELECT * FROM r",
    "p2_found": _ROLLING + " SELECT account_id, utc_day FROM r WHERE events_7 >= 20 AND events_7 * 30 >= events_30 * 21 AND visitors_7 >= 4",
    "p5_shares": _SHARES + " SELECT key, visitors, CAST(share AS DOUBLE) AS share FROM s",
    "p5_found": _SHARES + " SELECT key FROM s WHERE share >= 0.01",
}
