"""Queries of the corpus operators and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.cleaning import checkins, day_text, identifier, stripped
from ..functions.lineage import cut
from ..functions.net import canonical_ip
from ..plans.sql import ADDRESSES
from ..sources import table
from .distinct import Registers, estimates, merge_sketches, overlaps, sketches
from .garbled import restore
from .mixing import mixture, shares
from .neardup import near_duplicates
from .setjoin import link_counts, similar_pairs
from .tokenize import encode

REGISTERS = Registers(m=4096, base=1.08)
COUNTED = ["visitors", "accounts"]


def _day_ip(spark: SparkSession, folder: str) -> DataFrame:
    events = checkins(table(spark, folder, "checkin_events")).withColumn("ip", canonical_ip("ip"))
    return sketches(events, ["day", "ip"], ["visitor", "account"], REGISTERS)


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    """Days and addresses with at least 100 distinct visitors or accounts."""
    counts = estimates(_day_ip(spark, folder).where("ip is not null"), COUNTED, REGISTERS)
    each = F.explode(F.filter(F.array(*[F.when(F.col(c) >= 100, F.lit(c)) for c in COUNTED]), lambda x: x.isNotNull()))
    return counts.where("visitors >= 100 or accounts >= 100").select(day_text("day").alias("utc_day"), "ip", each.alias("counted"))


def p3_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Estimated counts with standard errors per day, per address and per day and address, all from the finest sketches."""
    finest = cut(_day_ip(spark, folder))
    none = F.lit(None)
    by_day = merge_sketches(finest, ["day"]).select("day", none.cast("string").alias("ip"), "sketch")
    known = finest.where("ip is not null")
    by_ip = merge_sketches(known, ["ip"]).select(none.cast("int").alias("day"), "ip", "sketch")
    levels = [x.select(F.lit(level).alias("level"), "day", "ip", "sketch") for level, x in (("day", by_day), ("ip", by_ip), ("day_ip", known))]
    counts = estimates(levels[0].unionByName(levels[1]).unionByName(levels[2]), COUNTED, REGISTERS)
    return counts.select("level", day_text("day").alias("utc_day"), "ip", *[c for n in COUNTED for c in (n, f"{n}_error")])


def p3_overlap(spark: SparkSession, folder: str) -> DataFrame:
    """Visitors and accounts that two days up to a week apart have in common."""
    days = cut(merge_sketches(_day_ip(spark, folder), ["day"]))
    later = days.select("day", F.col("sketch").alias("b")).withColumn("apart", F.explode(F.sequence(F.lit(1), F.lit(7))))
    later = later.select((F.col("day") - F.col("apart")).alias("day"), "apart", "b")
    pairs = days.withColumnRenamed("sketch", "a").join(later, "day").select("day", "apart", "a", "b")
    each = [overlaps(pairs, "a", "b", i, REGISTERS).withColumn("counted", F.lit(n)) for i, n in enumerate(COUNTED)]
    return each[0].unionByName(each[1]).withColumn("day", day_text("day")).withColumnRenamed("day", "utc_day")


def templates(spark: SparkSession, folder: str) -> DataFrame:
    """``(visitor_id, components)`` of the row with the greatest ``last_seen`` of each visitor (of equal ones, the greatest text)."""
    raw = table(spark, folder, "templates").where("visitor_id is not null")
    last = F.max_by("components", F.struct("last_seen", "components"))
    return raw.groupBy("visitor_id").agg(last.alias("components"))


def fonts_of(components: str) -> F.Column:
    """The strings in a template's font list, plain or wrapped; null when there is no readable list."""
    v = F.try_parse_json(F.col(components))
    fonts = lambda path: F.try_variant_get(v, path, "array<variant>")
    texts = F.filter(F.coalesce(fonts("$.fonts"), fonts("$.fonts.value")), lambda x: F.schema_of_variant(x) == "STRING")
    return F.transform(texts, lambda x: F.variant_get(x, "$", "string"))


def _fonts(spark: SparkSession, folder: str) -> DataFrame:
    """``(key, fonts)`` of observations and templates, fonts trimmed and lower-cased."""
    seen = table(spark, folder, "synthetic_observations").select(F.concat(F.lit("obs:"), F.col("obs_id").cast("string")).alias("key"), "fonts")
    known = templates(spark, folder).select(F.concat(F.lit("tpl:"), F.col("visitor_id")).alias("key"), fonts_of("components").alias("fonts"))
    clean = F.filter(F.transform("fonts", identifier), lambda x: x.isNotNull())
    return seen.unionByName(known).withColumn("fonts", clean)


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs of observations and templates whose font sets overlap by 0.8 or more."""
    return similar_pairs(_fonts(spark, folder), "key", "fonts", 4, 5)


def p4_links(spark: SparkSession, folder: str) -> DataFrame:
    """For each observation and template with fonts, the first one with the same fonts and the number of similar others."""
    return link_counts(_fonts(spark, folder), "key", "fonts", 4, 5)


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    """Groups of near-duplicate user agents and of near-duplicate templates."""
    agent = F.col("user_agent")
    seen = table(spark, folder, "synthetic_observations").where(F.length(stripped(agent)) >= 60)
    seen = seen.select(F.lit("observation").alias("kind"), F.col("obs_id").cast("string").alias("id"), agent.alias("text"))
    known = templates(spark, folder).where(F.length("components") >= 400)
    known = known.select(F.lit("template").alias("kind"), F.col("visitor_id").alias("id"), F.col("components").alias("text"))
    return near_duplicates(seen.unionByName(known), "kind", "id", "text", 7, 10)


def p7_ids(spark: SparkSession, folder: str) -> DataFrame:
    """Each document's token ids."""
    return encode(table(spark, folder, "documents"), "text", ["doc_id"])


def _mixture(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    docs = table(spark, folder, "documents").select("doc_id", identifier("source").alias("source"), "text")
    counted = cut(encode(docs, "text", ["doc_id", "source"], counts_only=True).withColumnRenamed("ids", "tokens"))
    targets = table(spark, folder, "mix_targets").withColumn("source", identifier("source"))
    return mixture(counted, targets)


def p8_mix(spark: SparkSession, folder: str) -> DataFrame:
    """The documents of each mix and how often each is used."""
    return _mixture(spark, folder)[0]


def p8_shares(spark: SparkSession, folder: str) -> DataFrame:
    """Wanted and reached shares of each source in each mix."""
    return shares(*_mixture(spark, folder))


def p9_restored(spark: SparkSession, folder: str) -> DataFrame:
    """Garbled documents with the chain of encodings and the original text where it can be had."""
    return restore(table(spark, folder, "documents"), "doc_id", "text").withColumnRenamed("key", "doc_id")


def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    """Documents that were decoded with a wrong character encoding."""
    return p9_restored(spark, folder).select("doc_id")


QUERIES = {
    "p3_found": p3_found, "p3_counts": p3_counts, "p3_overlap": p3_overlap, "p4_found": p4_found, "p4_links": p4_links, "p6_found": p6_found, "p7_ids": p7_ids, "p8_mix": p8_mix, "p8_shares": p8_shares,
    "p9_found": p9_found, "p9_restored": p9_restored,
}

_FOUND3 = f"""
WITH {ADDRESSES},
e AS (
  SELECT strftime(make_timestamp(CASE WHEN ts >= 100000000000 THEN ts ELSE ts * 1000 END * 1000), '%Y-%m-%d') AS utc_day, canon AS ip,
    nullif(lower(trim(visitor_id)), '') AS visitor, nullif(account_id, '') AS account
  FROM checkin_events JOIN ipc ON ip = raw WHERE ts > 0
),
g AS (SELECT utc_day, ip, count(DISTINCT visitor) AS v, count(DISTINCT account) AS a FROM e GROUP BY utc_day, ip)
SELECT utc_day, ip, 'visitors' AS counted FROM g WHERE v >= 100 UNION ALL SELECT utc_day, ip, 'accounts' FROM g WHERE a >= 100"""

_TEMPLATES = """
t AS (SELECT visitor_id, arg_max(components, last_seen) AS components FROM templates WHERE visitor_id IS NOT NULL GROUP BY visitor_id)"""
_PAIRS4 = f"""
WITH {_TEMPLATES},
j AS (SELECT visitor_id, CASE WHEN json_valid(components) THEN components::JSON END AS c FROM t),
f AS (SELECT visitor_id, CASE WHEN json_type(c->'fonts') = 'ARRAY' THEN c->'fonts' WHEN json_type(c->'fonts'->'value') = 'ARRAY' THEN c->'fonts'->'value' END AS l FROM j),
raw AS (
  SELECT 'obs:' || obs_id AS key, unnest(fonts) AS x FROM synthetic_observations
  UNION ALL
  SELECT 'tpl:' || visitor_id, e->>'$' FROM (SELECT visitor_id, unnest(CAST(l AS JSON[])) AS e FROM f WHERE l IS NOT NULL) WHERE json_type(e) = 'VARCHAR'
),
item AS (SELECT DISTINCT key, lower(trim(x)) AS x FROM raw WHERE trim(x) <> ''),
n AS (SELECT key, count(*) AS n FROM item GROUP BY key),
both_ AS (SELECT a.key AS k, b.key AS l, count(*) AS c FROM item a JOIN item b ON a.x = b.x AND a.key < b.key GROUP BY a.key, b.key)
SELECT k AS left_key, l AS right_key FROM both_ JOIN n p ON p.key = k JOIN n q ON q.key = l WHERE c * 5 >= (p.n + q.n - c) * 4"""
_LINKS4 = (
    _PAIRS4[: _PAIRS4.rindex("SELECT k AS")].rstrip()
    + """,
pairs AS (SELECT k, l FROM both_ JOIN n p ON p.key = k JOIN n q ON q.key = l WHERE c * 5 >= (p.n + q.n - c) * 4),
ends AS (SELECT k AS key FROM pairs UNION ALL SELECT l FROM pairs), deg AS (SELECT key, count(*) AS links FROM ends GROUP BY key),
cls AS (SELECT key, string_agg(x, chr(31) ORDER BY x) AS s FROM item GROUP BY key)
SELECT key, min(key) OVER (PARTITION BY s) AS class_key, coalesce(links, 0) AS links FROM cls LEFT JOIN deg USING (key)"""
)
_GROUPS6 = f"""
WITH RECURSIVE {_TEMPLATES},
txt AS (
  SELECT DISTINCT 'observation' AS kind, CAST(obs_id AS VARCHAR) AS id, user_agent AS x FROM synthetic_observations WHERE length(trim(user_agent)) >= 60
  UNION ALL
  SELECT 'template', visitor_id, components FROM t WHERE length(components) >= 400
),
word AS (SELECT DISTINCT kind, id, unnest(regexp_extract_all(lower(x), '[a-z0-9]+')) AS w FROM txt),
n AS (SELECT kind, id, count(*) AS n FROM word GROUP BY kind, id),
c AS (SELECT a.kind, a.id AS i, b.id AS j, count(*) AS c FROM word a JOIN word b ON a.kind = b.kind AND a.w = b.w AND a.id <> b.id GROUP BY a.kind, a.id, b.id),
link AS (SELECT c.kind, i, j FROM c JOIN n p ON p.kind = c.kind AND p.id = i JOIN n q ON q.kind = c.kind AND q.id = j WHERE c * 10 >= (p.n + q.n - c) * 7),
reach AS (SELECT kind, i, j FROM link UNION SELECT r.kind, r.i, l.j FROM reach r JOIN link l ON l.kind = r.kind AND l.i = r.j)
SELECT kind, min(j) AS leader_id, i AS member_id FROM reach GROUP BY kind, i HAVING min(j) < i"""

ORACLES = {"p3_found": _FOUND3, "p4_found": _PAIRS4, "p4_links": _LINKS4, "p6_found": _GROUPS6}
