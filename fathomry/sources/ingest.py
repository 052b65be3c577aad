"""Reading requests and fixtures, writing tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.hashing import signature


def valid_objects(df: DataFrame, text: str, allowed: list[str], required: list[str] = ()) -> DataFrame:
    """``df`` with ``problem``: null for JSON objects that have only ``allowed`` members and all ``required`` ones."""
    kinds = F.from_json(F.col(text), "map<string,string>")
    v = F.try_parse_json(F.col(text))
    extra = F.size(F.array_except(F.map_keys(kinds), F.array(*[F.lit(a) for a in allowed]))) > 0
    missing = F.size(F.array_except(F.array(*[F.lit(r) for r in required]).cast("array<string>"), F.map_keys(kinds))) > 0
    shape = ~F.coalesce(F.schema_of_variant(v).startswith("OBJECT"), F.lit(False))
    return df.withColumn("problem", F.when(v.isNull(), "unreadable").when(shape, "no object").when(extra, "unknown member").when(missing, "missing member"))


def checkin_requests(df: DataFrame, text: str, ip: str, ts: str) -> DataFrame:
    """Check-ins ``(account_id, visitor_id, ip, ts)`` of valid request bodies; address and time come from outside the body."""
    ok = valid_objects(df, text, ["accountId", "action", "identify"], ["accountId", "action", "identify"]).where("problem is null")
    v = F.try_parse_json(F.col(text))
    get = lambda path: F.try_variant_get(v, path, "string")
    rows = ok.select(get("$.accountId").alias("account_id"), get("$.action").alias("action"), get("$.identify.visitorId").alias("visitor_id"), F.col(ip).alias("ip"), F.col(ts).alias("ts"))
    return rows.where("account_id != '' and action = 'daily_checkin'").drop("action")


def claimed_agent(text):
    """The user agent that an observation claims: the first string among three names."""
    v = F.try_parse_json(text)
    string = lambda n: F.when(F.schema_of_variant(F.try_variant_get(v, f"$.{n}", "variant")) == "STRING", F.try_variant_get(v, f"$.{n}", "string"))
    return F.coalesce(*[string(n) for n in ("userAgent", "user_agent", "ua")])


def fixture(spark: SparkSession, path: str) -> DataFrame:
    """``(device, visit, components)`` of a labelled fixture file; components as JSON text."""
    raw = spark.read.text(path, wholetext=True).select(F.parse_json("value").alias("v"))
    devices = raw.select(F.posexplode(F.variant_get("v", "$.devices", "array<variant>")).alias("place", "d"))
    visits = devices.select("place", F.variant_get("d", "$.deviceId", "string").alias("device"), F.posexplode(F.variant_get("d", "$.observations", "array<variant>")).alias("visit", "o"))
    return visits.select("place", "device", "visit", F.to_json("o").alias("components"))


def signed(df: DataFrame, key: bytes, issued_ms: str, columns: list[str]) -> DataFrame:
    """``(body, timestamp, signature)``: each row as JSON text, serialised once, with its time of issue and signature over both."""
    rows = df.select(F.to_json(F.struct(*columns)).alias("body"), F.col(issued_ms).cast("bigint").alias("timestamp"))
    return rows.withColumn("signature", signature(key, "timestamp", "body"))


#: How the tables lie: columns of their folders, or key and number of their buckets (in place of an index).
LAYOUT = {"checkin_events": {"folders": ["utc_day"]}, "blocking_index": {"buckets": (64, "key")}, "templates": {"buckets": (64, "visitor_id")}, "records": {"folders": []}}


def lay_out(df: DataFrame, name: str, path: str) -> None:
    """Writes the managed table ``name`` as ``LAYOUT`` says; bucketed tables join on their key without a shuffle."""
    w = df.write.mode("overwrite").option("path", path).format("parquet")
    how = LAYOUT[name]
    if "buckets" in how:
        n, key = how["buckets"]
        w = w.bucketBy(n, key).sortBy(key)
    elif how["folders"]:
        w = w.partitionBy(*how["folders"])
    w.saveAsTable(name)


def append(df: DataFrame, path: str, by: list[str] = ()) -> None:
    """Appends rows to a Parquet table, partitioned by ``by``."""
    df.write.mode("append").partitionBy(*by).parquet(path)


def upserted(old: DataFrame, new: DataFrame, key: list[str], order: str) -> DataFrame:
    """A table after an upsert: of each key the row with the greatest ``order`` (new rows win ties)."""
    rest = [c for c in old.columns if c not in key]
    both = old.withColumn("__new", F.lit(0)).unionByName(new.withColumn("__new", F.lit(1)))
    last = F.max_by(F.struct(*rest), F.struct(order, "__new"))
    return both.groupBy(*key).agg(last.alias("r")).select(*key, "r.*")
