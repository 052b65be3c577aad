"""Components of an observation in canonical long form.

``(id, name, kind, cat, num, elems)``: one row for each component that is present and of the type its field wants. ``cat`` is
a salted hash, ``num`` a bigint, ``elems`` the sorted distinct salted hashes of a set's strings. What is missing, null or of
another type has no row, so that it can never be compared.
"""

from __future__ import annotations

import hashlib
import json
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .cleaning import _col
from .hashing import salted_hash

#: Fields with their kind and the prior probability that they agree on the same device.
FIELDS = {
    "webgl": ("category", 0.95),
    "platform": ("category", 0.95),
    "timezone": ("category", 0.95),
    "audio": ("category", 0.95),
    "languages": ("category", 0.95),
    "cpu_cores": ("numeric", 0.95),
    "device_memory": ("numeric", 0.95),
    "fonts": ("set", 0.80),
    "plugins": ("set", 0.80),
    "screen": ("numeric", 0.80),
    "user_agent": ("category", 0.50),
}
#: Every other name.
DEFAULT_FIELD = ("category", 0.80)
#: Names that the browser collector uses for fields.
COLLECTOR_NAMES = {
    "hardwareConcurrency": "cpu_cores",
    "deviceMemory": "device_memory",
    "screenResolution": "screen",
    "languages": "languages",
    "timezone": "timezone",
    "platform": "platform",
    "fonts": "fonts",
    "plugins": "plugins",
    "audio": "audio",
    "canvas": "canvas",
    "webGlBasics": "webgl",
    "webGlExtensions": "webgl",
}
LONG = ["id", "name", "kind", "cat", "num", "elems"]


def _choice(name: Column, at: int) -> Column:
    start = F.when(F.lit(False), F.lit(DEFAULT_FIELD[at]))
    return reduce(lambda c, f: c.when(name == f, F.lit(FIELDS[f][at])), FIELDS, start).otherwise(F.lit(DEFAULT_FIELD[at]))


def kind_of(name: Column | str) -> Column:
    return _choice(_col(name), 0)


def prior_of(name: Column | str) -> Column:
    return _choice(_col(name), 1)


def element_hashes(items: Column, salt: bytes) -> Column:
    return F.array_sort(F.array_distinct(F.transform(F.filter(items, lambda x: x.isNotNull()), lambda x: salted_hash(x, salt))))


def from_columns(df: DataFrame, id_: str, names: list[str], salt: bytes) -> DataFrame:
    """Long form of typed columns: strings for categories, bigint for numbers, array<string> for sets.

    Null is absent; an empty set is present. The columns are unpivoted in one pass, without a shuffle.
    """
    none = {"cat": "string", "num": "bigint", "elems": "array<string>"}
    parts = []
    for n in sorted(names):
        kind = FIELDS.get(n, DEFAULT_FIELD)[0]
        value = {
            "category": ("cat", lambda n=n: salted_hash(F.col(n).cast("string"), salt)),
            "numeric": ("num", lambda n=n: F.col(n).cast("bigint")),
            "set": ("elems", lambda n=n: element_hashes(F.col(n), salt)),
        }[kind]
        fields = [F.lit(n).alias("name"), F.lit(kind).alias("kind")]
        fields += [(value[1]() if c == value[0] else F.lit(None).cast(t)).alias(c) for c, t in none.items()]
        parts.append(F.when(F.col(n).isNotNull(), F.struct(*fields)))
    return df.select(F.col(id_).alias("id"), F.inline(F.filter(F.array(*parts), lambda x: x.isNotNull())))


def _typed(v: Column) -> Column:
    """A variant's own type, for scalars and arrays."""
    t = F.schema_of_variant(v)
    return (
        F.when(t == "STRING", "string")
        .when(t == "BOOLEAN", "boolean")
        .when(t.rlike(r"^(BIGINT|DECIMAL|DOUBLE|FLOAT)"), "number")
        .when(t.startswith("ARRAY"), "array")
        .when(t.startswith("OBJECT"), "object")
    )


def entries(df: DataFrame, id_: str, text: str) -> DataFrame:
    """``(id, pos, name, value variant, type)`` of a JSON object's members; other JSON and unreadable text have none."""
    parsed = df.select(F.col(id_).alias("id"), F.try_parse_json(F.col(text)).alias("v")).where(_typed(F.col("v")) == "object")
    out = parsed.lateralJoin(parsed.sparkSession.tvf.variant_explode(F.col("v").outer()))
    return out.select("id", "pos", F.col("key").alias("name"), "value", _typed(F.col("value")).alias("type"))


def unwrapped(members: DataFrame) -> DataFrame:
    """Collector members ``{"value": ..., "duration": ...}`` freed of the wrapper and renamed to fields.

    A member without own ``value`` is dropped, as are values of a type that the field can't take; unknown names keep
    scalars. Where two members give one field, a known name beats an unknown one, then the later member wins.
    """
    inner = F.try_variant_get("value", "$.value", "variant")
    rows = members.where("type = 'object'").withColumn("value", inner).where(F.col("value").isNotNull())
    rows = rows.withColumn("type", _typed(F.col("value")))
    known = F.create_map(*[F.lit(x) for kv in COLLECTOR_NAMES.items() for x in kv])
    target = F.try_element_at(known, F.col("name"))
    field = F.coalesce(target, F.col("name"))
    scalar = F.col("type").isin("string", "boolean", "number")
    fits = F.when(target.isin("fonts", "plugins"), F.col("type") == "array").otherwise(scalar)
    rows = rows.where(fits).select("id", field.alias("name"), F.struct(target.isNotNull().alias("known"), "pos").alias("rank"), F.struct(F.to_json("value").alias("j")).alias("s"))
    last = rows.groupBy("id", "name").agg(F.max_by("s", "rank").alias("s"))
    back = F.parse_json("s.j")
    return last.select("id", "name", back.alias("value")).withColumn("type", _typed(F.col("value")))


def from_members(members: DataFrame, salt: bytes) -> DataFrame:
    """Long form of ``(id, name, value, type)``: each value as its field wants it, dropped where the type is another."""
    kind = kind_of("name")
    scalar = F.col("type").isin("string", "boolean", "number")
    number = F.try_variant_get("value", "$", "double")
    whole = F.try_variant_get("value", "$", "decimal(38,0)")
    exact = F.schema_of_variant("value") == "BIGINT"
    strings = F.filter(F.try_variant_get("value", "$", "array<variant>"), lambda x: F.schema_of_variant(x) == "STRING")
    texts = F.transform(strings, lambda x: F.variant_get(x, "$", "string"))
    cat = F.when((kind == "category") & scalar, salted_hash(F.try_variant_get("value", "$", "string"), salt))
    num = F.when((kind == "numeric") & (F.col("type") == "number"), F.when(exact, whole.cast("bigint")).otherwise(F.round(number).cast("bigint")))
    elems = F.when((kind == "set") & (F.col("type") == "array"), element_hashes(texts, salt))
    out = members.select("id", "name", kind.alias("kind"), cat.alias("cat"), num.alias("num"), elems.alias("elems"))
    return out.where("cat is not null or num is not null or elems is not null")


def from_json(df: DataFrame, id_: str, text: str, salt: bytes) -> DataFrame:
    """Long form of JSON objects, plain members and members in the collector's wrapper alike.

    Defined cases: null, empty, unreadable and non-object texts have no components; null members are absent; a member that
    is an object with ``value`` is taken as wrapped, other objects are dropped.
    """
    members = entries(df, id_, text)
    inner = F.when(F.col("type") == "object", F.try_variant_get("value", "$.value", "variant"))
    flat = members.withColumn("value", F.coalesce(inner, F.when(F.col("type") != "object", F.col("value")))).where(F.col("value").isNotNull())
    return from_members(flat.withColumn("type", _typed(F.col("value"))), salt)


@F.pandas_udf(T.StringType())
def visitor_id(texts: pd.Series) -> pd.Series:
    """Id of a new device: SHA-256 of its components as compact JSON with sorted names; null for unreadable text."""

    def one(t: str | None) -> str | None:
        try:
            return hashlib.sha256(json.dumps(json.loads(t), sort_keys=True, separators=(",", ":"), ensure_ascii=False).encode()).hexdigest()
        except (TypeError, ValueError, UnicodeEncodeError):
            return None

    return texts.map(one)
