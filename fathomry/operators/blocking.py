"""Blocking keys and candidate recall.

Keys are hex SHA-256: one over all scalar components (exact repeats), two over fixed groups, and the bands of a MinHash
signature of the fonts. Integers inside digests are eight bytes, least significant first.
"""

from __future__ import annotations

import hashlib
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.hashing import le64, utf8
from ..sources.shipping import ship_active
from .fragment import skewed_join

#: The groups' names and members; permutations and rows of a band; most visitors in a block.
GROUPS = {"K1": ["webgl", "platform", "timezone"], "K2": ["audio", "cpu_cores", "device_memory"]}
ALL_SCALARS, BAND_LABEL, BANDED = "K0", "minhash-band", "fonts"
PERMUTATIONS, BAND_ROWS, BLOCK_CAP = 16, 2, 1024


def scalar_bytes() -> Column:
    """What of a component goes into keys: the hash of a category, the number as eight bytes; null for sets."""
    return F.coalesce(F.unhex("cat"), le64("num"))


def _digest(parts: Column, label: str) -> Column:
    return F.sha2(F.concat(F.encode(F.lit(label), "UTF-8"), parts), 256)


def _sized(b: Column) -> Column:
    return F.concat(le64(F.octet_length(b)), b)


def family(seed: bytes, n: int = PERMUTATIONS) -> list[tuple[int, int]]:
    """``n`` affine permutations of 64-bit numbers, drawn from a seed: an odd factor and an addend."""
    out = []
    for i in range(n):
        d = hashlib.sha256(seed + i.to_bytes(8, "little")).digest()
        out.append((int.from_bytes(d[:8], "little") | 1, int.from_bytes(d[8:16], "little")))
    return out


def band_keys(elems: Column, seed: bytes) -> Column:
    """Band keys of an array of element hashes (hex); an empty set has none, null gives null."""
    ship_active()
    pairs = family(seed)
    a = np.array([p[0] for p in pairs], dtype=np.uint64)[:, None]
    b = np.array([p[1] for p in pairs], dtype=np.uint64)[:, None]

    @F.pandas_udf("array<string>")
    def keys(sets: pd.Series) -> pd.Series:
        out: list[list[str] | None] = []
        for s in sets:
            if s is None:
                out.append(None)
            elif len(s) == 0:
                out.append([])
            else:
                x = np.frombuffer(b"".join(bytes.fromhex(e[:16]) for e in s), dtype="<u8")
                low = (x[None, :] * a + b).min(axis=1).astype("<u8")
                out.append([
                    hashlib.sha256(BAND_LABEL.encode() + i.to_bytes(8, "little") + low[i * BAND_ROWS : (i + 1) * BAND_ROWS].tobytes()).hexdigest()
                    for i in range(PERMUTATIONS // BAND_ROWS)
                ])
        return pd.Series(out)

    return keys(elems)


def blocking_keys(components: DataFrame, seed: bytes) -> DataFrame:
    """``(id, key)`` of long-form components; the rows of an id are gathered once (they are few by nature).

    Defined cases: a group with a missing or set member gives no key; an id without scalars no all-scalars key; empty
    fonts no band keys; repeated rows of a component must have been folded before.
    """
    scalar = scalar_bytes()
    packed = components.groupBy("id").agg(
        F.array_sort(F.collect_list(F.when(scalar.isNotNull(), F.struct(utf8("name").alias("n"), scalar.alias("b"))))).alias("scalars"),
        *[F.max(F.when(F.col("name") == m, scalar)).alias(f"m_{m}") for g in GROUPS.values() for m in g],
        F.max(F.when(F.col("name") == BANDED, F.col("elems"))).alias("banded"),
    )
    folded = F.aggregate("scalars", F.unhex(F.lit("")), lambda acc, x: F.concat(acc, _sized(x["n"]), _sized(x["b"])))
    every = F.when(F.size("scalars") > 0, _digest(folded, ALL_SCALARS))
    grouped = [_digest(reduce(lambda p, q: F.concat(p, q), [_sized(F.col(f"m_{m}")) for m in ms]), g) for g, ms in GROUPS.items()]
    bands = F.coalesce(band_keys(F.col("banded"), seed), F.array().cast("array<string>"))
    keys = F.filter(F.concat(F.array(every, *grouped), bands), lambda k: k.isNotNull())
    return packed.select("id", F.explode(keys).alias("key"))


def index(entries: DataFrame, order: list[str], cap: int = BLOCK_CAP) -> DataFrame:
    """The entries that a capped index holds: of each key the first ``cap`` visitors by their first entry in ``order``, then by id.

    Entries with a null key or visitor are dropped. Ranks are cut before the shuffle, so a hot key doesn't meet one task whole.
    """
    first = entries.where("key is not null and visitor_id is not null").groupBy("key", "visitor_id").agg(F.min(F.struct(*order)).alias("at"))
    place = F.row_number().over(Window.partitionBy("key").orderBy("at", "visitor_id"))
    return first.withColumn("place", place).where(F.col("place") <= cap).select("key", "visitor_id")


def candidates(probe_keys: DataFrame, blocks: DataFrame) -> DataFrame:
    """Distinct ``(id, visitor_id)`` that share a key; frequent keys are fragmented and their blocks replicated."""
    left = probe_keys.select("id", "key").where("key is not null")
    return skewed_join(left, blocks.select("key", "visitor_id"), "key").select("id", "visitor_id").distinct()


def recall(pairs: DataFrame, templates: DataFrame, most: int = BLOCK_CAP) -> tuple[DataFrame, DataFrame]:
    """Candidates that have a template, at most ``most`` (least visitor ids first) for each probe, and ``(id, kept, dropped)``.

    ``pairs``: distinct ``(id, visitor_id)``, stored; ``templates`` has one row for each visitor. Entries of visitors without a template are
    dangling and don't count. Ranks are cut before the shuffle, so a probe with very many candidates doesn't meet one task whole.
    """
    known = skewed_join(pairs, templates.select("visitor_id").distinct(), "visitor_id")
    place = F.row_number().over(Window.partitionBy("id").orderBy("visitor_id"))
    kept = known.withColumn("place", place).where(F.col("place") <= most).drop("place")
    n = F.least(F.col("n"), F.lit(most))
    counts = known.groupBy("id").agg(F.count("*").alias("n")).select("id", n.alias("kept"), (F.col("n") - n).alias("dropped"))
    return kept.select("id", "visitor_id"), counts


def without_visitors(entries: DataFrame, erased: DataFrame) -> DataFrame:
    """Index entries but those of erased visitors."""
    return entries.join(erased.select("visitor_id").distinct(), "visitor_id", "left_anti").select(*entries.columns)
