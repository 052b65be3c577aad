"""Identification with memory: exact in order, or in batches.

Each identification depends on all before it: rarities and reliabilities are counted over the whole history, and templates
drift. :func:`replay` keeps exactly that order, which is one task by nature; it is meant for evaluation sets and for
checking. :func:`identify_batch` is the form for large data: a batch is scored against the state before it with the
relational plan, new devices of the batch are linked by shared keys, and the state is merged once.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.canonical import prior_of
from ..functions.lineage import stored
from . import blocking, cells, scoring
from .trailing import CLASS_BAND, IP_BAND, RATE_WINDOW_S

#: Fixed value: change of confidence for a new device from an address with a high rate of them.
RATE_PENALTY = -0.3
OUTCOME = (
    "id string, visitor_id string, decision string, is_new_device boolean, score double, compared int, collision_risk boolean, confidence double, "
    "new_device_velocity string, new_device_velocity_ja4 string"
)


@dataclass
class Memory:
    """State of an ordered identification."""

    templates: dict[str, dict[str, tuple]] = field(default_factory=dict)
    blocks: dict[str, dict[str, None]] = field(default_factory=lambda: defaultdict(dict))
    hits: dict[str, int] = field(default_factory=lambda: defaultdict(int))
    all_hits: int = 0
    agreed: dict[str, list[int]] = field(default_factory=lambda: defaultdict(lambda: [0, 0]))
    arrivals: dict[str, list[int]] = field(default_factory=lambda: defaultdict(list))
    dropped: int = 0

    def rarity(self, value: str) -> float:
        return min(max((self.hits.get(value, 0) + 0.5) / (self.all_hits + 1.0), scoring.LEAST), scoring.MOST)

    def reliability(self, name: str, prior: float) -> float:
        yes, n = self.agreed[name] if name in self.agreed else (0, 0)
        w = scoring.PRIOR_WEIGHT
        return prior if n == 0 else min(max((yes + w * prior) / (n + w), scoring.LEAST), scoring.MOST)

    def compare(self, probe: dict[str, tuple], template: dict[str, tuple]) -> Iterator[tuple[str, float, float, float]]:
        """Name, agreement, rarity and prior of the components that both have, in order of names."""
        for name in sorted(probe.keys() & template.keys(), key=lambda n: n.encode()):
            kind, value, elems, prior = probe[name]
            kind2, value2, elems2, _ = template[name]
            if kind != kind2:
                continue
            if kind == "set":
                both, every = len(elems & elems2), len(elems | elems2)
                j = both / every if every else 1.0
                yield name, 1.0 if j >= scoring.AGREE else j, scoring.SET_RARITY, prior
            else:
                yield name, float(value == value2), self.rarity(value), prior

    def score(self, probe: dict[str, tuple], template: dict[str, tuple]) -> tuple[float, int]:
        total, n = 0.0, 0
        for name, sim, u, prior in self.compare(probe, template):
            m = self.reliability(name, prior)
            total += sim * math.log2(m / u) + (1.0 - sim) * math.log2((1.0 - m) / (1.0 - u))
            n += 1
        return total, n

    def observe(self, visitor: str, probe: dict[str, tuple], keys: list[str]) -> None:
        for kind, value, _, _ in probe.values():
            if kind != "set":
                self.hits[value] += 1
                self.all_hits += 1
        for k in keys:
            block = self.blocks[k]
            if visitor not in block:
                if len(block) >= blocking.BLOCK_CAP:
                    self.dropped += 1
                else:
                    block[visitor] = None
        self.templates.setdefault(visitor, {}).update(probe)

    def rate(self, key: str, now_s: int) -> int:
        seen = [t for t in self.arrivals[key] if t >= now_s - RATE_WINDOW_S] + [now_s]
        self.arrivals[key] = seen
        return len(seen)


def _logistic(x: float) -> float:
    return 1.0 / (1.0 + math.exp(-x))


def _band(n: int, medium: int, high: int) -> str:
    return "high" if n >= high else "medium" if n >= medium else "low"


def _confidence(decision: str, score: float | None, second: float | None, compared: int) -> float:
    whole = 0.5 + 0.5 * min(compared / scoring.FULL, 1.0)
    if decision == "match":
        gap = 1.0 if second is None else _logistic((score - second) / scoring.SCALE)
        base = 0.5 + 0.5 * min(_logistic((score - scoring.MATCH) / scoring.SCALE), gap)
    elif decision == "review":
        base = 0.25 + 0.25 * min(max((score - scoring.REVIEW) / (scoring.MATCH - scoring.REVIEW), 0.0), 1.0)
    else:
        near = 0.0 if score is None else _logistic((score - scoring.REVIEW) / scoring.SCALE)
        base = 0.5 + 0.5 * (1.0 - near)
    return min(max(base * whole, 0.0), 1.0)


def identify(memory: Memory, probe: dict[str, tuple], keys: list[str], minted: str, ts_ms: int, ip: str | None, shape: str | None) -> dict:
    """One identification, with its effect on the memory."""
    candidates = sorted({v for k in keys for v in memory.blocks.get(k, ())})
    ranked = sorted(((*memory.score(probe, memory.templates[v]), v) for v in candidates), key=lambda x: (-x[0], x[2]))
    score, compared, best = ranked[0] if ranked else (None, 0, None)
    second = ranked[1][0] if len(ranked) > 1 else None
    decision = "match" if ranked and score >= scoring.MATCH else "review" if ranked and score >= scoring.REVIEW else "new_device"
    out = {
        "visitor_id": minted if decision == "new_device" else best, "decision": decision, "is_new_device": decision == "new_device",
        "score": score, "compared": compared,
        "collision_risk": decision == "match" and second is not None and second >= scoring.MATCH and score - second < scoring.COLLISION_GAP,
        "confidence": _confidence(decision, score, second, compared), "new_device_velocity": "low", "new_device_velocity_ja4": "low",
    }
    if decision == "match":
        for name, sim, _, _ in memory.compare(probe, memory.templates[best]):
            memory.agreed[name][0] += sim >= scoring.AGREE
            memory.agreed[name][1] += 1
        memory.observe(best, probe, keys)
    elif decision == "new_device":
        memory.observe(minted, probe, keys)
        if ip is not None:
            out["new_device_velocity"] = _band(memory.rate(ip, ts_ms // 1000), *IP_BAND)
            if out["new_device_velocity"] == "high":
                out["confidence"] = min(max(out["confidence"] + RATE_PENALTY, 0.0), 1.0)
        if shape is not None:
            out["new_device_velocity_ja4"] = _band(memory.rate(f"ja4:{shape}", ts_ms // 1000), *CLASS_BAND)
    return out


def prepared(components: DataFrame, seen: DataFrame, salt: bytes, seed: bytes) -> DataFrame:
    """What an identification needs of each observation, ready for :func:`replay`.

    ``seen``: ``(id, ts, minted)`` and, where known, ``ip`` and ``shape`` (class of the handshake).
    """
    value = scoring.value_hash(salt)
    parts = components.groupBy("id").agg(F.collect_list(F.struct("name", "kind", value.alias("value"), "elems", prior_of("name").alias("prior"))).alias("parts"))
    keys = blocking.blocking_keys(components, seed).groupBy("id").agg(F.array_sort(F.collect_set("key")).alias("keys"))
    for c in ("ip", "shape"):
        if c not in seen.columns:
            seen = seen.withColumn(c, F.lit(None).cast("string"))
    return seen.select("id", "ts", "minted", "ip", "shape").join(parts, "id", "left").join(keys, "id", "left")


def replay(rows: DataFrame) -> DataFrame:
    """Outcomes of all observations in order of ``(ts, id)``: exact, and one task by nature."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        memory = Memory()
        for b in batches:
            out = []
            for r in b.itertuples(index=False):
                parts = r.parts if r.parts is not None else []
                probe = {p["name"]: (p["kind"], p["value"], frozenset(p["elems"] if p["elems"] is not None else ()), p["prior"]) for p in parts}
                keys = list(r.keys) if r.keys is not None else []
                out.append({"id": r.id} | identify(memory, probe, keys, r.minted, int(r.ts), r.ip, r.shape))
            yield pd.DataFrame(out, columns=[c.split()[0] for c in OUTCOME.split(", ")]).astype({"score": "float64"})

    one = rows.select(F.col("id").cast("string").alias("id"), F.coalesce("ts", F.lit(0)).alias("ts"), "minted", "ip", "shape", "parts", "keys", F.col("id").alias("__o"))
    return one.coalesce(1).sortWithinPartitions("ts", "__o").drop("__o").mapInPandas(run, OUTCOME)


def identify_batch(batch: DataFrame, seen: DataFrame, library: DataFrame, counts: DataFrame, learned: DataFrame | None, salt: bytes, seed: bytes) -> DataFrame:
    """Outcomes of a batch against the state before it.

    ``batch``: long-form components; ``seen``: ``(id, ts, minted)``; ``library``: templates with their index entries, as stored
    :func:`scoring.library_records`; ``counts`` stored. Rarities, reliabilities and templates are those at the batch's beginning.
    New devices of the batch that share a key with an earlier new one take its id (one step, not its chain); that differs from
    the order-exact form.
    """
    keys = blocking.blocking_keys(batch, seed).select("id", F.xxhash64("key").alias("key"))
    probe = scoring.probe_records(batch, keys, salt, counts, learned)
    top = cells.best(probe, library, scoring.AGREE).drop("names", "sims")
    found = stored(scoring.decide(seen, top))  # read for the outcomes and for the new devices
    fresh = found.where("is_new_device").join(seen.select("id", "ts", "minted"), "id").select("id", "ts", "minted")
    at = fresh.join(keys.distinct(), "id")
    heads = at.groupBy("key").agg(F.min(F.struct("ts", "id", "minted")).alias("head"))
    first = at.select("id", "key").join(heads, "key").groupBy("id").agg(F.min("head").alias("head"))
    own = fresh.join(first, "id", "left").select("id", F.coalesce("head.minted", "minted").alias("made"))
    return found.join(own, "id", "left").withColumn("visitor_id", F.coalesce("visitor_id", "made")).drop("made")


def evaluate(outcomes: DataFrame, truth: DataFrame) -> DataFrame:
    """One row of counts and rates; ``truth``: ``(id, device, ts)``.

    A visitor id belongs to the device of the observation that came first with it. A revisit is stable if it resolves to
    an id of its device that is older; an observation that resolves to another device's id is a collision.
    """
    rows = outcomes.select("id", "visitor_id").join(truth.select(F.col("id").cast("string").alias("id"), "device", "ts"), "id")
    when = F.struct("ts", F.col("id").alias("at"))
    owners = rows.groupBy("visitor_id").agg(F.min(F.struct("ts", F.col("id").alias("at"), "device")).alias("o"))
    starts = rows.groupBy("device").agg(F.min(when).alias("start"))
    judged = rows.join(owners, "visitor_id").join(starts, "device")
    first = F.col("id") == F.col("o.at")
    revisit = F.col("id") != F.col("start.at")
    own = F.col("device") == F.col("o.device")
    n = judged.agg(
        F.count("*").alias("observations"), F.count_distinct("device").alias("devices"), F.count_if(revisit).alias("revisits"),
        F.count_if(revisit & own & ~first).alias("stable"), F.count_if(~own).alias("collisions"), F.count_if(first).alias("minted"),
    )
    stability = F.when(F.col("revisits") == 0, 1.0).otherwise(F.col("stable") / F.col("revisits"))
    collision = F.when(F.col("observations") == 0, 0.0).otherwise(F.col("collisions") / F.col("observations"))
    return n.withColumns({"stability_rate": stability, "collision_rate": collision})


def rounds(observations: DataFrame, device: str, order: str) -> DataFrame:
    """``observations`` with ``round`` and ``place``: first visits of all devices, then second visits, and so on."""
    n = F.row_number().over(Window.partitionBy(device).orderBy(order)) - 1
    return observations.withColumn("round", n).withColumn("place", F.struct(F.col("round"), F.col(device)))
