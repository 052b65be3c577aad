"""Queries over observations and templates: components, keys, recall, scores, maintenance, signals."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import canonical, hashing
from ..functions.lineage import cut, stored
from ..operators import blocking, cells, maintenance, replay, scoring, signals, trailing
from ..sources import table

SALT = hashing.salt_from_secret("fathomry")
SEED = SALT
COLUMNS = ["webgl", "platform", "timezone", "audio", "cpu_cores", "device_memory", "user_agent", "canvas", "fonts"]
#: Hosting systems and owners as an address feed would give them, by the last octet of an address.
FEED = [(0, 16509, None), (1, 64500, "Example Cloud Ltd"), (2, 64501, "Example Telecom"), (3, None, "OVH SAS"), (4, None, None)]
#: Handshake digests as a proxy would give them, by observation.
HANDSHAKES = ["t13d1516h2_8daaf6152771_b0da82dd1658", "t13d0304h1_8daaf6152771_b0da82dd1658", "q13d1516h3_8daaf6152771_b0da82dd1658", "t13d1516h1_x_y", "garbage", None]


def observations(spark: SparkSession, folder: str) -> DataFrame:
    """Observations, each once, with ``id`` and a time (0 where it is missing)."""
    raw = table(spark, folder, "synthetic_observations").where("obs_id is not null")
    rest = [c for c in raw.columns if c != "obs_id"]
    once = raw.groupBy("obs_id").agg(F.max(F.struct(*rest)).alias("r")).select(F.col("obs_id").alias("id"), "r.*")
    return once.withColumn("ts", F.coalesce("ts", F.lit(0)))


def components(obs: DataFrame) -> DataFrame:
    return canonical.from_columns(obs, "id", COLUMNS, SALT)


def _split(obs: DataFrame) -> DataFrame:
    """``library`` true for each device's first observation."""
    first = obs.groupBy("device_id").agg(F.min(F.struct("ts", "id")).alias("f"))
    return obs.join(first, "device_id").withColumn("library", F.col("id") == F.col("f.id")).drop("f")


def stored_components(spark: SparkSession, folder: str) -> DataFrame:
    """Observations' components in long form."""
    c = components(observations(spark, folder))
    return c.withColumn("elems", F.array_join("elems", ","))


def template_components(spark: SparkSession, folder: str) -> DataFrame:
    """Number of components of each kind in the templates' JSON, plain and wrapped."""
    raw = table(spark, folder, "templates").where("visitor_id is not null")
    last = raw.groupBy("visitor_id").agg(F.max_by("components", F.struct("last_seen", "components")).alias("components"))
    c = canonical.from_json(last, "visitor_id", "components", SALT)
    return c.groupBy("name", "kind").agg(F.count("*").alias("n"), F.count_distinct(F.coalesce("cat", F.col("num").cast("string"))).alias("values"))


def blocking_scalar_keys(spark: SparkSession, folder: str) -> DataFrame:
    """Keys of observations without font lists: the all-scalars key and the two groups."""
    obs = observations(spark, folder).withColumn("fonts", F.lit(None).cast("array<string>"))
    return blocking.blocking_keys(components(obs), SEED)


def minhash_band_keys(spark: SparkSession, folder: str) -> DataFrame:
    """Band keys of observations' fonts."""
    fonts = canonical.from_columns(observations(spark, folder), "id", ["fonts"], SALT)
    return fonts.select("id", F.explode(blocking.band_keys(F.col("elems"), SEED)).alias("key"))


def _entries(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Keys of the later observations, index of the library (one visitor for each device), components of the library and of the later ones; all stored."""
    obs = cut(_split(observations(spark, folder)))
    library, asked = cut(components(obs.where("library"))), cut(components(obs.where("not library")))
    entries = blocking.blocking_keys(library, SEED).join(obs.select("id", "ts"), "id").select("key", F.col("id").alias("visitor_id"), "ts")
    return cut(blocking.blocking_keys(asked, SEED)), cut(blocking.index(entries, ["ts", "visitor_id"])), library, asked


def candidate_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs of later observations and library observations that share a key."""
    probes, index, *_ = _entries(spark, folder)
    return blocking.candidates(probes, index)


def recall_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Candidates of each later observation that have a template (each fifth visitor of the index has none), as bounded for a probe, and how many the bound drops."""
    probes, index, library, _ = _entries(spark, folder)
    known = library.select(F.col("id").alias("visitor_id")).where("visitor_id % 5 <> 0")
    return blocking.recall(cut(blocking.candidates(probes, index)), known)[1]


def value_frequency(spark: SparkSession, folder: str) -> DataFrame:
    """How often each scalar value was seen."""
    return scoring.frequency(components(observations(spark, folder)), SALT)


def _matching(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Later observations' components and keys, records of the library (stored), and how often each of its values was seen (stored)."""
    obs = stored(_split(observations(spark, folder)).select("id", "ts", "library", *COLUMNS))
    # an observation is moved once: all that is made of its components stays where it is
    library, asked = (components(obs.where(w).repartition(F.col("id"))) for w in ("library", "not library"))
    entries = blocking.blocking_keys(library, SEED).join(obs.where("library").select("id", "ts"), "id").select(F.xxhash64("key").alias("key"), F.col("id").alias("visitor_id"), "ts")
    records = stored(scoring.library_records(library, blocking.index(entries, ["ts", "visitor_id"]), SALT))
    return asked, blocking.blocking_keys(asked, SEED).select("id", F.xxhash64("key").alias("key")), records, stored(scoring.frequency(library, SALT))


def _rounded(s: DataFrame) -> DataFrame:
    return s.select("id", "visitor_id", F.round("score", 6).alias("score"), "compared")


def fs_candidate_scores(spark: SparkSession, folder: str) -> DataFrame:
    """Score of each pair with rarities of the library."""
    asked, keys, library, counts = _matching(spark, folder)
    return _rounded(cells.scored(scoring.probe_records(asked, keys, SALT, counts), library, scoring.AGREE))


def score_decision(spark: SparkSession, folder: str) -> DataFrame:
    """Decision for each later observation."""
    asked, keys, library, counts = _matching(spark, folder)
    out = scoring.decide(asked, cells.best(scoring.probe_records(asked, keys, SALT, counts), library, scoring.AGREE))
    return out.select("id", "visitor_id", "decision", F.round("score", 6).alias("score"), "compared", "collision_risk", F.round("confidence", 6).alias("confidence"))


def score_block_scope(spark: SparkSession, folder: str) -> DataFrame:
    """Score of each pair with rarities of the probe's own candidates."""
    asked, keys, library, _ = _matching(spark, folder)
    return _rounded(scoring.block_scope(keys, library, asked, SALT))


def _confirmed(probes: DataFrame, library: DataFrame) -> DataFrame:
    """How often each component agreed over confirmed matches."""
    top = stored(cells.best(probes, library, scoring.AGREE))
    match = scoring.decide(top, top.drop("names", "sims")).where("decision = 'match'").select("id", "visitor_id")
    sims = F.inline(F.arrays_zip(F.col("names").alias("name"), F.col("sims").alias("sim")))
    return scoring.agreement(top.where(F.col("score") >= scoring.MATCH).join(match, ["id", "visitor_id"]).select(sims))


def agreement_rates(spark: SparkSession, folder: str) -> DataFrame:
    """Agreement of each component over confirmed matches."""
    asked, keys, library, counts = _matching(spark, folder)
    return _confirmed(scoring.probe_records(asked, keys, SALT, counts), library)


def score_learned(spark: SparkSession, folder: str) -> DataFrame:
    """Score of each pair with the reliabilities that the confirmed matches of a first pass teach."""
    asked, keys, library, counts = _matching(spark, folder)
    learned = cut(_confirmed(scoring.probe_records(asked, keys, SALT, counts), library))
    return _rounded(cells.scored(scoring.probe_records(asked, keys, SALT, counts, learned), library, scoring.AGREE))


def template_fold(spark: SparkSession, folder: str) -> DataFrame:
    """Latest value of each component of each device."""
    obs = observations(spark, folder)
    seen = obs.select("id", F.col("device_id").alias("visitor_id"), "ts", F.col("id").alias("seq"))
    t = maintenance.fold_templates(components(obs), seen)
    return t.withColumn("elems", F.array_join("elems", ","))


def record_counters(spark: SparkSession, folder: str) -> DataFrame:
    """First and last sighting and number of observations of each device."""
    return maintenance.counters(observations(spark, folder).withColumnRenamed("device_id", "visitor_id"))


def _records(spark: SparkSession, folder: str) -> DataFrame:
    raw = table(spark, folder, "templates").where("visitor_id is not null")
    return raw.groupBy("visitor_id").agg(F.max("last_seen").alias("last_seen"))


def cap_evict(spark: SparkSession, folder: str) -> DataFrame:
    """The half of the library that was seen last."""
    r = _records(spark, folder)
    return maintenance.cap(r, r.count() // 2)


def template_retention(spark: SparkSession, folder: str) -> DataFrame:
    """Templates and index entries that a retention of 30 days before the last sighting keeps."""
    r = _records(spark, folder)
    last = r.agg(F.max("last_seen")).first()[0] or 0
    entries = table(spark, folder, "blocking_index").select(F.lower(F.trim("key")).alias("key"), F.lower(F.trim("visitor_id")).alias("visitor_id"))
    kept, index = maintenance.retire(r, entries.where("key is not null and visitor_id is not null").distinct(), last - 30 * 86_400_000)
    return kept.agg(F.count("*").alias("templates")).withColumn("entries", index.select(F.count("*")).scalar())


def capped_index(spark: SparkSession, folder: str) -> DataFrame:
    """Blocks of the index with the entries a cap of 1,024 visitors keeps and drops."""
    raw = table(spark, folder, "blocking_index").select(F.lower(F.trim("key")).alias("key"), F.lower(F.trim("visitor_id")).alias("visitor_id"))
    sizes = raw.where("key is not null and visitor_id is not null").distinct().groupBy("key").count()
    kept = F.least("count", F.lit(blocking.BLOCK_CAP))
    return sizes.select("key", kept.alias("kept"), (F.col("count") - kept).alias("dropped"))


def index_rows(spark: SparkSession, folder: str) -> DataFrame:
    """The index's entries under the cap, first by visitor id."""
    raw = table(spark, folder, "blocking_index").select(F.lower(F.trim("key")).alias("key"), F.lower(F.trim("visitor_id")).alias("visitor_id"))
    return blocking.index(raw, ["visitor_id"])


def requests(spark: SparkSession, folder: str) -> DataFrame:
    """Observations with a handshake and an address, derived from their number."""
    obs = observations(spark, folder)
    shakes = F.array(*[F.lit(h) for h in HANDSHAKES])
    ip = F.concat(F.when(F.col("id") % 7 == 0, "34.120.5.").when(F.col("id") % 7 == 1, "13.70.9.").otherwise("198.51.100."), (F.col("id") % 5).cast("string"))
    agent = F.when(F.col("id") % 11 == 0, "curl/8.4.0").otherwise(F.col("user_agent"))
    return obs.select("id", "ts", "device_id", agent.alias("agent"), F.element_at(shakes, (F.col("id") % len(HANDSHAKES) + 1).cast("int")).alias("ja4"), ip.alias("ip"))


def ua_class(spark: SparkSession, folder: str) -> DataFrame:
    """Class of each claimed user agent."""
    return requests(spark, folder).select("id", signals.agent_class("agent").alias("class"))


def ja4_class(spark: SparkSession, folder: str) -> DataFrame:
    """Class and stack of each handshake."""
    return requests(spark, folder).select("id", signals.handshake_class("ja4").alias("shape"), signals.stack_class("ja4").alias("stack"))


def tls_consistency(spark: SparkSession, folder: str) -> DataFrame:
    """Whether claim and handshake agree, and what that does to a confidence of 0.5."""
    s = signals.signals(requests(spark, folder), "agent", "ja4", "ip", F.col("id") % 13 != 0)
    return s.select("id", "ip_risk", "tls_consistency", signals.fused(F.lit(0.5), F.col("confidence_change")).alias("confidence"))


def asn_risk(spark: SparkSession, folder: str) -> DataFrame:
    """Risk by owner of the address's network, raised over the risk by address."""
    feed = spark.createDataFrame(FEED, "k bigint, asn bigint, owner string")
    rows = requests(spark, folder).withColumn("k", F.col("id") % 5).join(F.broadcast(feed), "k")
    by_owner = signals.owner_risk("asn", "owner")
    return rows.select("id", by_owner.alias("owner_risk"), signals.raised(signals.address_risk("ip"), by_owner).alias("ip_risk"))


def nonce_outcome(spark: SparkSession, folder: str) -> DataFrame:
    """Outcome of each use of a one-time token; tokens and uses are derived from the observations."""
    obs = observations(spark, folder).select("id", "ts")
    nonce = F.concat(F.lit("n"), F.col("id").cast("string"))
    issued = obs.where("id % 17 != 0").select(nonce.alias("nonce"), (F.col("ts") + 30_000).alias("expires_ms"))
    at = lambda shift, n: F.struct((F.col("ts") + shift).alias("used_ms"), (F.col("id") * 2 + n).alias("use_id"))
    twice = F.when(F.col("id") % 3 == 0, F.array(at(F.col("id") % 40 * 1000, 0), at(F.lit(29_999), 1))).otherwise(F.array(at(F.col("id") % 40 * 1000, 0)))
    uses = obs.select(nonce.alias("nonce"), F.inline(twice))
    return maintenance.single_use(issued, uses)


def hmac_probe(spark: SparkSession, folder: str) -> DataFrame:
    """Digest and signature of each observation's id."""
    obs = observations(spark, folder)
    text = F.col("id").cast("string")
    return obs.select("id", hashing.probe_digest(b"key", text).alias("digest"), hashing.signature(b"key", "ts", text).alias("signature"))


def nonce_issue(spark: SparkSession, folder: str) -> DataFrame:
    """A one-time token for each observation."""
    return maintenance.issue(observations(spark, folder), "id", "ts", b"key")


def exact_matches(spark: SparkSession, folder: str) -> DataFrame:
    """How often each exact set of components was seen, by the id made of it."""
    obs = observations(spark, folder).select(canonical.visitor_id(F.to_json(F.struct(*COLUMNS))).alias("visitor_id"))
    return obs.groupBy("visitor_id").agg(F.count("*").alias("seen_count"))


def _batch(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Outcomes of the later observations as one batch against the library of first ones, and all observations."""
    obs = stored(_split(observations(spark, folder)).select("id", "ts", "device_id", "library", *COLUMNS))
    library, batch = (components(obs.where(w).repartition(F.col("id"))) for w in ("library", "not library"))
    keys = blocking.blocking_keys(library, SEED).select(F.xxhash64("key").alias("key"), F.col("id").cast("string").alias("visitor_id"))
    visitors = library.withColumn("id", F.col("id").cast("string"))
    records = stored(scoring.library_records(visitors, blocking.index(keys, ["visitor_id"]), SALT))
    seen = obs.where("not library").select("id", "ts", canonical.visitor_id(F.to_json(F.struct(*COLUMNS))).alias("minted"))
    return replay.identify_batch(batch, seen, records, stored(scoring.frequency(library, SALT)), None, SALT, SEED), obs


def identify_batches(spark: SparkSession, folder: str) -> DataFrame:
    """Outcomes of the later observations as one batch against the library of first ones."""
    return _batch(spark, folder)[0].select("id", "visitor_id", "decision", F.round("confidence", 6).alias("confidence"))


def eval_rates(spark: SparkSession, folder: str) -> DataFrame:
    """Stability and collisions of the batch's outcomes (the library's observations have themselves for ids) against the labelled devices."""
    out, obs = _batch(spark, folder)
    own = obs.where("library").select(F.col("id").cast("string").alias("id"), F.col("id").cast("string").alias("visitor_id"))
    every = stored(out.select(F.col("id").cast("string").alias("id"), "visitor_id").unionByName(own))
    return replay.evaluate(every, obs.select("id", F.col("device_id").alias("device"), "ts"))


def velocity_gate(spark: SparkSession, folder: str) -> DataFrame:
    """Bands of new devices in an hour behind each observation's address and class of handshake; only new devices are counted and rated."""
    out, _ = _batch(spark, folder)
    asked = requests(spark, folder).select("id", "ip", signals.handshake_class("ja4").alias("shape"), F.floor(F.col("ts") / 1000).alias("s"))
    verdicts = stored(out.select("id", "is_new_device").join(asked, "id"))
    scopes = {"new_device_velocity": ("ip", trailing.IP_BAND), "new_device_velocity_ja4": ("shape", trailing.CLASS_BAND)}
    return trailing.rate_bands(verdicts, "id", "is_new_device", "s", scopes, trailing.RATE_WINDOW_S)


QUERIES = {
    "stored_components": stored_components, "template_components": template_components, "blocking_scalar_keys": blocking_scalar_keys,
    "minhash_band_keys": minhash_band_keys, "candidate_pairs": candidate_pairs, "value_frequency": value_frequency,
    "fs_candidate_scores": fs_candidate_scores, "score_decision": score_decision, "score_block_scope": score_block_scope,
    "agreement_rates": agreement_rates, "template_fold": template_fold, "record_counters": record_counters, "cap_evict": cap_evict,
    "template_retention": template_retention, "capped_index": capped_index, "index_rows": index_rows, "ua_class": ua_class, "ja4_class": ja4_class,
    "tls_consistency": tls_consistency, "asn_risk": asn_risk, "nonce_outcome": nonce_outcome, "hmac_probe": hmac_probe,
    "eval_rates": eval_rates, "identify_batches": identify_batches, "score_learned": score_learned, "recall_counts": recall_counts,
    "nonce_issue": nonce_issue, "exact_matches": exact_matches, "velocity_gate": velocity_gate,
}


def _h(x: str) -> str:
    return f"sha256(unhex('{SALT.hex()}') || encode({x}))"


def _le(hex16: str) -> str:
    return " || ".join(f"substr({hex16}, {15 - 2 * i}, 2)" for i in range(8))


def _le_int(x: str) -> str:
    return _le(f"lpad(to_hex({x}), 16, '0')")


def _text(s: str) -> str:
    return s.encode().hex()


def _component(name: str) -> str:
    kind = canonical.FIELDS.get(name, canonical.DEFAULT_FIELD)[0]
    cat = _h(name) if kind == "category" else "NULL"
    num = name if kind == "numeric" else "NULL"
    elems = f"list_sort(list_distinct(list_transform(list_filter(fonts, lambda x: x IS NOT NULL), lambda x: {_h('x')})))" if kind == "set" else "NULL"
    prior = canonical.FIELDS.get(name, canonical.DEFAULT_FIELD)[1]
    return (
        f"SELECT id, device_id, ts, '{name}' AS name, '{kind}' AS kind, {cat}::VARCHAR AS cat, {num}::BIGINT AS num, {elems}::VARCHAR[] AS elems, "
        f"{prior}::DOUBLE AS prior FROM obs WHERE {name} IS NOT NULL"
    )


_OBS = "obs AS (SELECT DISTINCT ON (obs_id) obs_id AS id, device_id, coalesce(ts, 0) AS ts, webgl, platform, timezone, audio, cpu_cores, device_memory, user_agent, canvas, fonts FROM synthetic_observations WHERE obs_id IS NOT NULL)"
_COMP = f"""{_OBS}, comp0 AS ({' UNION ALL '.join(map(_component, COLUMNS))}),
comp AS (SELECT *, coalesce(cat, {_h('num::VARCHAR')}) AS value, CASE WHEN cat IS NOT NULL THEN cat WHEN num IS NOT NULL THEN {_le_int('num')} END AS raw FROM comp0)"""
_SIZED = f"{_le_int('len(raw) // 2')} || raw"
_SCALAR_KEYS = f"""
k0 AS (SELECT id, sha256(unhex('{_text("K0")}' || string_agg({_le_int('strlen(name)')} || lower(hex(encode(name))) || {_SIZED}, '' ORDER BY name))) AS key FROM comp WHERE raw IS NOT NULL GROUP BY id),
""" + ",\n".join(
    f"""g{g} AS (SELECT id, sha256(unhex('{_text(g)}' || {' || '.join(f"max(CASE WHEN name = '{m}' THEN {_SIZED} END)" for m in ms)})) AS key FROM comp GROUP BY id
    HAVING {' AND '.join(f"max(CASE WHEN name = '{m}' THEN raw END) IS NOT NULL" for m in ms)})"""
    for g, ms in blocking.GROUPS.items()
) + ",\nscalar_keys AS (SELECT * FROM k0 UNION ALL SELECT * FROM gK1 UNION ALL SELECT * FROM gK2)"
_PERMS = ", ".join(f"({i}, {a}::UHUGEINT, {b}::UHUGEINT)" for i, (a, b) in enumerate(blocking.family(SEED)))
_BANDS = f"""
perm(i, a, b) AS (VALUES {_PERMS}),
el AS (SELECT id, ('0x' || {_le('e')})::UBIGINT::UHUGEINT AS x FROM (SELECT id, unnest(elems) AS e FROM comp WHERE name = 'fonts')),
low AS (SELECT id, i, min((a * x + b) % 18446744073709551616::UHUGEINT)::UBIGINT AS v FROM el, perm GROUP BY id, i),
band_keys AS (
  SELECT id, sha256(unhex('{_text(blocking.BAND_LABEL)}' || {_le_int('i // 2')} || string_agg({_le_int('v')}, '' ORDER BY i))) AS key FROM low GROUP BY id, i // 2
)"""
_KEYS = f"{_COMP}, {_SCALAR_KEYS}, {_BANDS}, keys AS (SELECT DISTINCT id, key FROM (SELECT * FROM scalar_keys UNION ALL SELECT * FROM band_keys))"
_PAIRS = f"""{_KEYS},
lib AS (SELECT arg_min(id, (ts, id)) AS id FROM obs GROUP BY device_id),
idx AS (SELECT key, id AS visitor_id FROM (SELECT key, id, row_number() OVER (PARTITION BY key ORDER BY ts, id) AS r FROM keys JOIN obs USING (id) WHERE id IN (FROM lib)) WHERE r <= {blocking.BLOCK_CAP}),
pairs AS (SELECT DISTINCT k.id, visitor_id FROM keys k JOIN idx USING (key) WHERE k.id NOT IN (FROM lib))"""
_SIM = """CASE WHEN p.kind = 'set' THEN CASE WHEN len(p.elems) = 0 AND len(t.elems) = 0 THEN 1.0 ELSE
    (SELECT CASE WHEN j >= 0.5 THEN 1.0 ELSE j END FROM (SELECT len(list_intersect(p.elems, t.elems)) / (len(p.elems) + len(t.elems) - len(list_intersect(p.elems, t.elems))) AS j)) END
    ELSE CASE WHEN p.value = t.value THEN 1.0 ELSE 0.0 END END"""
_W = "sim * log2(prior / u) + (1 - sim) * log2((1 - prior) / (1 - u))"
_SCORES = f"""{_PAIRS},
freq AS (SELECT value, count(*) AS hits FROM comp WHERE id IN (FROM lib) AND kind <> 'set' GROUP BY value),
tot AS (SELECT coalesce(sum(hits), 0) AS n FROM freq),
cmp AS (
  SELECT pairs.id, pairs.visitor_id, p.name, p.prior, {_SIM} AS sim,
    CASE WHEN p.kind = 'set' THEN 0.05 ELSE least(greatest((coalesce(hits, 0) + 0.5) / (tot.n + 1.0), 1e-4), 0.9999) END AS u
  FROM pairs JOIN comp p ON p.id = pairs.id JOIN comp t ON t.id = pairs.visitor_id AND t.name = p.name AND t.kind = p.kind
  LEFT JOIN freq ON freq.value = p.value AND p.kind <> 'set', tot
),
scored AS (SELECT id, visitor_id, sum({_W} ORDER BY name) AS score, CAST(count(*) AS INT) AS compared FROM cmp GROUP BY id, visitor_id)"""
_DECIDED = f"""{_SCORES},
ranked AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, visitor_id) AS r FROM scored),
best AS (
  SELECT a.id, b.visitor_id, b.score, coalesce(b.compared, 0) AS compared, s.score AS second,
    CASE WHEN b.score >= 12 THEN 'match' WHEN b.score >= 8 THEN 'review' ELSE 'new_device' END AS decision
  FROM (SELECT DISTINCT id FROM comp WHERE id NOT IN (FROM lib)) a LEFT JOIN ranked b ON b.id = a.id AND b.r = 1 LEFT JOIN ranked s ON s.id = a.id AND s.r = 2
)"""
_LOGISTIC = "(1 / (1 + exp(-({}))))"
_CONFIDENCE = f"""least(greatest((CASE decision
    WHEN 'match' THEN 0.5 + 0.5 * least({_LOGISTIC.format('(score - 12) / 4')}, CASE WHEN second IS NULL THEN 1.0 ELSE {_LOGISTIC.format('(score - second) / 4')} END)
    WHEN 'review' THEN 0.25 + 0.25 * least(greatest((score - 8) / 4, 0), 1)
    ELSE 0.5 + 0.5 * (1 - CASE WHEN score IS NULL THEN 0.0 ELSE {_LOGISTIC.format('(score - 8) / 4')} END) END) * (0.5 + 0.5 * least(compared / 8.0, 1)), 0), 1)"""
_BLOCK = f"""{_PAIRS},
cand AS (SELECT pairs.id, c.value FROM pairs JOIN comp c ON c.id = pairs.visitor_id WHERE c.kind <> 'set'),
tot AS (SELECT id, count(*) AS n FROM cand GROUP BY id), freq AS (SELECT id, value, count(*) AS hits FROM cand GROUP BY id, value),
cmp AS (
  SELECT pairs.id, pairs.visitor_id, p.name, p.prior, {_SIM} AS sim,
    CASE WHEN p.kind = 'set' THEN 0.05 ELSE least(greatest((coalesce(hits, 0) + 0.5) / (coalesce(tot.n, 0) + 1.0), 1e-4), 0.9999) END AS u
  FROM pairs JOIN comp p ON p.id = pairs.id JOIN comp t ON t.id = pairs.visitor_id AND t.name = p.name AND t.kind = p.kind
  LEFT JOIN freq ON freq.id = p.id AND freq.value = p.value AND p.kind <> 'set' LEFT JOIN tot ON tot.id = p.id
)
SELECT id, visitor_id, round(sum({_W} ORDER BY name), 6) AS score, CAST(count(*) AS INT) AS compared FROM cmp GROUP BY id, visitor_id"""
_JOINED = "CASE WHEN elems IS NOT NULL THEN coalesce(array_to_string(elems, ','), '') END AS elems"
_BLOCKS = "bi AS (SELECT DISTINCT lower(trim(key)) AS key, lower(trim(visitor_id)) AS visitor_id FROM blocking_index WHERE key IS NOT NULL AND visitor_id IS NOT NULL)"
_SHAKES = "[" + ", ".join("NULL" if h is None else f"'{h}'" for h in HANDSHAKES) + "]"
_REQ = f"""{_OBS}, req AS (SELECT id, CASE WHEN id % 11 = 0 THEN 'curl/8.4.0' ELSE user_agent END AS agent, ({_SHAKES}::VARCHAR[])[(id % {len(HANDSHAKES)} + 1)::INT] AS ja4,
  CASE WHEN id % 7 = 0 THEN '34.120.5.' WHEN id % 7 = 1 THEN '13.70.9.' ELSE '198.51.100.' END || (id % 5) AS ip FROM obs)"""


def _marks(words: list[str]) -> str:
    return " OR ".join(f"contains(lower(agent), '{w}')" for w in words)


_AGENT = f"CASE WHEN agent IS NULL THEN NULL WHEN {_marks(signals.SCRIPT_MARKS)} THEN 'automation' WHEN {_marks(signals.BROWSER_MARKS)} THEN 'browser' ELSE 'unknown' END"
_SHAPE = "CASE WHEN regexp_matches(split_part(ja4, '_', 1), '^.{4}[0-9]{4}.{2}') THEN ja4[1:4] || ja4[9:10] END"
_STACK = f"""CASE WHEN ja4 IS NULL THEN NULL WHEN {_SHAPE} IS NULL THEN 'unknown' WHEN ja4[5:6]::INT < 10 OR ja4[7:8]::INT < 10 THEN 'automation'
    WHEN {_SHAPE} IN ('t13dh2', 'q13dh3') THEN 'browser' ELSE 'automation' END"""
_RISK = "CASE WHEN ip LIKE '34.%' OR ip LIKE '13.7_.%' THEN 'high' ELSE 'low' END"
_ASN = ", ".join(f"({k}, {a if a is not None else 'NULL'}, {repr(o) if o else 'NULL'})" for k, a, o in FEED)
_PAD = {n: bytes(b ^ x for b in b"key".ljust(64, b"\0")).hex() for n, x in (("in", 0x36), ("out", 0x5C))}


def _hmac(message: str) -> str:
    return f"sha256(unhex('{_PAD['out']}') || unhex(sha256(unhex('{_PAD['in']}') || {message})))"


_LEARNED = f"""{_DECIDED},
learned AS (SELECT name, count(*) FILTER (sim >= 0.5) AS agree, count(*) AS total FROM cmp JOIN best USING (id, visitor_id) WHERE decision = 'match' GROUP BY name),
again AS (SELECT cmp.id, cmp.visitor_id, cmp.name, sim, u, CASE WHEN coalesce(total, 0) = 0 THEN cmp.prior ELSE least(greatest((agree + 20 * cmp.prior) / (total + 20), 1e-4), 0.9999) END AS prior
  FROM cmp LEFT JOIN learned USING (name))"""
_JSON = "'{' || concat_ws(',', " + ", ".join(f"""CASE WHEN {c} IS NOT NULL THEN '"{c}":' || to_json({c})::VARCHAR END""" for c in sorted(COLUMNS)) + ") || '}'"
#: The batch form: visitors are texts, blocks hold the least ids first, new devices that share a key take the id of the first of them.
_BATCH = f"""{_DECIDED.replace("SELECT key, id AS visitor_id FROM", "SELECT key, id::VARCHAR AS visitor_id FROM").replace("ORDER BY ts, id) AS r", "ORDER BY id::VARCHAR) AS r").replace("t.id = pairs.visitor_id", "t.id::VARCHAR = pairs.visitor_id").replace("SELECT DISTINCT id FROM comp WHERE id NOT IN (FROM lib)", "SELECT id FROM obs WHERE id NOT IN (FROM lib)")},
mint AS (SELECT id, ts, sha256({_JSON}) AS minted FROM obs),
fresh AS (SELECT best.id, ts, minted FROM best JOIN mint USING (id) WHERE decision = 'new_device'),
head AS (SELECT key, min((ts, id, minted)) AS h FROM fresh JOIN keys USING (id) GROUP BY key),
made AS (SELECT id, coalesce(min(h)[3], any_value(minted)) AS made FROM fresh LEFT JOIN keys USING (id) LEFT JOIN head USING (key) GROUP BY id),
batch AS (SELECT best.*, CASE WHEN decision = 'new_device' THEN made ELSE visitor_id END AS resolved FROM best LEFT JOIN made USING (id))"""


def _band(key: str, bounds: tuple[int, int]) -> str:
    n = f"count(*) OVER (PARTITION BY {key}, decision = 'new_device' ORDER BY s RANGE BETWEEN 3600 PRECEDING AND CURRENT ROW)"
    return f"CASE WHEN decision <> 'new_device' OR {key} IS NULL THEN 'low' WHEN {n} >= {bounds[1]} THEN 'high' WHEN {n} >= {bounds[0]} THEN 'medium' ELSE 'low' END"


ORACLES = {
    "score_learned": f"WITH {_LEARNED} SELECT id, visitor_id, round(sum({_W} ORDER BY name), 6) AS score, CAST(count(*) AS INT) AS compared FROM again GROUP BY id, visitor_id",
    "recall_counts": f"WITH {_PAIRS} SELECT id, least(count(*), 1024) AS kept, count(*) - least(count(*), 1024) AS dropped FROM pairs WHERE visitor_id % 5 <> 0 GROUP BY id",
    "nonce_issue": f"WITH {_OBS} SELECT id, substr({_hmac('encode(id::VARCHAR)')}, 1, 32) AS nonce, ts + 30000 AS expires_ms FROM obs",
    "exact_matches": f"WITH {_OBS} SELECT sha256({_JSON}) AS visitor_id, count(*) AS seen_count FROM obs GROUP BY 1",
    "identify_batches": f"WITH {_BATCH} SELECT id, resolved AS visitor_id, decision, round({_CONFIDENCE}, 6) AS confidence FROM batch",
    "eval_rates": f"""WITH {_BATCH},
        o AS (SELECT id, resolved AS v FROM batch UNION ALL SELECT id, id::VARCHAR FROM lib), t AS (SELECT o.id, v, device_id, obs.ts, o.id::VARCHAR AS nm FROM o JOIN obs USING (id)),
        own AS (SELECT v, min((ts, nm, device_id)) AS o FROM t GROUP BY v), st AS (SELECT device_id, min((ts, nm)) AS s FROM t GROUP BY device_id),
        j AS (SELECT t.nm <> st.s[2] AS revisit, t.nm = own.o[2] AS first, t.device_id = own.o[3] AS mine, t.device_id FROM t JOIN own USING (v) JOIN st ON st.device_id = t.device_id),
        n AS (SELECT count(*) AS observations, count(DISTINCT device_id) AS devices, count(*) FILTER (revisit) AS revisits, count(*) FILTER (revisit AND mine AND NOT first) AS stable,
          count(*) FILTER (NOT mine) AS collisions, count(*) FILTER (first) AS minted FROM j)
        SELECT *, CASE WHEN revisits = 0 THEN 1.0 ELSE stable / revisits END AS stability_rate, CASE WHEN observations = 0 THEN 0.0 ELSE collisions / observations END AS collision_rate FROM n""",
    "velocity_gate": f"""WITH {_BATCH}, {_REQ[_REQ.index("req AS"):]},
        v AS (SELECT id, decision, ip, {_SHAPE} AS shape, ts // 1000 AS s FROM batch JOIN req USING (id) JOIN (SELECT id, ts FROM obs) USING (id))
        SELECT id, {_band('ip', (5, 20))} AS new_device_velocity, {_band('shape', (100, 400))} AS new_device_velocity_ja4 FROM v""",
    "stored_components": f"WITH {_COMP} SELECT id, name, kind, cat, num, {_JOINED} FROM comp",
    "template_components": """
        WITH t AS (SELECT arg_max(components, last_seen) AS c FROM templates WHERE visitor_id IS NOT NULL GROUP BY visitor_id),
        j AS (SELECT c::JSON AS c FROM t WHERE json_valid(c) AND json_type(CASE WHEN json_valid(c) THEN c END) = 'OBJECT'),
        m AS (SELECT e.key AS name, CASE WHEN json_type(e.value) = 'OBJECT' THEN e.value->'value' ELSE e.value END AS v FROM j, json_each(j.c) e),
        k AS (SELECT name, v, json_type(v) AS t, CASE WHEN name IN ('fonts', 'plugins') THEN 'set' WHEN name IN ('cpu_cores', 'device_memory', 'screen') THEN 'numeric' ELSE 'category' END AS kind FROM m),
        x AS (SELECT name, kind, CASE WHEN kind = 'set' THEN NULL WHEN kind = 'numeric' THEN round((v->>'$')::DOUBLE)::BIGINT::VARCHAR ELSE v->>'$' END AS value FROM k
          WHERE CASE kind WHEN 'set' THEN t = 'ARRAY' WHEN 'numeric' THEN t IN ('BIGINT', 'UBIGINT', 'DOUBLE') ELSE t IN ('VARCHAR', 'BOOLEAN', 'BIGINT', 'UBIGINT', 'DOUBLE') END)
        SELECT name, kind, count(*) AS n, count(DISTINCT value) AS values FROM x GROUP BY name, kind""",
    "blocking_scalar_keys": f"WITH {_COMP}, {_SCALAR_KEYS} SELECT id, key FROM scalar_keys",
    "minhash_band_keys": f"WITH {_COMP}, {_BANDS} SELECT id, key FROM band_keys",
    "candidate_pairs": f"WITH {_PAIRS} SELECT id, visitor_id FROM pairs",
    "value_frequency": f"WITH {_COMP} SELECT value, count(*) AS hits FROM comp WHERE kind <> 'set' GROUP BY value",
    "fs_candidate_scores": f"WITH {_SCORES} SELECT id, visitor_id, round(score, 6) AS score, compared FROM scored",
    "score_decision": f"""WITH {_DECIDED} SELECT id, CASE WHEN decision <> 'new_device' THEN visitor_id END AS visitor_id, decision, round(score, 6) AS score, compared,
        coalesce(decision = 'match' AND second >= 12 AND score - second < 2, false) AS collision_risk, round({_CONFIDENCE}, 6) AS confidence FROM best""",
    "score_block_scope": f"WITH {_BLOCK}",
    "agreement_rates": f"WITH {_DECIDED} SELECT name, count(*) FILTER (sim >= 0.5) AS agree, count(*) AS total FROM cmp JOIN best USING (id, visitor_id) WHERE decision = 'match' GROUP BY name",
    "template_fold": f"""WITH {_COMP}, l AS (SELECT *, row_number() OVER (PARTITION BY device_id, name ORDER BY ts DESC, id DESC) AS r FROM comp)
        SELECT device_id AS visitor_id, name, kind, cat, num, {_JOINED}, ts AS fresh FROM l WHERE r = 1 AND device_id IS NOT NULL""",
    "record_counters": f"WITH {_OBS} SELECT device_id AS visitor_id, min(ts) AS first_seen, max(ts) AS last_seen, count(*) AS observation_count FROM obs WHERE device_id IS NOT NULL GROUP BY device_id",
    "cap_evict": """WITH r AS (SELECT visitor_id, max(last_seen) AS last_seen FROM templates WHERE visitor_id IS NOT NULL GROUP BY visitor_id),
        n AS (SELECT *, row_number() OVER (ORDER BY last_seen DESC, visitor_id) AS k FROM r) SELECT visitor_id, last_seen FROM n WHERE k <= (SELECT count(*) // 2 FROM r)""",
    "template_retention": f"""WITH {_BLOCKS}, r AS (SELECT visitor_id, max(last_seen) AS last_seen FROM templates WHERE visitor_id IS NOT NULL GROUP BY visitor_id),
        b AS (SELECT max(last_seen) - 2592000000 AS t FROM r), g AS (SELECT visitor_id FROM r, b WHERE last_seen < t)
        SELECT (SELECT count(*) FROM r, b WHERE last_seen >= t) AS templates, (SELECT count(*) FROM bi WHERE visitor_id NOT IN (FROM g)) AS entries""",
    "capped_index": f"WITH {_BLOCKS} SELECT key, least(count(*), 1024) AS kept, count(*) - least(count(*), 1024) AS dropped FROM bi GROUP BY key",
    "index_rows": f"WITH {_BLOCKS}, n AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY visitor_id) AS r FROM bi) SELECT key, visitor_id FROM n WHERE r <= 1024",
    "ua_class": f"WITH {_REQ} SELECT id, {_AGENT} AS class FROM req",
    "ja4_class": f"WITH {_REQ} SELECT id, {_SHAPE} AS shape, {_STACK} AS stack FROM req",
    "tls_consistency": f"""WITH {_REQ}, t AS (SELECT id, agent, CASE WHEN id % 13 <> 0 THEN ja4 END AS ja4, CASE WHEN id % 13 <> 0 THEN ip END AS ip FROM req),
        c AS (SELECT id, {_RISK} AS ip_risk, {_AGENT} AS a, coalesce({_STACK}, 'unknown') AS s FROM t),
        d AS (SELECT id, ip_risk, CASE WHEN s = 'unknown' THEN 'degraded' WHEN (s = 'browser' AND a = 'automation') OR (s = 'automation' AND a = 'browser') THEN 'mismatch' ELSE 'consistent' END AS tls_consistency FROM c)
        SELECT *, (0.5 + CASE tls_consistency WHEN 'consistent' THEN 0.05 WHEN 'mismatch' THEN -0.5 ELSE 0 END)::DOUBLE AS confidence FROM d""",
    "asn_risk": f"""WITH {_REQ}, feed(k, asn, owner) AS (VALUES {_ASN}),
        o AS (SELECT id, {_RISK} AS r, CASE WHEN asn IN ({', '.join(map(str, signals.HOSTING_ASNS))}) OR {' OR '.join(f"contains(lower(owner), '{w}')" for w in signals.HOSTING_WORDS)} THEN 'high' ELSE 'low' END AS owner_risk
          FROM req JOIN feed ON k = id % 5)
        SELECT id, owner_risk, CASE WHEN owner_risk = 'high' THEN 'high' ELSE r END AS ip_risk FROM o""",
    "nonce_outcome": f"""WITH {_OBS}, u AS (SELECT id, ts, ts + id % 40 * 1000 AS used_ms, id * 2 AS use_id FROM obs UNION ALL SELECT id, ts, ts + 29999, id * 2 + 1 FROM obs WHERE id % 3 = 0),
        o AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY used_ms, use_id) AS r FROM u)
        SELECT 'n' || id AS nonce, use_id, used_ms, CASE WHEN id % 17 = 0 THEN 'unknown' WHEN used_ms >= ts + 30000 THEN 'expired' WHEN r > 1 THEN 'reused' ELSE 'valid' END AS outcome FROM o""",
    "hmac_probe": f"WITH {_OBS} SELECT id, {_hmac('encode(id::VARCHAR)')} AS digest, {_hmac("unhex(lpad(to_hex(ts), 16, '0')) || encode(id::VARCHAR)")} AS signature FROM obs",
}
