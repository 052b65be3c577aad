"""Passive signals: what a client claims, what its handshake shows, where its address lies."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.cleaning import _col, stripped
from ..functions.net import ipv4_number, is_ipv4

#: Marks of scripting clients and of browsers in a lower-cased user agent.
SCRIPT_MARKS = ["curl", "wget", "python", "go-http", "java", "okhttp", "libwww", "node-fetch", "axios"]
BROWSER_MARKS = ["mozilla", "chrome", "firefox", "safari", "edg", "opera"]
#: Handshake shapes (protocol, version, SNI, ALPN) of browsers; the least number of ciphers and of extensions.
BROWSER_SHAPES = ["t13dh2", "q13dh3"]
LEAST_CIPHERS, LEAST_EXTENSIONS = 10, 10
#: Change of confidence where claim and handshake agree, and where they contradict.
AGREES, CONTRADICTS = 0.05, -0.5
#: Hosting networks as (address, prefix length), hosting systems, and words in their owners' names.
HOSTING_BLOCKS = [("34.0.0.0", 8), ("35.0.0.0", 8), ("52.0.0.0", 8), ("13.64.0.0", 11)]
HOSTING_ASNS = [16509, 14618, 15169, 396982, 8075, 14061, 16276, 24940, 63949, 20473, 13335]
HOSTING_WORDS = ["amazon", "google", "microsoft", "digitalocean", "ovh", "hetzner", "linode", "vultr", "cloud", "hosting", "datacenter", "data center"]
#: Networks that are no network of a provider: loopback, private and link-local ones.
OWN_BLOCKS = [("127.0.0.0", 8), ("10.0.0.0", 8), ("172.16.0.0", 12), ("192.168.0.0", 16), ("169.254.0.0", 16)]


def _ascii_lower(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _has_any(c: Column, words: Sequence[str]) -> Column:
    return c.rlike("|".join(w.replace("-", r"\-") for w in words))


def agent_class(agent: Column | str) -> Column:
    """``automation`` (wins), ``browser`` or ``unknown`` by marks in a user agent; null stays null."""
    a = _ascii_lower(_col(agent))
    return F.when(a.isNotNull(), F.when(_has_any(a, SCRIPT_MARKS), "automation").when(_has_any(a, BROWSER_MARKS), "browser").otherwise("unknown"))


def handshake_class(ja4: Column | str) -> Column:
    """Protocol, version, SNI and ALPN of a handshake digest (its first part); null when malformed."""
    a = F.substring_index(_col(ja4), "_", 1)
    shape = F.concat(F.substring(a, 1, 4), F.substring(a, 9, 2))
    return F.when((F.length(a) >= 10) & a.substr(5, 4).rlike(r"^(\+[0-9]|[0-9]{2})(\+[0-9]|[0-9]{2})$"), shape)


def stack_class(ja4: Column | str) -> Column:
    """``browser``, ``automation`` or ``unknown`` by a handshake's structure; null stays null."""
    j, shape = _col(ja4), handshake_class(ja4)
    few = (F.substring(j, 5, 2).try_cast("int") < LEAST_CIPHERS) | (F.substring(j, 7, 2).try_cast("int") < LEAST_EXTENSIONS)
    known = F.when(shape.isNull(), "unknown").when(few, "automation").when(shape.isin(BROWSER_SHAPES), "browser").otherwise("automation")
    return F.when(j.isNotNull(), known)


def consistency(agent: Column | str, ja4: Column | str) -> Column:
    """``degraded`` without a usable handshake, ``mismatch`` where claim and handshake contradict, else ``consistent``."""
    claim, seen = agent_class(agent), stack_class(ja4)
    against = ((seen == "browser") & (claim == "automation")) | ((seen == "automation") & (claim == "browser"))
    return F.when(F.coalesce(seen, F.lit("unknown")) == "unknown", "degraded").when(F.coalesce(against, F.lit(False)), "mismatch").otherwise("consistent")


def consistent(state: Column | str) -> Column:
    """False for a mismatch only."""
    return F.coalesce(_col(state) != "mismatch", F.lit(True))


def adjustment(state: Column | str) -> Column:
    s = _col(state)
    return F.when(s == "consistent", AGREES).when(s == "mismatch", CONTRADICTS).otherwise(0.0)


def fused(confidence: Column | str, change: Column) -> Column:
    return F.least(F.greatest(_col(confidence) + change, F.lit(0.0)), F.lit(1.0))


def in_block(number: Column, network: str, prefix: int) -> Column:
    """Whether an address as number lies in a network; every one does in a prefix of 0."""
    a, b, c, d = map(int, network.split("."))
    mask = (0xFFFFFFFF << (32 - prefix)) & 0xFFFFFFFF if prefix else 0
    return number.bitwiseAND(mask) == ((a << 24 | b << 16 | c << 8 | d) & mask)


def address_risk(ip: Column | str, blocks: Sequence[tuple[str, int]] = tuple(HOSTING_BLOCKS)) -> Column:
    """``high`` for addresses in hosting networks, else ``low`` (also for IPv6, missing and unreadable ones)."""
    s = stripped(ip)
    n = ipv4_number(s)
    own = F.lit(False)
    for b in OWN_BLOCKS:
        own = own | in_block(n, *b)
    hosted = F.lit(False)
    for b in blocks:
        hosted = hosted | in_block(n, *b)
    return F.when(is_ipv4(s) & ~own & hosted, "high").otherwise("low")


def owner_risk(asn: Column | str, owner: Column | str) -> Column:
    """``high`` for hosting systems or owners whose name holds a hosting word (looked at whatever the system), else ``low``."""
    by_name = _has_any(F.lower(_col(owner)), HOSTING_WORDS)
    return F.when(F.coalesce(_col(asn).isin(HOSTING_ASNS), F.lit(False)) | F.coalesce(by_name, F.lit(False)), "high").otherwise("low")


def raised(first: Column, second: Column) -> Column:
    """The higher of two risk bands."""
    rank = lambda c: F.when(c == "high", 2).when(c == "medium", 1).otherwise(0)
    return F.when(rank(second) > rank(first), second).otherwise(first)


def signals(df: DataFrame, agent: str, ja4: str, ip: str, trusted: Column | None = None) -> DataFrame:
    """``df`` with ``ip_risk``, ``tls_consistency`` and ``confidence_change``; where ``trusted`` is false both inputs are null."""
    ok = F.lit(True) if trusted is None else trusted
    j, a = F.when(ok, F.col(ja4)), F.when(ok, F.col(ip))
    state = consistency(agent, j)
    return df.withColumns({"ip_risk": address_risk(a), "tls_consistency": state, "confidence_change": adjustment(state)})
