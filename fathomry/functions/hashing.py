"""Salted hashes and keyed digests as Column expressions."""

from __future__ import annotations

import hashlib
import secrets

from pyspark.sql import Column
from pyspark.sql import functions as F

from .cleaning import _col

SALT_BYTES = 16


def salt_from_secret(secret: str | bytes) -> bytes:
    """The first 16 bytes of the secret's SHA-256: the same hashes wherever the secret is the same."""
    return hashlib.sha256(secret.encode() if isinstance(secret, str) else secret).digest()[:SALT_BYTES]


def random_salt() -> bytes:
    return secrets.token_bytes(SALT_BYTES)


def blob(data: bytes) -> Column:
    return F.unhex(F.lit(data.hex()))


def utf8(c: Column | str) -> Column:
    return F.encode(_col(c), "UTF-8")


def salted_hash(text: Column | str, salt: bytes) -> Column:
    """Hex of SHA-256(salt, text); null stays null."""
    return F.sha2(F.concat(blob(salt), utf8(text)), 256)


def le64(n: Column | str) -> Column:
    """A bigint as eight bytes, least significant first."""
    h = F.lpad(F.hex(_col(n).cast("bigint")), 16, "0")
    return F.unhex(F.concat(*[F.substring(h, 15 - 2 * i, 2) for i in range(8)]))


def be64(n: Column | str) -> Column:
    return F.unhex(F.lpad(F.hex(_col(n).cast("bigint")), 16, "0"))


def hmac_sha256(key: bytes, message: Column) -> Column:
    """Hex of HMAC-SHA256 over a binary column, built from the hash alone."""
    k = (hashlib.sha256(key).digest() if len(key) > 64 else key).ljust(64, b"\0")
    inner = F.unhex(F.sha2(F.concat(blob(bytes(b ^ 0x36 for b in k)), message), 256))
    return F.sha2(F.concat(blob(bytes(b ^ 0x5C for b in k)), inner), 256)


def probe_digest(key: bytes, nonce: Column | str) -> Column:
    """What a client returns for a nonce."""
    return hmac_sha256(key, utf8(nonce))


def signature(key: bytes, issued_ms: Column | str, body: Column | str) -> Column:
    """Signature of a response: over the issue time (eight bytes, most significant first) and the body."""
    return hmac_sha256(key, F.concat(be64(issued_ms), utf8(body)))


def verified(expected: Column, candidate: Column) -> Column:
    """Whether a hex digest is the expected one, in either letter case; null and malformed ones are not."""
    return F.coalesce(F.lower(candidate) == expected, F.lit(False))
