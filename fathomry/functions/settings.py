"""Settings in layers: defaults, then a TOML file, then the environment, then the session."""

from __future__ import annotations

import os
import tomllib
from collections.abc import Mapping
from dataclasses import dataclass, fields, replace
from pathlib import Path

from pyspark.sql import SparkSession

PREFIX = "FATHOMRY_"


@dataclass(frozen=True)
class Settings:
    """What a run is told from outside. Blank values count as unset; values that aren't of a field's type are errors."""

    salt_secret: str = ""
    signing_secret: str = ""
    nonce_ttl_ms: int = 30_000
    retention_days: int = 0
    block_cap: int = 1024
    trust_proxy: bool = False
    tokenizer_folder: str = "/opt/tokenizers"


def _as(kind: str, name: str, value: object) -> object:
    text = str(value).strip()
    if kind == "bool":
        if text.lower() not in ("true", "false", "1", "0", "yes", "no", "on", "off"):
            raise ValueError(f"{name}: not a flag: {text}")
        return text.lower() in ("true", "1", "yes", "on")
    return int(text) if kind == "int" else text


def load(path: str | None = None, env: Mapping[str, str] | None = None, spark: SparkSession | None = None) -> Settings:
    """Settings from all layers; the later ones win. Session keys are ``spark.fathomry.<name>``; unknown names in the file are errors."""
    kinds = {f.name: str(f.type) for f in fields(Settings)}
    found: dict[str, object] = {}
    if path and Path(path).exists():
        layer = tomllib.loads(Path(path).read_text(encoding="utf-8"))
        if extra := sorted(layer.keys() - kinds.keys()):
            raise ValueError(f"unknown settings: {extra}")
        found |= layer
    env = os.environ if env is None else env
    found |= {n: env[PREFIX + n.upper()] for n in kinds if env.get(PREFIX + n.upper(), "").strip()}
    if spark is not None:
        found |= {n: v for n in kinds if (v := spark.conf.get(f"spark.fathomry.{n}", "").strip())}
    return replace(Settings(), **{n: _as(kinds[n], n, v) for n, v in found.items() if str(v).strip()})
