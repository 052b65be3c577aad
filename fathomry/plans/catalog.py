"""All queries of the core by name, with their SQL."""

from __future__ import annotations

from . import checkin, identity, pipeline

FLAGSHIP = checkin.fanout_asof
QUERIES = {**pipeline.QUERIES, **checkin.QUERIES, **identity.QUERIES}
ORACLES = {**pipeline.ORACLES, **checkin.ORACLES, **identity.ORACLES}
