"""All queries of the library and the SQL that checks them."""

from __future__ import annotations

from tessera.queries import aggregates, corpus, entities, evidence, flow, ingest, legal, search, selecting, texts  # noqa: F401
from tessera.queries.registry import QUERIES as REGISTERED

QUERIES = {name: q.build for name, q in REGISTERED.items()}
ORACLES = {name: q.sql for name, q in REGISTERED.items() if q.sql}
COVERS = {name: q.covers.split() for name, q in REGISTERED.items()}
