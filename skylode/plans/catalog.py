"""All queries by name, and the SQL that must give the same rows."""

from __future__ import annotations

from skylode.plans import detection, evidence, leakage, lifecycle, manifests, review, storage

_MODULES = (detection, leakage, evidence, manifests, lifecycle, review, storage)
QUERIES = {k: f for m in _MODULES for k, f in m.QUERIES.items()}
ORACLES = {k: s for m in _MODULES for k, s in m.ORACLES.items()}
