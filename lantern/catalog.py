"""All queries of the engine by name, with the SQL that checks them."""

from __future__ import annotations

from lantern.plans import acts, authority, dictionaries, documents, evaluation, evidence, maintenance, provisions, retrieval, rules, scans, temporal  # noqa: F401
from lantern.plans.registry import ORACLE_SQL, QUERIES  # noqa: F401

FLAGSHIP = "hybrid_search"
