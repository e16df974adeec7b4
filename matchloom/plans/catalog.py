"""All queries of the match-analytics library, bound to the driver's tables, and the SQL that checks them."""

from __future__ import annotations

from matchloom.plans import assembled, audits, conforming, history, insight, modelling, storage

_MODULES = (history, assembled, conforming, insight, audits, storage, modelling)
QUERIES: dict = {name: fn for m in _MODULES for name, fn in m.QUERIES.items()}
ORACLES: dict[str, str] = {name: sql for m in _MODULES for name, sql in m.ORACLES.items()}
