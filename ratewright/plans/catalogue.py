"""All core queries and their SQL, gathered from the modules of this package."""

from __future__ import annotations

from ratewright.plans import agreement, checks, datasets, fits, manifest, measures, reports, states, texts

MODULES = [measures, agreement, datasets, fits, reports, texts, states, manifest, checks]

QUERIES: dict = {}
SQL: dict[str, str] = {}
for _m in MODULES:
    QUERIES |= _m.QUERIES
    SQL |= _m.SQL

FLAGSHIP = QUERIES["flagship"]
