"""All queries of the library, and their SQL."""

from __future__ import annotations

from . import accounts, cascades, dashboards, details, filters, library, listings, people, reports, resumes, stages, streams, texts

MODULES = (filters, stages, dashboards, texts, accounts, listings, streams, details, resumes, library, reports, cascades, people)


def queries() -> dict:
    return {name: f for m in MODULES for name, f in m.register.queries.items()}


def oracles() -> dict[str, str]:
    return {name: sql for m in MODULES for name, sql in m.register.oracles.items()}
