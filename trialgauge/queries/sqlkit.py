"""Assemble oracle SQL: name the views a query needs, get one WITH statement."""

from __future__ import annotations

import re

from ..plans.clinical_views import VIEW_SQL

_EXTRA: dict[str, str] = {}


def define(name: str, body: str) -> None:
    """Register a reusable common table expression; later ones may use earlier ones."""
    _EXTRA[name] = body


def oracle(body: str, **local: str) -> str:
    """Prefix ``body`` with exactly the common table expressions it mentions."""
    known = {**VIEW_SQL, **_EXTRA, **local}
    needed: list[str] = []

    def visit(sql: str) -> None:
        for name in re.findall(r"\b[a-z]_[a-z0-9_]+\b", sql):
            if name in known and name not in needed:
                visit(known[name])
                if name not in needed:
                    needed.append(name)

    visit(body)
    if not needed:
        return body
    ctes = ", ".join(f"{n} AS MATERIALIZED ({known[n]})" for n in needed)
    return f"WITH {ctes} {body}"
