"""All registered queries and the SQL texts that check them."""

from __future__ import annotations

from tabletop.plans import answers, facts, transfer  # noqa: F401 - they register their queries
from tabletop.plans.answers import flagship
from tabletop.plans.register import CHECKS, QUERIES, Query
from tabletop.plans.surface import SAMPLES, STATEMENTS

__all__ = ["flagship", "oracles", "queries"]


def queries() -> dict[str, Query]:
    statements = {name: statement.run for name, statement in {**STATEMENTS, **SAMPLES}.items()}
    return {**QUERIES, **statements}


def oracles() -> dict[str, str]:
    return {**CHECKS, **{name: statement.oracle for name, statement in STATEMENTS.items()}}
