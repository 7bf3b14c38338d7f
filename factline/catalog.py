"""Registry of queries and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from factline import corpus

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None, facts: str = "", recursive: bool = False) -> Callable[[Query], Query]:
    """Register a query; ``facts`` names the projections that its SQL builds on."""

    def register(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            views = [corpus.SQL[x] for x in facts.split()]
            body = sql.strip()
            if views and body.upper().startswith("WITH "):
                body = body[5:]
                ORACLES[name] = f"WITH {'RECURSIVE ' * recursive}{', '.join(views)}, {body}"
            elif views:
                ORACLES[name] = f"WITH {', '.join(views)} {body}"
            else:
                ORACLES[name] = body
        return f

    return register


def load() -> None:
    """Import the modules that register queries."""
    from factline.plans import facts, graphs, joins, metrics, packing, planning, search, service, upkeep, windows  # noqa: F401
