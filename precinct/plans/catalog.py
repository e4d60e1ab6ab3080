"""Registry of the named queries, each with the SQL text that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from precinct.plans.views import with_views

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, views: tuple[str, ...] = ()) -> Callable[[Query], Query]:
    """Register a query under its function name; `sql` may read the given views.

    Queries whose result depends on a seeded model have no SQL.
    """

    def register(run: Query) -> Query:
        QUERIES[run.__name__] = run
        if sql is not None:
            text = sql.strip()
            if views and text.startswith("WITH RECURSIVE "):
                known = with_views(*views).replace("WITH ", "WITH RECURSIVE ", 1)
                ORACLES[run.__name__] = known + ", " + text.removeprefix("WITH RECURSIVE ")
            elif views and text.startswith("WITH "):
                ORACLES[run.__name__] = with_views(*views) + ", " + text.removeprefix("WITH ")
            else:
                ORACLES[run.__name__] = f"{with_views(*views)} {text}" if views else text
        return run

    return register
