"""Named queries over the driver tables, each next to the SQL that states its result."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidemark.plans.fmt import nudge_rounds
from tidemark.session import use_utc
from tidemark.sources.views import CTE, Views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def with_views(sql: str, *names: str) -> str:
    """Prefix the SQL definitions of the named domain views (and what they need)."""
    ordered: list[str] = []

    def add(name: str) -> None:
        needs, _ = CTE[name]
        for n in needs:
            add(n)
        if name not in ordered:
            ordered.append(name)

    for n in names:
        add(n)
    if not ordered:
        return sql
    body = ",\n".join(f"{n} AS ({CTE[n][1]})" for n in ordered)
    head = "WITH RECURSIVE " if "RECURSIVE" in sql else "WITH "
    rest = sql.strip().removeprefix("WITH RECURSIVE").removeprefix("WITH ").strip() if sql.strip().startswith("WITH") else None
    return f"{head}{body}" + (f",\n{rest}" if rest is not None else f"\n{sql.strip()}")


def query(name: str, sql: str | None = None, views: tuple[str, ...] = ()):
    """Register a query; the decorated function gets a :class:`Views`."""

    def wrap(fn: Callable[[Views], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(Views(use_utc(spark), sf_dir))

        run.__doc__ = fn.__doc__
        run.__name__ = name
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = nudge_rounds(with_views(sql, *views))
        return fn

    return wrap
