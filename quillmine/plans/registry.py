"""Query name -> builder and oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Builder = Callable[[SparkSession, str], DataFrame]
_BUILDERS: dict[str, Builder] = {}
_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Builder], Builder]:
    """Registers a builder (spark, sf_dir) -> DataFrame under a name, with the SQL that must agree with it."""

    def put(build: Builder) -> Builder:
        if name in _BUILDERS:
            raise ValueError(f"query {name} is registered twice")
        _BUILDERS[name] = build
        if sql:
            _SQL[name] = sql
        return build

    return put


def queries() -> dict[str, Builder]:
    _load()
    return dict(_BUILDERS)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_SQL)


def _load() -> None:
    import quillmine.plans.catalog  # noqa: F401
