"""All registered queries: name -> (Spark function, DuckDB SQL or None)."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def register(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Decorator: the function answers query ``name``; sql is its DuckDB equivalent."""

    def add(f: Query) -> Query:
        if name in _QUERIES:
            raise ValueError(f"two queries named {name}")
        _QUERIES[name] = f
        if sql:
            _SQL[name] = sql
        return f

    return add


def _load() -> None:
    from viatrix.plans import all_plans  # noqa: F401  registers on import


def queries() -> dict[str, Query]:
    _load()
    return _QUERIES


def oracle_sql() -> dict[str, str]:
    _load()
    return _SQL


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return queries()["flagship_developments"](spark, sf_dir)
