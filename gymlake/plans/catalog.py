"""Registry of named queries: the Spark plan and the equivalent DuckDB SQL.

Each entry reads the driver tables (through the shared fixture derivations in
``gymlake.sources.fixtures``) so its work grows with the data.  ``oracle`` is a
SQL body over the domain tables; ``oracle_sql()`` prefixes the fixture CTEs.
Bodies may start with their own ``WITH`` list, which is appended to the
fixture CTEs.  An entry without SQL gets the driver's weaker rows-only check.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Callable

from pyspark.sql import DataFrame, SparkSession

from gymlake.sources import fixtures
from gymlake.sources.tables import Tables


@dataclass
class Entry:
    name: str
    build: Callable[[Tables], DataFrame]
    oracle: str | None
    tables: list[str] = field(default_factory=list)
    survey_ids: str = ""


REGISTRY: dict[str, Entry] = {}


def register(name: str, oracle: str | None, tables, survey_ids: str = ""):
    def deco(fn):
        REGISTRY[name] = Entry(name, fn, oracle, list(tables), survey_ids)
        return fn
    return deco


def _load_all():
    # importing the modules fills REGISTRY
    from gymlake.plans import (  # noqa: F401
        q_attendance, q_nutrition, q_scheduling, q_admin, q_foods, q_messages, q_reports,
        q_streaming, q_sources, q_directory, q_bundles, q_stored, q_rollups,
        q_drifted, q_bucketed)


def _run(e: Entry, spark: SparkSession, sf_dir: str) -> DataFrame:
    # dates, hours and day windows are wall-clock UTC values (as in get_spark)
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return e.build(Tables(spark, sf_dir))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load_all()
    return {name: (lambda spark, sf_dir, e=e: _run(e, spark, sf_dir)) for name, e in REGISTRY.items()}


def full_sql(entry: Entry) -> str:
    cte = fixtures.duckdb_cte(entry.tables)
    body = entry.oracle.strip()
    recursive = "WITH RECURSIVE"
    if body[:len(recursive)].upper() == recursive:
        return recursive + cte[4:].rstrip() + ",\n" + body[len(recursive):].lstrip()
    if body[:4].upper() == "WITH":
        if cte:
            return cte.rstrip() + ",\n" + body[4:].lstrip()
        return body
    return cte + body


def oracle_sql() -> dict[str, str]:
    _load_all()
    return {name: full_sql(e) for name, e in REGISTRY.items() if e.oracle}
