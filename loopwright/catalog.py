"""Registry of the checked queries: a Spark query and the SQL that must agree with it."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession

from loopwright.session import configure
from loopwright.views import VIEW_SQL, Tables

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def oracle_text(body: str, uses: Sequence[str]) -> str:
    """The SQL body with the derived views it uses in front."""
    views = [f"{name} AS ({VIEW_SQL[name]})" for name in uses]
    body = body.strip()
    if body.upper().startswith("WITH "):
        body = body[5:]
        return f"WITH {', '.join([*views, body])}"
    return f"WITH {', '.join(views)} {body}" if views else body


def query(name: str, sql: str | None = None, uses: Sequence[str] = ()):
    """Register a function of ``Tables`` under an operator id, with its SQL if it has one."""

    def register(build: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return build(Tables(configure(spark), sf_dir))

        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = run
        if sql:
            ORACLES[name] = oracle_text(sql, uses)
        return build

    return register
