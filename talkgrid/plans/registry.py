"""Named queries: a Spark plan each, and the SQL it must agree with where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..session import ship_package
from .tables import Tables, with_views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles at the precision results are compared at; 12 digits first, so that noise never decides a tie."""
    return df.select(*[F.round(F.round(f.name, 12), digits).alias(f.name) if f.dataType.typeName() in ("double", "float") else F.col(f.name)
                       for f in df.schema.fields])


def query(name: str, sql: str | None = None, r: str = ""):
    """Register ``fn(tables) -> DataFrame`` under ``name``; ``sql`` may use the derived views.

    ``r`` names the columns the SQL side rounds; the Spark side rounds every double.
    """

    def register(fn: Callable[[Tables], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship_package(spark)
            return rounded(fn(Tables(spark, sf_dir)))

        QUERIES[name] = run
        if sql:
            body = with_views(sql)
            if r:
                body = f"select * replace ({', '.join(f'round({c}::decimal(38,12), 6)::double as {c}' for c in r.split())}) from ({body})"
            ORACLES[name] = body
        return fn

    return register
