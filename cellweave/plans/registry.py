"""Query registry: a Spark builder and, where SQL can say it, the oracle text for the same tables."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellweave.plans.tables import PRELUDE, Tables
from cellweave.scale import c
from cellweave.session import ship_package


@dataclass(frozen=True)
class Query:
    build: Callable[[Tables], DataFrame]
    sql: str | None
    rounded: tuple[str, ...]
    digits: int


REGISTRY: dict[str, Query] = {}


def query(name: str, sql: str | None = None, rnd: str = "", digits: int = 6):
    """Register a query; the columns in ``rnd`` are rounded alike on both sides."""

    def add(fn: Callable[[Tables], DataFrame]):
        assert name not in REGISTRY, name
        REGISTRY[name] = Query(fn, sql, tuple(rnd.split()), digits)
        return fn

    return add


def spark_callable(q: Query) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship_package(spark)
        out = q.build(Tables(spark, sf_dir))
        done = set(q.rounded)
        return out.select(*[F.round(c(n), q.digits).alias(n) if n in done else c(n) for n in out.columns])

    return run


def oracle_text(q: Query) -> str:
    body = q.sql.strip().rstrip(";")
    swap = ", ".join(f'round("{n}", {q.digits}) AS "{n}"' for n in q.rounded)
    star = f"* REPLACE ({swap})" if swap else "*"
    return f"WITH {PRELUDE}\nSELECT {star} FROM (\n{body}\n) AS result"
