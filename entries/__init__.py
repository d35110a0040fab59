"""Registered queries: each pairs a DataFrame job with the SQL it must equal."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


class Tables:
    """Parquet tables of one directory by attribute."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path.rstrip('/')}/{name}.parquet")


def query(name: str, sql: str | None = None, dbl: str = "", digits: int = 6):
    """Register fn(tables) under name, with its SQL when SQL can say it.

    dbl names the double columns, rounded on both sides because sums of doubles
    depend on their order.
    """
    names = dbl.split()

    def register(fn):
        if name in QUERIES:
            raise KeyError(name)

        def run(spark: SparkSession, path: str) -> DataFrame:
            df = fn(Tables(spark, path))
            return df.withColumns({c: F.round(F.col(c).cast("double"), digits) + F.lit(0.0) for c in names})

        QUERIES[name] = run
        if sql:
            swaps = ", ".join(f"round(cast({c} as double), {digits}) + 0.0::double as {c}" for c in names)
            ORACLE[name] = f"select * replace ({swaps}) from ({sql})" if names else sql
        return fn

    return register


def load_all() -> None:
    import importlib
    import pkgutil

    for module in pkgutil.iter_modules(__path__):
        importlib.import_module(f"{__name__}.{module.name}")
