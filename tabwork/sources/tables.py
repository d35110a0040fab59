"""CSV scans and sinks, manifests, stored results and models."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str | None = None, **options) -> DataFrame:
    """CSV with a header row. Types are inferred, at the price of a second read, only without a schema.

    NaN becomes null, the one missing value of the operators.
    """
    reader = spark.read.options(header=True, **options)
    df = reader.schema(schema).csv(path) if schema is not None else reader.option("inferSchema", True).csv(path)
    floats = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    return df.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in floats}) if floats else df


def describe_source(df: DataFrame, name: str) -> DataFrame:
    """One row: source name, row and column count, column names."""
    return df.agg(
        F.lit(name).alias("source"),
        F.count(F.lit(1)).alias("row_count"),
        F.lit(len(df.columns)).cast("bigint").alias("column_count"),
        F.lit(",".join(df.columns)).alias("columns"),
    )


def preview(df: DataFrame, n: int = 5) -> DataFrame:
    return df.limit(n)


def write_csv(df: DataFrame, path: str) -> None:
    """One CSV part per partition, each with the header row."""
    df.write.options(header=True, timestampFormat="yyyy-MM-dd HH:mm:ss", timestampNTZFormat="yyyy-MM-dd HH:mm:ss").mode("overwrite").csv(path)


def write_with_manifest(df: DataFrame, path: str, meta: Mapping[str, str]) -> None:
    """CSV data, and beside it one JSON row with the caller's facts, column names and time of writing."""
    write_csv(df, f"{path}/data")
    facts = F.create_map(*[F.lit(str(x)) for pair in meta.items() for x in pair]) if meta else F.lit(None)
    df.sparkSession.range(1).select(
        F.current_timestamp().alias("written_at"),
        F.lit(len(df.columns)).alias("column_count"),
        F.array(*[F.lit(c) for c in df.columns]).alias("columns"),
        facts.alias("meta"),
    ).coalesce(1).write.mode("overwrite").json(f"{path}/manifest")


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.json(f"{path}/manifest")


class ResultStore:
    """Result tables by kind and run under one shared folder.

    A run is a folder of its own, so writing it again replaces it and lost tasks
    can be retried; its facts are one small file in the run list.
    """

    def __init__(self, spark: SparkSession, base: str):
        self.spark, self.base = spark, base.rstrip("/")

    def save(self, df: DataFrame, kind: str, run_id: str, session: str = "", meta: Mapping[str, str] | None = None) -> None:
        df.write.mode("overwrite").parquet(f"{self.base}/results/{kind}/run_id={run_id}")
        facts = F.to_json(F.create_map(*[F.lit(str(x)) for pair in (meta or {"": ""}).items() for x in pair]))
        row = self.spark.range(1).select(
            F.lit(session).alias("session"), F.current_timestamp().alias("saved_at"),
            F.lit(len(df.columns)).alias("column_count"), facts.alias("meta"),
        )
        row.coalesce(1).write.mode("overwrite").parquet(f"{self.base}/runs/kind={kind}/run_id={run_id}")

    def load(self, kind: str, run_id: str | None = None) -> DataFrame:
        """All runs of a kind with their run_id, or one run; the partition filter reads its folder only."""
        table = self.spark.read.parquet(f"{self.base}/results/{kind}")
        return table.filter(F.col("run_id") == run_id) if run_id else table

    def list(self, kind: str | None = None, session: str | None = None) -> DataFrame:
        runs = self.spark.read.parquet(f"{self.base}/runs")
        if kind:
            runs = runs.filter(F.col("kind") == kind)
        return runs.filter(F.col("session") == session) if session else runs


def save_model(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)
