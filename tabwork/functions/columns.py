"""Column lists by kind, and the long form of wide tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F, types as T

KINDS = ("number", "text", "datetime", "boolean", "other")


def kind_of(data_type: T.DataType) -> str:
    if isinstance(data_type, T.NumericType):
        return "number"
    if isinstance(data_type, (T.StringType, T.VarcharType, T.CharType)):
        return "text"
    if isinstance(data_type, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return "datetime"
    if isinstance(data_type, T.BooleanType):
        return "boolean"
    return "other"


def columns_of_kind(df: DataFrame, *kinds: str) -> list[str]:
    """Names of the columns whose type belongs to one of the kinds, in table order."""
    return [f.name for f in df.schema.fields if kind_of(f.dataType) in kinds]


def column_kind(df: DataFrame, name: str) -> str:
    return kind_of(df.schema[name].dataType)


def melt(df: DataFrame, cols: Sequence[str], cast: str, keys: Sequence[str] = ()) -> DataFrame:
    """Long form (keys..., column, value) of the non-null values of cols."""
    cells = df.select(*keys, *[F.col(c).cast(cast).alias(c) for c in cols])
    return cells.unpivot(list(keys), list(cols), "column", "value").filter(F.col("value").isNotNull())


def per_column(df: DataFrame, measures: dict[str, dict[str, Column]]) -> DataFrame:
    """One pass over df; one output row per column name, one field per aggregate."""
    rows = [
        F.struct(F.lit(name).alias("column"), *[expr.alias(key) for key, expr in fields.items()]).alias(f"_m{i}")
        for i, (name, fields) in enumerate(measures.items())
    ]
    wide = df.agg(*rows)
    return wide.select(F.inline(F.array(*[F.col(f"_m{i}") for i in range(len(rows))])))


def one_row(df: DataFrame, **aggregates: Column) -> Column:
    """The aggregates of df as a scalar struct: read once, usable in any expression."""
    return df.agg(F.struct(*[c.alias(k) for k, c in aggregates.items()]).alias("_one")).scalar()


def safe_div(a: Column, b: Column) -> Column:
    return F.try_divide(a.cast("double"), b.cast("double"))


def as_long(c: Column) -> Column:
    return c.cast("bigint")
