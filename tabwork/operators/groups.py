"""Group statistics on rows: aggregated first, then attached."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from tabwork.functions.columns import safe_div
from tabwork.operators.lookup import attach
from tabwork.operators.ordered import running


def group_mean(
    df: DataFrame, key: str, val: str, name: str = "group_mean", source: DataFrame | None = None
) -> DataFrame:
    """The mean of val over the rows of the same key, on every row."""
    stats = (df if source is None else source).groupBy(key).agg(F.avg(val).alias(name), F.count(F.lit(1)).alias("_w"))
    return attach(df, stats, [key], "_w").drop("_w")


def lookup_stats(df: DataFrame, stats: DataFrame, keys: Sequence[str], weight: str) -> DataFrame:
    """Statistics by key on rows; a missing key or figure gives 0."""
    extra = [c for c in stats.columns if c not in keys]
    return attach(df, stats, keys, weight).na.fill(0, extra)


def group_deviation(df: DataFrame, key: str, val: str, source: DataFrame | None = None) -> DataFrame:
    """Deviation from the group mean, its absolute value, and the deviation in group sds."""
    stats = (df if source is None else source).groupBy(key).agg(
        F.avg(val).alias("_m"), F.stddev_samp(val).alias("_s"), F.count(F.lit(1)).alias("_w")
    )
    dev = F.col(val) - F.col("_m")
    name = f"{val}_{key}"
    out = attach(df, stats, [key], "_w").withColumns(
        {
            f"{name}_deviation": dev,
            f"{name}_abs_deviation": F.abs(dev),
            f"{name}_norm_deviation": dev / (F.coalesce(F.col("_s"), F.lit(0.0)) + 1e-8),
        }
    )
    return out.drop("_m", "_s", "_w")


def rank_table(df: DataFrame, val: str, key: Sequence[str] = ()) -> DataFrame:
    """Distinct values with their row count and average-tie rank share inside the key."""
    counts = df.filter(F.col(val).isNotNull()).groupBy(*key, val).agg(F.count(F.lit(1)).alias("_w"))
    cum = running(counts, {"_upto": ("_w", "sum")}, [val], key, totals={"_all": ("_w", "sum")}, cut_from=df)
    share = safe_div(F.col("_upto") - F.col("_w") + (F.col("_w") + 1) / 2, F.col("_all"))
    return cum.select(*key, val, "_w", share.alias("_share"))


def percent_rank_avg(
    df: DataFrame, val: str, key: Sequence[str] = (), name: str | None = None, source: DataFrame | None = None
) -> DataFrame:
    """Average-tie rank over the row count, over all rows or inside a key."""
    ranks = rank_table(df if source is None else source, val, key)
    out = attach(df, ranks, [*key, val], "_w").drop("_w")
    return out.withColumnRenamed("_share", name or f"{val}_rank")
