"""Frequency tables, and statistics per key put back on rows of uneven keys."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from tabwork.functions.columns import melt
from tabwork.operators.ordered import with_blocks

HOT_SHARE = 1000
SALTS = 256


def value_counts(df: DataFrame, *cols: str, name: str = "n") -> DataFrame:
    """Rows per value; counts are combined before the shuffle."""
    return df.groupBy(*cols).agg(F.count(F.lit(1)).alias(name))


def attach(df: DataFrame, stats: DataFrame, keys: Sequence[str], weight: str) -> DataFrame:
    """Left join of per-key statistics on rows; weight is the row count of the key.

    Keys with more than a thousandth of all rows, of which there are fewer than
    a thousand, come by broadcast. Their rows get a spread-out second key that
    matches nothing, so the shuffle join of the other keys has no hot partition.
    """
    extra = [c for c in stats.columns if c not in keys]
    key = F.struct(*[F.col(c) for c in keys])
    packed = stats.select(key.alias("_key"), F.struct(*extra).alias("_val"), F.col(weight).alias("_w"))
    total = packed.agg(F.sum("_w").alias("t")).scalar()
    hot = packed.filter(F.col("_w") * HOT_SHARE > total).select("_key", F.col("_val").alias("_hot"))
    cold = packed.filter(F.col("_w") * HOT_SHARE <= total).select(
        "_key", F.lit(0).cast("long").alias("_salt"), F.col("_val").alias("_cold")
    )
    salt = F.when(F.col("_hot").isNull(), F.lit(0).cast("long")).otherwise(
        F.pmod(F.xxhash64(*[F.col(c) for c in df.columns]), F.lit(SALTS)) + 1
    )
    joined = (
        df.withColumn("_key", key)
        .join(F.broadcast(hot), "_key", "left")
        .withColumn("_salt", salt)
        .join(cold, ["_key", "_salt"], "left")
        .withColumn("_val", F.coalesce("_hot", "_cold"))
    )
    return joined.select(*df.columns, *[F.col("_val")[c].alias(c) for c in extra])


def quantiles(
    df: DataFrame, cols: Sequence[str], probs: dict[str, float], keys: Sequence[str] = ()
) -> DataFrame:
    """Exact interpolated quantiles per column (and key): (keys..., column, n, names...).

    Equal values are counted first and cut into blocks. The block totals show
    which blocks hold the wanted ranks, and only their values are sorted, so no
    task and no aggregation buffer holds a column.
    """
    cells = melt(df, cols, "double", keys).filter(~F.isnan("value"))
    counts = cells.groupBy(*keys, "column", "value").agg(F.count(F.lit(1)).alias("_n"))
    group = [*keys, "column"]
    parts = with_blocks(counts, ["value"], group)
    sums = parts.groupBy("_part").agg(F.sum("_n").alias("_size"))
    whole = Window.partitionBy(*[F.col(f"_part.{c}") for c in group])  # the blocks of one column
    placed = sums.select(
        "_part",
        "_size",
        F.sum("_size").over(whole).alias("n"),
        F.sum("_size").over(whole.orderBy("_part._block").rowsBetween(Window.unboundedPreceding, 0)).alias("_end"),
    )
    start = F.col("_end") - F.col("_size")
    wanted = F.lit(False)
    ranks: list[Column] = []
    for p in probs.values():
        rank = (F.col("n") - 1) * F.lit(float(p))
        for at in (F.floor(rank), F.ceil(rank)):
            ranks.append(at)
            wanted = wanted | ((start <= at) & (at < F.col("_end")))
    hit = placed.filter(wanted).select("_part", "n", start.alias("_start"))
    inside = Window.partitionBy("_part").orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
    found = parts.join(hit, "_part").withColumn("_upto", F.col("_start") + F.sum("_n").over(inside))
    picks = []
    for i, at in enumerate(ranks):
        here = (F.col("_upto") - F.col("_n") <= at) & (at < F.col("_upto"))
        picks.append(F.max(F.when(here, F.col("value"))).alias(f"_v{i}"))
    best = found.groupBy(*group).agg(F.max("n").alias("n"), *picks)
    out = []
    for i, (name, p) in enumerate(probs.items()):
        rank, lo, hi = (F.col("n") - 1) * F.lit(float(p)), F.col(f"_v{2 * i}"), F.col(f"_v{2 * i + 1}")
        out.append((lo + (hi - lo) * (rank - F.floor(rank))).alias(name))
    return best.select(*group, "n", *out)


def quantile_struct(df: DataFrame, cols: Sequence[str], probs: dict[str, float]) -> Column:
    """The quantiles of each column as one scalar struct: result[column][name]."""
    table = quantiles(df, cols, probs)
    fields = [
        F.max(F.when(F.col("column") == c, F.struct(*probs))).alias(c) for c in cols
    ]
    return table.agg(F.struct(*fields).alias("_q")).scalar()
