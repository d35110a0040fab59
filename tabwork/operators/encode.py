"""Encodings of categorical columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from tabwork.functions.columns import safe_div
from tabwork.operators.lookup import attach
from tabwork.operators.ordered import number_rows, running


def levels(df: DataFrame, col: str, limit: int) -> list[str] | None:
    """The sorted distinct values when there are at most `limit`, else None; reads limit + 1 values at most."""
    found = [r[0] for r in df.select(col).filter(F.col(col).isNotNull()).distinct().limit(limit + 1).collect()]
    return sorted(found) if len(found) <= limit else None


def one_hot(
    df: DataFrame,
    col: str,
    limit: int = 15,
    dummy_na: bool = True,
    drop_first: bool = False,
    source: DataFrame | None = None,
) -> DataFrame:
    """0/1 column per value, and one for null. A column of more than `limit` values is an error: use label codes or a higher limit."""
    values = levels(df if source is None else source, col, limit)
    if values is None:
        raise ValueError(f"{col} has more than {limit} values")
    kept = values[1:] if drop_first else values
    flags = {f"{col}_onehot_{v}": (F.col(col).eqNullSafe(F.lit(v))).cast("bigint") for v in kept}
    if dummy_na:
        flags[f"{col}_onehot_nan"] = F.col(col).isNull().cast("bigint")
    return df.withColumns(flags)


def label_codes(df: DataFrame, col: str, missing: str = "missing") -> DataFrame:
    """Distinct values with their rank from 0 in sort order, null counted as the missing word."""
    filled = df.select(F.coalesce(F.col(col).cast("string"), F.lit(missing)).alias("_v"))
    counts = filled.groupBy("_v").agg(F.count(F.lit(1)).alias("_w"))
    numbered = number_rows(counts, ["_v"], name="_rn")
    return numbered.select("_v", "_w", (F.col("_rn") - 1).alias("_code"))


def label_encode(
    df: DataFrame, col: str, missing: str = "missing", name: str | None = None, source: DataFrame | None = None
) -> DataFrame:
    """Rank of the value among the sorted distinct values of the source (df itself by default).

    When several columns are encoded in turn, the source is the table before the
    first one, so that its joins are not planned again for each column.
    """
    filled = df.withColumn("_v", F.coalesce(F.col(col).cast("string"), F.lit(missing)))
    coded = attach(filled, label_codes(df if source is None else source, col, missing), ["_v"], "_w")
    return coded.withColumnRenamed("_code", name or f"{col}_label_encoded").drop("_v", "_w")


def frequency_table(df: DataFrame, col: str) -> DataFrame:
    """Per value: count, share, average-tie and dense rank by count, row percentile of the count.

    Ranks are taken over the distinct counts, of which n rows have at most sqrt(2n).
    """
    counts = df.groupBy(col).agg(F.count(F.lit(1)).alias("_w"))
    freq = F.when(F.col(col).isNull(), 0).otherwise(F.col("_w")).cast("bigint")
    table = counts.select(col, "_w", freq.alias("_f"))
    by_freq = table.groupBy("_f").agg(
        F.sum(F.when(F.col(col).isNotNull(), 1).otherwise(0)).alias("_cats"), F.sum("_w").alias("_rows")
    )
    down = running(
        by_freq.withColumn("_neg", -F.col("_f")).withColumn("_level", (F.col("_cats") > 0).cast("bigint")),
        {"_cats_to": ("_cats", "sum"), "_dense": ("_level", "sum"), "_rows_down": ("_rows", "sum")},
        ["_neg"],
        totals={"_all": ("_rows", "sum")},
    )
    below = F.col("_all") - F.col("_rows_down")
    ranks = down.select(
        "_f",
        (F.col("_cats_to") - F.col("_cats") + (F.col("_cats") + 1) / 2).alias("rank"),
        F.col("_dense").cast("double").alias("freq_rank"),
        safe_div(below + (F.col("_rows") + 1) / 2, F.col("_all")).alias("freq_percentile"),
        F.col("_all"),
    )
    share = safe_div(F.col("_f"), F.col("_all"))
    known = F.col(col).isNotNull()
    per_rank = table.groupBy("_f").agg(F.count(F.lit(1)).alias("_many"))
    return attach(table, ranks.join(per_rank, "_f"), ["_f"], "_many").select(
        col,
        "_w",
        F.col("_f").alias("frequency"),
        share.alias("frequency_pct"),
        F.when(known, F.col("rank")).otherwise(0.0).alias("rank"),
        F.when(known, F.col("freq_rank")).otherwise(0.0).alias("freq_rank"),
        "freq_percentile",
        (known & (share < 0.01)).cast("bigint").alias("is_rare"),
        (known & (share > 0.1)).cast("bigint").alias("is_common"),
    )


def frequency_features(df: DataFrame, col: str, names: Sequence[str], source: DataFrame | None = None) -> DataFrame:
    """The named figures of frequency_table on every row, as <col>_<name>."""
    stats = frequency_table(df if source is None else source, col).select(col, "_w", *[F.col(n).alias(f"{col}_{n}") for n in names])
    return attach(df, stats, [col], "_w").drop("_w")


def frequency_encode(df: DataFrame, col: str) -> DataFrame:
    return frequency_features(df, col, ["frequency", "frequency_pct"])


def frequency_rank(df: DataFrame, col: str) -> DataFrame:
    return frequency_features(df, col, ["rank", "freq_rank"])


def frequency_percentile(df: DataFrame, col: str) -> DataFrame:
    return frequency_features(df, col, ["freq_percentile"])


def rare_common_flags(df: DataFrame, col: str) -> DataFrame:
    return frequency_features(df, col, ["is_rare", "is_common"])


def target_encode(df: DataFrame, col: str, y: str) -> DataFrame:
    """Mean of the target per category; null category 0."""
    stats = df.groupBy(col).agg(F.avg(y).alias("_t"), F.count(F.lit(1)).alias("_w"))
    out = attach(df, stats, [col], "_w")
    value = F.when(F.col(col).isNotNull(), F.col("_t"))
    return out.withColumn(f"{col}_target_encoded", F.coalesce(value, F.lit(0.0))).drop("_t", "_w")


def binary_encode(df: DataFrame, col: str) -> DataFrame:
    """Bits of the label code, lowest first; the bit count comes from the number of values (one number is read)."""
    coded = label_encode(df, col, name="_code")
    top = label_codes(df, col).agg(F.max("_code")).first()[0] or 0
    bits = {f"{col}_binary_{i}": F.shiftright("_code", i).bitwiseAND(F.lit(1)) for i in range(max(1, int(top).bit_length()))}
    return coded.withColumns({k: v.cast("bigint") for k, v in bits.items()}).drop("_code")


def value_length(df: DataFrame, col: str) -> DataFrame:
    return df.withColumn(f"{col}_length", F.length(col).cast("bigint"))


def encode_for_model(df: DataFrame, cols: Sequence[str], limit: int | None = None) -> DataFrame:
    """Label codes in place of the columns; with a limit, columns of more values are dropped."""
    out = df
    for c in cols:
        if limit is not None and levels(df, c, limit) is None:
            out = out.drop(c)
        else:
            out = label_encode(out, c, name="_new", source=df).drop(c).withColumnRenamed("_new", c)
    return out


def encode_mixed(df: DataFrame, cols: Sequence[str], limit: int = 10) -> DataFrame:
    """One-hot without the first value up to the limit, label codes above it; the source column goes."""
    out = df
    for c in cols:
        if levels(df, c, limit) is not None:
            out = one_hot(out, c, limit, dummy_na=False, drop_first=True, source=df).drop(c)
        else:
            out = label_encode(out, c, name="_new", source=df).drop(c).withColumnRenamed("_new", c)
    return out
