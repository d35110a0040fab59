"""Projection, filtering, splits, imputation, de-duplication and set operations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from tabwork.functions.columns import columns_of_kind, melt, one_row
from tabwork.operators.lookup import quantile_struct
from tabwork.operators.ordered import number_rows


def select_columns(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.select(*cols)


def drop_null_target(df: DataFrame, y: str) -> DataFrame:
    return df.filter(F.col(y).isNotNull())


def dropna(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.na.drop(subset=list(cols))


def key_hash(*keys: str, seed: int = 42) -> Column:
    """Repeatable hex digest of the row key."""
    return F.md5(F.concat_ws("|", *[F.col(k).cast("string") for k in keys], F.lit(str(seed))))


def hash_bucket(*keys: str, buckets: int = 1000, seed: int = 42) -> Column:
    """Bucket 0..buckets-1 from the first eight hex digits of the key digest."""
    return F.pmod(F.conv(F.substring(key_hash(*keys, seed=seed), 1, 8), 16, 10).cast("bigint"), F.lit(buckets))


def first_n(df: DataFrame, n: int, order_by: Sequence[str]) -> DataFrame:
    """The first n rows of an order, cut by row number, not on one task."""
    return number_rows(df, list(order_by), name="_rn").filter(F.col("_rn") <= n).drop("_rn")


def sample_n(df: DataFrame, n: int, keys: Sequence[str], seed: int = 42) -> DataFrame:
    """A repeatable random sample of exactly n rows."""
    hashed = df.withColumn("_h", key_hash(*keys, seed=seed))
    return first_n(hashed, n, ["_h", *keys]).drop("_h")


def head_n(df: DataFrame, n: int, order_by: Sequence[str]) -> DataFrame:
    return first_n(df, n, order_by)


def split_ordered(df: DataFrame, order_by: Sequence[str], ratio: float) -> DataFrame:
    """Add period: the first floor(n * ratio) rows are 'reference', the rest 'current'."""
    numbered = number_rows(df, order_by, name="_rn", total="_all")
    first = F.col("_rn") <= F.floor(F.col("_all") * ratio)
    return numbered.withColumn("period", F.when(first, "reference").otherwise("current")).drop("_rn", "_all")


def split_random(df: DataFrame, ratio: float, keys: Sequence[str], seed: int = 42) -> DataFrame:
    """Add period by key digest, in thousandths."""
    chosen = hash_bucket(*keys, seed=seed) < int(round(ratio * 1000))
    return df.withColumn("period", F.when(chosen, "reference").otherwise("current"))


def split_train_test(
    df: DataFrame, keys: Sequence[str], test_size: float = 0.2, stratify: str | None = None, seed: int = 42
) -> DataFrame:
    """Add split: 'test' for the ceil(test_size * n) rows of smallest digest, per class when stratified."""
    hashed = df.withColumn("_h", key_hash(*keys, seed=seed))
    numbered = number_rows(hashed, ["_h", *keys], [stratify] if stratify else [], "_rn", "_all")
    test = F.col("_rn") <= F.ceil(F.col("_all") * test_size)
    return numbered.withColumn("split", F.when(test, "test").otherwise("train")).drop("_h", "_rn", "_all")


def modes(df: DataFrame, cols: Sequence[str]) -> Column:
    """Most frequent value per text column as a scalar struct; ties take the smallest value."""
    counts = melt(df, cols, "string").groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))
    best = counts.groupBy("column").agg(F.min_by("value", F.struct(-F.col("n"), "value")).alias("top"))
    fields = [F.max(F.when(F.col("column") == c, F.col("top"))).alias(c) for c in cols]
    return best.agg(F.struct(*fields).alias("_m")).scalar()


def _fill(df: DataFrame, cols: Sequence[str], values: Column, pick) -> DataFrame:
    kinds = {f.name: f.dataType for f in df.schema.fields}
    return (
        df.withColumn("_fill", values)
        .withColumns({c: F.coalesce(F.col(c), pick(c).cast(kinds[c])) for c in cols})
        .drop("_fill")
    )


def impute_median(df: DataFrame, cols: Sequence[str], source: DataFrame | None = None) -> DataFrame:
    """Numeric nulls become the column median of the source (df by default); integer columns become double first."""
    df = df.withColumns({c: F.col(c).cast("double") for c in cols})
    return _fill(df, cols, quantile_struct(df if source is None else source, cols, {"m": 0.5}), lambda c: F.col(f"_fill.{c}.m"))


def impute_mean(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    df = df.withColumns({c: F.col(c).cast("double") for c in cols})
    return _fill(df, cols, one_row(df, **{c: F.avg(c) for c in cols}), lambda c: F.col(f"_fill.{c}"))


def impute_mode(df: DataFrame, cols: Sequence[str], default: str = "Unknown") -> DataFrame:
    """Text nulls become the most frequent value, or the default in an all-null column."""
    return _fill(df, cols, modes(df, cols), lambda c: F.coalesce(F.col(f"_fill.{c}"), F.lit(default)))


def impute_constant(df: DataFrame, cols: Sequence[str], value) -> DataFrame:
    return df.na.fill({c: value for c in cols})


def add_imputation_flag(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """1.0 where the value was observed, 0.0 where it will be filled."""
    return df.withColumns({f"{c}_confidence": F.col(c).isNotNull().cast("double") for c in cols})


def clean_features(df: DataFrame, numeric: Sequence[str] | None = None, text: Sequence[str] | None = None) -> DataFrame:
    """Infinite and null numbers to the median, clipped at mean +- 5 sd; null text to 'missing'."""
    numeric = list(numeric if numeric is not None else columns_of_kind(df, "number"))
    text = list(text if text is not None else columns_of_kind(df, "text"))
    bad = lambda c: F.isnan(c) | (F.abs(c) == float("inf"))
    finite = df.withColumns({c: F.when(~bad(F.col(c).cast("double")), F.col(c).cast("double")) for c in numeric})
    filled = impute_median(finite, numeric).na.fill(0.0, numeric)
    ends = one_row(
        filled, **{c: F.struct(F.avg(c).alias("m"), F.coalesce(F.stddev_samp(c), F.lit(0.0)).alias("s")) for c in numeric}
    )
    out = filled.withColumn("_e", ends)

    def clipped(c):
        m, s = F.col(f"_e.{c}.m"), F.col(f"_e.{c}.s")
        return F.when(s > 0, F.least(F.greatest(F.col(c), m - s * 5), m + s * 5)).otherwise(F.col(c))

    return out.withColumns({c: clipped(c) for c in numeric}).drop("_e").na.fill("missing", text)


def sort_time(df: DataFrame, t: str) -> DataFrame:
    return df.orderBy(t)


def drop_duplicates(df: DataFrame, subset: Sequence[str] | None = None, order_by: Sequence[str] = ()) -> DataFrame:
    """One row per key: any of identical rows, or the first in order_by.

    The kept row is an aggregate, so copies are combined before the shuffle.
    """
    if not subset:
        return df.dropDuplicates()
    return _pick(df, subset, order_by, F.min_by)


def dedupe_last(df: DataFrame, keys: Sequence[str], order_by: Sequence[str]) -> DataFrame:
    """The last row in order_by of each key."""
    return _pick(df, keys, order_by, F.max_by)


def _pick(df, keys, order_by, chooser):
    rest = [c for c in df.columns if c not in keys]
    kept = df.groupBy(*keys).agg(chooser(F.struct(*rest), F.struct(*order_by)).alias("_row"))
    return kept.select(*keys, "_row.*").select(*df.columns)


def isin_set(df: DataFrame, col: str, values: DataFrame, name: str) -> DataFrame:
    """Flag rows whose value occurs in the one-column table of values."""
    marked = values.select(F.col(values.columns[0]).alias(col)).distinct().withColumn("_hit", F.lit(True))
    joined = df.join(marked, col, "left")
    return joined.select(*df.columns, F.coalesce("_hit", F.lit(False)).alias(name))


def combine_forecast(history: DataFrame, forecast: DataFrame) -> DataFrame:
    """History and forecast rows under one schema, marked by type."""
    return history.withColumn("type", F.lit("history")).unionByName(
        forecast.withColumn("type", F.lit("forecast")), allowMissingColumns=True
    )


def all_categories(ref: DataFrame, cur: DataFrame, col: str) -> DataFrame:
    return ref.select(col).union(cur.select(col)).distinct()


def difference(df: DataFrame, sample: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of df whose key is not in the sample."""
    return df.join(sample.select(*keys), list(keys), "left_anti")


def align_counts(ref: DataFrame, cur: DataFrame, col: str) -> DataFrame:
    """Rows per category in two periods; a category absent from one counts 0 there.

    Written as one aggregation of the union: no join, and hot categories combine early.
    """
    both = ref.select(col, F.lit(1).alias("_r"), F.lit(0).alias("_c")).unionByName(
        cur.select(col, F.lit(0).alias("_r"), F.lit(1).alias("_c"))
    )
    return both.groupBy(col).agg(F.sum("_r").alias("ref_count"), F.sum("_c").alias("cur_count"))


def enrich_lookup(df: DataFrame, dim: DataFrame, key: str) -> DataFrame:
    """Columns of a reference table by key; Spark broadcasts it when its size allows."""
    return df.join(dim, key, "left")


def attach_fit(df: DataFrame, fit: DataFrame, t: str) -> DataFrame:
    """Fitted values by time key, and the residual of each row."""
    return df.join(fit, t, "left")


def append_columns(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """Columns appended in one projection; no join."""
    return df.select("*", *[c.alias(n) for n, c in columns.items()])


def limit_rows(df: DataFrame, n: int, *order_by: Column | str) -> DataFrame:
    """Top rows of a report."""
    return df.orderBy(*order_by).limit(n)


