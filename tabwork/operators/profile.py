"""Table and column profiles."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tabwork.functions import fixed, stats
from tabwork.functions.columns import (
    column_kind,
    columns_of_kind,
    melt,
    one_row,
    per_column,
    safe_div,
)
from tabwork.operators.lookup import quantile_struct, quantiles, value_counts

BATCH = 50


def _nulls(c: str) -> Column:
    return F.count_if(F.col(c).isNull())


def count_duplicates(df: DataFrame, subset: Sequence[str] | None = None) -> DataFrame:
    """Rows that repeat an earlier row; nulls count as equal."""
    groups = value_counts(df, *(subset or df.columns))
    return groups.agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).cast("bigint").alias("duplicate_rows"))


def profile_table(df: DataFrame) -> DataFrame:
    """Rows, columns, total nulls, duplicate rows and columns per kind: one row."""
    # full rows are grouped once; the group sizes give row, null and duplicate counts
    nulls = sum((F.col(c).isNull().cast("int") for c in df.columns), F.lit(0))
    groups = df.groupBy(*df.columns).agg(F.count(F.lit(1)).alias("_n")).select("_n", nulls.alias("_nulls"))
    kinds = {k: len(columns_of_kind(df, k)) for k in ("number", "text", "datetime")}
    return groups.agg(
        F.coalesce(F.sum("_n"), F.lit(0)).cast("bigint").alias("row_count"),
        F.lit(len(df.columns)).cast("bigint").alias("column_count"),
        F.coalesce(F.sum(F.col("_n") * F.col("_nulls")), F.lit(0)).cast("bigint").alias("missing_values"),
        F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).cast("bigint").alias("duplicate_rows"),
        *[F.lit(n).cast("bigint").alias(f"{k}_columns") for k, n in kinds.items()],
    )


def missing_summary(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Null count and percent per column."""
    return per_column(
        df,
        {
            c: {"missing": _nulls(c), "missing_pct": safe_div(_nulls(c), F.count(F.lit(1))) * 100}
            for c in cols or df.columns
        },
    )


def cardinality(df: DataFrame, cols: Sequence[str] | None = None, approximate: bool = False) -> DataFrame:
    """Distinct non-null values and their percent of the rows, per column."""
    cols = list(cols or df.columns)
    rows = df.agg(F.count(F.lit(1)).alias("n")).scalar()
    if approximate:
        counted = per_column(df, {c: {"unique_count": F.approx_count_distinct(c)} for c in cols})
    else:
        # exact: distinct (column, value) pairs are combined before the shuffle
        distinct = melt(df, cols, "string").groupBy("column", "value").agg(F.lit(1).alias("_one"))
        found = distinct.groupBy("column").agg(F.count(F.lit(1)).alias("unique_count"))
        counted = per_column(df, {c: {"_r": F.count(F.lit(1))} for c in cols}).join(found, "column", "left")
    count = F.coalesce(F.col("unique_count"), F.lit(0)).cast("bigint")
    return counted.select(
        "column", count.alias("unique_count"), (safe_div(count, rows) * 100).alias("unique_pct")
    )


def profile_numeric(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """min, max, mean, median and sample sd per numeric column."""
    cols = list(cols or columns_of_kind(df, "number"))
    basic = per_column(
        df,
        {
            c: {
                "min": F.min(F.col(c).cast("double")),
                "max": F.max(F.col(c).cast("double")),
                "mean": F.avg(c),
                "sd": F.stddev_samp(c),
            }
            for c in cols
        },
    )
    middle = quantiles(df, cols, {"median": 0.5}).select("column", "median")
    return basic.join(middle, "column", "left")


def iqr_bounds(df: DataFrame, cols: Sequence[str], k: float = 1.5, keys: Sequence[str] = ()) -> DataFrame:
    """Quartiles and outlier bounds: (keys..., column, q1, q3, lower_bound, upper_bound)."""
    q = quantiles(df, cols, {"q1": 0.25, "q3": 0.75}, keys)
    iqr = F.col("q3") - F.col("q1")
    return q.select(
        *keys, "column", "q1", "q3", (F.col("q1") - k * iqr).alias("lower_bound"), (F.col("q3") + k * iqr).alias("upper_bound")
    )


def iqr_outliers(df: DataFrame, cols: Sequence[str] | None = None, k: float = 1.5) -> DataFrame:
    """Bounds and number of values outside them, per column."""
    cols = list(cols or columns_of_kind(df, "number"))
    q = quantile_struct(df, cols, {"q1": 0.25, "q3": 0.75})
    wide = df.select(*[F.col(c).cast("double").alias(c) for c in cols], q.alias("_q"))
    measures = {}
    for c in cols:
        q1, q3 = F.col(f"_q.{c}.q1"), F.col(f"_q.{c}.q3")
        lo, hi = q1 - (q3 - q1) * k, q3 + (q3 - q1) * k
        v = F.col(c)
        measures[c] = {
            "q1": F.first(q1),
            "q3": F.first(q3),
            "lower_bound": F.first(lo),
            "upper_bound": F.first(hi),
            "outliers": F.count_if((v < lo) | (v > hi)),
            "row_count": F.count(F.lit(1)),
        }
    return per_column(wide, measures)


def profile_numeric_ext(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """profile_numeric with skew, kurtosis, outlier, zero and negative counts."""
    cols = list(cols or columns_of_kind(df, "number"))
    moments = per_column(
        df,
        {
            c: {
                "skew": stats.sample_skew(F.col(c)),
                "kurtosis": stats.sample_kurtosis(F.col(c)),
                "zero_count": F.count_if(F.col(c) == 0),
                "negative_count": F.count_if(F.col(c) < 0),
            }
            for c in cols
        },
    )
    outliers = iqr_outliers(df, cols).select("column", "outliers")
    return profile_numeric(df, cols).join(moments, "column").join(outliers, "column")


def top_values(df: DataFrame, cols: Sequence[str], k: int = 10, keys: Sequence[str] = ()) -> DataFrame:
    """The k most frequent values per column: (keys..., column, value, n, rank)."""
    counts = melt(df, cols, "string", keys).groupBy(*keys, "column", "value").agg(F.count(F.lit(1)).alias("n"))
    # Spark keeps only k rows per key and task before the shuffle (window group limit)
    order = Window.partitionBy(*keys, "column").orderBy(F.desc("n"), "value")
    ranked = counts.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.withColumn("rank", F.col("rank").cast("bigint"))


def profile_categorical(df: DataFrame, cols: Sequence[str] | None = None, k: int = 10) -> DataFrame:
    """Distinct count and top k values per text column."""
    cols = list(cols or columns_of_kind(df, "text"))
    uniques = cardinality(df, cols).select("column", "unique_count")
    return top_values(df, cols, k).join(uniques, "column")


def profile_datetime(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """First, last, range in whole days, and whether more than one hour occurs."""
    cols = list(cols or columns_of_kind(df, "datetime"))
    fmt = "yyyy-MM-dd HH:mm:ss"
    return per_column(
        df,
        {
            c: {
                "min_time": F.date_format(F.min(c), fmt),
                "max_time": F.date_format(F.max(c), fmt),
                "range_days": F.floor(seconds_between(F.min(c), F.max(c)) / 86400).cast("bigint"),
                "has_time": F.min(F.hour(c)) < F.max(F.hour(c)),
            }
            for c in cols
        },
    )


def seconds_between(a: Column, b: Column) -> Column:
    """b - a in whole seconds, for timestamps with or without zone."""
    return (
        F.datediff(b, a).cast("bigint") * 86400
        + (F.hour(b) - F.hour(a)) * 3600
        + (F.minute(b) - F.minute(a)) * 60
        + (F.second(b) - F.second(a))
    )


def word_count(c: Column) -> Column:
    return F.size(F.filter(F.split(c, r"\s+"), lambda w: w != ""))


def profile_text(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Length, word and character-class figures per text column."""
    cols = list(cols or columns_of_kind(df, "text"))
    figures = per_column(
        df,
        {
            c: {
                "avg_length": F.avg(F.length(c)),
                "max_length": F.max(F.length(c)).cast("bigint"),
                "min_length": F.min(F.length(c)).cast("bigint"),
                "avg_words": F.avg(word_count(F.col(c))),
                "with_digits": F.count_if(F.col(c).rlike(r"[0-9]")),
                "with_special": F.count_if(F.col(c).rlike(r"[^a-zA-Z0-9\s]")),
            }
            for c in cols
        },
    )
    likely = cardinality(df, cols).select("column", (F.col("unique_pct") < 10).alias("likely_categorical"))
    return figures.join(likely, "column")


def correlation_matrix(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Pearson r of each column pair (column1, column2, r), nulls dropped pair by pair."""
    cols = list(cols or columns_of_kind(df, "number"))
    pairs = list(combinations(cols, 2))
    parts = []
    for at in range(0, len(pairs), BATCH):
        wide = df.agg(
            *[
                F.struct(
                    F.lit(a).alias("column1"),
                    F.lit(b).alias("column2"),
                    F.corr(F.col(a).cast("double"), F.col(b).cast("double")).alias("r"),
                ).alias(f"p{i}")
                for i, (a, b) in enumerate(pairs[at : at + BATCH])
            ]
        )
        parts.append(wide.select(F.inline(F.array(*wide.columns))))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def strong_correlations(df: DataFrame, cols: Sequence[str] | None = None, threshold: float = 0.7) -> DataFrame:
    return correlation_matrix(df, cols).filter(F.abs("r") > threshold)


def normality(df: DataFrame, cols: Sequence[str] | None = None, level: float = 0.05) -> DataFrame:
    """D'Agostino-Pearson test per column; null under eight values."""
    cols = list(cols or columns_of_kind(df, "number"))
    moments = per_column(
        df, {c: {"n": F.count(c), "g1": F.skewness(c), "g2": F.kurtosis(c)} for c in cols}
    )
    k2 = F.when(F.col("n") >= 8, stats.k_squared(F.col("n"), F.col("g1"), F.col("g2")))
    tested = moments.withColumn("statistic", k2).withColumn("p_value", F.exp(-F.col("statistic") / 2))
    return tested.select("column", "n", "statistic", "p_value", (F.col("p_value") > level).alias("is_normal"))


def shape_label(skew: Column, kurtosis: Column) -> Column:
    return (
        F.when((F.abs(skew) < 0.5) & (F.abs(kurtosis) < 3), "normal")
        .when(skew > 1, "right_skewed")
        .when(skew < -1, "left_skewed")
        .when(kurtosis > 3, "heavy_tailed")
        .otherwise("unknown")
    )


def distribution_type(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Skew, kurtosis and a shape label per column."""
    cols = list(cols or columns_of_kind(df, "number"))
    shape = per_column(
        df,
        {c: {"skew": stats.sample_skew(F.col(c)), "kurtosis": stats.sample_kurtosis(F.col(c))} for c in cols},
    )
    return shape.withColumn("distribution", shape_label(F.col("skew"), F.col("kurtosis")))


def distribution_analysis(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Long table of figures: statistics of numeric columns, top-10 counts of text columns."""
    numeric = [c for c in cols if column_kind(df, c) == "number"]
    text = [c for c in cols if column_kind(df, c) == "text"]
    figures = ["mean", "median", "sd", "skew", "kurtosis"]
    out = None
    if numeric:
        wide = profile_numeric(df, numeric).join(distribution_type(df, numeric), "column").select("column", *figures)
        out = wide.unpivot(["column"], figures, "measure", "value")
    if text:
        tops = top_values(df, text, 10).select(
            "column", F.concat(F.lit("top:"), "value").alias("measure"), F.col("n").cast("double").alias("value")
        )
        out = tops if out is None else out.unionByName(tops)
    return out


def histogram(df: DataFrame, cols: Sequence[str], bins: int = 30) -> DataFrame:
    """Equal-width counts per column; the last bin holds the maximum."""
    ends = one_row(
        df, **{c: F.struct(F.min(F.col(c).cast("double")).alias("lo"), F.max(F.col(c).cast("double")).alias("hi")) for c in cols}
    )
    cells = df.select(*[F.col(c).cast("double").alias(c) for c in cols], ends.alias("_e"))
    binned = []
    for c in cols:
        lo, hi = F.col(f"_e.{c}.lo"), F.col(f"_e.{c}.hi")
        at = F.floor(safe_div(F.col(c) - lo, hi - lo) * bins)
        binned.append(F.least(F.coalesce(at, F.when(F.col(c).isNotNull(), 0)), F.lit(bins - 1)).cast("bigint").alias(c))
    counts = melt(cells.select(*binned), cols, "bigint").groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumnRenamed("value", "bin")


def box_stats(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Quartiles and the whisker ends: the outermost values inside the bounds."""
    cols = list(cols or columns_of_kind(df, "number"))
    q = quantile_struct(df, cols, {"q1": 0.25, "median": 0.5, "q3": 0.75})
    wide = df.select(*[F.col(c).cast("double").alias(c) for c in cols], q.alias("_q"))
    measures = {}
    for c in cols:
        q1, q3, v = F.col(f"_q.{c}.q1"), F.col(f"_q.{c}.q3"), F.col(c)
        inside = (v >= q1 - (q3 - q1) * 1.5) & (v <= q3 + (q3 - q1) * 1.5)
        measures[c] = {
            "q1": F.first(q1),
            "median": F.first(F.col(f"_q.{c}.median")),
            "q3": F.first(q3),
            "whisker_low": F.min(F.when(inside, v)),
            "whisker_high": F.max(F.when(inside, v)),
        }
    return per_column(wide, measures)


def variance_importance(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Variance and variance / max per numeric column."""
    cols = list(cols or columns_of_kind(df, "number"))
    return per_column(
        df,
        {
            c: {
                "importance_score": F.var_samp(c),
                "normalized_score": F.coalesce(safe_div(F.var_samp(c), F.max(c)), F.lit(0.0)),
            }
            for c in cols
        },
    )


def group_stats(df: DataFrame, key: str, vals: Sequence[str]) -> DataFrame:
    """mean, sd, min, max, count, median and sum of each value column per category."""
    cells = melt(df, vals, "double", [key])
    basic = cells.groupBy(key, "column").agg(
        F.avg("value").alias("mean"),
        F.stddev_samp("value").alias("sd"),
        F.min("value").alias("min"),
        F.max("value").alias("max"),
        F.count("value").alias("count"),
        F.sum("value").alias("sum"),
    )
    middle = quantiles(df, vals, {"median": 0.5}, [key]).select(key, "column", "median")
    return basic.join(middle, [key, "column"], "left")


def discover_text_patterns(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Rows per known pattern, and lengths shared by over a tenth of the rows."""
    cols = list(cols or columns_of_kind(df, "text"))
    known = {"Email": fixed.EMAIL, "Phone": fixed.PHONE, "Date": fixed.DATE}
    wide = per_column(
        df, {c: {"n": F.count(c), **{k: F.count_if(F.col(c).rlike(p)) for k, p in known.items()}} for c in cols}
    )
    hits = wide.unpivot(["column", "n"], list(known), "pattern_type", "matches").select(
        "column", "pattern_type", F.lit("").alias("detail"), "matches", "n"
    )
    lengths = df.select(*[F.length(c).alias(c) for c in cols])
    common = (
        top_values(lengths, cols, 5)
        .join(wide.select("column", F.col("n").alias("rows")), "column")
        .filter(F.col("n") > F.col("rows") * 0.1)
        .select("column", F.lit("Fixed Length").alias("pattern_type"), F.col("value").alias("detail"),
                F.col("n").alias("matches"), F.col("rows").alias("n"))
    )
    found = hits.filter("matches > 0").unionByName(common)
    return found.select("column", "pattern_type", "detail", "matches", (safe_div(F.col("matches"), F.col("n")) * 100).alias("pct"))


def discover_numeric_patterns(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Values between the quartiles, and values held by over a twentieth of the rows."""
    cols = list(cols or columns_of_kind(df, "number"))
    q = quantile_struct(df, cols, {"q1": 0.25, "q3": 0.75})
    wide = df.select(*[F.col(c).cast("double").alias(c) for c in cols], q.alias("_q"))
    inside = per_column(
        wide,
        {
            c: {
                "n": F.count(c),
                "matches": F.count_if(F.col(c).between(F.col(f"_q.{c}.q1"), F.col(f"_q.{c}.q3"))),
                "iqr": F.first(F.col(f"_q.{c}.q3") - F.col(f"_q.{c}.q1")),
            }
            for c in cols
        },
    )
    band = inside.filter("iqr > 0").select(
        "column", F.lit("Interquartile Range").alias("pattern_type"), F.lit(None).cast("double").alias("value"), "matches"
    )
    counts = melt(df, cols, "double").groupBy("column", "value").agg(F.count(F.lit(1)).alias("matches"))
    order = Window.partitionBy("column").orderBy(F.desc("matches"), "value")
    common = (
        counts.withColumn("_r", F.row_number().over(order))
        .filter("_r <= 3")
        .join(inside.select("column", "n"), "column")
        .filter(F.col("matches") > F.col("n") * 0.05)
        .select("column", F.lit("Common Value").alias("pattern_type"), "value", "matches")
    )
    return band.unionByName(common)


def flag_patterns(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Boolean columns per text column and pattern; null text is false."""
    known = {"email": fixed.EMAIL, "phone": fixed.PHONE, "date": fixed.DATE}
    return df.select(
        "*", *[F.coalesce(F.col(c).rlike(p), F.lit(False)).alias(f"{c}_{k}") for c in cols for k, p in known.items()]
    )


def enrichment_metrics(before: DataFrame, after: DataFrame) -> DataFrame:
    """Column and null counts of two tables and the share of nulls removed."""

    def nulls(df):
        return df.agg(F.sum(sum((F.col(c).isNull().cast("bigint") for c in df.columns), F.lit(0))).alias("s")).scalar()

    old, new = len(before.columns), len(after.columns)
    row = before.sparkSession.range(1).select(
        F.lit(old).cast("bigint").alias("original_columns"),
        F.lit(new).cast("bigint").alias("enriched_columns"),
        F.lit((new - old) / old).alias("enrichment_ratio"),
        F.coalesce(nulls(before), F.lit(0)).alias("original_missing"),
        F.coalesce(nulls(after), F.lit(0)).alias("enriched_missing"),
    )
    gain = safe_div(F.col("original_missing") - F.col("enriched_missing"), F.col("original_missing")) * 100
    return row.withColumn("improvement_pct", F.coalesce(gain, F.lit(0.0)))


def feature_catalog(features: DataFrame) -> DataFrame:
    """New features per type from the feature-description table."""
    return features.groupBy("type").agg(F.count(F.lit(1)).alias("features"))


def confusion_matrix(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    return df.groupBy(actual, predicted).agg(F.count(F.lit(1)).alias("n"))


def classification_report(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    """Precision, recall, F1 and support per class."""
    cells = confusion_matrix(df, actual, predicted).select(
        F.col(actual).cast("string").alias("a"), F.col(predicted).cast("string").alias("p"), "n"
    )
    # each cell counts once for its true class and once for the predicted one
    sides = cells.select(
        F.inline(
            F.array(
                F.struct(F.col("a").alias("label"), F.col("n").alias("support"), F.lit(0).cast("bigint").alias("named"),
                         F.when(F.col("a") == F.col("p"), F.col("n")).otherwise(0).alias("hits")),
                F.struct(F.col("p").alias("label"), F.lit(0).cast("bigint").alias("support"), F.col("n").alias("named"),
                         F.lit(0).cast("bigint").alias("hits")),
            )
        )
    )
    sums = sides.groupBy("label").agg(*[F.sum(c).alias(c) for c in ("support", "named", "hits")])
    precision = F.coalesce(safe_div(F.col("hits"), F.col("named")), F.lit(0.0))
    recall = F.coalesce(safe_div(F.col("hits"), F.col("support")), F.lit(0.0))
    f1 = F.coalesce(safe_div(precision * recall * 2, precision + recall), F.lit(0.0))
    return sums.select("label", precision.alias("precision"), recall.alias("recall"), f1.alias("f1"), "support")


def label_metrics(df: DataFrame, label: str, confidence: str) -> DataFrame:
    """Rows and mean confidence per label of a text-analysis result."""
    return df.groupBy(label).agg(F.count(F.lit(1)).alias("texts"), F.avg(confidence).alias("avg_confidence"))
