"""Drift between a reference and a current period, marked by the column `period`."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from tabwork.functions import stats
from tabwork.functions.columns import column_kind, melt, safe_div
from tabwork.operators.lookup import quantiles
from tabwork.operators.ordered import running
from tabwork.operators.profile import top_values

# fixed values: score bands of drift magnitude, and their weights in the overall score
BANDS = ((0.3, "High"), (0.1, "Medium"), (0.05, "Low"))
LOWEST = "Minimal"
WEIGHTS = {"High": 1.0, "Medium": 0.6, "Low": 0.3, "Minimal": 0.1}


def _is_ref() -> Column:
    return F.col("period") == "reference"


def two_sided_counts(df: DataFrame, cols: Sequence[str], cast: str) -> DataFrame:
    """(column, value, ref, cur): rows of each value in the two periods, nulls left out."""
    cells = melt(df, cols, cast, ["period"])
    return cells.groupBy("column", "value").agg(
        F.count_if(_is_ref()).alias("ref"), F.count_if(~_is_ref()).alias("cur")
    )


def ks_2samp(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Largest distance of the two distribution functions per column, asymptotic p-value.

    Values are counted per period first; the running counts are cut into blocks.
    """
    cells = melt(df, cols, "double", ["period"])
    counts = two_sided_counts(df, cols, "double")
    cum = running(
        counts,
        {"_r": ("ref", "sum"), "_c": ("cur", "sum")},
        ["value"],
        ["column"],
        totals={"n_ref": ("ref", "sum"), "n_cur": ("cur", "sum")},
        cut_from=cells,
    )
    gap = F.abs(safe_div(F.col("_r"), F.col("n_ref")) - safe_div(F.col("_c"), F.col("n_cur")))
    found = cum.groupBy("column").agg(
        F.max(gap).alias("statistic"), F.max("n_ref").alias("n_ref"), F.max("n_cur").alias("n_cur")
    )
    p = stats.ks_p_value(F.col("statistic"), F.col("n_ref"), F.col("n_cur"))
    return found.withColumn("p_value", F.when((F.col("n_ref") > 0) & (F.col("n_cur") > 0), p))


def chi2_drift(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Chi-square statistic and p-value per column, with Yates correction for two categories.

    With R = rows of a category and C = rows of a period, the statistic is
    N * (sum(ref^2 / R) / C_ref + sum(cur^2 / R) / C_cur - 1), so one pass over
    the category counts is enough.
    """
    counts = two_sided_counts(df, cols, "string")
    both = F.col("ref") + F.col("cur")
    sums = counts.groupBy("column").agg(
        F.sum(F.col("ref") * F.col("ref") / both).alias("_sr"),
        F.sum(F.col("cur") * F.col("cur") / both).alias("_sc"),
        F.sum("ref").alias("n_ref"),
        F.sum("cur").alias("n_cur"),
        F.count(F.lit(1)).alias("categories"),
        F.min_by("ref", "value").cast("double").alias("_a"),
        F.max_by("ref", "value").cast("double").alias("_b"),
        F.min_by("cur", "value").cast("double").alias("_c"),
        F.max_by("cur", "value").cast("double").alias("_d"),
    )
    n = (F.col("n_ref") + F.col("n_cur")).cast("double")
    plain = F.greatest(F.lit(0.0), n * (safe_div(F.col("_sr"), F.col("n_ref")) + safe_div(F.col("_sc"), F.col("n_cur")) - 1))
    off = F.abs(F.col("_a") * F.col("_d") - F.col("_b") * F.col("_c")) / n
    shrink = F.coalesce(safe_div(off - F.least(F.lit(0.5), off), off), F.lit(0.0))
    dof = F.col("categories") - 1
    out = sums.withColumn("statistic", F.when(dof == 1, plain * shrink * shrink).otherwise(plain))
    p = F.when(dof < 1, 1.0).otherwise(stats.chi2_sf(F.col("statistic"), dof))
    return out.withColumn("p_value", p).select("column", "statistic", "p_value", "categories", "n_ref", "n_cur")


def cardinality_drift(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Difference of the distinct counts of the two periods over the larger one."""
    counts = two_sided_counts(df, cols, "string")
    sums = counts.groupBy("column").agg(
        F.count_if(F.col("ref") > 0).alias("ref_unique"), F.count_if(F.col("cur") > 0).alias("cur_unique")
    )
    score = safe_div(F.abs(F.col("ref_unique") - F.col("cur_unique")), F.greatest("ref_unique", "cur_unique", F.lit(1)))
    return sums.withColumn("drift_score", score).withColumn("p_value", F.when(score > 0.1, 0.5).otherwise(0.8))


def drift_verdict(scores: DataFrame, threshold: float = 0.05) -> DataFrame:
    """Magnitude band, flag and summary text from drift_score and p_value."""
    band = F.lit(LOWEST)
    for cut, word in reversed(BANDS):
        band = F.when(F.col("drift_score") > cut, word).otherwise(band)
    hit = F.col("p_value") < threshold
    text = F.format_string("%s drift detected (p-value: %.4f)", F.when(hit, "Significant").otherwise("No significant"), "p_value")
    return scores.withColumns({"magnitude": band, "drift_detected": hit, "summary": text})


def detect_drift(df: DataFrame, cols: Sequence[str], threshold: float = 0.05) -> DataFrame:
    """One row per column: test, score, p-value and verdict; columns without data in a period score 0."""
    number = [c for c in cols if column_kind(df, c) == "number"]
    other = [c for c in cols if c not in number]
    parts = []
    if number:
        parts.append(
            ks_2samp(df, number).select(
                "column", F.lit("Kolmogorov-Smirnov").alias("test"), F.col("statistic").alias("drift_score"), "p_value"
            )
        )
    if other:
        parts.append(
            chi2_drift(df, other).select(
                "column",
                F.lit("Chi-square").alias("test"),
                F.least(F.lit(1.0), F.col("statistic") / 100).alias("drift_score"),
                "p_value",
            )
        )
    table = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    usable = F.col("drift_score").isNotNull() & F.col("p_value").isNotNull()
    table = table.select(
        "column",
        F.when(usable, F.col("test")).otherwise("No valid data").alias("test"),
        F.when(usable, F.col("drift_score")).otherwise(0.0).alias("drift_score"),
        F.when(usable, F.col("p_value")).otherwise(1.0).alias("p_value"),
    )
    return drift_verdict(table, threshold)


def period_stats(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """mean, median, sd, min, max and count of numeric columns per period."""
    cells = melt(df, cols, "double", ["period"])
    basic = cells.groupBy("period", "column").agg(
        F.avg("value").alias("mean"),
        F.stddev_samp("value").alias("sd"),
        F.min("value").alias("min"),
        F.max("value").alias("max"),
        F.count("value").alias("count"),
    )
    return basic.join(quantiles(df, cols, {"median": 0.5}, ["period"]).drop("n"), ["period", "column"])


def period_top_values(df: DataFrame, cols: Sequence[str], k: int = 5) -> DataFrame:
    """Most frequent values of text columns per period."""
    return top_values(df, cols, k, ["period"])


def overall_drift(results: DataFrame, threshold: float = 0.05) -> DataFrame:
    """Scores weighted by band, with the number of drifting columns beside the table flag."""
    weight = F.lit(WEIGHTS[LOWEST])
    for word, value in WEIGHTS.items():
        weight = F.when(F.col("magnitude") == word, value).otherwise(weight)
    score = F.coalesce(safe_div(F.sum(F.col("drift_score") * weight), F.sum(weight)), F.lit(0.0))
    return results.agg(
        score.alias("overall_drift_score"),
        F.count_if(F.col("drift_detected")).alias("columns_drifting"),
        F.count(F.lit(1)).alias("columns_checked"),
    ).withColumn("drift_detected", F.col("overall_drift_score") > threshold)


def drift_summary(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Rows and nulls of both periods, and the change of the row count in percent."""
    nulls = sum((F.col(c).isNull().cast("bigint") for c in cols), F.lit(0))
    row = df.agg(
        F.count_if(_is_ref()).alias("ref_rows"),
        F.count_if(~_is_ref()).alias("cur_rows"),
        F.coalesce(F.sum(F.when(_is_ref(), nulls)), F.lit(0)).cast("bigint").alias("ref_missing"),
        F.coalesce(F.sum(F.when(~_is_ref(), nulls)), F.lit(0)).cast("bigint").alias("cur_missing"),
    )
    change = F.coalesce(safe_div(F.col("cur_rows") - F.col("ref_rows"), F.col("ref_rows")) * 100, F.lit(0.0))
    return row.withColumn("row_change_pct", change)


def annotate_drift(df: DataFrame, cols: Sequence[str], results: DataFrame) -> DataFrame:
    """Score and flag of each column on every row, beside its period."""
    pick = lambda c, f: F.max(F.when(F.col("column") == c, F.col(f)))
    found = results.agg(
        F.struct(*[F.struct(pick(c, "drift_score").alias("s"), pick(c, "drift_detected").alias("d")).alias(c) for c in cols]).alias("r")
    ).scalar()
    wide = df.withColumn("_r", found)
    out = {}
    for c in cols:
        out |= {f"{c}_drift_score": F.col(f"_r.{c}.s"), f"{c}_drift_detected": F.col(f"_r.{c}.d")}
    return wide.withColumns(out).drop("_r")
