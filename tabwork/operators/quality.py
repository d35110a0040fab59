"""Quality scores, anomaly rules, and ratings of result tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from tabwork.functions import fixed
from tabwork.functions.columns import column_kind, columns_of_kind, per_column, safe_div
from tabwork.functions.textfeat import strip
from tabwork.operators.catalog import cases
from tabwork.operators.lookup import quantile_struct
from tabwork.operators.profile import cardinality, count_duplicates, iqr_outliers, profile_table
from tabwork.operators.rows import append_columns


def clamp(c: Column, low: float = 0.0, high: float = 100.0) -> Column:
    return F.least(F.greatest(c, F.lit(low)), F.lit(high))


def _ratios() -> tuple[Column, Column]:
    """Null share of the cells and duplicate share of the rows of a profile_table row."""
    cells = F.col("row_count") * F.col("column_count")
    return (
        F.coalesce(safe_div(F.col("missing_values"), cells), F.lit(0.0)),
        F.coalesce(safe_div(F.col("duplicate_rows"), F.col("row_count")), F.lit(0.0)),
    )


def quality_score(df: DataFrame) -> DataFrame:
    """100 - 50 * null share - 30 * duplicate share."""
    missing, duplicate = _ratios()
    return profile_table(df).select(clamp(100 - missing * 50 - duplicate * 30).alias("quality_score"))


def quality_dimensions(df: DataFrame) -> DataFrame:
    """Completeness, consistency, validity and uniqueness with a grade.

    A Spark column has one type, so consistency is 100. Validity counts numeric
    columns with infinite and text columns with empty values.
    """
    number, text = columns_of_kind(df, "number"), columns_of_kind(df, "text")
    checks = [F.bool_or(F.abs(F.col(c).cast("double")) == float("inf")) for c in number]
    checks += [F.bool_or(F.col(c) == "") for c in text]
    bad = sum((F.coalesce(c.cast("bigint"), F.lit(0)) for c in checks), F.lit(0))
    invalid = df.agg(bad.alias("bad")).scalar()
    missing, duplicate = _ratios()
    row = profile_table(df).select(
        ((1 - missing) * 100).alias("completeness"),
        F.lit(100.0).alias("consistency"),
        ((1 - invalid / float(max(1, len(checks)))) * 100).alias("validity"),
        ((1 - duplicate) * 100).alias("uniqueness"),
    )
    mean = (F.col("completeness") + F.col("consistency") + F.col("validity") + F.col("uniqueness")) / 4
    grade = cases((mean >= 90, "Excellent"), (mean >= 80, "Good"), (mean >= 70, "Fair"), otherwise="Poor")
    return row.withColumn("grade", grade)


def quality_simple(df: DataFrame) -> DataFrame:
    """Mean of completeness and consistency, and which recommendations apply."""
    missing, duplicate = _ratios()
    complete, consistent = (1 - missing) * 100, F.greatest(F.lit(0.0), 100 - duplicate * 100)
    return profile_table(df).select(
        F.round((complete + consistent) / 2, 2).alias("overall_score"),
        F.round(complete, 2).alias("completeness"),
        F.round(consistent, 2).alias("consistency"),
        F.col("missing_values"),
        F.col("duplicate_rows"),
        (complete < 90).alias("address_missing"),
        (F.col("duplicate_rows") > 0).alias("remove_duplicates"),
    )


def matching_quality(df: DataFrame) -> DataFrame:
    """0.4 completeness + 0.3 uniqueness + 0.3 text length (mean of column means, full at 20)."""
    text = columns_of_kind(df, "text")
    missing, duplicate = _ratios()
    length = F.lit(0.0)
    if text:
        means = [F.coalesce(F.avg(F.length(c)), F.lit(0.0)) for c in text]
        length = F.least(F.lit(1.0), df.agg((sum(means, F.lit(0.0)) / len(text)).alias("m")).scalar() / 20)
    score = (1 - missing) * 0.4 + (1 - duplicate) * 0.3 + length * 0.3
    return profile_table(df).select((clamp(score, 0.0, 1.0) * 100).alias("matching_quality"))


def governance_quality(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Completeness, case consistency, outlier validity and uniqueness per column, with flags."""
    number = [c for c in cols if column_kind(df, c) == "number"]
    text = {c for c in cols if column_kind(df, c) == "text"}
    measures = {}
    for c in cols:
        lower = safe_div(F.count_if(F.col(c) == F.lower(c)), F.count(c)) * 100 if c in text else F.lit(95.0)
        measures[c] = {
            "missing_pct": safe_div(F.count_if(F.col(c).isNull()), F.count(F.lit(1))) * 100,
            "consistency": F.coalesce(lower, F.lit(0.0)),
            "is_text": F.lit(c in text),
        }
    out = per_column(df, measures).join(cardinality(df, cols).select("column", "unique_pct"), "column")
    if number:
        rate = iqr_outliers(df, number).select(
            "column", (safe_div(F.col("outliers"), F.col("row_count")) * 100).alias("outlier_pct")
        )
        out = out.join(rate, "column", "left")
    else:
        out = out.withColumn("outlier_pct", F.lit(None).cast("double"))
    rated = F.greatest(F.lit(0.0), 100 - F.col("outlier_pct") * 2)
    validity = F.when(F.col("outlier_pct").isNotNull(), rated).otherwise(90.0)
    flags = F.array_compact(
        F.array(
            F.when(F.col("missing_pct") > 20, "Data Quality Risk"),
            F.when(F.col("is_text") & (F.col("consistency") < 80), "Standardization Required"),
            F.when(F.col("outlier_pct") > 5, "Outlier Management Needed"),
            F.when(F.contains(F.lower("column"), F.lit("id")) & (F.col("unique_pct") < 95), "Identity Integrity Risk"),
        )
    )
    scored = out.select(
        "column",
        (100 - F.col("missing_pct")).alias("completeness"),
        "consistency",
        validity.alias("validity"),
        F.col("unique_pct").alias("uniqueness"),
        F.array_join(flags, ", ").alias("governance_flags"),
    )
    return scored.withColumn("overall_score", (F.col("completeness") + F.col("consistency") + F.col("validity")) / 3)


def quality_level(score: Column) -> Column:
    return cases((score >= 90, "Excellent"), (score >= 70, "Good"), (score >= 50, "Fair"), otherwise="Poor")


def ts_quality(df: DataFrame, t: str, y: str, keys: Sequence[str] = ()) -> DataFrame:
    """Series quality per key: 100 - 2 * null % - outlier % - 50 * share of gaps over twice the mode."""
    from tabwork.operators.profile import iqr_bounds
    from tabwork.operators.windows import modal_gap, time_gaps

    keyed, group = (df, list(keys)) if keys else (df.withColumn("_all", F.lit(1)), ["_all"])
    rows = keyed.select(*group, t, F.col(y).cast("double").alias("_y"))
    bounds = iqr_bounds(rows, ["_y"], keys=group).drop("column")
    gaps = time_gaps(rows.select(*group, t), t, group)
    counts = gaps.filter(F.col("gap_seconds").isNotNull()).groupBy(*group, "gap_seconds").agg(F.count(F.lit(1)).alias("n"))
    # gap counts and values are joined on the series key after aggregation, not row by row
    far = (
        counts.join(modal_gap(gaps, group).select(*group, "modal_gap"), group)
        .groupBy(*group)
        .agg(F.sum(F.when((F.col("modal_gap") > 0) & (F.col("gap_seconds") > F.col("modal_gap") * 2), F.col("n")).otherwise(0)).alias("irregular_gaps"))
    )
    values = rows.groupBy(*group, "_y").agg(F.count(F.lit(1)).alias("n"))
    outside = (F.col("_y") < F.col("lower_bound")) | (F.col("_y") > F.col("upper_bound"))
    useful = F.col("q3") - F.col("q1") > 1e-10
    per_key = (
        values.join(bounds, group, "left")
        .groupBy(*group)
        .agg(
            F.sum("n").alias("data_points"),
            F.sum(F.when(F.col("_y").isNull(), F.col("n")).otherwise(0)).alias("missing"),
            F.sum(F.when(useful & outside, F.col("n")).otherwise(0)).alias("outside"),
        )
        .join(far, group, "left")
    )
    n = F.col("data_points")
    irregular = F.coalesce(F.col("irregular_gaps"), F.lit(0))
    outliers = F.when(n > 4, F.col("outside")).otherwise(0)
    score = clamp(100 - safe_div(F.col("missing"), n) * 200 - safe_div(outliers, n) * 100 - safe_div(irregular, n) * 50)
    return per_key.select(
        *keys, "data_points", "missing", outliers.alias("outliers"), irregular.alias("irregular_gaps"),
        score.alias("quality_score"), quality_level(score).alias("quality_level"),
    )


def text_value_quality(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Row-value quality of text: lowered for short, marked and overlong values; null is 0."""

    def score(c):
        v = strip(F.col(c))
        marked = F.lit(False)
        for m in fixed.BAD_MARKS:
            marked = marked | F.contains(v, F.lit(m))
        parts = (F.length(v) < 2, 0.5), (marked, 0.3), (F.length(v) > 200, 0.7)
        out = F.lit(1.0)
        for test, factor in parts:
            out = out * F.when(test, factor).otherwise(1.0)
        return F.when(F.col(c).isNull(), 0.0).otherwise(out)

    return append_columns(df, {f"{c}_data_quality": score(c) for c in cols})


def flag_anomalies(df: DataFrame, cols: Sequence[str], k: float = 1.5, source: DataFrame | None = None) -> DataFrame:
    """Outlier flag and distance past the bound, per numeric column."""
    q = quantile_struct(df if source is None else source, cols, {"q1": 0.25, "q3": 0.75})
    wide = df.withColumn("_q", q)
    out = {}
    for c in cols:
        q1, q3, v = F.col(f"_q.{c}.q1"), F.col(f"_q.{c}.q3"), F.col(c).cast("double")
        lo, hi = q1 - (q3 - q1) * k, q3 + (q3 - q1) * k
        distance = F.when(v < lo, lo - v).when(v > hi, v - hi).otherwise(0.0)
        out |= {f"{c}_is_anomaly": F.coalesce((v < lo) | (v > hi), F.lit(False)), f"{c}_anomaly_score": distance}
    return wide.withColumns(out).drop("_q")


def detect_anomalies(df: DataFrame) -> DataFrame:
    """Columns with over half nulls, over 5 % outliers or one value; duplicate rows."""
    nulls = per_column(
        df, {c: {"value": safe_div(F.count_if(F.col(c).isNull()), F.count(F.lit(1))) * 100} for c in df.columns}
    )
    rows = [nulls.filter("value > 50").select(F.lit("missing").alias("type"), "column", "value", F.lit(95).alias("confidence"))]
    number = columns_of_kind(df, "number")
    if number:
        out = iqr_outliers(df, number).filter(F.col("outliers") > F.col("row_count") * 0.05)
        rows.append(out.select(F.lit("outliers"), "column", F.col("outliers").cast("double"), F.lit(80)))
    constant = cardinality(df).filter("unique_count = 1")
    rows.append(constant.select(F.lit("constant"), "column", F.lit(1.0), F.lit(100)))
    copies = count_duplicates(df).filter("duplicate_rows > 0")
    rows.append(copies.select(F.lit("duplicates"), F.lit(""), F.col("duplicate_rows").cast("double"), F.lit(100)))
    found = rows[0]
    for r in rows[1:]:
        found = found.union(r)
    return found


def add_quality_columns(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """100 - null percent of each column, on every row."""
    share = df.agg(
        F.struct(*[(100 - safe_div(F.count_if(F.col(c).isNull()), F.count(F.lit(1))) * 100).alias(c) for c in cols]).alias("s")
    ).scalar()
    wide = df.withColumn("_s", share)
    return wide.withColumns({f"{c}_quality_score": F.col(f"_s.{c}") for c in cols}).drop("_s")


def add_readiness_columns(df: DataFrame, cols: Sequence[str], model_type: str) -> DataFrame:
    """100 or 0 by null per column, with the deployment marks."""
    return df.withColumns(
        {
            "deployment_ready": F.lit(True),
            "model_type": F.lit(model_type),
            **{f"{c}_quality_score": F.when(F.col(c).isNull(), 0).otherwise(100).cast("bigint") for c in cols},
        }
    )


def model_risk(metrics: DataFrame) -> DataFrame:
    """Risk points and level per run from accuracy or r2, data_size and num_features."""
    points = F.lit(0)
    for metric, low, fair in (("accuracy", 0.7, 0.8), ("r2", 0.5, 0.7)):
        points = points + F.when(F.col(metric) < low, 3).when(F.col(metric) < fair, 1).otherwise(0)
    points = points + F.when(F.col("data_size") < 1000, 2).when(F.col("data_size") < 5000, 1).otherwise(0)
    points = points + F.when(F.col("num_features") > F.col("data_size") / 10, 2).otherwise(0)
    level = cases((points >= 5, "High"), (points >= 3, "Medium"), otherwise="Low")
    return metrics.withColumns({"risk_score": points.cast("bigint"), "risk_level": level})


def governance_score(runs: DataFrame, compliance: float) -> DataFrame:
    """0.4 quality + 0.3 risk + 0.3 compliance, with a grade; needs quality_score and risk_level."""
    risk = cases(
        (F.col("risk_level") == "Low", 90.0), (F.col("risk_level") == "Medium", 70.0), (F.col("risk_level") == "High", 40.0),
        otherwise=50.0,
    )
    total = F.col("quality_score") * 0.4 + risk * 0.3 + F.lit(float(compliance)) * 0.3
    grade = cases((total >= 90, "A"), (total >= 80, "B"), (total >= 70, "C"), otherwise="D")
    return runs.withColumns({"governance_score": F.round(total, 1), "grade": grade})


def performance_level(metrics: DataFrame) -> DataFrame:
    """Level per run from accuracy where there is one, else from r2."""
    acc, r2 = F.col("accuracy"), F.col("r2")
    level = lambda v, cuts: cases(
        *[(v >= cut, word) for cut, word in zip(cuts, ("Excellent", "Good", "Fair"))], otherwise="Poor"
    )
    value = F.when(acc.isNotNull(), level(acc, (0.9, 0.8, 0.7))).otherwise(level(F.coalesce(r2, F.lit(0.0)), (0.8, 0.6, 0.4)))
    return metrics.withColumn("level", value)


def insight_rows(metrics: DataFrame, rules: Sequence[tuple]) -> DataFrame:
    """Rules (metric, low, high, title, format) kept where low <= value < high.

    metrics is long: run, metric, value. The rules are a constant array that each
    metric row unfolds, so nothing is shuffled.
    """
    table = F.array(
        *[
            F.struct(F.lit(m).alias("m"), F.lit(float(lo)).alias("lo"), F.lit(float(hi)).alias("hi"),
                     F.lit(title).alias("title"), F.format_string(text, "value").alias("description"))
            for m, lo, hi, title, text in rules
        ]
    )
    unfolded = metrics.select("run", "metric", "value", F.inline(table))
    kept = (F.col("m") == F.col("metric")) & (F.col("value") >= F.col("lo")) & (F.col("value") < F.col("hi"))
    return unfolded.filter(kept).select("run", "metric", "title", "description")
