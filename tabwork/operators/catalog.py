"""The column catalogue: one profile row per column, and rules over it."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from tabwork.functions import fixed
from tabwork.functions.calendar import FORMATS
from tabwork.functions.columns import column_kind, per_column, safe_div
from tabwork.operators.profile import cardinality, word_count

DATE_WIDTH = 19


def marks(form: str) -> str:
    """A LIKE pattern of the fixed characters of a date format."""
    return re.sub("[A-Za-z]+", "%", form)


def column_profile(df: DataFrame, dataset: str, cols: Sequence[str] | None = None) -> DataFrame:
    """Every figure the catalogue rules use, in two passes over the table."""
    cols = list(cols or df.columns)
    none_d, none_b = F.lit(None).cast("double"), F.lit(None).cast("boolean")
    measures = {}
    for i, c in enumerate(cols):
        kind, x = column_kind(df, c), F.col(c)
        number, text = kind == "number", kind == "text"
        known = F.count(c)
        if text:
            short = F.when(F.length(c) <= DATE_WIDTH, x)
            # a value without a format's marks is not parsed: a failed parse costs far more
            fits = [F.count(F.when(x.like(marks(f)), F.try_to_timestamp(short, F.lit(f)))) == known for f in FORMATS]
            dated = fits[0]
            for fit in fits[1:]:
                dated = dated | fit
            dated = dated & (known > 0)
        measures[c] = {
            "dataset": F.lit(dataset),
            "position": F.lit(i).cast("bigint"),
            "kind": F.lit(kind),
            "type": F.lit(df.schema[c].dataType.simpleString()),
            "row_count": F.count(F.lit(1)),
            "missing": F.count_if(x.isNull()),
            "missing_pct": F.coalesce(safe_div(F.count_if(x.isNull()), F.count(F.lit(1))) * 100, F.lit(0.0)),
            "min": F.min(x.cast("double")) if number else none_d,
            "max": F.max(x.cast("double")) if number else none_d,
            "mean": F.avg(x) if number else none_d,
            "sd": F.stddev_samp(x) if number else none_d,
            "avg_length": F.avg(F.length(x)) if text else none_d,
            "avg_words": F.avg(word_count(x)) if text else none_d,
            "has_at": F.bool_or(F.contains(x, F.lit("@"))) if text else none_b,
            "has_digit": F.bool_or(x.rlike("[0-9]")) if text else none_b,
            "has_separator": F.bool_or(x.rlike("[-/:]")) if text else none_b,
            "all_dates": dated if text else none_b,
        }
    figures = per_column(df, measures)
    return figures.join(cardinality(df, cols), "column")


def named(words: Sequence[str]) -> Column:
    """The lower-cased column name contains one of the words."""
    low = F.lower(F.col("column"))
    hit = F.lit(False)
    for w in words:
        hit = hit | F.contains(low, F.lit(w))
    return hit


def cases(*pairs: tuple[Column, object], otherwise=None) -> Column:
    """First pair whose condition holds."""
    out = F.when(pairs[0][0], pairs[0][1])
    for condition, value in pairs[1:]:
        out = out.when(condition, value)
    return out.otherwise(otherwise)




def _is(kind: str) -> Column:
    return F.col("kind") == kind


def _share() -> Column:
    return safe_div(F.col("unique_count"), F.col("row_count"))


U, MISS = "unique_count", "missing_pct"


def categorize_columns(profile: DataFrame) -> DataFrame:
    """categorical_numeric, integer, continuous, categorical, text, datetime or other."""
    whole = F.col("type").isin("int", "bigint")
    category = cases(
        (_is("number") & (F.col(U) < 10), "categorical_numeric"),
        (_is("number") & whole, "integer"),
        (_is("number"), "continuous"),
        (_is("text") & (_share() < 0.1), "categorical"),
        (_is("text"), "text"),
        (_is("datetime"), "datetime"),
        otherwise="other",
    )
    return profile.select("dataset", "column", category.alias("category"))


def classify_columns(profile: DataFrame) -> DataFrame:
    """Semantic type, meaning, data category and privacy level by name, else by kind."""
    general = ("General", "Public")
    rules = [(named(r[0]), r[1:]) for r in fixed.SEMANTIC_RULES]
    rules += [(_is(k), (t, m, *general)) for k, t, m in fixed.SEMANTIC_BY_KIND]
    default = (*fixed.SEMANTIC_DEFAULT, *general)
    fields = ("semantic_type", "business_meaning", "data_category", "privacy_level")
    return profile.select(
        "dataset",
        "column",
        "position",
        *[cases(*[(c, v[i]) for c, v in rules], otherwise=default[i]).alias(f) for i, f in enumerate(fields)],
        F.floor(F.greatest(F.lit(0.0), 100 - F.col(MISS))).cast("bigint").alias("quality_score"),
        "missing",
        "row_count",
    )


def pattern_hints(profile: DataFrame) -> DataFrame:
    """Text columns that hold an @ or a digit anywhere."""
    return profile.filter(_is("text")).select(
        "dataset", "column", F.coalesce("has_at", F.lit(False)).alias("has_at"), F.coalesce("has_digit", F.lit(False)).alias("has_digit")
    )


def smart_tags(catalog: DataFrame) -> DataFrame:
    """Data-set tags from the classified columns: first five semantic types, first three categories, privacy, quality.

    Each column unfolds into one row per tag family, so the catalogue is read once.
    """
    families = F.array(
        F.struct(F.lit("semantic").alias("type"), F.col("semantic_type").alias("word")),
        F.struct(F.lit("category").alias("type"), F.col("data_category").alias("word")),
        F.struct(F.lit("privacy").alias("type"), F.col("privacy_level").alias("word")),
        F.struct(F.lit("quality").alias("type"), F.lit("").alias("word")),
    )
    facts = (
        catalog.select("dataset", "position", "quality_score", F.inline(families))
        .groupBy("dataset", "type", "word")
        .agg(F.count(F.lit(1)).alias("n"), F.min("position").alias("_p"), F.avg("quality_score").alias("q"))
    )
    order = Window.partitionBy("dataset", "type").orderBy("_p")  # a handful of words per data set
    ranked = facts.withColumn("_r", F.row_number().over(order))
    kind, good = F.col("type"), F.col("q") > 90
    kept = cases(
        (kind == "semantic", F.col("_r") <= 5),
        (kind == "category", F.col("_r") <= 3),
        (kind == "privacy", F.col("word") == "Confidential"),
        otherwise=good | (F.col("q") < 60),
    )
    return ranked.filter(kept).select(
        "dataset",
        cases(
            (kind == "semantic", F.concat(F.lit("Contains "), "word")),
            (kind == "category", F.concat("word", F.lit(" Data"))),
            (kind == "privacy", F.lit("Contains Sensitive Data")),
            (good, F.lit("High Quality Dataset")),
            otherwise=F.lit("Needs Data Cleaning"),
        ).alias("tag"),
        "type",
        cases((kind == "semantic", 0.9), (kind == "category", 0.8), (kind == "privacy", 0.95), (good, 0.9), otherwise=0.8).alias("confidence"),
        F.when(kind == "quality", F.round("q", 1)).otherwise(F.col("n").cast("double")).alias("value"),
    )


def _found_in(text: Column):
    return lambda w: F.contains(text, w)


def search_catalog(catalog: DataFrame, text: str, k: int = 10) -> DataFrame:
    """Columns scored 3 / 2 / 1 / 2 for a query word in type, meaning, category or name; the best k."""
    words = F.array(*[F.lit(w) for w in text.lower().split()])
    weights = {"semantic_type": 3, "business_meaning": 2, "data_category": 1, "column": 2}
    score = F.lit(0).cast("bigint")
    for field, weight in weights.items():
        low = F.lower(F.col(field))
        score = score + F.when(F.exists(words, _found_in(low)), weight).otherwise(0)
    scored = catalog.withColumn("relevance_score", score).filter("relevance_score > 0")
    return (
        scored.orderBy(F.desc("relevance_score"), "dataset", "position")
        .limit(k)
        .select("dataset", "column", "semantic_type", "relevance_score")
    )


def etl_recommendations(catalog: DataFrame) -> DataFrame:
    """Advice rows per data set, each kept by its own condition on the catalogue."""
    facts = catalog.groupBy("dataset").agg(
        (100 - F.sum("missing") * 100 / F.sum("row_count")).alias("complete"),
        F.bool_or(F.col("privacy_level") == "Confidential").alias("secret"),
        F.max("row_count").alias("rows"),
        F.bool_or(F.col("semantic_type").isin("Text", "Email", "Phone")).alias("text"),
    )
    rules = [
        (F.col("complete") < 90, "Data Completeness", "High"),
        (F.col("secret"), "Data Security", "Critical"),
        (F.col("rows") > 100000, "Performance", "Medium"),
        (F.col("text"), "Data Standardization", "Medium"),
    ]
    advice = F.array(*[F.struct(c.alias("kept"), F.lit(a).alias("category"), F.lit(p).alias("priority")) for c, a, p in rules])
    return facts.select("dataset", F.inline(advice)).filter("kept").drop("kept")


def fe_potential(profile: DataFrame) -> DataFrame:
    """Feature-engineering potential and the techniques that suit the column."""
    low_number = (F.col(MISS) > 50) | (F.coalesce(F.col("sd"), F.lit(1.0)) == 0)
    level = cases(
        (F.col(MISS) > 70, "Low"),
        (_is("number") & (F.col(U) < 5), "Medium"),
        (_is("number") & low_number, "Low"),
        (_is("number"), "High"),
        (_is("text") & (_share() > 0.95), "Medium"),
        (_is("text") & (F.col(U) < 20), "High"),
        (_is("text"), "Medium"),
        (_is("datetime"), "High"),
        otherwise="Medium",
    )
    techniques = F.array_compact(
        F.array(
            *[F.when(_is("number"), t) for t in ("statistical", "interaction", "polynomial", "binning")],
            F.when(_is("number") & (F.col(U) > 10), "clustering"),
            *[F.when(_is("text"), t) for t in ("categorical", "frequency")],
            F.when(_is("text") & (F.col("avg_words") > 3), "text"),
            F.when(_is("datetime") | F.col("all_dates"), "temporal"),
            F.lit("aggregation"),
        )
    )
    return profile.select(
        "dataset", "column", level.alias("potential"), F.array_join(F.array_sort(techniques), ",").alias("techniques")
    )


# fixed values: distinct-value limits of the target rules, by preset
# (least and most for a numeric class target, least numeric for regression, most for a text class target)
TARGET_PRESETS = {
    "automl": (2, 20, 21, 50),
    "code_free": (2, 20, 21, 10),
    "governance": (0, 20, 21, 10),
    "deployment": (2, 19, 21, 49),
}


def target_suitability(profile: DataFrame, preset: str = "automl") -> DataFrame:
    """Problem type a column could be the target of, else null, by one of four rule sets."""
    low, high, regression, text_high = TARGET_PRESETS[preset]
    usable = F.col(MISS) < 30 if preset == "governance" else F.lit(True)
    text_low = 0 if preset == "deployment" else 2
    kind = cases(
        (usable & _is("number") & F.col(U).between(low, high), "classification"),
        (usable & _is("number") & (F.col(U) >= regression), "regression"),
        (usable & _is("text") & F.col(U).between(text_low, text_high), "classification"),
    )
    return profile.select("dataset", "column", kind.isNotNull().alias("suitable"), kind.alias("problem_type"))


def text_suitability(profile: DataFrame) -> DataFrame:
    return profile.select(
        "dataset", "column", (_is("text") & (F.coalesce(F.col("avg_length"), F.lit(0.0)) > 10)).alias("text_suitable")
    )


def drift_suitability(profile: DataFrame) -> DataFrame:
    kind = cases(
        (_is("number") & (F.col(U) < 2), "Constant"),
        (_is("number") & (F.col(MISS) > 90), "Too many missing"),
        (_is("number"), "Numerical Distribution"),
        (_is("text") & (_share() > 0.9), "High cardinality"),
        (_is("text"), "Categorical Distribution"),
        otherwise="Statistical",
    )
    bad = F.col("drift_type").isin("Constant", "Too many missing", "High cardinality")
    return profile.select("dataset", "column", kind.alias("drift_type")).withColumn("suitable", ~bad)


def matching_suitability(profile: DataFrame) -> DataFrame:
    """Suitability for matching, and two ratings for clustering."""
    long_text = _is("text") & (F.col("avg_length") > 5) & (F.col(U) > 1)
    constant = _is("text") & (F.col(U) == 1)
    few, holed = _is("number") & (F.col(U) < 5), _is("number") & (F.col(MISS) > 50)
    return profile.select(
        "dataset",
        "column",
        cases((long_text, "Excellent"), (constant, "Poor"), (few, "Low"), (holed, "Poor"), otherwise="High").alias("matching"),
        cases((long_text, "Excellent"), (constant, "Poor"), (few, "Fair"), (holed, "Poor"), otherwise="Good").alias(
            "clustering_potential"
        ),
        cases(
            (_is("number") & (F.col(U) < 3), "Low"),
            (holed, "Medium"),
            (_is("text") & (_share() > 0.8), "Low"),
            (_is("text") & (F.col(U) >= 10), "Medium"),
            otherwise="High",
        ).alias("clustering_suitability"),
    )


def ts_suitability(profile: DataFrame) -> DataFrame:
    """Suitability as time or target column of a series."""
    level = cases(
        (_is("datetime"), "Excellent"),
        (_is("text") & F.coalesce(F.col("all_dates"), F.lit(False)), "Good"),
        (_is("text") & (named(fixed.TIME_NAMES) | F.coalesce(F.col("has_separator"), F.lit(False))), "Medium"),
        (_is("number") & (F.col(U) > 5) & (F.col(MISS) < 80), "Good"),
        otherwise="Low",
    )
    return profile.select(
        "dataset",
        "column",
        (_is("datetime") | F.coalesce(F.col("all_dates"), F.lit(False))).alias("is_datetime"),
        (_is("number") & (F.col(MISS) < 50)).alias("is_target"),
        level.alias("suitability"),
    )


def enrichment_potential(profile: DataFrame) -> DataFrame:
    by_name = [(named(words), ("High", reason)) for words, reason in fixed.ENRICH_RULES]
    rules = by_name + [
        (_is("number"), ("Medium", "Numeric data suitable for statistical enrichment")),
        (_is("text") & (_share() < 0.5), ("Medium", "Categorical data suitable for encoding and clustering")),
        (F.col(U) == 1, ("Low", "Constant values - limited enrichment potential")),
    ]
    default = ("Medium", "General data suitable for basic enrichment")
    return profile.select(
        "dataset",
        "column",
        *[cases(*[(c, v[i]) for c, v in rules], otherwise=default[i]).alias(f) for i, f in enumerate(("level", "reason"))],
    )


def governance_relevance(profile: DataFrame) -> DataFrame:
    number = _is("number") & (F.col(U) > 10) & (F.col(MISS) < 20)
    text = _is("text") & (_share() < 0.8)
    return profile.select(
        "dataset",
        "column",
        F.when(number | text, "High").otherwise("Medium").alias("relevance"),
        cases((number & (F.col(MISS) > 10), "Medium"), (text & named(("id", "key")), "High"), otherwise="Low").alias("risk"),
    )


def null_share_level(profile: DataFrame) -> DataFrame:
    """Deployment suitability and quality word by null share."""
    over50, over20 = F.col(MISS) > 50, F.col(MISS) > 20
    return profile.select(
        "dataset",
        "column",
        cases((over50, "Low"), (over20, "Medium"), otherwise="High").alias("deployment"),
        cases((over50, "Poor"), (over20, "Fair"), otherwise="Good").alias("quality"),
    )


def column_flags(profile: DataFrame) -> DataFrame:
    return profile.select(
        "dataset",
        "column",
        _is("number").alias("is_numeric"),
        (~_is("number") & (F.col(U) < 10)).alias("is_categorical"),
        (_is("text") & (F.col(U) > 10)).alias("is_text"),
        _is("datetime").alias("is_datetime"),
        U,
        "missing",
    )


def column_characteristics(profile: DataFrame) -> DataFrame:
    """A short description and the quality percent."""
    words = cases(
        (_is("number"), F.format_string("Numeric: %.2f to %.2f", "min", "max")),
        (_is("text"), F.format_string("Text/Categorical: %d unique values", U)),
        otherwise=F.concat(F.lit("Data type: "), F.col("type")),
    )
    return profile.select("dataset", "column", words.alias("characteristics"), (100 - F.col(MISS)).alias("quality_pct"))


def column_advice(profile: DataFrame) -> DataFrame:
    """Summary and recommendation by kind, null share and cardinality."""
    summary = cases(
        (_is("number"), F.format_string("Numeric column with %d unique values. Range: %.2f to %.2f", U, "min", "max")),
        (_is("text"), F.format_string("Categorical column with %d unique values", U)),
        otherwise=F.format_string("Column of type %s with %d unique values", "type", U),
    )
    advice = cases(
        (_is("number") & (F.col(MISS) < 5), "Good quality numeric data. Consider for statistical analysis."),
        (_is("number") & (F.col(MISS) < 20), "Some missing values. Consider for imputation strategies."),
        (_is("number"), "High missing values. Investigate data collection process."),
        (_is("text") & (_share() > 0.8), "High cardinality. Consider grouping or encoding strategies."),
        (_is("text") & (F.col(U) < 10), "Low cardinality. Good for categorical analysis."),
        (_is("text"), "Medium cardinality. Suitable for most analyses."),
        otherwise="Review data type and consider appropriate preprocessing.",
    )
    return profile.select("dataset", "column", summary.alias("summary"), advice.alias("recommendation"))


def quality_issues(profile: DataFrame) -> DataFrame:
    """Columns with over 20 % nulls, text columns with over 80 % distinct values."""
    holes = profile.filter(F.col(MISS) > 20).select(
        "dataset", "column", F.lit("missing values").alias("issue"), F.col(MISS).alias("pct")
    )
    wide = profile.filter(_is("text") & (_share() > 0.8)).select(
        "dataset", "column", F.lit("high cardinality").alias("issue"), (_share() * 100).alias("pct")
    )
    return holes.unionByName(wide)


def tag_sensitive(profile: DataFrame) -> DataFrame:
    """Sensitive, demographic and geographic columns by name."""
    kinds = (("sensitive", fixed.SENSITIVE_NAMES, "High"), ("demographic", fixed.DEMOGRAPHIC_NAMES, "High"),
             ("geographic", fixed.GEOGRAPHIC_NAMES, "Medium"))
    tags = F.array(*[F.struct(named(w).alias("hit"), F.lit(k).alias("tag"), F.lit(r).alias("risk_level")) for k, w, r in kinds])
    return profile.select("dataset", "column", F.inline(tags)).filter("hit").drop("hit")


def cv_risk(profile: DataFrame) -> DataFrame:
    """Drift risk of numeric columns by coefficient of variation."""
    cv = F.coalesce(safe_div(F.col("sd"), F.col("mean")), F.lit(0.0))
    return profile.filter(_is("number")).select(
        "dataset", "column", cv.alias("cv"), cases((cv > 1, "High"), (cv > 0.5, "Medium"), otherwise="Low").alias("level")
    )
