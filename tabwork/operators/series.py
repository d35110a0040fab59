"""Many time series in one job: rows are (keys..., t, y)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from tabwork.functions.calendar import elapsed_seconds, parse_datetime
from tabwork.functions.columns import column_kind, safe_div
from tabwork.functions.stats import normal_quantile
from tabwork.operators.lookup import attach
from tabwork.operators.ordered import number_rows, trailing
from tabwork.operators.windows import modal_gap, smoothing_weight

DAY = 86400
MODELS = ("linear", "moving_average", "smoothing", "mean")


def prepare_series(
    df: DataFrame, t: str, y: str, keys: Sequence[str] = (), order_by: Sequence[str] = ()
) -> DataFrame:
    """Parsed, non-null rows with the last value per time; order_by says which row is last."""
    time = parse_datetime(F.col(t)) if column_kind(df, t) == "text" else F.col(t)
    rows = df.select(
        *keys, time.alias("t"), F.col(y).try_cast("double").alias("y"), F.struct(*[F.col(c) for c in order_by or [y]]).alias("_o")
    ).filter(F.col("t").isNotNull() & F.col("y").isNotNull())
    return rows.groupBy(*keys, "t").agg(F.max_by("y", "_o").alias("y"))


def numbered_series(series: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Row number, row count and the gap to the time before."""
    seconds = elapsed_seconds(series, "t")

    def build(_frame, order):
        return {"gap_seconds": seconds - F.lag(seconds).over(order)}

    return trailing(series, build, 1, ["t"], keys, number="rn", total="n")


def _keyed(series: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, list[str]]:
    """A constant key where there is none, so one series and many take the same path."""
    return (series, list(keys)) if keys else (series.withColumn("_series", F.lit(0)), ["_series"])


def fit_series(series: DataFrame, keys: Sequence[str], alpha: float = 0.3, window: int = 7) -> DataFrame:
    """All figures the forecasts need, one row per key: trend, level, spread, last time, modal gap."""
    numbered = numbered_series(series, keys)
    x = F.col("rn") - 1
    n, y = F.col("n"), F.col("y")
    fitted = numbered.groupBy(*keys).agg(
        F.max("n").alias("n"),
        F.max("t").alias("last_t"),
        F.min("t").alias("first_t"),
        F.min_by("y", "rn").alias("first_y"),
        F.max_by("y", "rn").alias("last_y"),
        F.coalesce(F.regr_slope(y, x), F.lit(0.0)).alias("slope"),
        F.coalesce(F.regr_intercept(y, x), F.avg(y)).alias("intercept"),
        F.avg(y).alias("mean"),
        F.stddev_samp(y).alias("sd"),
        F.stddev_pop(y).alias("sd_pop"),
        F.min(y).alias("min"),
        F.max(y).alias("max"),
        (F.regr_syy(y, x) - F.coalesce(safe_div(F.regr_sxy(y, x) * F.regr_sxy(y, x), F.regr_sxx(y, x)), F.lit(0.0))).alias("_sse"),
        F.avg(F.when(F.col("rn") > n - window, y)).alias("moving_average"),
        F.sum(y * smoothing_weight(F.col("rn"), n, alpha)).alias("smoothing"),
    )
    fitted = fitted.withColumn("rmse", F.sqrt(F.greatest(F.col("_sse") / F.col("n"), F.lit(1e-10)))).drop("_sse")
    gaps = modal_gap(numbered.select(*keys, "gap_seconds"), keys).drop("gaps")
    gap = F.coalesce("modal_gap", F.lit(DAY))
    return fitted.join(gaps, list(keys), "left").withColumn("modal_gap", gap)


def analyze_series(series: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Points, range, statistics, direction and trend slope per key."""
    s, group = _keyed(series, keys)
    fit = fit_series(s, group)
    day = lambda c: F.date_format(c, "yyyy-MM-dd")
    return fit.select(
        *keys,
        F.col("n").alias("data_points"),
        day("first_t").alias("start"),
        day("last_t").alias("end"),
        "mean",
        "sd",
        "min",
        "max",
        F.when(F.col("last_y") > F.col("first_y"), "increasing").otherwise("decreasing").alias("trend"),
        F.col("slope").alias("trend_slope"),
    )


def weekly_seasonality(series: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Sample sd of the weekday means per key; 0 for series of up to twelve points."""
    s, group = _keyed(series, keys)
    days = s.groupBy(*group, F.weekday("t").alias("_d")).agg(F.avg("y").alias("_m"), F.count(F.lit(1)).alias("_n"))
    spread = F.when(F.sum("_n") > 12, F.stddev_samp("_m"))
    return days.groupBy(*group).agg(F.coalesce(spread, F.lit(0.0)).alias("weekly_seasonality")).select(
        *keys, "weekly_seasonality"
    )


def level_of(model: str, step: Column) -> Column:
    """Forecast value of a fitted row at a step from 1."""
    if model == "linear":
        return F.col("slope") * (F.col("n") - 1 + step) + F.col("intercept")
    if model in MODELS:
        return F.col(model)
    raise ValueError(f"model must be one of {MODELS}")


def future_rows(fit: DataFrame, periods: int) -> DataFrame:
    """Steps 1..periods with their times: last time plus whole modal gaps."""
    steps = fit.withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(periods))))
    at = F.timestamp_add("SECOND", F.col("step") * F.col("modal_gap"), F.col("last_t"))
    return steps.withColumn("t", at).withColumn("step", F.col("step").cast("bigint"))


def interval_residual(y: Column, confidence: float) -> tuple[Column, Column]:
    """y +- z * residual error of the fitted row."""
    margin = F.col("rmse") * normal_quantile(confidence)
    return y - margin, y + margin


def interval_spread(forecasts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Bounds by 1.96 * sd of the forecast values over sqrt(n); forecasts have y and n."""
    spread = forecasts.groupBy(*keys).agg((F.stddev_pop("y") * 1.96 / F.sqrt(F.max("n"))).alias("_margin"))
    out = forecasts.join(spread, list(keys))
    return out.withColumns({"lower_ci": F.col("y") - F.col("_margin"), "upper_ci": F.col("y") + F.col("_margin")}).drop("_margin")


def forecast_rows(
    series: DataFrame,
    periods: int,
    model: str = "linear",
    keys: Sequence[str] = (),
    interval: str = "residual",
    confidence: float = 0.95,
    alpha: float = 0.3,
    window: int = 7,
) -> DataFrame:
    """Forecasts with bounds: (keys..., step, t, y, lower_ci, upper_ci)."""
    s, group = _keyed(series, keys)
    fit = fit_series(s, group, alpha, window)
    if model == "moving_average":
        # a full window is needed for a moving average
        fit = fit.withColumn("moving_average", F.when(F.col("n") >= window, F.col("moving_average")))
    rows = future_rows(fit, periods).withColumn("y", level_of(model, F.col("step")))
    if interval == "spread":
        rows = interval_spread(rows, group)
    elif model == "mean":
        margin = F.col("sd_pop") * normal_quantile(confidence)
        rows = rows.withColumns({"lower_ci": F.col("y") - margin, "upper_ci": F.col("y") + margin})
    else:
        low, high = interval_residual(F.col("y"), confidence)
        rows = rows.withColumns({"lower_ci": low, "upper_ci": high})
    return rows.select(*keys, "step", "t", "y", "lower_ci", "upper_ci")


def forecast_linear(series: DataFrame, periods: int, keys: Sequence[str] = (), **options) -> DataFrame:
    return forecast_rows(series, periods, "linear", keys, **options)


def forecast_ma(series: DataFrame, periods: int, window: int = 7, keys: Sequence[str] = ()) -> DataFrame:
    return forecast_rows(series, periods, "moving_average", keys, interval="spread", window=window)


def forecast_ses(series: DataFrame, periods: int, alpha: float = 0.3, keys: Sequence[str] = ()) -> DataFrame:
    return forecast_rows(series, periods, "smoothing", keys, interval="spread", alpha=alpha)


def forecast_mean(series: DataFrame, periods: int, keys: Sequence[str] = (), confidence: float = 0.95) -> DataFrame:
    return forecast_rows(series, periods, "mean", keys, confidence=confidence)


def forecast_constant(series: DataFrame, periods: int, keys: Sequence[str] = ()) -> DataFrame:
    """The mean with bounds of a tenth of it, the last resort for unfit series."""
    rows = forecast_rows(series, periods, "mean", keys)
    error = F.when(F.col("y") != 0, F.abs("y") * 0.1).otherwise(1.0) * 1.96
    return rows.withColumns({"lower_ci": F.col("y") - error, "upper_ci": F.col("y") + error})


def fitted_rows(series: DataFrame, keys: Sequence[str] = (), first_share: float = 1.0) -> DataFrame:
    """Linear fit on every row: (keys..., t, y, rn, n, fitted, residual).

    With first_share under 1 only the first floor(share * n) rows make the fit.
    """
    s, group = _keyed(series, keys)
    numbered = number_rows(s, ["t"], group, "rn", "n")
    x = F.col("rn") - 1
    used = F.when(F.col("rn") <= F.floor(F.col("n") * first_share), F.col("y"))
    fit = numbered.groupBy(*group).agg(
        F.coalesce(F.regr_slope(used, x), F.lit(0.0)).alias("_slope"),
        F.coalesce(F.regr_intercept(used, x), F.avg(used)).alias("_intercept"),
        F.avg("y").alias("mean_y"),
        F.count(F.lit(1)).alias("_w"),
    )
    out = attach(numbered, fit, group, "_w").withColumn("fitted", F.col("_slope") * x + F.col("_intercept"))
    return out.withColumn("residual", F.col("y") - F.col("fitted")).drop("_slope", "_intercept", "_w", "_series")


def fit_metrics(series: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """MAE, MSE, RMSE, MAPE and clamped R2 of the linear fit per key."""
    rows, group = _keyed(fitted_rows(series, keys), keys)
    r, y = F.col("residual"), F.col("y")
    dev = y - F.col("mean_y")
    out = rows.groupBy(*group).agg(
        F.avg(F.abs(r)).alias("mae"),
        F.avg(r * r).alias("mse"),
        (F.coalesce(F.avg(F.when(F.abs(y) > 1e-10, F.abs(r / y))), F.lit(0.0)) * 100).alias("mape"),
        (1 - F.sum(r * r) / F.greatest(F.sum(dev * dev), F.lit(1e-10))).alias("_r2"),
    )
    return out.select(
        *keys,
        "mae",
        "mse",
        F.sqrt(F.greatest("mse", F.lit(1e-10))).alias("rmse"),
        "mape",
        F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("_r2"))).alias("r_squared"),
    )


def forecast_summary(forecasts: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Mean, spread, ends, slope and direction of the forecast values per key."""
    f, group = _keyed(forecasts, keys)
    steps = F.greatest(F.count(F.lit(1)) - 1, F.lit(1))
    out = f.groupBy(*group).agg(
        F.avg("y").alias("forecast_mean"),
        F.stddev_pop("y").alias("forecast_sd"),
        F.min("y").alias("forecast_min"),
        F.max("y").alias("forecast_max"),
        ((F.max_by("y", "step") - F.min_by("y", "step")) / steps).alias("trend_slope"),
    )
    direction = F.when(F.col("trend_slope") > 0.01, "Increasing").when(F.col("trend_slope") < -0.01, "Decreasing")
    return out.withColumn("trend_direction", direction.otherwise("Stable")).drop("_series")


def holdout_metrics(series: DataFrame, keys: Sequence[str] = (), share: float = 0.8, least: int = 10) -> DataFrame:
    """Errors on the last rows of a linear fit to the first ones, for series of `least` points or more."""
    rows, group = _keyed(fitted_rows(series, keys, share), keys)
    test = rows.filter((F.col("n") >= least) & (F.col("rn") > F.floor(F.col("n") * share)))
    r = F.col("residual")
    out = test.groupBy(*group).agg(
        F.avg(F.abs(r)).alias("mae"),
        F.avg(r * r).alias("mse"),
        F.sqrt(F.avg(r * r)).alias("rmse"),
        (F.avg(F.abs(safe_div(r, F.col("y")))) * 100).alias("mape"),
        F.count(F.lit(1)).alias("validation_points"),
    )
    return out.drop("_series")


def enlarge_series(series: DataFrame, periods: int, keys: Sequence[str] = (), confidence: float = 0.95) -> DataFrame:
    """History with fitted values and residuals, then forecast rows with bounds."""
    history = fitted_rows(series, keys).select(
        *keys, "t", "y", F.col("fitted").alias("fitted_values"), F.col("residual").alias("residuals"), F.lit(False).alias("is_forecast")
    )
    future = forecast_linear(series, periods, keys, confidence=confidence).select(
        *keys, "t", "y", F.col("y").alias("fitted_values"), "lower_ci", "upper_ci",
        F.lit(True).alias("is_forecast"), F.col("step").alias("forecast_period"),
    )
    return history.unionByName(future, allowMissingColumns=True)
