"""The forecast job: from a raw table to history and forecast rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from tabwork.operators import series as s


def forecast(
    df: DataFrame,
    t: str,
    y: str,
    periods: int,
    model: str = "linear",
    keys: Sequence[str] = (),
    order_by: Sequence[str] = (),
    interval: str = "spread",
) -> DataFrame:
    """History and forecast of every series: (keys..., t, y, type, lower_ci, upper_ci)."""
    series = s.prepare_series(df, t, y, keys, order_by)
    future = s.forecast_rows(series, periods, model, keys, interval).select(
        *keys, "t", "y", F.lit("forecast").alias("type"), "lower_ci", "upper_ci"
    )
    history = series.select(
        *keys, "t", "y", F.lit("historical").alias("type"), F.col("y").alias("lower_ci"), F.col("y").alias("upper_ci")
    )
    return history.unionByName(future)
