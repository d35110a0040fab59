"""Row-level operators on a stream, and data quality per time window."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from tabwork.functions import calendar as cal, textfeat as tf


def row_features(stream: DataFrame, text: Sequence[str] = (), time: Sequence[str] = ()) -> DataFrame:
    """Text counts, content flags and calendar parts: expressions only, so they hold no state."""
    made = {}
    for c in text:
        made |= tf.text_counts(c) | tf.content_flags(c)
    for c in time:
        made |= cal.calendar_parts(c) | cal.day_flags(c)
    return stream.withColumns(made) if made else stream


def window_quality(stream: DataFrame, t: str, cols: Sequence[str], width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Rows and nulls per column and tumbling window; windows close when the watermark passes them."""
    counts = [F.count(F.lit(1)).alias("row_count"), *[F.count_if(F.col(c).isNull()).alias(f"{c}_missing") for c in cols]]
    return stream.withWatermark(t, late).groupBy(F.window(t, width).alias("window")).agg(*counts)
