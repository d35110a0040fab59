"""The feature job: named feature families over the selected columns, and the feature table."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, functions as F

from tabwork.functions import calendar as cal, numeric as nf, textfeat as tf
from tabwork.functions.columns import column_kind
from tabwork.operators import cluster, encode, groups, quality, scaling, windows

ONE_HOT = 15



def generate_features(
    df: DataFrame, cols: Sequence[str], families: Sequence[str], order_by: Sequence[str] = (), partition_by: Sequence[str] = ()
) -> tuple[DataFrame, DataFrame]:
    """The table with all features, and (name, type). A name made twice keeps its first family.

    The statistics of every family are read from the given table, so the plan
    grows by one pass per family and not with the columns already made. Families: statistical (needs order_by), temporal, categorical, interaction,
    text, aggregation, polynomial, binning, clustering, frequency.
    """
    number = [c for c in cols if column_kind(df, c) == "number"]
    text = [c for c in cols if column_kind(df, c) == "text"]
    time = [c for c in cols if column_kind(df, c) == "datetime"]

    def expressions(maker: Callable[[str], dict], names: Sequence[str]):
        return lambda t: t.withColumns({k: v for c in names for k, v in maker(c).items()}) if names else t

    def statistical(t):
        if not number:
            return t
        t = windows.ordered_features(t, number, order_by, partition_by)
        t = windows.cumulative_features(t, number, order_by, partition_by)
        for c in number:
            t = groups.percent_rank_avg(t, c, source=df)
        t = scaling.scale(scaling.scale(t, number, "zscore", df), number, "minmax", df)
        return quality.flag_anomalies(scaling.log_sqrt(t, number, df), number, source=df)

    def categorical(t):
        for c in text:
            if encode.levels(df, c, ONE_HOT) is not None:  # a column of more values has codes and frequencies
                t = encode.one_hot(t, c, ONE_HOT, source=df)
            t = encode.label_encode(t, c, source=df)
            t = encode.frequency_features(t, c, ["frequency", "frequency_pct", "rank", "is_rare"], df)
        return t

    def frequency(t):
        for c in [*number, *text]:
            t = encode.frequency_features(t, c, ["freq_rank", "freq_percentile", "is_common"], df)
        return t

    def text_features(t):
        makers = (tf.text_counts, tf.char_class_counts, tf.mark_counts, tf.char_ratios, tf.sentence_stats, tf.content_flags,
                  tf.shape_flags, tf.sentiment_score, tf.avg_syllables, tf.flesch)
        for make in makers:
            t = expressions(make, text)(t)
        return t

    def temporal(t):
        for make in (cal.calendar_parts, cal.day_flags, cal.boundary_flags, cal.cyclic_features, cal.epoch_features, cal.season):
            t = expressions(make, time)(t)
        return t

    def interaction(t):
        made = {}
        for make in (nf.interaction_features, nf.interaction_pow, nf.interaction_dist, nf.interaction_stats, nf.interaction_cmp, nf.interaction_ratio):
            made |= make(number)
        return t.withColumns(made | nf.self_powers(number)) if number else t

    def aggregation(t):
        for c in text:
            for v in number:
                t = groups.group_deviation(t, c, v, df)
        return t.withColumns(nf.row_stats(number) | nf.row_counts(number)) if len(number) > 1 else t

    def polynomial(t):
        return scaling.polynomial_features(t, number, source=df) if number else t

    def binning(t):
        if not number:
            return t
        for n in (5, 10):
            t = scaling.bin_quantile(scaling.bin_equal(t, number, n, df), number, n, source=df)
        return scaling.bin_percentile(scaling.bin_std(t, number, df), number, df)

    def clustering(t):
        return cluster.cluster_features(t, number) if len(number) > 1 else t

    makers = {
        "statistical": statistical, "temporal": temporal, "categorical": categorical, "interaction": interaction, "text": text_features,
        "aggregation": aggregation, "polynomial": polynomial, "binning": binning, "clustering": clustering, "frequency": frequency,
    }
    out, listed = df, []
    for family in families:
        if family not in makers:
            raise ValueError(f"unknown family {family}; known are {sorted(makers)}")
        made = makers[family](out)
        fresh = [c for c in made.columns if c not in out.columns]
        # a family that makes a name again would replace it; the earlier column is kept
        made = made.select(*fresh, *out.columns) if set(out.columns) <= set(made.columns) else made
        listed += [(c, family) for c in fresh]
        out = made.select(*out.columns, *fresh)
    table = df.sparkSession.createDataFrame(listed or [("", "")], "name string, type string").filter(F.col("name") != "")
    return out, table
