"""Numeric features that need a statistic of the column first."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from tabwork.functions import stats
from tabwork.functions.columns import one_row, safe_div
from tabwork.functions.numeric import EPS, num
from tabwork.operators.groups import group_mean
from tabwork.operators.lookup import quantile_struct


def _with_ends(df: DataFrame, cols: Sequence[str], source: DataFrame | None = None, **measures) -> DataFrame:
    """Statistics of the source (df by default) as a struct on each row; a source keeps joins made on df out of the statistics pass."""
    fields = {c: F.struct(*[fn(num(c)).alias(k) for k, fn in measures.items()]) for c in cols}
    return df.withColumn("_e", one_row(df if source is None else source, **fields))


def scale(df: DataFrame, cols: Sequence[str], how: str = "zscore", source: DataFrame | None = None) -> DataFrame:
    """z-score by the sample sd ('zscore'), by the population sd ('standard'), or 'minmax'; null when constant."""
    m = {"mean": F.avg, "sd": F.stddev_samp, "pop": F.stddev_pop, "lo": F.min, "hi": F.max}
    wide = _with_ends(df, cols, source, **m)
    out = {}
    for c in cols:
        e = lambda k, c=c: F.col(f"_e.{c}.{k}")
        if how == "zscore":
            out[f"{c}_zscore"] = F.when(e("sd") > 0, (num(c) - e("mean")) / e("sd"))
        elif how == "standard":
            # a constant column scales to 0
            out[f"{c}_scaled"] = F.coalesce(safe_div(num(c) - e("mean"), e("pop")), num(c) - e("mean"))
        else:
            out[f"{c}_minmax"] = F.when(e("hi") > e("lo"), (num(c) - e("lo")) / (e("hi") - e("lo")))
    return wide.withColumns(out).drop("_e")


def standard_scale(df: DataFrame, cols: Sequence[str], source: DataFrame | None = None) -> DataFrame:
    return scale(df, cols, "standard", source)


def log_sqrt(df: DataFrame, cols: Sequence[str], source: DataFrame | None = None) -> DataFrame:
    """log1p and square root of columns that are positive throughout, else null."""
    wide = _with_ends(df, cols, source, lo=F.min)
    out = {}
    for c in cols:
        ok = F.col(f"_e.{c}.lo") > 0
        out |= {f"{c}_log": F.when(ok, F.log1p(num(c))), f"{c}_sqrt": F.when(ok, F.sqrt(num(c)))}
    return wide.withColumns(out).drop("_e")


def log_if_skewed(df: DataFrame, cols: Sequence[str], source: DataFrame | None = None) -> DataFrame:
    """log1p in place of columns with skew over 1 and no value under 0; others unchanged."""
    wide = _with_ends(df, cols, source, skew=stats.sample_skew, lo=F.min)
    out = {
        c: F.when((F.col(f"_e.{c}.skew") > 1) & (F.col(f"_e.{c}.lo") >= 0), F.log1p(num(c))).otherwise(num(c))
        for c in cols
    }
    return wide.withColumns(out).drop("_e")


def polynomial_features(df: DataFrame, cols: Sequence[str], source: DataFrame | None = None) -> DataFrame:
    """Powers, roots, logs and bounded exponentials; roots and logs need the whole column in range."""
    wide = _with_ends(df, cols, source, lo=F.min)
    out = {}
    for c in cols:
        x, lo = num(c), F.col(f"_e.{c}.lo")
        held = F.when(x.isNotNull(), F.least(F.greatest(x, F.lit(-10.0)), F.lit(10.0)))
        out |= {
            f"{c}_poly_2": x * x,
            f"{c}_poly_3": x * x * x,
            f"{c}_sqrt": F.when(lo >= 0, F.sqrt(x)),
            f"{c}_cbrt": F.when(lo >= 0, F.cbrt(x)),
            f"{c}_log": F.when(lo > 0, F.log(x)),
            f"{c}_log1p": F.when(lo > 0, F.log1p(x)),
            f"{c}_log10": F.when(lo > 0, F.log10(x)),
            f"{c}_exp": F.exp(held),
            f"{c}_exp2": F.pow(F.lit(2.0), held),
        }
    return wide.withColumns(out).drop("_e")


def bin_equal(df: DataFrame, cols: Sequence[str], n: int, source: DataFrame | None = None) -> DataFrame:
    """Equal-width, right-closed bins 0..n-1; a constant column falls in the middle bin."""
    wide = _with_ends(df, cols, source, lo=F.min, hi=F.max)
    out = {}
    for c in cols:
        x, lo, hi = num(c), F.col(f"_e.{c}.lo"), F.col(f"_e.{c}.hi")
        step = (hi - lo) / n
        over = sum(((x > lo + step * i).cast("bigint") for i in range(1, n)), F.lit(0).cast("bigint"))
        out[f"{c}_bin_equal_{n}"] = F.when(lo == hi, F.when(x.isNotNull(), (n + 1) // 2 - 1)).otherwise(over).cast("bigint")
    return wide.withColumns(out).drop("_e")


def in_edges(x: Column, edges: Column, closed_low: bool) -> Column:
    """Right-closed bin of x among rising edges; null outside, and at the lowest edge unless closed_low."""
    below = F.size(F.filter(edges, lambda e: e < x)).cast("bigint") - 1
    if closed_low:
        below = F.greatest(below, F.lit(0).cast("bigint"))
    inside = (x >= F.element_at(edges, 1)) & (x <= F.element_at(edges, -1))
    return F.when(inside & (below >= 0) & (F.size(edges) > 1), below)


def bin_quantile(
    df: DataFrame, cols: Sequence[str], n: int, name: str = "bin_quantile", source: DataFrame | None = None
) -> DataFrame:
    """Equal-frequency bins on interpolated quantile edges, equal edges merged."""
    return _bin_by_quantiles(df, cols, [i / n for i in range(n + 1)], f"{name}_{n}", True, source)


def bin_percentile(df: DataFrame, cols: Sequence[str], source: DataFrame | None = None) -> DataFrame:
    """Quartile bins with an open lowest edge: the minimum gets null."""
    return _bin_by_quantiles(df, cols, [0, 0.25, 0.5, 0.75, 1], "bin_percentile", False, source)


def _bin_by_quantiles(df, cols, shares, suffix, closed_low, source):
    names = {f"e{i}": p for i, p in enumerate(shares)}
    wide = df.withColumn("_q", quantile_struct(df if source is None else source, cols, names))
    wide = wide.withColumns(
        {f"_edges_{c}": F.array_distinct(F.array(*[F.col(f"_q.{c}.{k}") for k in names])) for c in cols}
    )
    binned = {f"{c}_{suffix}": in_edges(num(c), F.col(f"_edges_{c}"), closed_low) for c in cols}
    return wide.withColumns(binned).drop("_q", *[f"_edges_{c}" for c in cols])


def bin_std(df: DataFrame, cols: Sequence[str], source: DataFrame | None = None) -> DataFrame:
    """Bins at min, mean - sd, mean, mean + sd, max; null where the edges do not rise."""
    wide = _with_ends(df, cols, source, lo=F.min, m=F.avg, s=F.stddev_samp, hi=F.max)
    out = {}
    for c in cols:
        lo, m, s, hi = [F.col(f"_e.{c}.{k}") for k in ("lo", "m", "s", "hi")]
        rising = (lo <= m - s) & (m + s <= hi) & (s > 0)
        edges = F.array_distinct(F.array(lo, m - s, m, m + s, hi))
        out[f"{c}_bin_std"] = F.when(rising, in_edges(num(c), edges, False))
    return wide.withColumns(out).drop("_e")


def guided_features(df: DataFrame, specs: Sequence[dict]) -> DataFrame:
    """Features given as data: {name, columns: [a, b]}.

    Two numeric columns give their ratio, a numeric and a text column the ratio
    to the group mean; other combinations are left out.
    """
    from tabwork.functions.columns import column_kind

    out = df
    for spec in specs:
        a, b = spec["columns"][:2]
        kinds = (column_kind(df, a), column_kind(df, b))
        if kinds == ("number", "number"):
            out = out.withColumn(spec["name"], num(a) / (num(b) + EPS))
        elif kinds[0] == "number":
            out = group_mean(out, b, a, "_mean", df).withColumn(spec["name"], num(a) / (F.col("_mean") + EPS)).drop("_mean")
    return out
