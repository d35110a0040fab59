"""Row-order features: rolling, lag, cumulative, change, gaps, smoothing."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from tabwork.functions.calendar import elapsed_seconds
from tabwork.functions.columns import safe_div
from tabwork.operators.ordered import number_rows, running, trailing

WIDTHS = (3, 5, 7)
LAGS = (1, 2, 3, 5)


def _rolling(c: str, frame, widths: Sequence[int]) -> dict[str, Column]:
    out = {}
    for k in widths:
        w, x = frame(k), F.col(c).cast("double")
        out |= {
            f"{c}_rolling_mean_{k}": F.avg(x).over(w),
            f"{c}_rolling_std_{k}": F.coalesce(F.stddev_samp(x).over(w), F.lit(0.0)),
            f"{c}_rolling_median_{k}": F.percentile(x, F.lit(0.5)).over(w),
            f"{c}_rolling_min_{k}": F.min(x).over(w),
            f"{c}_rolling_max_{k}": F.max(x).over(w),
        }
    return out


def _lags(c: str, order, lags: Sequence[int]) -> dict[str, Column]:
    return {f"{c}_lag_{k}": F.lag(c, k).over(order) for k in lags}


def _change(c: str, order) -> dict[str, Column]:
    before = F.lag(F.col(c).cast("double")).over(order)
    change = F.coalesce(safe_div(F.col(c) - before, before), F.lit(0.0))
    return {f"{c}_pct_change": change, f"{c}_pct_change_abs": F.abs(change)}


def rolling_features(
    df: DataFrame,
    cols: Sequence[str],
    order_by: Sequence[str],
    partition_by: Sequence[str] = (),
    widths: Sequence[int] = WIDTHS,
) -> DataFrame:
    """Mean, sd (0 for one value), median, min and max of the last rows."""

    def build(frame, _order):
        out = {}
        for c in cols:
            out |= _rolling(c, frame, widths)
        return out

    return trailing(df, build, max(widths) - 1, order_by, partition_by)


def ordered_features(
    df: DataFrame,
    cols: Sequence[str],
    order_by: Sequence[str],
    partition_by: Sequence[str] = (),
    widths: Sequence[int] = WIDTHS,
    lags: Sequence[int] = LAGS,
) -> DataFrame:
    """Rolling, lag and change features together: one numbering and one shuffle for all frames."""

    def build(frame, order):
        out = {}
        for c in cols:
            out |= _rolling(c, frame, widths) | _lags(c, order, lags) | _change(c, order)
        return out

    return trailing(df, build, max([*widths, *lags]), order_by, partition_by)


def lag_features(
    df: DataFrame,
    cols: Sequence[str],
    order_by: Sequence[str],
    partition_by: Sequence[str] = (),
    lags: Sequence[int] = LAGS,
) -> DataFrame:
    def build(_frame, order):
        out = {}
        for c in cols:
            out |= _lags(c, order, lags)
        return out

    return trailing(df, build, max(lags), order_by, partition_by)


def cumulative_features(
    df: DataFrame, cols: Sequence[str], order_by: Sequence[str], partition_by: Sequence[str] = ()
) -> DataFrame:
    """Running sum, max and min; null where the value is null."""
    wanted = {f"{c}_cum{how}": (c, how) for c in cols for how in ("sum", "max", "min")}
    out = running(df, wanted, order_by, partition_by)
    return out.withColumns({k: F.when(F.col(c).isNotNull(), F.col(k)) for k, (c, _) in wanted.items()})


def cumprod(df: DataFrame, col: str, order_by: Sequence[str], partition_by: Sequence[str] = ()) -> DataFrame:
    """Running product from running sums of logs, signs and zeros."""
    x = F.col(col).cast("double")
    parts = df.withColumns(
        {
            "_log": F.when(x != 0, F.log(F.abs(x))).otherwise(0.0),
            "_neg": F.coalesce((x < 0).cast("bigint"), F.lit(0)),
            "_zero": F.coalesce((x == 0).cast("bigint"), F.lit(0)),
        }
    )
    sums = {"_logs": ("_log", "sum"), "_negs": ("_neg", "sum"), "_zeros": ("_zero", "sum")}
    out = running(parts, sums, order_by, partition_by, cut_from=df)
    sign = F.when(F.pmod(F.col("_negs"), F.lit(2)) == 1, -1.0).otherwise(1.0)
    product = F.when(F.col("_zeros") > 0, 0.0).otherwise(sign * F.exp("_logs"))
    return out.select(*df.columns, F.when(x.isNotNull(), product).alias(f"{col}_cumprod"))


def pct_change(df: DataFrame, col: str, order_by: Sequence[str], partition_by: Sequence[str] = ()) -> DataFrame:
    """Change against the row before over that row, and its absolute value; 0 where there is none."""

    def build(_frame, order):
        return _change(col, order)

    return trailing(df, build, 1, order_by, partition_by)


def time_gaps(df: DataFrame, t: str, keys: Sequence[str] = ()) -> DataFrame:
    """Seconds since the time before, per key; null on the first row."""
    seconds = elapsed_seconds(df, t)

    def build(_frame, order):
        return {"gap_seconds": seconds - F.lag(seconds).over(order)}

    return trailing(df.filter(F.col(t).isNotNull()), build, 1, [t], keys)


def modal_gap(gaps: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Most frequent gap per key, ties to the smallest."""
    counts = gaps.filter(F.col("gap_seconds").isNotNull()).groupBy(*keys, "gap_seconds").agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy(*keys).agg(
        F.min_by("gap_seconds", F.struct(-F.col("n"), "gap_seconds")).alias("modal_gap"), F.sum("n").alias("gaps")
    )


def irregular_gaps(df: DataFrame, t: str) -> DataFrame:
    """Gaps over twice the modal gap."""
    gaps = time_gaps(df.select(t), t)
    counts = gaps.filter(F.col("gap_seconds").isNotNull()).groupBy("gap_seconds").agg(F.count(F.lit(1)).alias("n"))
    mode = modal_gap(gaps).select("modal_gap").scalar()
    far = (F.col("gap_seconds") > mode * 2) & (mode > 0)
    return counts.agg(
        F.max(mode).alias("modal_gap"),
        F.coalesce(F.sum(F.when(far, F.col("n"))), F.lit(0)).alias("irregular_gaps"),
        F.sum("n").alias("gaps"),
    )


def moving_average(df: DataFrame, y: str, order_by: Sequence[str], keys: Sequence[str] = (), width: int = 7) -> DataFrame:
    """Mean of the last rows of each key."""
    numbered = number_rows(df, order_by, keys, "_rn", "_all")
    last = numbered.filter(F.col("_rn") > F.col("_all") - width)
    return last.groupBy(*keys).agg(F.avg(y).alias("moving_average"))


def smoothing_weight(rn: Column, n: Column, alpha: float) -> Column:
    """Weight of row rn of n in the smoothed level: the first row starts the level."""
    return F.pow(F.lit(1 - alpha), n - rn) * F.when(rn == 1, 1.0).otherwise(alpha)


def exp_smooth(df: DataFrame, y: str, order_by: Sequence[str], keys: Sequence[str] = (), alpha: float = 0.3) -> DataFrame:
    """Last smoothed level per key, as a weighted sum: no row-by-row recursion."""
    numbered = number_rows(df, order_by, keys, "_rn", "_all")
    term = F.col(y) * smoothing_weight(F.col("_rn"), F.col("_all"), alpha)
    return numbered.groupBy(*keys).agg(F.sum(term).alias("level"), F.count(F.lit(1)).alias("n"))
