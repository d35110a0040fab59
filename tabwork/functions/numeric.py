"""Numeric feature expressions: names to columns, no data read."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

from pyspark.sql import Column, functions as F

from tabwork.functions.columns import safe_div

EPS = 1e-8


def num(c: str) -> Column:
    return F.col(c).cast("double")


def flag(c: Column) -> Column:
    return F.coalesce(c.cast("bigint"), F.lit(0).cast("bigint"))


def pairs(cols: Sequence[str]):
    return combinations(cols, 2)


def interaction_features(cols: Sequence[str], eps: bool = False) -> dict[str, Column]:
    """Products, sums, differences and ratios of pairs; eps adds 1e-8 to the divisor instead of giving 0."""
    out = {}
    for a, b in pairs(cols):
        x, y = num(a), num(b)
        out |= {f"{a}_x_{b}": x * y, f"{a}_plus_{b}": x + y, f"{a}_minus_{b}": x - y, f"{b}_minus_{a}": y - x}
        for top, bottom in ((a, b), (b, a)):
            ratio = num(top) / (num(bottom) + EPS) if eps else F.coalesce(safe_div(num(top), num(bottom)), F.lit(0.0))
            out[f"{top}_div_{bottom}"] = ratio
    return out


def interaction_pow(cols: Sequence[str]) -> dict[str, Column]:
    return {f"{a}_pow_{b}": F.pow(F.abs(num(a)), F.abs(num(b)) % 3) for a, b in pairs(cols)}


def interaction_dist(cols: Sequence[str]) -> dict[str, Column]:
    out = {}
    for a, b in pairs(cols):
        x, y = F.abs(num(a)), F.abs(num(b))
        out[f"{a}_{b}_euclidean"] = F.sqrt(x * x + y * y)
        out[f"{a}_{b}_manhattan"] = x + y
        out[f"{a}_{b}_chebyshev"] = null_if_any(F.greatest(x, y), a, b)
    return out


def null_if_any(c: Column, *cols: str) -> Column:
    """c, but null when one of the inputs is; greatest and least skip nulls."""
    missing = F.lit(False)
    for name in cols:
        missing = missing | F.col(name).isNull()
    return F.when(~missing, c)


def interaction_stats(cols: Sequence[str]) -> dict[str, Column]:
    out = {}
    for a, b in pairs(cols):
        x, y = num(a), num(b)
        out[f"{a}_{b}_mean"] = (x + y) / 2
        out[f"{a}_{b}_max"] = null_if_any(F.greatest(x, y), a, b)
        out[f"{a}_{b}_min"] = null_if_any(F.least(x, y), a, b)
        out[f"{a}_{b}_range"] = F.abs(x - y)
    return out


def interaction_cmp(cols: Sequence[str]) -> dict[str, Column]:
    out = {}
    for a, b in pairs(cols):
        out[f"{a}_gt_{b}"] = flag(num(a) > num(b))
        out[f"{a}_eq_{b}"] = flag(num(a) == num(b))
    return out


def interaction_ratio(cols: Sequence[str]) -> dict[str, Column]:
    """Share of each pair sum; named by pair, so several pairs of a column can stand side by side."""
    out = {}
    for a, b in pairs(cols):
        total = num(a) + num(b) + EPS
        out[f"{a}_share_{a}_{b}"] = num(a) / total
        out[f"{b}_share_{a}_{b}"] = num(b) / total
    return out


def self_powers(cols: Sequence[str]) -> dict[str, Column]:
    out = {}
    for c in cols:
        x = num(c)
        out |= {f"{c}_squared": x * x, f"{c}_cubed": x * x * x, f"{c}_sqrt": F.sqrt(F.abs(x))}
    return out


def row_stats(cols: Sequence[str]) -> dict[str, Column]:
    """Statistics over the non-null values of several columns of a row."""
    values = F.filter(F.array(*[num(c) for c in cols]), lambda v: v.isNotNull())
    n = F.size(values).cast("double")
    total = F.aggregate(values, F.lit(0.0), lambda s, v: s + v)
    mean = F.when(n > 0, total / n)

    def central(power: int) -> Column:
        def term(v):
            d = v - mean
            out = d
            for _ in range(power - 1):
                out = out * d
            return out

        return F.aggregate(values, F.lit(0.0), lambda s, v: s + term(v))

    m2, m3, m4 = central(2), central(3), central(4)
    ordered = F.array_sort(values)
    half = (F.size(values) / F.lit(2)).cast("int")
    odd = F.size(values) % 2 == 1
    median = F.when(
        n > 0,
        F.when(odd, F.get(ordered, half)).otherwise((F.get(ordered, half - 1) + F.get(ordered, half)) / 2),
    )
    sd = F.coalesce(F.when(n > 1, F.sqrt(m2 / (n - 1))), F.lit(0.0))
    var = m2 / n
    skew = F.when((n > 2) & (m2 > 0), F.sqrt(n * (n - 1)) / (n - 2) * (m3 / n) / F.pow(var, F.lit(1.5)))
    g2 = (m4 / n) / (var * var) - 3
    kurt = F.when((n > 3) & (m2 > 0), (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * g2 + 6))
    return {
        "row_mean": mean,
        "row_std": sd,
        "row_min": F.array_min(values),
        "row_max": F.array_max(values),
        "row_range": F.array_max(values) - F.array_min(values),
        "row_median": median,
        "row_sum": total,
        "row_skew": F.coalesce(skew, F.lit(0.0)),
        "row_kurtosis": F.coalesce(kurt, F.lit(0.0)),
    }


def row_counts(cols: Sequence[str]) -> dict[str, Column]:
    """Non-zero (nulls included), positive and negative cells of a row."""
    cell = lambda test: sum((test(num(c)) for c in cols), F.lit(0).cast("bigint"))
    return {
        "row_nonzero_count": cell(lambda x: F.coalesce((x != 0).cast("bigint"), F.lit(1).cast("bigint"))),
        "row_positive_count": cell(lambda x: flag(x > 0)),
        "row_negative_count": cell(lambda x: flag(x < 0)),
    }


def model_features(cols: Sequence[str], crossed: Sequence[str] | None = None) -> dict[str, Column]:
    """Model input set: products, ratios, squares and roots of the crossed columns (default all), sum, mean and sd of all."""
    top = list(cols if crossed is None else crossed)
    out = {}
    for a, b in pairs(top):
        out[f"{a}_x_{b}"] = num(a) * num(b)
        out[f"{a}_div_{b}"] = num(a) / (num(b) + EPS)
    for c in top:
        out[f"{c}_squared"] = num(c) * num(c)
        out[f"{c}_sqrt"] = F.sqrt(F.abs(num(c)))
    stats = row_stats(cols)
    return out | {"numeric_sum": stats["row_sum"], "numeric_mean": stats["row_mean"], "numeric_std": stats["row_std"]}
