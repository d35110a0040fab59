"""Small inputs with known answers."""

import math

import pytest
from pyspark.sql import functions as F

from tabwork.functions import numeric as nf, stats
from tabwork.operators import drift, encode, groups, lookup, profile, quality, rows, scaling, series, textops, windows

VALUES = [1.0, 2.0, 2.0, 10.0, 3.0]


@pytest.fixture(scope="module")
def x(spark):
    return spark.createDataFrame(list(enumerate(VALUES)), "i bigint, x double").cache()


def col(df, name, key="i"):
    return [r[name] for r in df.orderBy(key).collect()]


def near(got, want, tol=1e-5):
    assert len(got) == len(want)
    for g, w in zip(got, want):
        assert (g is None) == (w is None)
        assert w is None or math.isclose(g, w, abs_tol=tol), (got, want)


def test_profile_numeric(x):
    row = profile.profile_numeric_ext(x, ["x"]).first()
    near([row["sd"], row["median"], row["skew"], row["kurtosis"]], [3.646917, 2, 2.028699, 4.272147])
    assert row["outliers"] == 1


def test_iqr_bounds(x):
    row = profile.iqr_outliers(x, ["x"]).first()
    near([row["lower_bound"], row["upper_bound"]], [0.5, 4.5])


def test_rolling(x):
    out = windows.rolling_features(x, ["x"], ["i"])
    near(col(out, "x_rolling_mean_3"), [1, 1.5, 1.666667, 4.666667, 5])
    near(col(out, "x_rolling_std_3"), [0, 0.707107, 0.57735, 4.618802, 4.358899])
    near(col(out, "x_rolling_median_3"), [1, 1.5, 2, 2, 3])


def test_cumulative_and_change(x):
    near(col(windows.cumprod(x, "x", ["i"]), "x_cumprod"), [1, 2, 4, 40, 120])
    near(col(windows.pct_change(x, "x", ["i"]), "x_pct_change"), [0, 1, 0, 4, -0.7])


def test_cumprod_signs_and_zeros(spark):
    df = spark.createDataFrame([(0, -2.0), (1, 3.0), (2, -1.0), (3, 0.0), (4, 5.0)], "i bigint, x double")
    near(col(windows.cumprod(df, "x", ["i"]), "x_cumprod"), [-2, -6, 6, 0, 0])


def test_ranks_and_scales(x):
    near(col(groups.percent_rank_avg(x, "x"), "x_rank"), [0.2, 0.5, 0.5, 1, 0.8])
    near(col(scaling.scale(x, ["x"]), "x_zscore"), [-0.712931, -0.438727, -0.438727, 1.754907, -0.164523])


def test_bins(x):
    assert col(scaling.bin_equal(x, ["x"], 5), "x_bin_equal_5") == [0, 0, 0, 4, 1]
    assert col(scaling.bin_quantile(x, ["x"], 5), "x_bin_quantile_5") == [0, 1, 1, 4, 3]
    assert col(scaling.bin_std(x, ["x"]), "x_bin_std") == [None] * 5


def test_constant_column_bins(spark):
    df = spark.createDataFrame([(i, 4.0) for i in range(3)], "i bigint, x double")
    assert col(scaling.bin_equal(df, ["x"], 5), "x_bin_equal_5") == [2, 2, 2]
    assert col(scaling.scale(df, ["x"]), "x_zscore") == [None] * 3


def test_category_counts_with_null(spark):
    df = spark.createDataFrame([(0, "b"), (1, "a"), (2, "b"), (3, None), (4, "c")], "i bigint, c string")
    out = encode.frequency_features(df, "c", ["frequency", "rank", "freq_rank"])
    assert col(out, "c_frequency") == [2, 1, 2, 0, 1]
    near(col(out, "c_rank"), [1, 2.5, 1, 0, 2.5])
    near(col(out, "c_freq_rank"), [1, 2, 1, 0, 2])
    assert col(rows.impute_mode(df, ["c"]), "c") == ["b", "a", "b", "b", "c"]
    assert col(encode.label_encode(df, "c"), "c_label_encoded") == [1, 0, 1, 3, 2]
    hot = encode.one_hot(df, "c")
    assert col(hot, "c_onehot_nan") == [0, 0, 0, 1, 0]


def test_trend_and_smoothing(spark):
    df = spark.createDataFrame([(float(t), y) for t, y in enumerate([10.0, 12.0, 11.0, 15.0, 16.0])], "d double, y double")
    s = df.select(F.timestamp_add("DAY", F.col("d").cast("bigint"), F.lit("2024-02-27").cast("timestamp_ntz")).alias("t"), "y")
    fit = series.fit_series(s.withColumn("k", F.lit(0)), ["k"]).first()
    near([fit["slope"], fit["intercept"], fit["rmse"], fit["smoothing"]], [1.5, 9.8, 0.927362, 13.2028])
    ahead = series.forecast_linear(s, 2).orderBy("step").collect()
    near([r["y"] for r in ahead], [17.3, 18.8])
    assert [str(r["t"])[:10] for r in ahead] == ["2024-03-03", "2024-03-04"]


def test_chi_square(spark):
    cells = [("reference", "a", 30), ("reference", "b", 10), ("current", "a", 20), ("current", "b", 40)]
    df = spark.createDataFrame([(p, v) for p, v, n in cells for _ in range(n)], "period string, c string")
    row = drift.chi2_drift(df, ["c"]).first()
    near([row["statistic"]], [15.041667])
    near([row["p_value"]], [math.erfc(math.sqrt(row["statistic"] / 2))], 1e-9)


@pytest.mark.parametrize("stat,dof", [(3.0, 1), (7.5, 3), (4.2, 4), (40.0, 25), (0.5, 6)])
def test_chi_square_tail(spark, stat, dof):
    steps = 200000
    # integrate the density in u = sqrt(x), which has no pole at 0
    top, scale = math.sqrt(stat), 2 ** (dof / 2) * math.gamma(dof / 2)
    width = top / steps
    area = sum(2 * (u := (i + 0.5) * width) ** (dof - 1) * math.exp(-u * u / 2) for i in range(steps)) * width / scale
    got = spark.range(1).select(stats.chi2_sf(F.lit(stat), F.lit(dof)).alias("p")).first()["p"]
    assert math.isclose(got, 1 - area, abs_tol=1e-7)


def test_kolmogorov_smirnov(spark):
    df = spark.createDataFrame(
        [("reference", float(v)) for v in range(1, 5)] + [("current", float(v)) for v in range(3, 7)], "period string, x double"
    )
    near([drift.ks_2samp(df, ["x"]).first()["statistic"]], [0.5])


def test_empty_and_one_row(spark):
    empty = spark.createDataFrame([], "i bigint, x double")
    assert profile.profile_table(empty).first()["row_count"] == 0
    assert profile.iqr_outliers(empty, ["x"]).first()["outliers"] == 0
    assert quality.quality_score(empty).first()["quality_score"] == 100
    one = spark.createDataFrame([(0, 5.0)], "i bigint, x double")
    assert profile.profile_numeric(one, ["x"]).first()["median"] == 5
    assert windows.rolling_features(one, ["x"], ["i"]).first()["x_rolling_std_3"] == 0


def test_all_null_column(spark):
    df = spark.createDataFrame([(0, None), (1, None)], "i bigint, x double")
    assert profile.missing_summary(df, ["x"]).first()["missing"] == 2
    row = profile.profile_numeric(df, ["x"]).first()
    assert row["median"] is None and row["mean"] is None


def test_row_stats_match_moments(spark):
    df = spark.createDataFrame([(1.0, 2.0, 2.0, 10.0, 3.0), (None, 1.0, None, None, None)], "a double, b double, c double, d double, e double")
    got = df.select(*[c.alias(n) for n, c in nf.row_stats("abcde").items()]).collect()
    near([got[0]["row_skew"], got[0]["row_kurtosis"], got[0]["row_median"]], [2.028699, 4.272147, 2])
    assert got[1]["row_std"] == 0 and got[1]["row_mean"] == 1


def test_entities_have_own_offsets(spark):
    text = "Ann met Ann Lee on 03/04/2024 and paid $1,200.50 to Bob."
    found = textops.extract_entities(spark.createDataFrame([(text,)], "t string"), "t").first()["entities"]
    assert [(e["entity"], e["type"]) for e in found] == [
        ("Ann", "PERSON"), ("Ann Lee", "PERSON"), ("Bob", "PERSON"), ("03/04/2024", "DATE"), ("$1,200.50", "MONEY")
    ]
    assert all(text[e["start"] : e["end"]] == e["entity"] for e in found)


def test_map_texts_falls_back_by_rule(spark):
    def broken(_texts):
        raise RuntimeError("no client")

    df = spark.createDataFrame([("ab",), ("abc",)], "t string")
    out = textops.map_texts(df, "t", broken, "n", "bigint", fallback=len)
    assert sorted(r["n"] for r in out.collect()) == [2, 3]


def test_quantiles_per_key_with_ties(spark):
    import numpy as np

    data = [(k, float((i * 7919) % 37)) for k in ("a", "b") for i in range(500)] + [("c", 1.0)] * 400
    df = spark.createDataFrame(data, "k string, x double")
    got = {r["k"]: r for r in lookup.quantiles(df, ["x"], {"q": 0.37, "m": 0.5}, ["k"]).collect()}
    for k in "abc":
        values = [v for key, v in data if key == k]
        near([got[k]["q"], got[k]["m"]], list(np.percentile(values, [37, 50])))
