"""The ordered core against a plain window, on keys that a shortened key would confuse."""

import datetime as dt

import pytest
from pyspark.sql import Window, functions as F

from tabwork.operators.encode import label_codes, label_encode
from tabwork.operators.ordered import number_rows, running, trailing, with_blocks
from tabwork.operators.windows import lag_features, time_gaps

NEW_YORK = "America/New_York"


@pytest.fixture
def new_york(spark):
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", NEW_YORK)
    yield spark
    spark.conf.set("spark.sql.session.timeZone", before)


def shuffled(spark, n):
    return spark.range(n).withColumn("id", F.pmod(F.col("id") * 7919, F.lit(n)))


def same_as_window(df, order):
    want = df.withColumn("want", F.row_number().over(Window.orderBy(*order)))
    return number_rows(want, order).filter(F.col("rn") != F.col("want")).count()


def frames(spark):
    n = 1000
    base = shuffled(spark, n)
    return {
        "shared prefix": base.withColumn("k", F.format_string("Customer#00999%06d", F.pmod(F.col("id") * 31, F.lit(n)))),
        "one second": base.withColumn("k", F.timestamp_micros(F.lit(1_700_000_000_000_000) + F.pmod(F.col("id") * 31, F.lit(n)))),
        "large integers": base.withColumn("k", F.lit(1 << 60) + F.pmod(F.col("id") * 31, F.lit(n))),
        "decimals": base.withColumn("k", (F.lit("100000000000000000000").cast("decimal(38,6)") + F.pmod(F.col("id") * 31, F.lit(n)) / 1_000_000).cast("decimal(38,6)")),
        "nulls": base.withColumn("k", F.when(F.col("id") % 3 > 0, F.pmod(F.col("id") * 31, F.lit(97)))),
        "one value": base.withColumn("k", F.lit("same")),
        "few rows": shuffled(spark, 5).withColumn("k", F.lit(1)),
        "no rows": shuffled(spark, 5).withColumn("k", F.lit(1)).filter("id < 0"),
        "nan": base.withColumn("k", F.when(F.col("id") % 5 == 0, F.lit(float("nan"))).otherwise(F.col("id") % 11)),
    }


@pytest.mark.parametrize("name", ["shared prefix", "one second", "large integers", "decimals", "nulls", "one value", "few rows", "no rows", "nan"])
def test_row_numbers(spark, name):
    assert same_as_window(frames(spark)[name], ["k", "id"]) == 0


def test_row_numbers_over_a_clock_change(new_york):
    start = int(dt.datetime(2023, 11, 5, 4, tzinfo=dt.timezone.utc).timestamp())
    df = shuffled(new_york, 7200).withColumn("k", F.timestamp_seconds(F.lit(start) + F.col("id") * 2)).drop("id")
    assert same_as_window(df, ["k"]) == 0
    gaps = time_gaps(df, "k").groupBy("gap_seconds").count().collect()
    assert {r["gap_seconds"]: r["count"] for r in gaps} == {None: 1, 2: 7199}


def test_lags_inside_one_second(spark):
    df = shuffled(spark, 500).withColumn("ts", F.timestamp_micros(F.lit(1_700_000_000_000_000) + F.col("id"))).withColumn("v", F.col("id").cast("double"))
    out = lag_features(df, ["v"], ["ts", "id"])
    assert out.filter((F.col("id") > 0) & (F.col("v_lag_1") != F.col("v") - 1)).count() == 0


def test_shared_prefix_makes_several_blocks(spark):
    df = frames(spark)["shared prefix"]
    assert with_blocks(df, ["k"]).select("_part").distinct().count() > 4
    codes = label_encode(df, "k").select("k", "k_label_encoded")
    want = df.select("k", (F.dense_rank().over(Window.orderBy("k")) - 1).alias("w"))
    assert codes.join(want, "k").filter("k_label_encoded <> w").count() == 0
    assert label_codes(df, "k").count() == 1000


def test_frequent_first_value_is_cut_by_the_second(spark):
    df = frames(spark)["one value"]
    sizes = [r["count"] for r in with_blocks(df, ["k", "id"]).groupBy("_part").count().collect()]
    assert len(sizes) > 4 and max(sizes) < 400


def test_running_and_keys(spark):
    df = shuffled(spark, 600).withColumn("g", F.col("id") % 3).withColumn("k", F.col("id") % 7).withColumn("v", F.col("id") * 2)
    out = running(df, {"s": ("v", "sum"), "m": ("v", "max")}, ["k", "id"], ["g"])
    w = Window.partitionBy("g").orderBy("k", "id").rowsBetween(Window.unboundedPreceding, 0)
    assert out.withColumn("w", F.sum("v").over(w)).withColumn("x", F.max("v").over(w)).filter("s <> w or m <> x").count() == 0


@pytest.mark.parametrize("chunk", [2, 5, 40, 1000])
def test_frames_longer_than_a_chunk(spark, chunk):
    df = shuffled(spark, 100).withColumn("v", F.col("id").cast("double"))
    out = trailing(df, lambda frame, order: {"s": F.sum("v").over(frame(12))}, 11, ["id"], chunk_rows=chunk)
    want = F.sum("v").over(Window.orderBy("id").rowsBetween(-11, 0))
    assert out.count() == 100
    assert out.withColumn("w", want).filter("s <> w").count() == 0


def test_ordered_operators_have_no_single_partition_exchange_of_rows(spark):
    """The only rows that meet in one partition are cut points and table totals, which are aggregated first."""
    df = shuffled(spark, 1000).withColumn("k", F.col("id") % 7).withColumn("v", F.col("id") * 2.0)
    plans = [number_rows(df, ["k", "id"]), running(df, {"s": ("v", "sum")}, ["k", "id"]), lag_features(df, ["v"], ["k", "id"]), label_encode(df, "v")]
    for plan in plans:
        lines = plan._jdf.queryExecution().executedPlan().toString().split("\n")
        for i, line in enumerate(lines):
            if "Exchange SinglePartition" in line:
                assert "functions=[partial_" in lines[i + 1] or "Window" in lines[i - 1] or "Aggregate" in lines[i + 1] or "Sort" in lines[i - 1], lines[max(0, i - 2) : i + 3]
