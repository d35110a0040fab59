"""Registered queries against their SQL on the smallest tables."""

import pytest

import check
import entries

entries.load_all()
PATH = "/root/testdata/sf0.001"
# queries whose result over the smallest tables is empty; any other empty result is a failure
EMPTY = {"match_records_pairs", "resolve_entities_canonical"}
NAMES = sorted(entries.ORACLE)


@pytest.fixture(scope="module")
def con():
    return check.connect(PATH)


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, con, name):
    said = check.compare(spark, con, PATH, name)
    assert said == ("FAIL: no rows" if name in EMPTY else ""), said


def test_every_sql_has_a_query():
    assert set(entries.ORACLE) <= set(entries.QUERIES)


def test_stream_features_and_windows(spark, tmp_path):
    from tabwork.streaming.rows import row_features, window_quality

    schema = spark.read.parquet(f"{PATH}/events.parquet").schema
    source = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(PATH)
    source = source.withColumn("ts", source["ts"].cast("timestamp"))
    query = row_features(source, ["event_type"], ["ts"]).writeStream.format("memory").queryName("rows_out").start()
    query.processAllAvailable()
    query.stop()
    assert spark.table("rows_out").count() == spark.read.parquet(f"{PATH}/events.parquet").count()
    counts = window_quality(source, "ts", ["value"], "1 day")
    query = counts.writeStream.format("memory").queryName("counts_out").outputMode("complete").start()
    query.processAllAvailable()
    query.stop()
    assert spark.sql("select sum(row_count) from counts_out").first()[0] == spark.table("rows_out").count()
