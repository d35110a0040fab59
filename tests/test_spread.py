"""Large tables of one row group are fitted in even parts; small ones stay as they are; dates are parsed by their marks only."""

from pyspark.sql import functions as F

from tabwork import session as s
from tabwork.operators import catalog, cluster, models


def test_rows_of_one_part_are_spread_for_fits(spark, monkeypatch):
    one = spark.range(1000).coalesce(1).select(F.col("id").cast("double").alias("x"), (F.col("id") % 7).cast("double").alias("y"))
    assert s.spread(one).rdd.getNumPartitions() == 1
    monkeypatch.setattr(s, "SPREAD_ROWS", 100)
    assert s.spread(one).rdd.getNumPartitions() == 10
    seen = []

    def note(df):
        out = s.spread(df)
        seen.append(out.rdd.getNumPartitions())
        return out

    monkeypatch.setattr(cluster, "spread", note)
    monkeypatch.setattr(models, "spread", note)
    cluster.auto_cluster(one, ["x"], ks=(2,))
    models.train(one, "y", ["x"], "linear", "regression")
    assert seen == [10, 10]


def test_dates_are_known_by_marks(spark):
    df = spark.createDataFrame([("2024-01-02", "01/31/2024", "F", "2024-01-02 03:04:05"), ("2024-02-03", "02/01/2024", "O", None)], "a string, b string, c string, d string")
    got = {r["column"]: r["all_dates"] for r in catalog.column_profile(df, "t").collect()}
    assert got == {"a": True, "b": True, "c": False, "d": True}
    assert [catalog.marks(f) for f in catalog.FORMATS[:4]] == ["%-%-%", "%/%/%", "%/%/%", "%-%-% %:%:%"]
