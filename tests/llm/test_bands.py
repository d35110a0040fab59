"""Limits of the quality rules act: low-quality documents go, clean ones stay."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabwork.llm import compression

DATA = "/root/testdata/sf0.1"


@pytest.fixture(scope="module")
def tables(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet"), spark.read.parquet(f"{DATA}/labels.parquet")


def test_limits_are_those_of_the_fit(tables):
    assert compression.fit(*tables) == (compression.BANDS, compression.CHUNK_BAND)


def test_low_quality_goes_and_clean_stays(tables):
    docs, labels = tables
    good = docs.join(labels.filter("quality = 1"), "doc_id").select("doc_id")
    fitted = good.orderBy(F.xxhash64("doc_id"), "doc_id").limit(compression.FIT_ROWS).withColumn("fitted", F.lit(True))
    out = compression.rated(docs.select("doc_id", "text")).filter("not base_failed").join(labels, "doc_id").join(fitted, "doc_id", "left")
    n = {(r["quality"], r["kept"]): r["n"] for r in out.filter("fitted is null").groupBy("quality", "kept").agg(F.count("*").alias("n")).collect()}
    assert n[1, True] > 1000 and 100 * n.get((1, False), 0) <= n[1, True]
    assert n[0, False] > n[0, True]


def test_fitted_limits_keep_the_sample_and_fall_with_length():
    r = np.random.default_rng(3)
    sizes = r.integers(300, 50_000, 3000)
    ratios = 0.9 - 0.03 * np.log2(sizes) + r.normal(0, 0.01, 3000)
    bands = compression.fit_bands(sizes, ratios)
    low, high = np.array([compression.band(int(s), bands) for s in sizes]).T
    assert (low < ratios).all() and (ratios < high).all()
    assert all(a[1] >= b[1] and a[2] >= b[2] for a, b in zip(bands, bands[1:]))
    with pytest.raises(ValueError):
        compression.fit_bands(sizes[:2], ratios[:2])
