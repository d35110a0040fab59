"""The block, chunk and hot-key paths, against plain windows, and the shape of the plans."""

import random

import pytest
from pyspark.sql import Window, functions as F

from tabwork.operators import cluster, encode, graph, groups, lookup, match, models, ordered, profile, rows


@pytest.fixture(scope="module")
def skewed(spark):
    """3000 rows; a third belong to one key, a third share one order value."""
    rng = random.Random(7)
    data = [
        (i, "hot" if i % 3 == 0 else f"k{rng.randrange(40)}", 500 if rng.random() < 0.33 else rng.randrange(1000), rng.random())
        for i in range(3000)
    ]
    return spark.createDataFrame(data, "id bigint, k string, o bigint, v double").cache()


@pytest.mark.parametrize("keys", [[], ["k"]])
def test_numbering_equals_window(skewed, keys):
    got = ordered.number_rows(skewed, ["o", "id"], keys, "rn", "n")
    w = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(1))
    want = skewed.select("id", F.row_number().over(w.orderBy("o", "id")).alias("rn"), F.count("*").over(w).alias("n"))
    pick = lambda d: sorted((r["id"], r["rn"], r["n"]) for r in d.collect())
    assert pick(got) == pick(want)


def test_hot_order_value_is_cut(skewed):
    parts = ordered.with_blocks(skewed, ["o", "id"]).groupBy("_part").count()
    assert parts.agg(F.max("count")).first()[0] < 1000


@pytest.mark.parametrize("keys", [[], ["k"]])
def test_chunks_see_rows_before_them(skewed, keys):
    def build(frame, order):
        return {"s": F.sum("v").over(frame(4)), "l": F.lag("id", 3).over(order)}

    got = ordered.trailing(skewed, build, 3, ["o", "id"], keys, chunk_rows=10)
    w = (Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(1))).orderBy("o", "id")
    want = skewed.select("id", F.sum("v").over(w.rowsBetween(-3, 0)).alias("s"), F.lag("id", 3).over(w).alias("l"))
    pick = lambda d: sorted((r["id"], round(r["s"], 9), r["l"]) for r in d.select("id", "s", "l").collect())
    assert pick(got) == pick(want)


def test_attach_keeps_rows_with_hot_and_null_keys(skewed):
    holed = skewed.withColumn("k", F.when(F.col("id") % 5 != 0, F.col("k")))
    stats = holed.groupBy("k").agg(F.sum("v").alias("s"), F.count("*").alias("w"))
    got = lookup.attach(holed, stats, ["k"], "w")
    assert got.count() == 3000
    assert got.filter("s is null").count() == 0


def test_components_of_chain_and_hub(spark):
    chain = [(i, i + 1) for i in range(1, 60)]
    hub = [(1000, 1000 + i) for i in range(1, 200)]
    out = graph.connected_components(spark.createDataFrame(chain + hub + [(60, 60)], "id1 bigint, id2 bigint"))
    parts = {r["id"]: r["component"] for r in out.collect()}
    assert {parts[i] for i in range(1, 61)} == {1}
    assert {parts[1000 + i] for i in range(200)} == {1000}


def test_pairs_equal_brute_force(spark):
    rng = random.Random(3)
    vocab = [f"word{i}" for i in range(30)]
    texts = [" ".join(rng.choices(vocab, k=rng.randrange(2, 9))) for _ in range(120)]
    texts += texts[:20]
    df = spark.createDataFrame(list(enumerate(texts)), "id bigint, t string")
    weights = {}
    for r in match.tfidf(df, "id", F.col("t"), 1000).collect():
        weights.setdefault(r["id"], {})[r["term"]] = r["weight"]
    dot = lambda a, b: sum(w * weights[b].get(t, 0.0) for t, w in weights[a].items())
    got = match.similar_pairs(df, "id", F.col("t"), 0.6).collect()
    rep = {i: i for i in weights}
    rep.update({r["id2"]: r["id1"] for r in got if r["similarity"] == 1.0})
    listed = {(r["id1"], r["id2"]) for r in got}
    for a in range(140):
        for b in range(a + 1, 140):
            s = dot(a, b)
            if abs(s - 0.6) > 1e-9:
                same = rep[a] == rep[b] or tuple(sorted((rep[a], rep[b]))) in listed
                assert same == (s > 0.6), (a, b, s)


def test_density_clusters_with_a_dense_cell(spark):
    rng = random.Random(5)
    pts = [(rng.gauss(0, 0.05), rng.gauss(0, 0.05)) for _ in range(150)]
    pts += [(rng.gauss(0.9, 0.3), rng.gauss(0.2, 0.3)) for _ in range(80)] + [(rng.uniform(-4, 4), rng.uniform(-4, 4)) for _ in range(60)]
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(pts)], "id bigint, a double, b double")
    eps, least = 0.35, 5
    got = {r["id"]: r["cluster"] for r in cluster.cluster_dbscan(df, "id", ["a", "b"], eps, least).collect()}
    d2 = lambda p, q: (p[0] - q[0]) ** 2 + (p[1] - q[1]) ** 2
    near = [[j for j, q in enumerate(pts) if d2(p, q) <= eps * eps] for p in pts]
    core = {i for i, n in enumerate(near) if len(n) >= least}
    label, n = {}, 0
    for i in sorted(core):
        if i in label:
            continue
        todo, label[i] = [i], n
        while todo:
            for j in near[todo.pop()]:
                if j in core and j not in label:
                    label[j] = n
                    todo.append(j)
        n += 1
    for i in range(len(pts)):
        if i in core:
            assert got[i] == label[i]
        elif not any(j in core for j in near[i]):
            assert got[i] == -1
        else:
            assert got[i] == label[min((d2(pts[i], pts[j]), label[j], j) for j in near[i] if j in core)[2]]


def test_nearest_neighbours_over_several_blocks(spark, monkeypatch):
    monkeypatch.setattr(models, "KNN_BLOCK", 16)
    rng = random.Random(9)
    data = [(i, [rng.random(), rng.random()], float(i % 3)) for i in range(90)]
    df = spark.createDataFrame(data, "id bigint, v array<double>, y double")
    got = {r["id"]: r["predicted"] for r in models.knn(df, df, "id", "v", "y", 3, regression=True).collect()}
    for i, v, _ in data:
        best = sorted(data, key=lambda r: ((r[1][0] - v[0]) ** 2 + (r[1][1] - v[1]) ** 2, r[0]))[:3]
        assert abs(got[i] - sum(r[2] for r in best) / 3) < 1e-9


def test_split_shares(skewed):
    parts = {r["split"]: r["count"] for r in rows.split_train_test(skewed, ["id"], 0.2).groupBy("split").count().collect()}
    assert parts == {"test": 600, "train": 2400}


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_plans_have_no_product_and_no_python(skewed):
    plans = [
        profile.iqr_outliers(skewed, ["v"]),
        profile.cardinality(skewed),
        encode.label_encode(skewed, "k"),
        groups.percent_rank_avg(skewed, "v"),
        groups.group_deviation(skewed, "k", "v"),
        ordered.number_rows(skewed, ["o", "id"], ["k"]),
    ]
    for df in plans:
        text = plan_of(df)
        assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text
        assert "Python" not in text


def test_scan_reads_needed_columns_only(spark):
    lineitem = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet")
    text = plan_of(profile.missing_summary(lineitem, ["l_tax"]))
    assert "ReadSchema: struct<l_tax:double>" in text


def test_pairs_with_a_term_in_every_text_and_small_blocks(spark):
    rng = random.Random(11)
    vocab = [f"w{i}" for i in range(40)]
    texts = ["common " + " ".join(rng.choices(vocab, k=rng.randrange(1, 7))) for _ in range(150)] + ["common"] * 3
    df = spark.createDataFrame(list(enumerate(texts)), "id bigint, t string")
    v = match.collapse(df, "id", F.col("t"), None, (1, 1), ())
    weights = {}
    for r in v.terms.collect():
        weights.setdefault(r["rep"], {})[r["term"]] = r["weight"]
    dot = lambda a, b: sum(w * weights[b].get(t, 0.0) for t, w in weights[a].items())
    for threshold in (0.5, 0.8):
        got = {(r["id1"], r["id2"]) for r in match.pairs_above(v.terms, threshold, block=4).collect()}
        ids = sorted(weights)
        want = {(a, b) for i, a in enumerate(ids) for b in ids[i + 1:] if dot(a, b) > threshold + 1e-9}
        edge = {(a, b) for i, a in enumerate(ids) for b in ids[i + 1:] if abs(dot(a, b) - threshold) <= 1e-9}
        assert want <= got <= want | edge
