"""Clustering on Spark ML, density clustering on joins, and cluster reports."""

from __future__ import annotations

import math
from collections.abc import Sequence
from itertools import product

from pyspark.ml.clustering import BisectingKMeans, KMeans
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.feature import IDF, PCA, HashingTF, OneHotEncoder, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, functions as F

from tabwork.functions.columns import column_kind
from tabwork.functions.textfeat import combine_text
from tabwork.operators.encode import label_encode
from tabwork.operators.graph import connected_components
from tabwork.operators.lookup import attach
from tabwork.operators.ordered import number_rows
from tabwork.operators.profile import top_values
from tabwork.operators.rows import impute_mean, impute_median, impute_mode
from tabwork.operators.scaling import standard_scale
from tabwork.session import cut_lineage, spread

SEED = 42
TEXT_DIM = 1 << 10
# fixed values: cluster counts tried by the automatic choice and by the feature set
AUTO_K = (3, 4, 5, 6, 7, 8)
FEATURE_K = (3, 5, 8)


def _split_kinds(df: DataFrame, cols: Sequence[str]) -> tuple[list[str], list[str]]:
    return ([c for c in cols if column_kind(df, c) == "number"], [c for c in cols if column_kind(df, c) == "text"])


def cluster_prepare(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Add <col>_scaled: median or mode for nulls, label codes for text, population scaling."""
    number, text = _split_kinds(df, cols)
    work = df.withColumns({f"_n_{c}": F.col(c).cast("double") for c in number} | {f"_n_{c}": F.col(c) for c in text})
    if number:
        work = impute_median(work, [f"_n_{c}" for c in number])
    if text:
        source = work = impute_mode(work, [f"_n_{c}" for c in text])
        for c in text:
            work = label_encode(work, f"_n_{c}", name="_code", source=source).drop(f"_n_{c}").withColumnRenamed("_code", f"_n_{c}")
    scaled = standard_scale(work, [f"_n_{c}" for c in cols])
    return scaled.withColumnsRenamed({f"_n_{c}_scaled": f"{c}_scaled" for c in cols}).drop(*[f"_n_{c}" for c in cols])


def cluster_prepare_mixed(df: DataFrame, cols: Sequence[str], out: str = "features") -> DataFrame:
    """Vector of scaled numbers (mean for nulls) and one-hot text; null text is a level of its own."""
    number, text = _split_kinds(df, cols)
    work = df.withColumns({f"_n_{c}": F.col(c) for c in number})
    if number:
        work = standard_scale(impute_mean(work, [f"_n_{c}" for c in number]), [f"_n_{c}" for c in number])
    inputs = [f"_n_{c}_scaled" for c in number]
    if text:
        work = work.withColumns({f"_t_{c}": F.coalesce(F.col(c), F.lit("missing")) for c in text})
        names = [f"_t_{c}" for c in text]
        indexer = StringIndexer(inputCols=names, outputCols=[f"{c}_i" for c in names], handleInvalid="keep", stringOrderType="alphabetAsc")
        work = indexer.fit(work).transform(work)
        hot = OneHotEncoder(inputCols=[f"{c}_i" for c in names], outputCols=[f"{c}_h" for c in names], handleInvalid="keep", dropLast=False)
        work = hot.fit(work).transform(work)
        inputs += [f"{c}_h" for c in names]
    return VectorAssembler(inputCols=inputs, outputCol=out).transform(work).select(*df.columns, out)


def features(
    df: DataFrame, cols: Sequence[str], out: str = "features", shift: float = 0.0, source: DataFrame | None = None, text_dim: int = TEXT_DIM
) -> DataFrame:
    """Vector of scaled numbers and hashed TF-IDF of the joined text columns.

    The top-down splits start from a share of the mean, so they need a mean away
    from zero: shift moves the numbers, which changes no distance.
    """
    number, text = _split_kinds(df, cols)
    work, inputs = df, []
    if number:
        names = [f"_n_{c}" for c in number]
        doubled = lambda t: t.withColumns({f"_n_{c}": F.col(c).cast("double") for c in number})
        basis = doubled(df if source is None else source)
        filled = impute_median(basis, names)
        work = standard_scale(impute_median(doubled(work), names, basis), names, filled)
        inputs += [f"{n}_scaled" for n in names]
        work = work.withColumns({n: F.col(n) + shift for n in inputs})
    if text:
        words = F.filter(F.split(F.lower(combine_text(text)), r"[^\p{L}\p{N}_]+"), lambda w: F.length(w) > 1)
        work = HashingTF(inputCol="_w", outputCol="_tf", numFeatures=text_dim).transform(work.withColumn("_w", words))
        work = IDF(inputCol="_tf", outputCol="_tfidf").fit(work).transform(work)
        inputs.append("_tfidf")
    return VectorAssembler(inputCols=inputs, outputCol=out).transform(work).select(*df.columns, out)


def _labelled(model, df: DataFrame, keep: Sequence[str]) -> DataFrame:
    return model.transform(df).select(*keep, F.col("prediction").alias("cluster"))


def _fit_label(algorithm, fit_on: DataFrame, ready: DataFrame, keep: Sequence[str]) -> DataFrame:
    """Fit on the persisted vectors: every iteration reads them."""
    held = fit_on.select("features").persist()
    try:
        model = algorithm.fit(held)
    finally:
        held.unpersist()
    return _labelled(model, ready, keep)


def cluster_kmeans(
    df: DataFrame, cols: Sequence[str], k: int, seed: int = SEED, source: DataFrame | None = None
) -> DataFrame:
    """The table with a k-means label, fitted on the source (df by default)."""
    ready = features(df, cols, source=source)
    fit_on = ready if source is None else features(source, cols)
    return _fit_label(KMeans(k=k, seed=seed, maxIter=20), fit_on, ready, df.columns)


def cluster_bisecting(df: DataFrame, cols: Sequence[str], k: int, seed: int = SEED) -> DataFrame:
    """The table with a label of top-down hierarchical clustering."""
    ready = features(df, cols, shift=1.0)
    return _fit_label(BisectingKMeans(k=k, seed=seed), ready, ready, df.columns)


def append_cluster(df: DataFrame, model, features_col: str = "features") -> DataFrame:
    """Labels of a fitted model on a table with vectors."""
    return _labelled(model, df, [c for c in df.columns if c != features_col])


def cluster_features(df: DataFrame, cols: Sequence[str], ks: Sequence[int] = FEATURE_K, seed: int = SEED) -> DataFrame:
    """k-means label, nearest and mean distance to the centres, for several k; nulls count as 0."""
    zeroed = df.withColumns({f"_n_{c}": F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in cols})
    names = [f"_n_{c}_scaled" for c in cols]
    ready = VectorAssembler(inputCols=names, outputCol="_v").transform(standard_scale(zeroed, [f"_n_{c}" for c in cols]))
    out, held = ready, ready.select("_v").persist()
    for k in ks:
        model = KMeans(k=k, seed=seed, maxIter=20, featuresCol="_v", predictionCol=f"kmeans_cluster_{k}").fit(held)
        distances = []
        for centre in model.clusterCenters():
            squares = [(F.col(n) - float(x)) * (F.col(n) - float(x)) for n, x in zip(names, centre)]
            distances.append(F.sqrt(sum(squares, F.lit(0.0))))
        out = model.transform(out).withColumns(
            {
                f"kmeans_distance_min_{k}": F.array_min(F.array(*distances)),
                f"kmeans_distance_mean_{k}": sum(distances, F.lit(0.0)) / len(distances),
            }
        )
    held.unpersist()
    added = [f"kmeans_{m}_{k}" for k in ks for m in ("cluster", "distance_min", "distance_mean")]
    return out.select(*df.columns, *added)


def silhouette(df: DataFrame, features_col: str = "features", label: str = "prediction") -> float:
    """Mean squared-Euclidean silhouette, in time linear in the rows."""
    return ClusteringEvaluator(featuresCol=features_col, predictionCol=label).evaluate(df)


def auto_cluster(df: DataFrame, cols: Sequence[str], ks: Sequence[int] = AUTO_K, seed: int = SEED) -> tuple[DataFrame, DataFrame]:
    """The table labelled by the best of several models, and the score table (algorithm, k, score)."""
    ready = features(df, cols, shift=1.0)
    held = spread(ready.select("features")).persist()  # every fit runs on all cores
    tried, best = [], (-2.0, None)
    try:
        for name, make in (("kmeans", KMeans), ("hierarchical", BisectingKMeans)):
            for k in ks:
                model = make(k=k, seed=seed).fit(held)
                labelled = model.transform(held)
                if labelled.select("prediction").distinct().limit(2).count() < 2:
                    continue
                score = silhouette(labelled)
                tried.append((name, k, float(score)))
                if score > best[0]:
                    best = (score, model)
    finally:
        held.unpersist()
    scores = df.sparkSession.createDataFrame(tried, "algorithm string, k int, score double")
    return _labelled(best[1], ready, df.columns), scores


def cluster_stats(df: DataFrame, cols: Sequence[str], label: str = "cluster", k: int = 3) -> DataFrame:
    """Long report (cluster, column, measure, value): size, share, moments of numbers, top values of text."""
    number, text = _split_kinds(df, cols)
    known = df.filter(F.col(label) != -1)
    total = df.agg(F.count(F.lit(1)).alias("n")).scalar()
    aggs = [F.count(F.lit(1)).cast("double").alias("size")]
    for c in number:
        aggs += [F.avg(c).alias(f"{c}|mean"), F.stddev_samp(c).alias(f"{c}|sd"),
                 F.min(c).cast("double").alias(f"{c}|min"), F.max(c).cast("double").alias(f"{c}|max")]
    wide = known.groupBy(label).agg(*aggs).withColumn("share", F.col("size") / total * 100)
    names = [c for c in wide.columns if c != label]
    cells = [
        F.struct(F.lit(n.split("|")[0] if "|" in n else "").alias("column"), F.lit(n.split("|")[-1]).alias("measure"), F.col(f"`{n}`").alias("value"))
        for n in names
    ]
    report = wide.select(label, F.inline(F.array(*cells)))
    if text:
        tops = top_values(known, text, k, [label]).select(
            label, "column", F.concat(F.lit("top:"), "value").alias("measure"), F.col("n").cast("double").alias("value")
        )
        report = report.unionByName(tops)
    return report


def cluster_centers(df: DataFrame, cols: Sequence[str], label: str = "cluster") -> DataFrame:
    return df.groupBy(label).agg(*[F.avg(c).alias(c) for c in cols])


def pca_2d(df: DataFrame, features_col: str = "features") -> DataFrame:
    """Two principal coordinates x and y; their signs are free."""
    model = PCA(k=2, inputCol=features_col, outputCol="_pca").fit(df)
    xy = vector_to_array("_pca")
    return model.transform(df).withColumns({"x": F.get(xy, 0), "y": F.get(xy, 1)}).drop("_pca")


def _cell(point: Column, side: float) -> Column:
    return F.transform(point, lambda v: F.floor(v / side).cast("bigint"))


def _near_cells(cell: Column, offsets: Sequence[tuple[int, ...]]) -> Column:
    dims = len(offsets[0])
    return F.array(*[F.array(*[F.get(cell, i) + o[i] for i in range(dims)]) for o in offsets])


def _distance2(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda p, q: (p - q) * (p - q)), F.lit(0.0), lambda s, v: s + v)


def cluster_dbscan(df: DataFrame, key: str, cols: Sequence[str], eps: float, min_pts: int) -> DataFrame:
    """(key, cluster): exact density clustering in a few dimensions, -1 for noise.

    Points of a grid cell of side eps / sqrt(d) are all within eps of each
    other, so a cell of min_pts points needs no distances inside it. Other cells
    hold fewer than min_pts points, which bounds every probe list. Two cells of
    core points are linked by narrowing boxes (see _linked_cells), not by their
    point pairs. A border point joins its nearest core point.
    """
    dims = len(cols)
    if dims > 4:
        raise ValueError("reduce to four dimensions or fewer first, for example with pca_2d")
    side = eps / math.sqrt(dims)
    reach = math.ceil(math.sqrt(dims))
    offsets = list(product(range(-reach, reach + 1), repeat=dims))
    rows = df.select(F.col(key).alias("id"), F.array(*[F.col(c).cast("double") for c in cols]).alias("x"))
    rows = rows.filter(F.forall("x", lambda v: v.isNotNull()))
    # equal points are one point with a weight
    points = rows.groupBy("x").agg(F.min("id").alias("pid"), F.count(F.lit(1)).alias("w")).withColumn("cell", _cell(F.col("x"), side))
    points = cut_lineage(points)
    cells = points.groupBy("cell").agg(F.sum("w").alias("n"))
    sized = points.join(cells, "cell")
    dense = sized.filter(F.col("n") >= min_pts).select("pid", "x", "w", "cell")
    sparse = sized.filter(F.col("n") < min_pts).select("pid", "x", "w", "cell")
    probes = sparse.select(F.col("pid").alias("qid"), F.col("x").alias("q"), F.explode(_near_cells(F.col("cell"), offsets)).alias("cell"))
    within = _distance2(F.col("x"), F.col("q")) <= eps * eps
    counted = probes.join(points, "cell").filter(within).groupBy("qid").agg(F.sum("w").alias("near"))
    lone = counted.filter(F.col("near") >= min_pts).select(F.col("qid").alias("pid"))
    core = cut_lineage(dense.unionByName(sparse.join(lone, "pid", "left_semi")))
    links = _linked_cells(core, side, eps, offsets)
    parts = connected_components(links.select(F.to_json("a").alias("id1"), F.to_json("b").alias("id2")))
    named = core.withColumn("cell_id", F.to_json("cell")).join(parts.withColumnRenamed("id", "cell_id"), "cell_id", "left")
    labelled = cut_lineage(named.select("pid", "x", "cell", F.coalesce("component", "cell_id").alias("part")))
    firsts = labelled.groupBy("part").agg(F.min("pid").alias("first"))
    order = number_rows(firsts, ["first"], name="_rn").select("part", (F.col("_rn") - 1).alias("cluster"))
    core_labels = labelled.join(order, "part").select("pid", "x", "cell", "cluster")
    border = (
        probes.join(lone.withColumnRenamed("pid", "qid"), "qid", "left_anti")
        .join(core_labels, "cell")
        .withColumn("d", _distance2(F.col("x"), F.col("q")))
        .filter(F.col("d") <= eps * eps)
        .groupBy("qid")
        .agg(F.min(F.struct("d", "cluster")).alias("m"))
        .select(F.col("qid").alias("pid"), F.col("m.cluster").alias("cluster"))
    )
    labels = core_labels.select("pid", "cluster").unionByName(border)
    by_point = points.select("pid", "x", "w").join(labels, "pid", "left").select("x", "w", F.coalesce("cluster", F.lit(-1)).alias("cluster"))
    return attach(rows, by_point, ["x"], "w").select(F.col("id").alias(key), "cluster")


MAX_DEPTH = 40


def _linked_cells(core: DataFrame, side: float, eps: float, offsets) -> DataFrame:
    """(a, b): neighbouring cells that hold core points within eps of each other.

    Each cell starts as one box with one of its points. A pair of boxes is
    linked when the two points are close enough, dropped when the boxes are too
    far apart, and otherwise cut in halves. Boxes of one point settle a pair at
    once, so only boxes near the distance eps are cut again.
    """
    dims = len(offsets[0])

    def boxes(level: int) -> DataFrame:
        unit = side / (2**level)
        sub, up = _cell(F.col("x"), unit), _cell(F.col("x"), unit * 2)
        cut = core.select("cell", "x", sub.alias("sub"), (up if level else F.array().cast("array<bigint>")).alias("up"))
        if level == 0:
            cut = cut.withColumn("sub", F.array().cast("array<bigint>"))
        if level == 1:
            cut = cut.withColumn("up", F.array().cast("array<bigint>"))
        ends = lambda f: F.array(*[f(F.get("x", i)) for i in range(dims)])
        return cut.groupBy("cell", "up", "sub").agg(F.min("x").alias("p"), ends(F.min).alias("lo"), ends(F.max).alias("hi"))

    def sided(table: DataFrame, tag: str) -> DataFrame:
        return table.select(F.col("cell").alias(tag), *[F.col(c).alias(f"{c}_{tag}") for c in ("up", "sub", "p", "lo", "hi")])

    first = boxes(0)
    half = [o for o in offsets if o > tuple([0] * dims)]
    a = sided(first, "a").withColumn("b", F.explode(_near_cells(F.col("a"), half)))
    pairs = a.join(sided(first, "b"), "b")
    linked = None
    for level in range(MAX_DEPTH):
        gap = F.zip_with(
            F.zip_with("lo_b", "hi_a", lambda p, q: p - q), F.zip_with("lo_a", "hi_b", lambda p, q: p - q),
            lambda p, q: F.greatest(p, q, F.lit(0.0)),
        )
        far = F.aggregate(gap, F.lit(0.0), lambda s, v: s + v * v) > eps * eps
        near = _distance2(F.col("p_a"), F.col("p_b")) <= eps * eps
        judged = cut_lineage(pairs.withColumn("near", near).filter(~far))
        found = judged.filter("near").select("a", "b").distinct()
        linked = found if linked is None else linked.unionByName(found)
        single = (F.col("lo_a") == F.col("hi_a")) & (F.col("lo_b") == F.col("hi_b"))
        open_pairs = judged.filter(~F.col("near") & ~single).join(found, ["a", "b"], "left_anti")
        open_pairs = cut_lineage(open_pairs.select("a", "sub_a", "b", "sub_b"))
        if open_pairs.isEmpty():
            return linked.distinct()
        nxt = boxes(level + 1)
        left = sided(nxt, "a").withColumnRenamed("up_a", "_ua")
        right = sided(nxt, "b").withColumnRenamed("up_b", "_ub")
        parents = open_pairs.withColumnsRenamed({"sub_a": "_ua", "sub_b": "_ub"})
        pairs = parents.join(left, ["a", "_ua"]).join(right, ["b", "_ub"]).drop("_ua", "_ub")
    raise RuntimeError("cells could not be told apart")
