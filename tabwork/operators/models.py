"""Spark ML training, comparison, scoring and metrics."""

from __future__ import annotations

import time
from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml import classification as mc, regression as mr
from pyspark.ml.feature import Imputer, IndexToString, StandardScaler, StringIndexer, UnivariateFeatureSelector, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, functions as F

from tabwork.functions.columns import column_kind, safe_div
from tabwork.operators.groups import rank_table
from tabwork.operators.lookup import attach
from tabwork.operators.profile import cardinality, classification_report
from tabwork.operators.quality import model_risk
from tabwork.operators.rows import drop_null_target, hash_bucket, split_train_test
from tabwork.operators.scaling import bin_quantile
from tabwork.session import spread

SEED = 42
CLASSIFIERS = ("logistic", "tree", "naive_bayes", "forest", "gbt", "svm", "mlp")
REGRESSORS = ("linear", "ridge", "tree", "forest", "gbt")
THREADS = 4

# fixed values: most distinct values of a numeric class target, by preset
CLASS_LIMITS = {"deployment": 19, "governance": 20, "strict": 10}


def problem_type(df: DataFrame, y: str, preset: str = "governance") -> DataFrame:
    """(target, unique_count, problem_type): text or few values is classification."""
    text = column_kind(df, y) == "text"
    few = F.col("unique_count") <= CLASS_LIMITS[preset]
    return cardinality(df, [y]).select(
        F.col("column").alias("target"), "unique_count", F.when(F.lit(text) | few, "classification").otherwise("regression").alias("problem_type")
    )


# fixed values: settings of each model by preset; a caller's own settings go over them
PRESETS = {
    "standard": {
        "linear": {}, "ridge": {"regParam": 1.0, "elasticNetParam": 0.0}, "logistic": {"maxIter": 100}, "tree": {"maxDepth": 3}, "forest": {"numTrees": 50, "maxDepth": 10},
        "gbt": {"maxIter": 20}, "naive_bayes": {"modelType": "gaussian"}, "svm": {"maxIter": 100}, "mlp": {"maxIter": 100},
    },
    "deep": {"tree": {"maxDepth": 10}, "forest": {"numTrees": 100, "maxDepth": 12}, "gbt": {"maxIter": 50}, "logistic": {"maxIter": 500}, "mlp": {"maxIter": 300}},
}


def settings(name: str, preset: str = "standard", params: dict | None = None) -> dict:
    """The settings of a model: the standard ones, those of the preset over them, then the caller's."""
    return {**PRESETS["standard"][name], **PRESETS[preset].get(name, {}), **(params or {})}


def estimator(name: str, kind: str, width: int, classes: int, preset: str = "standard", params: dict | None = None):
    """The Spark ML stage of a model name; gradient boosting and SVM go one-vs-rest above two classes."""
    chosen = settings(name, preset, params)
    if kind == "regression":
        make = {"linear": mr.LinearRegression, "ridge": mr.LinearRegression, "tree": mr.DecisionTreeRegressor, "forest": mr.RandomForestRegressor, "gbt": mr.GBTRegressor}[name]
    else:
        make = {
            "logistic": mc.LogisticRegression, "tree": mc.DecisionTreeClassifier, "naive_bayes": mc.NaiveBayes, "forest": mc.RandomForestClassifier,
            "gbt": mc.GBTClassifier, "svm": mc.LinearSVC, "mlp": mc.MultilayerPerceptronClassifier,
        }[name]
    if name in ("tree", "forest", "gbt", "mlp"):
        chosen = {"seed": SEED, **chosen}
    if name == "mlp":
        chosen = {"layers": [width, 50, classes], **chosen}
    model = make(**chosen)
    return mc.OneVsRest(classifier=model) if name in ("gbt", "svm") and kind != "regression" and classes > 2 else model


def input_columns(df: DataFrame, xs: Sequence[str]) -> DataFrame:
    """Numbers as double, text nulls as 'Unknown'."""
    return df.withColumns(
        {
            c: F.col(c).cast("double") if column_kind(df, c) == "number" else F.coalesce(F.col(c).cast("string"), F.lit("Unknown"))
            for c in xs
        }
    )


def preparation(df: DataFrame, xs: Sequence[str]) -> list:
    """Stages from columns to a scaled vector: median, label codes, assembly, scaling. Fitted on training rows only."""
    number = [c for c in xs if column_kind(df, c) == "number"]
    text = [c for c in xs if c not in number]
    stages = []
    if number:
        stages.append(Imputer(inputCols=number, outputCols=[f"_i_{c}" for c in number], strategy="median"))
    if text:
        stages.append(StringIndexer(inputCols=text, outputCols=[f"_i_{c}" for c in text], handleInvalid="keep", stringOrderType="alphabetAsc"))
    stages.append(VectorAssembler(inputCols=[f"_i_{c}" for c in xs], outputCol="_raw"))
    stages.append(StandardScaler(inputCol="_raw", outputCol="features", withMean=True))
    return stages


def prepare_model_data(df: DataFrame, y: str, xs: Sequence[str]) -> DataFrame:
    """The table without null targets, with its scaled feature vector."""
    rows = input_columns(drop_null_target(df, y), xs)
    return Pipeline(stages=preparation(rows, xs)).fit(rows).transform(rows).select(*df.columns, "features")


def train(df: DataFrame, y: str, xs: Sequence[str], name: str, kind: str | None = None, preset: str = "standard", params: dict | None = None) -> PipelineModel:
    """Fit preparation and model as one pipeline; the answer column is `predicted_<y>`.

    Every stage of the fit reads the input rows, so they are held for its length, in even
    parts: a forest holds a bagged copy of each part.
    """
    kind = kind or problem_type(df, y).first()["problem_type"]
    rows = spread(input_columns(drop_null_target(df, y), xs).select(y, *[x for x in xs if x != y])).persist()
    try:
        return _fit(rows, y, xs, name, kind, preset, params)
    finally:
        rows.unpersist()


def _fit(rows: DataFrame, y: str, xs: Sequence[str], name: str, kind: str, preset: str, params: dict | None) -> PipelineModel:
    stages = preparation(rows, xs)
    if kind == "regression":
        rows = rows.withColumn("label", F.col(y).cast("double"))
        model = estimator(name, kind, len(xs), 0, preset, params)
        model.setPredictionCol(f"predicted_{y}")
        return Pipeline(stages=[*stages, model]).fit(rows)
    rows = rows.withColumn("_y", F.col(y).cast("string"))
    labels = StringIndexer(inputCol="_y", outputCol="label", stringOrderType="alphabetAsc").fit(rows)
    model = estimator(name, kind, len(xs), len(labels.labels), preset, params)
    back = IndexToString(inputCol="prediction", outputCol=f"predicted_{y}", labels=labels.labels)
    fitted = Pipeline(stages=[*stages, model, back])
    return fitted.fit(labels.transform(rows))


def check_inputs(df: DataFrame, xs: Sequence[str]) -> None:
    missing = [c for c in xs if c not in df.columns]
    if missing:
        raise ValueError(f"missing feature columns: {', '.join(missing)}")


def score(df: DataFrame, model: PipelineModel, y: str, xs: Sequence[str]) -> DataFrame:
    """Predictions on new rows by the fitted pipeline, with the probability where the model has one."""
    check_inputs(df, xs)
    out = model.transform(input_columns(df, xs))
    extra = [F.array_max(vector_to_array("probability")).alias("probability")] if "probability" in out.columns else []
    keys = [c for c in df.columns if c not in xs]
    return out.select(*keys, *[df_col for df_col in xs], f"predicted_{y}", *extra)


def prediction_table(df: DataFrame, y: str, xs: Sequence[str], name: str, keys: Sequence[str], test_size: float = 0.2) -> DataFrame:
    """All rows with split, prediction on test rows, and match or absolute error."""
    kind = problem_type(df, y).first()["problem_type"]
    parts = split_train_test(drop_null_target(df, y), keys, test_size, y if kind == "classification" else None)
    model = train(parts.filter("split = 'train'"), y, xs, name, kind)
    p = f"predicted_{y}"
    out = model.transform(input_columns(parts, xs)).withColumn(p, F.when(F.col("split") == "test", F.col(p)))
    if kind == "classification":
        verdict = (F.col(y).cast("string") == F.col(p)).cast("int").alias("prediction_match")
    else:
        verdict = F.abs(F.col(y) - F.col(p)).alias("prediction_error")
    return out.select(*keys, y, "split", p, verdict)


def attach_predictions(df: DataFrame, predictions: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Predictions by row key; rows without one keep null."""
    return df.join(predictions, list(keys), "left")


def classification_metrics(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    """Accuracy and support-weighted precision, recall and F1, from the class table."""
    report = classification_report(df, actual, predicted)
    weighted = lambda c: (F.sum(F.col(c) * F.col("support")) / F.sum("support")).alias(c)
    hits = F.sum(F.col("recall") * F.col("support")) / F.sum("support")
    return report.agg(hits.alias("accuracy"), weighted("precision"), weighted("recall"), weighted("f1"))


def regression_metrics(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    """MSE, RMSE, MAE, R2 and explained variance."""
    e = F.col(actual) - F.col(predicted)
    return df.agg(
        F.avg(e * e).alias("mse"),
        F.sqrt(F.avg(e * e)).alias("rmse"),
        F.avg(F.abs(e)).alias("mae"),
        (1 - safe_div(F.avg(e * e), F.var_pop(actual))).alias("r2"),
        (1 - safe_div(F.var_pop(e), F.var_pop(actual))).alias("explained_variance"),
    )


def roc_auc(df: DataFrame, actual: str, score_col: str) -> DataFrame:
    """Area under the ROC curve by the rank sum of the positives, ties at their mean rank.

    Scores are counted per class first, so the ranks come from distinct scores.
    """
    ranks = rank_table(df.withColumn(score_col, F.col(score_col).cast("double")), score_col)
    counts = df.groupBy(F.col(score_col).cast("double").alias(score_col)).agg(
        F.count_if(F.col(actual) == 1).alias("pos"), F.count_if(F.col(actual) == 0).alias("neg")
    )
    n = F.sum("pos") + F.sum("neg")
    # the rank share is relative to all rows
    rank_sum = F.sum(F.col("_share") * F.col("pos")) * n
    area = (rank_sum - F.sum("pos") * (F.sum("pos") + 1) / 2) / (F.sum("pos") * F.sum("neg"))
    return counts.join(ranks, score_col).agg(area.alias("roc_auc"))


def _metrics_long(df: DataFrame, y: str, kind: str) -> DataFrame:
    p = f"predicted_{y}"
    table = (
        classification_metrics(df.withColumn("_y", F.col(y).cast("string")), "_y", p)
        if kind == "classification"
        else regression_metrics(df, y, p)
    )
    return table.unpivot([], table.columns, "metric", "value")


def compare_models(df: DataFrame, y: str, xs: Sequence[str], names: Sequence[str], keys: Sequence[str], test_size: float = 0.2) -> DataFrame:
    """(model, metric, value) on held-out rows, training seconds included.

    The fits share one persisted table and overlap on up to four driver threads.
    """
    kind = problem_type(df, y).first()["problem_type"]
    parts = split_train_test(drop_null_target(df, y).select(*dict.fromkeys([*keys, y, *xs])), keys, test_size, y if kind == "classification" else None)
    parts = parts.persist()

    def one(name):
        start = time.monotonic()
        model = train(parts.filter("split = 'train'"), y, xs, name, kind)
        spent = time.monotonic() - start
        test = model.transform(input_columns(parts.filter("split = 'test'"), xs))
        rows = [(name, r["metric"], float(r["value"])) for r in _metrics_long(test, y, kind).collect()]
        return [*rows, (name, "training_seconds", spent)]

    try:
        with ThreadPoolExecutor(min(THREADS, len(names))) as pool:
            results = [row for rows in pool.map(one, names) for row in rows]
    finally:
        parts.unpersist()
    return df.sparkSession.createDataFrame(results, "model string, metric string, value double")


def best_model(results: DataFrame, metric: str) -> DataFrame:
    """The model with the highest value of the metric."""
    return results.filter(F.col("metric") == metric).agg(
        F.max_by("model", F.struct("value", "model")).alias("model"), F.max("value").alias("value")
    )


def cross_validate(df: DataFrame, y: str, xs: Sequence[str], name: str, keys: Sequence[str], folds: int = 5) -> DataFrame:
    """(fold, metric, value) by a fold from the row-key digest: accuracy or R2."""
    kind = problem_type(df, y).first()["problem_type"]
    main = "accuracy" if kind == "classification" else "r2"
    rows = drop_null_target(df, y).withColumn("_fold", hash_bucket(*keys, buckets=folds)).persist()
    try:
        scores = []
        for fold in range(folds):
            model = train(rows.filter(F.col("_fold") != fold).drop("_fold"), y, xs, name, kind)
            test = model.transform(input_columns(rows.filter(F.col("_fold") == fold), xs))
            value = _metrics_long(test, y, kind).filter(F.col("metric") == main).first()["value"]
            scores.append((fold, main, float(value)))
    finally:
        rows.unpersist()
    return df.sparkSession.createDataFrame(scores, "fold int, metric string, value double")


def fold_summary(scores: DataFrame) -> DataFrame:
    return scores.groupBy("metric").agg(
        F.avg("value").alias("mean"), F.stddev_pop("value").alias("sd"), F.min("value").alias("min"), F.max("value").alias("max")
    )


def feature_importance(df: DataFrame, model: PipelineModel, xs: Sequence[str]) -> DataFrame:
    """(feature, importance): tree importances, or absolute coefficients (mean over classes)."""
    fitted = next(s for s in model.stages if hasattr(s, "featureImportances") or hasattr(s, "coefficients") or hasattr(s, "coefficientMatrix"))
    if hasattr(fitted, "featureImportances"):
        values = fitted.featureImportances.toArray()
    elif getattr(fitted, "numClasses", 2) > 2:
        values = np.abs(fitted.coefficientMatrix.toArray()).mean(axis=0)
    else:
        values = np.abs(fitted.coefficients.toArray())
    rows = [(x, float(v)) for x, v in zip(xs, values)]
    return df.sparkSession.createDataFrame(rows, "feature string, importance double")


def mutual_information(df: DataFrame, y: str, xs: Sequence[str], bins: int = 10) -> DataFrame:
    """(feature, mutual_information) in nats with a class target; numbers are cut into quantile bins first."""
    number = [c for c in xs if column_kind(df, c) == "number"]
    binned = bin_quantile(df, number, bins) if number else df
    cells = binned.select(
        F.col(y).cast("string").alias("_y"),
        *[F.col(f"{c}_bin_quantile_{bins}" if c in number else c).cast("string").alias(c) for c in xs],
    ).filter("_y is not null")
    joint = cells.unpivot(["_y"], list(xs), "feature", "v").filter("v is not null").groupBy("feature", "_y", "v").agg(F.count(F.lit(1)).alias("n"))
    left = joint.groupBy("feature", "v").agg(F.sum("n").alias("nv"), F.count(F.lit(1)).alias("rows"))
    right = joint.groupBy("feature", "_y").agg(F.sum("n").alias("ny"), F.count(F.lit(1)).alias("rows"))
    total = joint.groupBy("feature").agg(F.sum("n").alias("t"), F.count(F.lit(1)).alias("rows"))
    table = joint
    for part, keys in ((left, ["feature", "v"]), (right, ["feature", "_y"]), (total, ["feature"])):
        table = attach(table, part, keys, "rows").drop("rows")
    share = F.col("n") / F.col("t")
    part = share * F.log(F.col("n") * F.col("t") / (F.col("nv") * F.col("ny")))
    return table.groupBy("feature").agg(F.sum(part).alias("mutual_information"))


def select_k_best(df: DataFrame, y: str, xs: Sequence[str], k: int = 20) -> DataFrame:
    """(feature) the k features of highest F test against the target."""
    kind = problem_type(df, y).first()["problem_type"]
    ready = prepare_model_data(df, y, xs)
    if kind == "classification":
        ready = StringIndexer(inputCol="_y", outputCol="label").fit(ready.withColumn("_y", F.col(y).cast("string"))).transform(ready.withColumn("_y", F.col(y).cast("string")))
    else:
        ready = ready.withColumn("label", F.col(y).cast("double"))
    selector = UnivariateFeatureSelector(featuresCol="features", labelCol="label", outputCol="_sel", selectionMode="numTopFeatures")
    selector.setFeatureType("continuous").setLabelType("categorical" if kind == "classification" else "continuous").setSelectionThreshold(min(k, len(xs)))
    chosen = selector.fit(ready).selectedFeatures
    return df.sparkSession.createDataFrame([(xs[i],) for i in sorted(chosen)], "feature string")


def governed_run(df: DataFrame, y: str, xs: Sequence[str], keys: Sequence[str]) -> DataFrame:
    """One row: metrics of a forest on held-out rows, table size, and the risk rating."""
    kind = problem_type(df, y).first()["problem_type"]
    scores = compare_models(df, y, xs, ["forest"], keys)
    wanted = "accuracy" if kind == "classification" else "r2"
    other = "r2" if wanted == "accuracy" else "accuracy"
    size = df.agg(F.count(F.lit(1)).alias("n")).scalar()
    row = scores.filter(F.col("metric") == wanted).select(
        F.lit(kind).alias("problem_type"),
        F.col("value").alias(wanted),
        F.lit(None).cast("double").alias(other),
        size.alias("data_size"),
        F.lit(len(xs)).cast("bigint").alias("num_features"),
    )
    return model_risk(row)


KNN_BLOCK = 4096
KNN_WIDE = 8


def _knn_blocks(rows: int) -> int:
    """Blocks of KNN_BLOCK rows, of up to KNN_WIDE times as many once there are KNN_WIDE of them."""
    return max(1, -(-rows // min(KNN_BLOCK * KNN_WIDE, max(KNN_BLOCK, -(-rows // KNN_WIDE)))))


def knn(train_rows: DataFrame, query_rows: DataFrame, key: str, features: str, y: str, k: int = 5, regression: bool = False) -> DataFrame:
    """(key, predicted) by the k nearest training rows: majority vote, smallest class on ties, or mean.

    Exact: the training rows are cut into blocks of bounded size, every query row
    meets every block in some task by matrix products, and the k nearest of
    each block are merged per query row. A row is sent once for each block of the
    other table, so large tables have wide blocks. No task holds more than one block of
    each side; the work grows with the product of the two tables.
    """
    vec = F.col(features)  # sent as it is; distances are of doubles
    blocks, q_blocks = _knn_blocks(train_rows.count()), _knn_blocks(query_rows.count())
    known = train_rows.select(
        F.col(key).alias("tid"), vec.alias("v"), F.col(y).cast("double").alias("t"), F.pmod(F.xxhash64(key), F.lit(blocks)).alias("tb")
    ).withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(q_blocks - 1))))
    asked = query_rows.select(F.col(key).alias("id"), vec.alias("q"), F.pmod(F.xxhash64(F.col(key), F.lit(7)), F.lit(q_blocks)).alias("qb"))
    asked = asked.withColumn("tb", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    kind = query_rows.schema[key].dataType.simpleString()

    def nearest(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if left.empty or right.empty:
            return pd.DataFrame({"id": [], "d": [], "tid": [], "t": []})
        a, b = (np.stack(v.to_numpy()).astype(np.float64) for v in (right["q"], left["v"]))
        squares, top = (b * b).sum(1)[None, :], min(k, b.shape[0])
        step = max(1, KNN_BLOCK * KNN_BLOCK // b.shape[0])  # query rows whose distances are held at once
        return pd.concat([near(right.iloc[i : i + step], left, a[i : i + step], b, squares, top) for i in range(0, len(a), step)])

    def near(right, left, a, b, squares, top) -> pd.DataFrame:
        d = (a * a).sum(1)[:, None] + squares - 2 * a @ b.T
        at = np.argpartition(d, top - 1, axis=1)[:, :top]
        return pd.DataFrame(
            {
                "id": np.repeat(right["id"].to_numpy(), top),
                "d": np.take_along_axis(d, at, 1).ravel(),
                "tid": left["tid"].to_numpy()[at].ravel(),
                "t": left["t"].to_numpy()[at].ravel(),
            }
        )

    found = known.groupBy("tb", "qb").cogroup(asked.groupBy("tb", "qb")).applyInPandas(
        nearest, f"id {kind}, d double, tid {kind}, t double"
    )
    # at most k rows of each block per query row
    merged = found.groupBy("id").agg(F.slice(F.array_sort(F.collect_list(F.struct("d", "tid", "t"))), 1, k).alias("near"))
    votes = merged.select("id", F.explode("near").alias("n")).select("id", F.col("n.t").alias("t"))
    if regression:
        return votes.groupBy("id").agg(F.avg("t").alias("predicted")).withColumnRenamed("id", key)
    counts = votes.groupBy("id", "t").agg(F.count(F.lit(1)).alias("c"))
    return counts.groupBy("id").agg(F.min_by("t", F.struct(-F.col("c"), "t")).alias("predicted")).withColumnRenamed("id", key)


