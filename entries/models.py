"""Models on labelled documents, parts and embeddings. Fits are checked by rows, metrics by SQL."""

from pyspark.sql import functions as F

from entries import query
from entries.profile import CELLS, predicted
from tabwork.functions import textfeat as tf
from tabwork.operators import models as m

XS = ["n_chars", "text_word_count", "text_digit_count", "lang"]


def labelled(t):
    """Documents with a 0/1 quality label and a few features."""
    cols = {**tf.text_counts("text"), **tf.char_class_counts("text")}
    d = t.documents.select("doc_id", "n_chars", "lang", *[cols[c].alias(c) for c in ("text_word_count", "text_digit_count")])
    return d.join(t.labels, "doc_id")


def priced(t):
    return t.part.select("p_partkey", "p_size", "p_brand", "p_type", "p_retailprice")


PX = ["p_size", "p_brand", "p_type", "p_partkey"]


def counted(df, *cols):
    return df.groupBy(*cols).agg(F.count(F.lit(1)).alias("n"))


def classifier_query(name):
    @query(f"train_{name}_classifier")
    def _(t):
        df = labelled(t)
        return counted(m.score(df, m.train(df, "quality", XS, name, "classification"), "quality", XS), "quality", "predicted_quality")


for _name in m.CLASSIFIERS:
    classifier_query(_name)


def regressor_query(name):
    @query(f"train_{name}_regressor")
    def _(t):
        df = priced(t)
        out = m.score(df.withColumn("y", F.col("p_retailprice")), m.train(df.withColumn("y", F.col("p_retailprice")), "y", PX, name, "regression"), "y", PX)
        return m.regression_metrics(out, "y", "predicted_y")


for _name in m.REGRESSORS:
    regressor_query(_name)


def mean_query(name):
    """The mean of the fitted values equals the mean of the target, on the rows of the fit."""

    @query(f"{name}_mean_prediction", "select avg(p_retailprice) as mean_prediction, count(*) as n from part", dbl="mean_prediction", digits=4)
    def _(t):
        df = priced(t).withColumn("y", F.col("p_retailprice"))
        out = m.score(df, m.train(df, "y", PX, name, "regression"), "y", PX)
        return out.agg(F.avg("predicted_y").alias("mean_prediction"), F.count(F.lit(1)).alias("n"))


for _name in ("linear", "ridge", "tree"):
    mean_query(_name)


@query(
    "model_settings",
    """select 'shallow' as setting, avg(p_retailprice) as mean_prediction, true as better from part union all
    select 'deep', avg(p_retailprice), true from part""",
    dbl="mean_prediction",
    digits=4,
)
def _(t):
    """Two settings of one model: both keep the mean of the target, and the deeper tree has the smaller error."""
    df = priced(t).withColumn("y", F.col("p_retailprice"))
    error = {}
    for setting, params in (("shallow", {"maxDepth": 1}), ("deep", {"maxDepth": 8})):
        out = m.score(df, m.train(df, "y", PX, "tree", "regression", params=params), "y", PX)
        error[setting] = out.agg(F.avg("predicted_y").alias("mean_prediction"), F.avg((F.col("y") - F.col("predicted_y")) ** 2).alias("mse"))
    both = error["shallow"].select(F.lit("shallow").alias("setting"), "mean_prediction", "mse").unionByName(error["deep"].select(F.lit("deep").alias("setting"), "mean_prediction", "mse"))
    worse = error["shallow"].select("mse").scalar()
    return both.select("setting", "mean_prediction", (F.col("mse") <= worse).alias("better"))


@query("fold_summary", "select 'accuracy' as metric, true as ordered, true as in_range, true as beats_half")
def _(t):
    s = m.fold_summary(m.cross_validate(labelled(t), "quality", XS, "tree", ["doc_id"], 3))
    ordered = (F.col("min") <= F.col("mean")) & (F.col("mean") <= F.col("max")) & (F.col("sd") <= F.col("max") - F.col("min"))
    return s.select("metric", ordered.alias("ordered"), F.col("mean").between(0, 1).alias("in_range"), (F.col("mean") > 0.5).alias("beats_half"))


@query("score_rows", "select lang, count(*) as n from documents group by lang")
def _(t):
    """Scoring takes rows without a target: every document gets an answer."""
    df = labelled(t)
    cols = {**tf.text_counts("text"), **tf.char_class_counts("text")}
    fresh = t.documents.select("doc_id", "n_chars", "lang", *[cols[c].alias(c) for c in ("text_word_count", "text_digit_count")])
    answers = m.score(fresh, m.train(df, "quality", XS, "tree", "classification"), "quality", XS)
    return counted(answers.filter(F.col("predicted_quality").isin("0", "1")), "lang")


@query("compare_models")
def _(t):
    return m.compare_models(labelled(t), "quality", XS, ["logistic", "tree", "naive_bayes"], ["doc_id"]).filter("metric <> 'training_seconds'")


@query("best_model")
def _(t):
    return m.best_model(m.compare_models(labelled(t), "quality", XS, ["logistic", "tree"], ["doc_id"]), "accuracy")


@query("prediction_table")
def _(t):
    return counted(m.prediction_table(labelled(t), "quality", XS, "tree", ["doc_id"]), "split", "prediction_match")


@query("cross_validate")
def _(t):
    return m.cross_validate(labelled(t), "quality", XS, "tree", ["doc_id"])


@query("feature_importance")
def _(t):
    df = labelled(t)
    return m.feature_importance(df, m.train(df, "quality", XS, "forest", "classification"), XS)


@query("select_k_best")
def _(t):
    return m.select_k_best(labelled(t), "quality", XS, 2)


@query("governed_run")
def _(t):
    return m.governed_run(labelled(t), "quality", XS, ["doc_id"])


@query("prepare_model_data", "select count(*) as n from documents join labels using (doc_id)")
def _(t):
    return m.prepare_model_data(labelled(t), "quality", XS).agg(F.count("features").alias("n"))


@query(
    "problem_type",
    """select 'p_size' as target, count(distinct p_size) as unique_count, case when count(distinct p_size) <= 20 then 'classification' else 'regression' end as problem_type from part
    union all select 'p_brand', count(distinct p_brand), 'classification' from part""",
)
def _(t):
    return m.problem_type(t.part, "p_size").unionByName(m.problem_type(t.part, "p_brand"))


@query(
    "classification_metrics",
    f"""with c as (select * from {CELLS}), s as (select y as label, count(*) as support, count(*) filter (p = y) as hits from c group by y),
    n as (select p as label, count(*) as named from c group by p), m as (select support, hits / support as r, coalesce(hits / nullif(named, 0), 0) as p from s left join n using (label)),
    f as (select *, case when p + r > 0 then 2 * p * r / (p + r) else 0 end as f from m)
    select sum(r * support) / sum(support) as accuracy, sum(p * support) / sum(support) as precision, sum(r * support) / sum(support) as recall, sum(f * support) / sum(support) as f1 from f""",
    dbl="accuracy precision recall f1",
)
def _(t):
    return m.classification_metrics(predicted(t), "y", "p")


@query(
    "regression_metrics",
    """with e as (select p_retailprice as y, 900 + p_size * 20.0 as p from part)
    select avg(pow(y - p, 2)) as mse, sqrt(avg(pow(y - p, 2))) as rmse, avg(abs(y - p)) as mae, 1 - avg(pow(y - p, 2)) / var_pop(y) as r2,
    1 - var_pop(y - p) / var_pop(y) as explained_variance from e""",
    dbl="mse rmse mae r2 explained_variance",
    digits=4,
)
def _(t):
    df = t.part.select(F.col("p_retailprice").alias("y"), (F.col("p_size") * 20.0 + 900).alias("p"))
    return m.regression_metrics(df, "y", "p")


@query(
    "roc_auc",
    """with d as (select quality as y, n_chars as s from labels join documents using (doc_id)),
    r as (select y, rank() over (order by s) + (count(*) over (partition by s) - 1) / 2.0 as r from d)
    select (sum(r) filter (y = 1) - count(*) filter (y = 1) * (count(*) filter (y = 1) + 1) / 2) / (count(*) filter (y = 1) * count(*) filter (y = 0)) as roc_auc from r""",
    dbl="roc_auc",
)
def _(t):
    df = t.labels.join(t.documents, "doc_id").select(F.col("quality").alias("y"), F.col("n_chars").alias("s"))
    return m.roc_auc(df, "y", "s")


@query(
    "mutual_information",
    """with q as (select list_distinct(quantile_cont(l_quantity, [0, .1, .2, .3, .4, .5, .6, .7, .8, .9, 1])) as e from lineitem),
    b as (select l_returnflag as y, greatest(len(list_filter(e, lambda z: z < l_quantity)) - 1, 0)::varchar as l_quantity, l_linestatus from lineitem, q),
    j as (select 'l_quantity' as feature, y, l_quantity as v from b union all select 'l_linestatus', y, l_linestatus from b),
    c as (select feature, y, v, count(*)::double as n from j group by all),
    s as (select feature, n, sum(n) over (partition by feature, y) as ny, sum(n) over (partition by feature, v) as nv, sum(n) over (partition by feature) as t from c)
    select feature, sum(n / t * ln(n * t / (nv * ny))) as mutual_information from s group by feature""",
    dbl="mutual_information",
    digits=8,
)
def _(t):
    return m.mutual_information(t.lineitem, "l_returnflag", ["l_quantity", "l_linestatus"])


def knn_sql(answer, order):
    return f"""with d as (select q.vec_id as id, k.vec_id as tid, k.label, list_sum(list_transform(range(1, 65), lambda i: pow(q.embedding[i]::double - k.embedding[i]::double, 2))) as d
      from embeddings q, embeddings k),
    n as (select id, label from d qualify row_number() over (partition by id order by d, tid) <= 5), a as (select id, {answer} as p, count(*) as c from n group by {order})
    select id as vec_id, p::double as predicted from a qualify row_number() over (partition by id order by c desc, p) = 1"""


@query("knn_classify", knn_sql("label", "id, label"), dbl="predicted")
def _(t):
    return m.knn(t.embeddings, t.embeddings, "vec_id", "embedding", "label", 5)


@query("knn_regress", knn_sql("avg(label)", "id"), dbl="predicted")
def _(t):
    return m.knn(t.embeddings, t.embeddings, "vec_id", "embedding", "label", 5, regression=True)


@query(
    "attach_predictions",
    "select p_partkey, p_retailprice, case when p_size > 10 then p_size * 20.0 end as predicted from part",
    dbl="predicted",
)
def _(t):
    answers = t.part.filter("p_size > 10").select("p_partkey", (F.col("p_size") * 20.0).alias("predicted"))
    return m.attach_predictions(t.part.select("p_partkey", "p_retailprice"), answers, ["p_partkey"])
