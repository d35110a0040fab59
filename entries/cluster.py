"""Clustering queries; fits have no SQL twin, reports and density clusters have."""

from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from entries import query
from tabwork.operators import cluster as c

VALUES = ["c_acctbal", "c_nationkey"]


def vectors(t):
    return t.embeddings.withColumn("features", array_to_vector(F.col("embedding").cast("array<double>")))


def sizes(df):
    return df.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"))


@query("cluster_kmeans")
def _(t):
    return sizes(c.cluster_kmeans(t.customer, [*VALUES, "c_mktsegment"], 5))


@query("cluster_bisecting")
def _(t):
    return sizes(c.cluster_bisecting(t.customer, VALUES, 4))


@query("append_cluster")
def _(t):
    from pyspark.ml.clustering import KMeans

    ready = vectors(t)
    return c.append_cluster(ready, KMeans(k=10, seed=42).fit(ready)).groupBy("label", "cluster").agg(F.count(F.lit(1)).alias("n"))


@query("cluster_features")
def _(t):
    made = c.cluster_features(t.customer, VALUES)
    return made.agg(F.count(F.lit(1)).alias("n"), *[F.round(F.avg(f"kmeans_distance_min_{k}"), 4).alias(f"d{k}") for k in c.FEATURE_K])


@query("auto_cluster")
def _(t):
    return c.auto_cluster(t.customer, VALUES)[1]


@query("silhouette")
def _(t):
    score = c.silhouette(vectors(t).withColumn("prediction", F.col("label").cast("int")))
    return t.embeddings.agg(F.count(F.lit(1)).alias("n"), F.lit(float(score)).alias("silhouette"))


@query("pca_2d")
def _(t):
    return c.pca_2d(vectors(t)).agg(F.count("x").alias("n"), F.round(F.var_samp("x"), 4).alias("vx"), F.round(F.var_samp("y"), 4).alias("vy"))


@query(
    "cluster_prepare",
    """with a as (select c_custkey, c_acctbal, dense_rank() over (order by c_mktsegment) - 1 as s from customer)
    select c_custkey, (c_acctbal - avg(c_acctbal) over ()) / stddev_pop(c_acctbal) over () as c_acctbal_scaled,
    (s - avg(s) over ()) / stddev_pop(s) over () as c_mktsegment_scaled from a""",
    dbl="c_acctbal_scaled c_mktsegment_scaled",
)
def _(t):
    return c.cluster_prepare(t.customer, ["c_acctbal", "c_mktsegment"]).select("c_custkey", "c_acctbal_scaled", "c_mktsegment_scaled")


@query(
    "cluster_prepare_mixed",
    """select c_custkey, (c_acctbal - avg(c_acctbal) over ()) / stddev_pop(c_acctbal) over () as first, dense_rank() over (order by c_mktsegment) as level from customer""",
    dbl="first",
)
def _(t):
    from pyspark.ml.functions import vector_to_array

    v = vector_to_array("features")
    ready = c.cluster_prepare_mixed(t.customer, ["c_acctbal", "c_mktsegment"])
    hot = F.array_position(F.slice(v, 2, 100), 1.0).cast("bigint")
    return ready.select("c_custkey", F.get(v, 0).alias("first"), hot.alias("level"))


@query(
    "cluster_stats",
    """with a as (select c_nationkey % 4 as cluster, c_acctbal as v, c_mktsegment as s from customer),
    w as (select cluster, count(*)::double as size, count(*) * 100.0 / (select count(*) from a) as share, avg(v) as mean, stddev_samp(v) as sd, min(v) as lo, max(v) as hi from a group by cluster)
    select cluster, '' as "column", 'size' as measure, size as value from w union all select cluster, '', 'share', share from w
    union all select cluster, 'c_acctbal', 'mean', mean from w union all select cluster, 'c_acctbal', 'sd', sd from w
    union all select cluster, 'c_acctbal', 'min', lo from w union all select cluster, 'c_acctbal', 'max', hi from w
    union all select cluster, 'c_mktsegment', 'top:' || s, n from (select cluster, s, count(*)::double as n from a group by cluster, s)
      qualify row_number() over (partition by cluster order by n desc, s) <= 3""",
    dbl="value",
)
def _(t):
    marked = t.customer.withColumn("cluster", F.col("c_nationkey") % 4)
    return c.cluster_stats(marked, ["c_acctbal", "c_mktsegment"])


DIMS = [f"d{i}" for i in range(1, 65)]


@query(
    "cluster_centers",
    f"select label as cluster, {', '.join(f'avg(embedding[{i}]) as d{i}' for i in range(1, 65))} from embeddings group by label",
    dbl=" ".join(DIMS),
)
def _(t):
    df = t.embeddings.select(F.col("label").alias("cluster"), *[F.get("embedding", i).alias(d) for i, d in enumerate(DIMS)])
    return c.cluster_centers(df, DIMS)


@query(
    "cluster_dbscan",
    """with recursive p as (select c_custkey as id, c_acctbal / 100 as a, c_nationkey * 2.0 as b from customer),
    nb as (select x.id as i, y.id as j, pow(x.a - y.a, 2) + pow(x.b - y.b, 2) as d from p x join p y on pow(x.a - y.a, 2) + pow(x.b - y.b, 2) <= 2.25),
    core as (select i from nb group by i having count(*) >= 4),
    e as (select i, j from nb where i in (select i from core) and j in (select i from core)),
    r as (select i, i as nd from core union select r.i, e.j from r join e on e.i = r.nd),
    k as (select i, min(nd) as root from r group by i),
    l as (select i, dense_rank() over (order by root) - 1 as cluster from k),
    bd as (select nb.i, arg_min(l.cluster, [nb.d, l.cluster::double]) as cluster from nb join l on l.i = nb.j where nb.i not in (select i from core) group by nb.i)
    select id as c_custkey, coalesce(l.cluster, bd.cluster, -1)::bigint as cluster from p left join l on l.i = id left join bd on bd.i = id""",
)
def _(t):
    df = t.customer.select("c_custkey", (F.col("c_acctbal") / 100).alias("a"), (F.col("c_nationkey") * 2.0).alias("b"))
    return c.cluster_dbscan(df, "c_custkey", ["a", "b"], 1.5, 4)
