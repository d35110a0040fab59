"""Sources, sinks and composed jobs."""

import uuid

from pyspark.sql import functions as F

from entries import query
from entries.profile import HOLED_PART, holed_part
from tabwork.operators.profile import feature_catalog
from tabwork.plans import cleaning, features
from tabwork.session import ensure_checkpoint_dir
from tabwork.sources import tables as s

ORDER_SCHEMA = "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz, o_orderpriority string"


def scratch(t):
    """A new folder below the shared checkpoint folder."""
    ensure_checkpoint_dir(t.spark)
    return f"{t.spark.sparkContext.getCheckpointDir()}/scratch-{uuid.uuid4().hex}"


ORDERS = "select o_orderkey, o_custkey, o_orderstatus, o_totalprice, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') as o_orderdate, o_orderpriority from orders"


def day_text(df):
    return df.withColumn("o_orderdate", F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss"))


@query("csv_round_trip", ORDERS, dbl="o_totalprice")
def _(t):
    path = scratch(t)
    s.write_csv(t.orders, path)
    return day_text(s.read_csv(t.spark, path, ORDER_SCHEMA, timestampNTZFormat="yyyy-MM-dd HH:mm:ss"))


@query("csv_inferred", "select c_custkey::int as c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment from customer", dbl="c_acctbal")
def _(t):
    path = scratch(t)
    s.write_csv(t.customer, path)
    return s.read_csv(t.spark, path)


@query(
    "describe_source",
    "select 'region' as source, count(*) as row_count, 2::bigint as column_count, 'r_regionkey,r_name' as columns from region",
)
def _(t):
    return s.describe_source(t.region, "region")


@query("preview", "select * from region")
def _(t):
    return s.preview(t.region, 5)


@query("write_with_manifest", "select 4 as column_count, 'n' as key, count(*)::varchar as value from supplier")
def _(t):
    path = scratch(t)
    s.write_with_manifest(t.supplier, path, {"n": t.supplier.count()})
    return s.read_manifest(t.spark, path).select(
        F.col("column_count").cast("int").alias("column_count"), F.lit("n").alias("key"), F.col("meta.n").alias("value")
    )


@query("save_result", "select 'r1' as run_id, p_partkey, p_size from part union all select 'r2', p_partkey, p_size * 2 from part")
def _(t):
    store = s.ResultStore(t.spark, scratch(t))
    store.save(t.part.select("p_partkey", "p_size"), "sizes", "r1", "s1")
    store.save(t.part.select("p_partkey", (F.col("p_size") * 2).alias("p_size")), "sizes", "r2", "s2")
    return store.load("sizes").select("run_id", "p_partkey", "p_size")


@query("list_results", "select 'sizes' as kind, 'r1' as run_id, 's1' as session, 2 as column_count from (select count(*) from supplier)")
def _(t):
    store = s.ResultStore(t.spark, scratch(t))
    store.save(t.supplier.select("s_suppkey", "s_name"), "sizes", "r1", "s1")
    store.save(t.supplier.select("s_suppkey"), "names", "r2", "s1")
    return store.list("sizes").select("kind", "run_id", "session", "column_count")


@query("save_model")
def _(t):
    from tabwork.operators.models import score, train

    path, xs = scratch(t), ["p_size", "p_brand"]
    df = t.part.withColumn("y", F.col("p_retailprice"))
    s.save_model(train(df, "y", xs, "linear", "regression"), path)
    return score(df, s.load_model(path), "y", xs).select("p_partkey", F.round("predicted_y", 4).alias("predicted_y"))


WHITE = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
MODE = f"(select p_brand from {HOLED_PART} where p_brand is not null group by 1 order by count(*) desc, 1 limit 1)"
MEDIAN = f"(select quantile_cont(p_size, 0.5) from {HOLED_PART})"


def cleaned(t):
    return holed_part(t).select("p_name", "p_brand", "p_size")


CLEAN = f"(select lower(trim(p_name, {WHITE})) as p_name, lower(trim(coalesce(p_brand, {MODE}), {WHITE})) as p_brand, coalesce(p_size, {MEDIAN})::double as p_size from {HOLED_PART})"


@query("clean_data", f"select distinct * from {CLEAN}", dbl="p_size")
def _(t):
    return cleaning.clean_data(cleaned(t), ["p_name", "p_brand", "p_size"])


@query(
    "clean_records",
    f"""with f as (select p_partkey, coalesce(p_brand, {MODE}) as p_brand, coalesce(p_size, {MEDIAN})::double as p_size from {HOLED_PART})
    select min(p_partkey) as p_partkey, p_brand, p_size, upper(left(p_brand, 1)) || lower(substr(p_brand, 2)) as p_brand_cleaned from f group by p_brand, p_size""",
    dbl="p_size",
)
def _(t):
    return cleaning.clean_records(holed_part(t).select("p_partkey", "p_brand", "p_size"), ["p_brand", "p_size"], ["p_partkey"])


@query(
    "cleaning_actions",
    f"""select 'p_brand' as "column", 'filled with mode' as action, count(*) as row_count from {HOLED_PART} where p_brand is null
    union all select 'p_size', 'filled with median', count(*) from {HOLED_PART} where p_size is null
    union all select 'p_name', 'standardized text', count(*) from {HOLED_PART} where p_name <> lower(trim(p_name, {WHITE}))
    union all select 'p_brand', 'standardized text', count(*) from {HOLED_PART} where p_brand <> lower(trim(p_brand, {WHITE}))
    union all select '', 'removed duplicates', sum(c - 1)::bigint from (select count(*) as c from {CLEAN} group by p_name, p_brand, p_size) having sum(c - 1) > 0""",
)
def _(t):
    return cleaning.cleaning_actions(cleaned(t), ["p_name", "p_brand", "p_size"])


@query(
    "transform_data",
    """select event_id, case when (select skewness(value) from events) > 1 then ln(1 + value) end as value_log,
    (value - avg(value) over ()) / stddev_samp(value) over () as value_standardized, dense_rank() over (order by event_type) - 1 as event_type_encoded from events""",
    dbl="value_log value_standardized",
)
def _(t):
    made = cleaning.transform_data(t.events.select("event_id", "value", "event_type"), ["value", "event_type"])
    return made.drop("value", "event_type")


@query("enrich")
def _(t):
    df = holed_part(t)
    made = cleaning.enrich(df, ["p_name", "p_brand", "p_size", "p_retailprice"], cleaning.TECHNIQUES)
    return made.select("p_partkey", "p_size_confidence", "p_name_word_count", "p_brand_label_encoded", "cluster", "p_size_is_anomaly", "p_name_data_quality")




@query("generate_features")
def _(t):
    made, _ = features.generate_features(
        t.events.select("event_id", "ts", "user_id", "event_type", "value"), ["ts", "event_type", "value", "user_id"], ["temporal", "interaction", "categorical", "binning", "polynomial"]
    )
    return made


@query("feature_catalog")
def _(t):
    df = t.events.select("event_id", "ts", "user_id", "event_type", "value")
    _, listed = features.generate_features(df, ["ts", "event_type", "value", "user_id"], ["temporal", "interaction", "polynomial", "binning"])
    return feature_catalog(listed)
