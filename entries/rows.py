"""Rows, joins and set operations."""

from pyspark.sql import functions as F

from entries import query
from entries.profile import HOLED_PART, holed_part
from tabwork.functions.columns import columns_of_kind
from tabwork.operators import groups, rows as r
from tabwork.operators.lookup import value_counts

H = "md5({k} || '|42')"
BUCKET = "(('0x' || substr(md5({k} || '|42'), 1, 8))::bigint % 1000)"


@query("select_columns", "select o_orderkey, o_totalprice from orders")
def _(t):
    return r.select_columns(t.orders, ["o_orderkey", "o_totalprice"])


@query("columns_of_kind", "select l_quantity, l_extendedprice, l_discount, l_tax, l_orderkey, l_partkey, l_suppkey, l_linenumber from lineitem")
def _(t):
    df = t.lineitem
    return df.select(*columns_of_kind(df, "number"))


@query("drop_null_target", f"select p_partkey, p_size from {HOLED_PART} where p_size is not null")
def _(t):
    return r.drop_null_target(holed_part(t), "p_size").select("p_partkey", "p_size")


@query("dropna", f"select p_partkey from {HOLED_PART} where p_size is not null and p_brand is not null")
def _(t):
    return r.dropna(holed_part(t), ["p_size", "p_brand"]).select("p_partkey")


@query("sample_n", f"select o_orderkey from orders order by {H.format(k='o_orderkey')}, o_orderkey limit 500")
def _(t):
    return r.sample_n(t.orders, 500, ["o_orderkey"]).select("o_orderkey")


@query("head_n", "select event_id, value from events order by ts, event_id limit 500", dbl="value")
def _(t):
    return r.head_n(t.events, 500, ["ts", "event_id"]).select("event_id", "value")


@query(
    "split_ordered",
    """select event_id, case when row_number() over (order by ts, event_id) <= floor((select count(*) from events) * 0.7)
    then 'reference' else 'current' end as period from events""",
)
def _(t):
    return r.split_ordered(t.events, ["ts", "event_id"], 0.7).select("event_id", "period")


@query(
    "split_random",
    f"select event_id, case when {BUCKET.format(k='event_id')} < 700 then 'reference' else 'current' end as period from events",
)
def _(t):
    return r.split_random(t.events, 0.7, ["event_id"]).select("event_id", "period")


@query(
    "split_train_test",
    f"""select doc_id, case when row_number() over (partition by quality order by {H.format(k='doc_id')}, doc_id)
    <= ceil(count(*) over (partition by quality) * 0.2) then 'test' else 'train' end as split from labels""",
)
def _(t):
    return r.split_train_test(t.labels, ["doc_id"], 0.2, "quality").select("doc_id", "split")


@query(
    "impute_median",
    f"""select p_partkey, coalesce(p_size, (select quantile_cont(p_size, 0.5) from {HOLED_PART}))::double as p_size,
    coalesce(p_retailprice, (select quantile_cont(p_retailprice, 0.5) from {HOLED_PART})) as p_retailprice from {HOLED_PART}""",
    dbl="p_size p_retailprice",
)
def _(t):
    return r.impute_median(holed_part(t), ["p_size", "p_retailprice"]).select("p_partkey", "p_size", "p_retailprice")


@query(
    "impute_mode",
    f"""select p_partkey, coalesce(p_brand, (select p_brand from {HOLED_PART} where p_brand is not null group by p_brand
    order by count(*) desc, p_brand limit 1)) as p_brand from {HOLED_PART}""",
)
def _(t):
    return r.impute_mode(holed_part(t), ["p_brand"]).select("p_partkey", "p_brand")


@query("impute_constant", f"select p_partkey, coalesce(p_brand, 'Unknown') as p_brand from {HOLED_PART}")
def _(t):
    return r.impute_constant(holed_part(t), ["p_brand"], "Unknown").select("p_partkey", "p_brand")


@query(
    "impute_mean",
    f"select p_partkey, coalesce(p_size, (select avg(p_size) from {HOLED_PART}))::double as p_size from {HOLED_PART}",
    dbl="p_size",
)
def _(t):
    return r.impute_mean(holed_part(t), ["p_size"]).select("p_partkey", "p_size")


@query("add_imputation_flag", f"select p_partkey, (p_size is not null)::int::double as p_size_confidence from {HOLED_PART}")
def _(t):
    return r.add_imputation_flag(holed_part(t), ["p_size"]).select("p_partkey", "p_size_confidence")


@query(
    "clean_features",
    """with a as (select event_id, event_type, value / nullif(round(value) % 7, 0) as v from events),
    b as (select event_id, nullif(event_type, 'click') as event_type, coalesce(v, (select quantile_cont(v, 0.5) from a)) as v from a),
    s as (select avg(v) as m, stddev_samp(v) as s from b)
    select event_id, coalesce(event_type, 'missing') as event_type, least(greatest(v, m - 5 * s), m + 5 * s) as v from b, s""",
    dbl="v",
)
def _(t):
    ratio = F.when(F.expr("round(value) % 7 = 0"), float("inf")).otherwise(F.expr("value / nullif(round(value) % 7, 0)"))
    holed = t.events.select("event_id", F.expr("nullif(event_type, 'click')").alias("event_type"), ratio.alias("v"))
    return r.clean_features(holed, ["v"], ["event_type"])


@query("sort_time", "select event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') as at from events order by ts")
def _(t):
    return r.sort_time(t.events, "ts").select("event_id", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("at"))


LAST = "select user_id, event_id, event_type from events qualify row_number() over (partition by user_id order by ts {d}, event_id {d}) = 1"


@query("dedupe_last", LAST.format(d="desc"))
def _(t):
    return r.dedupe_last(t.events, ["user_id"], ["ts", "event_id"]).select("user_id", "event_id", "event_type")


@query("drop_duplicates", "select distinct text, lang from documents")
def _(t):
    return r.drop_duplicates(t.documents.select("text", "lang"))


@query("drop_duplicates_subset", "select text, min(doc_id) as doc_id from documents group by text")
def _(t):
    return r.drop_duplicates(t.documents, ["text"], ["doc_id"]).select("text", "doc_id")


@query("limit_rows", "select o_orderkey, o_totalprice from orders order by o_totalprice desc, o_orderkey limit 50")
def _(t):
    return r.limit_rows(t.orders.select("o_orderkey", "o_totalprice"), 50, F.desc("o_totalprice"), "o_orderkey")


@query(
    "top_features",
    """select * from (select 'l_quantity' as "column", var_samp(l_quantity) as score from lineitem union all
    select 'l_extendedprice', var_samp(l_extendedprice) from lineitem union all select 'l_tax', var_samp(l_tax) from lineitem)
    order by score desc limit 2""",
    dbl="score",
    digits=3,
)
def _(t):
    from tabwork.operators.profile import variance_importance

    scores = variance_importance(t.lineitem, ["l_quantity", "l_extendedprice", "l_tax"])
    return r.limit_rows(scores.select("column", F.col("importance_score").alias("score")), 2, F.desc("score"), "column")


@query(
    "combine_forecast",
    """select event_id, value, 'history' as type, null::double as level from events union all
    select null, null, 'forecast', avg(value) from events""",
    dbl="value level",
)
def _(t):
    return r.combine_forecast(t.events.select("event_id", "value"), t.events.agg(F.avg("value").alias("level")))


FIRST = "select *, row_number() over (order by ts, event_id) <= floor(count(*) over () * 0.7) as first from events"


@query("all_categories", f"select distinct event_type from ({FIRST})")
def _(t):
    split = r.split_ordered(t.events, ["ts", "event_id"], 0.7)
    return r.all_categories(split.filter("period = 'reference'"), split.filter("period = 'current'"), "event_type")


@query(
    "difference",
    f"select o_orderkey from orders where o_orderkey not in (select o_orderkey from orders order by {H.format(k='o_orderkey')}, o_orderkey limit 500)",
)
def _(t):
    orders = t.orders.select("o_orderkey")
    return r.difference(orders, r.sample_n(orders, 500, ["o_orderkey"]), ["o_orderkey"])


@query(
    "align_counts",
    """select coalesce(a.p_brand, b.p_brand) as p_brand, coalesce(a.n, 0)::bigint as ref_count, coalesce(b.n, 0)::bigint as cur_count
    from (select p_brand, count(*) as n from part where p_size < 12 group by p_brand) a
    full join (select p_brand, count(*) as n from part where p_size >= 12 group by p_brand) b on a.p_brand = b.p_brand""",
)
def _(t):
    return r.align_counts(t.part.filter("p_size < 12"), t.part.filter("p_size >= 12"), "p_brand")


@query(
    "lookup_stats",
    """select p_partkey, coalesce(avg_price, 0) as avg_price, coalesce(n, 0)::bigint as n from part left join
    (select p_brand, avg(p_retailprice) as avg_price, count(*) as n from part where p_size > 3 and p_brand <> 'Brand#12' group by p_brand)
    using (p_brand)""",
    dbl="avg_price",
    digits=4,
)
def _(t):
    stats = (
        t.part.filter("p_size > 3 and p_brand <> 'Brand#12'")
        .groupBy("p_brand")
        .agg(F.avg("p_retailprice").alias("avg_price"), F.count(F.lit(1)).alias("n"))
    )
    return groups.lookup_stats(t.part, stats, ["p_brand"], "n").select("p_partkey", "avg_price", "n")


@query(
    "attach_fit",
    """select event_id, fitted, value - fitted as residual from events join
    (select ts::date as d, avg(value) as fitted from events group by 1) on d = ts::date""",
    dbl="fitted residual",
)
def _(t):
    e = t.events.withColumn("d", F.to_date("ts"))
    fit = e.groupBy("d").agg(F.avg("value").alias("fitted"))
    return r.attach_fit(e, fit, "d").select("event_id", "fitted", (F.col("value") - F.col("fitted")).alias("residual"))


@query("append_columns", "select o_orderkey, o_totalprice * 2 as twice, upper(o_orderstatus) as up from orders", dbl="twice")
def _(t):
    return r.append_columns(
        t.orders.select("o_orderkey", "o_orderstatus", "o_totalprice"),
        {"twice": F.col("o_totalprice") * 2, "up": F.upper("o_orderstatus")},
    ).drop("o_orderstatus", "o_totalprice")


@query(
    "enrich_lookup",
    """select c_custkey, n_name, r_name from customer left join nation on c_nationkey = n_nationkey
    left join region on n_regionkey = r_regionkey""",
)
def _(t):
    nation = t.nation.withColumnRenamed("n_nationkey", "c_nationkey")
    region = t.region.withColumnRenamed("r_regionkey", "n_regionkey")
    named = r.enrich_lookup(t.customer, nation, "c_nationkey")
    return r.enrich_lookup(named, region, "n_regionkey").select("c_custkey", "n_name", "r_name")


@query(
    "isin_set",
    """select p_partkey, p_name in (select p_name from part group by p_name having count(*) < 30) as rare from part""",
)
def _(t):
    few = value_counts(t.part, "p_name").filter("n < 30").select("p_name")
    return r.isin_set(t.part, "p_name", few, "rare").select("p_partkey", "rare")
