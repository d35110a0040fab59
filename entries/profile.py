"""Profile queries."""

from pyspark.sql import functions as F

from entries import query
from tabwork.operators import lookup, profile as p

LINE = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
HOLED_PART = """(select p_partkey, p_name, nullif(p_brand, 'Brand#11') as p_brand, p_type,
    nullif(p_size, 7) as p_size, nullif(p_retailprice, 1000.0) as p_retailprice from part)"""


def holed_part(t):
    """part with nulls, for the null paths."""
    return t.part.select(
        "p_partkey",
        "p_name",
        F.expr("nullif(p_brand, 'Brand#11')").alias("p_brand"),
        "p_type",
        F.expr("nullif(p_size, 7)").alias("p_size"),
        F.expr("nullif(p_retailprice, 1000.0D)").alias("p_retailprice"),
    )


def each(cols, template, joiner=" union all "):
    """One SQL select per column."""
    return joiner.join(template.replace("{c}", c) for c in cols)


@query(
    "quantiles_exact",
    each(
        LINE,
        """select '{c}' as "column", count({c}) as n, quantile_cont({c}, 0.1) as d1,
           quantile_cont({c}, 0.5) as d5, quantile_cont({c}, 0.9) as d9 from lineitem""",
    ),
    dbl="d1 d5 d9",
)
def _(t):
    return lookup.quantiles(t.lineitem, LINE, {"d1": 0.1, "d5": 0.5, "d9": 0.9})


@query(
    "profile_table",
    f"""with g as (select *, count(*) as c from {HOLED_PART} group by all)
    select sum(c)::bigint as row_count, 6::bigint as column_count,
      sum(c * ((p_brand is null)::int + (p_size is null)::int + (p_retailprice is null)::int))::bigint as missing_values,
      sum(c - 1)::bigint as duplicate_rows, 3::bigint as number_columns, 3::bigint as text_columns,
      0::bigint as datetime_columns from g""",
)
def _(t):
    return p.profile_table(holed_part(t))


@query(
    "count_duplicates",
    "select sum(c - 1)::bigint as duplicate_rows from (select count(*) as c from part group by p_name, p_brand, p_type)",
)
def _(t):
    return p.count_duplicates(t.part, ["p_name", "p_brand", "p_type"])


@query(
    "missing_summary",
    each(
        ["p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice"],
        """select '{c}' as "column", count(*) filter ({c} is null) as missing,
        count(*) filter ({c} is null) * 100.0 / count(*) as missing_pct from """ + HOLED_PART,
    ),
    dbl="missing_pct",
)
def _(t):
    return p.missing_summary(holed_part(t))


@query(
    "cardinality",
    each(
        ["p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice"],
        """select '{c}' as "column", count(distinct {c}) as unique_count,
        count(distinct {c}) * 100.0 / count(*) as unique_pct from """ + HOLED_PART,
    ),
    dbl="unique_pct",
)
def _(t):
    return p.cardinality(holed_part(t))


NUMERIC = """select '{c}' as "column", min({c})::double as min, max({c})::double as max, avg({c}) as mean,
  stddev_samp({c}) as sd, quantile_cont({c}, 0.5)::double as median"""


@query("profile_numeric", each(LINE, NUMERIC + " from lineitem"), dbl="min max mean sd median")
def _(t):
    return p.profile_numeric(t.lineitem, LINE)


IQR = """with q as (select quantile_cont({c}, 0.25) as q1, quantile_cont({c}, 0.75) as q3 from {t})
  select '{c}' as "column", q1, q3, q1 - 1.5 * (q3 - q1) as lower_bound, q3 + 1.5 * (q3 - q1) as upper_bound,
  (select count(*) from {t} where {c} < q1 - 1.5 * (q3 - q1) or {c} > q3 + 1.5 * (q3 - q1)) as outliers,
  (select count(*) from {t}) as row_count from q"""


@query(
    "profile_numeric_ext",
    each(
        ["value"],
        NUMERIC
        + """, skewness({c}) as skew, kurtosis({c}) as kurtosis, count(*) filter ({c} = 0) as zero_count,
        count(*) filter ({c} < 0) as negative_count, (select outliers from (
        """ + IQR.replace("{t}", "events") + ")) as outliers from events",
    ),
    dbl="min max mean sd median skew kurtosis",
)
def _(t):
    return p.profile_numeric_ext(t.events, ["value"])


@query(
    "profile_categorical",
    each(
        ["p_brand", "p_type", "p_name"],
        """select '{c}' as "column", value, n, rank, unique_count from (select {c} as value, count(*) as n,
        row_number() over (order by count(*) desc, {c}) as rank,
        (select count(distinct {c}) from """ + HOLED_PART + """) as unique_count
        from """ + HOLED_PART + """ where {c} is not null group by {c}) where rank <= 10""",
    ),
)
def _(t):
    return p.profile_categorical(holed_part(t))


@query(
    "profile_datetime",
    each(
        ["ts"],
        """select 'ts' as "column", strftime(min(ts), '%Y-%m-%d %H:%M:%S') as min_time,
        strftime(max(ts), '%Y-%m-%d %H:%M:%S') as max_time,
        floor((epoch(date_trunc('second', max(ts))) - epoch(date_trunc('second', min(ts)))) / 86400)::bigint as range_days,
        count(distinct hour(ts)) > 1 as has_time from events""",
    ),
)
def _(t):
    return p.profile_datetime(t.events)


@query(
    "has_time_component",
    """select 'o_orderdate' as "column", count(distinct hour(o_orderdate)) > 1 as has_time from orders
    union all select 'l_shipdate', count(distinct hour(l_shipdate)) > 1 from lineitem""",
)
def _(t):
    a = p.profile_datetime(t.orders).select("column", "has_time")
    return a.unionByName(p.profile_datetime(t.lineitem).select("column", "has_time"))


@query(
    "profile_text",
    each(
        ["text", "lang", "source"],
        r"""select '{c}' as "column", avg(length({c})) as avg_length, max(length({c})) as max_length,
        min(length({c})) as min_length,
        avg(len(list_filter(regexp_split_to_array({c}, '[ \t\n\r\f\v]+'), lambda x: x <> ''))) as avg_words,
        count(*) filter (regexp_matches({c}, '[0-9]')) as with_digits,
        count(*) filter (regexp_matches({c}, '[^a-zA-Z0-9 \t\n\r\f\v]')) as with_special,
        count(distinct {c}) * 1.0 / count(*) < 0.1 as likely_categorical from documents""",
    ),
    dbl="avg_length avg_words",
)
def _(t):
    return p.profile_text(t.documents)


PAIRS = [(a, b) for i, a in enumerate(LINE) for b in LINE[i + 1 :]]
CORR = " union all ".join(
    f"select '{a}' as column1, '{b}' as column2, corr({a}, {b}) as r from lineitem" for a, b in PAIRS
)


@query("correlation_matrix", CORR, dbl="r")
def _(t):
    return p.correlation_matrix(t.lineitem, LINE)


@query(
    "strong_correlations",
    """select 'l_extendedprice' as column1, 'net' as column2, corr(l_extendedprice, l_extendedprice * (1 - l_discount)) as r
    from lineitem""",
    dbl="r",
)
def _(t):
    net = t.lineitem.withColumn("net", F.col("l_extendedprice") * (1 - F.col("l_discount")))
    return p.strong_correlations(net, [*LINE, "net"])


@query(
    "normality",
    """with m as (select count(value)::double as n, avg(value) as mu from events),
    c as (select n, sum(pow(value - mu, 3)) / n / pow(sum(pow(value - mu, 2)) / n, 1.5) as g1,
       sum(pow(value - mu, 4)) / n / pow(sum(pow(value - mu, 2)) / n, 2) as b2 from events, m group by n),
    s as (select *, g1 * sqrt((n+1)*(n+3)/(6*(n-2))) as y,
       sqrt(2*(3*(n*n+27*n-70)*(n+1)*(n+3)/((n-2)*(n+5)*(n+7)*(n+9)) - 1)) - 1 as w2,
       (b2 - 3*(n-1)/(n+1)) / sqrt(24*n*(n-2)*(n-3)/((n+1)*(n+1)*(n+3)*(n+5))) as x,
       6*(n*n-5*n+2)/((n+7)*(n+9)) * sqrt(6*(n+3)*(n+5)/(n*(n-2)*(n-3))) as rb from c),
    z as (select *, y / sqrt(2/(w2-1)) as ya, 6 + 8/rb*(2/rb + sqrt(1 + 4/(rb*rb))) as a from s),
    k as (select n, ln(ya + sqrt(ya*ya+1)) / sqrt(0.5*ln(w2)) as zs,
       (1 - 2/(9*a) - cbrt((1-2/a)/(1 + x*sqrt(2/(a-4))))) / sqrt(2/(9*a)) as zk from z)
    select 'value' as "column", n::bigint as n, zs*zs + zk*zk as statistic, exp(-(zs*zs + zk*zk)/2) as p_value,
       exp(-(zs*zs + zk*zk)/2) > 0.05 as is_normal from k""",
    dbl="statistic p_value",
    digits=4,
)
def _(t):
    return p.normality(t.events, ["value"])


LABEL = """case when abs(skew) < 0.5 and abs(kurtosis) < 3 then 'normal' when skew > 1 then 'right_skewed'
  when skew < -1 then 'left_skewed' when kurtosis > 3 then 'heavy_tailed' else 'unknown' end"""
SHAPE = each(["l_quantity", "l_extendedprice"], """select '{c}' as "column", skewness({c}) as skew, kurtosis({c}) as kurtosis from lineitem""") + (
    " union all select 'value', skewness(value), kurtosis(value) from events"
)


@query("distribution_type", f"select *, {LABEL} as distribution from ({SHAPE})", dbl="skew kurtosis")
def _(t):
    return p.distribution_type(t.lineitem, ["l_quantity", "l_extendedprice"]).unionByName(
        p.distribution_type(t.events, ["value"])
    )


@query(
    "distribution_analysis",
    """with v as (select avg(value) as mean, quantile_cont(value, 0.5) as median, stddev_samp(value) as sd,
      skewness(value) as skew, kurtosis(value) as kurtosis from events)
    select 'value' as "column", measure, v.value from (select 'mean' as measure, mean as value from v union all
      select 'median', median from v union all select 'sd', sd from v union all select 'skew', skew from v
      union all select 'kurtosis', kurtosis from v) v
    union all select 'event_type', 'top:' || event_type, count(*)::double from events group by event_type""",
    dbl="value",
)
def _(t):
    return p.distribution_analysis(t.events, ["value", "event_type"])


@query(
    "histogram",
    each(
        ["l_quantity", "l_extendedprice"],
        """select '{c}' as "column", bin, count(*) as n from (select least(floor(({c} - lo) / (hi - lo) * 30), 29)::bigint as bin
        from lineitem, (select min({c}) as lo, max({c}) as hi from lineitem)) group by bin""",
    ),
)
def _(t):
    return p.histogram(t.lineitem, ["l_quantity", "l_extendedprice"])


@query(
    "box_stats",
    """with q as (select quantile_cont(value, 0.25) as q1, quantile_cont(value, 0.5) as median,
      quantile_cont(value, 0.75) as q3 from events)
    select 'value' as "column", q1, median, q3, (select min(value) from events where value >= q1 - 1.5 * (q3 - q1)) as whisker_low,
    (select max(value) from events where value <= q3 + 1.5 * (q3 - q1)) as whisker_high from q""",
    dbl="q1 median q3 whisker_low whisker_high",
)
def _(t):
    return p.box_stats(t.events, ["value"])


@query(
    "variance_importance",
    each(
        LINE,
        """select '{c}' as "column", var_samp({c}) as importance_score,
        case when max({c}) = 0 then 0 else var_samp({c}) / max({c}) end as normalized_score from lineitem""",
    ),
    dbl="importance_score normalized_score",
    digits=3,
)
def _(t):
    return p.variance_importance(t.lineitem, LINE)


@query(
    "group_stats",
    each(
        ["l_quantity", "l_extendedprice"],
        """select l_returnflag, '{c}' as "column", avg({c}) as mean, stddev_samp({c}) as sd, min({c}) as min,
        max({c}) as max, count({c}) as count, sum({c}) as sum, quantile_cont({c}, 0.5) as median
        from lineitem group by l_returnflag""",
    ),
    dbl="mean sd min max sum median",
    digits=3,
)
def _(t):
    return p.group_stats(t.lineitem, "l_returnflag", ["l_quantity", "l_extendedprice"])


@query(
    "group_mean",
    """select l_orderkey, l_partkey, l_suppkey, l_linenumber, avg(l_quantity) over (partition by l_returnflag) as group_mean
    from lineitem""",
    dbl="group_mean",
)
def _(t):
    from tabwork.operators.groups import group_mean

    return group_mean(t.lineitem, "l_returnflag", "l_quantity").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "group_mean"
    )


@query("value_counts", "select o_orderpriority, count(*) as n from orders group by o_orderpriority")
def _(t):
    return lookup.value_counts(t.orders, "o_orderpriority")


EMAIL = r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b"
PHONE = r"\b\d{3}[-.]?\d{3}[-.]?\d{4}\b"
DATE = r"\b\d{1,2}[/-]\d{1,2}[/-]\d{2,4}\b"


@query(
    "discover_text_patterns",
    each(
        ["text", "lang"],
        f"""select '{{c}}' as "column", pattern_type, '' as detail, matches, matches * 100.0 / n as pct from (
        select 'Email' as pattern_type, count(*) filter (regexp_matches({{c}}, '{EMAIL}')) as matches, count(*) as n from documents
        union all select 'Phone', count(*) filter (regexp_matches({{c}}, '{PHONE}')), count(*) from documents
        union all select 'Date', count(*) filter (regexp_matches({{c}}, '{DATE}')), count(*) from documents) where matches > 0
        union all select '{{c}}', 'Fixed Length', l::varchar, n, n * 100.0 / (select count(*) from documents) from (
          select length({{c}}) as l, count(*) as n from documents group by 1 order by 2 desc, l::varchar limit 5)
          where n > 0.1 * (select count(*) from documents)""",
    ),
    dbl="pct",
)
def _(t):
    return p.discover_text_patterns(t.documents, ["text", "lang"])


@query(
    "discover_numeric_patterns",
    each(
        ["l_discount", "l_tax"],
        """select '{c}' as "column", 'Interquartile Range' as pattern_type, null::double as value, (select count(*) from lineitem
          where {c} between q1 and q3) as matches from (select quantile_cont({c}, 0.25) as q1, quantile_cont({c}, 0.75) as q3
          from lineitem) where q3 > q1
        union all select '{c}', 'Common Value', {c}, n from (select {c}, count(*) as n from lineitem group by {c}
          order by n desc, {c} limit 3) where n > 0.05 * (select count(*) from lineitem)""",
    ),
)
def _(t):
    return p.discover_numeric_patterns(t.lineitem, ["l_discount", "l_tax"])


@query(
    "flag_patterns",
    f"""select doc_id, regexp_matches(text, '{EMAIL}') as text_email, regexp_matches(text, '{PHONE}') as text_phone,
    regexp_matches(text, '{DATE}') as text_date from documents""",
)
def _(t):
    return p.flag_patterns(t.documents, ["text"]).drop("text", "lang", "source", "n_chars")


@query(
    "enrichment_metrics",
    f"""select 6::bigint as original_columns, 7::bigint as enriched_columns, (1/6.0)::double as enrichment_ratio, s as original_missing,
    s - b as enriched_missing, b * 100.0 / s as improvement_pct from (select sum((p_brand is null)::int + (p_size is null)::int
    + (p_retailprice is null)::int)::bigint as s, sum((p_brand is null)::int)::bigint as b from {HOLED_PART})""",
    dbl="enrichment_ratio improvement_pct",
)
def _(t):
    before = holed_part(t)
    return p.enrichment_metrics(before, before.na.fill("none", ["p_brand"]).withColumn("extra", F.lit(1)))


CELLS = """(select quality as y, case when n_chars > 900 then 1 else 0 end as p from labels join documents using (doc_id))"""


def predicted(t):
    """labels with a rule's answer next to the true one."""
    return t.labels.join(t.documents, "doc_id").select(
        F.col("quality").alias("y"), (F.col("n_chars") > 900).cast("int").alias("p")
    )


@query("confusion_matrix", f"select y, p, count(*) as n from {CELLS} group by y, p")
def _(t):
    return p.confusion_matrix(predicted(t), "y", "p")


@query(
    "classification_report",
    f"""with c as (select * from {CELLS}), k as (select distinct y as label from c union select distinct p from c),
    s as (select label, (select count(*) from c where y = label) as support, (select count(*) from c where p = label) as named,
      (select count(*) from c where p = label and y = label) as hits from k),
    m as (select *, case when named > 0 then hits / named else 0 end as precision, case when support > 0 then hits / support else 0 end as recall from s)
    select label::varchar as label, precision, recall,
      case when precision + recall > 0 then 2 * precision * recall / (precision + recall) else 0 end as f1, support from m""",
    dbl="precision recall f1",
)
def _(t):
    return p.classification_report(predicted(t), "y", "p")
