"""Quality scores and ratings."""

from pyspark.sql import functions as F

from entries import query
from entries.profile import HOLED_PART, IQR, holed_part
from tabwork.functions import fixed
from tabwork.operators import quality as q

SCORED = f"""(select p_name, p_brand, p_type, p_size from {HOLED_PART})"""
FACTS = f"""f as (select sum(c) as n, sum(c * ((p_brand is null)::int + (p_size is null)::int)) as miss, sum(c - 1) as dup
  from (select *, count(*) as c from {SCORED} group by all))"""


def scored(t):
    return holed_part(t).select("p_name", "p_brand", "p_type", "p_size")


@query("quality_score", f"with {FACTS} select 100 - 50 * (miss / (n * 4)) - 30 * (dup / n) as quality_score from f", dbl="quality_score")
def _(t):
    return q.quality_score(scored(t))


@query(
    "quality_dimensions",
    f"""with {FACTS}, s as (select (1 - miss / (n * 4)) * 100 as completeness, 100.0::double as consistency,
      100.0::double as validity, (1 - dup / n) * 100 as uniqueness from f)
    select *, case when (completeness + consistency + validity + uniqueness) / 4 >= 90 then 'Excellent'
      when (completeness + consistency + validity + uniqueness) / 4 >= 80 then 'Good'
      when (completeness + consistency + validity + uniqueness) / 4 >= 70 then 'Fair' else 'Poor' end as grade from s""",
    dbl="completeness consistency validity uniqueness",
)
def _(t):
    return q.quality_dimensions(scored(t))


@query(
    "quality_simple",
    f"""with {FACTS} select round(((1 - miss / (n * 4)) * 100 + 100 - dup / n * 100) / 2, 2) as overall_score, round((1 - miss / (n * 4)) * 100, 2) as completeness,
    round(100 - dup / n * 100, 2) as consistency, miss::bigint as missing_values, dup::bigint as duplicate_rows, (1 - miss / (n * 4)) * 100 < 90 as address_missing,
    dup > 0 as remove_duplicates from f""",
    dbl="overall_score completeness consistency",
)
def _(t):
    return q.quality_simple(scored(t))


@query(
    "matching_quality",
    f"""with {FACTS}, l as (select least(1, (avg(length(p_name)) + avg(length(p_brand)) + avg(length(p_type))) / 3 / 20) as t from {SCORED})
    select (0.4 * (1 - miss / (n * 4)) + 0.3 * (1 - dup / n) + 0.3 * t) * 100 as matching_quality from f, l""",
    dbl="matching_quality",
)
def _(t):
    return q.matching_quality(scored(t))


@query(
    "governance_quality",
    f"""with o as (select outliers * 100.0 / row_count as pct from ({IQR.replace('{c}', 'p_retailprice').replace('{t}', HOLED_PART)})),
    a as (select 'p_brand' as "column", 100 - count(*) filter (p_brand is null) * 100.0 / count(*) as completeness,
        count(*) filter (p_brand = lower(p_brand)) * 100.0 / count(p_brand) as consistency, 90.0 as validity,
        count(distinct p_brand) * 100.0 / count(*) as uniqueness, 'Standardization Required' as governance_flags from {HOLED_PART}
      union all select 'p_retailprice', 100 - count(*) filter (p_retailprice is null) * 100.0 / count(*), 95.0, greatest(0, 100 - 2 * max(pct)),
        count(distinct p_retailprice) * 100.0 / count(*), case when max(pct) > 5 then 'Outlier Management Needed' else '' end from {HOLED_PART}, o)
    select *, (completeness + consistency + validity) / 3 as overall_score from a""",
    dbl="completeness consistency validity uniqueness overall_score",
)
def _(t):
    return q.governance_quality(holed_part(t), ["p_brand", "p_retailprice"])


@query(
    "ts_quality",
    """with d as (select event_type as k, floor(epoch(ts))::bigint as s, nullif(value, 100.0) as v, ts from events),
    b as (select k, quantile_cont(v, .25) as q1, quantile_cont(v, .75) as q3, count(*) as n, count(*) filter (v is null) as missing from d group by k),
    o as (select k, count(*) filter (v < q1 - 1.5 * (q3 - q1) or v > q3 + 1.5 * (q3 - q1)) as outliers from d join b using (k) group by k),
    g as (select k, s - lag(s) over (partition by k order by ts) as gap from d),
    m as (select k, gap as mode from g where gap is not null group by k, gap qualify row_number() over (partition by k order by count(*) desc, gap) = 1),
    i as (select k, count(*) filter (mode > 0 and gap > 2 * mode) as irregular from g join m using (k) group by k),
    s as (select k as event_type, n as data_points, missing, outliers, irregular as irregular_gaps,
      least(greatest(100 - missing * 200.0 / n - outliers * 100.0 / n - irregular * 50.0 / n, 0), 100) as quality_score from b join o using (k) join i using (k))
    select *, case when quality_score >= 90 then 'Excellent' when quality_score >= 70 then 'Good' when quality_score >= 50 then 'Fair' else 'Poor' end as quality_level from s""",
    dbl="quality_score",
)
def _(t):
    e = t.events.withColumn("value", F.expr("nullif(value, 100.0D)"))
    return q.ts_quality(e, "ts", "value", ["event_type"])


MARKED = " or ".join(f"contains(trim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '{m}')" for m in fixed.BAD_MARKS)


@query(
    "text_value_quality",
    f"""select doc_id, (case when length(trim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))) < 2 then 0.5 else 1 end * case when {MARKED} then 0.3 else 1 end
    * case when length(trim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))) > 200 then 0.7 else 1 end)::double as text_data_quality from documents""",
    dbl="text_data_quality",
)
def _(t):
    return q.text_value_quality(t.documents, ["text"]).select("doc_id", "text_data_quality")


@query(
    "iqr_outliers",
    " union all ".join(f"select * from ({IQR.replace('{c}', x).replace('{t}', 'lineitem')})" for x in ("l_quantity", "l_extendedprice", "l_discount", "l_tax")),
    dbl="q1 q3 lower_bound upper_bound",
)
def _(t):
    from tabwork.operators.profile import iqr_outliers

    return iqr_outliers(t.lineitem, ["l_quantity", "l_extendedprice", "l_discount", "l_tax"])


@query(
    "flag_anomalies",
    """with q as (select quantile_cont(value, .25) as q1, quantile_cont(value, .75) as q3 from events),
    b as (select q1 - 1.5 * (q3 - q1) as lo, q3 + 1.5 * (q3 - q1) as hi from q)
    select event_id, value < lo or value > hi as value_is_anomaly, case when value < lo then lo - value when value > hi then value - hi else 0 end as value_anomaly_score
    from events, b""",
    dbl="value_anomaly_score",
)
def _(t):
    return q.flag_anomalies(t.events, ["value"]).select("event_id", "value_is_anomaly", "value_anomaly_score")


HOLED_EVENTS = """(select event_type, value * value as squared, case when value > 20 then null else value end as small, 7 as same from events)"""


@query(
    "detect_anomalies",
    f"""select 'missing' as type, 'small' as "column", count(*) filter (small is null) * 100.0 / count(*) as value, 95 as confidence from {HOLED_EVENTS}
    having count(*) filter (small is null) > 0.5 * count(*)
    union all select 'outliers', 'squared', outliers, 80 from ({IQR.replace('{c}', 'squared').replace('{t}', HOLED_EVENTS)}) where outliers > 0.05 * row_count
    union all select 'outliers', 'small', outliers, 80 from ({IQR.replace('{c}', 'small').replace('{t}', HOLED_EVENTS)}) where outliers > 0.05 * row_count
    union all select 'constant', 'same', 1, 100 union all
    select 'duplicates', '', sum(c - 1), 100 from (select count(*) as c from {HOLED_EVENTS} group by event_type, squared, small, same) having sum(c - 1) > 0""",
    dbl="value",
)
def _(t):
    v = F.col("value")
    holed = t.events.select("event_type", (v * v).alias("squared"), F.when(v <= 20, v).alias("small"), F.lit(7).alias("same"))
    return q.detect_anomalies(holed)


@query(
    "add_quality_columns",
    f"""select p_partkey, (select 100 - count(*) filter (p_size is null) * 100.0 / count(*) from {HOLED_PART}) as p_size_quality_score from {HOLED_PART}""",
    dbl="p_size_quality_score",
)
def _(t):
    return q.add_quality_columns(holed_part(t), ["p_size"]).select("p_partkey", "p_size_quality_score")


@query(
    "add_readiness_columns",
    f"""select p_partkey, true as deployment_ready, 'forest' as model_type, case when p_size is null then 0 else 100 end::bigint as p_size_quality_score from {HOLED_PART}""",
)
def _(t):
    return q.add_readiness_columns(holed_part(t), ["p_size"], "forest").select(
        "p_partkey", "deployment_ready", "model_type", "p_size_quality_score"
    )


RUNS = """(select p_brand as run, case when p_brand not like '%3' then avg((p_size > 12)::int) end as accuracy, avg((p_size > 20)::int) as r2, count(*) as data_size, max(p_size)::bigint as num_features,
  100.0 - avg(p_size) as quality_score from part group by p_brand)"""


def runs(t):
    """A metrics table with one row per brand; some have no accuracy, as regressions do."""
    return t.part.groupBy(F.col("p_brand").alias("run")).agg(
        F.when(~F.col("p_brand").like("%3"), F.avg((F.col("p_size") > 12).cast("int"))).alias("accuracy"),
        F.avg((F.col("p_size") > 20).cast("int")).alias("r2"),
        F.count(F.lit(1)).alias("data_size"),
        F.max("p_size").cast("bigint").alias("num_features"),
        (100.0 - F.avg("p_size")).alias("quality_score"),
    )


RISK = f"""(select *, case when risk_score >= 5 then 'High' when risk_score >= 3 then 'Medium' else 'Low' end as risk_level from (select *,
  (case when accuracy < 0.7 then 3 when accuracy < 0.8 then 1 else 0 end + case when r2 < 0.5 then 3 when r2 < 0.7 then 1 else 0 end
  + case when data_size < 1000 then 2 when data_size < 5000 then 1 else 0 end + case when num_features > data_size / 10 then 2 else 0 end)::bigint as risk_score from {RUNS}))"""


@query("model_risk", f"select run, risk_score, risk_level from {RISK}")
def _(t):
    return q.model_risk(runs(t)).select("run", "risk_score", "risk_level")


@query(
    "governance_score",
    f"""with s as (select run, quality_score * 0.4 + case risk_level when 'Low' then 90.0 when 'Medium' then 70.0 when 'High' then 40.0 else 50.0 end * 0.3 + 85.0 * 0.3 as g from {RISK})
    select run, round(g, 1) as governance_score, case when g >= 90 then 'A' when g >= 80 then 'B' when g >= 70 then 'C' else 'D' end as grade from s""",
    dbl="governance_score",
)
def _(t):
    return q.governance_score(q.model_risk(runs(t)), 85).select("run", "governance_score", "grade")


@query(
    "performance_level",
    f"""select run, case when accuracy is null then case when r2 >= 0.8 then 'Excellent' when r2 >= 0.6 then 'Good' when r2 >= 0.4 then 'Fair' else 'Poor' end
    when accuracy >= 0.9 then 'Excellent' when accuracy >= 0.8 then 'Good' when accuracy >= 0.7 then 'Fair' else 'Poor' end as level from {RUNS}""",
)
def _(t):
    return q.performance_level(runs(t)).select("run", "level")


RULES = [
    ("accuracy", 0.9, 2, "Excellent performance", "accuracy %.3f"),
    ("accuracy", 0.7, 0.9, "Good performance", "accuracy %.3f"),
    ("accuracy", -1, 0.7, "Weak performance", "accuracy %.3f needs work"),
    ("r2", 0.5, 2, "Good fit", "r2 %.3f"),
]


@query(
    "insight_rows",
    f"""with m as (select run, 'accuracy' as metric, accuracy as value from {RUNS} union all select run, 'r2', r2 from {RUNS})
    select run, metric, case when metric = 'r2' then 'Good fit' when value >= 0.9 then 'Excellent performance' when value >= 0.7 then 'Good performance' else 'Weak performance' end as title,
    case when metric = 'r2' then printf('r2 %.3f', value) when value >= 0.7 then printf('accuracy %.3f', value) else printf('accuracy %.3f needs work', value) end as description
    from m where value is not null and (metric = 'accuracy' or value >= 0.5)""",
)
def _(t):
    return q.insight_rows(runs(t).unpivot(["run"], ["accuracy", "r2"], "metric", "value"), RULES)
