"""Drift queries: the first 70 % of the events by time against the rest."""

from pyspark.sql import functions as F

from entries import query
from tabwork.operators import drift as d, rows as r

SPLIT = """(select *, case when row_number() over (order by ts, event_id) <= floor((select count(*) from events) * 0.7) then 'reference' else 'current' end as period,
  case when value > 50 then 'high' else 'low' end as size from events)"""
NUMBER = ["value", "user_id"]
TEXT = ["event_type", "size"]


def split(t):
    marked = t.events.withColumn("size", F.when(F.col("value") > 50, "high").otherwise("low"))
    return r.split_ordered(marked, ["ts", "event_id"], 0.7)


def ks_sql(c):
    return f"""select '{c}' as "column", max(abs(cr / nr - cc / nc)) as statistic, max(nr)::bigint as n_ref, max(nc)::bigint as n_cur from (
      select sum(r) over w as cr, sum(k) over w as cc, sum(r) over () as nr, sum(k) over () as nc from (
        select {c} as v, count(*) filter (period = 'reference') as r, count(*) filter (period = 'current') as k from {SPLIT} group by 1)
      window w as (order by v rows unbounded preceding))"""


KS = f"""(select *, sqrt(n_ref::double * n_cur / (n_ref + n_cur)) * statistic as lam from ({' union all '.join(ks_sql(c) for c in NUMBER)}))"""
KS_P = """least(1, greatest(0, case when lam < 0.6 then 1 - sqrt(2 * pi()) / lam * list_sum(list_transform(range(1, 5), lambda k: exp(-(2 * k - 1) * (2 * k - 1) * pi() * pi() / (8 * lam * lam))))
  else 2 * list_sum(list_transform(range(1, 101), lambda k: case when k % 2 = 1 then 1 else -1 end * exp(-2.0 * k * k * lam * lam))) end))"""


def chi_sql(c):
    return f"""select '{c}' as "column", sum(case when kk = 2 then pow(greatest(abs(o - e) - 0.5, 0), 2) else pow(o - e, 2) end / e) as statistic, any_value(kk) as categories
      from (select o, sum(o) over (partition by v) * sum(o) over (partition by p) / sum(o) over () as e, (select count(distinct {c}) from events_sized) as kk
        from (select {c} as v, period as p, count(*)::double as o from {SPLIT} group by 1, 2))"""


CHI = "(" + " union all ".join(chi_sql(c) for c in TEXT).replace("events_sized", SPLIT) + ")"


@query("ks_2samp", f'select "column", statistic, {KS_P} as p_value, n_ref, n_cur from {KS}', dbl="statistic p_value")
def _(t):
    return d.ks_2samp(split(t), NUMBER)


@query("chi2_drift", f'select "column", statistic, categories from {CHI}', dbl="statistic")
def _(t):
    return d.chi2_drift(split(t), TEXT).select("column", "statistic", "categories")


@query(
    "chi2_p_value",
    f"""select "column", exp(-statistic / 2) * (1 + statistic / 2) as p_value from {CHI} where "column" = 'event_type'""",
    dbl="p_value",
)
def _(t):
    return d.chi2_drift(split(t), ["event_type"]).select("column", "p_value")


@query(
    "cardinality_drift",
    " union all ".join(
        f"""select '{c}' as "column", count(distinct {c}) filter (period = 'reference') as ref_unique, count(distinct {c}) filter (period = 'current') as cur_unique,
        abs(count(distinct {c}) filter (period = 'reference') - count(distinct {c}) filter (period = 'current'))
          / greatest(count(distinct {c}) filter (period = 'reference'), count(distinct {c}) filter (period = 'current'), 1) as drift_score from {SPLIT}"""
        for c in ("event_type", "user_id", "value")
    ),
    dbl="drift_score",
)
def _(t):
    return d.cardinality_drift(split(t), ["event_type", "user_id", "value"]).drop("p_value")


SCORES = f"""(select "column", 'Kolmogorov-Smirnov' as test, statistic as drift_score, {KS_P} as p_value from {KS} union all
  select "column", 'Chi-square', least(1, statistic / 100), exp(-statistic / 2) * (1 + statistic / 2) from {CHI} where "column" = 'event_type')"""
VERDICT = f"""(select *, case when drift_score > 0.3 then 'High' when drift_score > 0.1 then 'Medium' when drift_score > 0.05 then 'Low' else 'Minimal' end as magnitude,
  p_value < 0.05 as drift_detected from {SCORES})"""
DRIFT_COLS = [*NUMBER, "event_type"]


@query(
    "detect_drift",
    f"""select *, printf('%s drift detected (p-value: %.4f)', case when drift_detected then 'Significant' else 'No significant' end, p_value) as summary from {VERDICT}""",
    dbl="drift_score p_value",
)
def _(t):
    return d.detect_drift(split(t), DRIFT_COLS)


@query(
    "drift_verdict",
    f"""select "column", magnitude, drift_detected from {VERDICT}""",
)
def _(t):
    return d.detect_drift(split(t), DRIFT_COLS, 0.05).select("column", "magnitude", "drift_detected")


@query(
    "period_stats",
    " union all ".join(
        f"""select period, '{c}' as "column", avg({c}) as mean, stddev_samp({c}) as sd, min({c})::double as min, max({c})::double as max, count({c}) as count,
        quantile_cont({c}, 0.5)::double as median from {SPLIT} group by period"""
        for c in NUMBER
    ),
    dbl="mean sd min max median",
)
def _(t):
    return d.period_stats(split(t), NUMBER)


@query(
    "period_top_values",
    f"""select period, 'event_type' as "column", event_type as value, count(*) as n, row_number() over (partition by period order by count(*) desc, event_type) as rank
    from {SPLIT} group by period, event_type""",
)
def _(t):
    return d.period_top_values(split(t), ["event_type"])


WEIGHT = "case magnitude when 'High' then 1.0 when 'Medium' then 0.6 when 'Low' then 0.3 else 0.1 end"


@query(
    "overall_drift",
    f"""select *, overall_drift_score > 0.05 as drift_detected from (select sum(drift_score * {WEIGHT}) / sum({WEIGHT}) as overall_drift_score,
    count(*) filter (drift_detected) as columns_drifting, count(*) as columns_checked from {VERDICT})""",
    dbl="overall_drift_score",
)
def _(t):
    return d.overall_drift(d.detect_drift(split(t), DRIFT_COLS))


@query(
    "drift_summary",
    f"""select *, (cur_rows - ref_rows) * 100.0 / ref_rows as row_change_pct from (select count(*) filter (period = 'reference') as ref_rows,
    count(*) filter (period = 'current') as cur_rows, 0::bigint as ref_missing, 0::bigint as cur_missing from {SPLIT})""",
    dbl="row_change_pct",
)
def _(t):
    return d.drift_summary(split(t), DRIFT_COLS)


@query(
    "annotate_drift",
    f"""select event_id, period, (select drift_score from {VERDICT} where "column" = 'value') as value_drift_score,
    (select drift_detected from {VERDICT} where "column" = 'value') as value_drift_detected from {SPLIT}""",
    dbl="value_drift_score",
)
def _(t):
    parts = split(t)
    return d.annotate_drift(parts, ["value"], d.detect_drift(parts, ["value"])).select(
        "event_id", "period", "value_drift_score", "value_drift_detected"
    )
