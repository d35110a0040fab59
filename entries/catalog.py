"""Column catalogue rules."""

from functools import reduce

from pyspark.sql import functions as F

from entries import query
from entries.profile import HOLED_PART, holed_part
from tabwork.functions import fixed
from tabwork.operators import catalog as c, quality as q

ORDERS = "(select o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, strftime(o_orderdate, '%m/%d/%Y') as day_text from orders)"
SETS = {
    "part": (HOLED_PART, [("p_partkey", "bigint"), ("p_name", ""), ("p_brand", ""), ("p_type", ""), ("p_size", "int"), ("p_retailprice", "double")]),
    "orders": (ORDERS, [("o_orderkey", "bigint"), ("o_custkey", "bigint"), ("o_orderstatus", ""), ("o_totalprice", "double"), ("o_orderdate", "timestamp_ntz"), ("day_text", "")]),
    "documents": ("documents", [("doc_id", "bigint"), ("text", ""), ("lang", ""), ("source", ""), ("n_chars", "bigint")]),
}


BLANKS = r"[ \t\n\r\f\v]+"


def profile_sql():
    parts = []
    for name, (table, cols) in SETS.items():
        for i, (x, kind) in enumerate(cols):
            text, time = kind == "", kind.startswith("timestamp")
            number = not text and not time
            fits = " or ".join(
                f"count(try_strptime({x}, '{f}')) = count({x})"
                for f in ("%Y-%m-%d", "%m/%d/%Y", "%d/%m/%Y", "%Y-%m-%d %H:%M:%S", "%m/%d/%Y %H:%M:%S")
            )
            parts.append(
                f"""select '{name}' as dataset, '{x}' as "column", {i}::bigint as position,
                '{"text" if text else "datetime" if time else "number"}' as kind, '{kind or "string"}' as type, count(*) as row_count,
                count(*) filter ({x} is null) as missing, count(*) filter ({x} is null) * 100.0 / count(*) as missing_pct,
                {f"min({x})::double" if number else "null::double"} as min, {f"max({x})::double" if number else "null::double"} as max,
                {f"avg({x})" if number else "null::double"} as mean, {f"stddev_samp({x})" if number else "null::double"} as sd,
                {f"avg(length({x}))" if text else "null::double"} as avg_length,
                {f"avg(len(list_filter(regexp_split_to_array({x}, '{BLANKS}'), lambda w: w <> '')))" if text else "null::double"} as avg_words,
                {f"bool_or(contains({x}, '@'))" if text else "null::boolean"} as has_at,
                {f"bool_or(regexp_matches({x}, '[0-9]'))" if text else "null::boolean"} as has_digit,
                {f"bool_or(regexp_matches({x}, '[-/:]'))" if text else "null::boolean"} as has_separator,
                {f"({fits})" if text else "null::boolean"} as all_dates, count(distinct {x}) as unique_count from {table}"""
            )
    return " union all ".join(parts)


PROFILE = profile_sql()
SHARE = "unique_count / row_count"


def profile(t):
    orders = t.orders.select(
        "o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", F.date_format("o_orderdate", "MM/dd/yyyy").alias("day_text")
    )
    sets = {"part": holed_part(t), "orders": orders, "documents": t.documents}
    return reduce(lambda a, b: a.unionByName(b), [c.column_profile(df, n) for n, df in sets.items()])


def rule_query(name, make, body, dbl="", digits=6):
    @query(name, f"with p as ({PROFILE}) {body}", dbl=dbl, digits=digits)
    def _(t):
        return make(profile(t))


def name_has(words):
    return "(" + " or ".join(f"contains(lower(\"column\"), '{w}')" for w in words) + ")"


rule_query(
    "column_profile",
    lambda p: p.drop("unique_pct"),
    "select * from p",
    dbl="missing_pct min max mean sd avg_length avg_words",
    digits=4,
)
rule_query(
    "categorize_columns",
    c.categorize_columns,
    f"""select dataset, "column", case when kind = 'number' then case when unique_count < 10 then 'categorical_numeric' when type in ('int', 'bigint')
    then 'integer' else 'continuous' end when kind = 'text' then case when {SHARE} < 0.1 then 'categorical' else 'text' end
    when kind = 'datetime' then 'datetime' else 'other' end as category from p""",
)


def semantic_case(i):
    named = " ".join(f"when {name_has(r[0])} then '{r[1 + i]}'" for r in fixed.SEMANTIC_RULES)
    kinds = " ".join(f"when kind = '{k[0]}' then '{([*k[1:], 'General', 'Public'])[i]}'" for k in fixed.SEMANTIC_BY_KIND)
    default = [*fixed.SEMANTIC_DEFAULT, "General", "Public"][i]
    return f"case {named} {kinds} else '{default}' end"


CLASSES = f"""k as (select dataset, "column", position, {semantic_case(0)} as semantic_type, {semantic_case(1)} as business_meaning,
  {semantic_case(2)} as data_category, {semantic_case(3)} as privacy_level, floor(greatest(0, 100 - missing_pct))::bigint as quality_score, missing, row_count from p)"""


def class_query(name, make, body, dbl=""):
    @query(name, f"with p as ({PROFILE}), {CLASSES} {body}", dbl=dbl)
    def _(t):
        return make(profile(t))


class_query("classify_columns", c.classify_columns, "select * from k")
class_query(
    "smart_tags",
    lambda p: c.smart_tags(c.classify_columns(p)),
    """, s as (select dataset, semantic_type, count(*) as n, min(position) as f from k group by all),
    d as (select dataset, data_category, count(*) as n, min(position) as f from k group by all),
    a as (select dataset, avg(quality_score) as q from k group by dataset)
    select dataset, 'Contains ' || semantic_type as tag, 'semantic' as type, 0.9::double as confidence, n::double as value from s
      qualify row_number() over (partition by dataset order by f) <= 5
    union all select dataset, data_category || ' Data', 'category', 0.8, n from d qualify row_number() over (partition by dataset order by f) <= 3
    union all select dataset, 'Contains Sensitive Data', 'privacy', 0.95, count(*) from k where privacy_level = 'Confidential' group by dataset
    union all select dataset, 'High Quality Dataset', 'quality', 0.9, round(q, 1) from a where q > 90
    union all select dataset, 'Needs Data Cleaning', 'quality', 0.8, round(q, 1) from a where q < 60""",
    dbl="confidence value",
)
SEARCH = ["price", "text", "financial"]


def any_word(field):
    return "(" + " or ".join(f"contains(lower({field}), '{w}')" for w in SEARCH) + ")::bigint"


class_query(
    "search_catalog",
    lambda p: c.search_catalog(c.classify_columns(p), "Price TEXT financial"),
    f""", s as (select *, 3 * {any_word('semantic_type')} + 2 * {any_word('business_meaning')} + {any_word('data_category')} + 2 * {any_word('"column"')} as relevance_score from k)
    select dataset, "column", semantic_type, relevance_score from s where relevance_score > 0 order by relevance_score desc, dataset, position limit 10""",
)
class_query(
    "etl_recommendations",
    lambda p: c.etl_recommendations(c.classify_columns(p)),
    """, f as (select dataset, 100 - sum(missing) * 100.0 / sum(row_count) as complete, bool_or(privacy_level = 'Confidential') as secret,
      max(row_count) as rows, bool_or(semantic_type in ('Text', 'Email', 'Phone')) as txt from k group by dataset)
    select dataset, 'Data Completeness' as category, 'High' as priority from f where complete < 90
    union all select dataset, 'Data Security', 'Critical' from f where secret
    union all select dataset, 'Performance', 'Medium' from f where rows > 100000
    union all select dataset, 'Data Standardization', 'Medium' from f where txt""",
)
rule_query(
    "pattern_hints",
    c.pattern_hints,
    """select dataset, "column", coalesce(has_at, false) as has_at, coalesce(has_digit, false) as has_digit from p where kind = 'text'""",
)
rule_query(
    "fe_potential",
    c.fe_potential,
    f"""select dataset, "column", case when missing_pct > 70 then 'Low' when kind = 'number' then case when unique_count < 5 then 'Medium'
      when missing_pct > 50 or sd = 0 then 'Low' else 'High' end when kind = 'text' then case when {SHARE} > 0.95 then 'Medium'
      when unique_count < 20 then 'High' else 'Medium' end when kind = 'datetime' then 'High' else 'Medium' end as potential,
    case when kind = 'number' then 'aggregation,binning' || case when unique_count > 10 then ',clustering' else '' end || ',interaction,polynomial,statistical'
      when kind = 'text' then 'aggregation,categorical,frequency' || case when all_dates then ',temporal' else '' end || case when avg_words > 3 then ',text' else '' end
      else 'aggregation,temporal' end as techniques from p""",
)


def target_sql(preset):
    low, high, reg, text_high = c.TARGET_PRESETS[preset]
    text_low = 0 if preset == "deployment" else 2
    gate = "missing_pct < 30" if preset == "governance" else "true"
    return f"""select '{preset}' as preset, dataset, "column", k is not null as suitable, k as problem_type from (select *, case when not ({gate}) then null
      when kind = 'number' and unique_count between {low} and {high} then 'classification' when kind = 'number' and unique_count >= {reg} then 'regression'
      when kind = 'text' and unique_count between {text_low} and {text_high} then 'classification' end as k from p)"""


def all_presets(p):
    parts = [c.target_suitability(p, n).withColumn("preset", F.lit(n)) for n in c.TARGET_PRESETS]
    return reduce(lambda a, b: a.unionByName(b), parts)


rule_query("target_suitability", all_presets, " union all ".join(target_sql(n) for n in c.TARGET_PRESETS))
rule_query(
    "text_suitability",
    c.text_suitability,
    """select dataset, "column", kind = 'text' and coalesce(avg_length, 0) > 10 as text_suitable from p""",
)
rule_query(
    "drift_suitability",
    c.drift_suitability,
    f"""select *, drift_type not in ('Constant', 'Too many missing', 'High cardinality') as suitable from (select dataset, "column",
    case when kind = 'number' then case when unique_count < 2 then 'Constant' when missing_pct > 90 then 'Too many missing' else 'Numerical Distribution' end
    when kind = 'text' then case when {SHARE} > 0.9 then 'High cardinality' else 'Categorical Distribution' end else 'Statistical' end as drift_type from p)""",
)
rule_query(
    "matching_suitability",
    c.matching_suitability,
    f"""select dataset, "column", case when kind = 'text' and avg_length > 5 and unique_count > 1 then 'Excellent' when kind = 'text' and unique_count = 1
      then 'Poor' when kind = 'number' and unique_count < 5 then 'Low' when kind = 'number' and missing_pct > 50 then 'Poor' else 'High' end as matching,
    case when kind = 'text' and avg_length > 5 and unique_count > 1 then 'Excellent' when kind = 'text' and unique_count = 1
      then 'Poor' when kind = 'number' and unique_count < 5 then 'Fair' when kind = 'number' and missing_pct > 50 then 'Poor' else 'Good' end as clustering_potential,
    case when kind = 'number' and unique_count < 3 then 'Low' when kind = 'number' and missing_pct > 50 then 'Medium'
      when kind = 'text' and {SHARE} > 0.8 then 'Low' when kind = 'text' and unique_count >= 10 then 'Medium' else 'High' end as clustering_suitability from p""",
)
rule_query(
    "ts_suitability",
    c.ts_suitability,
    f"""select dataset, "column", kind = 'datetime' or coalesce(all_dates, false) as is_datetime, kind = 'number' and missing_pct < 50 as is_target,
    case when kind = 'datetime' then 'Excellent' when coalesce(all_dates, false) then 'Good' when kind = 'text' and ({name_has(fixed.TIME_NAMES)} or has_separator)
      then 'Medium' when kind = 'number' and unique_count > 5 and missing_pct < 80 then 'Good' else 'Low' end as suitability from p""",
)
ENRICH = " ".join(f"when {name_has(w)} then '{{}}'" for w, _ in fixed.ENRICH_RULES)
REASONS = " ".join(f"when {name_has(w)} then '{why}'" for w, why in fixed.ENRICH_RULES)
rule_query(
    "enrichment_potential",
    c.enrichment_potential,
    f"""select dataset, "column", case {ENRICH.replace('{}', 'High')} when kind = 'number' then 'Medium' when kind = 'text' and {SHARE} < 0.5 then 'Medium'
      when unique_count = 1 then 'Low' else 'Medium' end as level, case {REASONS} when kind = 'number' then 'Numeric data suitable for statistical enrichment'
      when kind = 'text' and {SHARE} < 0.5 then 'Categorical data suitable for encoding and clustering'
      when unique_count = 1 then 'Constant values - limited enrichment potential' else 'General data suitable for basic enrichment' end as reason from p""",
)
rule_query(
    "governance_relevance",
    c.governance_relevance,
    f"""select dataset, "column", case when (kind = 'number' and unique_count > 10 and missing_pct < 20) or (kind = 'text' and {SHARE} < 0.8) then 'High' else 'Medium' end as relevance,
    case when kind = 'number' and unique_count > 10 and missing_pct < 20 and missing_pct > 10 then 'Medium'
      when kind = 'text' and {SHARE} < 0.8 and {name_has(['id', 'key'])} then 'High' else 'Low' end as risk from p""",
)
rule_query(
    "null_share_level",
    c.null_share_level,
    """select dataset, "column", case when missing_pct > 50 then 'Low' when missing_pct > 20 then 'Medium' else 'High' end as deployment,
    case when missing_pct > 50 then 'Poor' when missing_pct > 20 then 'Fair' else 'Good' end as quality from p""",
)
rule_query(
    "column_flags",
    c.column_flags,
    """select dataset, "column", kind = 'number' as is_numeric, kind <> 'number' and unique_count < 10 as is_categorical,
    kind = 'text' and unique_count > 10 as is_text, kind = 'datetime' as is_datetime, unique_count, missing from p""",
)
rule_query(
    "column_characteristics",
    c.column_characteristics,
    """select dataset, "column", case kind when 'number' then printf('Numeric: %.2f to %.2f', min, max) when 'text' then printf('Text/Categorical: %d unique values', unique_count)
    else 'Data type: ' || type end as characteristics, 100 - missing_pct as quality_pct from p""",
    dbl="quality_pct",
)
rule_query(
    "column_advice",
    c.column_advice,
    f"""select dataset, "column", case kind when 'number' then printf('Numeric column with %d unique values. Range: %.2f to %.2f', unique_count, min, max)
      when 'text' then printf('Categorical column with %d unique values', unique_count) else printf('Column of type %s with %d unique values', type, unique_count) end as summary,
    case kind when 'number' then case when missing_pct < 5 then 'Good quality numeric data. Consider for statistical analysis.'
      when missing_pct < 20 then 'Some missing values. Consider for imputation strategies.' else 'High missing values. Investigate data collection process.' end
      when 'text' then case when {SHARE} > 0.8 then 'High cardinality. Consider grouping or encoding strategies.' when unique_count < 10
      then 'Low cardinality. Good for categorical analysis.' else 'Medium cardinality. Suitable for most analyses.' end
      else 'Review data type and consider appropriate preprocessing.' end as recommendation from p""",
)
rule_query(
    "quality_issues",
    c.quality_issues,
    f"""select dataset, "column", 'missing values' as issue, missing_pct as pct from p where missing_pct > 20
    union all select dataset, "column", 'high cardinality', {SHARE} * 100 from p where kind = 'text' and {SHARE} > 0.8""",
    dbl="pct",
)
rule_query(
    "tag_sensitive",
    c.tag_sensitive,
    f"""select dataset, "column", 'sensitive' as tag, 'High' as risk_level from p where {name_has(fixed.SENSITIVE_NAMES)}
    union all select dataset, "column", 'demographic', 'High' from p where {name_has(fixed.DEMOGRAPHIC_NAMES)}
    union all select dataset, "column", 'geographic', 'Medium' from p where {name_has(fixed.GEOGRAPHIC_NAMES)}""",
)
rule_query(
    "cv_risk",
    c.cv_risk,
    """select *, case when cv > 1 then 'High' when cv > 0.5 then 'Medium' else 'Low' end as level from
    (select dataset, "column", case when mean = 0 then 0 else sd / mean end as cv from p where kind = 'number')""",
    dbl="cv",
)
