"""Numeric, date, text, categorical and row-order features."""

from itertools import combinations

from pyspark.sql import functions as F

from entries import query
from entries.profile import HOLED_PART, holed_part
from tabwork.functions import calendar as cal, fixed, numeric as nf, textfeat as tf
from tabwork.operators import encode as e, groups as g, scaling as s, windows as w

NUM = ["p_size", "p_retailprice", "p_partkey"]
PAIRS = list(combinations(NUM, 2))
PART_D = f"(select p_partkey as id, p_partkey::double as p_partkey, p_size::double as p_size, p_retailprice from {HOLED_PART})"


def part_features(t, columns):
    return holed_part(t).select(F.col("p_partkey").alias("id"), *[c.alias(n) for n, c in columns.items()])


def pair_query(name, make, sql_of):
    """One entry over all pairs of the numeric columns of part."""
    cells = [x for a, b in PAIRS for x in sql_of(a, b)]
    doubles = " ".join(n for n, _, whole in cells if not whole)
    body = ", ".join(f"{x} as {n}" for n, x, _ in cells)

    @query(name, f"select id, {body} from {PART_D}", dbl=doubles)
    def _(t):
        return part_features(t, make(NUM))


pair_query(
    "interaction_features",
    nf.interaction_features,
    lambda a, b: [
        (f"{a}_x_{b}", f"{a} * {b}", 0),
        (f"{a}_plus_{b}", f"{a} + {b}", 0),
        (f"{a}_minus_{b}", f"{a} - {b}", 0),
        (f"{b}_minus_{a}", f"{b} - {a}", 0),
        (f"{a}_div_{b}", f"coalesce({a} / nullif({b}, 0), 0)", 0),
        (f"{b}_div_{a}", f"coalesce({b} / nullif({a}, 0), 0)", 0),
    ],
)
pair_query(
    "interaction_pow",
    nf.interaction_pow,
    lambda a, b: [(f"{a}_pow_{b}", f"pow(abs({a}), abs({b}) % 3)", 0)],
)
pair_query(
    "interaction_dist",
    nf.interaction_dist,
    lambda a, b: [
        (f"{a}_{b}_euclidean", f"sqrt({a} * {a} + {b} * {b})", 0),
        (f"{a}_{b}_manhattan", f"abs({a}) + abs({b})", 0),
        (f"{a}_{b}_chebyshev", f"case when {a} + {b} is not null then greatest(abs({a}), abs({b})) end", 0),
    ],
)
pair_query(
    "interaction_stats",
    nf.interaction_stats,
    lambda a, b: [
        (f"{a}_{b}_mean", f"({a} + {b}) / 2", 0),
        (f"{a}_{b}_max", f"case when {a} + {b} is not null then greatest({a}, {b}) end", 0),
        (f"{a}_{b}_min", f"case when {a} + {b} is not null then least({a}, {b}) end", 0),
        (f"{a}_{b}_range", f"abs({a} - {b})", 0),
    ],
)
pair_query(
    "interaction_cmp",
    nf.interaction_cmp,
    lambda a, b: [
        (f"{a}_gt_{b}", f"coalesce(({a} > {b})::bigint, 0)", 1),
        (f"{a}_eq_{b}", f"coalesce(({a} = {b})::bigint, 0)", 1),
    ],
)
pair_query(
    "interaction_ratio",
    nf.interaction_ratio,
    lambda a, b: [
        (f"{a}_share_{a}_{b}", f"{a} / ({a} + {b} + 1e-8)", 0),
        (f"{b}_share_{a}_{b}", f"{b} / ({a} + {b} + 1e-8)", 0),
    ],
)


@query(
    "self_powers",
    """select c_custkey, c_acctbal * c_acctbal as c_acctbal_squared, c_acctbal * c_acctbal * c_acctbal as c_acctbal_cubed,
    sqrt(abs(c_acctbal)) as c_acctbal_sqrt from customer""",
)
def _(t):
    return t.customer.select("c_custkey", *[c.alias(n) for n, c in nf.self_powers(["c_acctbal"]).items()])


@query(
    "polynomial_features",
    """select event_id, value * value as value_poly_2, value * value * value as value_poly_3, sqrt(value) as value_sqrt, cbrt(value) as value_cbrt,
    ln(value) as value_log, ln(1 + value) as value_log1p, log10(value) as value_log10, exp(least(greatest(value, -10), 10)) as value_exp,
    pow(2, least(greatest(value, -10), 10)) as value_exp2 from events""",
    dbl=" ".join(f"value_{k}" for k in "poly_2 poly_3 sqrt cbrt log log1p log10 exp exp2".split()),
)
def _(t):
    return s.polynomial_features(t.events, ["value"]).drop("ts", "user_id", "event_type", "value", "props")


@query(
    "log_sqrt",
    """select p_partkey, ln(1 + p_retailprice) as p_retailprice_log, sqrt(p_retailprice) as p_retailprice_sqrt from part""",
    dbl="p_retailprice_log p_retailprice_sqrt",
)
def _(t):
    return s.log_sqrt(t.part, ["p_retailprice"]).select("p_partkey", "p_retailprice_log", "p_retailprice_sqrt")


@query(
    "scale_zscore_minmax",
    """select event_id, (value - avg(value) over ()) / stddev_samp(value) over () as value_zscore,
    (value - min(value) over ()) / (max(value) over () - min(value) over ()) as value_minmax from events""",
    dbl="value_zscore value_minmax",
)
def _(t):
    both = s.scale(s.scale(t.events, ["value"], "zscore"), ["value"], "minmax")
    return both.select("event_id", "value_zscore", "value_minmax")


@query(
    "standard_scale",
    "select event_id, (value - avg(value) over ()) / stddev_pop(value) over () as value_scaled from events",
    dbl="value_scaled",
)
def _(t):
    return s.standard_scale(t.events, ["value"]).select("event_id", "value_scaled")


@query(
    "log_if_skewed",
    """with e as (select skewness(value) as a from events)
    select event_id, case when a > 1 then ln(1 + value) else value end as value, user_id::double as user_id from events, e""",
    dbl="value user_id",
)
def _(t):
    return s.log_if_skewed(t.events, ["value", "user_id"]).select("event_id", "value", "user_id")


@query(
    "row_stats",
    """with a as (select event_id, [value, user_id::double, nullif(event_id % 5, 0)::double] as raw from events),
    v as (select event_id, list_filter(raw, lambda x: x is not null) as v from a),
    u as (select event_id, unnest(v) as x from v)
    select event_id, avg(x) as row_mean, coalesce(stddev_samp(x), 0) as row_std, min(x) as row_min, max(x) as row_max,
    max(x) - min(x) as row_range, quantile_cont(x, 0.5) as row_median, sum(x) as row_sum, coalesce(skewness(x), 0) as row_skew
    from u group by event_id""",
    dbl="row_mean row_std row_min row_max row_range row_median row_sum row_skew",
    digits=5,
)
def _(t):
    df = t.events.withColumn("k", F.expr("nullif(event_id % 5, 0)"))
    out = nf.row_stats(["value", "user_id", "k"])
    out.pop("row_kurtosis")
    return df.select("event_id", *[c.alias(n) for n, c in out.items()])


@query(
    "row_counts",
    f"""select id, ((p_size <> 0 or p_size is null)::int + (p_retailprice <> 0 or p_retailprice is null)::int)::bigint as row_nonzero_count,
    (coalesce(p_size > 0, false)::int + coalesce(p_retailprice > 0, false)::int)::bigint as row_positive_count,
    (coalesce(p_size < 0, false)::int + coalesce(p_retailprice < 0, false)::int)::bigint as row_negative_count from {PART_D}""",
)
def _(t):
    return part_features(t, nf.row_counts(["p_size", "p_retailprice"]))


@query(
    "bin_equal",
    """with m as (select min(value) as lo, (max(value) - min(value)) / 5 as s5, (max(value) - min(value)) / 10 as s10 from events)
    select event_id, len(list_filter(range(1, 5), lambda i: value > lo + s5 * i))::bigint as value_bin_equal_5,
    len(list_filter(range(1, 10), lambda i: value > lo + s10 * i))::bigint as value_bin_equal_10 from events, m""",
)
def _(t):
    both = s.bin_equal(s.bin_equal(t.events, ["value"], 5), ["value"], 10)
    return both.select("event_id", "value_bin_equal_5", "value_bin_equal_10")


@query(
    "bin_quantile",
    """with q as (select list_distinct(quantile_cont(l_quantity, [0, .1, .2, .3, .4, .5, .6, .7, .8, .9, 1])) as e from lineitem)
    select l_quantity, count(*) as n, greatest(len(list_filter(e, lambda z: z < l_quantity)) - 1, 0)::bigint as l_quantity_bin_quantile_10
    from lineitem, q group by l_quantity, e""",
    dbl="l_quantity",
)
def _(t):
    return s.bin_quantile(t.lineitem, ["l_quantity"], 10).groupBy("l_quantity", "l_quantity_bin_quantile_10").agg(
        F.count(F.lit(1)).alias("n")
    )


@query(
    "bin_std_percentile",
    """with m as (select min(value) as lo, max(value) as hi, avg(value) as m, stddev_samp(value) as s,
      quantile_cont(value, .25) as a, quantile_cont(value, .5) as b, quantile_cont(value, .75) as c from events)
    select event_id, case when m - s < lo then null when value = lo then null
      else ((value > m - s)::int + (value > m)::int + (value > m + s)::int)::bigint end as value_bin_std,
      case when value = lo then null else ((value > a)::int + (value > b)::int + (value > c)::int)::bigint end as value_bin_percentile
    from events, m""",
)
def _(t):
    return s.bin_percentile(s.bin_std(t.events, ["value"]), ["value"]).select(
        "event_id", "value_bin_std", "value_bin_percentile"
    )


@query(
    "guided_features",
    """select p_partkey, p_retailprice / (p_size + 1e-8) as per_size,
    p_retailprice / (avg(p_retailprice) over (partition by p_brand) + 1e-8) as vs_brand from part""",
    dbl="per_size vs_brand",
)
def _(t):
    specs = [
        {"name": "per_size", "columns": ["p_retailprice", "p_size"]},
        {"name": "vs_brand", "columns": ["p_retailprice", "p_brand"]},
    ]
    return s.guided_features(t.part, specs).select("p_partkey", "per_size", "vs_brand")


@query(
    "model_features",
    """select p_partkey as id, p_size * p_retailprice as p_size_x_p_retailprice, p_size / (p_retailprice + 1e-8) as p_size_div_p_retailprice,
    (p_size * p_size)::double as p_size_squared, sqrt(p_size) as p_size_sqrt, p_retailprice * p_retailprice as p_retailprice_squared,
    sqrt(p_retailprice) as p_retailprice_sqrt, p_size + p_retailprice as numeric_sum, (p_size + p_retailprice) / 2 as numeric_mean,
    abs(p_size - p_retailprice) / sqrt(2) as numeric_std from part""",
    dbl="p_size_x_p_retailprice p_size_div_p_retailprice p_size_squared p_size_sqrt p_retailprice_squared p_retailprice_sqrt numeric_sum numeric_mean numeric_std",
    digits=5,
)
def _(t):
    cols = nf.model_features(["p_size", "p_retailprice"])
    return t.part.select(F.col("p_partkey").alias("id"), *[c.alias(n) for n, c in cols.items()])


def date_query(name, make, sql, dbl=""):
    @query(name, f"select o_orderkey, {sql} from orders", dbl=dbl)
    def _(t):
        return t.orders.select("o_orderkey", *[c.alias(n) for n, c in make("o_orderdate").items()])


D = "o_orderdate"
date_query(
    "calendar_parts",
    cal.calendar_parts,
    ", ".join(
        f"{fn}({D})::bigint as {D}_{n}"
        for n, fn in dict(
            year="year", month="month", day="day", dayofyear="dayofyear", week="week", quarter="quarter", hour="hour",
            minute="minute", second="second",
        ).items()
    )
    + f", (isodow({D}) - 1)::bigint as {D}_dayofweek",
)
date_query("day_flags", cal.day_flags, f"(isodow({D}) >= 6)::bigint as {D}_is_weekend, (isodow({D}) < 6)::bigint as {D}_is_business_day")
date_query(
    "boundary_flags",
    cal.boundary_flags,
    ", ".join(
        f"({D}::date = date_trunc('{u}', {D})::date)::bigint as {D}_is_{u}_start, "
        f"({D}::date = (date_trunc('{u}', {D}) + interval '{m} months' - interval '1 day')::date)::bigint as {D}_is_{u}_end"
        for u, m in (("month", 1), ("quarter", 3), ("year", 12))
    ),
)
date_query(
    "cyclic_features",
    cal.cyclic_features,
    ", ".join(
        f"{fn}({part}({D}) * (2 * pi()) / {size}) as {D}_{part}_{fn}"
        for part, size in (("month", 12), ("day", 31), ("hour", 24))
        for fn in ("sin", "cos")
    ),
    dbl=" ".join(f"{D}_{p}_{f}" for p in ("month", "day", "hour") for f in ("sin", "cos")),
)
date_query(
    "epoch_features",
    cal.epoch_features,
    f"""datediff('day', date '1970-01-01', {D}::date)::bigint as {D}_days_since_epoch,
    (hour({D}) * 3600 + minute({D}) * 60 + second({D}))::bigint as {D}_seconds_since_midnight, floor(epoch({D}))::bigint as {D}_timestamp""",
)
date_query(
    "season",
    cal.season,
    f"case when month({D}) in (12, 1, 2) then 0 when month({D}) <= 5 then 1 when month({D}) <= 8 then 2 else 3 end::bigint as {D}_season",
)


@query(
    "parse_datetime",
    """with a as (select o_orderkey, case o_orderkey % 4 when 0 then strftime(o_orderdate, '%Y-%m-%d') when 1 then strftime(o_orderdate, '%m/%d/%Y')
      when 2 then strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') else 'n/a ' || o_orderstatus end as s from orders)
    select o_orderkey, strftime(coalesce(try_strptime(s, '%Y-%m-%d'), try_strptime(s, '%m/%d/%Y'), try_strptime(s, '%d/%m/%Y'),
      try_strptime(s, '%Y-%m-%d %H:%M:%S'), try_strptime(s, '%m/%d/%Y %H:%M:%S')), '%Y-%m-%d %H:%M:%S') as parsed from a""",
)
def _(t):
    d = F.col("o_orderdate")
    text = (
        F.when(F.col("o_orderkey") % 4 == 0, F.date_format(d, "yyyy-MM-dd"))
        .when(F.col("o_orderkey") % 4 == 1, F.date_format(d, "MM/dd/yyyy"))
        .when(F.col("o_orderkey") % 4 == 2, F.date_format(d, "yyyy-MM-dd HH:mm:ss"))
        .otherwise(F.concat(F.lit("n/a "), "o_orderstatus"))
    )
    return t.orders.select("o_orderkey", F.date_format(cal.parse_datetime(text), "yyyy-MM-dd HH:mm:ss").alias("parsed"))


WS = r"[ \t\n\r\f\v]"
WORDS = f"list_filter(regexp_split_to_array({{x}}, '{WS}+'), lambda q: q <> '')"
PUNCT = r"[^\p{L}\p{N}_ \t\n\r\f\v]"


def n_of(pattern, x="text"):
    return f"len(regexp_extract_all({x}, '{pattern}'))"


def text_query(name, make, sql, dbl=""):
    @query(name, f"select doc_id, {sql} from documents", dbl=dbl)
    def _(t):
        return t.documents.select("doc_id", *[c.alias(n) for n, c in make("text").items()])


DW = WORDS.format(x="text")
text_query(
    "text_counts",
    tf.text_counts,
    f"""len({DW})::bigint as text_word_count, length(text) as text_char_count, len(list_distinct({DW}))::bigint as text_unique_words,
    coalesce(list_avg(list_transform({DW}, lambda w: length(w))), 0) as text_avg_word_length""",
    dbl="text_avg_word_length",
)
text_query(
    "char_class_counts",
    tf.char_class_counts,
    f"""{n_of('[A-Z]')} as text_uppercase_count, {n_of('[a-z]')} as text_lowercase_count, {n_of('[0-9]')} as text_digit_count,
    {n_of(PUNCT)} as text_punctuation_count, {n_of(WS)} as text_whitespace_count,
    {n_of('[!@#$%^&*(),.?":{}|<>]')} as text_special_char_count""",
)
text_query(
    "mark_counts",
    tf.mark_counts,
    f"{n_of('!')} as text_exclamation_count, {n_of('[?]')} as text_question_count, {n_of('[.]')} as text_period_count, {n_of(',')} as text_comma_count",
)
text_query(
    "char_ratios",
    tf.char_ratios,
    f"""{n_of('[A-Z]')} / (length(text) + 1.0) as text_uppercase_ratio, {n_of('[0-9]')} / (length(text) + 1.0) as text_digit_ratio,
    {n_of(PUNCT)} / (length(text) + 1.0) as text_punctuation_ratio""",
    dbl="text_uppercase_ratio text_digit_ratio text_punctuation_ratio",
)
text_query(
    "sentence_stats",
    tf.sentence_stats,
    f"{n_of('[.!?]+')} as text_sentence_count, len({DW}) / ({n_of('[.!?]+')} + 1.0) as text_avg_sentence_length",
    dbl="text_avg_sentence_length",
)
text_query(
    "content_flags",
    tf.content_flags,
    ", ".join(
        f"regexp_matches(text, '{p}')::bigint as text_has_{k}"
        for k, p in dict(
            url="https?://[a-zA-Z0-9$-_@.&+!*,]|https?://%[0-9a-fA-F][0-9a-fA-F]", email=fixed.EMAIL, phone=fixed.PHONE,
            hashtag=r"#[\p{L}\p{N}_]", mention=r"@[\p{L}\p{N}_]",
        ).items()
    ),
)
text_query(
    "shape_flags",
    tf.shape_flags,
    r"""regexp_matches(text, '^[A-Z]')::bigint as text_starts_with_capital, regexp_matches(text, '^[^\n]*[.!?]\n?$')::bigint as text_ends_with_punctuation,
    (text = upper(text) and text <> lower(text))::bigint as text_all_caps, (text = lower(text) and text <> upper(text))::bigint as text_all_lower""",
)


def contained(listed, x="text"):
    return "(" + " + ".join(f"contains(lower({x}), '{q}')::bigint" for q in listed) + ")"


POS, NEG = contained(fixed.FEATURE_POSITIVE), contained(fixed.FEATURE_NEGATIVE)
text_query(
    "sentiment_score",
    tf.sentiment_score,
    f"{POS}::bigint as text_positive_words, {NEG}::bigint as text_negative_words, ({POS} - {NEG})::bigint as text_sentiment_score",
)
SYL = f"""coalesce(list_avg(list_transform(list_transform({WORDS.format(x='lower(text)')}, lambda w: regexp_replace(w, '[^a-z]', '', 'g')),
  lambda w: case when w = '' then 0 else greatest(len(regexp_extract_all(w, '[aeiouy]+')) - (right(w, 1) = 'e')::int, 1) end)), 0)"""
text_query("avg_syllables", tf.avg_syllables, f"{SYL} as text_avg_syllables", dbl="text_avg_syllables")
text_query(
    "flesch",
    tf.flesch,
    f"206.835 - 1.015 * (len({DW}) / ({n_of('[.!?]+')} + 1.0)) - 84.6 * {SYL} as text_flesch_score",
    dbl="text_flesch_score",
)
text_query("standardize_text", lambda c: {"text": tf.standardize(F.col(c))}, "lower(trim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))) as text")
text_query(
    "match_key",
    lambda c: {"key": tf.match_key(F.col(c))},
    rf"regexp_replace(lower(trim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))), '{PUNCT}', '', 'g') as key",
)
text_query(
    "preview_text",
    lambda c: {"preview": tf.preview_text(F.col(c))},
    "case when length(text) > 100 then left(text, 100) || '...' else text end as preview",
)


@query(
    "clean_text",
    """select p_partkey, list_aggregate(list_transform(string_split(trim(p_name, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), ' '), lambda w: upper(left(w, 1)) || lower(substr(w, 2))),
    'string_agg', ' ') as p_name_cleaned from part""",
)
def _(t):
    return t.part.select("p_partkey", tf.clean_text("p_name").alias("p_name_cleaned"))


@query("combine_text", f"select p_partkey, p_name || ' ' || coalesce(p_brand, '') || ' ' || coalesce(p_size::varchar, '') as combined from {HOLED_PART}")
def _(t):
    return holed_part(t).select("p_partkey", tf.combine_text(["p_name", "p_brand", "p_size"]).alias("combined"))


TYPES = ["ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD"]


def hot(col, values, na=True):
    cells = [f"""coalesce({col} = '{v}', false)::bigint as "{col}_onehot_{v}" """ for v in values]
    return ", ".join(cells + ([f'({col} is null)::bigint as "{col}_onehot_nan"'] if na else []))


STATUS = "(select o_orderkey, nullif(o_orderstatus, 'P') as o_orderstatus from orders)"


def holed_orders(t):
    return t.orders.select("o_orderkey", F.expr("nullif(o_orderstatus, 'P')").alias("o_orderstatus"))


@query("one_hot", f"select o_orderkey, o_orderstatus, {hot('o_orderstatus', ['F', 'O'])} from {STATUS}")
def _(t):
    return e.one_hot(holed_orders(t), "o_orderstatus")


@query("one_hot_drop_first", f"select o_orderkey, o_orderstatus, {hot('o_orderstatus', ['O'], False)} from {STATUS}")
def _(t):
    return e.one_hot(holed_orders(t), "o_orderstatus", dummy_na=False, drop_first=True)


BRANDS = f"select p_partkey, p_brand, dense_rank() over (order by coalesce(p_brand, 'missing')) - 1 as p_brand_label_encoded from {HOLED_PART}"


@query("label_encode", BRANDS)
def _(t):
    return e.label_encode(holed_part(t).select("p_partkey", "p_brand"), "p_brand")


FREQ = f"""(with f as (select p_brand, count(*) as n from {HOLED_PART} where p_brand is not null group by p_brand),
  k as (select p_brand, n, rank() over (order by n desc) + (count(*) over (partition by n) - 1) / 2.0 as rank,
    dense_rank() over (order by n desc)::double as freq_rank from f),
  a as (select p_partkey, p_brand, coalesce(n, 0)::bigint as n, rank, freq_rank from {HOLED_PART} left join k using (p_brand))
  select p_partkey, n as p_brand_frequency, n / 2000.0 * 2000 / count(*) over () as p_brand_frequency_pct, coalesce(rank, 0) as p_brand_rank,
    coalesce(freq_rank, 0) as p_brand_freq_rank,
    (rank() over (order by n) + (count(*) over (partition by n) - 1) / 2.0) / count(*) over () as p_brand_freq_percentile,
    (p_brand is not null and n / count(*) over () < 0.01)::bigint as p_brand_is_rare,
    (p_brand is not null and n / count(*) over () > 0.1)::bigint as p_brand_is_common from a)"""


def frequency_query(name, make, cols, dbl=""):
    @query(name, f"select p_partkey, {', '.join(cols)} from {FREQ}", dbl=dbl)
    def _(t):
        return make(holed_part(t), "p_brand").select("p_partkey", *cols)


frequency_query("frequency_encode", e.frequency_encode, ["p_brand_frequency", "p_brand_frequency_pct"], "p_brand_frequency_pct")
frequency_query("frequency_rank", e.frequency_rank, ["p_brand_rank", "p_brand_freq_rank"], "p_brand_rank p_brand_freq_rank")
frequency_query("frequency_percentile", e.frequency_percentile, ["p_brand_freq_percentile"], "p_brand_freq_percentile")
frequency_query("rare_common_flags", e.rare_common_flags, ["p_brand_is_rare", "p_brand_is_common"])


@query(
    "target_encode",
    f"""select p_partkey, case when p_brand is null then 0 else avg(p_partkey) over (partition by p_brand) end as p_brand_target_encoded
    from {HOLED_PART}""",
    dbl="p_brand_target_encoded",
)
def _(t):
    return e.target_encode(holed_part(t), "p_brand", "p_partkey").select("p_partkey", "p_brand_target_encoded")


@query(
    "binary_encode",
    f"""select p_partkey, {', '.join(f'((c >> {i}) & 1)::bigint as p_name_binary_{i}' for i in range(6))} from
    (select p_partkey, dense_rank() over (order by p_name) - 1 as c from part)""",
)
def _(t):
    return e.binary_encode(t.part.select("p_partkey", "p_name"), "p_name").drop("p_name")


@query("value_length", "select p_partkey, length(p_name)::bigint as p_name_length from part")
def _(t):
    return e.value_length(t.part, "p_name").select("p_partkey", "p_name_length")


@query(
    "encode_for_model",
    "select p_partkey, dense_rank() over (order by p_brand) - 1 as p_brand, dense_rank() over (order by p_type) - 1 as p_type from part",
)
def _(t):
    return e.encode_for_model(t.part.select("p_partkey", "p_brand", "p_type", "p_name"), ["p_brand", "p_type", "p_name"], limit=50)


@query(
    "encode_mixed",
    f"""select o_orderkey, {hot('o_orderstatus', ['O', 'P'], False)}, dense_rank() over (order by d) - 1 as d from
    (select *, strftime(o_orderdate, '%Y-%m') as d from orders)""",
)
def _(t):
    df = t.orders.select("o_orderkey", "o_orderstatus", F.date_format("o_orderdate", "yyyy-MM").alias("d"))
    return e.encode_mixed(df, ["o_orderstatus", "d"])


def frames(c, over):
    out = []
    for k in w.WIDTHS:
        f = f"over ({over} rows between {k - 1} preceding and current row)"
        out += [
            f"avg({c}) {f} as {c}_rolling_mean_{k}",
            f"coalesce(stddev_samp({c}) {f}, 0) as {c}_rolling_std_{k}",
            f"quantile_cont({c}, 0.5) {f} as {c}_rolling_median_{k}",
            f"min({c}) {f} as {c}_rolling_min_{k}",
            f"max({c}) {f} as {c}_rolling_max_{k}",
        ]
    return ", ".join(out)


ROLLED = " ".join(f"value_rolling_{m}_{k}" for k in w.WIDTHS for m in ("mean", "std", "median", "min", "max"))


@query("rolling_features", f"select event_id, {frames('value', 'order by ts, event_id')} from events", dbl=ROLLED)
def _(t):
    return w.rolling_features(t.events.select("event_id", "ts", "value"), ["value"], ["ts", "event_id"]).drop("ts", "value")


@query(
    "rolling_features_keyed",
    f"select event_id, {frames('value', 'partition by user_id order by ts, event_id')} from events",
    dbl=ROLLED,
)
def _(t):
    df = t.events.select("event_id", "ts", "user_id", "value")
    return w.rolling_features(df, ["value"], ["ts", "event_id"], ["user_id"]).drop("ts", "value", "user_id")


@query(
    "lag_features",
    "select event_id, " + ", ".join(f"lag(value, {k}) over (order by ts, event_id) as value_lag_{k}" for k in w.LAGS) + " from events",
    dbl=" ".join(f"value_lag_{k}" for k in w.LAGS),
)
def _(t):
    return w.lag_features(t.events.select("event_id", "ts", "value"), ["value"], ["ts", "event_id"]).drop("ts", "value")


CUM = ", ".join(f"{f}(value) over (order by ts, event_id rows unbounded preceding) as value_cum{f}" for f in ("sum", "max", "min"))


@query("cumulative_features", f"select event_id, {CUM} from events", dbl="value_cumsum value_cummax value_cummin", digits=4)
def _(t):
    return w.cumulative_features(t.events.select("event_id", "ts", "value"), ["value"], ["ts", "event_id"]).drop("ts", "value")


@query(
    "cumprod",
    """select event_id, product(v) over (partition by user_id order by ts, event_id rows unbounded preceding) as v_cumprod from
    (select *, (value - 100) / 100 as v from events)""",
    dbl="v_cumprod",
)
def _(t):
    df = t.events.select("event_id", "ts", "user_id", ((F.col("value") - 100) / 100).alias("v"))
    return w.cumprod(df, "v", ["ts", "event_id"], ["user_id"]).select("event_id", "v_cumprod")


CHANGE = "coalesce((value - lag(value) over (order by ts, event_id)) / nullif(lag(value) over (order by ts, event_id), 0), 0)"


@query(
    "pct_change",
    f"select event_id, {CHANGE} as value_pct_change, abs({CHANGE}) as value_pct_change_abs from events",
    dbl="value_pct_change value_pct_change_abs",
)
def _(t):
    return w.pct_change(t.events.select("event_id", "ts", "value"), "value", ["ts", "event_id"]).drop("ts", "value")


PRANK = "(rank() over ({p} order by {v}) + (count(*) over (partition by {k}) - 1) / 2.0) / count(*) over ({p})"


@query(
    "percent_rank_avg",
    f"""select l_quantity, r as l_quantity_rank, count(*) as n from
    (select l_quantity, {PRANK.format(p='', v='l_quantity', k='l_quantity')} as r from lineitem) group by l_quantity, r""",
    dbl="l_quantity l_quantity_rank",
)
def _(t):
    return g.percent_rank_avg(t.lineitem, "l_quantity").groupBy("l_quantity", "l_quantity_rank").agg(F.count(F.lit(1)).alias("n"))


@query(
    "group_percentile",
    f"select event_id, {PRANK.format(p='partition by event_type', v='value', k='event_type, value')} as value_rank from events",
    dbl="value_rank",
)
def _(t):
    return g.percent_rank_avg(t.events, "value", ["event_type"]).select("event_id", "value_rank")


DEV = "value - avg(value) over (partition by event_type)"


@query(
    "group_deviation",
    f"""select event_id, {DEV} as value_event_type_deviation, abs({DEV}) as value_event_type_abs_deviation,
    ({DEV}) / (stddev_samp(value) over (partition by event_type) + 1e-8) as value_event_type_norm_deviation from events""",
    dbl="value_event_type_deviation value_event_type_abs_deviation value_event_type_norm_deviation",
)
def _(t):
    return g.group_deviation(t.events, "event_type", "value").drop("ts", "user_id", "event_type", "value", "props")


GAPS = "(select event_id, floor(epoch(ts))::bigint - lag(floor(epoch(ts))::bigint) over (order by ts) as gap_seconds from events)"
MODE = f"(select gap_seconds from {GAPS} where gap_seconds is not null group by 1 order by count(*) desc, 1 limit 1)"


@query("time_gaps", f"select event_id, gap_seconds from {GAPS}")
def _(t):
    return w.time_gaps(t.events, "ts").select("event_id", "gap_seconds")


@query(
    "irregular_gaps",
    f"""select {MODE} as modal_gap, count(*) filter (gap_seconds > 2 * {MODE}) as irregular_gaps, count(gap_seconds) as gaps from {GAPS}""",
)
def _(t):
    return w.irregular_gaps(t.events, "ts").withColumn("gaps", F.col("gaps").cast("bigint"))


@query(
    "modal_gap_frequency",
    """with d as (select o_custkey, o_orderdate::date as d from orders group by all),
    g as (select o_custkey, datediff('day', lag(d) over (partition by o_custkey order by d), d) as gap from d),
    m as (select o_custkey, gap, count(*) as n from g where gap is not null group by all),
    k as (select o_custkey, gap from m qualify row_number() over (partition by o_custkey order by n desc, gap) = 1)
    select o_custkey, gap::bigint * 86400 as modal_gap, case when gap = 1 then 'daily' when gap = 7 then 'weekly' when gap between 28 and 31 then 'monthly'
      when gap between 365 and 366 then 'yearly' else gap || '_days' end as frequency from k""",
)
def _(t):
    days = t.orders.select("o_custkey", F.to_date("o_orderdate").alias("d")).distinct()
    days = days.withColumn("d", F.col("d").cast("timestamp_ntz"))
    found = w.modal_gap(w.time_gaps(days, "d", ["o_custkey"]), ["o_custkey"])
    return found.select("o_custkey", "modal_gap", cal.frequency_name(F.col("modal_gap")).alias("frequency"))


@query(
    "moving_average",
    """select event_type, avg(value) as moving_average from (select *, row_number() over (partition by event_type order by ts desc, event_id desc) as rn
    from events) where rn <= 7 group by event_type""",
    dbl="moving_average",
)
def _(t):
    return w.moving_average(t.events, "value", ["ts", "event_id"], ["event_type"])


@query(
    "exp_smooth",
    """with a as (select user_id, value, row_number() over (partition by user_id order by ts, event_id) as rn, count(*) over (partition by user_id) as n from events)
    select user_id, sum(value * pow(0.7, n - rn) * case when rn = 1 then 1 else 0.3 end) as level, max(n) as n from a group by user_id""",
    dbl="level",
)
def _(t):
    return w.exp_smooth(t.events, "value", ["ts", "event_id"], ["user_id"])
