"""Series queries: events per type and hour, orders per day."""

from pyspark.sql import functions as F

from entries import query
from tabwork.operators import series as s
from tabwork.plans.forecast import forecast

SER = "ser as (select event_type, date_trunc('hour', ts) as t, arg_max(value, ts) as y from events group by 1, 2)"
NUM = f"""{SER}, num as (select *, row_number() over w - 1 as x, count(*) over (partition by event_type) as n,
  epoch(t)::bigint - lag(epoch(t)::bigint) over w as gap from ser window w as (partition by event_type order by t)),
  gaps as (select event_type, gap as modal_gap from num where gap is not null group by event_type, gap
    qualify row_number() over (partition by event_type order by count(*) desc, gap) = 1),
  fit as (select event_type, max(n) as n, max(t) as last_t, min(t) as first_t, arg_min(y, t) as first_y, arg_max(y, t) as last_y, regr_slope(y, x) as slope,
    regr_intercept(y, x) as intercept, avg(y) as mean, stddev_samp(y) as sd, stddev_pop(y) as sd_pop, min(y) as min, max(y) as max,
    sqrt((regr_syy(y, x) - regr_sxy(y, x) * regr_sxy(y, x) / regr_sxx(y, x)) / max(n)) as rmse, avg(y) filter (x >= n - 7) as moving_average,
    sum(y * pow(0.7, n - 1 - x) * case when x = 0 then 1 else 0.3 end) as smoothing from num group by event_type)"""
TS = "strftime({}, '%Y-%m-%d %H:%M:%S')"
Z = 1.959963984540054


def hourly(t):
    return t.events.withColumn("hour", F.date_trunc("hour", "ts").cast("timestamp_ntz"))


def series(t):
    return s.prepare_series(hourly(t), "hour", "value", ["event_type"], ["ts"])


def text_time(df, *cols):
    return df.withColumns({c: F.date_format(c, "yyyy-MM-dd HH:mm:ss") for c in cols})


@query("prepare_series", f"with {SER} select event_type, {TS.format('t')} as t, y from ser", dbl="y")
def _(t):
    return text_time(series(t), "t")


@query(
    "prepare_series_text",
    """select o_orderpriority, strftime(o_orderdate::date, '%Y-%m-%d 00:00:00') as t, arg_max(o_totalprice, o_orderkey) as y from orders
    where o_orderstatus <> 'P' group by 1, 2""",
    dbl="y",
)
def _(t):
    orders = t.orders.select(
        "o_orderpriority",
        "o_orderkey",
        F.when(F.col("o_orderstatus") != "P", F.date_format("o_orderdate", "MM/dd/yyyy")).otherwise("unknown").alias("d"),
        F.col("o_totalprice").cast("string").alias("v"),
    )
    return text_time(s.prepare_series(orders, "d", "v", ["o_orderpriority"], ["o_orderkey"]), "t")


@query(
    "analyze_series",
    f"""with {NUM} select event_type, n as data_points, strftime(first_t, '%Y-%m-%d') as start, strftime(last_t, '%Y-%m-%d') as "end", mean, sd, min, max,
    case when last_y > first_y then 'increasing' else 'decreasing' end as trend, slope as trend_slope from fit""",
    dbl="mean sd min max trend_slope",
)
def _(t):
    return s.analyze_series(series(t), ["event_type"])


@query(
    "analyze_series_single",
    """with a as (select o_orderdate::date as t, arg_max(o_totalprice, o_orderkey) as y from orders group by 1), b as (select *, row_number() over (order by t) - 1 as x from a)
    select count(*) as data_points, strftime(min(t), '%Y-%m-%d') as start, strftime(max(t), '%Y-%m-%d') as "end", avg(y) as mean, stddev_samp(y) as sd, min(y) as min, max(y) as max,
    case when arg_max(y, t) > arg_min(y, t) then 'increasing' else 'decreasing' end as trend, regr_slope(y, x) as trend_slope from b""",
    dbl="mean sd min max trend_slope",
    digits=4,
)
def _(t):
    daily = t.orders.withColumn("d", F.to_date("o_orderdate").cast("timestamp_ntz"))
    return s.analyze_series(s.prepare_series(daily, "d", "o_totalprice", (), ["o_orderkey"]))


@query(
    "weekly_seasonality",
    f"""with {SER} select event_type, stddev_samp(m) as weekly_seasonality from (select event_type, isodow(t) as d, avg(y) as m from ser group by 1, 2) group by 1""",
    dbl="weekly_seasonality",
)
def _(t):
    return s.weekly_seasonality(series(t), ["event_type"])


def forecast_query(name, level, low, high, make):
    @query(
        name,
        f"""with {NUM}, f as (select event_type, k as step, last_t + to_seconds(k * modal_gap) as t, {level} as y, rmse, sd_pop, n
          from fit join gaps using (event_type), range(1, 13) as r(k))
        select event_type, step, {TS.format('t')} as t, y, {low} as lower_ci, {high} as upper_ci from f""",
        dbl="y lower_ci upper_ci",
    )
    def _(t):
        return text_time(make(series(t)), "t")


SPREAD = "1.96 * stddev_pop(y) over (partition by event_type) / sqrt(n)"
K = ["event_type"]
forecast_query("forecast_linear", "slope * (n - 1 + k) + intercept", f"y - {Z} * rmse", f"y + {Z} * rmse", lambda x: s.forecast_linear(x, 12, K))
forecast_query("forecast_ma", "moving_average", f"y - {SPREAD}", f"y + {SPREAD}", lambda x: s.forecast_ma(x, 12, 7, K))
forecast_query("forecast_ses", "smoothing", f"y - {SPREAD}", f"y + {SPREAD}", lambda x: s.forecast_ses(x, 12, 0.3, K))
forecast_query("forecast_mean", "mean", f"y - {Z} * sd_pop", f"y + {Z} * sd_pop", lambda x: s.forecast_mean(x, 12, K))
forecast_query("forecast_constant", "mean", "y - 1.96 * 0.1 * abs(y)", "y + 1.96 * 0.1 * abs(y)", lambda x: s.forecast_constant(x, 12, K))
forecast_query(
    "interval_spread", "slope * (n - 1 + k) + intercept", f"y - {SPREAD}", f"y + {SPREAD}", lambda x: s.forecast_linear(x, 12, K, interval="spread")
)
forecast_query(
    "interval_residual", "slope * (n - 1 + k) + intercept", "y - 1.2815515655446008 * rmse", "y + 1.2815515655446008 * rmse",
    lambda x: s.forecast_linear(x, 12, K, confidence=0.8),
)


@query(
    "future_dates",
    f"with {NUM} select event_type, k as step, {TS.format('last_t + to_seconds(k * modal_gap)')} as t from fit join gaps using (event_type), range(1, 6) as r(k)",
)
def _(t):
    return text_time(s.future_rows(s.fit_series(series(t), K), 5).select("event_type", "step", "t"), "t")


FITTED = "rows as (select num.*, y - (slope * x + intercept) as r, mean from num join fit using (event_type))"


@query(
    "fitted_rows",
    f"with {NUM}, {FITTED} select event_type, {TS.format('t')} as t, y - r as fitted, r as residual from rows",
    dbl="fitted residual",
)
def _(t):
    return text_time(s.fitted_rows(series(t), K).select("event_type", "t", "fitted", "residual"), "t")


@query(
    "fit_metrics",
    f"""with {NUM}, {FITTED} select event_type, avg(abs(r)) as mae, avg(r * r) as mse, sqrt(avg(r * r)) as rmse, avg(abs(r / y)) * 100 as mape,
    greatest(0, least(1, 1 - sum(r * r) / sum(pow(y - mean, 2)))) as r_squared from rows group by event_type""",
    dbl="mae mse rmse mape r_squared",
    digits=5,
)
def _(t):
    return s.fit_metrics(series(t), K)


@query(
    "forecast_summary",
    f"""with {NUM}, f as (select event_type, k, slope * (n - 1 + k) + intercept as y from fit, range(1, 13) as r(k)),
    a as (select event_type, avg(y) as forecast_mean, stddev_pop(y) as forecast_sd, min(y) as forecast_min, max(y) as forecast_max,
      (arg_max(y, k) - arg_min(y, k)) / 11 as trend_slope from f group by event_type)
    select *, case when trend_slope > 0.01 then 'Increasing' when trend_slope < -0.01 then 'Decreasing' else 'Stable' end as trend_direction from a""",
    dbl="forecast_mean forecast_sd forecast_min forecast_max trend_slope",
)
def _(t):
    return s.forecast_summary(s.forecast_linear(series(t), 12, K), K)


@query(
    "holdout_metrics",
    f"""with {NUM}, f as (select event_type, regr_slope(y, x) as a, regr_intercept(y, x) as b from num where x < floor(n * 0.8) group by event_type),
    r as (select event_type, y, y - (a * x + b) as r from num join f using (event_type) where x >= floor(n * 0.8))
    select event_type, avg(abs(r)) as mae, avg(r * r) as mse, sqrt(avg(r * r)) as rmse, avg(abs(r / y)) * 100 as mape, count(*) as validation_points from r group by event_type""",
    dbl="mae mse rmse mape",
    digits=5,
)
def _(t):
    return s.holdout_metrics(series(t), K)


FUTURE = f"""select event_type, last_t + to_seconds(k * modal_gap) as t, slope * (n - 1 + k) + intercept as y, rmse, n, k from fit join gaps using (event_type), range(1, 13) as r(k)"""


@query(
    "enlarge_series",
    f"""with {NUM}, {FITTED}, f as ({FUTURE}) select event_type, {TS.format('t')} as t, y, y - r as fitted_values, r as residuals, false as is_forecast,
      null::double as lower_ci, null::double as upper_ci, null::bigint as forecast_period from rows
    union all select event_type, {TS.format('t')}, y, y, null, true, y - {Z} * rmse, y + {Z} * rmse, k from f""",
    dbl="y fitted_values residuals lower_ci upper_ci",
)
def _(t):
    return text_time(s.enlarge_series(series(t), 12, K), "t")


@query(
    "forecast_job",
    f"""with {NUM}, f as ({FUTURE}) select event_type, {TS.format('t')} as t, y, 'historical' as type, y as lower_ci, y as upper_ci from ser
    union all select event_type, {TS.format('t')}, y, 'forecast', y - {SPREAD}, y + {SPREAD} from f""",
    dbl="y lower_ci upper_ci",
)
def _(t):
    return text_time(forecast(hourly(t), "hour", "value", 12, "linear", K, ["ts"]), "t")
