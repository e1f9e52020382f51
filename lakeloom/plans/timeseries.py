"""Time-series queries: hourly sums of events, a series per event type."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeloom.operators import timeseries as S
from lakeloom.session import table

DAY, LAGS, TAIL = 24, 6, 24


def _hourly(spark: SparkSession, d: str) -> DataFrame:
    return S.regularise(table(spark, d, "events"), "event_type", "ts", "value", "hour", fill=0.0)


def _shown(df: DataFrame) -> DataFrame:
    return df.select("series", F.date_format("t", "yyyy-MM-dd HH:mm:ss").alias("t"), F.round("y", 6).alias("y"))


def ts_regularise(spark, d):
    return _shown(_hourly(spark, d))


def ts_regularise_gaps(spark, d):
    """Per user and day, with null where a user has no events."""
    return _shown(S.regularise(table(spark, d, "events"), "user_id", "ts", None, "day", "count"))


def ts_difference(spark, d):
    return _shown(S.difference(_hourly(spark, d), d=1, seasonal=1, lag=DAY))


def ts_difference_gaps(spark, d):
    """Twice differenced daily counts of each user: no difference bridges a day without events."""
    return _shown(S.difference(S.regularise(table(spark, d, "events"), "user_id", "ts", None, "day", "count"), d=2))


def ts_rolling(spark, d):
    return _shown(S.rolling(_hourly(spark, d), 5, 2))


def ts_acf(spark, d):
    return S.acf(_hourly(spark, d), LAGS).select("series", "lag", F.round("acf", 8).alias("acf"))


def ts_pacf(spark, d):
    return S.pacf(_hourly(spark, d), 2).select("series", "lag", F.round("pacf", 8).alias("pacf"))


def ts_pacf_long(spark, d):
    return S.pacf(_hourly(spark, d), 12)


def ts_adf(spark, d):
    return S.adf(_hourly(spark, d), 0).select("series", "n", F.round("statistic", 6).alias("statistic"), "stationary")


def ts_adf_lags(spark, d):
    return S.adf(_hourly(spark, d), 4)


def ts_ar1(spark, d):
    return S.ar(_hourly(spark, d), 1).select("series", "n", F.round("intercept", 6).alias("intercept"), F.round(F.col("phi")[0], 8).alias("phi"), F.round("sigma2", 4).alias("sigma2"))


def ts_ar2(spark, d):
    return S.ar(_hourly(spark, d), 2).select("series", "n", F.round(F.col("phi")[0], 7).alias("phi1"), F.round(F.col("phi")[1], 7).alias("phi2"))


def ts_ar5(spark, d):
    return S.ar(_hourly(spark, d), 5)


def ts_arima_fit(spark, d):
    return S.arima_fit(_hourly(spark, d), (1, 0, 1))


def ts_auto_order(spark, d):
    return S.auto_order(_hourly(spark, d), [(p, i, q) for p in range(3) for i in range(2) for q in range(2)])


def ts_forecast(spark, d):
    own = _hourly(spark, d)
    return S.forecast(own, S.arima_fit(own, (1, 0, 1)), 12)


def ts_forecast_ar1(spark, d):
    return S.forecast_ar1(_hourly(spark, d), 12).select("series", "step", F.round("mean", 6).alias("mean"))


def ts_ljung_box(spark, d):
    return S.ljung_box(_hourly(spark, d), LAGS).select("series", "n", F.round("q", 6).alias("q"))


def ts_eval(spark, d):
    train, test = S.hold_out(_hourly(spark, d), TAIL)
    got = S.ts_eval(S.forecast_ar1(train, TAIL), test)
    return got.select("series", "n", *[F.round(c, 6).alias(c) for c in ("mae", "rmse", "mape")])


_H = """sums as (select event_type as series, date_trunc('hour', ts) as t, sum(value) as y from events where ts is not null group by 1, 2),
span as (select series, min(t) as a, max(t) as b from sums group by 1),
grid as (select series, unnest(generate_series(a, b, interval 1 hour)) as t from span),
h as materialized (select g.series, g.t, coalesce(s.y, 0) as y from grid g left join sums s on g.series = s.series and g.t = s.t)"""
_L = "lag(y, {k}) over (partition by series order by t)"
_ACF = _H + """, z as (select series, t, y - avg(y) over (partition by series) as y from h),
l as (select series, y as z0, """ + ", ".join(f"{_L.format(k=k)} as z{k}" for k in range(1, LAGS + 1)) + """ from z),
acf as (select series, sum(z0 * z0) as s0, """ + ", ".join(f"sum(z0 * z{k}) / sum(z0 * z0) as r{k}" for k in range(1, LAGS + 1)) + """ from l group by 1)"""
_AR1 = """fit{of} as (select series, count(*) as n, regr_intercept(y, y1) as intercept, regr_slope(y, y1) as phi, regr_syy(y, y1) as syy, regr_sxx(y, y1) as sxx
from (select series, y, lag(y, 1) over (partition by series order by t) as y1 from {of}) where y1 is not null group by 1)"""

QUERIES = {f.__name__: f for f in (ts_regularise, ts_regularise_gaps, ts_difference, ts_difference_gaps, ts_rolling, ts_acf, ts_pacf, ts_pacf_long, ts_adf, ts_adf_lags, ts_ar1, ts_ar2, ts_ar5, ts_arima_fit, ts_auto_order, ts_forecast, ts_forecast_ar1, ts_ljung_box, ts_eval)}
ORACLES = {
    "ts_regularise": f"with {_H} select series, strftime(t, '%Y-%m-%d %H:%M:%S') as t, round(y, 6) as y from h",
    "ts_regularise_gaps": """with sums as (select user_id as series, date_trunc('day', ts)::timestamp as t, cast(count(*) as double) as y from events where ts is not null group by 1, 2),
span as (select series, min(t) as a, max(t) as b from sums group by 1), grid as (select series, unnest(generate_series(a, b, interval 1 day)) as t from span)
select g.series, strftime(g.t, '%Y-%m-%d %H:%M:%S') as t, round(s.y, 6) as y from grid g left join sums s on g.series = s.series and g.t = s.t""",
    "ts_difference": f"""with {_H}, s as (select series, t, y - lag(y, 24) over (partition by series order by t) as y from h), k as (select * from s where y is not null),
f as (select series, t, y - lag(y, 1) over (partition by series order by t) as y from k)
select series, strftime(t, '%Y-%m-%d %H:%M:%S') as t, round(y, 6) as y from f where y is not null""",
    "ts_difference_gaps": """with sums as (select user_id as series, date_trunc('day', ts)::timestamp as t, cast(count(*) as double) as y from events where ts is not null group by 1, 2),
span as (select series, min(t) as a, max(t) as b from sums group by 1), grid as (select series, unnest(generate_series(a, b, interval 1 day)) as t from span),
g as (select g.series, g.t, s.y from grid g left join sums s on g.series = s.series and g.t = s.t),
f as (select g.series, g.t, g.y - 2 * a.y + b.y as y from g join g a on a.series = g.series and a.t = g.t - interval 1 day join g b on b.series = g.series and b.t = g.t - interval 2 day)
select series, strftime(t, '%Y-%m-%d %H:%M:%S') as t, round(y, 6) as y from f where y is not null""",
    "ts_rolling": f"with {_H} select series, strftime(t, '%Y-%m-%d %H:%M:%S') as t, round(avg(y) over (partition by series order by t rows between 5 preceding and 2 following), 6) as y from h",
    "ts_acf": f"with {_ACF} " + " union all ".join(f"select series, {k} as lag, round({'1.0::double' if k == 0 else f'r{k}'}, 8) as acf from acf" for k in range(LAGS + 1)),
    "ts_pacf": f"with {_ACF} select series, 1 as lag, round(r1, 8) as pacf from acf union all select series, 2, round((r2 - r1 * r1) / (1 - r1 * r1), 8) from acf",
    "ts_adf": f"""with {_H}, x as (select series, lag(y, 1) over (partition by series order by t) as x, y - lag(y, 1) over (partition by series order by t) as dy from h),
f as (select series, count(*) as n, regr_slope(dy, x) as b, regr_sxx(dy, x) as sxx, regr_syy(dy, x) as syy from x where x is not null group by 1)
select series, n, round(b / sqrt((syy - b * b * sxx) / (n - 2) / sxx), 6) as statistic, b / sqrt((syy - b * b * sxx) / (n - 2) / sxx) < -2.86 as stationary from f""",
    "ts_ar1": f"with {_H}, {_AR1.format(of='h')} select series, n, round(intercept, 6) as intercept, round(phi, 8) as phi, round((syy - phi * phi * sxx) / n, 4) as sigma2 from fith",
    "ts_ar2": f"""with {_H}, l as (select series, y, lag(y, 1) over (partition by series order by t) as a, lag(y, 2) over (partition by series order by t) as b from h),
s as (select series, count(*) as n, covar_pop(a, a) as aa, covar_pop(b, b) as bb, covar_pop(a, b) as ab, covar_pop(a, y) as ay, covar_pop(b, y) as cy from l where b is not null group by 1)
select series, n, round((ay * bb - cy * ab) / (aa * bb - ab * ab), 7) as phi1, round((cy * aa - ay * ab) / (aa * bb - ab * ab), 7) as phi2 from s""",
    "ts_forecast_ar1": f"""with {_H}, {_AR1.format(of='h')}, last as (select series, arg_max(y, t) as last from h group by 1)
select f.series, cast(k as integer) as step, round(intercept / (1 - phi) + pow(phi, k) * (last - intercept / (1 - phi)), 6) as mean from fith f join last l on f.series = l.series cross join range(1, 13) r(k)""",
    "ts_ljung_box": f"""with {_ACF}, c as (select series, count(*) as n from h group by 1)
select a.series, c.n, round(c.n * (c.n + 2) * ({' + '.join(f'r{k} * r{k} / (c.n - {k})' for k in range(1, LAGS + 1))}), 6) as q from acf a join c on a.series = c.series""",
    "ts_eval": f"""with {_H}, o as (select *, row_number() over (partition by series order by t desc) as r from h), train as (select series, t, y from o where r > 24), {_AR1.format(of='train')},
last as (select series, arg_max(y, t) as last from train group by 1),
p as (select o.series, o.y, intercept / (1 - phi) + pow(phi, 25 - o.r) * (last - intercept / (1 - phi)) as f from o join fittrain f on o.series = f.series join last l on o.series = l.series where o.r <= 24)
select series, count(*) as n, round(avg(abs(f - y)), 6) as mae, round(sqrt(avg((f - y) * (f - y))), 6) as rmse, round(avg(case when y <> 0 then abs((f - y) / y) end), 6) as mape from p group by 1""",
}
