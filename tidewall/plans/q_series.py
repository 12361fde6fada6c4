"""Queries of the daily-series operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewall.operators import series
from tidewall.plans.registry import query, rounded
from tidewall.plans.standins import oracle, standin
from tidewall.sources.shared import stored

#: The stand-in series has seven years, so its normals are taken over those.
FIRST, LAST = 1995, 2000
_TEMP = "tm as (select cell_id, year(date) as year, month(date) as month, count(*) filter (tasmin < 0 and tasmax > 0) as ftc, sum(greatest(0, -(tasmin + tasmax) / 2)) as fdd from si_temp group by 1, 2, 3)"
_RAIN = "rm as (select cell_id, year(date) as year, month(date) as month, count(*) filter (value < 1) as drydays, count(*) filter (value >= 10) as r10mm, count(*) filter (value >= 20) as r20mm from si_rain group by 1, 2, 3)"
_SPELLS = """aw as (select *, coalesce(sum(value) over (partition by cell_id order by date rows between 1 following and 3 following), 0) as ahead from si_rain),
    dr as (select *, i - row_number() over (partition by cell_id order by date) as run from aw where value < 1),
    sp as (select cell_id, min(date) as start, max(date) as "end", count(*) as length, arg_max(ahead, date) >= 10 as rewet from dr group by cell_id, run)"""
_ANNUAL = """yr as (select cell_id, year(date) as year, max(value) as rain_max_day from si_rain group by 1, 2),
    sy as (select cell_id, year(start) as year, max(length) as m, count(*) filter (length >= 10) as c10, count(*) filter (length >= 15) as c15, count(*) filter (length >= 21) as c21, count(*) filter (length >= 15 and rewet) as rw from sp group by 1, 2),
    an as (select yr.cell_id, yr.year, rain_max_day, coalesce(m, 0) as dryspell_max, coalesce(c10, 0) as dryspell_count_10, coalesce(c15, 0) as dryspell_count_15, coalesce(c21, 0) as dryspell_count_21, coalesce(rw, 0) as rewet_15 from yr left join sy on yr.cell_id = sy.cell_id and yr.year = sy.year)"""
_METRICS = {"ftc": "tm", "fdd": "tm", "drydays": "rm", "r10mm": "rm", "r20mm": "rm"}
_NORMALS = "nm as (" + " union all ".join(f"select cell_id, '{m}' as metric, avg(v) as mu, stddev_samp(v) as sd from (select cell_id, year, cast(sum({m}) as double) as v from {t} where year between {FIRST} and {LAST} group by 1, 2) group by 1" for m, t in _METRICS.items()) + ")"
_FRAME = """ce as (select least((select last_day(max(make_date(year, month, 1))) from tm), (select last_day(max(make_date(year, month, 1))) from rm)) as ceiling),
    fr as (select a.asset_id, a.t_anchor, a.asset_start_date, c.cell_id, c.fallback_temp or c.fallback_rain as fallback, case when t_anchor is not null then least(t_anchor, ceiling) end as t_eff from si_anchor a left join si_cell_map c on a.asset_id = c.asset_id cross join ce)"""
_DAYS = {"2y": 730, "5y": 1826, "15y": 5478, "30y": 10957}


def _windows_sql() -> str:
    parts = []
    for w, days in _DAYS.items():
        parts.append(f"select asset_id, cell_id, '{w}' as w, {days} as days, t_eff, case when t_eff is not null then greatest(t_eff - {days}, asset_start_date, date '1960-01-01') end as flo from fr")
    return "wi as (select *, (t_eff - flo) / 365.25 as yrs, (t_eff - flo) / 365.25 < days / 365.25 as truncated, year(flo) * 12 + month(flo) - 1 + cast(date_trunc('month', flo) <> flo as int) as fm, year(t_eff) * 12 + month(t_eff) - 2 as lm, year(flo) + cast(date_trunc('year', flo) <> flo as int) as fy, year(t_eff) - 1 as ly from (" + " union all ".join(parts) + "))"


_ALL = oracle("si_anchor", "si_cell_map", "si_rain", "si_temp") + ", " + ", ".join([_TEMP, _RAIN, _SPELLS, _ANNUAL, _NORMALS, _FRAME, _windows_sql()])


def _climate_sql() -> str:
    text, names, picks = _ALL, [], ["a.asset_id"]
    joins = ""
    for t in ("tm", "rm"):
        ms = [m for m, x in _METRICS.items() if x == t]
        text += f", mo_{t} as (select wi.asset_id, wi.w, " + ", ".join(f"sum({m}) as {m}" for m in ms) + f" from wi join {t} on wi.cell_id = {t}.cell_id and year * 12 + month - 1 between fm and lm group by 1, 2)"
        text += f", ya_{t} as (select cell_id, year, " + ", ".join(f"sum({m}) as {m}" for m in ms) + f" from {t} group by 1, 2)"
        text += f", ye_{t} as (select wi.asset_id, wi.w, " + ", ".join(f"max({m}) as {m}" for m in ms) + f" from wi join ya_{t} y on wi.cell_id = y.cell_id and year between fy and ly group by 1, 2)"
        joins += f" left join mo_{t} on mo_{t}.asset_id = wi.asset_id and mo_{t}.w = wi.w left join ye_{t} on ye_{t}.asset_id = wi.asset_id and ye_{t}.w = wi.w"
    annual = [*((m, s) for m in ("dryspell_max", "rain_max_day") for s in ("mean", "max")), *((m, s) for m in ("dryspell_count_10", "dryspell_count_15", "dryspell_count_21", "rewet_15") for s in ("sum", "mean", "max"))]
    text += ", ay as (select wi.asset_id, wi.w, " + ", ".join(f"{dict(mean='avg').get(s, s)}({m}) as {m}__{s}" for m, s in annual) + " from wi join an on wi.cell_id = an.cell_id and year between fy and ly group by 1, 2)"
    joins += " left join ay on ay.asset_id = wi.asset_id and ay.w = wi.w"
    cols = []
    for m, t in _METRICS.items():
        joins += f" left join nm n_{m} on n_{m}.cell_id = wi.cell_id and n_{m}.metric = '{m}'"
        rate = f"case when yrs > 0 then mo_{t}.{m} / yrs end"
        cols += [(f"{m}__count", f"cast(mo_{t}.{m} as double)"), (f"{m}__rate", rate), (f"{m}__max_in_year", f"cast(ye_{t}.{m} as double)"), (f"{m}__z", f"case when n_{m}.sd > 0 then ({rate} - n_{m}.mu) / n_{m}.sd end")]
    cols += [(f"{m}__{s}", f"cast(ay.{m}__{s} as double)") for m, s in annual]
    text += ", lo as (select wi.asset_id, wi.w, truncated, " + ", ".join(f"{e} as {n}" for n, e in cols) + " from wi" + joins + ")"
    for w in _DAYS:
        for n, _ in cols:
            picks.append(f"round(max({n}) filter (w = '{w}'), 5) as climate__{n.replace('__', f'__{w}__', 1)}")
        picks.append(f"bool_or(truncated) filter (w = '{w}') as climate__{w}__window_truncated")
    return text + " select " + ", ".join(picks) + ", any_value(fallback) as climate__oncoast_fallback, any_value(cast(t_anchor - t_eff as int)) as climate__ceiling_lag_days from fr a join lo on lo.asset_id = a.asset_id group by a.asset_id"


def _rain(spark, d):
    return standin(spark, d, "si_rain")


def _parts(spark: SparkSession, d: str):
    temp, rain = stored(series.temp_monthly(standin(spark, d, "si_temp")), "monthly"), stored(series.rain_monthly(_rain(spark, d)), "monthly")  # read many times
    cells = standin(spark, d, "si_cell_map").select("asset_id", F.col("cell_id").alias("cell_id_temp"), F.col("cell_id").alias("cell_id_rain"), "fallback_temp", "fallback_rain")
    frame = series.anchor_frame(standin(spark, d, "si_anchor"), cells, series.data_ceiling(temp, rain))
    return temp, rain, frame


@query(oracle("si_temp") + ", " + _TEMP + " select cell_id, year, month, ftc, round(fdd, 6) as fdd from tm")
def f_temp_monthly(spark: SparkSession, d: str) -> DataFrame:
    return rounded(series.temp_monthly(standin(spark, d, "si_temp")))


@query(oracle("si_rain") + ", " + _RAIN + " select * from rm")
def f_rain_monthly(spark: SparkSession, d: str) -> DataFrame:
    return series.rain_monthly(_rain(spark, d))


@query(oracle("si_rain") + ", " + _SPELLS + " select * from sp")
def f_spells(spark: SparkSession, d: str) -> DataFrame:
    return series.spells(_rain(spark, d))


@query(oracle("si_rain") + ", " + _SPELLS + ", " + _ANNUAL + " select * replace (round(rain_max_day, 6) as rain_max_day) from an")
def f_rain_annual(spark: SparkSession, d: str) -> DataFrame:
    return rounded(series.rain_annual(_rain(spark, d)))


@query(oracle("si_rain") + ", k as (select cell_id, date from si_rain where (i + cell_id) % 97 > 1) select cell_id, date, previous from (select *, lag(date) over (partition by cell_id order by date) as previous from k) where date - previous <> 1")
def f_series_gaps(spark: SparkSession, d: str) -> DataFrame:
    """The gaps of series that lack two days in 97."""
    return series.series_gaps(_rain(spark, d).filter("(i + cell_id) % 97 > 1"))


@query(oracle("si_rain", "si_temp") + ", " + ", ".join([_TEMP, _RAIN, _NORMALS]) + " select cell_id, metric, round(mu, 6) as mu, round(sd, 6) as sd from nm where metric in ('drydays', 'r10mm', 'r20mm')")
def f_normals(spark: SparkSession, d: str) -> DataFrame:
    return rounded(series.normals(series.rain_monthly(_rain(spark, d)), ["drydays", "r10mm", "r20mm"], FIRST, LAST))


@query(oracle("si_rain", "si_temp") + ", " + ", ".join([_TEMP, _RAIN]) + " select least((select last_day(max(make_date(year, month, 1))) from tm), (select last_day(max(make_date(year, month, 1))) from rm)) as ceiling")
def data_ceiling(spark: SparkSession, d: str) -> DataFrame:
    return series.data_ceiling(series.temp_monthly(standin(spark, d, "si_temp")), series.rain_monthly(_rain(spark, d)))


@query(_ALL + " select asset_id, t_eff, cast(t_anchor - t_eff as int) as climate__ceiling_lag_days, fallback as climate__oncoast_fallback from fr")
def anchor_frame(spark: SparkSession, d: str) -> DataFrame:
    return _parts(spark, d)[2].select("asset_id", "t_eff", "climate__ceiling_lag_days", "climate__oncoast_fallback")


@query(_ALL + ' select asset_id, w as "window", flo as obs_floor, round(yrs, 6) as obs_years, truncated, fm as first_month, lm as last_month, fy as first_year, ly as last_year from wi')
def period_bounds(spark: SparkSession, d: str) -> DataFrame:
    rows = series.window_rows(_parts(spark, d)[2])
    return rounded(rows.select("asset_id", "window", "obs_floor", "obs_years", "truncated", *[F.col(c).cast("long").alias(c) for c in ("first_month", "last_month", "first_year", "last_year")]))


@query(_ALL + ' select wi.asset_id, w as "window", cast(sum(drydays) as double) as drydays__sum, round(avg(drydays), 6) as drydays__mean, cast(max(drydays) as double) as drydays__max from wi left join rm on wi.cell_id = rm.cell_id and year * 12 + month - 1 between fm and lm group by 1, 2')
def clipped_window_agg(spark: SparkSession, d: str) -> DataFrame:
    _, rain, frame = _parts(spark, d)
    monthly = rain.withColumn("ordinal", F.col("year") * 12 + F.col("month") - 1)
    return rounded(series.clipped_window_agg(series.window_rows(frame), monthly, "cell_id_rain", "first_month", "last_month", "ordinal", ["drydays"], ["asset_id", "window"]))


@query(_climate_sql())
def f_climate_features(spark: SparkSession, d: str) -> DataFrame:
    temp, rain, frame = _parts(spark, d)
    normal = series.normals(temp, ["ftc", "fdd"], FIRST, LAST).withColumn("group", F.lit("temp")).unionByName(series.normals(rain, ["drydays", "r10mm", "r20mm"], FIRST, LAST).withColumn("group", F.lit("rain")))
    return rounded(series.climate_features(frame, temp, rain, stored(series.rain_annual(_rain(spark, d)), "annual"), normal), digits=5)


@query(oracle("si_rain") + ", n as (select year(date) as year, count(*) as n_rows from si_rain where not (cell_id = 1 and i = 700) group by 1) select year, n_rows, (select count(distinct cell_id) from si_rain) * dayofyear(make_date(year, 12, 31)) as expected, n_rows = (select count(distinct cell_id) from si_rain) * dayofyear(make_date(year, 12, 31)) or year = 2001 as complete from n")
def calendar_completeness(spark: SparkSession, d: str) -> DataFrame:
    return series.calendar_completeness(_rain(spark, d).filter("not (cell_id = 1 and i = 700)")).withColumn("year", F.col("year").cast("long"))


@query(oracle("si_rain") + " select cell_id, date, round(value, 6) as value from si_rain")
def load_daily(spark: SparkSession, d: str) -> DataFrame:
    return rounded(series.load_daily(_rain(spark, d)).select("cell_id", "date", "value"))


_CELLS = oracle("si_rain") + " select cell_id + 100 as cell_id, date, round(value, 6) as value from si_rain"


@query(_CELLS)
def sample_cells(spark: SparkSession, d: str) -> DataFrame:
    """Every cell's series."""
    raster = _rain(spark, d).select(F.lit(0).alias("iy"), F.col("cell_id").alias("ix"), "date", "value")
    cells = standin(spark, d, "si_cell").select((F.col("cell_id") + 100).alias("cell_id"), F.lit(0).alias("iy"), F.col("cell_id").alias("ix"))
    return rounded(series.sample_cells(raster, cells))




@query("select distinct m as month from (select cast(unnest(generate_series(timestamp '1994-11-01', timestamp '2002-02-01', interval 1 month)) as date) as m) where m not in (select date_trunc('month', o_orderdate) from orders where o_orderkey % 5 <> 0 and month(o_orderdate) <> 7)")
def plan_missing_months(spark: SparkSession, d: str) -> DataFrame:
    have = spark.read.parquet(f"{d}/orders.parquet").filter("o_orderkey % 5 <> 0 and month(o_orderdate) <> 7").select(F.col("o_orderdate").cast("date").alias("date"))
    return series.plan_missing_months(have, "1994-11-01", "2002-02-01")
