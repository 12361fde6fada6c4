"""Queries of the line and terrain operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewall.operators import lines
from tidewall.plans.q_spatial import lines as line_table
from tidewall.plans.registry import query, rounded
from tidewall.plans.standins import oracle, standin


def _px(m: str) -> str:
    return f"case when {m} <= 50 then x + ({m}) * 0.6 when {m} <= 110 then x + 30 else x + 30 + ({m} - 110) * 0.6 end"


def _py(m: str) -> str:
    return f"case when {m} <= 50 then y + ({m}) * 0.8 when {m} <= 110 then y + 40 + ({m} - 50) else y + 100 + ({m} - 110) * 0.8 end"


_B, _A = "greatest(0.0, chainage - 2.5)", "least(210.0, chainage + 2.5)"
_ST = oracle("si_asset") + f""", c as (select asset_id, x, y, unnest(range(0, 42)) * 5.0::double as chainage from si_asset), q as (select asset_id, chainage, {_px('chainage')} as px, {_py('chainage')} as py, {_px(_A)} - ({_px(_B)}) as dx, {_py(_A)} - ({_py(_B)}) as dy from c),
    st as (select asset_id, chainage, px as x, py as y, -dy / sqrt(dx * dx + dy * dy) as nx, dx / sqrt(dx * dx + dy * dy) as ny from q)"""


def _lines(spark: SparkSession, d: str) -> DataFrame:
    return line_table(spark, d).select("asset_id", lines.longest_line(F.col("parts")).alias("line"))


@query(oracle("si_asset") + " select asset_id, 4 as n_points, round(x, 6) as first_x, round(y + 180, 6) as last_y from si_asset")
def longest_line(spark: SparkSession, d: str) -> DataFrame:
    line = F.col("line")
    return rounded(_lines(spark, d).select("asset_id", F.size(line).alias("n_points"), line[0]["x"].alias("first_x"), F.element_at(line, -1)["y"].alias("last_y")))


@query(_ST + " select asset_id, chainage, round(x, 5) as x, round(y, 5) as y, round(nx, 5) as nx, round(ny, 5) as ny from st")
def stations(spark: SparkSession, d: str) -> DataFrame:
    return rounded(lines.stations(_lines(spark, d), "asset_id"), digits=5)


_TRANSECTS = (
    _ST + """, o as (select asset_id, chainage, k, floor((x + k * nx) / 7 + 0.0001) as c, floor((y + k * ny) / 7 + 0.0001) as r from st cross join (select unnest(range(-4, 5)) as k))
    select asset_id, chainage, cast(sum(coalesce(case when (r * 3 + c * 5) % 11 <> 0 then (r * 7 + c * 13) % 97 end, 0) * (k + 5)) as bigint) as mark, count(case when (r * 3 + c * 5) % 11 <> 0 then 1 end) as n_known from o group by 1, 2"""
)


@query(_TRANSECTS)
def sample_transects(spark: SparkSession, d: str) -> DataFrame:
    """Nine samples 1 m apart across every line's stations, of a made raster of 7 m cells, with unknown cells."""
    points = lines.stations(_lines(spark, d), "asset_id").withColumns({"x": F.col("x") + 0.0007, "y": F.col("y") + 0.0007})
    cells = lines.transect_runs(points, 4, 7.0).select("row", "col").distinct()
    raster = cells.withColumn("value", F.when((F.col("row") * 3 + F.col("col") * 5) % 11 != 0, (F.col("row") * 7 + F.col("col") * 13) % 97).cast("double"))
    out = lines.sample_transects(points, raster, "asset_id", half=4, cell=7.0)
    mark = F.aggregate(F.transform("profile", lambda v, i: F.coalesce(v, F.lit(0.0)) * (i + 1)), F.lit(0.0), lambda a, v: a + v)
    return out.select("asset_id", "chainage", mark.cast("long").alias("mark"), F.size(F.array_compact("profile")).cast("long").alias("n_known"))




_CRESTS = oracle("si_station", "si_asset") + """, p0 as (select station, asset_id, chainage, tier, list_transform(embedding, lambda v: v::double * 10) as raw from si_station),
    p1 as (select *, list_transform(raw, lambda v: coalesce(v, list_min(raw))) as f from p0),
    p2 as (select *, list_transform(range(1, len(f) + 1), lambda i: (f[i] + coalesce(case when i > 1 then f[i - 1] end, 0.0) + coalesce(f[i + 1], 0.0)) / 3) as s from p1),
    p3 as (select *, len(s) as n, list_position(s[23:43], list_max(s[23:43])) - 1 + 22 as c from p2),
    p4 as (select *, coalesce(list_min(list_filter(range(1, c), lambda k: raw[c - k + 1] is null or s[c - k + 1] > s[c - k + 2] + 0.02)), c) as l, coalesce(list_min(list_filter(range(1, n - c), lambda k: raw[c + k + 1] is null or s[c + k + 1] > s[c + k] + 0.02)), n - c) as r from p3 where list_max(raw) is not null and raw[c + 1] is not null),
    p5 as (select station, asset_id, chainage, tier, (c - 32)::double as crest_off, raw[c + 1] as crest_z, raw[c - (l - 1) + 1] as toe_l_z, raw[c + (r - 1) + 1] as toe_r_z, ((c + (r - 1)) - (c - (l - 1)))::double as footprint_width from p4),
    cr as (select *, crest_z - greatest(toe_l_z, toe_r_z) as prominence, crest_z - (toe_l_z + toe_r_z) / 2 as relheight from p5)"""
_WEIGHTS = ", ".join(f"({w}, {i}, {j}, {x!r}::double)" for w in (5, 7, 9, 11) for i, row in enumerate(lines.smoothing_weights(w)) for j, x in enumerate(row))


def _detrended(source: str) -> str:
    """Clauses up to dt: rows of `source` with their smooth and residual."""
    return f""", wt as (select * from (values {_WEIGHTS}) t(w, place, j, weight)),
    d0 as (select asset_id, chainage, crest_z, row_number() over (partition by asset_id order by chainage) - 1 as i, count(*) over (partition by asset_id) as n from {source}),
    d1 as (select *, case when n >= 5 then least(11, n - 1 + n % 2) end as w from d0), d2 as (select *, greatest(0, least(i - w // 2, n - w)) as f from d1),
    d3 as (select a.asset_id, a.chainage, sum(b.crest_z * weight) as trend from d2 a join d2 b on a.asset_id = b.asset_id and b.i between a.f and a.f + a.w - 1 join wt on wt.w = a.w and wt.place = a.i - a.f and wt.j = b.i - a.f group by 1, 2),
    dt as (select d0.asset_id, d0.chainage, d0.crest_z, trend, crest_z - trend as residual from d0 left join d3 using (asset_id, chainage))"""


def _crests(spark: SparkSession, d: str) -> DataFrame:
    df = standin(spark, d, "si_station").withColumn("profile", F.transform("embedding", lambda v: v * F.lit(10.0)))
    return lines.crest_toes(df, centre=32).drop("embedding", "profile")


@query(_CRESTS + " select station, asset_id, chainage, tier, crest_off, round(crest_z, 6) as crest_z, round(toe_l_z, 6) as toe_l_z, round(toe_r_z, 6) as toe_r_z, round(prominence, 6) as prominence, round(relheight, 6) as relheight, footprint_width from cr")
def g_crest_toes(spark: SparkSession, d: str) -> DataFrame:
    """Crest and toes of every station."""
    return rounded(_crests(spark, d))


@query(_CRESTS + _detrended("cr") + " select asset_id, chainage, round(crest_z, 6) as crest_z, round(trend, 6) as trend, round(residual, 6) as residual from dt")
def g_detrend(spark: SparkSession, d: str) -> DataFrame:
    """Crest heights less their smooth."""
    return rounded(lines.detrend(_crests(spark, d).select("asset_id", "chainage", "crest_z"), "asset_id", "chainage", "crest_z"))


@query(
    _CRESTS + ", en as (select cr.* from cr join (select asset_id from si_station group by 1 having count(*) >= 3 and max(chainage) - min(chainage) >= 15) using (asset_id))" + _detrended("en")
    + """, d5 as (select *, lag(residual) over (partition by asset_id order by chainage) as back from dt where residual is not null),
    rs as (select asset_id, stddev_pop(residual) as sd, -min(residual) as dip, corr(back, residual) as c, sum(abs(residual - back)) as tv, max(residual) - min(residual) as span from d5 group by 1),
    su as (select asset_id, arg_min(tier, chainage) as tier, count(*) as n_stations, median(abs(crest_off)) as crest_offset_median, median(prominence) as crest_prominence_median, avg(relheight) as rm, min(relheight) as rn, stddev_pop(relheight) as rd, avg(footprint_width) as wm from en group by 1),
    fe as (select su.*, rs.*, tier in ('engineered_raised', 'natural_geomorphic') and crest_prominence_median >= 0.25 and n_stations >= 5 as ok from su left join rs using (asset_id))
    select a.asset_id, tier, coalesce(n_stations, 0) as n_stations, round(crest_offset_median, 6) as crest_offset_median, round(crest_prominence_median, 6) as crest_prominence_median, coalesce(ok, false) as crest_found,
      round(case when ok then rm end, 6) as crest_relheight_mean, round(case when ok then rn end, 6) as crest_relheight_min, round(case when ok then rd end, 6) as crest_relheight_std, round(case when ok then wm end, 6) as crest_width_mean,
      round(case when ok then sd end, 6) as crest_resid_std, round(case when ok then dip end, 6) as crest_resid_max_dip, round(case when ok and sd >= 0.05 then c end, 6) as crest_resid_ac1, round(case when ok and sd >= 0.05 and span > 0 then tv / span end, 6) as crest_resid_tv_range
    from si_asset a left join fe on fe.asset_id = a.asset_id"""
)
def g_line_features(spark: SparkSession, d: str) -> DataFrame:
    """One summary per asset."""
    return rounded(lines.line_features(lines.enough_stations(_crests(spark, d), "asset_id"), standin(spark, d, "si_asset")))


@query(_CRESTS + " select tier, count(*) as n, round(avg((abs(crest_off) >= 10)::int), 6) as pinned, round(avg((prominence < 0.25)::int), 6) as below_floor, round(quantile_cont(prominence, 0.25), 6) as q25, round(quantile_cont(prominence, 0.5), 6) as q50, round(quantile_cont(prominence, 0.75), 6) as q75 from cr group by 1")
def station_qc(spark: SparkSession, d: str) -> DataFrame:
    """Quality shares and quartiles by tier."""
    return rounded(lines.station_qc(_crests(spark, d)))
