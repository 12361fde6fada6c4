"""Queries of the spatial operators, over L-shaped polygons at the suppliers' places and lines at the assets'."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewall.operators import corridors, spatial
from tidewall.plans.registry import query, rounded
from tidewall.plans.standins import oracle, standin
from tidewall.sources.shared import tasks_for

TILE = 10_000.0
#: Vertices of the L from its lower left corner, and of the hole that every fourth has; both grow with the outline's scale.
SHAPE = ((0, 0), (4000, 0), (4000, 1500), (3000, 1500), (3000, 4000), (0, 4000))
HOLE = ((500, 500), (1500, 500), (1500, 1000), (500, 1000))
LINE = ((0, 0), (30, 40), (30, 100), (90, 180))


def _point(x: Column, y: Column) -> Column:
    return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))


def polygons(spark: SparkSession, d: str) -> DataFrame:
    """An outline for each supplier: of three sizes, with or without a hole, many of them over one another."""
    df = standin(spark, d, "si_outline")
    ring = lambda shape: F.array(*[_point(F.col("x0") + a * F.col("k"), F.col("y0") + b * F.col("k")) for a, b in shape])
    return df.select("poly_id", F.when(F.col("holed"), F.array(ring(SHAPE), ring(HOLE))).otherwise(F.array(ring(SHAPE))).alias("parts"))


def lines(spark: SparkSession, d: str) -> DataFrame:
    """A line for each asset; assets are dealt before their lines are made, by the 42 stations that each line will have."""
    df = standin(spark, d, "si_asset").select("asset_id", "x", "y")
    df = df.repartition(tasks_for(df, 42), "asset_id")
    return df.select("asset_id", F.array(F.array(*[_point(F.col("x") + a, F.col("y") + b) for a, b in LINE[:3]]), F.array(*[_point(F.col("x") + a, F.col("y") + b) for a, b in LINE[2:]])).alias("parts"))


def _points(spark: SparkSession, d: str) -> DataFrame:
    return standin(spark, d, "si_asset").select("asset_id", "x", "y")


_HOLE = "holed and x >= x0 + 500 * k and x <= x0 + 1500 * k and y >= y0 + 500 * k and y <= y0 + 1000 * k"
_INSIDE = f"(x > x0 and x < x0 + 4000 * k and y > y0 and y < y0 + 1500 * k or x > x0 and x < x0 + 3000 * k and y > y0 and y < y0 + 4000 * k) and not ({_HOLE})"
_P = oracle("si_asset", "si_outline") + f", p as (select *, k * k * (case when holed then 13e6 else 135e5 end)::double as area from si_outline), w as (select asset_id, x, y, poly_id, p.area from si_asset join p on {_INSIDE})"


@query(_P + " select asset_id, x, y, poly_id from w")
def sjoin_within(spark: SparkSession, d: str) -> DataFrame:
    return spatial.sjoin_within(_points(spark, d), polygons(spark, d), TILE)


@query(_P + " select a.asset_id, poly_id from si_asset a left join w on w.asset_id = a.asset_id")
def sjoin_within_left(spark: SparkSession, d: str) -> DataFrame:
    return spatial.sjoin_within(_points(spark, d), polygons(spark, d), TILE, "left").select("asset_id", "poly_id")


@query(_P + ", r as (select *, row_number() over (partition by asset_id order by area, poly_id) as rn from w) select asset_id, poly_id, area from r where rn = 1")
def sjoin_smallest(spark: SparkSession, d: str) -> DataFrame:
    return spatial.sjoin_smallest(_points(spark, d), polygons(spark, d), TILE, "asset_id")


_RECT = "sqrt(greatest(x0 - x, 0, x - x0 - {0} * k) ** 2 + greatest(y0 - y, 0, y - y0 - {1} * k) ** 2)"


@query(
    _P + f", n as (select asset_id, poly_id, case when {_HOLE} then least(x - x0 - 500 * k, x0 + 1500 * k - x, y - y0 - 500 * k, y0 + 1000 * k - y) else least(" + _RECT.format(4000, 1500) + ", " + _RECT.format(3000, 4000) + ") end as dist from si_asset cross join p), "
    "r as (select *, row_number() over (partition by asset_id order by dist, poly_id) as rn from n) select asset_id, poly_id, round(dist, 6) as distance from r where rn = 1"
)
def sjoin_nearest(spark: SparkSession, d: str) -> DataFrame:
    return rounded(spatial.sjoin_nearest(_points(spark, d), polygons(spark, d), TILE / 4, "asset_id"))


@query(_P + " select poly_id, area, (16000 + case when holed then 3000 else 0 end) * k::double as length, round(x0 + k * case when holed then 22750 / 13.0 else 23250 / 13.5 end, 6) as cx, round(y0 + k * case when holed then 24750 / 13.0 else 25125 / 13.5 end, 6) as cy from p")
def polygon_measures(spark: SparkSession, d: str) -> DataFrame:
    parts = F.col("parts")
    c = spatial.polygon_centroid(parts)
    closed = F.transform(parts, lambda r: F.concat(r, F.slice(r, 1, 1)))
    return rounded(polygons(spark, d).select("poly_id", spatial.area(parts).alias("area"), spatial.length(closed).alias("length"), c["x"].alias("cx"), c["y"].alias("cy")))


@query(oracle("si_asset") + " select asset_id, 210.0::double as length, round(x + (50 * 15 + 60 * 30 + 100 * 60) / 210, 6) as cx, round(y + (50 * 20 + 60 * 70 + 100 * 140) / 210, 6) as cy from si_asset")
def line_measures(spark: SparkSession, d: str) -> DataFrame:
    c = spatial.line_centroid(F.col("parts"))
    return rounded(lines(spark, d).select("asset_id", spatial.length(F.col("parts")).alias("length"), c["x"].alias("cx"), c["y"].alias("cy")))


@query(oracle("si_asset") + ", b as (select asset_id, x - 30 as x0, y - 30 as y0, x + 90 + asset_id % 40 * 100 + 30 as x1, y + 180 + 30 as y1 from si_asset) select *, cast(ceil(x1 - x0) as int) as width, cast(ceil(y1 - y0) as int) as height, x1 - x0 > 3000 or y1 - y0 > 3000 as oversize from b")
def plan_tiles(spark: SparkSession, d: str) -> DataFrame:
    df = standin(spark, d, "si_asset").select("asset_id", F.col("x").alias("xmin"), F.col("y").alias("ymin"), (F.col("x") + 90 + F.col("asset_id") % 40 * 100).alias("xmax"), (F.col("y") + 180).alias("ymax"))
    return spatial.plan_tiles(df).drop("xmin", "ymin", "xmax", "ymax")


def _ways(spark: SparkSession, d: str) -> DataFrame:
    """Assets of a known sub-type as lines of 200 m in two parts, eastward or northward by turns."""
    df = standin(spark, d, "si_asset").filter("sub_type is not null")
    east = F.col("asset_id") % 2 == 0
    spot = lambda a: _point(F.col("x") + F.when(east, a).otherwise(0), F.col("y") + F.when(east, 0).otherwise(a))
    return df.select("asset_id", "sub_type", F.array(F.array(spot(0), spot(70), spot(120)), F.array(spot(120), spot(200))).alias("parts"))


def _corner(u: str, v: str) -> str:
    """Area of the circle about the origin with radius d that lies beyond u on one axis and v on the other."""
    g = lambda x: f"(({x}) * sqrt(greatest(0, d * d - ({x}) * ({x}))) + d * d * asin(greatest(-1, least(1, ({x}) / d)))) / 2"
    w = f"least(abs({v}), d)"
    far = f"sqrt(d * d - {w} * {w})"
    at = f"greatest(-{far}, least({far}, {u}))"
    half = f"({g(far)} - {g(at)} - {w} * ({far} - {at}))"
    return f"(case when {v} >= 0 then {half} else 2 * ({g('d')} - {g(f'greatest(-d, least(d, {u}))')}) - {half} end)"


# A corridor's area in an outline: sums over the corners of its rectangles of the areas beyond each, of a rectangle and two half circles.
_AREAS = (
    oracle("si_asset", "si_outline") + """, c as (select asset_id, sub_type, asset_id % 2 = 0 as east, x, y, case when sub_type in ('Wall', 'Quay', 'Demountable Defence', 'Flood Gate', 'Weir') then 5.0 else 20.0 end::double as d,
      case when sub_type in ('Flood Gate', 'Weir') then 100 else 0 end as first, case when sub_type in ('Flood Gate', 'Weir') then 100 else 200 end as last from si_asset where sub_type is not null),
    o as (select poly_id, x0, y0, k, unnest([{'x': 0, 'y': 0, 's': 1}, {'x': 4000, 'y': 0, 's': -1}, {'x': 0, 'y': 1500, 's': -1}, {'x': 4000, 'y': 1500, 's': 1}, {'x': 0, 'y': 1500, 's': 1}, {'x': 3000, 'y': 1500, 's': -1}, {'x': 0, 'y': 4000, 's': -1}, {'x': 3000, 'y': 4000, 's': 1}]
      || case when holed then [{'x': 500, 'y': 500, 's': -1}, {'x': 1500, 'y': 500, 's': 1}, {'x': 500, 'y': 1000, 's': 1}, {'x': 1500, 'y': 1000, 's': -1}] else [] end) as v from si_outline),
    q as (select asset_id, poly_id, d, first, last, v.s as s, (case when east then x0 + k * v.x - x else y0 + k * v.y - y end)::double as u, (case when east then y0 + k * v.y - y else x0 + k * v.x - x end)::double as w
      from c join o on x + 220 >= x0 and x - 20 <= x0 + 4000 * k and y + 220 >= y0 and y - 20 <= y0 + 4000 * k),
    i as (select asset_id, poly_id, sum(s * (greatest(0, last - greatest(u, first)) * greatest(0, d - greatest(w, -d)) + """
    + f"{_corner('(u - first)', 'w')} - {_corner('greatest(u - first, 0)', 'w')} + {_corner('greatest(u - last, 0)', 'w')})) as area from q group by 1, 2 having area > 1e-6)"
)


@query(_AREAS + " select asset_id, poly_id, round(area, 6) as area from i")
def sjoin_intersect_area(spark: SparkSession, d: str) -> DataFrame:
    """Every asset's corridor, by the regime of its sub-type, inside every outline."""
    return rounded(corridors.intersect_areas(corridors.build_corridors(_ways(spark, d)), polygons(spark, d), "asset_id", TILE / 4))


@query()
def corridor_areas_bent(spark: SparkSession, d: str) -> DataFrame:
    """Corridors of 20 m along every asset's bent line inside every outline; tested against fine slices."""
    return rounded(corridors.intersect_areas(lines(spark, d).withColumn("distance", F.lit(20.0)), polygons(spark, d), "asset_id", TILE / 4))


@query(
    _AREAS + """ select poly_id, asset_id, round(area, 6) as intersected_area_m2, cast(poly_id as varchar) as rec_out_id, case when poly_id % 5 <> 0 then cast(poly_id % 7 as varchar) end as rec_grp_id,
    date '1995-01-01' + cast(poly_id * 80 as int) as start_date, date '1995-01-03' + cast(poly_id * 80 as int) as end_date, case when poly_id % 2 = 0 then 'river' else 'sea' end as flood_src from i"""
)
def exposure_events(spark: SparkSession, d: str) -> DataFrame:
    """Every asset's events: outlines that share area with its corridor, with group ids and both dates."""
    day = lambda text: F.date_add(F.lit(text).cast("date"), (F.col("poly_id") * 80).cast("int"))
    attributes = {"rec_out_id": F.col("poly_id").cast("double"), "rec_grp_id": F.when(F.col("poly_id") % 5 != 0, (F.col("poly_id") % 7).cast("double")), "start_date": day("1995-01-01"), "end_date": day("1995-01-03"), "flood_src": F.when(F.col("poly_id") % 2 == 0, "river").otherwise("sea")}
    return rounded(corridors.exposure_events(_ways(spark, d), polygons(spark, d).withColumns(attributes), "asset_id", TILE / 4))


def bng_to_wgs84(spark: SparkSession, d: str) -> DataFrame:
    """Assets' places as longitude and latitude; tested on published points."""
    df = standin(spark, d, "si_asset").select("asset_id", (F.col("x") + 400000).alias("e"), (F.col("y") + 200000).alias("n"))
    return rounded(spatial.bng_to_wgs84(df, "e", "n").drop("e", "n"), digits=7)


query()(bng_to_wgs84)
