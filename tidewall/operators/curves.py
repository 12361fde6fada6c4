"""Scores against deterioration curves: the age at which an asset reaches each grade, read piecewise linearly."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Sub-type -> (curve type, material, width, environment if the curve has only one).
SUB_TYPES = {
    "Embankment": ("embankment", "varying_core", "narrow", None),
    "Engineered High Ground": ("embankment", "varying_core", "narrow", None),
    "Natural High Ground": ("embankment", "varying_core", "narrow", None),
    "Wall": ("vertical_wall", "concrete_masonry", "na", None),
    "Flood Gate": ("flood_gate", "metal", "na", None),
    "Demountable Defence": ("demountable_defence", "metal", "na", "fluvial"),
    "Beach": ("beach", "shingle/sand", "na", "coastal"),
    "Barrier Beach": ("beach", "shingle/sand", "na", "coastal"),
    "Dunes": ("dunes", "na", "na", "coastal"),
    "Weir": ("weir", "all", "na", "fluvial"),
}
# Protection type -> environment.
ENVIRONMENTS = {"Fluvial": "fluvial", "Coastal": "coastal", "Tidal": "coastal", "Fluvial/Tidal": "coastal"}
KEY = ("halcrow_type", "environment", "material", "width")
CURVE_SCHEMA = "halcrow_type string, environment string, material string, width string, rate string, regime int, t1 double, t2 double, t3 double, t4 double, t5 double"

# Age in years at which grades 1 to 5 are reached. A line for each curve (type, environment,
# material, width), then one for each rate with its regimes 1, 2 and 3.
CURVES = """
embankment fluvial varying_core narrow
  slowest: 0 5 10 40 60, 0 20 40 70 110, 0 22 44 90 130
  medium: 0 3 6 25 40, 0 15 30 60 80, 0 16 33 70 90
  fastest: 0 1 3 5 7, 0 2 5 7 10, 0 3 6 8 11
embankment coastal varying_core narrow
  slowest: 0 5 10 40 60, 0 20 40 60 80, 0 22 45 80 110
  medium: 0 3 6 22 30, 0 14 28 40 50, 0 15 30 45 60
  fastest: 0 1 2 4 5, 0 2 4 6 8, 0 3 5 8 10
vertical_wall fluvial concrete_masonry na
  slowest: 0 20 50 70 80, 0 25 60 100 120, 0 30 70 130 160
  medium: 0 15 35 50 60, 0 20 45 70 90, 0 25 55 90 120
  fastest: 0 5 20 30 40, 0 10 30 50 60, 0 15 40 70 80
vertical_wall coastal concrete_masonry na
  slowest: 0 15 45 60 80, 0 20 60 80 100, 0 25 75 100 120
  medium: 0 10 30 40 50, 0 15 40 55 70, 0 20 50 70 90
  fastest: 0 5 15 25 30, 0 10 20 30 40, 0 15 25 35 50
vertical_wall fluvial timber na
  slowest: 0 7 15 18 21, 0 15 30 35 40, 0 23 45 52 60
  medium: 0 5 10 12 15, 0 10 20 25 30, 0 15 30 35 42
  fastest: 0 3 5 7 10, 0 5 10 12 15, 0 7 15 17 20
vertical_wall coastal timber na
  slowest: 0 5 13 16 20, 0 14 28 33 38, 0 21 42 48 55
  medium: 0 4 8 10 14, 0 8 18 23 28, 0 13 28 33 38
  fastest: 0 2 4 6 8, 0 4 8 10 13, 0 5 13 15 18
flood_gate fluvial metal na
  slowest: 0 15 32 41 50, 0 20 40 50 60, 0 25 48 59 70
  medium: 0 12 25 32 38, 0 18 34 42 50, 0 24 43 52 62
  fastest: 0 5 12 16 20, 0 10 22 30 35, 0 15 32 44 50
flood_gate coastal metal na
  slowest: 0 13 22 26 30, 0 18 29 35 40, 0 23 36 44 50
  medium: 0 10 14 16 18, 0 15 23 27 30, 0 20 32 38 42
  fastest: 0 4 7 9 10, 0 7 11 13 15, 0 10 15 17 20
demountable_defence fluvial metal na
  slowest: 0 2 4 5 7, 0 10 20 60 70, 0 15 25 70 80
  medium: 0 1 3 4 5, 0 5 10 45 55, 0 8 15 55 65
  fastest: 0 1 2 3 4, 0 2 5 35 45, 0 5 10 45 55
demountable_defence fluvial wood na
  slowest: 0 2 4 5 7, 0 5 10 30 35, 0 8 13 35 40
  medium: 0 1 3 4 5, 0 3 5 23 28, 0 4 8 28 33
  fastest: 0 1 2 3 4, 0 1 3 18 23, 0 3 5 23 28
beach coastal shingle/sand na
  slowest: 0 15 38 75 100, 0 27 50 150 200, 0 27 75 200 250
  medium: 0 9 13 25 35, 0 16 30 50 75, 0 20 55 90 120
  fastest: 0 4 7 9 13, 0 7 10 13 20, 0 12 20 25 40
dunes coastal na na
  slowest: 0 20 40 110 150, 0 27 60 150 200, 0 30 80 190 250
  medium: 0 10 15 30 40, 0 15 35 60 80, 0 20 60 100 130
  fastest: 0 5 8 10 15, 0 7 10 13 20, 0 12 20 25 40
weir fluvial all na
  slowest: 0 20 30 50 70, 0 40 70 90 110, 0 60 110 130 150
  medium: 0 15 20 40 60, 0 30 50 70 90, 0 45 80 100 120
  fastest: 0 10 15 30 40, 0 20 30 50 60, 0 30 45 70 80
"""


def curve_rows(text: str = CURVES) -> list[tuple]:
    """A row of CURVE_SCHEMA for each curve, rate and regime of a text like CURVES."""
    rows, key = [], ()
    for line in text.strip().splitlines():
        rate, _, regimes = line.strip().partition(": ")
        if not regimes:
            key = tuple(line.split())
        for regime, years in enumerate(regimes.split(", ") if regimes else (), 1):
            rows.append((*key, rate, regime, *map(float, years.split())))
    return rows


def curve_table(spark: SparkSession, text: str = CURVES) -> DataFrame:
    """All curves (CURVE_SCHEMA)."""
    return spark.createDataFrame(curve_rows(text), CURVE_SCHEMA)


def _mapped(column: Column, values: Mapping[str, str | None]) -> Column:
    pairs = [F.lit(x) for k, v in values.items() if v is not None for x in (k, v)]
    return F.when(column.isNotNull(), F.try_element_at(F.create_map(*pairs), column))


def curve_key(sub_type: Column, protection_type: Column) -> dict[str, Column]:
    """The four key columns; the environment is the curve's own, else the protection type's, else fluvial."""
    part = lambda i: _mapped(sub_type, {k: v[i] for k, v in SUB_TYPES.items()})
    return {"halcrow_type": part(0), "environment": F.coalesce(part(3), _mapped(protection_type, ENVIRONMENTS), F.lit("fluvial")), "material": part(1), "width": part(2)}


def curve_score(assets: DataFrame, curves: DataFrame, rate: str = "medium", regime: int = 2) -> DataFrame:
    """asset_id, sub_type, curve_status, age_years, pred_grade_cont, pred_grade.

    assets needs sub_type, protection_type and age_years. Status, first that holds: unmapped_type, no_curve,
    no_age, scored. A band without width counts as not entered; grades are clipped to 1 to 5.
    """
    table = curves.filter((F.col("rate") == rate) & (F.col("regime") == regime)).drop("rate", "regime")
    df = assets.withColumns(curve_key(F.col("sub_type"), F.col("protection_type"))).join(F.broadcast(table), list(KEY), "left")
    age = F.col("age_years")
    into = lambda a, b: F.when(F.col(b) > F.col(a), (age - F.col(a)) / (F.col(b) - F.col(a))).otherwise(0.0)
    grade = F.when(age >= F.col("t5"), 5.0)
    for k in (4, 3, 2):
        grade = grade.when(age >= F.col(f"t{k}"), k + into(f"t{k}", f"t{k + 1}"))
    grade = F.greatest(F.lit(1.0), F.least(F.lit(5.0), grade.otherwise(1 + into("t1", "t2"))))
    status = F.when(F.col("halcrow_type").isNull(), "unmapped_type").when(F.col("t2").isNull(), "no_curve").when(age.isNull(), "no_age").otherwise("scored")
    df = df.withColumn("curve_status", status).withColumn("pred_grade_cont", F.when(F.col("curve_status") == "scored", grade))
    return df.select("asset_id", "sub_type", "curve_status", "age_years", "pred_grade_cont", F.floor("pred_grade_cont").cast("int").alias("pred_grade"))


def curve_coverage(scored: DataFrame) -> DataFrame:
    """(sub_type, curve_status, n, share of all rows to 4 digits)."""
    counts = scored.groupBy("sub_type", "curve_status").agg(F.count("*").alias("n"))
    total = scored.agg(F.count("*").alias("_all"))
    return counts.crossJoin(F.broadcast(total)).select("sub_type", "curve_status", "n", F.round(F.col("n") / F.col("_all"), 4).alias("share"))
