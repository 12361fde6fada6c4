"""Copies of places, corridors and outlines: tested once, and every copy has its rows."""

import pytest

from tests.test_oracles import DATA, pytestmark  # noqa: F401
from tidewall.operators import corridors, lines, spatial
from tidewall.plans.catalogue import QUERIES

SQUARE, TRIANGLE = [[(0.0, 0.0), (10.0, 0.0), (10.0, 10.0), (0.0, 10.0)]], [[(0.0, 0.0), (4.0, 0.0), (0.0, 4.0)]]
POLYGONS = "poly_id long, parts array<array<struct<x:double,y:double>>>"


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def tables(spark):
    """Points 0 to 29 inside both outlines, on an edge of the square, and away, ten at a place; 30 without a place."""
    spots = [(1.0, 1.0), (10.0, 5.0), (13.0, 14.0)]
    points = spark.createDataFrame([*[(i, *spots[i // 10]) for i in range(30)], (30, None, 1.0)], "k long, x double, y double")
    polygons = spark.createDataFrame([*[(i, SQUARE) for i in (9, 5, 7)], *[(i, TRIANGLE) for i in (8, 6)], (1, None)], POLYGONS)
    return points, polygons


@pytest.mark.parametrize("how", ["inner", "left"])
def test_within_tests_a_place_and_an_outline_once(tables, how):
    points, polygons = tables
    df = spatial.sjoin_within(points, polygons, 5.0, how)
    assert "keys=[parts" in _plan(df) and "keys=[x" in _plan(df)
    want = [(k, p) for k in range(10) for p in (5, 6, 7, 8, 9)] + [(k, None) for k in range(10, 31) if how == "left"]
    assert sorted((r.k, r.poly_id) for r in df.collect()) == want


def test_smallest_ranks_a_place_once(tables):
    points, polygons = tables
    df = spatial.sjoin_smallest(points, polygons, 5.0, "k")
    assert "keys=[parts" in _plan(df) and "keys=[x" in _plan(df)
    assert sorted(tuple(r) for r in df.collect()) == [(k, 6, 8.0) for k in range(10)]


def test_nearest_stores_a_place_once(tables, monkeypatch):
    points, polygons = tables
    sizes, keep = [], spatial.stored
    monkeypatch.setattr(spatial, "stored", lambda df, label: sizes.append(keep(df, label).count()) or keep(df, label))
    got = sorted(tuple(r) for r in spatial.sjoin_nearest(points, polygons, 2.0, "k").collect())
    assert max(sizes) <= 3
    assert got == [*[(k, 5, 0.0) for k in range(20)], *[(k, 5, 5.0) for k in range(20, 30)], (30, None, None)]


def test_nearest_of_an_outline_that_is_one_point(spark):
    points = spark.createDataFrame([(0, 1.0, 1.0), (1, 50.0, 50.0)], "k long, x double, y double")
    polygons = spark.createDataFrame([(5, SQUARE), (3, [[(1.0, 1.0)]])], POLYGONS)
    assert sorted((r.k, r.poly_id, round(r.distance, 6)) for r in spatial.sjoin_nearest(points, polygons, 2.0, "k").collect()) == [(0, 3, 0.0), (1, 5, 56.568542)]


def test_areas_are_of_distinct_corridors_and_outlines(spark):
    line = [[(-5.0, 5.0), (5.0, 5.0)]]
    ways = spark.createDataFrame([(k, 1.0, line) for k in range(6)] + [(6, 2.0, line)], "k long, distance double, parts array<array<struct<x:double,y:double>>>")
    outlines = spark.createDataFrame([(i, SQUARE) for i in (9, 5, 7)], POLYGONS)
    df = corridors.intersect_areas(ways, outlines, "k", 5.0)
    assert "keys=[distance" in _plan(df) and "keys=[parts" in _plan(df)
    want = [(k, p, round(10 * d + 3.141592653589793 * d * d / 2, 6)) for k, d in [*[(k, 1.0) for k in range(6)], (6, 2.0)] for p in (5, 7, 9)]
    assert sorted((r.k, r.poly_id, round(r.area, 6)) for r in df.collect()) == want


def test_tiles_of_outlines_are_not_broadcast(spark):
    plan = _plan(QUERIES["exposure_events"](spark, DATA))
    assert "SortMergeJoin [tx" in plan and "BroadcastHashJoin [tx" not in plan


def test_transects_are_not_broadcast_and_join_by_runs(spark):
    plan = _plan(QUERIES["sample_transects"](spark, DATA))
    assert "SortMergeJoin [row" in plan and "BroadcastHashJoin [row" not in plan
    points = spark.createDataFrame([(1, 0.0, 1.0, 3.5, 0.0, 1.0), (1, 5.0, 1.0, 3.5, None, None)], "k long, chainage double, x double, y double, nx double, ny double")
    assert lines.transect_runs(points, 4, 7.0).filter("chainage = 0").select("start", "row", "col").sort("start").collect() == [(-4, -1, 0), (-3, 0, 0), (4, 1, 0)]
    raster = spark.createDataFrame([(0, 0, 2.0), (1, 0, 3.0)], "row int, col int, value double")
    got = {r.chainage: r.profile for r in lines.sample_transects(points, raster, "k", 4, 7.0).collect()}
    assert got == {0.0: [None, *[2.0] * 7, 3.0], 5.0: [None] * 9}
