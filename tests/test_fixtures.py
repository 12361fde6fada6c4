"""Hand-made cases: edges that the given tables do not hit."""

import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewall.operators import clean, corridors, curves, evaluate, exposure, folds, joins, lines, models, series, spatial, stats
from tidewall.sources import io

D = dt.date


def test_rounding_is_half_even_and_null_subtypes_drop(spark):
    rows = [(1, 2.5, "Wall", 10.0), (2, 0.4, "Wall", 9999.0), (3, 5.2, None, 10000.0), (4, 3.5, "Natural High Ground", None), (5, 4.5, "Weir", 10000.0)]
    df = spark.createDataFrame(rows, "asset_id long, grade double, sub_type string, design_sop double").withColumns({"protection_type": F.lit("x"), "lithology": F.lit("l"), "maintainer": F.lit(None).cast("string"), "asset_length": F.lit(0.0), "actual_dcl": F.lit(None).cast("double"), "inspection_date": F.lit(D(2000, 1, 1)), "asset_start_date": F.lit(D(1850, 1, 1)), "primary_purpose": F.lit("p"), **{f"geosure_{t}": F.lit("2" if t == "landslides" else "n/a") for t in clean.GROUND_THEMES}})
    got = {r.asset_id: r for r in clean.prepare_features(df).collect()}
    assert {k: r.condition_grade for k, r in got.items()} == {1: 2, 5: 4}
    assert got[5].design_sop is None and got[5].design_sop_missing == 1 and got[1].maintainer_is_ea is None
    assert got[1].age_years == pytest.approx(54786 / 365.25)
    assert (got[1].geosure_landslides, got[1].geosure_soluble_rocks, got[1].primary_purpose_code) == (2, None, 0) and (got[1].sub_type_code, got[5].sub_type_code) == (0, 1)


def test_age_limits(spark):
    df = spark.createDataFrame([(D(2000, 1, 1), D(2000, 1, 2)), (D(2000, 1, 1), D(2000, 1, 1)), (D(2000, 1, 1), D(1849, 1, 1)), (None, D(2000, 1, 1))], "a date, b date")
    assert [r[0] for r in df.select(clean.age_years(F.col("a"), F.col("b"))).collect()] == [None, 0.0, None, None]


def test_gates_raise_and_leaks_raise(spark):
    df = spark.createDataFrame([(1, 2), (1, 9), (2, None)], "k int, g int")
    gates = clean.quality_gates(df, {"domain": F.col("g").between(1, 5)}, ["k"])
    assert {r.rule: r.n_bad for r in gates.collect()} == {"domain": 2, "unique_k": 1}
    with pytest.raises(clean.QualityError, match="domain: 2"):
        clean.raise_on_bad(gates)
    with pytest.raises(clean.QualityError):
        clean.assert_no_leak(df, ["g"])
    with pytest.raises(clean.QualityError):
        clean.attach_blocks(df.select("k").distinct(), {"b": df}, "k")
    with pytest.raises(clean.QualityError):
        clean.build_feature_set(df.withColumn("c", F.lit(1)), ["c"])
    named, kind = clean.harmonise_schema(df.withColumnRenamed("k", "OLD"), {"old": "new"})
    assert named.columns == ["new", "g"] and kind == "pre"
    with pytest.raises(clean.QualityError):
        clean.harmonise_schema(df, {}, ["absent"])


def _event(asset, out, grp, start, end, area, fluvial=True):
    return (asset, out, grp, start, end, fluvial, False, False, False, area)


EVENTS = "asset_id long, rec_out_id string, rec_grp_id string, start_date date, end_date date, src_fluvial boolean, src_coastal boolean, src_tidal boolean, src_surface_water boolean, area double"
ANCHORS = "asset_id long, t_anchor date, asset_start_date date, asset_src_fluvial boolean, asset_src_coastal boolean, asset_src_tidal boolean, asset_src_surface_water boolean, protection_type_missing boolean"


def test_exposure_edges(spark):
    a = D(2010, 6, 1)
    edge = a - dt.timedelta(days=730)
    events = spark.createDataFrame([_event(1, "o1", None, edge, edge, 1.0), _event(1, "o2", None, edge, edge, 2.0), _event(1, "o3", "g", edge - dt.timedelta(days=1), edge, 4.0), _event(1, "o4", "g", a, a, 8.0), _event(1, "o5", "g", None, None, 16.0), _event(2, "o6", "h", edge, edge, 1.0, False), _event(3, "o7", "h", edge, edge, 1.0)], EVENTS)
    anchors = spark.createDataFrame([(1, a, D(1990, 1, 1), True, False, False, False, False), (2, a, D(2011, 1, 1), True, False, False, False, False), (3, None, None, False, False, False, False, False), (4, a, None, False, False, False, False, True)], ANCHORS)
    got = {r.asset_id: r for r in exposure.exposure_features(events, anchors).collect()}
    assert got[1]["exp__all__2y__n_events"] == 2 and got[1]["exp__all__5y__n_events"] == 3 and got[1]["exp__all__5y__cum_area"] == 7.0
    assert got[1]["exp__2y__window_truncated"] is False
    assert got[2]["exp__all__2y__n_events"] == 1 and got[2]["exp__all__2y__freq"] is None and got[2]["exp__matched__2y__n_events"] == 0
    assert got[3]["exp__all__lifetime__n_events"] is None and got[3]["exp__2y__window_truncated"] is None
    assert got[4]["exp__all__2y__n_events"] == 0 and got[4]["exp__matched__2y__n_events"] is None
    assert len(got[1]) == 36


def test_spells_cross_the_year_and_end_with_the_series(spark):
    first = D(2000, 12, 20)
    values = [0.0] * 20 + [5.0, 3.0, 2.0] + [0.0] * 16
    df = spark.createDataFrame([(1, first + dt.timedelta(days=i), v) for i, v in enumerate(values)], "cell_id int, date date, value double")
    got = {(r.start, r.length, r.rewet) for r in series.spells(df).collect()}
    assert got == {(first, 20, True), (first + dt.timedelta(days=23), 16, False)}
    annual = {r.year: r for r in series.rain_annual(df).collect()}
    assert annual[2000].dryspell_max == 20 and annual[2000].rewet_15 == 1 and annual[2001].dryspell_count_15 == 1 and annual[2001].rewet_15 == 0
    assert series.series_gaps(df.filter(F.col("date") != first + dt.timedelta(days=3))).count() == 1
    with pytest.raises(clean.QualityError):
        series.load_daily(df.unionByName(df))


def test_period_bounds_and_empty_windows(spark):
    frame = spark.createDataFrame([(1, D(2001, 1, 1), D(2000, 3, 1)), (2, D(2001, 5, 31), D(2000, 3, 2)), (3, None, None), (4, D(2000, 3, 20), D(2000, 3, 5))], "asset_id int, t_eff date, asset_start_date date").withColumn("cell_id", F.lit(7))
    rows = series.window_rows(frame, {"2y": 730})
    got = {r.asset_id: (r.first_month, r.last_month, r.first_year, r.last_year) for r in rows.collect()}
    m = lambda y, k: y * 12 + k - 1
    assert got == {1: (m(2000, 3), m(2000, 12), 2001, 2000), 2: (m(2000, 4), m(2001, 4), 2001, 2000), 3: (None,) * 4, 4: (m(2000, 4), m(2000, 2), 2001, 1999)}
    months = spark.createDataFrame([(7, m(2000, k), 0) for k in range(1, 13)], "cell_id int, ordinal int, v int")
    out = {r.asset_id: r.v__sum for r in series.clipped_window_agg(rows, months, "cell_id", "first_month", "last_month", "ordinal", ["v"], ["asset_id"]).collect()}
    assert out == {1: 0.0, 2: 0.0, 3: None, 4: None}


def test_ranges_look_up_their_ends(spark):
    """Sums, means and maxima of every range, past the ends and over gaps and nulls too, as plain reductions give them."""
    import random

    rng = random.Random(3)
    values = {(c, i): (rng.choice((None, -5.0, rng.uniform(-9, 9))), rng.randint(-9, 9)) for c, n in ((1, 37), (2, 8), (3, 1)) for i in range(100, 100 + n) if rng.random() < 0.8 or i == 100}
    months = spark.createDataFrame([(c, i, v, w) for (c, i), (v, w) in values.items()], "cell_id int, i int, v double, w int")
    ranges = [(k, c, a, b) for k, (c, a, b) in enumerate((c, rng.randint(95, 140), rng.randint(95, 145)) for c in (1, 1, 1, 2, 3, 4) for _ in range(60))] + [(900, 1, None, 120), (901, None, 100, 120)]
    rows = spark.createDataFrame(ranges, "k int, c int, a int, b int")
    out = series.join_window_agg(rows, months, "c", "a", "b", "i", {"v": ["sum", "mean", "max"], "w": ["max", "sum"]})
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "BETWEEN" not in plan.upper() and "_at#" in plan
    for r in out.collect():
        v, w = ([values[c, i][n] for c, i in values if c == r.c and r.a is not None and r.a <= i <= r.b and values[c, i][n] is not None] for n in (0, 1))
        assert (r.v__sum, r.v__mean, r.v__max) == ((pytest.approx(sum(v)), pytest.approx(sum(v) / len(v)), max(v)) if v else (None,) * 3)
        assert (r.w__sum, r.w__max) == ((sum(w), max(w)) if w else (None, None))


def test_agreement_table(spark):
    table = [[441, 28, 3, 0, 0], [15, 8013, 294, 15, 1], [6, 271, 22426, 260, 20], [6, 16, 235, 2595, 29], [0, 3, 16, 13, 489]]
    conf = spark.createDataFrame([("c", i + 1, j + 1, n) for i, row in enumerate(table) for j, n in enumerate(row)], "cell_id string, y_true int, y_pred_argmax int, n long")
    r = evaluate.label_metrics(conf, ["cell_id"]).first()
    assert r.exact == pytest.approx(0.9650234, abs=1e-7) and r.within_1 == pytest.approx(0.9975565, abs=1e-7)
    o = np.array(table, float)
    w = (np.arange(5)[:, None] - np.arange(5)) ** 2
    want = 1 - (w * o).sum() / (w * np.outer(o.sum(1), o.sum(0)) / o.sum()).sum()
    assert evaluate.weighted_kappa(conf, ["cell_id"]).first().qwk == pytest.approx(want)


def test_probabilities(spark):
    df = spark.createDataFrame([([0.1, 0.2, 0.7],), ([0.1, 0.1, 0.1],)], "p array<double>")
    got = evaluate.align_proba(df, "p", [3, 1, 2]).collect()
    assert [got[0][f"proba_{g}"] for g in range(1, 6)] == [0.2, 0.7, 0.1, 0.0, 0.0] and [r.bad_sum for r in got] == [False, True]
    with pytest.raises(ValueError):
        evaluate.align_proba(df, "p", [3, 1, 2], strict=True)
    cum = spark.createDataFrame([(0.8, 0.5, 0.2, 0.05), (0.8, 0.3, 0.5, 0.05)], "a double, b double, c double, d double")
    ok, turned = evaluate.cumulative_to_class(cum, ["a", "b", "c", "d"]).collect()
    assert [ok[f"proba_{g}"] for g in range(1, 6)] == pytest.approx([0.2, 0.3, 0.3, 0.15, 0.05]) and not ok.inverted
    assert turned.inverted and sum(turned[f"proba_{g}"] for g in range(1, 6)) == pytest.approx(1) and turned.proba_3 == 0


def test_average_precision_ties_and_no_positives(spark):
    rows = [("a", 0.9, 1), ("a", 0.9, 0), ("a", 0.5, 1), ("a", 0.1, 0), ("b", 0.3, 0)]
    df = spark.createDataFrame(rows, "cell_id string, score_ge4 double, y_ge4 int")
    got = {r.cell_id: r.pr_auc_ge4 for r in evaluate.average_precision(df, ["cell_id"]).collect()}
    assert got["a"] == pytest.approx(0.5 * 0.5 + 0.5 * 2 / 3) and got["b"] is None


def test_wilcoxon_exact(spark):
    d = spark.createDataFrame([("g", float(x)) for x in (1, 2, 3, 4, 5, 6)] + [("z", 0.0), ("m", 1.0), ("m", -2.0), ("m", 3.0)], "k string, d double")
    got = {r.k: r for r in evaluate.wilcoxon(d, ["k"]).collect()}
    assert got["g"].p_value == pytest.approx(2 / 64) and got["g"].w_plus == 21 and "z" not in got and got["m"].p_value == 0.75


def test_attribution_names_keep_underscores(spark):
    wide = spark.createDataFrame([(1, -2.0, 4.0)], "fold_id int, shap__a__b__grade1 double, shap__c__grade5 double")
    assert {(r.feature, r.grade, r.mean_abs) for r in evaluate.attribution_agg(wide).collect()} == {("a__b", 1, 2.0), ("c", 5, 4.0)}


def test_curve_score_edges(spark):
    curve = spark.createDataFrame([("weir", "fluvial", "all", "na", "medium", 2, 0.0, 10.0, 20.0, 20.0, 30.0)], curves.CURVE_SCHEMA)
    rows = [(1, "Weir", "Coastal", 10.0), (2, "Weir", None, 20.0), (3, "Weir", None, 30.0), (4, "Weir", None, None), (5, "Quay", None, 1.0), (6, "Wall", None, 1.0), (7, None, None, 5.0), (8, "Weir", None, 25.0), (9, "Weir", None, 5.0)]
    df = spark.createDataFrame(rows, "asset_id int, sub_type string, protection_type string, age_years double")
    got = {r.asset_id: (r.curve_status, r.pred_grade_cont, r.pred_grade) for r in curves.curve_score(df, curve).collect()}
    assert got == {1: ("scored", 2.0, 2), 2: ("scored", 4.0, 4), 3: ("scored", 5.0, 5), 4: ("no_age", None, None), 5: ("unmapped_type", None, None), 6: ("no_curve", None, None), 7: ("unmapped_type", None, None), 8: ("scored", 4.5, 4), 9: ("scored", 1.5, 1)}


def _walk(s, raw, c, step):
    i, n = c, len(s)
    while 0 < i + step < n and raw[i + step] is not None and s[i + step] <= s[i] + 0.02:
        i += step
    return i


def test_crest_and_toes_equal_a_plain_walk(spark):
    rng = np.random.default_rng(1)
    profiles = [(rng.normal(0, 1, 51).cumsum() / 3 + 5).round(3).tolist() for _ in range(40)] + [[None] * 51, [1.0] * 51, [float(i) for i in range(51)], [None if i == 25 else 10.0 - abs(i - 25) for i in range(51)], [None if i < 20 else 1.0 + (i == 26) for i in range(51)]]
    df = spark.createDataFrame(list(enumerate(profiles)), "k int, profile array<double>")
    got = {r.k: r for r in lines.crest_toes(df).collect()}
    for k, p in enumerate(profiles):
        known = [v for v in p if v is not None]
        if not known:
            assert got[k].crest_z is None
            continue
        filled = [min(known) if v is None else v for v in p]
        s = [sum(filled[j] for j in (i - 1, i, i + 1) if 0 <= j < 51) / 3 for i in range(51)]
        c = max(range(15, 36), key=lambda i: (s[i], -i))
        if p[c] is None:
            assert got[k].crest_z is None and got[k].prominence is None
            continue
        left, right = _walk(s, p, c, -1), _walk(s, p, c, 1)
        assert (got[k].crest_off, got[k].crest_z, got[k].toe_l_z, got[k].toe_r_z) == (c - 25, p[c], p[left], p[right]), k
        assert got[k].footprint_width == right - left


@pytest.mark.parametrize("n", [4, 5, 6, 12])
def test_detrend_equals_fitted_polynomials(spark, n):
    rng = np.random.default_rng(n)
    y = rng.normal(size=n).cumsum()
    df = spark.createDataFrame([(1, 5.0 * i, float(v)) for i, v in enumerate(y)], "asset_id int, chainage double, z double").repartition(3)
    got = [r.trend for r in lines.detrend(df, "asset_id", "chainage", "z").orderBy("chainage").collect()]
    if n < 5:
        assert got == [None] * n
        return
    w = min(11, n if n % 2 else n - 1)
    for i in range(n):
        first = max(0, min(i - w // 2, n - w))
        x = np.arange(w)
        want = np.polyval(np.polyfit(x, y[first : first + w], 2), i - first)
        assert got[i] == pytest.approx(want, abs=1e-9)


def test_line_features_gate_and_spine(spark):
    rows = [(1, "engineered_raised", 5.0 * i, 10.0 + (i % 2), 1.0, 1.0 + i, 8.0, float(i - 4)) for i in range(8)] + [(2, "none", 5.0 * i, 10.0, 1.0, 1.0, 8.0, 0.0) for i in range(8)]
    rows += [(3, "natural_geomorphic", 5.0 * i, 10.0, 0.2, 1.0, 8.0, 0.0) for i in range(8)] + [(4, "natural_geomorphic", 5.0 * i, 10.0, 0.9, 1.0, 8.0, 0.0) for i in range(4)]
    st = spark.createDataFrame(rows, "asset_id long, tier string, chainage double, crest_z double, prominence double, relheight double, footprint_width double, crest_off double")
    got = {r.asset_id: r for r in lines.line_features(st, spark.range(1, 6).withColumnRenamed("id", "asset_id")).collect()}
    assert got[1].crest_resid_std > 0.05 and got[1].crest_resid_ac1 < 0 and got[1].crest_found
    assert (got[1].crest_relheight_mean, got[1].crest_relheight_min, got[1].crest_width_mean, got[1].crest_offset_median) == (4.5, 1.0, 8.0, 2.0)
    assert got[1].crest_relheight_std == pytest.approx(np.std(np.arange(8)))
    for k in (2, 3, 4):  # an untrusted tier, too low, too few
        assert got[k].crest_found is False and got[k].crest_relheight_mean is None and got[k].crest_prominence_median is not None
    assert got[5].crest_found is False and got[5].n_stations == 0 and got[5].tier is None


def test_curves_hold_the_fixed_values():
    rows = {r[:6]: r[6:] for r in curves.curve_rows()}
    assert len(rows) == 117 and len({r[:4] for r in rows}) == 13 and all(list(v) == sorted(v) and v[0] == 0 for v in rows.values())
    assert rows["vertical_wall", "coastal", "concrete_masonry", "na", "medium", 2] == (0, 15, 40, 55, 70)
    assert rows["embankment", "fluvial", "varying_core", "narrow", "slowest", 3] == (0, 22, 44, 90, 130)
    assert rows["weir", "fluvial", "all", "na", "fastest", 3] == (0, 30, 45, 70, 80)


def test_nearest_leaves_no_point_out(spark):
    ring = [(0.0, 0.0), (1.0, 0.0), (1.0, 1.0), (0.0, 1.0)]
    shapes = spark.createDataFrame([(1, [ring]), (2, [[(x + 5000.0, y) for x, y in ring]])], "poly_id int, parts array<array<struct<x:double,y:double>>>")
    points = spark.createDataFrame([(1, 0.5, 0.5), (2, 4000.0, 0.5), (3, 3.0, 1.0), (4, None, 2.0), (5, -9000.0, 0.5)], "k int, x double, y double")
    got = {r.k: (r.poly_id, r.distance) for r in spatial.sjoin_nearest(points, shapes, 2.0, "k").collect()}
    assert got == {1: (1, 0.0), 2: (2, 1000.0), 3: (1, 2.0), 4: (None, None), 5: (1, 9000.0)}
    assert {(r.k, r.poly_id) for r in spatial.sjoin_nearest(points, shapes.limit(0), 2.0, "k").collect()} == {(k, None) for k in range(1, 6)}


def test_longest_line_merges_touching_parts(spark):
    parts = [[(0.0, 0.0), (3.0, 0.0)], [(3.0, 0.0), (3.0, 4.0)], [(9.0, 9.0), (15.0, 9.0)]]
    df = spark.createDataFrame([(parts,)], "parts array<array<struct<x:double,y:double>>>")
    assert [tuple(p) for p in df.select(lines.longest_line(F.col("parts"))).first()[0]] == [(0, 0), (3, 0), (3, 4)]


SQUARE = [(0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (0.0, 4.0)]
HOLE = [(1.0, 1.0), (2.0, 1.0), (2.0, 2.0), (1.0, 2.0)]


def test_polygons_with_holes_and_edges(spark):
    df = spark.createDataFrame([(1, [SQUARE, HOLE]), (2, [[(4.0, 0.0), (8.0, 0.0), (8.0, 4.0), (4.0, 4.0), (4.0, 0.0)]])], "poly_id int, parts array<array<struct<x:double,y:double>>>")
    assert [r[0] for r in df.select(spatial.area(F.col("parts"))).collect()] == [15.0, 16.0]
    c = df.select(spatial.polygon_centroid(F.col("parts")).alias("c")).first().c
    assert (c.x, c.y) == (pytest.approx((16 * 2 - 1.5) / 15), pytest.approx((16 * 2 - 1.5) / 15))
    points = spark.createDataFrame([(1, 1.5, 1.5), (2, 3.0, 3.0), (3, 4.0, 2.0), (4, 1.0, 1.5), (5, 5.0, 1.0), (6, 20.0, 1.0)], "k int, x double, y double")
    assert {(r.k, r.poly_id) for r in spatial.sjoin_within(points, df, 3.0).collect()} == {(2, 1), (5, 2)}
    near = {r.k: (r.poly_id, r.distance) for r in spatial.sjoin_nearest(points, df, 3.0, "k").collect()}
    assert near[3] == (1, 0.0) and near[1] == (1, 0.5) and near[6] == (2, 12.0)


def test_rings_of_several_polygons(spark):
    """Shells add and holes take off, however rings are listed: two squares, one with a hole and an island in it."""
    far = [(x + 10, y) for x, y in SQUARE]
    big, hole, isle = ([(a, a), (b, a), (b, b), (a, b), (a, a)] for a, b in ((-1.0, 9.0), (0.0, 8.0), (1.0, 2.0)))
    rows = [(1, [SQUARE, far]), (2, [far[::-1], SQUARE, HOLE]), (3, [isle, hole, big]), (4, [hole, big[::-1], isle, far]), (5, [SQUARE]), (6, [])]
    df = spark.createDataFrame(rows, "poly_id int, parts array<array<struct<x:double,y:double>>>")
    got = {r.poly_id: (r.a, r.c.x) for r in df.select("poly_id", spatial.area(F.col("parts")).alias("a"), spatial.polygon_centroid(F.col("parts")).alias("c")).collect()}
    assert {k: v[0] for k, v in got.items()} == {1: 32.0, 2: 31.0, 3: 37.0, 4: 53.0, 5: 16.0, 6: 0.0}
    assert got[1][1] == 7.0 and got[3][1] == pytest.approx((100 * 4 - 64 * 4 + 1.5) / 37) and got[6][1] is None
    edges = {r.poly_id: r.e for r in df.select("poly_id", spatial.oriented_edges(F.col("parts")).alias("e")).collect()}
    assert {k: sum(e.a.x * e.b.y - e.b.x * e.a.y for e in v) / 2 for k, v in edges.items()} == {k: pytest.approx(v[0]) for k, v in got.items()}
    points = spark.createDataFrame([(1, 1.5, 1.5), (1, 1.5, 1.5), (2, 5.0, 5.0), (3, None, 1.0)], "k int, x double, y double")
    met = sorted((r.k, -1 if r.poly_id is None else r.poly_id) for r in spatial.sjoin_within(points, df.filter("poly_id in (2, 3)"), 3.0, "left").collect())
    assert met == [(1, 3), (1, 3), (2, -1), (3, -1)]  # repeated points stay apart


def test_quadtree_tiles_equal_the_exact_test_at_each_point(spark):
    """Stars, slants, tiny and huge outlines, rings without extent; a third of the points in one tile, others on vertices, edges and tile ends."""
    rng = np.random.default_rng(5)
    rows = [(1, [SQUARE, HOLE]), (2, [[(-900.0, -700.0), (800.0, -650.0), (3.0, 900.0)]]), (3, [[(2.0, 2.0)] * 3]), (4, []), (5, [[(5.0, 5.0), (5.0001, 5.0), (5.0, 5.0001)]])]
    for k in range(6, 14):
        c, turns = rng.uniform(-20, 20, 2), np.sort(rng.uniform(0, 2 * np.pi, 24))
        r = rng.uniform(0.3, 1, 24) * 2.0 ** rng.integers(-1, 6)
        rows.append((k, [[(float(c[0] + a * np.cos(t)), float(c[1] + a * np.sin(t))) for a, t in zip(r, turns)]]))
    spots = [tuple(map(float, p)) for p in rng.uniform(-60, 60, (150, 2))] + [(0.6 + i * 1e-3, 3.1) for i in range(100)] + [p for _, parts in rows for ring in parts for p in ring]
    spots += [(float(x), float(y)) for x in range(-2, 6) for y in range(-2, 6)] + [(5.00002, 5.00002), (None, 1.0), (1e12, 0.5)]
    points = spark.createDataFrame([(i, *p) for i, p in enumerate(spots)], "k int, x double, y double")
    shapes = spark.createDataFrame(rows, "poly_id int, parts array<array<struct<x:double,y:double>>>")
    want = {(r.k, r.poly_id) for r in points.join(shapes, spatial.contains(F.col("parts"), F.col("x"), F.col("y"))).collect()}
    for tile, depth in ((3.0, 0), (0.7, 3), (1.0, 5)):
        got = [(r.k, r.poly_id) for r in spatial.sjoin_within(points, shapes, tile, depth=depth).collect()]
        assert len(got) == len(set(got)) and set(got) == want
    left = [(r.k, r.poly_id) for r in spatial.sjoin_within(points, shapes, 3.0, "left").collect()]
    assert {p for p in left if p[1] is not None} == want and {k for k, _ in left} == set(range(len(spots))) and len(left) == len(set(left))
    tiles = spatial.quad_tiles(shapes, 1.0, 3)
    assert tiles.filter("whole").count() > 0 and tiles.groupBy("poly_id").count().filter("count > 4 * 64").count() == 0
    assert {r.poly_id for r in spatial.sjoin_within(points, shapes.filter("poly_id in (3, 4)"), 3.0, "left").collect()} == {None}


def _path(*points):
    return np.array([[*a, *b] for a, b in zip(points, points[1:])], float)


def _slices(edges, d, outline, n=40001):
    """Area by fine slices: at each height the union of the capsules' spans, clipped to the outline's."""
    low, high = edges[:, 1::2].min() - d, edges[:, 1::2].max() + d
    ys, total = low + (np.arange(n) + 0.5) * (high - low) / n, 0.0
    for y in ys:
        spans = []
        for ax, ay, bx, by in edges:
            xs = []
            for cx, cy in ((ax, ay), (bx, by)):
                if abs(y - cy) < d:
                    xs += [cx - math.sqrt(d * d - (y - cy) ** 2), cx + math.sqrt(d * d - (y - cy) ** 2)]
            size = math.hypot(bx - ax, by - ay)
            if size:
                nx, ny = -(by - ay) / size * d, (bx - ax) / size * d
                box = [(ax + nx, ay + ny), (bx + nx, by + ny), (bx - nx, by - ny), (ax - nx, ay - ny)]
                xs += [px + (y - py) * (qx - px) / (qy - py) for (px, py), (qx, qy) in zip(box, box[1:] + box[:1]) if (py > y) != (qy > y)]
            if xs:
                spans.append((min(xs), max(xs)))
        cuts = sorted(px + (y - py) * (qx - px) / (qy - py) for px, py, qx, qy in outline if (py > y) != (qy > y))
        inside, end = list(zip(cuts[::2], cuts[1::2])), -math.inf
        for a, b in sorted(spans):
            a, end = max(a, end), max(b, end)
            total += sum(max(0.0, min(end, q) - max(a, p)) for p, q in inside)
    return total * (high - low) / n


def test_corridor_areas_are_exact():
    area, flat = corridors.corridor_area, _path((0, 0), (100, 0))
    box = lambda a, b, c, d: _path((a, b), (c, b), (c, d), (a, d), (a, b))
    close = lambda x: pytest.approx(x, rel=1e-9, abs=1e-9)
    assert area(flat, 5) == close(1000 + 25 * math.pi) and area(_path((3, 4), (3, 4)), 2) == close(4 * math.pi)
    assert area(_path((0, 0), (100, 0), (40, 0), (160, 0)), 5) == close(1600 + 25 * math.pi)  # over itself
    assert area(_path((0, 0), (60, 80)), 5) == area(_path((60, 80), (0, 0)), 5) == close(1000 + 25 * math.pi)
    assert area(_path((0, 0), (100, 0), (100, 100)), 5) == close(2000 - 25 + 25 * math.pi * 1.25)
    assert area(flat, 5, box(50, -50, 150, 50)) == close(500 + 12.5 * math.pi)
    assert area(flat, 5, box(-50, 0, 150, 50)) == close(500 + 12.5 * math.pi)
    assert area(flat, 5, box(20, -5, 30, 5)) == close(100) and area(flat, 5, box(0, -5, 100, 5)) == close(1000)  # edges on the sides
    assert area(flat, 5, box(0, 5, 100, 50)) == close(0) and area(flat, 5, box(500, 5, 600, 50)) == 0
    assert area(flat, 5, np.concatenate([box(-50, -50, 150, 50), _path((40, -1), (40, 1), (60, 1), (60, -1), (40, -1))])) == close(960 + 25 * math.pi)
    far = np.tile([400000.0, 300000.0], 2)
    assert area(_path((0, 0), (100, 0), (100, 100)) + far, 5) == pytest.approx(area(_path((0, 0), (100, 0), (100, 100)), 5), rel=1e-8)
    rng = np.random.default_rng(4)
    shape = _path((-40, -30), (45, -35), (20, 10), (50, 40), (-30, 50), (-40, -30))
    for n in (2, 4, 7):
        line = _path(*map(tuple, rng.uniform(-50, 50, (n, 2))))
        assert area(line, 7, shape) == pytest.approx(_slices(line, 7, shape), rel=1e-6)
        assert area(line, 7) == pytest.approx(_slices(line, 7, box(-99, -99, 99, 99)), rel=1e-6)


PARTS = "parts array<array<struct<x:double,y:double>>>"


def test_corridors_by_regime_and_pairs(spark):
    way = [[(0.0, 0.0), (100.0, 0.0)]]
    assets = spark.createDataFrame([(1, "Embankment", way), (2, "Wall", way), (3, "Weir", way)], f"k int, sub_type string, {PARTS}")
    got = {r.k: (r.distance, len(r.parts[0]), r.parts[0][0].x) for r in corridors.build_corridors(assets).collect()}
    assert got == {1: (20.0, 2, 0.0), 2: (5.0, 2, 0.0), 3: (5.0, 1, 50.0)}
    with pytest.raises(clean.QualityError, match="Pier"):
        corridors.build_corridors(assets.withColumn("sub_type", F.lit("Pier")))
    half = [[(-100.0, 0.0), (200.0, 0.0), (200.0, 100.0), (-100.0, 100.0)]]
    around = [[(-900.0, -900.0), (900.0, -900.0), (900.0, 900.0), (-900.0, 900.0)], [(500.0, 500.0), (600.0, 500.0), (600.0, 600.0), (500.0, 600.0)]]
    left = [[(-200.0, -50.0), (-50.0, -50.0), (-50.0, 50.0), (-200.0, 50.0)]]
    outlines = spark.createDataFrame([(1, half, 7.0), (2, around, None), (3, left, 1.0), (4, [], 2.0), (5, None, 2.0)], f"poly_id int, {PARTS}, rec_grp_id double")
    for tile in (30.0, 1000.0):
        events = {(r.k, r.poly_id): (r.intersected_area_m2, r.rec_grp_id) for r in corridors.exposure_events(assets, outlines, "k", tile).collect()}
        assert set(events) == {(k, p) for k in (1, 2, 3) for p in (1, 2)}
        assert events[1, 1] == (pytest.approx(2000 + 200 * math.pi), "7") and events[1, 2] == (pytest.approx(4000 + 400 * math.pi), None)
        assert events[3, 1][0] == pytest.approx(12.5 * math.pi) and events[2, 2][0] == pytest.approx(1000 + 25 * math.pi)


def test_signed_ranks_of_any_number(spark):
    import itertools

    for n in (1, 2, 5, 9, 12):
        ranks = [2 * k + 1 + (k % 2) for k in range(n)]
        sums = [sum(c) for c in itertools.product(*[(0, r) for r in ranks])]
        for w in {0, ranks[0], sum(ranks) // 2, sum(ranks)}:
            p = min(1.0, 2 * min(sum(s <= w for s in sums), sum(s >= w for s in sums)) / 2**n)
            assert evaluate.signed_rank_p(ranks, w) == pytest.approx(p, abs=1e-12)
    rows = [("a", float(k)) for k in range(1, 22)] + [("b", float(k if k % 3 else -k)) for k in range(1, 101)] + [("c", 0.0), ("c", None)]
    got = {r.m: (r.n, r.w_plus, r.p_value) for r in evaluate.wilcoxon(spark.createDataFrame(rows, "m string, d double"), ["m"]).collect()}
    assert set(got) == {"a", "b"} and got["a"] == (21, 231.0, pytest.approx(2 / 2**21, rel=1e-9))
    assert got["b"][:2] == (100, 3367.0) and 0 < got["b"][2] < 0.01


def test_chi_square_tails_of_any_freedom(spark):
    """Against the closed sums in 60 digits, from 1 to 5000 degrees, near and far from the mean."""
    import decimal

    with decimal.localcontext() as ctx:
        ctx.prec = 60
        dec, rows = decimal.Decimal, []
        for k in (1, 2, 3, 4, 10, 11, 101, 400, 799, 801, 999, 1500, 4999, 5000):
            for share in (0.5, 0.9, 1.0, 1.1, 1.6):
                h = dec(k) * dec(str(share))
                x = h / 2
                term, total = dec(1), dec(0)
                if k % 2:
                    term = x.sqrt() / (dec(math.pi).sqrt() / 2)
                for j in range(k // 2):
                    total += term
                    term *= x / (dec(j) + (dec("1.5") if k % 2 else 1))
                rows.append((k, float(h), float(total * (-x).exp()) + (math.erfc(math.sqrt(float(x))) if k % 2 else 0.0)))
    df = spark.createDataFrame(rows + [(None, 3.0, None), (4, None, None), (3, 0.0, 1.0)], "k int, h double, want double")
    for r in df.select("want", stats.chi_square_tail(F.col("h"), F.col("k")).alias("p")).collect():
        assert r.p == (None if r.want is None else pytest.approx(r.want, abs=1e-10, rel=1e-8))
    tied = stats.kruskal(spark.createDataFrame([(1, 2.0), (2, 2.0)], "g int, v double"), "g", "v").first()
    assert tied.h is None and tied.p is None


def test_grid_index_of_no_place_is_null(spark):
    df = spark.createDataFrame([(None,), (-9.0,), (4.4,), (99.0,)], "x double")
    assert [r[0] for r in df.select(joins.nearest_axis_index(F.col("x"), 0.0, 1.0, 10)).collect()] == [None, 0, 4, 9]


def test_grid_reference_points(spark):
    # A published worked example of the projection (easting 651409.903, northing 313177.270 is 52 39 27.2531 N, 1 43 4.5177 E on the
    # older datum), moved to WGS 84: about 52.6580 N, 1.7161 E.
    r = spatial.bng_to_wgs84(spark.createDataFrame([(651409.903, 313177.270)], "e double, n double"), "e", "n").first()
    assert r.lat == pytest.approx(52.6580, abs=2e-4) and r.lon == pytest.approx(1.7161, abs=2e-4)


def test_ring_search_takes_the_first_ring(spark):
    grid = spark.createDataFrame([(1, 1, False), (0, 0, True), (1, 3, True), (2, 2, True)], "iy int, ix int, valid boolean")
    points = spark.createDataFrame([(1, 1, 1), (2, 9, 9)], "k int, iy int, ix int")
    got = {r.k: (r.valid_iy, r.valid_ix, r.fallback) for r in joins.resolve_valid_cell(points, grid, 2).collect()}
    assert got == {1: (0, 0, True), 2: (None, None, None)}


def test_axis_ties_go_left(spark):
    df = spark.createDataFrame([(x,) for x in (-9.0, 0.5, 0.51, 1.5, 99.0)], "x double")
    assert [r[0] for r in df.select(joins.nearest_axis_index(F.col("x"), 0.0, 1.0, 4)).collect()] == [0, 0, 1, 1, 3]


def test_folds_keep_blocks_whole_and_cover_rows(spark):
    df = spark.range(400).select(F.col("id").alias("asset_id"), F.concat(F.lit("b"), (F.col("id") % 23).cast("string")).alias("block"), (1 + F.col("id") % 3).cast("int").alias("y"))
    dealt = folds.assign_folds(df, "block", "y", 4)
    assert dealt.count() == 400 and dealt.groupBy("block").agg(F.count_distinct("fold_id").alias("n")).filter("n > 1").count() == 0
    sizes = [r["count"] for r in dealt.groupBy("fold_id").count().collect()]
    assert len(sizes) == 4 and max(sizes) < 2 * min(sizes)


def test_models_predict_each_row_once_and_attributions_add_up(spark):
    from pyspark.ml.feature import VectorAssembler

    assemble = lambda d: VectorAssembler(inputCols=["a", "b"], outputCol="features").transform(d.drop("features"))
    df = assemble(spark.range(120).select(F.col("id").alias("asset_id"), (F.col("id") % 2).cast("int").alias("fold_id"), (1 + F.col("id") % 5).cast("int").alias("y_true"), (F.col("id") % 5).cast("double").alias("a"), (F.col("id") % 7).cast("double").alias("b"))).cache()
    oof = models.run_oof(df, {"f": models.forest(3, 4), "o": models.ordinal_boost(2, 2)}, [0, 1])
    assert oof.groupBy("cell_id").agg(F.count_distinct("asset_id").alias("n"), F.count("*").alias("m")).filter("n <> 120 or m <> 120").count() == 0
    assert evaluate.validate_oof(oof).filter("n_bad > 0").count() == 0
    predict = models.forest(3, 4)(df)
    some = df.filter("asset_id < 6")
    parts = models.attributions(some, predict, ["a", "b"], {"a": 2.0, "b": 3.0}, assemble, permutations=2)
    sums = {(r.asset_id, r.grade): r.s for r in parts.groupBy("asset_id", "grade").agg(F.sum("value").alias("s")).collect()}
    for r in predict(some).collect():
        for g in range(1, 6):
            assert sums[r.asset_id, g] == pytest.approx(r[f"proba_{g}"], abs=1e-9)
    with pytest.raises(clean.QualityError):
        models.ordinal_boost(1, 1)(df.filter("y_true = 2"))
    assert len(models.model_grid({"a": (1, 2), "b": (3,)})) == 2


def test_boosted_grades_stop_early_and_grids_resume(spark, tmp_path):
    from pyspark.ml.feature import VectorAssembler

    df = spark.range(240).select(F.col("id").alias("asset_id"), (F.col("id") % 2).cast("int").alias("fold_id"), (1 + F.col("id") % 5).cast("int").alias("y_true"), (F.col("id") % 5).cast("double").alias("a"), (F.xxhash64("id") % 7).cast("double").alias("b"))
    df = VectorAssembler(inputCols=["a", "b"], outputCol="features").transform(df).cache()
    out = models.boosted(4, 2, 0.5)(df)(df)
    probas = [f"proba_{g}" for g in range(1, 6)]
    assert out.filter(F.abs(sum(F.col(p) for p in probas) - 1) > 1e-9).count() == 0
    assert out.filter(F.array_position(F.array(*probas), F.greatest(*probas)) != F.col("y_true")).count() == 0
    two = models.boosted(2, 2, balanced=True)(df.filter("y_true in (2, 5)"))(df)
    assert two.filter("proba_1 + proba_3 + proba_4 <> 0 or abs(proba_2 + proba_5 - 1) > 1e-9").count() == 0
    assert models.boosted(1, 1)(df.filter("y_true = 4"))(df).filter("proba_4 <> 1").count() == 0
    with pytest.raises(clean.QualityError):
        models.boosted(1, 1)(df.limit(0))
    noise = (F.xxhash64("asset_id") % 2 == 0) & (F.col("asset_id") >= 0)  # nothing to learn: held rows stop the boosting
    early, whole = (models._boosted_binary(df, noise, F.lit(1.0), 12, 4, 0.5, 0, h, "asset_id")[1] for h in (0.3, 0.0))
    assert early < whole == 12
    cells, root = models.model_grid({"trees": (2, 3), "depth": (1, 2)}), str(tmp_path)
    fitter = lambda c: models.forest(c["trees"], c["depth"])
    assert models.run_grid(df, cells[:1], fitter, [0, 1], root) == [cells[0]["cell_id"]]
    assert models.run_grid(df, cells, fitter, [0, 1], root, together=3) == [c["cell_id"] for c in cells[1:]]
    assert models.run_grid(df, cells, fitter, [0, 1], root) == []


def test_passes_of_a_fit_do_not_repeat_its_preparation(spark, tmp_path):
    """Class weights are in the rows' own plan, one job looks at the sides of all grades, cells of a grid read kept rows."""
    from pyspark.ml.feature import VectorAssembler

    df = spark.range(90).select(F.col("id").alias("asset_id"), (F.col("id") % 2).cast("int").alias("fold_id"), F.when(F.col("id") % 9 != 0, (1 + F.col("id") % 3).cast("int")).alias("y_true"), F.col("id").cast("double").alias("a"))
    df = VectorAssembler(inputCols=["a"], outputCol="features").transform(df)
    weighted = models.class_weights(df)
    assert "Exchange" not in weighted._jdf.queryExecution().executedPlan().toString()
    counts = {g: df.filter(F.col("y_true") == g).count() for g in (1, 2, 3)}
    assert {(r.y_true, r.weight) for r in weighted.select("y_true", "weight").distinct().collect()} == {(g, 90 / (4 * n)) for g, n in counts.items()}
    assert weighted.count() == 80
    seen, fold, df = [], models.forest(2, 1), df.filter("y_true is not null")
    models.run_grid(df, models.model_grid({"trees": (2,)}), lambda c: lambda train: seen.append(train._jdf.queryExecution().withCachedData().toString()) or fold(train), [0], str(tmp_path))
    assert len(seen) == 1 and "InMemoryRelation" in seen[0] and not df.is_cached and not df.storageLevel.useMemory


def test_bootstrap_and_samples(spark):
    df = spark.range(300).select(F.col("id").alias("asset_id"), F.col("id").cast("double").alias("v"), (1 + F.floor(F.col("id") / 60)).cast("int").alias("t"), (F.col("id") % 3).alias("g"))
    r = stats.target_stats(df, ["v"], "t", replicates=50).first()
    assert r.rho_low <= r.rho <= r.rho_high and r.rho > 0.95 and r.ap == pytest.approx(1) and r.prevalence == pytest.approx(0.4)
    a, b = (stats.stratified_sample(df, "g", "asset_id", 20).collect() for _ in range(2))
    assert len(a) == 60 and sorted(a) == sorted(b)
    assert 0.2 < stats.hopkins(df.withColumn("w", (F.col("asset_id") * 7919 % 300).cast("double")), ["v", "w"], "asset_id", 60).first().hopkins < 0.8
    explained = [x.explained for x in stats.pca(df, ["v", "t"]).collect()]
    assert sum(explained) == pytest.approx(1) and explained[0] > 0.9


def test_logs_and_commits(spark, tmp_path):
    for n in (1, 2):
        io.log_run(spark, f"{tmp_path}/log", "run", {"n": n})
    io.log_run(spark, f"{tmp_path}/log", "cell", {"n": 9})
    last = {r.kind: r.payload for r in io.last_record(io.load_run_log(spark, f"{tmp_path}/log", "run")).collect()}
    assert last == {"run": '{"n": 2}'}
    oof = spark.createDataFrame([("c", 1, 0.2, 0.2, 0.2, 0.2, 0.2, 3)], "cell_id string, asset_id int, proba_1 double, proba_2 double, proba_3 double, proba_4 double, proba_5 double, y_true int")
    io.commit_cell(oof, oof, str(tmp_path), "c")
    assert io.load_oof(spark, str(tmp_path), ["c"]).first().y_pred_argmax == 1
    with pytest.raises(clean.QualityError):
        io.load_oof(spark, str(tmp_path), ["d"])


def test_stream_equals_batch_and_resumes(spark, tmp_path):
    from tidewall.streaming.ingest import ingest_daily_stream

    rows = [(i, dt.datetime(2024, 1, 1 + i % 3, i % 24), i % 5, float(i % 13)) for i in range(300)]
    schema = "event_id long, ts timestamp, user_id long, value double"
    spark.createDataFrame(rows + rows[:20], schema).write.parquet(f"{tmp_path}/in")
    got = ingest_daily_stream(spark, f"{tmp_path}/in", f"{tmp_path}/work")
    assert got.agg(F.sum("n")).first()[0] == 300 and got.agg(F.sum("total")).first()[0] == sum(r[3] for r in rows)
    spark.createDataFrame([(1000, dt.datetime(2024, 1, 3, 23), 1, 50.0)], schema).write.mode("append").parquet(f"{tmp_path}/in")
    again = ingest_daily_stream(spark, f"{tmp_path}/in", f"{tmp_path}/work")
    assert again.agg(F.sum("n")).first()[0] == 301


def test_tails_equal_published_values(spark):
    df = spark.createDataFrame([(3.841459, 1, 0.05), (9.487729, 4, 0.05), (7.814728, 3, 0.05), (23.209251, 10, 0.01), (0.0, 2, 1.0), (124.342113, 100, 0.05), (77.930524, 99, 0.9414)], "h double, k int, p double")
    for r in df.select("p", "k", stats.chi_square_tail(F.col("h"), F.col("k")).alias("got")).collect():
        assert r.got == pytest.approx(r.p, abs=2e-3 if r.k == 99 else 1e-6)
    z = spark.createDataFrame([(0.0, 1.0), (1.959964, 0.05), (2.575829, 0.01), (4.0, 6.334248e-5), (6.0, 1.973175e-9)], "z double, p double")
    for r in z.select("p", stats.normal_tail(F.col("z")).alias("got")).collect():
        assert r.got == pytest.approx(r.p, rel=1e-5)


def test_spatial_blocks_put_near_points_together(spark):
    rng = np.random.default_rng(1)
    centres = [(0.0, 0.0), (1000.0, 0.0), (0.0, 1000.0)]
    rows = [(i, centres[i % 3][0] + float(rng.normal(0, 5)), centres[i % 3][1] + float(rng.normal(0, 5))) for i in range(90)]
    df = spark.createDataFrame(rows, "asset_id long, x double, y double")
    got = {}
    for r in folds.spatial_blocks(df, "x", "y", 3).collect():
        got.setdefault(r.block, set()).add(r.asset_id % 3)
    assert sorted(map(len, got.values())) == [1, 1, 1]
