"""Running sums, exact quantiles and what rests on them, against numpy and pandas."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidewall.operators import clean, evaluate, lines, stats
from tidewall.operators.running import exact_quantiles, running_totals


def test_running_totals_by_group_with_ties_and_nulls(spark):
    rng = np.random.default_rng(3)
    table = pd.DataFrame({"g": rng.choice(["a", "b", None], 3000, p=[0.8, 0.1, 0.1]), "v": rng.integers(0, 40, 3000), "w": rng.integers(-3, 9, 3000)})
    got = running_totals(spark.createDataFrame(table), [F.desc("v")], {"up": "w"}, ["g"], {"all": "w"})
    assert got.columns == ["g", "v", "w", "up", "all"]
    rows = [(r.g, r.v, r.up, r["all"]) for r in got.collect()]
    assert len(rows) == 3000
    for g, part in table.groupby("g", dropna=False):
        name = None if pd.isna(g) else g
        want = {v: int(part.w[part.v >= v].sum()) for v in part.v.unique()}
        mine = [r for r in rows if r[0] == name]
        assert len(mine) == len(part)
        assert all(up == want[v] and whole == part.w.sum() for _, v, up, whole in mine)
    assert running_totals(spark.createDataFrame(table).filter("false"), [F.asc("v")], {"up": "w"}, ["g"]).count() == 0


def test_hot_group_of_a_million_values_spreads(spark):
    old = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rows = spark.range(1_000_000).select(F.lit("hot").alias("g"), F.col("id").alias("v"), F.lit(1).alias("n")).unionByName(spark.createDataFrame([("cold", 1, 5)], "g string, v long, n int"))
        got = running_totals(rows, [F.asc("v")], {"up": "n"}, ["g"], {"all": "n"})
        files = got.inputFiles()
        assert len(files) >= 4
        sizes = [spark.read.parquet(f).count() for f in files]
        assert sum(sizes) == 1_000_001 and max(sizes) < 600_000
        assert got.filter("g = 'hot'").agg(F.min(F.col("up") - F.col("v")), F.max(F.col("up") - F.col("v")), F.min("all")).first() == (1, 1, 1_000_000)
        assert "CartesianProduct" not in got._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", old)


def test_exact_quantiles_equal_numpy(spark):
    rng = np.random.default_rng(5)
    values = np.concatenate([rng.normal(size=900), rng.integers(0, 3, 600).astype(float), [np.inf, np.inf]])
    groups = np.concatenate([np.repeat(["x", "y"], [900, 600]), ["z", "z"]]).astype(object)
    groups[:50] = None
    table = spark.createDataFrame(pd.DataFrame({"g": groups, "v": values})).unionByName(spark.createDataFrame([("one", 4.0), ("none", None), ("y", None)], "g string, v double"))
    at = [0, 0.025, 0.25, 0.5, 0.9, 1]
    got = {r.g: r.quantiles for r in exact_quantiles(table, "v", at, ["g"]).collect()}
    assert set(got) == {None, "x", "y", "z", "one"} and got["one"] == [4.0] * 6 and got["z"] == [math.inf] * 6
    for g in (None, "x", "y"):
        assert got[g] == pytest.approx(np.quantile(values[[h == g if g else h is None for h in groups]], at))
    whole = exact_quantiles(table.filter("g <> 'z' or g is null"), "v", at).first().quantiles
    assert whole == pytest.approx(np.quantile(np.append(values[:-2], 4.0), at))
    assert exact_quantiles(table.filter("false"), "v", [0.5]).first().quantiles == [None]
    assert exact_quantiles(table.filter("false"), "v", [0.5], ["g"]).count() == 0


def test_bootstrap_ranks_each_resample_anew(spark):
    rng = np.random.default_rng(11)
    x = rng.integers(0, 12, 60).astype(float)
    y = np.clip(np.round(x / 4 + rng.normal(size=60)), 1, 5)
    table = spark.createDataFrame(pd.DataFrame({"asset_id": range(60), "a": x, "flat": 1.0, "empty": np.nan, "y": y})).withColumn("empty", F.lit(None).cast("double"))
    long = table.select(F.lit("a").alias("feature"), F.col("asset_id").alias("k"), F.col("a").alias("v"), F.col("y").alias("t"))
    weights = np.zeros((1000, 60), int)
    for r in spark.range(60).select(F.col("id").alias("k"), F.explode(F.sequence(F.lit(1), F.lit(1000))).alias("r")).select("k", "r", stats.poisson_weight(7).alias("w")).collect():
        weights[r.r - 1, r.k] = r.w
    assert weights.mean() == pytest.approx(1, abs=0.02) and weights.var() == pytest.approx(1, abs=0.03)
    want = []
    for w in weights:
        ranks = [pd.Series(np.repeat(c, w)).rank().to_numpy() for c in (x, y)]
        want.append(np.corrcoef(*ranks)[0, 1])
    got = {r.r: r.rho for r in stats.bootstrap_rho(long, 1000).collect()}
    assert [got[r] for r in range(1, 1001)] == pytest.approx(want, abs=1e-9)
    rows = {r.feature: r for r in stats.target_stats(table, ["a", "flat", "empty"], "y", replicates=1000, anew=True).collect()}
    assert [rows["a"].rho_low, rows["a"].rho_high] == pytest.approx(np.quantile(want, [0.025, 0.975]), abs=1e-9)
    assert rows["a"].rho == pytest.approx(np.corrcoef(pd.Series(x).rank(), pd.Series(y).rank())[0, 1])
    assert rows["flat"].rho_low is None and rows["flat"].n == 60
    assert rows["empty"].n == 0 and rows["empty"].rho is None and rows["empty"].rho_low is None


def test_cross_block_correlation(spark):
    rng = np.random.default_rng(2)
    table = pd.DataFrame(rng.integers(0, 9, (80, 4)).astype(float), columns=list("abcd"))
    table.loc[::9, "c"] = np.nan
    df = spark.createDataFrame(table.astype(object).where(table.notna(), None), "a double, b double, c double, d double")
    want = table.dropna().rank().corr()
    got = {(r.x, r.y): r for r in stats.cross_corr(df, ["a", "b"], ["c", "d"]).collect()}
    assert len(got) == 4
    for (x, y), r in got.items():
        assert r.n == len(table.dropna()) and r.spearman == pytest.approx(want.loc[x, y])
    assert [(r.n, r.spearman) for r in stats.cross_corr(df.filter("false"), ["a"], ["b"]).collect()] == [(0, None)]


def test_sweep_qc_and_codes_with_null_groups(spark):
    oof = spark.createDataFrame([(None, 0.9, 1), (None, 0.9, 0), (None, 0.1, 1), ("m", 0.5, 0)], "cell_id string, score_ge4 double, y_ge4 int")
    got = {r.cell_id: r.pr_auc_ge4 for r in evaluate.average_precision(oof, ["cell_id"]).collect()}
    assert got[None] == pytest.approx((1 / 2 + 2 / 3) / 2) and got["m"] is None
    sweep = {(r.cell_id, r.threshold): (r.n_pred_pos, r.tp, r.fn) for r in evaluate.threshold_sweep(oof, ["cell_id"]).collect()}
    assert sweep == {(None, 0.9): (2, 1, 1), (None, 0.1): (3, 2, 0), ("m", 0.5): (1, 0, 0)}
    stations = spark.createDataFrame([(None, 1.0, 3.0, 0.1), (None, 1.0, 12.0, 0.3), ("t", 1.0, 0.0, None)], "tier string, crest_z double, crest_off double, prominence double")
    qc = {r.tier: r for r in lines.station_qc(stations).collect()}
    assert qc[None].q50 == pytest.approx(0.2) and qc[None].pinned == 0.5 and qc["t"].q50 is None and qc["t"].n == 1
    codes = clean.encode_categories(spark.createDataFrame([("b",), ("a",), (None,), ("b",)], "s string"), "s", "code")
    assert sorted(((r.s, r.code) for r in codes.collect()), key=str) == [("a", 0), ("b", 1), ("b", 1), (None, None)]
    assert dict(codes.dtypes)["code"] == "int"


def test_correlation_without_spread_or_pairs_is_null(spark):
    rows = [("line", 1.0, 2.0), ("line", 2.0, 4.0), ("line", None, 99.0), ("line", 3.0, None), ("line", 4.0, 8.0), ("flat", 1.0, 1.0), ("flat", 1.0, 2.0), ("one", 1.0, 1.0), ("none", None, 1.0)]
    df = spark.createDataFrame(rows, "g string, x double, y double")
    got = {r.group: r.rho for r in stats.group_spearman(df, "g", "x", "y").collect()}
    assert got["line"] == pytest.approx(1) and got["flat"] is None and got["one"] is None and "none" not in got
    still = spark.createDataFrame([(1, float(i), 2.0) for i in range(6)], "k int, chainage double, residual double")
    assert lines.residual_stats(still, "k").first().resid_lag1 is None
