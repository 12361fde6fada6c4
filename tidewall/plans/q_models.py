"""Queries of folds, models and attributions; fits are held against invariants in the tests."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewall.operators import evaluate, folds, models
from tidewall.plans.registry import query, rounded
from tidewall.plans.standins import oracle, standin
from tidewall.sources import io
from tidewall.sources.shared import shared_dir, stored

FEATURES = ("asset_length", "actual_dcl", "price", "x")
#: Grids of the two families. Boosting has 400 rounds to go, as in the reference, and ends where held rows say so.
FORESTS = {"family": ("forest",), "depth": (2, 3, 4), "trees": (5, 10), "balanced": (False, True)}
BOOSTED = {"family": ("boosted",), "depth": (2, 3), "trees": (400,), "rate": (0.05,), "balanced": (False, True)}
#: Folds of the grid, as in the reference.
GRID_FOLDS = 10


def _assemble(df: DataFrame) -> DataFrame:
    return VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(df.drop("features"))


def _table(spark: SparkSession, d: str, n_folds: int = 3) -> DataFrame:
    """Assets with grade, features and folds of grid blocks."""
    j = standin(spark, d, "si_asset").join(standin(spark, d, "si_latest").select("asset_id", F.col("grade").alias("y_true"), "price"), "asset_id")
    j = j.withColumns({f: F.coalesce(F.col(f).cast("double"), F.lit(-1.0)) for f in FEATURES})
    dealt = folds.assign_folds(folds.grid_blocks(j, "x", "y", 20000.0), "block", "y_true", n_folds)
    return _assemble(stored(dealt.select("asset_id", "y_true", "fold_id", "block", *FEATURES), "fits"))  # fits read it many times


@query(oracle("si_asset") + " select asset_id, concat_ws(':', cast(cast(floor(x / 20000) as bigint) as varchar), cast(cast(floor(y / 20000) as bigint) as varchar)) as block from si_asset")
def grid_blocks(spark: SparkSession, d: str) -> DataFrame:
    return folds.grid_blocks(standin(spark, d, "si_asset"), "x", "y", 20000.0).select("asset_id", "block")


@query()
def spatial_blocks(spark: SparkSession, d: str) -> DataFrame:
    return folds.spatial_blocks(standin(spark, d, "si_asset").select("asset_id", "x", "y"), "x", "y", 10)


@query()
def assign_folds(spark: SparkSession, d: str) -> DataFrame:
    return _table(spark, d).select("asset_id", "block", "y_true", "fold_id")


@query(oracle("si_oof") + ", a as (select distinct asset_id, fold_id from si_oof) select cast(count(*) filter (where asset_id % 7 in (0, 1)) as bigint) as only_a, cast(count(*) filter (where asset_id % 7 = 0) as bigint) as only_b from a")
def folds_match(spark: SparkSession, d: str) -> DataFrame:
    """The folds of stored predictions against those of a later run that moved some assets and lacks others."""
    stored = standin(spark, d, "si_oof").select("asset_id", "fold_id").distinct()
    later = stored.filter("asset_id % 7 <> 1").withColumn("fold_id", F.when(F.col("asset_id") % 7 == 0, F.col("fold_id") + 1).otherwise(F.col("fold_id")))
    return folds.folds_match(stored, later)


@query(oracle("si_oof") + " select cell_id, count(*) as n from si_oof where cell_id not in (select cell_id from si_oof where cell_id = 'cell_1') group by 1")
def pending_cells(spark: SparkSession, d: str) -> DataFrame:
    oof = standin(spark, d, "si_oof")
    todo = models.pending_cells(oof.select("cell_id").distinct(), oof.filter("cell_id = 'cell_1'"))
    return oof.join(todo, "cell_id").groupBy("cell_id").agg(F.count("*").alias("n"))


@query()
def run_oof(spark: SparkSession, d: str) -> DataFrame:
    fitters = {"forest": models.forest(5, 3), "ordinal": models.ordinal_boost(3, 2)}
    return rounded(models.run_oof(_table(spark, d), fitters, range(3)))


def _fitter(cell: Mapping) -> models.Fitter:
    if cell["family"] == "forest":
        return models.forest(cell["trees"], cell["depth"], cell["balanced"])
    return models.boosted(cell["trees"], cell["depth"], cell["rate"], cell["balanced"])


@query()
def model_grid(spark: SparkSession, d: str) -> DataFrame:
    """Every cell of both grids fitted, in a run that ends after one cell and a second that goes on; metrics by fold."""
    cells, root, table = models.model_grid(FORESTS) + models.model_grid(BOOSTED), shared_dir(spark, "grid"), _table(spark, d, GRID_FOLDS)
    for some in (cells[:1], cells):
        models.run_grid(table, some, _fitter, range(GRID_FOLDS), root)
    return rounded(evaluate.metrics(io.load_oof(spark, root, [c["cell_id"] for c in cells]), (*evaluate.CELL, "fold_id")))


@query()
def cross_validate(spark: SparkSession, d: str) -> DataFrame:
    scorers = {"mae": lambda p: p.agg(F.avg(F.abs(F.col("y_true") - F.col("y_pred_argmax")))), "agreement": lambda p: p.agg(F.avg((F.col("y_true") == F.col("y_pred_argmax")).cast("int")))}
    return rounded(models.cross_validate(_table(spark, d), models.forest(5, 3), range(3), scorers))


@query(
    oracle("si_asset", "si_latest") + """ select a.asset_id, 'constant' as model, 3 as y_pred_argmax, cast(abs(l.grade - 3) as int) as error from si_asset a join si_latest l on a.asset_id = l.asset_id
    union all select a.asset_id, 'curve', coalesce(case when a.asset_id % 4 <> 0 then cast(1 + a.asset_id % 5 as int) end, 3), cast(abs(l.grade - coalesce(case when a.asset_id % 4 <> 0 then 1 + a.asset_id % 5 end, 3)) as int) from si_asset a join si_latest l on a.asset_id = l.asset_id"""
)
def reference_predictors(spark: SparkSession, d: str) -> DataFrame:
    """The constant and the curve predictor; the random one is in run_reference_random."""
    df = _table(spark, d).withColumn("pred_grade", F.when(F.col("asset_id") % 4 != 0, (1 + F.col("asset_id") % 5).cast("int")))
    out = models.run_oof(df, {"constant": models.constant(), "curve": models.curve_one_hot()}, range(3))
    return out.select("asset_id", "model", "y_pred_argmax", F.abs(F.col("y_true") - F.col("y_pred_argmax")).alias("error"))


@query()
def run_reference_random(spark: SparkSession, d: str) -> DataFrame:
    return models.run_oof(_table(spark, d), {"random": models.stratified_random()}, range(3))


@query()
def h_attributions(spark: SparkSession, d: str) -> DataFrame:
    """Shares of a forest's probabilities by feature, over a seeded sample of rows a fold."""
    from tidewall.operators.stats import stratified_sample

    df = _table(spark, d)
    predict = models.forest(5, 3)(df)
    means = df.agg(*[F.avg(f).alias(f) for f in FEATURES]).first().asDict()
    return rounded(models.attributions(stratified_sample(df, "fold_id", "asset_id", 500), predict, FEATURES, means, _assemble))
