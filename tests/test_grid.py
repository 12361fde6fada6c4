"""The model grid does its whole job: boosting ends by its held rows, each of ten folds is predicted by the others."""

import pytest
from pyspark.sql import functions as F

from tests.test_oracles import DATA, pytestmark  # noqa: F401
from tidewall.operators import models
from tidewall.plans import q_models


def test_boosting_of_the_grid_ends_by_held_rows(spark):
    from pyspark.ml.feature import VectorAssembler

    cell = models.model_grid(q_models.BOOSTED)[0]
    df = spark.range(0, 2000, 1, 1).select(F.col("id").alias("asset_id"), (F.col("id") % 10).cast("double").alias("a"), (F.xxhash64("id") % 7).cast("double").alias("b"))
    df = VectorAssembler(inputCols=["a", "b"], outputCol="features").transform(df).cache()
    positive = (F.col("a") >= 5) & (F.pmod(F.xxhash64(F.lit(1), "asset_id"), F.lit(5)) == 0)  # rare: many small steps to its odds
    model, rounds = models._boosted_binary(df, positive, F.lit(1.0), cell["trees"], cell["depth"], cell.get("rate", 0.1), 0, 0.1, "asset_id")
    assert 4 < rounds < cell["trees"]
    held = df.filter(F.pmod(F.xxhash64(F.lit(0), "asset_id"), F.lit(1_000_003)) < 0.1 * 1_000_003).withColumns({"_positive": positive.cast("int"), "_weight": F.lit(1.0)})
    losses = model.evaluateEachIteration(held)
    assert all(later < loss for loss, later in zip(losses, losses[1:], strict=False))


def test_the_grid_has_ten_folds_side_by_side(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(models, "run_grid", lambda table, cells, fitter, folds, root: seen.append((table, cells, list(folds))))
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):  # nothing was committed
        q_models.model_grid(spark, DATA)
    table, cells, folds = seen[-1]
    assert folds == list(range(10)) and {r[0] for r in table.select("fold_id").distinct().collect()} == set(folds)
    assert table.count() == table.select("asset_id").distinct().count() and len(cells) == 16
    fits = []
    fitter = lambda train: fits.append({r[0] for r in train.select("fold_id").distinct().collect()}) or models.constant()(train)
    out = models.run_oof(table, {"c": fitter}, folds, together=4)
    assert sorted(map(sorted, fits)) == sorted(sorted(set(folds) - {k}) for k in folds)
    assert out.count() == out.select("asset_id").distinct().count() == table.count()


def test_few_rows_are_kept_in_one_task(spark, tmp_path):
    df = spark.range(40).select(F.col("id").alias("asset_id"), (F.col("id") % 2).cast("int").alias("fold_id"), (1 + F.col("id") % 5).cast("int").alias("y_true")).repartition(6)
    seen = []
    fitter = lambda cell: lambda train: seen.append((train.rdd.getNumPartitions(), train.count())) or models.constant()(train)
    models.run_grid(df, models.model_grid({"trees": (2,)}), fitter, [0, 1], str(tmp_path))
    assert seen == [(1, 20), (1, 20)]
