"""Model grids over folds: Spark ML fits, out-of-fold predictions, the ordinal ensemble, reference predictors,
sampled attributions. Rows stay distributed; only specifications and fitted models are on the driver."""

from __future__ import annotations

import hashlib
import itertools
import json
from collections.abc import Callable, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark import StorageLevel, inheritable_thread_target
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewall.operators.clean import QualityError
from tidewall.operators.evaluate import GRADES, cumulative_to_class, with_scores

#: Takes training rows (features, y_true), gives a function that adds proba_1..5 to rows.
Fitter = Callable[[DataFrame], Callable[[DataFrame], DataFrame]]

#: Boosting goes on while a round lowers the loss of the held rows by more than this share of it, as the reference's does.
TOLERANCE = 1e-7


def cell_id(spec: Mapping) -> str:
    """Twelve hex digits of the SHA-1 of the specification as sorted JSON."""
    return hashlib.sha1(json.dumps(spec, sort_keys=True).encode()).hexdigest()[:12]


def model_grid(options: Mapping[str, Sequence], keep: int | None = None) -> list[dict]:
    """All combinations with their cell_id, or the `keep` with the least ids; equal ids of unlike cells raise."""
    cells = [dict(zip(options, values, strict=True)) for values in itertools.product(*options.values())]
    named = {cell_id(c): c for c in cells}
    if len(named) < len(cells):
        raise QualityError("two cells of the grid share an id")
    return [{"cell_id": k, **named[k]} for k in sorted(named)[:keep]]


def pending_cells(cells: DataFrame, done: DataFrame) -> DataFrame:
    """Cells of the grid that have no stored output yet."""
    return cells.join(done.select("cell_id").distinct(), "cell_id", "left_anti")


def class_weights(df: DataFrame, target: str = "y_true") -> DataFrame:
    """Adds weight: rows over classes times the class's rows, as balance does; rows without a class go.

    One job counts the classes, so that no later pass over the rows does it again."""
    counts = {r[0]: r[1] for r in df.groupBy(target).count().collect()}
    n, known = sum(counts.values()), [c for c in counts if c is not None]
    weight = reduce(lambda w, c: w.when(F.col(target) == c, n / (len(counts) * counts[c])), known, F.when(F.lit(False), 0.0))
    return df.filter(F.col(target).isNotNull()).withColumn("weight", weight)


def forest(trees: int = 20, depth: int = 5, balanced: bool = False, seed: int = 0) -> Fitter:
    """A multiclass random forest."""
    from pyspark.ml.classification import RandomForestClassifier

    def fit(train: DataFrame):
        rows = class_weights(train) if balanced else train.withColumn("weight", F.lit(1.0))
        model = RandomForestClassifier(labelCol="y_true", weightCol="weight", numTrees=trees, maxDepth=depth, seed=seed).fit(rows)

        def predict(df: DataFrame) -> DataFrame:
            out = model.transform(df).withColumn("_p", vector_to_array("probability"))
            return out.withColumns({f"proba_{g}": F.coalesce(F.get("_p", F.lit(g)), F.lit(0.0)) for g in GRADES}).drop("_p", "probability", "rawPrediction", "prediction")

        return predict

    return fit


def _boosted_binaries(train: DataFrame, positives: Sequence[Column], weight: Column, iterations: int, depth: int, rate: float, seed: int, held: float, key: str) -> list:
    """A boosted model of each of `positives`; on `held` of the rows, by a hash of their key, it stops
    when the loss there no longer falls (by TOLERANCE of itself). Held rows lacking on either side of the cut, all are
    learned from. One job looks at the sides of all."""
    from pyspark.ml.classification import GBTClassifier

    drawn = F.pmod(F.xxhash64(F.lit(seed), key), F.lit(1_000_003)) < held * 1_000_003
    rows = train.withColumns({"_weight": weight, "_held": F.coalesce(drawn, F.lit(False))})
    side = lambda p, h, is_held: F.coalesce(F.bool_or((p == h) & (F.col("_held") == is_held)), F.lit(False))
    both = [reduce(Column.__and__, [side(p, h, is_held) for h in (True, False) for is_held in (True, False)]) for p in positives]
    stops = rows.agg(*[b.alias(f"_{i}") for i, b in enumerate(both)]).first() if held else [False] * len(positives)
    models = []
    for positive, stop in zip(positives, stops, strict=True):
        booster = GBTClassifier(labelCol="_positive", weightCol="_weight", maxIter=iterations, maxDepth=depth, stepSize=rate, seed=seed)
        if stop:
            booster = booster.setParams(validationIndicatorCol="_held", validationTol=TOLERANCE)
        models.append(booster.fit(rows.withColumn("_positive", positive.cast("int"))))
    return models


def _boosted_binary(train: DataFrame, positive: Column, *options):
    """A boosted model of `positive` and its number of trees."""
    model = _boosted_binaries(train, [positive], *options)[0]
    return model, model.getNumTrees


def boosted(iterations: int = 20, depth: int = 3, rate: float = 0.1, balanced: bool = False, seed: int = 0, held: float = 0.1, key: str = "asset_id") -> Fitter:
    """Boosted multi-class: a boosted model of each grade against the rest, stopped early, shares of their sum.

    Grades absent from the training rows get 0; a single grade gets 1. Without training rows it raises.
    """
    def fit(train: DataFrame):
        grades = sorted(r[0] for r in train.filter(F.col("y_true").isin(*GRADES)).select("y_true").distinct().collect())
        if not grades:
            raise QualityError("no graded rows to learn from")
        models = {}
        if len(grades) > 1:
            rows = class_weights(train) if balanced else train.withColumn("weight", F.lit(1.0))
            made = _boosted_binaries(rows, [F.col("y_true") == g for g in grades], F.col("weight"), iterations, depth, rate, seed, held, key)
            models = dict(zip(grades, made, strict=True))

        def predict(df: DataFrame) -> DataFrame:
            for g, model in models.items():
                df = model.transform(df).withColumn(f"_e{g}", vector_to_array("probability")[1]).drop("probability", "rawPrediction", "prediction")
            if not models:
                return df.withColumns({f"proba_{g}": F.lit(float(g == grades[0])) for g in GRADES})
            total = reduce(Column.__add__, [F.col(f"_e{g}") for g in models])
            return df.withColumns({f"proba_{g}": F.col(f"_e{g}") / total if g in models else F.lit(0.0) for g in GRADES}).drop(*[f"_e{g}" for g in models])

        return predict

    return fit


def ordinal_boost(iterations: int = 10, depth: int = 3, rate: float = 0.1, seed: int = 0, held: float = 0.1, key: str = "asset_id") -> Fitter:
    """Four boosted binary models of y > k, stopped early, whose differences are the classes; a cut without both sides raises."""
    def fit(train: DataFrame):
        sides = train.agg(*[F.avg((F.col("y_true") > k).cast("int")).alias(f"c{k}") for k in (1, 2, 3, 4)]).first()
        for k in (1, 2, 3, 4):
            if not sides[f"c{k}"] or sides[f"c{k}"] == 1:
                raise QualityError(f"no rows on one side of grade {k}")
        models = _boosted_binaries(train, [F.col("y_true") > k for k in (1, 2, 3, 4)], F.lit(1.0), iterations, depth, rate, seed, held, key)

        def predict(df: DataFrame) -> DataFrame:
            for k, model in enumerate(models, 1):
                df = model.transform(df).withColumn(f"_e{k}", vector_to_array("probability")[1]).drop("probability", "rawPrediction", "prediction")
            return cumulative_to_class(df, ["_e1", "_e2", "_e3", "_e4"]).drop("_e1", "_e2", "_e3", "_e4")

        return predict

    return fit


def constant(grade: int = 3) -> Fitter:
    return lambda _: lambda df: df.withColumns({f"proba_{g}": F.lit(float(g == grade)) for g in GRADES})


def stratified_random(key: str = "asset_id", seed: int = 0) -> Fitter:
    """One grade by the class prior of the training rows, drawn by a hash of the key."""
    def fit(train: DataFrame):
        prior = train.agg(*[F.avg((F.col("y_true") == g).cast("int")).alias(f"p{g}") for g in GRADES]).first()

        def predict(df: DataFrame) -> DataFrame:
            u = F.pmod(F.crc32(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string")).cast("binary")), F.lit(1_000_003)) / F.lit(1_000_003.0)
            edges = list(itertools.accumulate(prior[f"p{g}"] for g in GRADES))
            drawn = F.lit(1)
            for e in edges[:-1]:
                drawn = drawn + (u >= e).cast("int")
            return df.withColumn("_g", drawn).withColumns({f"proba_{g}": (F.col("_g") == g).cast("double") for g in GRADES}).drop("_g")

        return predict

    return fit


def curve_one_hot(column: str = "pred_grade", fallback: int = 3) -> Fitter:
    """The curve's grade, or the fallback where there is none."""
    return lambda _: lambda df: df.withColumns({f"proba_{g}": (F.coalesce(column, F.lit(fallback)) == g).cast("double") for g in GRADES})


def _side_by_side(spark: SparkSession, run: Callable, over: Sequence, together: int) -> list:
    """run of each, `together` at a time: the driver only submits their jobs, so that small ones fill the executors."""
    with ThreadPoolExecutor(together) as pool:
        started = [pool.submit(inheritable_thread_target(spark)(run), x) for x in over]
    return [s.result() for s in started]


def run_oof(df: DataFrame, fitters: Mapping[str, Fitter], folds: Sequence[int], together: int = 1) -> DataFrame:
    """Out-of-fold predictions of each named cell: (cell_id, asset_id, fold_id, y_true, proba_1..5, scores).

    Each fold is predicted by a model of the others, so every row of the folds is predicted once. Folds of a cell
    are fitted `together` at a time.
    """
    parts = []
    for name, fitter in fitters.items():
        predictors = _side_by_side(df.sparkSession, lambda k: fitter(df.filter(F.col("fold_id") != k)), folds, together)  # noqa: B023
        for k, predict in zip(folds, predictors, strict=True):
            out = predict(df.filter(F.col("fold_id") == k))
            parts.append(with_scores(out).select(F.lit(name).alias("cell_id"), F.lit(name).alias("model"), F.lit("base").alias("feature_set"), "asset_id", "fold_id", "y_true", *[f"proba_{g}" for g in GRADES], "y_pred_argmax", "score_ge4", "y_ge4"))
    return reduce(DataFrame.unionByName, parts)


def run_grid(df: DataFrame, cells: Sequence[Mapping], fitter: Callable[[Mapping], Fitter], folds: Sequence[int], root: str, together: int = 4) -> list[str]:
    """Fits and commits the cells of a grid that have no committed output below `root`, `together` at a time; their ids.

    So are the folds of each. A run that ends early leaves whole cells only, and the next one goes on with the rest;
    a cell that fails raises at the end.
    Every fit passes over its rows several times, so they are kept in memory, or on disk beyond it, while cells run,
    in no more tasks than their number asks for: each pass is a job, which for few rows costs by its tasks.
    """
    from tidewall.sources.io import commit_cell, committed_cells
    from tidewall.sources.shared import tasks_for

    done = committed_cells(df.sparkSession, root)
    todo = [c for c in cells if c["cell_id"] not in done]

    if not todo:
        return []
    ours = df.storageLevel == StorageLevel.NONE
    kept = df.coalesce(tasks_for(df)).persist(StorageLevel.MEMORY_AND_DISK) if ours else df

    def run(cell: Mapping) -> str:
        commit_cell(run_oof(kept, {cell["cell_id"]: fitter(cell)}, folds, together).drop("y_pred_argmax", "score_ge4", "y_ge4"), None, root, cell["cell_id"])
        return cell["cell_id"]

    try:
        return _side_by_side(df.sparkSession, run, todo, together)
    finally:
        if ours:
            kept.unpersist()


def cross_validate(df: DataFrame, fitter: Fitter, folds: Sequence[int], scorers: Mapping[str, Callable[[DataFrame], DataFrame]]) -> DataFrame:
    """(metric, mean, std, n_folds): scorers map predictions of one fold to one row and column."""
    rows = []
    for k in folds:
        out = with_scores(fitter(df.filter(F.col("fold_id") != k))(df.filter(F.col("fold_id") == k)))
        for name, score in scorers.items():
            scored = score(out)
            rows.append(scored.select(F.lit(name).alias("metric"), F.lit(k).alias("fold_id"), F.col(scored.columns[0]).cast("double").alias("value")))
    return reduce(DataFrame.unionByName, rows).groupBy("metric").agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"), F.count("value").alias("n_folds"))


def attributions(df: DataFrame, predict: Callable[[DataFrame], DataFrame], features: Sequence[str], background: Mapping[str, float], assemble: Callable[[DataFrame], DataFrame], permutations: int = 4, seed: int = 0, key: str = "asset_id") -> DataFrame:
    """(key, feature, grade, value) and the base value as feature "base_value": sampled Shapley values.

    Along an order of the features, each is switched from the background to the row's value in turn; the change
    in a class probability is its share, averaged over `permutations` orders drawn by a hash of the row. Shares
    add up to the prediction less the base exactly. All switched rows are scored in one pass.
    """
    n = len(features)
    order = F.transform(F.array_sort(F.array(*[F.struct(F.xxhash64(key, "_perm", F.lit(i), F.lit(seed)).alias("h"), F.lit(i).alias("i")) for i in range(n)])), lambda s: s["i"])
    rows = df.withColumn("_perm", F.explode(F.sequence(F.lit(1), F.lit(permutations)))).withColumn("_order", order).withColumn("_step", F.explode(F.sequence(F.lit(0), F.lit(n))))
    on = lambda i: F.array_position("_order", F.lit(i)) <= F.col("_step")
    mixed = rows.withColumns({f: F.when(on(i), F.col(f).cast("double")).otherwise(F.lit(float(background[f]))) for i, f in enumerate(features)})
    scored = predict(assemble(mixed)).select(key, "_perm", "_order", "_step", *[f"proba_{g}" for g in GRADES])
    steps = scored.groupBy(key, "_perm").agg(F.first("_order").alias("_order"), F.transform(F.sort_array(F.collect_list(F.struct("_step", F.array(*[f"proba_{g}" for g in GRADES]).alias("p")))), lambda s: s["p"]).alias("_p"))
    names = F.array(*map(F.lit, features))
    moved = steps.select(key, F.posexplode("_order").alias("_at", "_i"), "_p").select(key, F.element_at(names, F.col("_i") + 1).alias("feature"), F.posexplode(F.zip_with(F.element_at("_p", F.col("_at") + 2), F.element_at("_p", F.col("_at") + 1), lambda a, b: a - b)).alias("_g", "value"))
    base = steps.select(key, F.lit("base_value").alias("feature"), F.posexplode(F.element_at("_p", 1)).alias("_g", "value"))
    return moved.unionByName(base).groupBy(key, "feature", (F.col("_g") + 1).alias("grade")).agg(F.avg("value").alias("value"))
