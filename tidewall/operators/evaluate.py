"""Out-of-fold evaluation of ordinal predictions, grades 1 to 5.

A predictions table has cell_id (a model with its settings), model, feature_set, fold_id, asset_id, y_true,
proba_1..5, y_pred_argmax, score_ge4 and y_ge4. Everything starts from counts by group: confusion counts or
counts by distinct score, so windows run over those and never over all rows of a cell.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from tidewall.operators.running import running_totals

GRADES = (1, 2, 3, 4, 5)
CELL = ("cell_id", "model", "feature_set")
METRICS = ("qwk", "pr_auc_ge4", "mae")


def with_scores(oof: DataFrame) -> DataFrame:
    """Adds y_pred_argmax (the first largest), score_ge4 and y_ge4."""
    p = F.array(*[F.col(f"proba_{g}") for g in GRADES])
    return oof.withColumns({"y_pred_argmax": F.array_position(p, F.array_max(p)).cast("int"), "score_ge4": F.col("proba_4") + F.col("proba_5"), "y_ge4": (F.col("y_true") >= 4).cast("int")})


def align_proba(df: DataFrame, proba: str, classes: Sequence[int], strict: bool = False) -> DataFrame:
    """proba_1..5 from an array of probabilities by class in the order of `classes`; absent classes are 0.

    `bad_sum` marks rows whose sum is off 1 by more than 1e-6. With strict, absent classes raise.
    """
    if strict and (absent := sorted(set(GRADES) - set(classes))):
        raise ValueError(f"the model does not know classes {absent}")
    place = {c: k for k, c in enumerate(classes)}
    out = {f"proba_{g}": F.col(proba)[place[g]] if g in place else F.lit(0.0) for g in GRADES}
    total = F.aggregate(proba, F.lit(0.0), lambda a, x: a + x)
    return df.withColumns(out | {"bad_sum": F.abs(total - 1) > 1e-6})


def cumulative_to_class(df: DataFrame, exceed: Sequence[str]) -> DataFrame:
    """proba_1..5 from P(y > k), k = 1 to 4: differences, clamped at 0, scaled to sum 1; `inverted` if any was negative."""
    edges = [F.lit(1.0), *map(F.col, exceed), F.lit(0.0)]
    raw = [edges[k] - edges[k + 1] for k in range(5)]
    held = [F.greatest(F.lit(0.0), r) for r in raw]
    total = sum(held[1:], held[0])
    inverted = F.lit(False)
    for r in raw:
        inverted = inverted | (r < 0)
    return df.withColumns({f"proba_{g}": held[g - 1] / total for g in GRADES} | {"inverted": inverted})


def inversion_rates(df: DataFrame, by: Sequence[str]) -> DataFrame:
    return df.groupBy(*by).agg(F.count("*").alias("n"), F.avg(F.col("inverted").cast("int")).alias("inversion_rate"))


def validate_oof(oof: DataFrame) -> DataFrame:
    """(rule, n_bad): grade domain, probabilities that sum to 1, one row per cell and asset, equal counts by cell."""
    from tidewall.operators.clean import quality_gates

    total = sum((F.col(f"proba_{g}") for g in GRADES[1:]), F.col("proba_1"))
    gates = quality_gates(oof, {"y_true_domain": F.col("y_true").between(1, 5), "y_pred_domain": F.col("y_pred_argmax").between(1, 5), "sums_to_one": F.abs(total - 1) <= 1e-6}, ["cell_id", "asset_id"])
    sizes = oof.groupBy("cell_id").agg(F.count("*").alias("n")).agg(F.lit("equal_counts").alias("rule"), (F.count_distinct("n") - 1).alias("n_bad"))
    return gates.unionByName(sizes)


def confusion(oof: DataFrame, keys: Sequence[str] = CELL) -> DataFrame:
    """All 25 (y_true, y_pred_argmax) of each group with n, zero where none."""
    counted = oof.groupBy(*keys, "y_true", "y_pred_argmax").agg(F.count("*").alias("n"))
    grid = counted.select(*keys).distinct().withColumn("y_true", F.explode(F.array(*map(F.lit, GRADES)))).withColumn("y_pred_argmax", F.explode(F.array(*map(F.lit, GRADES))))
    return grid.join(counted, [*keys, "y_true", "y_pred_argmax"], "left").withColumn("n", F.coalesce("n", F.lit(0)))


def confusion_wide(conf: DataFrame, keys: Sequence[str] = CELL) -> DataFrame:
    return conf.groupBy(*keys, "y_true").pivot("y_pred_argmax", list(GRADES)).agg(F.first("n"))


def _margins(conf: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, grade, support, n_pred, tp) in one pass over confusion counts."""
    sides = conf.withColumn("_s", F.explode(F.array(F.struct(F.col("y_true").alias("grade"), F.lit(True).alias("true")), F.struct(F.col("y_pred_argmax").alias("grade"), F.lit(False).alias("true")))))
    hit = F.col("y_true") == F.col("y_pred_argmax")
    return sides.groupBy(*keys, F.col("_s.grade").alias("grade")).agg(
        F.sum(F.when(F.col("_s.true"), F.col("n")).otherwise(0)).alias("support"), F.sum(F.when(~F.col("_s.true"), F.col("n")).otherwise(0)).alias("n_pred"), F.sum(F.when(F.col("_s.true") & hit, F.col("n")).otherwise(0)).alias("tp")
    )


def _f1(p: Column, r: Column) -> Column:
    return F.when(p + r > 0, 2 * p * r / (p + r))


def per_grade(oof: DataFrame, keys: Sequence[str] = CELL, zero_division: float | None = None) -> DataFrame:
    """Precision, recall and F1 of each grade; on a zero denominator null or `zero_division`."""
    m = _margins(confusion(oof, keys), keys)
    fill = F.lit(zero_division).cast("double")
    rate = lambda d: F.when(F.col(d) > 0, F.col("tp") / F.col(d)).otherwise(fill)
    m = m.withColumns({"precision": rate("n_pred"), "recall": rate("support")})
    return m.withColumn("f1", F.coalesce(_f1(F.col("precision"), F.col("recall")), fill))


def grade_scores(oof: DataFrame, keys: Sequence[str] = (*CELL, "fold_id")) -> DataFrame:
    """Scorers of each grade: null where the truth lacks the grade, else zero on a zero denominator."""
    m = _margins(confusion(oof, keys), keys)
    known = F.col("support") > 0
    recall = F.when(known, F.col("tp") / F.col("support"))
    precision = F.when(known, F.when(F.col("n_pred") > 0, F.col("tp") / F.col("n_pred")).otherwise(0.0))
    return m.select(*keys, "grade", recall.alias("recall"), precision.alias("precision"), F.when(known, F.coalesce(_f1(precision, recall), F.lit(0.0))).alias("f1"))


def weighted_kappa(conf: DataFrame, keys: Sequence[str] = CELL) -> DataFrame:
    """(keys, qwk): quadratic weights over grades 1 to 5; null where no disagreement is expected.

    The expected part needs only the margins' first two moments: sum over i, j of r_i c_j (i - j)^2 / n.
    """
    t, p, n = F.col("y_true"), F.col("y_pred_argmax"), F.col("n")
    s = conf.groupBy(*keys).agg(F.sum(n).alias("n"), F.sum(n * (t - p) * (t - p)).alias("o"), F.sum(n * t).alias("t1"), F.sum(n * t * t).alias("t2"), F.sum(n * p).alias("p1"), F.sum(n * p * p).alias("p2"))
    expected = F.col("t2") + F.col("p2") - 2 * F.col("t1") * F.col("p1") / F.col("n")
    return s.select(*keys, F.when(F.abs(expected) > 1e-9, 1 - F.col("o") / expected).alias("qwk"))


def label_metrics(conf: DataFrame, keys: Sequence[str] = CELL) -> DataFrame:
    """n, mae, bias, exact and within_1 shares, and macro F1 over grades seen in truth or prediction."""
    t, p, n = F.col("y_true"), F.col("y_pred_argmax"), F.col("n")
    total = F.sum(n)
    base = conf.groupBy(*keys).agg(total.alias("n"), (F.sum(n * F.abs(t - p)) / total).alias("mae"), (F.sum(n * (p - t)) / total).alias("bias"), (F.sum(F.when(t == p, n).otherwise(0)) / total).alias("exact"), (F.sum(F.when(F.abs(t - p) <= 1, n).otherwise(0)) / total).alias("within_1"))
    m = _margins(conf, keys).filter("support + n_pred > 0")
    macro = m.groupBy(*keys).agg(F.avg(2 * F.col("tp") / (F.col("support") + F.col("n_pred"))).alias("macro_f1"))
    return base.join(macro, list(keys))


def score_counts(oof: DataFrame, keys: Sequence[str] = CELL) -> DataFrame:
    """(keys, score, n, pos): rows and positives at each distinct score."""
    return oof.groupBy(*keys, F.col("score_ge4").alias("score")).agg(F.count("*").alias("n"), F.sum(F.col("y_ge4").cast("long")).alias("pos"))


def _running(counts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows and positives at each score and above (k, tp), and the group's positives; a group may be of any size."""
    return running_totals(counts, [F.desc("score")], {"k": "n", "tp": "pos"}, keys, {"p_total": "pos"})


def average_precision(oof: DataFrame, keys: Sequence[str] = CELL) -> DataFrame:
    """(keys, pr_auc_ge4): sum of recall steps times precision over distinct scores; null without positives."""
    r = _running(score_counts(oof, keys), keys)
    total = F.max("p_total")
    return r.groupBy(*keys).agg(F.when(total > 0, F.sum(F.col("pos") * F.col("tp") / F.col("k")) / total).alias("pr_auc_ge4"))


def metrics(oof: DataFrame, keys: Sequence[str] = CELL) -> DataFrame:
    """n, n_pos_ge4, qwk, pr_auc_ge4 and mae by group: by CELL pooled, with fold_id by fold."""
    conf = confusion(oof, keys)
    n_pos = F.sum(F.when(F.col("y_true") >= 4, F.col("n")).otherwise(0)).alias("n_pos_ge4")
    base = conf.groupBy(*keys).agg(F.sum("n").alias("n"), n_pos, (F.sum(F.col("n") * F.abs(F.col("y_true") - F.col("y_pred_argmax"))) / F.sum("n")).alias("mae"))
    return base.join(weighted_kappa(conf, keys), list(keys)).join(average_precision(oof, keys), list(keys))


def metrics_summary(per_fold: DataFrame) -> DataFrame:
    """(cell, metric, mean, std, n_folds) over folds where the metric is defined; population deviation."""
    long = per_fold.unpivot([*CELL, "fold_id"], list(METRICS), "metric", "value")
    return long.groupBy(*CELL, "metric").agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"), F.count("value").alias("n_folds"))


def contrasts(cells: Sequence[str], families: Sequence[tuple[str, str, str]], floor: str | None = None) -> list[tuple[str, str, str]]:
    """(family, cell_a, cell_b) of the families whose cells are there, and every other cell against `floor`."""
    have = set(cells)
    found = [f for f in families if f[1] in have and f[2] in have]
    if floor in have:
        found += [("vs_floor", c, floor) for c in sorted(have) if c != floor and not c.startswith("dummy")]
    return found


def paired_deltas(per_fold: DataFrame, pairs: Sequence[tuple[str, str, str]], names: Sequence[str] = METRICS) -> DataFrame:
    """(family, cell_a, cell_b, metric, mean_d, std_d, n_folds_paired, frac_d_gt0) over folds where both are defined."""
    d = deltas(per_fold, pairs, names)
    keys = ["family", "cell_a", "cell_b", "metric"]
    return d.groupBy(*keys).agg(F.avg("d").alias("mean_d"), F.stddev_samp("d").alias("std_d"), F.count("*").alias("n_folds_paired"), F.avg((F.col("d") > 0).cast("int")).alias("frac_d_gt0"))


def deltas(per_fold: DataFrame, pairs: Sequence[tuple[str, str, str]], names: Sequence[str] = METRICS) -> DataFrame:
    """(family, cell_a, cell_b, metric, fold_id, d) of defined differences."""
    long = per_fold.unpivot(["cell_id", "fold_id"], list(names), "metric", "value")
    table = per_fold.sparkSession.createDataFrame(list(pairs), "family string, cell_a string, cell_b string")
    a = long.select(F.col("cell_id").alias("cell_a"), "fold_id", "metric", F.col("value").alias("va"))
    b = long.select(F.col("cell_id").alias("cell_b"), "fold_id", "metric", F.col("value").alias("vb"))
    joined = F.broadcast(table).join(a, "cell_a").join(b, ["cell_b", "fold_id", "metric"])
    return joined.withColumn("d", F.col("va") - F.col("vb")).filter("d is not null").select("family", "cell_a", "cell_b", "metric", "fold_id", "d")


def signed_rank_p(ranks: Sequence[int], w: int) -> float:
    """Two-sided p of a sum w of doubled ranks of positive differences, when each rank is signed by a fair coin.

    The distribution of sums up to the nearer tail is built rank by rank, so any number of ranks has an exact p.
    """
    near = min(w, sum(ranks) - w)
    share = np.zeros(near + 1)
    share[0] = 1.0
    for r in ranks:
        share /= 2
        if r <= near:
            share[r:] += share[: near + 1 - r].copy()
    return min(1.0, 2 * float(share.sum()))


def wilcoxon(d: DataFrame, keys: Sequence[str] = ("family", "cell_a", "cell_b", "metric")) -> DataFrame:
    """(keys, n, w_plus, p_value): exact two-sided signed-rank test of d, zeros left out, ties by average ranks.

    A group holds a difference per fold; a group of nulls and zeros only has no row.
    """
    rows = d.filter("d <> 0").withColumn("_a", F.round(F.abs("d"), 12))
    by = Window.partitionBy(*keys)
    rank = F.rank().over(by.orderBy("_a")) + (F.count("*").over(Window.partitionBy(*keys, "_a")) - 1) / 2
    groups = rows.withColumn("_r", (2 * rank).cast("long")).groupBy(*keys).agg(F.count("*").alias("n"), F.sum(F.when(F.col("d") > 0, F.col("_r")).otherwise(0)).alias("_w"), F.sort_array(F.collect_list("_r")).alias("_ranks"))

    def judged(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            p = [signed_rank_p([int(r) for r in ranks], int(w)) for ranks, w in zip(batch["_ranks"], batch["_w"], strict=True)]
            yield batch[[*keys, "n"]].assign(w_plus=batch["_w"] / 2, p_value=np.array(p, float))

    schema = StructType([*[groups.schema[k] for k in (*keys, "n")], StructField("w_plus", DoubleType()), StructField("p_value", DoubleType())])
    return groups.mapInPandas(judged, schema)


def threshold_sweep(oof: DataFrame, keys: Sequence[str] = CELL) -> DataFrame:
    """A row per distinct score as threshold: n_pred_pos, tp, fp, fn, precision, recall, f1 (0 where undefined)."""
    r = _running(score_counts(oof, keys), keys)
    return _rates(r.select(*keys, F.col("score").alias("threshold"), F.col("k").alias("n_pred_pos"), "tp", (F.col("k") - F.col("tp")).alias("fp"), (F.col("p_total") - F.col("tp")).alias("fn")))


def _rates(df: DataFrame) -> DataFrame:
    p = F.when(F.col("n_pred_pos") > 0, F.col("tp") / F.col("n_pred_pos")).otherwise(0.0)
    r = F.when(F.col("tp") + F.col("fn") > 0, F.col("tp") / (F.col("tp") + F.col("fn"))).otherwise(0.0)
    return df.withColumns({"precision": p, "recall": r}).withColumn("f1", F.coalesce(_f1(F.col("precision"), F.col("recall")), F.lit(0.0)))


def threshold_grid(oof: DataFrame, thresholds: Sequence[float], keys: Sequence[str] = CELL) -> DataFrame:
    """The sweep at given thresholds (score >= t): rows are counted by the grid step below them, then summed
    from the top, so no row meets every threshold."""
    grid = sorted(set(thresholds))
    counts = score_counts(oof, keys).withColumn("_step", F.size(F.filter(F.array(*map(F.lit, grid)), lambda t: t <= F.col("score"))))
    steps = counts.groupBy(*keys, "_step").agg(F.sum("n").alias("n"), F.sum("pos").alias("pos"))
    totals = steps.groupBy(*keys).agg(F.sum("pos").alias("p_total"))
    spread = totals.select("*", F.posexplode(F.array(*map(F.lit, grid))).alias("_i", "threshold"))
    joined = spread.withColumn("_step", F.col("_i") + 1).join(steps, [*keys, "_step"], "left")
    up = Window.partitionBy(*keys).orderBy(F.col("_step").desc())
    sums = joined.withColumns({"n_pred_pos": F.sum(F.coalesce("n", F.lit(0))).over(up), "tp": F.sum(F.coalesce("pos", F.lit(0))).over(up)})
    return _rates(sums.select(*keys, "threshold", "n_pred_pos", "tp", (F.col("n_pred_pos") - F.col("tp")).alias("fp"), (F.col("p_total") - F.col("tp")).alias("fn")))


def operating_point(sweep: DataFrame, rule: str = "max_f1", target_recall: float = 0.5, keys: Sequence[str] = CELL) -> DataFrame:
    """One row of the sweep per cell: most F1, or the highest threshold with enough recall; ties to the higher threshold."""
    if rule == "min_recall":
        sweep, order = sweep.filter(F.col("recall") >= target_recall), F.struct("threshold")
    elif rule == "max_f1":
        order = F.struct("f1", "threshold")
    else:
        raise ValueError(f"unknown rule {rule!r}")
    row = F.max_by(F.struct("threshold", "precision", "recall", "f1"), order)
    return sweep.groupBy(*keys).agg(row.alias("_r")).select(*keys, F.lit(rule).alias("rule"), "_r.*")


def argmax_point(oof: DataFrame, keys: Sequence[str] = CELL) -> DataFrame:
    """Precision and recall of a predicted grade of 4 or more."""
    hit, said, true = (F.count_if(c) for c in ((F.col("y_pred_argmax") >= 4) & (F.col("y_true") >= 4), F.col("y_pred_argmax") >= 4, F.col("y_true") >= 4))
    return oof.groupBy(*keys).agg(said.alias("n_pred_pos"), hit.alias("tp"), F.try_divide(hit, said).alias("precision"), F.try_divide(hit, true).alias("recall"))


def attribution_agg(wide: DataFrame, keys: Sequence[str] = ("fold_id",)) -> DataFrame:
    """(keys, feature, grade, mean_abs, mean) from columns shap__{feature}__grade{g}; a feature may hold `__`."""
    columns = [c for c in wide.columns if c.startswith("shap__")]
    long = wide.unpivot(list(keys), columns, "name", "value")
    part = lambda i: F.regexp_extract("name", r"^shap__(.+)__grade(\d)$", i)
    return long.groupBy(*keys, part(1).alias("feature"), part(2).cast("int").alias("grade")).agg(F.avg(F.abs("value")).alias("mean_abs"), F.avg("value").alias("mean"))


def importance_rank(agg: DataFrame, keys: Sequence[str] = ("fold_id", "grade")) -> DataFrame:
    """Dense rank by mean_abs, and a full order with ties by feature."""
    down = Window.partitionBy(*keys).orderBy(F.col("mean_abs").desc())
    return agg.withColumns({"dense_rank": F.dense_rank().over(down), "ordinal_rank": F.row_number().over(Window.partitionBy(*keys).orderBy(F.col("mean_abs").desc(), "feature"))})
