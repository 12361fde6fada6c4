"""Queries of the evaluation and curve operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewall.operators import clean, curves, evaluate
from tidewall.plans.registry import query, rounded
from tidewall.plans.standins import oracle, standin

_O = oracle("si_oof")
_C = "cell_id, model, feature_set"
GRID = [0.0, 0.1, 0.2, 0.25, 0.3, 0.4, 0.5, 0.6, 0.75, 1.0]
FAMILIES = [("capacity", "cell_1", "cell_0"), ("exposure", "cell_2", "cell_0"), ("absent", "cell_9", "cell_0")]
PAIRS = evaluate.contrasts(["cell_0", "cell_1", "cell_2"], FAMILIES, "cell_0")
_PAIRS = "pairs as (select * from (values " + ", ".join(f"('{f}', '{a}', '{b}')" for f, a, b in PAIRS) + ") t(family, cell_a, cell_b))"


def _metrics_sql(keys: str) -> str:
    return f"""cf as (select {keys}, y_true, y_pred_argmax, count(*) as n from si_oof group by all),
    mg as (select {keys}, sum(n) as n, sum(n) filter (y_true >= 4) as np, sum(n * (y_true - y_pred_argmax) ** 2) as o, sum(n * abs(y_true - y_pred_argmax)) as ab from cf group by all),
    rr as (select {keys}, y_true, sum(n) as r from cf group by all), cc as (select {keys}, y_pred_argmax, sum(n) as c from cf group by all),
    ex as (select {keys}, sum(r * c * (y_true - y_pred_argmax) ** 2) as e from rr join cc using ({keys}) group by all),
    sc as (select {keys}, score_ge4 as s, count(*) as n, sum(y_ge4) as pos from si_oof group by all),
    ru as (select *, sum(n) over w as k, sum(pos) over w as tp, sum(pos) over (partition by {keys}) as p from sc window w as (partition by {keys} order by s desc)),
    ap as (select {keys}, sum(pos * tp / k) / max(p) as ap from ru group by all),
    me as (select {keys}, mg.n, coalesce(np, 0) as n_pos_ge4, 1 - o / (e / mg.n) as qwk, ap as pr_auc_ge4, ab / mg.n as mae from mg join ex using ({keys}) join ap using ({keys}))"""


_FOLD = _C + ", fold_id"
_LONG = "lo as (unpivot me on qwk, pr_auc_ge4, mae into name metric value value)"
_DELTA = "de as (select family, cell_a, cell_b, a.metric, a.fold_id, a.value - b.value as d from pairs join lo a on a.cell_id = cell_a join lo b on b.cell_id = cell_b and a.fold_id = b.fold_id and a.metric = b.metric)"


def _oof(spark, d):
    return standin(spark, d, "si_oof")


@query(_O + ", " + _metrics_sql(_FOLD) + f" select {_FOLD}, n, n_pos_ge4, round(qwk, 6) as qwk, round(pr_auc_ge4, 6) as pr_auc_ge4, round(mae, 6) as mae from me")
def h_metrics_per_fold(spark: SparkSession, d: str) -> DataFrame:
    return rounded(evaluate.metrics(_oof(spark, d), (*evaluate.CELL, "fold_id")))


@query(_O + ", " + _metrics_sql(_C) + f" select {_C}, n, round(qwk, 6) as qwk, round(pr_auc_ge4, 6) as pr_auc_ge4, round(mae, 6) as mae from me")
def h_metrics_pooled(spark: SparkSession, d: str) -> DataFrame:
    return rounded(evaluate.metrics(_oof(spark, d)).drop("n_pos_ge4"))


@query(_O + ", " + _metrics_sql(_FOLD) + ", " + _LONG + f" select {_C}, metric, round(avg(value), 6) as mean, round(stddev_pop(value), 6) as std, count(value) as n_folds from lo group by all")
def h_metrics_summary(spark: SparkSession, d: str) -> DataFrame:
    return rounded(evaluate.metrics_summary(evaluate.metrics(_oof(spark, d), (*evaluate.CELL, "fold_id"))))


@query(_O + ", " + _metrics_sql(_C) + f" select {_C}, round(qwk, 6) as qwk from me")
def h_qwk(spark: SparkSession, d: str) -> DataFrame:
    return rounded(evaluate.weighted_kappa(evaluate.confusion(_oof(spark, d))))


@query(_O + ", " + _metrics_sql(_C) + f" select {_C}, round(pr_auc_ge4, 6) as pr_auc_ge4 from me")
def h_average_precision(spark: SparkSession, d: str) -> DataFrame:
    return rounded(evaluate.average_precision(_oof(spark, d)))


@query(
    _O + f""", g as (select g from (values (1), (2), (3), (4), (5)) t(g)), m as (select {_C}, g, count(*) filter (y_true = g) as s, count(*) filter (y_pred_argmax = g) as p, count(*) filter (y_true = g and y_pred_argmax = g) as tp from si_oof cross join g group by all),
    f as (select {_C}, avg(2 * tp / (s + p)) as macro_f1 from m where s + p > 0 group by all)
    select {_C}, count(*) as n, round(avg(abs(y_true - y_pred_argmax)), 6) as mae, round(avg(y_pred_argmax - y_true), 6) as bias, round(avg(cast(y_true = y_pred_argmax as int)), 6) as exact,
      round(avg(cast(abs(y_true - y_pred_argmax) <= 1 as int)), 6) as within_1, round(any_value(macro_f1), 6) as macro_f1 from si_oof join f using ({_C}) group by all"""
)
def h_label_metrics(spark: SparkSession, d: str) -> DataFrame:
    return rounded(evaluate.label_metrics(evaluate.confusion(_oof(spark, d))))


_GRID25 = "g as (select unnest([1, 2, 3, 4, 5]) as g)"


@query(_O + f", {_GRID25}, k as (select distinct {_C} from si_oof), c as (select {_C}, y_true, y_pred_argmax, count(*) as n from si_oof group by all) select k.*, a.g as y_true, b.g as y_pred_argmax, coalesce(n, 0) as n from k cross join g a cross join g b left join c on c.cell_id = k.cell_id and c.y_true = a.g and c.y_pred_argmax = b.g")
def h_confusion(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.confusion(_oof(spark, d))


@query(_O + f", {_GRID25} select {_C}, g as y_true, " + ", ".join(f'count(*) filter (y_true = g and y_pred_argmax = {k}) as "{k}"' for k in range(1, 6)) + " from si_oof cross join g group by all")
def h_confusion_wide(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.confusion_wide(evaluate.confusion(_oof(spark, d)))


_PG = f"{_GRID25}, m as (select {{k}}, g as grade, count(*) filter (y_true = g) as support, count(*) filter (y_pred_argmax = g) as n_pred, count(*) filter (y_true = g and y_pred_argmax = g) as tp from si_oof cross join g group by all)"


@query(_O + ", " + _PG.format(k=_C) + ", r as (select *, case when n_pred > 0 then tp / n_pred end as p, case when support > 0 then tp / support end as r from m)" + f" select {_C}, grade, support, n_pred, tp, round(p, 6) as precision, round(r, 6) as recall, round(case when p + r > 0 then 2 * p * r / (p + r) end, 6) as f1 from r")
def h_per_grade(spark: SparkSession, d: str) -> DataFrame:
    return rounded(evaluate.per_grade(_oof(spark, d)))


@query(_O + ", " + _PG.format(k=_FOLD) + f" select {_FOLD}, grade, round(case when support > 0 then tp / support end, 6) as recall, round(case when support > 0 then case when n_pred > 0 then tp / n_pred else 0 end end, 6) as precision, round(case when support > 0 then case when tp > 0 then 2 * tp / (support + n_pred) else 0 end end, 6) as f1 from m")
def h_grade_scores(spark: SparkSession, d: str) -> DataFrame:
    return rounded(evaluate.grade_scores(_oof(spark, d)))


@query(_O + ", " + ", ".join([_metrics_sql(_FOLD), _LONG, _PAIRS, _DELTA]) + " select family, cell_a, cell_b, metric, round(avg(d), 6) as mean_d, round(stddev_samp(d), 6) as std_d, count(*) as n_folds_paired, round(avg(cast(d > 0 as int)), 6) as frac_d_gt0 from de where d is not null group by all")
def h_paired_deltas(spark: SparkSession, d: str) -> DataFrame:
    return rounded(evaluate.paired_deltas(evaluate.metrics(_oof(spark, d), (*evaluate.CELL, "fold_id")), PAIRS))


@query(
    _O + ", " + ", ".join([_metrics_sql(_FOLD), _LONG, _PAIRS, _DELTA]) + """, nz as (select *, round(abs(d), 12) as a from de where d <> 0),
    rk as (select *, rank() over (partition by family, cell_a, cell_b, metric order by a) + (count(*) over (partition by family, cell_a, cell_b, metric, a) - 1) / 2 as r from nz),
    gr as (select family, cell_a, cell_b, metric, count(*) as n, coalesce(sum(r) filter (d > 0), 0) as w, list(r) as rs from rk group by all),
    ms as (select *, unnest(range(0, cast(2 ** n as bigint))) as m from gr),
    ts as (select family, cell_a, cell_b, metric, n, w, list_sum(list_transform(rs, lambda x, i: case when (m >> (i - 1)) & 1 = 1 then x else 0.0 end)) as t from ms)
    select family, cell_a, cell_b, metric, n, w as w_plus, round(least(1.0, 2 * least(avg(cast(t <= w as int)), avg(cast(t >= w as int)))), 9) as p_value from ts group by all"""
)
def h_wilcoxon(spark: SparkSession, d: str) -> DataFrame:
    return rounded(evaluate.wilcoxon(evaluate.deltas(evaluate.metrics(_oof(spark, d), (*evaluate.CELL, "fold_id")), PAIRS)), digits=9)


_SWEEP = f"""sc as (select {_C}, score_ge4 as threshold, count(*) as n, sum(y_ge4) as pos from si_oof group by all),
    ru as (select {_C}, threshold, sum(n) over w as k, sum(pos) over w as tp, sum(pos) over (partition by cell_id) as p from sc window w as (partition by cell_id order by threshold desc)),
    sw as (select {_C}, threshold, cast(k as bigint) as n_pred_pos, cast(tp as bigint) as tp, cast(k - tp as bigint) as fp, cast(p - tp as bigint) as fn, tp / k as precision, case when p > 0 then tp / p else 0 end as recall from ru),
    sf as (select *, case when precision + recall > 0 then 2 * precision * recall / (precision + recall) else 0 end as f1 from sw)"""
_SW_OUT = "round(precision, 6) as precision, round(recall, 6) as recall, round(f1, 6) as f1"


@query(_O + ", " + _SWEEP + f" select {_C}, threshold, n_pred_pos, tp, fp, fn, {_SW_OUT} from sf")
def h_threshold_sweep(spark: SparkSession, d: str) -> DataFrame:
    return rounded(evaluate.threshold_sweep(_oof(spark, d)))


@query(
    _O + f""", t as (select unnest({GRID}) as threshold), b as (select {_C}, threshold, count(*) filter (score_ge4 >= threshold) as k, count(*) filter (score_ge4 >= threshold and y_ge4 = 1) as tp, sum(y_ge4) as p from si_oof cross join t group by all),
    sw as (select *, case when k > 0 then tp / k else 0 end as precision, case when p > 0 then tp / p else 0 end as recall from b), sf as (select *, case when precision + recall > 0 then 2 * precision * recall / (precision + recall) else 0 end as f1 from sw)
    select {_C}, cast(threshold as double) as threshold, k as n_pred_pos, tp, k - tp as fp, cast(p - tp as bigint) as fn, {_SW_OUT} from sf"""
)
def h_threshold_grid(spark: SparkSession, d: str) -> DataFrame:
    return rounded(evaluate.threshold_grid(_oof(spark, d), GRID))


@query(
    _O + ", " + _SWEEP + f""" select {_C}, 'max_f1' as rule, threshold, {_SW_OUT} from (select *, row_number() over (partition by cell_id order by f1 desc, threshold desc) as rn from sf) where rn = 1
    union all select {_C}, 'min_recall', threshold, {_SW_OUT} from (select *, row_number() over (partition by cell_id order by threshold desc) as rn from sf where recall >= 0.5) where rn = 1"""
)
def h_operating_point(spark: SparkSession, d: str) -> DataFrame:
    sweep = evaluate.threshold_sweep(_oof(spark, d))
    return rounded(evaluate.operating_point(sweep).unionByName(evaluate.operating_point(sweep, "min_recall", 0.5)))


@query(_O + f" select {_C}, count(*) filter (y_pred_argmax >= 4) as n_pred_pos, count(*) filter (y_pred_argmax >= 4 and y_true >= 4) as tp, round(count(*) filter (y_pred_argmax >= 4 and y_true >= 4) / nullif(count(*) filter (y_pred_argmax >= 4), 0), 6) as precision, round(count(*) filter (y_pred_argmax >= 4 and y_true >= 4) / nullif(count(*) filter (y_true >= 4), 0), 6) as recall from si_oof group by all")
def h_argmax_point(spark: SparkSession, d: str) -> DataFrame:
    return rounded(evaluate.argmax_point(_oof(spark, d)))


_CUM = "cu as (select cell_id, asset_id, 1.0::double as e0, round(1 - proba_1, 3) as e1, round(proba_3 + proba_4 + proba_5, 3) as e2, round((proba_4 + proba_5) * 1.2, 3) as e3, round(proba_5 * 1.5, 3) as e4, 0.0::double as e5 from si_oof)"
_CLASS = _CUM + ", ra as (select cell_id, asset_id, e0 - e1 as r1, e1 - e2 as r2, e2 - e3 as r3, e3 - e4 as r4, e4 - e5 as r5 from cu), cl as (select *, " + " + ".join(f"greatest(0, r{g})" for g in range(1, 6)) + " as s, " + " or ".join(f"r{g} < 0" for g in range(1, 6)) + " as inverted from ra)"


def _cumulative(spark: SparkSession, d: str) -> DataFrame:
    p = [F.col(f"proba_{g}") for g in range(1, 6)]
    exceed = [F.round(1 - p[0], 3).alias("e1"), F.round(p[2] + p[3] + p[4], 3).alias("e2"), F.round((p[3] + p[4]) * 1.2, 3).alias("e3"), F.round(p[4] * 1.5, 3).alias("e4")]
    return evaluate.cumulative_to_class(_oof(spark, d).select("cell_id", "asset_id", *exceed), ["e1", "e2", "e3", "e4"])


@query(_O + ", " + _CLASS + " select cell_id, asset_id, " + ", ".join(f"round(greatest(0, r{g}) / s, 6) as proba_{g}" for g in range(1, 6)) + ", inverted from cl")
def h_cumulative_to_class(spark: SparkSession, d: str) -> DataFrame:
    return rounded(_cumulative(spark, d).select("cell_id", "asset_id", *[f"proba_{g}" for g in range(1, 6)], "inverted"))


@query(_O + ", " + _CLASS + " select cell_id, count(*) as n, round(avg(cast(inverted as int)), 6) as inversion_rate from cl group by 1")
def h_inversion_rates(spark: SparkSession, d: str) -> DataFrame:
    return rounded(evaluate.inversion_rates(_cumulative(spark, d), ["cell_id"]))


@query(_O + " select cell_id, asset_id, round(proba_4, 6) as proba_1, 0.0::double as proba_2, round(proba_1, 6) as proba_3, round(proba_2, 6) as proba_4, 0.0::double as proba_5, abs(proba_4 + proba_1 + proba_2 - 1) > 1e-6 as bad_sum from si_oof")
def align_proba(spark: SparkSession, d: str) -> DataFrame:
    df = _oof(spark, d).select("cell_id", "asset_id", F.array("proba_1", "proba_2", "proba_4").alias("p"))
    return rounded(evaluate.align_proba(df, "p", [3, 4, 1]).drop("p"))


@query("select unnest(['y_true_domain', 'y_pred_domain', 'sums_to_one', 'unique_cell_id_asset_id', 'equal_counts']) as rule, cast(0 as bigint) as n_bad")
def h_validate_oof(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.validate_oof(_oof(spark, d))


_SHAP = "sh as (select l_linenumber as fold_id, " + ", ".join(f"(l_quantity - {20 + g}) / {g} as \"shap__qty__grade{g}\", (l_discount - 0.0{g}) * 10 as \"shap__a__b__grade{g}\"" for g in range(1, 6)) + " from lineitem)"
_SHAP_AGG = _SHAP + ", un as (unpivot sh on columns('shap__.*') into name name value value), ag as (select fold_id, regexp_extract(name, '^shap__(.+)__grade(\\d)$', 1) as feature, cast(regexp_extract(name, '^shap__(.+)__grade(\\d)$', 2) as int) as grade, round(avg(abs(value)), 6) as mean_abs, round(avg(value), 6) as mean from un group by all)"


def _attributions(spark: SparkSession, d: str) -> DataFrame:
    columns = [x for g in range(1, 6) for x in (((F.col("l_quantity") - (20 + g)) / g).alias(f"shap__qty__grade{g}"), ((F.col("l_discount") - F.lit(float(f"0.0{g}"))) * 10).alias(f"shap__a__b__grade{g}"))]
    return rounded(evaluate.attribution_agg(spark.read.parquet(f"{d}/lineitem.parquet").select(F.col("l_linenumber").alias("fold_id"), *columns)))


@query("with " + _SHAP_AGG + " select * from ag")
def h_attribution_agg(spark: SparkSession, d: str) -> DataFrame:
    return _attributions(spark, d)


@query("with " + _SHAP_AGG + " select *, cast(dense_rank() over (partition by fold_id, grade order by mean_abs desc) as int) as dense_rank, cast(row_number() over (partition by fold_id, grade order by mean_abs desc, feature) as int) as ordinal_rank from ag")
def h_importance_rank(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.importance_rank(_attributions(spark, d))


# The medium curves of the second regime, as the SQL holds them.
_CURVES = """cv as (select * from (values
  ('embankment', 'fluvial', 'varying_core', 'narrow', 0, 15, 30, 60, 80), ('embankment', 'coastal', 'varying_core', 'narrow', 0, 14, 28, 40, 50),
  ('vertical_wall', 'fluvial', 'concrete_masonry', 'na', 0, 20, 45, 70, 90), ('vertical_wall', 'coastal', 'concrete_masonry', 'na', 0, 15, 40, 55, 70),
  ('flood_gate', 'fluvial', 'metal', 'na', 0, 18, 34, 42, 50), ('flood_gate', 'coastal', 'metal', 'na', 0, 15, 23, 27, 30),
  ('demountable_defence', 'fluvial', 'metal', 'na', 0, 5, 10, 45, 55), ('beach', 'coastal', 'shingle/sand', 'na', 0, 16, 30, 50, 75),
  ('dunes', 'coastal', 'na', 'na', 0, 15, 35, 60, 80), ('weir', 'fluvial', 'all', 'na', 0, 30, 50, 70, 90)) t(halcrow_type, environment, material, width, t1, t2, t3, t4, t5))"""


def _mapping(column: str, values: dict) -> str:
    return f"case {column} " + " ".join(f"when '{k}' then '{v}'" for k, v in values.items() if v) + " end"


_AGE = "case when (inspection_date - asset_start_date) / 365.25 between 0 and 150 then (inspection_date - asset_start_date) / 365.25 end"
_SCORED = oracle("si_asset", "si_latest") + ", " + _CURVES + f""", ke as (select a.asset_id, sub_type, {_AGE} as age,
      {_mapping("sub_type", {k: v[0] for k, v in curves.SUB_TYPES.items()})} as halcrow_type, {_mapping("sub_type", {k: v[1] for k, v in curves.SUB_TYPES.items()})} as material, {_mapping("sub_type", {k: v[2] for k, v in curves.SUB_TYPES.items()})} as width,
      coalesce({_mapping("sub_type", {k: v[3] for k, v in curves.SUB_TYPES.items()})}, {_mapping("protection_type", curves.ENVIRONMENTS)}, 'fluvial') as environment from si_asset a left join si_latest l on a.asset_id = l.asset_id),
    ju as (select ke.*, t1, t2, t3, t4, t5 from ke left join cv on cv.halcrow_type = ke.halcrow_type and cv.material = ke.material and cv.width = ke.width and cv.environment = ke.environment),
    st as (select *, case when halcrow_type is null then 'unmapped_type' when t2 is null then 'no_curve' when age is null then 'no_age' else 'scored' end as curve_status,
      greatest(1, least(5, case when age >= t5 then 5 when age >= t4 then 4 + case when t5 > t4 then (age - t4) / (t5 - t4) else 0 end when age >= t3 then 3 + case when t4 > t3 then (age - t3) / (t4 - t3) else 0 end
        when age >= t2 then 2 + case when t3 > t2 then (age - t2) / (t3 - t2) else 0 end else 1 + case when t2 > t1 then (age - t1) / (t2 - t1) else 0 end end)) as g from ju)"""


def _score(spark: SparkSession, d: str) -> DataFrame:
    joined = standin(spark, d, "si_asset").join(standin(spark, d, "si_latest").select("asset_id", "inspection_date"), "asset_id", "left")
    assets = joined.withColumn("age_years", clean.age_years(F.col("inspection_date"), F.col("asset_start_date")))
    return curves.curve_score(assets, curves.curve_table(spark))


@query(_SCORED + " select asset_id, sub_type, curve_status, round(age, 6) as age_years, round(case when curve_status = 'scored' then g end, 6) as pred_grade_cont, cast(case when curve_status = 'scored' then least(5, floor(g)) end as int) as pred_grade from st")
def h_curve_score(spark: SparkSession, d: str) -> DataFrame:
    return rounded(_score(spark, d))


@query(_SCORED + " select sub_type, curve_status, count(*) as n, round(count(*) / (select count(*) from st), 4) as share from st group by 1, 2")
def curve_coverage(spark: SparkSession, d: str) -> DataFrame:
    return curves.curve_coverage(_score(spark, d))


def _all_curves_sql() -> str:
    rows = ", ".join(str(r) for r in curves.curve_rows())
    return f"cv as (select * from (values {rows}) t(halcrow_type, environment, material, width, rate, regime, t1, t2, t3, t4, t5))"


@query(oracle("si_asset") + ", " + _all_curves_sql() + f", n as (select {_mapping('sub_type', {k: v[0] for k, v in curves.SUB_TYPES.items()})} as halcrow_type, {_mapping('sub_type', {k: v[1] for k, v in curves.SUB_TYPES.items()})} as material, coalesce({_mapping('sub_type', {k: v[3] for k, v in curves.SUB_TYPES.items()})}, {_mapping('protection_type', curves.ENVIRONMENTS)}, 'fluvial') as environment, count(*) as n from si_asset group by all) select halcrow_type, environment, material, width, rate, cast(regime as int) as regime, t1::double as t1, t2::double as t2, t3::double as t3, t4::double as t4, t5::double as t5, coalesce(n, 0) as n from cv left join n using (halcrow_type, environment, material)")
def curve_table(spark: SparkSession, d: str) -> DataFrame:
    """All curves, with how many assets ask for each."""
    assets = standin(spark, d, "si_asset").withColumns(curves.curve_key(F.col("sub_type"), F.col("protection_type")))
    counts = assets.groupBy(*curves.KEY).agg(F.count("*").alias("n"))
    return curves.curve_table(spark).join(counts, list(curves.KEY), "left").withColumn("n", F.coalesce("n", F.lit(0).cast("long")))
