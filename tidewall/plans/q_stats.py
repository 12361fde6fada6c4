"""Queries of the exploratory statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewall.operators import stats
from tidewall.plans.registry import query, rounded
from tidewall.plans.standins import oracle, standin

_J = oracle("si_asset", "si_latest") + ", j as (select a.*, l.inspection_date, l.grade, l.price from si_asset a left join si_latest l on a.asset_id = l.asset_id)"


def _j(spark: SparkSession, d: str) -> DataFrame:
    return standin(spark, d, "si_asset").join(standin(spark, d, "si_latest").select("asset_id", "inspection_date", "grade", "price"), "asset_id", "left")


def _rank(c: str, t: str, by: str = "") -> str:
    part = f"partition by {by} " if by else ""
    return f"rank() over ({part}order by {c}) + (count(*) over (partition by {by + ', ' if by else ''}{c}) - 1) / 2.0"


@query(_J + " " + " union all ".join(f"select '{c}' as \"column\", count(*) filter ({c} is null) as n_null, round(100.0 * count(*) filter ({c} is null) / count(*), 6) as pct_null, round(100 - 100.0 * count(*) filter ({c} is null) / count(*), 6) as pct_coverage from j" for c in ("sub_type", "design_sop", "actual_dcl", "asset_start_date")))
def k_missingness(spark: SparkSession, d: str) -> DataFrame:
    return rounded(stats.missingness(_j(spark, d), ["sub_type", "design_sop", "actual_dcl", "asset_start_date"]))


@query("with c as (select p_name as value, count(*) as n from part group by 1) select value, n, round(100 * n / sum(n) over (), 6) as pct, round(100 * sum(n) over (order by n desc, value) / sum(n) over (), 6) as cum_pct, n / sum(n) over () < 0.01 or n < 50 as rare from c")
def k_value_counts(spark: SparkSession, d: str) -> DataFrame:
    return rounded(stats.value_counts(spark.read.parquet(f"{d}/part.parquet"), "p_name"))


@query("with t as (select case when c_custkey % 5 = 0 then null when c_custkey % 5 = 1 then '  ' when c_custkey % 5 = 2 then '999' when c_custkey % 7 = 0 then ' 888' else c_mktsegment end as v from customer), s as (select case when v is null then 'null' when trim(v) = '' then 'blank' when trim(v) = '888' then 'not_inspected' when trim(v) = '999' then 'unknown' else 'value' end as status from t) select status, count(*) as n, round(100 * count(*) / sum(count(*)) over (), 6) as pct from s group by 1")
def k_status_breakdown(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey")
    v = F.when(k % 5 == 0, None).when(k % 5 == 1, "  ").when(k % 5 == 2, "999").when(k % 7 == 0, " 888").otherwise(F.col("c_mktsegment"))
    return rounded(stats.status_breakdown(spark.read.parquet(f"{d}/customer.parquet").withColumn("v", v), "v", {"888": "not_inspected", "999": "unknown"}))


@query("""with t as (select case when o_orderkey % 9 = 0 then '' when o_orderkey % 101 = 0 then 'about ' || cast(year(o_orderdate) as varchar) else strftime(o_orderdate, '%d/%m/%Y') end as v from orders), x as (select distinct v from t where trim(v) <> '' and not regexp_matches(v, '^\\d{2}/\\d{2}/\\d{4}$') order by v limit 5)
    select count(*) filter (trim(v) <> '') as n_filled, count(*) filter (regexp_matches(v, '^\\d{2}/\\d{2}/\\d{4}$')) as n_match, count(*) filter (trim(v) <> '' and not regexp_matches(v, '^\\d{2}/\\d{2}/\\d{4}$')) as n_exceptions, (select string_agg(v, '|' order by v) from x) as examples from t""")
def k_pattern_audit(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    v = F.when(k % 9 == 0, "").when(k % 101 == 0, F.concat(F.lit("about "), F.year("o_orderdate").cast("string"))).otherwise(F.date_format("o_orderdate", "dd/MM/yyyy"))
    return stats.pattern_audit(spark.read.parquet(f"{d}/orders.parquet").select(v.alias("v")), "v", r"^\d{2}/\d{2}/\d{4}$")


@query(_J + ", c as (select coalesce(sub_type, 'total') as sub_type, " + ", ".join(f'count(*) filter (grade = {g}) as "{g}"' for g in range(1, 6)) + ", count(*) as total from j where sub_type is not null and grade in (1, 2, 3, 4, 5) group by rollup (sub_type)) select *, " + ", ".join(f'round(100.0 * "{g}" / total, 6) as pct_{g}' for g in range(1, 6)) + " from c")
def k_crosstab(spark: SparkSession, d: str) -> DataFrame:
    return rounded(stats.crosstab(_j(spark, d), "sub_type", "grade", [1, 2, 3, 4, 5]))


@query("with t as (select case when s_suppkey % 3 = 0 then upper(substr(s_name, 1, 17)) else ' ' || substr(s_name, 1, 17) end as v from supplier) select lower(trim(v)) as key, count(distinct v) as n_variants, count(*) as n from t group by 1 having count(distinct v) > 1")
def k_text_variants(spark: SparkSession, d: str) -> DataFrame:
    name = F.substring("s_name", 1, 17)
    return stats.text_variants(spark.read.parquet(f"{d}/supplier.parquet").select(F.when(F.col("s_suppkey") % 3 == 0, F.upper(name)).otherwise(F.concat(F.lit(" "), name)).alias("v")), "v")


_MOM = "select '{c}' as \"column\", count(v) as n, round(avg(v), 6) as mean, round(stddev_samp(v), 6) as sd, round(min(v), 6) as min, round(quantile_cont(v, 0.25), 6) as q25, round(quantile_cont(v, 0.5), 6) as median, round(quantile_cont(v, 0.75), 6) as q75, round(max(v), 6) as max, round(avg((v - m) ** 3) / (avg((v - m) ** 2) ** 1.5), 6) as skew, round(avg((v - m) ** 4) / (avg((v - m) ** 2) ** 2) - 3, 6) as kurtosis, round(avg((l - lm) ** 3) / (avg((l - lm) ** 2) ** 1.5), 6) as skew_log1p from (select v, avg(v) over () as m, l, avg(l) over () as lm from (select {c}::double as v, case when {c} > -1 then ln(1 + {c}) end as l from j where {c} is not null))"


@query(_J + " " + " union all ".join(_MOM.format(c=c) for c in ("asset_length", "actual_dcl", "grade")))
def k_distribution(spark: SparkSession, d: str) -> DataFrame:
    df = _j(spark, d).select(*[F.col(c).cast("double") for c in ("asset_length", "actual_dcl", "grade")])
    return rounded(stats.distribution(df, df.columns))


@query(_J + " " + " union all ".join(f"select '{c}' as \"column\", count(*) filter ({c} in (9999, 10000)) as n_sentinel, count(*) filter ({c} <= 0) as n_non_positive, count(*) filter ({c} > 90) as n_over from j" for c in ("design_sop", "actual_dcl")))
def k_sentinel_scan(spark: SparkSession, d: str) -> DataFrame:
    return stats.sentinel_scan(_j(spark, d), ["design_sop", "actual_dcl"], [9999, 10000], 90)


@query(_J + " (select 'top' as \"end\", asset_id, asset_length as value from j order by asset_length desc, asset_id limit 10) union all (select 'bottom', asset_id, asset_length from j order by asset_length, asset_id limit 10)")
def k_extremes(spark: SparkSession, d: str) -> DataFrame:
    return stats.extremes(_j(spark, d), "asset_id", "asset_length")


@query(_J + " " + " union all ".join(f"select '{n}' as rule, count(*) filter ({c}) as n_broken, round(100.0 * count(*) filter ({c}) / count(*), 6) as pct from j" for n, c in (("below_zero", "actual_dcl < 0"), ("gap", "abs(actual_dcl - design_sop) > 2"), ("late_start", "asset_start_date > inspection_date"))))
def k_rule_checks(spark: SparkSession, d: str) -> DataFrame:
    rules = {"below_zero": F.col("actual_dcl") < 0, "gap": F.abs(F.col("actual_dcl") - F.col("design_sop")) > 2, "late_start": F.col("asset_start_date") > F.col("inspection_date")}
    return rounded(stats.rule_checks(_j(spark, d), rules))


_CORR = ("asset_length", "actual_dcl", "price", "grade")


def _pair_sql(x: str, y: str) -> str:
    e = lambda c: f"ln(1 + {c})" if c == "asset_length" else f"{c}::double"
    inner = f"select {e(x)} as a, {e(y)} as b from j where {x} is not null and {y} is not null"
    return f"select '{x}' as x, '{y}' as y, count(*) as n, round(corr(a, b), 6) as pearson, round(corr(ra, rb), 6) as spearman from (select a, b, {_rank('a', '')} as ra, {_rank('b', '')} as rb from ({inner}))"


@query(_J + " " + " union all ".join(_pair_sql(x, y) for x in _CORR for y in _CORR))
def k_corr_matrix(spark: SparkSession, d: str) -> DataFrame:
    return rounded(stats.corr_matrix(_j(spark, d), _CORR, ["asset_length"]))


_BLOCK = (("asset_length", "price"), ("actual_dcl", "design_sop", "grade"))


def _block_sql() -> str:
    names = [c for side in _BLOCK for c in side]
    known = " and ".join(f"{c} is not null" for c in names)
    ranks = ", ".join(f"{_rank(c, '')} as r_{c}" for c in names)
    cells = " union all ".join(f"select '{x}' as x, '{y}' as y, count(*) as n, round(corr(r_{x}, r_{y}), 6) as spearman from ranked" for x in _BLOCK[0] for y in _BLOCK[1])
    return f"{_J}, complete as (select * from j where {known}), ranked as (select {ranks} from complete) {cells}"


@query(_block_sql())
def k_cross_corr(spark: SparkSession, d: str) -> DataFrame:
    """Rank correlations of one block of measures with another, over the rows where all are known."""
    return rounded(stats.cross_corr(_j(spark, d), *_BLOCK))


#: P(|Z| > z): the series of the normal integral.
_NORMAL_TAIL = "case when z > 7 then 0.0 else greatest(0, 1 - 2 * exp(-z * z / 2) / sqrt(2 * pi()) * list_sum(list_transform(range(0, 80), lambda k: power(z, 2 * k + 1) * power(2, k) * gamma(k + 1) / gamma(2 * k + 2)))) end"


@query(_J + f", e as (select 'ALL' as g, asset_length, grade from j where grade is not null union all select sub_type, asset_length, grade from j where grade is not null and sub_type is not null) select \"group\", n, round(rho, 6) as rho, round({_NORMAL_TAIL}, 6) as p from (select *, abs(rho) * sqrt(n - 1) as z from (select g as \"group\", count(*) as n, corr(ra, rb) as rho from (select g, {_rank('asset_length', '', 'g')} as ra, {_rank('grade', '', 'g')} as rb from e) group by 1))")
def k_group_spearman(spark: SparkSession, d: str) -> DataFrame:
    return rounded(stats.group_spearman(_j(spark, d), "sub_type", "asset_length", "grade"))


@query(_J + """, k as (select actual_dcl as v, grade as t from j where actual_dcl is not null and grade is not null), e as (select quantile_cont(v, [0, 0.25, 0.5, 0.75, 1.0]) as e, avg(cast(t >= 4 as int)) as a from k),
    b as (select v, t, e, a, greatest(1, len(list_filter(e, lambda x: x < v))) as bin from k cross join e)
    select cast(bin as int) as bin, round(e[bin], 6) as low, round(e[bin + 1], 6) as high, count(*) as n, round(avg(t), 6) as mean_target, round(avg(cast(t >= 4 as int)), 6) as share_positive, round(avg(cast(t >= 4 as int)) / any_value(a), 6) as lift from b group by bin, e""")
def k_quantile_lift(spark: SparkSession, d: str) -> DataFrame:
    return rounded(stats.quantile_lift(_j(spark, d), "actual_dcl", "grade"))


@query(_J + " select sub_type, design_sop > 100 as exposed, count(*) as n, round(avg(grade), 6) as mean_target, round(avg(cast(grade >= 4 as int)), 6) as share_positive from j group by 1, 2")
def k_exposure_split(spark: SparkSession, d: str) -> DataFrame:
    return rounded(stats.exposure_split(_j(spark, d), F.col("design_sop") > 100, "grade", ["sub_type"]))


def _target_clauses(f: str) -> str:
    return f"""k_{f} as (select {f}::double as v, grade::double as t from j where {f} is not null and grade is not null),
      r_{f} as (select corr(ra, rb) as rho, avg(cast(t >= 4 as int)) as prev from (select t, {_rank('v', '')} as ra, {_rank('t', '')} as rb from k_{f})),
      c_{f} as (select v, count(*) as n, sum(cast(t >= 4 as int)) as pos, any_value(rho) as rho from k_{f} cross join r_{f} group by v),
      u_{f} as (select pos, sum(n) over w as k, sum(pos) over w as tp from c_{f} window w as (order by case when rho < 0 then v else -v end)),
      a_{f} as (select sum(pos * tp / k) / sum(pos) as ap from u_{f})"""


@query(_J + ", " + ", ".join(_target_clauses(f) for f in ("asset_length", "price")) + " " + " union all ".join(f"select '{f}' as feature, (select count(*) from k_{f}) as n, round(rho, 6) as rho, sign(rho)::double as sign, round(ap, 6) as ap, round(prev, 6) as prevalence, round(ap / prev, 6) as ap_lift from r_{f}, a_{f}" for f in ("asset_length", "price")))
def k_target_stats(spark: SparkSession, d: str) -> DataFrame:
    return rounded(stats.target_stats(_j(spark, d), ["asset_length", "price"], "grade"))


def k_target_bootstrap(spark: SparkSession, d: str) -> DataFrame:
    """With bootstrap intervals, ranked anew in each resample; its resamples are held against numpy in the tests."""
    return rounded(stats.target_stats(_j(spark, d), ["asset_length"], "grade", replicates=100, anew=True))


query()(k_target_bootstrap)


@query(_J + f""", k as (select price as v, grade as t from j where price is not null and grade is not null), e as (select quantile_cont(v, {[x / 10 for x in range(1, 10)]}) as e from k),
    b as (select len(list_filter(e, lambda x: x < v)) as b, t, count(*) as c from k cross join e group by 1, 2), m as (select *, sum(c) over (partition by b) as cb, sum(c) over (partition by t) as ct, sum(c) over () as n from b)
    select 'price' as feature, cast(max(n) as bigint) as n, round(sum(c / n * ln(c * n / (cb * ct))), 6) as mi, round((count(distinct b) - 1) * (count(distinct t) - 1) / (2 * max(n)), 6) as noise from m""")
def k_mutual_info(spark: SparkSession, d: str) -> DataFrame:
    return rounded(stats.mutual_info(_j(spark, d), "price", "grade"))


@query(_J + f""", k as (select sub_type as g, grade as v from j where sub_type is not null and grade is not null), r as (select g, {_rank('v', '')} as r from k), s as (select g, sum(r) as r, count(*) as n from r group by 1),
    t as (select sum(c * c * c - c)::double as t from (select count(*) as c from k group by v)), a as (select sum(n)::double as n, count(*) as groups, sum(r * r / n) as s from s)
    select cast(n as bigint) as n, groups, round(h, 6) as h, round(exp(-h / 2) * list_sum(list_transform(range(0, (groups - 1) // 2), lambda j: power(h / 2, j) / gamma(j + 1))), 6) as p
    from (select *, (12 / (n * (n + 1)) * s - 3 * (n + 1)) / (1 - t / (n * n * n - n)) as h from a, t)""")  # ten degrees of freedom: the even form of the tail
def k_kruskal(spark: SparkSession, d: str) -> DataFrame:
    return rounded(stats.kruskal(_j(spark, d), "sub_type", "grade"))


@query(_J + ", l as (select sub_type, 'actual_dcl' as \"column\", actual_dcl as v from j union all select sub_type, 'price', price from j), g as (select sub_type as \"group\", \"column\", median(v) as median, count(*) as n from l where v is not null and sub_type is not null group by 1, 2) select \"group\", \"column\", round(median, 6) as median, n, round(n / sum(n) over (partition by \"column\"), 6) as share from g")
def k_group_profile(spark: SparkSession, d: str) -> DataFrame:
    return rounded(stats.group_profile(_j(spark, d), "sub_type", ["actual_dcl", "price"]))


@query(oracle("si_inspection") + " select asset_id, count(*) as n, cast(max(inspection_date) - min(inspection_date) as int) as span_days, round(case when max(inspection_date) > min(inspection_date) then (count(*) - 1) / ((max(inspection_date) - min(inspection_date)) / 365.25) end, 6) as per_year, cast(date '2002-01-01' - max(inspection_date) as int) as recency_days from si_inspection group by 1")
def k_inspection_rate(spark: SparkSession, d: str) -> DataFrame:
    return rounded(stats.inspection_rate(standin(spark, d, "si_inspection"), F.lit("2002-01-01").cast("date")))


_T = oracle("si_inspection", "si_asset") + ", t as (select * from (select asset_id, inspection_date as date_t0, grade as grade_t0, lead(grade) over w as grade_t1, (lead(inspection_date) over w - inspection_date) / 365.25 as interval_years from si_inspection window w as (partition by asset_id order by inspection_date, inspection_id)) where grade_t1 is not null)"


@query(_T + " select asset_id, date_t0, grade_t0, grade_t1, grade_t1 - grade_t0 as delta_grade, round(interval_years, 6) as interval_years from t")
def k_transitions(spark: SparkSession, d: str) -> DataFrame:
    return rounded(stats.transitions(standin(spark, d, "si_inspection")))


@query(_T + ", c as (select cast(round_even(interval_years, 0) as int) as \"interval\", grade_t0, grade_t1, count(*) as n from t group by 1, 2, 3) select *, round(n / sum(n) over (partition by \"interval\", grade_t0), 6) as p from c")
def k_transition_matrix(spark: SparkSession, d: str) -> DataFrame:
    return rounded(stats.transition_matrix(stats.transitions(standin(spark, d, "si_inspection")), by_interval=True))


@query(_T + ", g as (select t.*, (date_t0 - asset_start_date) / 365.25 as age from t join si_asset a on a.asset_id = t.asset_id where interval_years between 0.4 and 1.25) select cast(greatest(ceil(age / 5) - 1, 0) as int) as band, count(*) as n, round(avg(cast(grade_t1 > grade_t0 as int)), 6) as share_worse, round(avg(grade_t1 - grade_t0), 6) as mean_delta, round(median(age), 6) as median_age from g where age >= 0 group by 1 having count(*) >= 30")
def k_age_bands(spark: SparkSession, d: str) -> DataFrame:
    return rounded(stats.age_bands(stats.transitions(standin(spark, d, "si_inspection")), standin(spark, d, "si_asset"), low=0.4))


def _draw(seed: int) -> str:
    return f"cast('0x' || substr(md5('{seed}:' || asset_id), 1, 8) as bigint)"


@query(_J + f" select sub_type, count(*) as n, round(avg(abs(1 + asset_id % 5 - grade)), 6) as mae_pred, round(avg(abs(3 - grade)), 6) as mae_flat3, round(avg(abs({_draw(3)} % 6 + 1 - grade)), 6) as mae_random from j where grade is not null group by 1")
def k_naive_baselines(spark: SparkSession, d: str) -> DataFrame:
    """Against a flat grade and hashed draws."""
    df = _j(spark, d).withColumn("pred", F.lit(1) + F.pmod("asset_id", F.lit(5)))
    return rounded(stats.naive_baselines(df, "grade", "pred", "asset_id", ["sub_type"]))


@query(_J + " select asset_id, round(case when asset_length <> 0 then 100 * abs(asset_length * (1 + (asset_id % 30) / 100.0) - asset_length) / asset_length end, 4) as pct_diff, 100 * abs(asset_length * (1 + (asset_id % 30) / 100.0) - asset_length) / nullif(asset_length, 0) < 10.5 as agrees from j")
def k_area_check(spark: SparkSession, d: str) -> DataFrame:
    df = _j(spark, d).withColumn("computed", F.col("asset_length") * (1 + F.pmod("asset_id", F.lit(30)) / 100.0))
    return rounded(stats.area_check(df, "computed", "asset_length", 10.5).select("asset_id", "pct_diff", "agrees"), digits=4)


@query(_J + " select cast(least(19, floor((price - 0) / 10000.0)) as int) as bin, cast(least(4, floor((grade - 1) / 0.8)) as int) as bin_y, count(*) as n from j where price between 0 and 200000 and grade between 1 and 5 group by 1, 2")
def k_histogram(spark: SparkSession, d: str) -> DataFrame:
    return stats.histogram(_j(spark, d), "price", 0.0, 200000.0, 20, ("grade", 1.0, 5.0, 5))


@query(_J + f" select asset_id, sub_type from (select asset_id, sub_type, row_number() over (partition by sub_type order by {_draw(1)}, asset_id) as rn from j) where rn <= 40")
def k_stratified_sample(spark: SparkSession, d: str) -> DataFrame:
    """A seeded sample: as many of each sub-type as the cap allows."""
    return stats.stratified_sample(_j(spark, d).select("asset_id", "sub_type"), "sub_type", "asset_id", 40)


@query(_J + " select sub_type as \"group\", count(*) as n, round(avg(cast(grade <> 1 + asset_id % 5 as int)), 6) as rate from j where grade is not null group by 1 having count(*) >= 50")
def k_disagreement(spark: SparkSession, d: str) -> DataFrame:
    return rounded(stats.disagreement(_j(spark, d).withColumn("other", 1 + F.col("asset_id") % 5), "sub_type", "grade", "other"))


@query(_J + " select case when sub_type is null then 'unmapped' when sub_type = 'Quay' then 'partial' else 'mapped' end as tier, count(*) as n, round(100 * avg(cast(asset_start_date is not null as int)), 6) as pct_dated, round(100.0 * count(*) / sum(count(*)) over (), 6) as pct from j group by 1")
def k_mapping_coverage(spark: SparkSession, d: str) -> DataFrame:
    tier = F.when(F.col("sub_type").isNull(), "unmapped").when(F.col("sub_type") == "Quay", "partial").otherwise("mapped")
    return rounded(stats.mapping_coverage(_j(spark, d), tier, "asset_start_date"))


@query(_J + " select year(asset_start_date) as year, count(*) as n from j where asset_start_date is not null group by 1 order by n desc, year limit 5")
def k_date_spikes(spark: SparkSession, d: str) -> DataFrame:
    return stats.date_spikes(_j(spark, d), "asset_start_date", 5)


def k_pca(spark: SparkSession, d: str) -> DataFrame:
    """Explained variance of standardised asset measures."""
    return stats.pca(_j(spark, d), ["asset_length", "actual_dcl", "price", "grade"])


def k_hopkins(spark: SparkSession, d: str) -> DataFrame:
    """Clustering tendency of the assets' places."""
    return stats.hopkins(_j(spark, d), ["x", "y"], "asset_id")


query()(k_pca)
query()(k_hopkins)
