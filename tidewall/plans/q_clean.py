"""Queries of the cleaning, typing and join operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewall.operators import clean, joins
from tidewall.plans.registry import query, rounded
from tidewall.plans.standins import oracle, standin


def _joined(spark: SparkSession, d: str) -> DataFrame:
    assets, latest = standin(spark, d, "si_asset"), standin(spark, d, "si_latest")
    return assets.join(latest.select("asset_id", "inspection_date", "grade"), "asset_id", "left")


_JOINED = oracle("si_asset", "si_latest") + ", j as (select a.*, l.inspection_date, l.grade from si_asset a left join si_latest l on a.asset_id = l.asset_id)"
_AGE = "case when (inspection_date - asset_start_date) / 365.25 between 0 and 150 then (inspection_date - asset_start_date) / 365.25 end"


_CODE = "cast(case when {0} is not null then dense_rank() over (order by {0} nulls last) - 1 end as int)"


@query(
    oracle("si_asset", "si_latest", "si_ground") + f""", s as (select a.*, g.* exclude (asset_id), l.inspection_date, l.grade from si_asset a join si_latest l on a.asset_id = l.asset_id join si_ground g on g.asset_id = a.asset_id where grade between 1 and 5 and sub_type <> 'Natural High Ground'),
    top as (select lithology from s where lithology is not null group by 1 order by count(*) desc, lithology limit 20),
    b as (select *, case when lithology is null then null when lithology in (select lithology from top) then lithology else 'the_rest' end as lithology_binned from s), c as (select *, case when lithology_binned = 'the_rest' then chr(1114111) else lithology_binned end as o from b)
    select asset_id, cast(grade as int) as condition_grade, sub_type, {_CODE.format("sub_type")} as sub_type_code, protection_type, {_CODE.format("protection_type")} as protection_type_code, primary_purpose, {_CODE.format("primary_purpose")} as primary_purpose_code,
      lithology_binned, {_CODE.format("o")} as lithology_code, {", ".join(f"try_cast(geosure_{t} as tinyint) as geosure_{t}" for t in clean.GROUND_THEMES)},
      cast(regexp_matches(maintainer, '(?i)environment agency') as int) as maintainer_is_ea, round(ln(1 + asset_length), 6) as asset_length_log1p,
      round(actual_dcl, 6) as actual_dcl, cast(actual_dcl is null as int) as actual_dcl_missing,
      case when design_sop in (9999, 10000) then null else design_sop end as design_sop,
      cast(design_sop is null or design_sop in (9999, 10000) as int) as design_sop_missing,
      round({_AGE}, 6) as age_years, cast({_AGE} is null as int) as age_estimated
    from c"""
)
def prepare_features(spark: SparkSession, d: str) -> DataFrame:
    return rounded(clean.prepare_features(_joined(spark, d).join(standin(spark, d, "si_ground"), "asset_id")))


@query(oracle("si_asset") + " select asset_id, case when design_sop in (9999, 10000) then null else design_sop end as design_sop from si_asset")
def null_sentinels(spark: SparkSession, d: str) -> DataFrame:
    return clean.null_sentinels(standin(spark, d, "si_asset"), ["design_sop"], clean.SOP_SENTINELS).select("asset_id", "design_sop")


@query(_JOINED + f" select asset_id, round({_AGE}, 6) as age_years from j")
def age_years(spark: SparkSession, d: str) -> DataFrame:
    return rounded(_joined(spark, d).select("asset_id", clean.age_years(F.col("inspection_date"), F.col("asset_start_date")).alias("age_years")))


@query(
    oracle("si_asset") + """, top as (select lithology from si_asset where lithology is not null group by 1 order by count(*) desc, lithology limit 8)
    select asset_id, lithology, case when lithology is null then null when lithology in (select lithology from top) then lithology else 'the_rest' end as binned from si_asset"""
)
def bin_top_k(spark: SparkSession, d: str) -> DataFrame:
    return clean.bin_top_k(standin(spark, d, "si_asset"), "lithology", "binned", 8).select("asset_id", "lithology", "binned")


@query(oracle("si_asset") + ", v as (select distinct sub_type from si_asset where sub_type is not null), c as (select sub_type, cast(row_number() over (order by sub_type) - 1 as int) as code from v) select asset_id, sub_type, code from si_asset left join c using (sub_type)")
def encode_categories(spark: SparkSession, d: str) -> DataFrame:
    return clean.encode_categories(standin(spark, d, "si_asset"), "sub_type", "code").select("asset_id", "sub_type", "code")


@query(oracle("si_asset") + " select asset_id, cast(regexp_matches(maintainer, '(?i)environment agency') as int) as maintainer_is_ea from si_asset")
def regex_flag(spark: SparkSession, d: str) -> DataFrame:
    return standin(spark, d, "si_asset").select("asset_id", clean.regex_flag(F.col("maintainer"), "(?i)environment agency").alias("maintainer_is_ea"))


@query(
    oracle("si_asset") + """ select asset_id, coalesce(contains(protection_type, 'Fluvial'), false) as src_fluvial, coalesce(contains(protection_type, 'Coastal'), false) as src_coastal,
      coalesce(contains(protection_type, 'Tidal'), false) as src_tidal, coalesce(contains(protection_type, 'Surface Water'), false) as src_surface_water, protection_type is null as missing from si_asset"""
)
def source_flags(spark: SparkSession, d: str) -> DataFrame:
    df = standin(spark, d, "si_asset")
    return df.withColumns(clean.source_flags(F.col("protection_type"), "src_")).select("asset_id", *[f"src_{s}" for s in clean.SOURCES], F.col("protection_type").isNull().alias("missing"))


@query(oracle("si_asset") + " select asset_id, round(ln(1 + asset_length), 6) as asset_length_log1p, cast(actual_dcl is null as int) as actual_dcl_missing from si_asset")
def numeric_transforms(spark: SparkSession, d: str) -> DataFrame:
    return rounded(clean.numeric_transforms(standin(spark, d, "si_asset"), ["asset_length"], ["actual_dcl"]).select("asset_id", "asset_length_log1p", "actual_dcl_missing"))


@query("select o_orderkey, try_cast(nullif(regexp_extract(trim(o_orderpriority), '^(\\d+)', 1), '') as int) as grade, split_part(replace(o_orderpriority, '-', ' - '), ' - ', 1) as code from orders")
def parse_grade(spark: SparkSession, d: str) -> DataFrame:
    orders = spark.read.parquet(f"{d}/orders.parquet")
    return orders.select("o_orderkey", clean.parse_grade(F.col("o_orderpriority")).alias("grade"), clean.parse_code(F.replace("o_orderpriority", F.lit("-"), F.lit(" - "))).alias("code"))


@query(
    """with t as (select o_orderkey, case when o_orderkey % 7 = 0 then 'n/a' when o_orderkey % 11 = 0 then '31/02/2000' else strftime(o_orderdate, '%d/%m/%Y') end as text from orders)
    select o_orderkey, text, cast(try_strptime(text, '%d/%m/%Y') as date) as parsed from t"""
)
def parse_date(spark: SparkSession, d: str) -> DataFrame:
    orders = spark.read.parquet(f"{d}/orders.parquet")
    text = F.when(F.col("o_orderkey") % 7 == 0, "n/a").when(F.col("o_orderkey") % 11 == 0, "31/02/2000").otherwise(F.date_format("o_orderdate", "dd/MM/yyyy"))
    return orders.select("o_orderkey", text.alias("text")).withColumn("parsed", clean.parse_date(F.col("text")))


@query("select n_nationkey, lower(case when n_nationkey % 3 = 0 then ' True ' when n_nationkey % 3 = 1 then 'False' end) like '%true%' as flag from nation")
def bool_flag(spark: SparkSession, d: str) -> DataFrame:
    nation = spark.read.parquet(f"{d}/nation.parquet")
    text = F.when(F.col("n_nationkey") % 3 == 0, " True ").when(F.col("n_nationkey") % 3 == 1, "False")
    return nation.select("n_nationkey", clean.bool_flag(text).alias("flag"))


@query("select c_custkey as customer_id, c_name as name, c_nationkey, c_acctbal as balance, c_mktsegment from customer")
def harmonise_schema(spark: SparkSession, d: str) -> DataFrame:
    df, _ = clean.harmonise_schema(spark.read.parquet(f"{d}/customer.parquet").withColumnRenamed("c_name", "C_NAME"), {"c_custkey": "customer_id", "c_name": "name", "c_acctbal": "balance"}, ["customer_id", "balance"])
    return df


@query("select s_suppkey, s_name as sup__name, s_nationkey as sup__nationkey, s_acctbal as sup__acctbal from supplier")
def namespace_columns(spark: SparkSession, d: str) -> DataFrame:
    return clean.namespace_columns(spark.read.parquet(f"{d}/supplier.parquet"), "sup__", ["s_suppkey"], "s_.*", lambda c: c.removeprefix("s_"))


@query("select o_orderkey, cast(o_custkey as varchar) as id from orders")
def normalise_ids(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/orders.parquet").select("o_orderkey", clean.normalise_ids(F.col("o_custkey").cast("double")).alias("id"))


@query("select distinct l_returnflag, l_linestatus, l_linenumber, l_discount from lineitem")
def drop_exact_duplicates(spark: SparkSession, d: str) -> DataFrame:
    return clean.drop_exact_duplicates(spark.read.parquet(f"{d}/lineitem.parquet").select("l_returnflag", "l_linestatus", "l_linenumber", "l_discount"))


@query(oracle("si_latest") + " select asset_id, inspection_id, inspection_date, grade from si_latest")
def latest_per_key(spark: SparkSession, d: str) -> DataFrame:
    return clean.latest_per_key(standin(spark, d, "si_inspection"), "asset_id", "inspection_date", "inspection_id").select("asset_id", "inspection_id", "inspection_date", "grade")


@query(
    _JOINED + """ select rule, n_bad from (select
      count(*) filter (not coalesce(grade between 1 and 5, false)) as grade_domain, count(*) filter (not coalesce(asset_length >= 0, false)) as length_sign,
      count(*) filter (not coalesce(asset_start_date <= inspection_date, false)) as dates_in_order, count(*) - count(distinct asset_id) as unique_asset_id from j) unpivot (n_bad for rule in (grade_domain, length_sign, dates_in_order, unique_asset_id))"""
)
def quality_gates(spark: SparkSession, d: str) -> DataFrame:
    rules = {"grade_domain": F.col("grade").between(1, 5), "length_sign": F.col("asset_length") >= 0, "dates_in_order": F.col("asset_start_date") <= F.col("inspection_date")}
    return clean.quality_gates(_joined(spark, d), rules, ["asset_id"])


@query(_JOINED + " select asset_id, sub_type, design_sop from j")
def assert_no_leak(spark: SparkSession, d: str) -> DataFrame:
    return clean.assert_no_leak(_joined(spark, d).select("asset_id", "sub_type", "design_sop"), ["grade", "inspection_id"])


@query(
    _JOINED + """ select 'grade' as "column", round(avg(cast(grade is not null as int)), 6) as coverage from j union all select 'design_sop', round(avg(cast(design_sop is not null as int)), 6) from j
    union all select 'n_inspections', round(avg(cast(n is not null as int)), 6) from j left join (select asset_id, count(*) as n from si_inspection where status = 'F' group by 1) using (asset_id)"""
)
def attach_blocks(spark: SparkSession, d: str) -> DataFrame:
    counts = standin(spark, d, "si_inspection").filter("status = 'F'").groupBy("asset_id").agg(F.count("*").alias("n_inspections"))
    latest = standin(spark, d, "si_latest").select("asset_id", "grade")
    joined = clean.attach_blocks(standin(spark, d, "si_asset"), {"latest": latest, "counts": counts}, "asset_id")
    return rounded(clean.coverage(joined, ["grade", "design_sop", "n_inspections"]))


@query(_JOINED + " select asset_id, round(asset_length, 6) as asset_length, round(coalesce(actual_dcl, (select min(actual_dcl) from j) - 1), 6) as actual_dcl from j")
def build_feature_set(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.ml.functions import vector_to_array

    df = clean.build_feature_set(_joined(spark, d), ["asset_length", "actual_dcl"])
    v = vector_to_array("features")
    return rounded(df.select("asset_id", v[0].alias("asset_length"), v[1].alias("actual_dcl")))


@query(oracle("si_asset") + " select sub_type, segment, count(*) as n from si_asset where area in (1, 2, 3, 5, 8) and maintainer is not null and sub_type not in ('Dunes', 'Weir') group by 1, 2")
def subset_counts(spark: SparkSession, d: str) -> DataFrame:
    keep = F.col("area").isin(1, 2, 3, 5, 8) & F.col("maintainer").isNotNull() & ~F.col("sub_type").isin("Dunes", "Weir")
    return clean.subset_counts(standin(spark, d, "si_asset"), keep, ["sub_type", "segment"])


@query(
    oracle("si_asset") + """, t as (select nullif(trim(maintainer), '') as a, nullif(trim(protection_type), '') as b from si_asset)
    select 'maintainer|protection_type' as pair, count(*) filter (a is not null and b is not null and a <> b) as both_differ, count(*) filter (a is not null and b is null) as only_first,
      count(*) filter (a is null and b is not null) as only_second, count(*) filter (a is not distinct from b) as same from t"""
)
def column_conflicts(spark: SparkSession, d: str) -> DataFrame:
    return clean.column_conflicts(standin(spark, d, "si_asset"), [("maintainer", "protection_type")])


@query(
    oracle("si_rain", "si_temp") + """, a as (select cell_id, date from si_rain where value < 10), b as (select cell_id, date from si_temp where tasmin < 0)
    select count(*) filter (a.cell_id is not null and b.cell_id is not null) as matched, count(*) filter (b.cell_id is null) as left_only, count(*) filter (a.cell_id is null) as right_only from a full join b on a.cell_id = b.cell_id and a.date = b.date"""
)
def align_series(spark: SparkSession, d: str) -> DataFrame:
    return joins.align_series(standin(spark, d, "si_rain").filter("value < 10"), standin(spark, d, "si_temp").filter("tasmin < 0"), ["cell_id", "date"])


@query(oracle("si_inspection", "si_asset") + " select inspection_id, asset_id from si_inspection where asset_id in (select asset_id from si_asset where segment = 'BUILDING')")
def restrict_to_scope(spark: SparkSession, d: str) -> DataFrame:
    scope = standin(spark, d, "si_asset").filter("segment = 'BUILDING'")
    return joins.restrict_to_scope(standin(spark, d, "si_inspection"), scope, "asset_id").select("inspection_id", "asset_id")


@query(oracle("si_inspection", "si_asset") + " select distinct asset_id from si_inspection where asset_id not in (select asset_id from si_asset where design_sop > 50)")
def stray_ids(spark: SparkSession, d: str) -> DataFrame:
    return joins.stray_ids(standin(spark, d, "si_inspection"), standin(spark, d, "si_asset").filter("design_sop > 50"), "asset_id")


@query(
    oracle("si_asset", "si_latest") + """, a as (select asset_id, sub_type from si_asset where asset_id % 3 <> 0), b as (select asset_id, grade from si_latest where asset_id % 2 = 0)
    select coalesce(a.asset_id, b.asset_id) as asset_id, sub_type, grade from a full join b on a.asset_id = b.asset_id"""
)
def outer_union_join(spark: SparkSession, d: str) -> DataFrame:
    a, b = standin(spark, d, "si_asset").filter("asset_id % 3 <> 0").select("asset_id", "sub_type"), standin(spark, d, "si_latest").filter("asset_id % 2 = 0").select("asset_id", "grade")
    return joins.outer_union_join(a, b, "asset_id")


@query(oracle("si_event", "si_anchor") + " select e.asset_id, rec_out_id, start_date, end_date from si_event e join si_anchor a on e.asset_id = a.asset_id where end_date < t_anchor and start_date >= t_anchor - 730")
def lookback_events(spark: SparkSession, d: str) -> DataFrame:
    return joins.lookback_events(standin(spark, d, "si_event"), standin(spark, d, "si_anchor"), 730).select("asset_id", "rec_out_id", "start_date", "end_date")


@query(oracle("si_asset") + " select asset_id, cast(greatest(0, least(49, ceil((x - 500) / 2000 - 0.5))) as int) as ix, cast(greatest(0, least(39, ceil((y - 1000) / 2500 - 0.5))) as int) as iy from si_asset")
def nearest_axis_index(spark: SparkSession, d: str) -> DataFrame:
    return standin(spark, d, "si_asset").select("asset_id", joins.nearest_axis_index(F.col("x"), 500.0, 2000.0, 50).alias("ix"), joins.nearest_axis_index(F.col("y"), 1000.0, 2500.0, 40).alias("iy"))


_CELLS = """, p as (select asset_id, cast(floor(x / 5000) as int) as ix, cast(floor(y / 5000) as int) as iy from si_asset),
    g as (select a.i as iy, b.i as ix, (a.i * 7 + b.i * 3) % 5 = 0 as valid from (select i from si_day where i < 20) a cross join (select i from si_day where i < 20) b)"""


def _points_and_grid(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    points = standin(spark, d, "si_asset").select("asset_id", F.floor(F.col("x") / 5000).cast("int").alias("ix"), F.floor(F.col("y") / 5000).cast("int").alias("iy"))
    index = standin(spark, d, "si_day").filter("i < 20").select("i")
    grid = index.select(F.col("i").alias("iy")).crossJoin(index.select(F.col("i").alias("ix"))).withColumn("valid", (F.col("iy") * 7 + F.col("ix") * 3) % 5 == 0)
    return points, grid


@query(
    oracle("si_asset", "si_day") + _CELLS + """, t as (select asset_id, p.iy, p.ix, g.iy as ty, g.ix as tx, row_number() over (partition by asset_id order by greatest(abs(g.iy - p.iy), abs(g.ix - p.ix)), (g.iy - p.iy) * (g.iy - p.iy) + (g.ix - p.ix) * (g.ix - p.ix), g.iy - p.iy, g.ix - p.ix) as rn
      from p join g on g.valid and g.iy between p.iy - 3 and p.iy + 3 and g.ix between p.ix - 3 and p.ix + 3)
    select asset_id, ty as valid_iy, tx as valid_ix, ty <> iy or tx <> ix as fallback from t where rn = 1"""
)
def resolve_valid_cell(spark: SparkSession, d: str) -> DataFrame:
    points, grid = _points_and_grid(spark, d)
    return joins.resolve_valid_cell(points, grid).select("asset_id", "valid_iy", "valid_ix", "fallback")


@query(
    oracle("si_asset") + """ select segment, iy, ix, cast(dense_rank() over (partition by segment order by iy, ix) - 1 as int) as cell_id
    from (select distinct segment, cast(floor(y / 5000) as int) as iy, cast(floor(x / 5000) as int) as ix from si_asset)"""
)
def densify_cells(spark: SparkSession, d: str) -> DataFrame:
    cells = standin(spark, d, "si_asset").select("segment", F.floor(F.col("y") / 5000).cast("int").alias("iy"), F.floor(F.col("x") / 5000).cast("int").alias("ix"))
    return joins.densify_cells(cells, "segment").select("segment", "iy", "ix", "cell_id")
