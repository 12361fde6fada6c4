"""Asset, event, series and prediction tables derived from the given star-schema tables.

Each is one SQL text that Spark and DuckDB read alike: `@name` stands for a given table and
`{series(a,b)}` for the integers a to b. The oracles use the very same texts as their first clauses. Spark makes
the tables of BUILT, which are far larger than what they come from, by DataFrames dealt over tasks by their own size.
"""

from __future__ import annotations

import re
from collections.abc import Container

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewall.sources.shared import tasks_for

SI: dict[str, str] = {
    "si_asset": """
      select c_custkey as asset_id,
        case c_custkey % 12 when 0 then 'Embankment' when 1 then 'Wall' when 2 then 'Flood Gate' when 3 then 'Demountable Defence' when 4 then 'Beach'
          when 5 then 'Barrier Beach' when 6 then 'Dunes' when 7 then 'Weir' when 8 then 'Engineered High Ground' when 9 then 'Natural High Ground' when 10 then 'Quay' end as sub_type,
        case cast(floor(c_custkey / 7) as bigint) % 6 when 0 then 'Fluvial' when 1 then 'Coastal' when 2 then 'Tidal' when 3 then 'Fluvial/Tidal' when 4 then 'Surface Water' end as protection_type,
        case when c_custkey % 17 <> 0 then date '1990-01-01' + cast((c_custkey * 37) % 4200 as int) end as asset_start_date,
        case c_custkey % 50 when 0 then 9999.0 when 1 then 10000.0 when 2 then null else cast(5 + c_custkey % 200 as double) end as design_sop,
        case when c_custkey % 9 <> 0 then c_acctbal / 100 end as actual_dcl,
        case c_custkey % 4 when 0 then 'Environment Agency' when 1 then 'the environment agency (north)' when 2 then 'Local Authority' end as maintainer,
        abs(c_acctbal) as asset_length,
        case when c_custkey % 23 <> 0 then concat('LEX-', cast((c_custkey * c_custkey) % 31 as string)) end as lithology,
        cast((c_custkey * 7919) % 100000 as double) as x, cast((c_custkey * 104729) % 100000 as double) as y,
        c_nationkey as area, c_mktsegment as segment
      from @customer""",
    "si_ground": """
      select c_custkey as asset_id, case c_custkey % 5 when 0 then 'Flood Defence' when 1 then 'Coast Protection' when 2 then 'Channel' when 3 then 'Structure' end as primary_purpose,
        cast(1 + c_custkey % 3 as string) as geosure_collapsible_deposits, cast(1 + c_custkey % 2 as string) as geosure_compressible_ground, case when c_custkey % 19 <> 0 then cast(1 + cast(floor(c_custkey / 3) as bigint) % 3 as string) end as geosure_landslides,
        case when c_custkey % 29 = 0 then 'n/a' else '2' end as geosure_running_sand, cast(1 + c_nationkey % 3 as string) as geosure_shrink_swell, '1' as geosure_soluble_rocks
      from @customer""",
    "si_inspection": """
      select o_orderkey as inspection_id, o_custkey as asset_id, cast(o_orderdate as date) as inspection_date,
        cast(substring(o_orderpriority, 1, 1) as int) as grade, o_totalprice as price, o_orderstatus as status
      from @orders""",
    "si_latest": """
      select inspection_id, asset_id, inspection_date, grade, price, status from (
        select *, row_number() over (partition by asset_id order by inspection_date desc, inspection_id desc) as rn from si_inspection) q where rn = 1""",
    "si_anchor": """
      select a.asset_id, case when a.asset_id % 41 <> 0 then l.inspection_date end as t_anchor, a.asset_start_date,
        coalesce(a.protection_type like '%Fluvial%', false) as asset_src_fluvial, coalesce(a.protection_type like '%Coastal%', false) as asset_src_coastal,
        coalesce(a.protection_type like '%Tidal%', false) as asset_src_tidal, coalesce(a.protection_type like '%Surface Water%', false) as asset_src_surface_water,
        a.protection_type is null as protection_type_missing
      from si_asset a left join si_latest l on a.asset_id = l.asset_id""",
    "si_event": """
      select o_custkey as asset_id, concat_ws('-', cast(l_orderkey as string), cast(l_linenumber as string), cast(l_partkey as string), cast(l_suppkey as string)) as rec_out_id,
        max(case when l_linenumber <> 5 then cast(l_orderkey as string) end) as rec_grp_id,
        min(cast(l_shipdate as date)) as start_date, min(cast(l_shipdate as date) + l_linenumber) as end_date,
        max(l_returnflag = 'A') as src_fluvial, max(l_returnflag = 'R') as src_coastal, max(l_linestatus = 'O') as src_tidal, max(l_linenumber = 3) as src_surface_water,
        sum(l_extendedprice) / 100 as area
      from @lineitem join @orders on l_orderkey = o_orderkey
      group by o_custkey, l_orderkey, l_linenumber, l_partkey, l_suppkey""",
    "si_day": "select date '1995-01-01' + i as date, i from (select {series(0,2403)} as i) q",
    "si_cell": "select distinct cast(floor(c_custkey / 60) as int) as cell_id from @customer",
    "si_rain": """
      select c.cell_id, d.date, coalesce(s.total, cast(0 as double)) / 20011 as value, d.i
      from si_cell c cross join si_day d left join (
        select cast(floor(o_custkey / 60) as int) as cell_id, cast(o_orderdate as date) as date, cast(sum(cast(round(o_totalprice * 100) as bigint)) as double) / 100 as total from @orders group by 1, 2) s
        on s.cell_id = c.cell_id and s.date = d.date""",
    "si_temp": "select cell_id, date, tasmin, tasmin + (i + cell_id) % 9 as tasmax from (select cell_id, date, i, cast(cast(floor(value * 10) as bigint) % 300 as double) / 10 - 12 as tasmin from si_rain) q",
    "si_cell_map": "select asset_id, cast(floor(asset_id / 60) as int) as cell_id, asset_id % 13 = 0 as fallback_temp, asset_id % 26 = 0 as fallback_rain from si_asset",
    "si_weight": """
      select concat('cell_', cast(k as string)) as cell_id, concat('m', cast(k % 2 as string)) as model, case when k < 2 then 'base' else 'base_exp' end as feature_set,
        o_orderkey as asset_id, cast(o_custkey % 10 as int) as fold_id, cast(substring(o_orderpriority, 1, 1) as int) as y_true, g,
        1 + (o_orderkey * (7 + 2 * g) + 13 * k) % 19 + case when g = cast(substring(o_orderpriority, 1, 1) as int) and o_orderkey % 3 = 0 then 25 else 0 end as w
      from @orders cross join (select {series(0,2)} as k) a cross join (select {series(1,5)} as g) b""",
    "si_oof": """
      select cell_id, model, feature_set, asset_id, fold_id, y_true, p1 / s as proba_1, p2 / s as proba_2, p3 / s as proba_3, p4 / s as proba_4, p5 / s as proba_5,
        case greatest(p1, p2, p3, p4, p5) when p1 then 1 when p2 then 2 when p3 then 3 when p4 then 4 else 5 end as y_pred_argmax,
        round((p4 + p5) / s, 3) as score_ge4, case when y_true >= 4 then 1 else 0 end as y_ge4
      from (select cell_id, model, feature_set, asset_id, fold_id, y_true, cast(sum(w) as double) as s, cast(max(case when g = 1 then w end) as double) as p1, cast(max(case when g = 2 then w end) as double) as p2,
          cast(max(case when g = 3 then w end) as double) as p3, cast(max(case when g = 4 then w end) as double) as p4, cast(max(case when g = 5 then w end) as double) as p5
        from si_weight group by cell_id, model, feature_set, asset_id, fold_id, y_true) q""",
    "si_outline": """
      select s_suppkey as poly_id, cast((s_suppkey * 7907) % 96 * 1000 as bigint) as x0, cast((s_suppkey * 104711) % 94 * 1000 as bigint) as y0, 1 + s_suppkey % 3 as k, s_suppkey % 4 = 0 as holed from @supplier""",
    "si_station": """
      select vec_id as station, label as asset_id, cast(5 * (row_number() over (partition by label order by vec_id) - 1) as double) as chainage,
        case label % 3 when 0 then 'engineered_raised' when 1 then 'natural_geomorphic' else 'none' end as tier, embedding from @embeddings""",
}


#: First and number of the days of si_day.
FIRST_DAY, DAYS = "1995-01-01", 2404


def _rain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """si_rain: a cell's days come from one row of the cell, so the tasks that hold its cells make and keep its series.

    A cell's known totals, in order, are each followed by as many nulls as there are days to the next one.
    """
    tasks = tasks_for(standin(spark, sf_dir, "si_cell"), DAYS)
    # dealt before they are made distinct: a shuffle of Spark's own for that could be taken for this one and be coalesced
    cells = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.expr("cast(floor(c_custkey / 60) as int)").alias("cell_id")).repartition(tasks, "cell_id").distinct()
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.expr("cast(floor(o_custkey / 60) as int)").alias("cell_id"), F.date_diff(F.col("o_orderdate").cast("date"), F.lit(FIRST_DAY).cast("date")).alias("i"), "o_totalprice")
    totals = orders.filter(F.col("i").between(0, DAYS - 1)).repartition(tasks, "cell_id").groupBy("cell_id", "i").agg(F.expr("cast(sum(cast(round(o_totalprice * 100) as bigint)) as double) / 100").alias("total"))
    known = totals.groupBy("cell_id").agg(F.sort_array(F.collect_list(F.struct("i", "total"))).alias("_known"))
    start = F.array(F.struct(F.lit(-1).alias("i"), F.lit(None).cast("double").alias("total")))
    df = cells.join(known, "cell_id", "left").withColumn("_known", F.concat(start, F.coalesce("_known", F.array().cast("array<struct<i:int,total:double>>"))))
    following = lambda k: F.coalesce(F.get("_known", k + 1)["i"], F.lit(DAYS))
    filled = F.flatten(F.transform("_known", lambda e, k: F.concat(F.array(e["total"]), F.array_repeat(F.lit(None).cast("double"), following(k) - e["i"] - 1))))
    days = df.select("cell_id", F.posexplode(F.slice(filled, 2, DAYS)).alias("i", "total"))
    return days.select("cell_id", F.date_add(F.lit(FIRST_DAY).cast("date"), F.col("i")).alias("date"), (F.coalesce("total", F.lit(0.0)) / 20011).alias("value"), "i")


def _event(spark: SparkSession, sf_dir: str) -> DataFrame:
    """si_event by its own text, over line items that are dealt by their number: by order, to meet it, and then by asset,
    which grouping and the joins by asset keep."""
    items, orders = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("lineitem", "orders"))
    tasks = tasks_for(items)
    met = items.repartition(tasks, "l_orderkey").join(orders.repartition(tasks, "o_orderkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    return spark.sql(SI["si_event"].replace("@lineitem join @orders on l_orderkey = o_orderkey", "{met}"), met=met.repartition(tasks, "o_custkey"))


BUILT = {"si_rain": _rain, "si_event": _event}


def _needed(names: list[str], given: Container[str] = ()) -> list[str]:
    """The texts that `names` rest on, in order of definition; what is given rests on nothing."""
    found: set[str] = set()

    def visit(name: str) -> None:
        if name not in found and name not in given:
            for other in SI:
                if other != name and re.search(rf"\b{other}\b", SI[name]):
                    visit(other)
            found.add(name)

    for n in names:
        visit(n)
    return [n for n in SI if n in found]


def _clauses(names: list[str], series: str, given, built: Container[str] = ()) -> str:
    texts = []
    for n in _needed(names, built):
        text = re.sub(r"\{series\((\d+),(\d+)\)\}", lambda m: series.format(m[1], m[2], int(m[2]) + 1), SI[n])
        texts.append(f"{n} as ({re.sub(r'@(\w+)', given, text)})")
    return ", ".join(texts)


def standin(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The derived table `name` over the given tables of sf_dir."""
    if name in BUILT:
        return BUILT[name](spark, sf_dir)
    text = f"with {_clauses([name], 'explode(sequence({0}, {1}))', lambda m: f'parquet.`{sf_dir}/{m[1]}.parquet`', BUILT)} select * from {name}"
    used = {n: make(spark, sf_dir) for n, make in BUILT.items() if re.search(rf"\b{n}\b", text)}
    for n in used:
        text = re.sub(rf"\b{n}\b", f"{{{n}}}", text)
    return spark.sql(text, **used) if used else spark.sql(text)


def oracle(*names: str) -> str:
    """The clauses of the derived tables for DuckDB, ready for more: "with a as (...), b as (...)"."""
    return "with " + _clauses(list(names), "cast(unnest(range({0}, {2})) as int)", lambda m: m[1])
