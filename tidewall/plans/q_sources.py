"""Queries of sources, sinks and the stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewall.operators import spatial
from tidewall.plans.registry import query, rounded
from tidewall.plans.standins import oracle, standin
from tidewall.sources import io
from tidewall.sources.shared import shared_dir
from tidewall.streaming.ingest import ingest_daily_stream


@query("select l_orderkey, l_quantity from lineitem where l_shipdate < timestamp '1996-01-01'")
def scan_table(spark: SparkSession, d: str) -> DataFrame:
    return io.scan_table(spark, f"{d}/lineitem.parquet", ["l_orderkey", "l_quantity", "l_shipdate"]).filter("l_shipdate < timestamp_ntz'1996-01-01 00:00:00'").drop("l_shipdate")


@query("select c_custkey, c_acctbal, c_mktsegment from customer")
def scan_csv(spark: SparkSession, d: str) -> DataFrame:
    path = shared_dir(spark, "csv")
    io.write_csv(spark.read.parquet(f"{d}/customer.parquet").select("c_custkey", "c_acctbal", "c_mktsegment"), path)
    return io.scan_csv(spark, path, "c_custkey long, c_acctbal double, c_mktsegment string")


@query("select event_type as kind, max(event_id) as last_id, count(*) as n from events group by 1")
def load_run_log(spark: SparkSession, d: str) -> DataFrame:
    """Events written as JSON lines and read back: the last record and the number of each kind."""
    path = shared_dir(spark, "log")
    events = spark.read.parquet(f"{d}/events.parquet")
    events.select(F.col("event_type").alias("kind"), F.timestamp_seconds("event_id").alias("at"), F.col("event_id").cast("string").alias("payload")).write.json(path)
    kinds = [r[0] for r in events.select("event_type").distinct().collect()]
    log = io.load_run_log(spark, path, kinds[0])
    for k in kinds[1:]:
        log = log.unionByName(io.load_run_log(spark, path, k))
    counts = log.groupBy("kind").agg(F.count("*").alias("n"))
    return io.last_record(log).join(counts, "kind").select("kind", F.col("payload").cast("long").alias("last_id"), "n")


@query(oracle("si_oof") + " select cell_id, count(*) as n, round(sum(proba_4 + proba_5), 3) as mass, sum(y_pred_argmax) as argmax_sum from si_oof where cell_id <> 'cell_1' group by 1")
def load_oof(spark: SparkSession, d: str) -> DataFrame:
    """Cells committed one by one, then two of the three read back by partition."""
    root, oof = shared_dir(spark, "oof"), standin(spark, d, "si_oof")
    for cell in ("cell_0", "cell_1", "cell_2"):
        io.commit_cell(oof.filter(F.col("cell_id") == cell).drop("y_pred_argmax", "score_ge4", "y_ge4"), None, root, cell)
    found = io.load_oof(spark, root, ["cell_0", "cell_2"])
    return rounded(found.groupBy("cell_id").agg(F.count("*").alias("n"), F.sum("score_ge4").alias("mass"), F.sum("y_pred_argmax").alias("argmax_sum")), digits=3)


@query(oracle("si_rain") + " select year(date) as year, count(*) as n, round(sum(value), 4) as total from si_rain group by 1")
def compact_years(spark: SparkSession, d: str) -> DataFrame:
    """Month shards of the daily series, complete years compacted, all read back."""
    path = shared_dir(spark, "daily")
    daily = standin(spark, d, "si_rain").select(F.lit("rainfall").alias("var"), "cell_id", "date", "value")
    io.write_table(daily.withColumn("year", F.year("date")).repartition(F.month("date"), F.year("date")), path, ["var", "year"])
    stored = spark.read.parquet(path)
    compacted = shared_dir(spark, "compacted")
    io.write_table(stored, compacted, ["var", "year"])
    io.compact_years(stored.drop("year"), compacted)
    back = spark.read.parquet(compacted)
    return rounded(back.groupBy("year").agg(F.count("*").alias("n"), F.sum("value").alias("total")), digits=4)


@query(
    oracle("si_asset") + """ select asset_id, case asset_id % 3 when 0 then 'Polygon' when 1 then 'Point' else 'MultiPolygon' end as geom_type, cast(x as varchar) as label,
    case asset_id % 3 when 0 then 25.0 when 2 then 40.0 end::double as area, case asset_id % 3 when 0 then round(x + 2.5, 6) when 2 then round(x + 170 / 40.0, 6) end as cx from si_asset"""
)
def read_geojson_table(spark: SparkSession, d: str) -> DataFrame:
    """Points, squares, and three polygons: one with a hole, an island in the hole, a square beside."""
    x, y = F.col("x").cast("string"), F.col("y").cast("string")
    corner = lambda a, b: F.concat(F.lit("["), (F.col("x") + a).cast("string"), F.lit(","), (F.col("y") + b).cast("string"), F.lit("]"))
    ring = lambda a, b, c, e: F.concat(F.lit("["), F.concat_ws(",", corner(a, b), corner(c, b), corner(c, e), corner(a, e), corner(a, b)), F.lit("]"))
    several = F.concat(F.lit("[[["), F.concat_ws(",", corner(10, 0), corner(13, 0), corner(13, 1), corner(10, 1)), F.lit("]],["), ring(0, 0, 7, 7), F.lit(","), ring(1, 1, 5, 5), F.lit("],["), ring(2, 2, 4, 4), F.lit("]]"))
    shape = F.when(F.col("asset_id") % 3 == 0, F.concat(F.lit('{"type":"Polygon","coordinates":['), ring(0, 0, 5, 5), F.lit("]}"))).when(F.col("asset_id") % 3 == 1, F.concat(F.lit('{"type":"Point","coordinates":['), x, F.lit(","), y, F.lit("]}"))).otherwise(F.concat(F.lit('{"type":"MultiPolygon","coordinates":'), several, F.lit("}")))
    text = F.concat(F.lit('{"type":"Feature","geometry":'), shape, F.lit(',"properties":{"label":"'), x, F.lit('"}}'))
    out = io.read_geojson_table(standin(spark, d, "si_asset").select("asset_id", text.alias("feature")), "feature")
    filled = F.col("geom_type") != "Point"
    return rounded(out.select("asset_id", "geom_type", F.when(filled, spatial.area(F.col("parts"))).alias("area"), F.when(filled, spatial.polygon_centroid(F.col("parts"))["x"]).alias("cx"), F.col("properties")["label"].alias("label")))


@query("select user_id % 20 as cell_id, date_trunc('day', ts)::date as day, count(*) as n, round(sum(value), 4) as total, count(*) filter (value < 1) as drydays, count(*) filter (value >= 10) as r10mm from events group by 1, 2")
def ingest_daily(spark: SparkSession, d: str) -> DataFrame:
    """The stream's daily metrics of the events, run to the end of what is there."""
    return rounded(ingest_daily_stream(spark, f"{d}/events.parquet", shared_dir(spark, "stream")), digits=4)


@query("select o_orderstatus as kind, count(*) as n, max(o_orderkey) as last_key from orders group by 1")
def run_manifest(spark: SparkSession, d: str) -> DataFrame:
    """Two runs a status of the orders logged one after the other, and the last record of each status read back."""
    path = shared_dir(spark, "runs")
    counts = spark.read.parquet(f"{d}/orders.parquet").groupBy("o_orderstatus").agg(F.count("*").alias("n"), F.max("o_orderkey").alias("last_key")).collect()
    for r in counts:  # a status each, three at most
        for n in (0, r.n):
            io.log_run(spark, path, r.o_orderstatus, {"n": n, "last_key": r.last_key})
    log = spark.read.json(path, schema="kind string, at timestamp, payload string")
    return io.last_record(log).select("kind", *[F.get_json_object("payload", f"$.{k}").cast("long").alias(k) for k in ("n", "last_key")])
