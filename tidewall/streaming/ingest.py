"""Daily metrics of a stream of measurements, by the same expressions as the batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def daily_metrics(df: DataFrame, watermark: str = "2 days") -> DataFrame:
    """(cell_id, day, n, total, drydays, r10mm) of rows (event_id, ts, cell_id, value).

    An event that comes again within the watermark counts once; days close when the watermark has passed.
    """
    kept = df.withWatermark("ts", watermark).dropDuplicatesWithinWatermark(["event_id"])
    by_day = kept.groupBy("cell_id", F.window("ts", "1 day").alias("w"))
    return by_day.agg(F.count("*").alias("n"), F.sum("value").alias("total"), F.count_if(F.col("value") < 1).alias("drydays"), F.count_if(F.col("value") >= 10).alias("r10mm")).select("cell_id", F.to_date("w.start").alias("day"), "n", "total", "drydays", "r10mm")


def ingest_daily_stream(spark: SparkSession, source: str, work: str, watermark: str = "2 days") -> DataFrame:
    """Reads Parquet files of events below `source` as a stream, up to what is there now, and returns the daily
    metrics as a stored table. A run with the same `work` folder goes on where the last one stopped.

    Micro-batch results are upserted by day: each batch writes the days it changed under its own number, and the
    latest number of a day is its result.
    """
    schema = spark.read.parquet(source).schema
    # a stream reads folders: a single file is its folder with the name as a filter
    folder, _, name = source.rstrip("/").rpartition("/")
    events = spark.readStream.schema(schema).option("pathGlobFilter", name).parquet(folder) if name.endswith(".parquet") and _is_file(spark, source) else spark.readStream.schema(schema).parquet(source)
    rows = events.select("event_id", F.col("ts").cast("timestamp").alias("ts"), (F.col("user_id") % 20).alias("cell_id"), "value")

    def upsert(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{work}/days/number={number}")

    query = daily_metrics(rows, watermark).writeStream.outputMode("update").foreachBatch(upsert).option("checkpointLocation", f"{work}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    latest = spark.read.parquet(f"{work}/days").groupBy("cell_id", "day").agg(F.max_by(F.struct("n", "total", "drydays", "r10mm"), "batch").alias("r"))
    return latest.select("cell_id", "day", "r.*")


def _is_file(spark: SparkSession, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(target).isFile()
