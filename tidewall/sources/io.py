"""Reads and writes of tables, logs and out-of-fold artefacts."""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewall.operators.clean import QualityError
from tidewall.operators.evaluate import with_scores


def scan_table(spark: SparkSession, path: str, columns: Sequence[str] = ()) -> DataFrame:
    """A Parquet table; columns and later filters reach the scan."""
    df = spark.read.parquet(path)
    return df.select(*columns) if columns else df


def scan_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """CSV with a header and a stated schema; a row that does not fit it raises."""
    return spark.read.csv(path, header=True, schema=schema, mode="FAILFAST")


def load_run_log(spark: SparkSession, path: str, kind: str, schema: str = "kind string, at timestamp, payload string") -> DataFrame:
    """Records of one kind of a JSON-lines log."""
    return spark.read.json(path, schema=schema).filter(F.col("kind") == kind)


def last_record(log: DataFrame, by: str = "kind", order: str = "at") -> DataFrame:
    """The last record of each kind."""
    return log.groupBy(by).agg(F.max_by(F.struct(*[c for c in log.columns if c != by]), order).alias("_r")).select(by, "_r.*")


def write_table(df: DataFrame, path: str, partition_by: Sequence[str] = (), mode: str = "error") -> None:
    """Parquet through Spark's committer: readers see all of it, marked by _SUCCESS, or nothing."""
    df.write.mode(mode).partitionBy(*partition_by).parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.csv(path, header=True)


def log_run(spark: SparkSession, path: str, kind: str, payload: Mapping) -> None:
    """Appends one record to a JSON-lines log."""
    row = spark.range(1).select(F.lit(kind).alias("kind"), F.current_timestamp().alias("at"), F.lit(json.dumps(payload, sort_keys=True)).alias("payload"))
    row.coalesce(1).write.mode("append").json(path)


def commit_cell(oof: DataFrame, attributions: DataFrame | None, root: str, cell: str) -> None:
    """Writes a cell's attributions, then its predictions: the latter's presence says that the cell is done."""
    if attributions is not None:
        attributions.write.mode("overwrite").parquet(f"{root}/shap/cell_id={cell}")
    oof.drop("cell_id").write.mode("overwrite").parquet(f"{root}/oof/cell_id={cell}")


def committed_cells(spark: SparkSession, root: str) -> set[str]:
    """Ids of the cells whose predictions are committed; none where nothing is."""
    try:
        found = spark.read.parquet(f"{root}/oof")
    except AnalysisException:  # no such folder yet
        return set()
    return {r[0] for r in found.select(F.col("cell_id").cast("string")).distinct().collect()}


def load_oof(spark: SparkSession, root: str, cells: Sequence[str] = ()) -> DataFrame:
    """Stored predictions with derived scores; a list of cells prunes partitions, an absent one raises."""
    df = spark.read.parquet(f"{root}/oof")
    if cells:
        df = df.filter(F.col("cell_id").isin(*cells))
        if absent := set(cells) - {r[0] for r in df.select("cell_id").distinct().collect()}:
            raise QualityError(f"no stored predictions of {sorted(absent)}")
    return with_scores(df)


def compact_years(daily: DataFrame, path: str) -> None:
    """Rewrites the years of which all months are there as one file each; other years stay as they are.

    `daily` has var, date and the values; the table at `path` is partitioned by var and year.
    """
    df = daily.withColumn("year", F.year("date"))
    full = df.groupBy("var", "year").agg(F.count_distinct(F.month("date")).alias("_m")).filter("_m = 12").drop("_m")
    df.join(F.broadcast(full), ["var", "year"]).repartition("var", "year").sortWithinPartitions("var", "year", "date").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("var", "year").parquet(path)


GEOJSON = "type string, geometry struct<type:string,coordinates:string>, properties map<string,string>"


def read_geojson_table(df: DataFrame, column: str) -> DataFrame:
    """Adds geom_type, parts and properties from one GeoJSON feature a row; points are one part of one vertex,
    of several polygons the rings are listed together: how they lie in one another tells shells from holes."""
    parsed = F.from_json(column, GEOJSON)
    df = df.withColumn("_f", parsed).withColumns({"geom_type": F.col("_f.geometry.type"), "properties": F.col("_f.properties"), "_c": F.col("_f.geometry.coordinates")})
    vertex = lambda p: F.struct(p[0].alias("x"), p[1].alias("y"))
    ring = lambda r: F.transform(r, vertex)
    as_kind = lambda k: F.from_json("_c", k)
    parts = (
        F.when(F.col("geom_type") == "Point", F.array(F.array(vertex(as_kind("array<double>")))))
        .when(F.col("geom_type") == "LineString", F.array(ring(as_kind("array<array<double>>"))))
        .when(F.col("geom_type").isin("Polygon", "MultiLineString"), F.transform(as_kind("array<array<array<double>>>"), ring))
        .when(F.col("geom_type") == "MultiPolygon", F.transform(F.flatten(as_kind("array<array<array<array<double>>>>")), ring))
    )
    return df.withColumn("parts", parts).drop("_f", "_c")
