"""Keyed joins with the checks that go with them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def align_series(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(matched, left_only, right_only): how two series with the same keys line up, in one full join."""
    a = left.select(*keys).withColumn("_a", F.lit(1))
    b = right.select(*keys).withColumn("_b", F.lit(1))
    both = a.join(b, list(keys), "full_outer")
    return both.agg(F.count_if(F.col("_a").isNotNull() & F.col("_b").isNotNull()).alias("matched"), F.count_if(F.col("_b").isNull()).alias("left_only"), F.count_if(F.col("_a").isNull()).alias("right_only"))


def restrict_to_scope(df: DataFrame, scope: DataFrame, key: str) -> DataFrame:
    return df.join(scope.select(key), key, "left_semi")


def stray_ids(df: DataFrame, scope: DataFrame, key: str) -> DataFrame:
    """Distinct keys that the scope lacks."""
    return df.select(key).distinct().join(scope.select(key), key, "left_anti")


def outer_union_join(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """All keys of both sides with the columns of both."""
    return left.join(right, key, "full_outer")


def lookback_events(events: DataFrame, anchors: DataFrame, days: int | None, key: str = "asset_id") -> DataFrame:
    """Events that ended before the anchor and, with `days`, started no earlier than that many before it.

    An equality on the key with the range as a further condition, so the join is dealt by key.
    """
    joined = events.join(anchors, key)
    inside = F.col("end_date") < F.col("t_anchor")
    if days is not None:
        inside &= F.col("start_date") >= F.date_sub("t_anchor", days)
    return joined.filter(inside)


def nearest_axis_index(value, first: float, step: float, size: int):
    """0-based index of the nearest point of a regular axis; a tie goes left, beyond the ends clamps, null stays null."""
    raw = F.ceil((value - F.lit(first)) / F.lit(step) - F.lit(0.5))
    return F.when(raw.isNotNull(), F.greatest(F.lit(0), F.least(F.lit(size - 1), raw))).cast("int")


def resolve_valid_cell(points: DataFrame, grid: DataFrame, max_ring: int = 3) -> DataFrame:
    """points (iy, ix among others) with the valid grid cell (valid_iy, valid_ix) found by growing rings.

    The best of the first square ring that has any valid cell: least squared distance, then dy, then dx.
    `fallback` says that the own cell was not valid; no valid cell within max_ring leaves nulls. Each
    distinct raw cell is looked up once.
    """
    cells = points.select("iy", "ix").distinct()
    spread = F.explode(F.sequence(F.lit(-max_ring), F.lit(max_ring)))
    tried = cells.withColumn("dy", spread).withColumn("dx", F.explode(F.sequence(F.lit(-max_ring), F.lit(max_ring)))).withColumns({"ty": F.col("iy") + F.col("dy"), "tx": F.col("ix") + F.col("dx")})
    valid = grid.filter("valid").select(F.col("iy").alias("ty"), F.col("ix").alias("tx"))
    order = F.struct(F.greatest(F.abs("dy"), F.abs("dx")), F.col("dy") * F.col("dy") + F.col("dx") * F.col("dx"), "dy", "dx")
    best = tried.join(valid, ["ty", "tx"]).groupBy("iy", "ix").agg(F.min_by(F.struct("ty", "tx"), order).alias("_best"))
    joined = points.join(best, ["iy", "ix"], "left")
    return joined.withColumns({"valid_iy": F.col("_best.ty"), "valid_ix": F.col("_best.tx"), "fallback": (F.col("_best.ty") != F.col("iy")) | (F.col("_best.tx") != F.col("ix"))}).drop("_best")


def densify_cells(cells: DataFrame, group: str) -> DataFrame:
    """Distinct (group, iy, ix) with a 0-based id by group in order of iy, ix.

    Counts per (group, iy) are summed first, so the windows run over rows of the grid, not over cells of
    the whole group: no task sorts more than a group's rows of cells or one row's cells.
    """
    from pyspark.sql import Window

    distinct = cells.select(group, "iy", "ix").distinct()
    rows = distinct.groupBy(group, "iy").agg(F.count("*").alias("_n"))
    before = rows.withColumn("_before", F.sum("_n").over(Window.partitionBy(group).orderBy("iy")) - F.col("_n")).drop("_n")
    within = F.row_number().over(Window.partitionBy(group, "iy").orderBy("ix")) - 1
    return distinct.withColumn("_within", within).join(before, [group, "iy"]).withColumn("cell_id", (F.col("_before") + F.col("_within")).cast("int")).drop("_before", "_within")
