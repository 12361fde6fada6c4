"""Running sums, exact quantiles and correlations of groups of any size."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewall.sources.shared import stored


def null_safe_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """The join on keys of which null equals null; `left`'s keys stay."""
    on = reduce(lambda a, b: a & b, [left[k].eqNullSafe(right[k]) for k in keys])
    return left.join(right, on, how).drop(*[right[k] for k in keys])


def running_totals(rows: DataFrame, order: Sequence[Column], sums: Mapping[str, str], by: Sequence[str] = (), totals: Mapping[str, str] | None = None) -> DataFrame:
    """Adds, for each out: value of `sums`, the sum of `value` over the rows up to each one within its group; rows
    that tie in `order` count together. `totals` adds sums of whole groups. Null is a group like any other.

    Rows are sorted by group and order into ranges and stored, which runs a job when the frame is built. Each range
    sums its own part of a group and adds what the group's ranges before it hold, from a table of a row per group
    and range. So a group spreads over as many tasks as it fills, and no task needs to see all of it.
    """
    totals = totals or {}
    keys = ["_group"] if by else []
    grouped = rows.withColumn("_group", F.struct(*by)) if by else rows
    sorting = [*[F.asc(b) for b in by], *order]
    placed = stored(grouped.repartitionByRange(*sorting).sortWithinPartitions(*sorting).withColumn("_range", F.spark_partition_id()), "ranges")
    values = sorted({*sums.values(), *totals.values()})
    parts = placed.groupBy(*keys, "_range").agg(*[F.sum(v).alias(f"_part_{v}") for v in values])
    whole = Window.partitionBy(*keys)
    before = whole.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = parts.select(*keys, "_range", *[F.coalesce(F.sum(f"_part_{v}").over(before), F.lit(0)).alias(f"_before_{out}") for out, v in sums.items()], *[F.sum(f"_part_{v}").over(whole).alias(out) for out, v in totals.items()])
    inside = Window.partitionBy(*keys, "_range").orderBy(*order)
    joined = placed.join(offsets if by else F.broadcast(offsets), [*keys, "_range"])
    added = joined.withColumns({out: F.col(f"_before_{out}") + F.sum(v).over(inside) for out, v in sums.items()})
    return added.select(*rows.columns, *sums, *totals)


def exact_quantiles(df: DataFrame, value: str, at: Sequence[float], by: Sequence[str] = (), out: str = "quantiles") -> DataFrame:
    """(by, out): the quantiles of the known values as an array, interpolated linearly between the two next ranks.

    Running counts over distinct values say which value holds each wanted rank, so no task gathers the values of
    a group. NaN is the largest value. Groups without a known value have no row; without groups and values, one
    row of nulls.
    """
    counts = df.filter(F.col(value).isNotNull()).groupBy(*by, F.col(value).cast("double").alias("_v")).agg(F.count("*").alias("_n"))
    placed = running_totals(counts, [F.asc("_v")], {"_up": "_n"}, by, {"_all": "_n"})

    def held(rank: Column) -> Column:
        return F.max(F.when((rank >= F.col("_up") - F.col("_n")) & (rank < F.col("_up")), F.col("_v")))

    def quantile(q: float) -> Column:
        place = F.lit(float(q)) * (F.col("_all") - 1)
        low, high, part = held(F.floor(place)), held(F.ceil(place)), F.max(place - F.floor(place))
        return F.when((part == 0) | (low == high), low).otherwise(low + (high - low) * part)

    return placed.groupBy(*by).agg(F.array(*[quantile(q) for q in at]).alias(out))


def correlation(x: str, y: str) -> Column:
    """Aggregate: the correlation of two columns over the rows where both are known; null where one has no spread."""
    a, b = F.when(F.col(y).isNotNull(), F.col(x)), F.when(F.col(x).isNotNull(), F.col(y))
    return F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b))
