"""Terrain along lines: stations, transects, crests and toes, detrended residuals, gated summaries."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewall.operators.running import correlation, exact_quantiles, null_safe_join
from tidewall.operators.spatial import line_length
from tidewall.sources.shared import stored

RISE = 0.02


def longest_line(parts: Column) -> Column:
    """The longest line after parts are chained, in order, where one ends as the next begins."""
    def chain(acc: Column, part: Column) -> Column:
        last = F.element_at(acc, -1)
        meets = F.element_at(last, -1) == part[0]
        joined = F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.concat(last, F.slice(part, 2, F.size(part)))))
        return F.when(F.size(acc) == 0, F.array(part)).otherwise(F.when(meets, joined).otherwise(F.concat(acc, F.array(part))))

    chained = F.aggregate(parts, F.array().cast("array<array<struct<x:double,y:double>>>"), chain)
    sized = F.transform(chained, lambda p: F.struct(line_length(p).alias("size"), p.alias("line")))
    return F.aggregate(sized, F.struct(F.lit(-1.0).alias("size"), F.array().cast("array<struct<x:double,y:double>>").alias("line")), lambda acc, p: F.when(p["size"] > acc["size"], p).otherwise(acc))["line"]


def _place(vertices: Column, at: Column) -> Column:
    """The point of a line (vertices with their chainage m) at a distance, clamped to its ends."""
    last = F.element_at(vertices, -1)
    clamped = F.greatest(F.lit(0.0), F.least(at, last["m"]))
    i = F.greatest(F.lit(1), F.least(F.size(vertices) - 1, F.size(F.filter(vertices, lambda v: v["m"] <= clamped))))
    a, b = F.element_at(vertices, i), F.element_at(vertices, i + 1)
    t = F.when(b["m"] > a["m"], (clamped - a["m"]) / (b["m"] - a["m"])).otherwise(0.0)
    return F.struct((a["x"] + t * (b["x"] - a["x"])).alias("x"), (a["y"] + t * (b["y"] - a["y"])).alias("y"))


def stations(lines: DataFrame, key: str, step: float = 5.0, reach: float = 2.5) -> DataFrame:
    """(key, chainage, x, y, nx, ny): points every `step` from 0, the end excluded, with the unit left normal of
    the chord from `reach` before to `reach` after. lines has key and `line`, an array of points."""
    start = F.struct(F.array().cast("array<struct<x:double,y:double,m:double>>").alias("v"), F.lit(0.0).alias("m"))

    def grow(acc: Column, p: Column) -> Column:
        before = F.element_at(acc["v"], -1)
        m = F.when(F.size(acc["v"]) == 0, 0.0).otherwise(acc["m"] + F.hypot(p["x"] - before["x"], p["y"] - before["y"]))
        return F.struct(F.concat(acc["v"], F.array(F.struct(p["x"].alias("x"), p["y"].alias("y"), m.alias("m")))).alias("v"), m.alias("m"))

    first = F.struct(F.array(F.struct(F.col("line")[0]["x"].alias("x"), F.col("line")[0]["y"].alias("y"), F.lit(0.0).alias("m"))).alias("v"), F.lit(0.0).alias("m"))
    df = lines.filter(F.size("line") > 1).withColumn("_v", F.aggregate(F.slice("line", 2, F.size("line")), first, grow))
    df = df.select(key, F.col("_v.v").alias("_v"), F.col("_v.m").alias("_m")).filter(F.col("_m") > 0)
    df = df.withColumn("_k", F.explode(F.sequence(F.lit(0), F.ceil(F.col("_m") / step).cast("int") - 1))).withColumn("chainage", F.col("_k") * F.lit(step))
    df = df.withColumns({"_p": _place(F.col("_v"), F.col("chainage")), "_a": _place(F.col("_v"), F.col("chainage") - reach), "_b": _place(F.col("_v"), F.col("chainage") + reach)})
    dx, dy = F.col("_b.x") - F.col("_a.x"), F.col("_b.y") - F.col("_a.y")
    size = F.hypot(dx, dy)
    return df.select(key, "chainage", F.col("_p.x").alias("x"), F.col("_p.y").alias("y"), F.try_divide(-dy, size).alias("nx"), F.try_divide(dx, size).alias("ny"))


def sample_transects(points: DataFrame, raster: DataFrame, key: str, half: int = 25, cell: float = 1.0) -> DataFrame:
    """(key, chainage, profile): raster values (row, col, value) at each metre from -half to half along the normal;
    null where there is no cell. (key, chainage) is unique.

    A row joins once for each run of samples in one cell; neither side is broadcast, as a raster may have any size.
    """
    at = transect_runs(points.select(key, "chainage", "x", "y", "nx", "ny"), half, cell).select(key, "chainage", "start", "row", "col")
    joined = at.join(raster.hint("merge"), ["row", "col"], "left")
    df = joined.groupBy(key, "chainage").agg(F.sort_array(F.collect_list(F.struct("start", "value"))).alias("_runs"))
    ends = lambda r, i: F.coalesce(F.get("_runs", i + 1)["start"], F.lit(half + 1))
    return df.select(key, "chainage", F.flatten(F.transform("_runs", lambda r, i: F.array_repeat(r["value"], ends(r, i) - r["start"]))).alias("profile"))


def transect_runs(points: DataFrame, half: int, cell: float) -> DataFrame:
    """points (x, y, nx, ny, ...) with a row per run of samples from -half to half that lie in one cell: the offset
    `start` of its first one, row and col."""
    place = lambda axis, o: F.floor((F.col(axis) + o * F.col(f"n{axis}")) / cell).cast("int")
    begins = lambda o: (o == -half) | ~place("x", o).eqNullSafe(place("x", o - 1)) | ~place("y", o).eqNullSafe(place("y", o - 1))
    runs = points.withColumn("start", F.explode(F.filter(F.sequence(F.lit(-half), F.lit(half)), begins)))
    return runs.withColumns({"row": place("y", F.col("start")), "col": place("x", F.col("start"))})


def smoothed(profile: Column) -> Column:
    """Three-wide means with zeros beyond the ends; nulls take the least known value first."""
    least = F.array_min(profile)
    filled = F.transform(profile, lambda v: F.coalesce(v, least))
    return F.transform(filled, lambda v, i: (v + F.coalesce(F.get(filled, i - 1), F.lit(0.0)) + F.coalesce(F.get(filled, i + 1), F.lit(0.0))) / 3)


def _walk(smooth: Column, raw: Column, start: Column, step: int) -> Column:
    """Index where a walk from the crest stops: before a rise of more than RISE or an unknown value, or at the bound."""
    n = F.size(smooth)
    begin = F.struct(start.cast("int").alias("i"), F.lit(False).alias("stop"))

    def go(acc: Column, _: Column) -> Column:
        to = acc["i"] + step
        inside = (to > 0) & (to < n)
        rises = F.get(smooth, to) > F.get(smooth, acc["i"]) + RISE
        stop = acc["stop"] | ~inside | F.get(raw, to).isNull() | F.coalesce(rises, F.lit(True))
        return F.struct(F.when(stop, acc["i"]).otherwise(to).cast("int").alias("i"), stop.alias("stop"))

    return F.aggregate(smooth, begin, go, lambda acc: acc["i"])


def crest_toes(transects: DataFrame, profile: str = "profile", centre: int = 25, search: int = 10) -> DataFrame:
    """Adds crest_off, crest_z, toe_l_z, toe_r_z, prominence, relheight and footprint_width (1 m samples).

    The crest is the first largest smoothed value within `search` of the centre; a station without any value, or
    with an unknown crest cell, has nulls.
    """
    raw = F.col("_raw")
    df = transects.withColumn("_raw", F.transform(profile, lambda v: v.cast("double")))
    df = df.withColumn("_s", smoothed(raw))
    near = F.slice("_s", centre - search + 1, 2 * search + 1)
    df = df.withColumn("_c", F.when(F.array_max(raw).isNotNull(), F.array_position(near, F.array_max(near)).cast("int") - 1 + centre - search))
    df = df.withColumn("_c", F.when(F.get(raw, F.col("_c")).isNotNull(), F.col("_c")))
    df = df.withColumns({"_l": F.when(F.col("_c").isNotNull(), _walk(F.col("_s"), raw, F.col("_c"), -1)), "_r": F.when(F.col("_c").isNotNull(), _walk(F.col("_s"), raw, F.col("_c"), 1))})
    df = df.withColumns({"crest_off": (F.col("_c") - centre).cast("double"), "crest_z": F.get(raw, F.col("_c")), "toe_l_z": F.get(raw, F.col("_l")), "toe_r_z": F.get(raw, F.col("_r"))})
    l, r, c = F.col("toe_l_z"), F.col("toe_r_z"), F.col("crest_z")
    return df.withColumns({"prominence": c - F.greatest(l, r), "relheight": c - (l + r) / 2, "footprint_width": (F.col("_r") - F.col("_l")).cast("double")}).drop("_raw", "_s", "_c", "_l", "_r")


def enough_stations(df: DataFrame, key: str, least: int = 3, least_length: float = 15.0) -> DataFrame:
    """Rows of assets that have enough stations over enough length."""
    by = Window.partitionBy(key)
    df = df.withColumns({"_n": F.count("*").over(by), "_l": F.max("chainage").over(by) - F.min("chainage").over(by)})
    return df.filter((F.col("_n") >= least) & (F.col("_l") >= least_length)).drop("_n", "_l")


def smoothing_weights(width: int, degree: int = 2) -> list[list[float]]:
    """Row i: the weights that give the fitted polynomial's value at point i of a window of `width` points."""
    x = np.vander(np.arange(width) - width // 2, degree + 1)
    return (x @ np.linalg.pinv(x)).tolist()


def detrend(df: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """Adds trend and residual: a quadratic Savitzky-Golay smooth by key in order, the ends by their windows' fits.

    The window is the largest odd number of points up to 11; assets with fewer than 5 points have nulls. The
    few weight rows are a broadcast table, and each row has its neighbours' values, ten on either side at most.
    """
    spark = df.sparkSession
    rows = [(w, i, weights) for w in (5, 7, 9, 11) for i, weights in enumerate(smoothing_weights(w))]
    table = F.broadcast(spark.createDataFrame(rows, "_w int, _at int, _weights array<double>"))
    by = Window.partitionBy(key).orderBy(order)
    whole = Window.partitionBy(key)
    df = df.withColumns({"_i": F.row_number().over(by) - 1, "_n": F.count("*").over(whole), "_v": F.collect_list(F.struct(F.col(value).alias("v"))).over(by.rowsBetween(-10, 10))})
    width = F.least(F.lit(11), F.col("_n") - 1 + F.col("_n") % 2).cast("int")
    df = df.withColumn("_w", F.when(F.col("_n") >= 5, width))
    half = F.floor(F.col("_w") / 2).cast("int")
    first = F.greatest(F.lit(0), F.least(F.col("_i") - half, F.col("_n").cast("int") - F.col("_w")))
    df = df.withColumn("_first", first).withColumn("_at", F.col("_i") - F.col("_first"))
    joined = df.join(table, ["_w", "_at"], "left")
    used = F.slice("_v", F.col("_first") - F.greatest(F.lit(0), F.col("_i") - 10) + 1, F.col("_w"))
    trend = F.when(F.col("_w").isNotNull(), F.aggregate(F.zip_with(used, F.col("_weights"), lambda a, b: a["v"] * b), F.lit(0.0), lambda acc, v: acc + v))
    return joined.withColumn("trend", trend).withColumn("residual", F.col(value) - F.col("trend")).drop("_w", "_at", "_i", "_n", "_v", "_first", "_weights")


def residual_stats(df: DataFrame, key: str, order: str = "chainage", floor: float = 0.05) -> DataFrame:
    """(key, resid_std, resid_max_dip, resid_lag1, resid_tv_range): the last two only where the deviation reaches `floor`."""
    by = Window.partitionBy(key).orderBy(order)
    rows = df.filter("residual is not null").withColumn("_before", F.lag("residual").over(by))
    out = rows.groupBy(key).agg(
        F.stddev_pop("residual").alias("resid_std"), (-F.min("residual")).alias("resid_max_dip"), correlation("_before", "residual").alias("_c"),
        F.sum(F.abs(F.col("residual") - F.col("_before"))).alias("_tv"), (F.max("residual") - F.min("residual")).alias("_range"),
    )
    rough = F.col("resid_std") >= floor
    return out.select(key, "resid_std", "resid_max_dip", F.when(rough, F.col("_c")).alias("resid_lag1"), F.when(rough, F.try_divide("_tv", "_range")).alias("resid_tv_range"))


#: Tiers whose geometry can be trusted, and the least median prominence and number of stations.
TRUSTED, LEAST_PROMINENCE, LEAST_STATIONS = ("engineered_raised", "natural_geomorphic"), 0.25, 5
GEOMETRY = ("relheight_mean", "relheight_min", "relheight_std", "width_mean", "resid_std", "resid_max_dip", "resid_ac1", "resid_tv_range")


def line_features(stations: DataFrame, scope: DataFrame, key: str = "asset_id", trusted: tuple[str, ...] = TRUSTED, least_prominence: float = LEAST_PROMINENCE, least: int = LEAST_STATIONS) -> DataFrame:
    """key, tier, n_stations, crest_offset_median, crest_prominence_median, crest_found and crest_ with each of GEOMETRY.

    One row per scoped asset. crest_found is whether the summary can be trusted (a trusted tier, enough
    stations, and enough median prominence); else the geometry is null. Assets without stations have 0 of them.
    """
    known = stations.filter("crest_z is not null")
    summed = known.groupBy(key).agg(
        F.min_by("tier", "chainage").alias("tier"), F.count("*").alias("n_stations"), F.median(F.abs("crest_off")).alias("crest_offset_median"), F.median("prominence").alias("crest_prominence_median"),
        F.avg("relheight").alias("relheight_mean"), F.min("relheight").alias("relheight_min"), F.stddev_pop("relheight").alias("relheight_std"), F.avg("footprint_width").alias("width_mean"),
    )
    rough = residual_stats(detrend(known, key, "chainage", "crest_z"), key).withColumnRenamed("resid_lag1", "resid_ac1")
    valid = F.col("tier").isin(*trusted) & (F.col("crest_prominence_median") >= least_prominence) & (F.col("n_stations") >= least)
    df = summed.join(rough, key, "left").withColumn("crest_found", F.coalesce(valid, F.lit(False)))
    df = df.select(key, "tier", "n_stations", "crest_offset_median", "crest_prominence_median", "crest_found", *[F.when(F.col("crest_found"), F.col(c)).alias(f"crest_{c}") for c in GEOMETRY])
    spine = scope.select(key).distinct().join(df, key, "left")
    return spine.withColumns({"crest_found": F.coalesce("crest_found", F.lit(False)), "n_stations": F.coalesce("n_stations", F.lit(0))})


def station_qc(stations: DataFrame, search: int = 10, floor: float = 0.25) -> DataFrame:
    """(tier, n, pinned, below_floor, q25, q50, q75): crests at the search bound, low prominence, and quartiles.

    Both passes read three stored columns, since crests are dear to find; runs jobs when the frame is built."""
    known = stored(stations.filter("crest_z is not null").select("tier", "crest_off", "prominence"), "stations")
    out = known.groupBy("tier").agg(F.count("*").alias("n"), F.avg((F.abs("crest_off") >= search).cast("int")).alias("pinned"), F.avg((F.col("prominence") < floor).cast("int")).alias("below_floor"))
    out = null_safe_join(out, exact_quantiles(known, "prominence", [0.25, 0.5, 0.75], ["tier"], "_q"), ["tier"], "left")
    return out.select("tier", "n", "pinned", "below_floor", *[F.col("_q")[i].alias(f"q{k}") for i, k in enumerate((25, 50, 75))])
