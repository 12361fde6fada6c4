"""Daily series by cell: monthly sums, spells, normals, and aggregates over lookback windows of assets."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewall.operators.clean import DAYS_A_YEAR, QualityError
from tidewall.sources.shared import stored

WINDOWS = {"2y": 730, "5y": 1826, "15y": 5478, "30y": 10957}
ADDITIVE = {"ftc": "temp", "fdd": "temp", "drydays": "rain", "r10mm": "rain", "r20mm": "rain"}
EXTREMES = ("dryspell_max", "rain_max_day")
COUNTS = ("dryspell_count_10", "dryspell_count_15", "dryspell_count_21", "rewet_15")
RECORD_FLOOR = "1960-01-01"


def load_daily(df: DataFrame, keys: Sequence[str] = ("cell_id", "date")) -> DataFrame:
    """The series, after a check (one job) that no key repeats over its files."""
    if df.groupBy(*keys).count().filter("count > 1").limit(1).count():
        raise QualityError("a key repeats in the daily series")
    return df


def sample_cells(raster: DataFrame, cells: DataFrame) -> DataFrame:
    """Long rows (cell_id, date, value) of the raster cells (iy, ix) that are asked for."""
    return raster.join(cells.select("cell_id", "iy", "ix"), ["iy", "ix"]).select("cell_id", "date", "value")


def calendar_completeness(daily: DataFrame) -> DataFrame:
    """(year, n_rows, expected, complete): cells times days of the year; the last year is excused."""
    by_year = daily.groupBy(F.year("date").alias("year")).agg(F.count("*").alias("n_rows"))
    whole = daily.agg(F.count_distinct("cell_id").alias("cells"), F.max(F.year("date")).alias("last"))
    days = F.dayofyear(F.make_date("year", F.lit(12), F.lit(31)))
    expected = (F.col("cells") * days).cast("long")
    return by_year.crossJoin(F.broadcast(whole)).select("year", "n_rows", expected.alias("expected"), ((F.col("n_rows") == expected) | (F.col("year") == F.col("last"))).alias("complete"))


def temp_monthly(daily: DataFrame) -> DataFrame:
    """(cell_id, year, month, ftc, fdd): freeze-thaw days and freezing degree days."""
    frost = F.greatest(F.lit(0.0), -(F.col("tasmin") + F.col("tasmax")) / 2)
    return daily.groupBy("cell_id", F.year("date").alias("year"), F.month("date").alias("month")).agg(F.count_if((F.col("tasmin") < 0) & (F.col("tasmax") > 0)).alias("ftc"), F.coalesce(F.sum(frost), F.lit(0.0)).alias("fdd"))


def rain_monthly(daily: DataFrame) -> DataFrame:
    """(cell_id, year, month, drydays, r10mm, r20mm)."""
    return daily.groupBy("cell_id", F.year("date").alias("year"), F.month("date").alias("month")).agg(F.count_if(F.col("value") < 1).alias("drydays"), F.count_if(F.col("value") >= 10).alias("r10mm"), F.count_if(F.col("value") >= 20).alias("r20mm"))


def spells(daily: DataFrame) -> DataFrame:
    """(cell_id, start, end, length, rewet): maximal runs of dry days (value below 1) over whole series.

    A run is a group of days whose date less their rank among the cell's dry days is one value. rewet says
    whether the up to three days after the run bring 10 or more.
    """
    by_cell = Window.partitionBy("cell_id").orderBy("date")
    ahead = F.sum("value").over(by_cell.rowsBetween(1, 3))
    dry = daily.withColumn("_ahead", F.coalesce(ahead, F.lit(0.0))).filter("value < 1")
    dry = dry.withColumn("_run", F.date_sub("date", F.row_number().over(by_cell)))
    return dry.groupBy("cell_id", "_run").agg(F.min("date").alias("start"), F.max("date").alias("end"), F.count("*").alias("length"), (F.max_by("_ahead", "date") >= 10).alias("rewet")).drop("_run")


def series_gaps(daily: DataFrame) -> DataFrame:
    """(cell_id, date, previous): days that do not follow the day before; runs need that there are none."""
    previous = F.lag("date").over(Window.partitionBy("cell_id").orderBy("date"))
    return daily.withColumn("previous", previous).filter(F.datediff("date", "previous") != 1).select("cell_id", "date", "previous")


def rain_annual(daily: DataFrame) -> DataFrame:
    """(cell_id, year, dryspell_max, dryspell_count_10/15/21, rain_max_day, rewet_15); a spell counts in the
    year in which it starts, a year without one has zeros."""
    years = daily.groupBy("cell_id", F.year("date").alias("year")).agg(F.max("value").alias("rain_max_day"))
    by_year = spells(daily).groupBy("cell_id", F.year("start").alias("year")).agg(
        F.max("length").alias("dryspell_max"),
        *[F.count_if(F.col("length") >= n).alias(f"dryspell_count_{n}") for n in (10, 15, 21)],
        F.count_if((F.col("length") >= 15) & F.col("rewet")).alias("rewet_15"),
    )
    filled = ["dryspell_max", *[f"dryspell_count_{n}" for n in (10, 15, 21)], "rewet_15"]
    return years.join(by_year, ["cell_id", "year"], "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in filled})


def normals(monthly: DataFrame, metrics: Sequence[str], first: int = 1991, last: int = 2020) -> DataFrame:
    """(cell_id, metric, mu, sd): mean and sample deviation of annual totals over the years."""
    annual = monthly.filter(F.col("year").between(first, last)).groupBy("cell_id", "year").agg(*[F.sum(m).cast("double").alias(m) for m in metrics])
    long = annual.unpivot(["cell_id", "year"], list(metrics), "metric", "value")
    return long.groupBy("cell_id", "metric").agg(F.avg("value").alias("mu"), F.stddev_samp("value").alias("sd"))


def data_ceiling(*monthly: DataFrame) -> DataFrame:
    """One row: the last day of the last month that all tables have."""
    last = [m.agg(F.last_day(F.max(F.make_date("year", "month", F.lit(1)))).alias(f"_{k}")) for k, m in enumerate(monthly)]
    return reduce(lambda a, b: a.crossJoin(b), last).select(F.least(*[f"_{k}" for k in range(len(monthly))]).alias("ceiling") if len(monthly) > 1 else F.col("_0").alias("ceiling"))


def anchor_frame(anchors: DataFrame, cells: DataFrame, ceiling: DataFrame) -> DataFrame:
    """Anchors with their cells, t_eff = the earlier of anchor and ceiling, the lag in days and the fallback flag."""
    df = anchors.join(cells, "asset_id", "left").crossJoin(F.broadcast(ceiling))
    df = df.withColumn("t_eff", F.when(F.col("t_anchor").isNotNull(), F.least("t_anchor", "ceiling")))
    return df.withColumns({"climate__ceiling_lag_days": F.datediff("t_anchor", "t_eff"), "climate__oncoast_fallback": F.col("fallback_temp") | F.col("fallback_rain")}).drop("ceiling")


def window_rows(frame: DataFrame, windows: Mapping[str, int] = WINDOWS, floor: str = RECORD_FLOOR) -> DataFrame:
    """A row per asset and window: obs_floor, obs_years, truncated and the fully included month and year bounds.

    Bounds are ordinals, both ends included; the period of t_eff never counts. All null without an anchor.
    """
    spec = F.explode(F.array(*[F.struct(F.lit(w).alias("window"), F.lit(d).alias("days")) for w, d in windows.items()]))
    df = frame.withColumn("_w", spec).select("*", "_w.window", "_w.days").drop("_w")
    known = F.col("t_eff").isNotNull()
    df = df.withColumn("obs_floor", F.when(known, F.greatest(F.date_sub("t_eff", F.col("days")), "asset_start_date", F.lit(floor).cast("date"))))
    df = df.withColumn("obs_years", F.datediff("t_eff", "obs_floor") / F.lit(DAYS_A_YEAR)).withColumn("truncated", F.col("obs_years") < F.col("days") / F.lit(DAYS_A_YEAR))
    ordinal = lambda c: F.year(c) * 12 + F.month(c) - 1
    later = lambda unit: (F.trunc("obs_floor", unit) != F.col("obs_floor")).cast("int")
    return df.withColumns({"first_month": ordinal("obs_floor") + later("month"), "last_month": ordinal("t_eff") - 1, "first_year": F.year("obs_floor") + later("year"), "last_year": F.year("t_eff") - 1})


def range_ends(series: DataFrame, index: str, metrics: Mapping[str, Sequence[str]]) -> DataFrame:
    """(cell_id, _at, and what a range that starts or ends there needs of each metric), for every index of a cell's span.

    For sums and means the running sum and count up to and before the index, as decimals of nine places, so that their
    differences carry no rounding; for maxima those over the next and
    the last 2^k indices, k from 0, each level made of the one before at two places. Indices of a cell are unique.
    The number of levels is the logarithm of the longest span, which one small job finds.
    """
    bounds = series.groupBy("cell_id").agg(F.min(index).alias("_from"), F.max(index).alias("_to"))
    at = bounds.select("cell_id", F.explode(F.sequence("_from", "_to")).alias("_at"))
    known = series.select("cell_id", F.col(index).alias("_at"), *[F.col(m).cast("double").alias(m) for m in metrics])
    by, out = Window.partitionBy("cell_id").orderBy("_at"), at.join(known, ["cell_id", "_at"], "left")
    tops, levels = [m for m, wanted in metrics.items() if "max" in wanted], 0
    if tops:
        levels = (bounds.agg(F.max(F.col("_to") - F.col("_from"))).first()[0] or 0).bit_length() + 1
    for k in range(levels):
        larger = F.array(*tops) if not k else F.zip_with(f"_{k - 1}", F.coalesce(F.lead(f"_{k - 1}", 1 << (k - 1)).over(by), F.col(f"_{k - 1}")), lambda x, y: F.greatest(x, y))
        out = out.withColumn(f"_{k}", larger)
    up = by.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    made = [F.array(*[F.col(f"_{k}") for k in range(levels)]).alias("_ahead"), F.array(*[F.lag(f"_{k}", (1 << k) - 1).over(by) for k in range(levels)]).alias("_behind")] if tops else []
    for m in metrics:
        held = F.coalesce(F.round(m, 9).cast("decimal(38,9)"), F.lit(0).cast("decimal(38,9)"))
        total, count = F.sum(held).over(up), F.count(m).over(up)
        made += [total.alias(f"{m}_upto"), (total - held).alias(f"{m}_before"), count.alias(f"{m}_n_upto"), (count - F.col(m).isNotNull().cast("long")).alias(f"{m}_n_before")]
    return out.select("cell_id", "_at", *made)


def join_window_agg(rows: DataFrame, series: DataFrame, cell: str, first: str, last: str, index: str, metrics: Mapping[str, Sequence[str]], source: DataFrame | None = None) -> DataFrame:
    """rows with {metric}__{stat} of the series (cell_id, index, metrics) over [first, last], stat sum, mean or max.

    Distinct (cell, first, last) are few against assets. Each is clipped to its cell's span and looks up its two ends
    by equality, whatever it spans: sums are differences of running sums, a maximum is the larger of two overlapping
    ones of a power of two. No value in the range: null, which a measured zero is not. `source` gives the ranges
    where rows has been joined since.
    """
    ranges = (rows if source is None else source).select(F.col(cell).alias("cell_id"), F.col(first).alias("_first"), F.col(last).alias("_last")).filter("_first <= _last").distinct()
    bounds = series.groupBy("cell_id").agg(F.min(index).alias("_from"), F.max(index).alias("_to"))
    clipped = ranges.join(bounds, "cell_id").withColumns({"_lo": F.greatest("_first", "_from"), "_hi": F.least("_last", "_to")}).filter("_lo <= _hi")
    side = lambda c, k: F.struct(F.col(c).alias("_at"), F.lit(k).alias("_end"))
    ends = clipped.select("cell_id", "_first", "_last", F.floor(F.log2(F.col("_hi") - F.col("_lo") + 1) + 1e-9).cast("int").alias("_k"), F.inline(F.array(side("_lo", 0), side("_hi", 1))))
    met = ends.join(range_ends(series, index, metrics), ["cell_id", "_at"])
    start = F.col("_end") == 0
    difference = lambda m, n="": F.sum(F.when(start, -F.col(f"{m}{n}_before")).otherwise(F.col(f"{m}{n}_upto")))
    tops, parts = [m for m, wanted in metrics.items() if "max" in wanted], []
    if tops:
        met = met.withColumn("_top", F.get(F.when(start, F.col("_ahead")).otherwise(F.col("_behind")), F.col("_k")))
    for m, wanted in metrics.items():
        count, total = difference(m, "_n"), difference(m)
        stats = {"sum": F.when(count > 0, total.cast("double")), "mean": F.when(count > 0, total.cast("double") / count)}
        if "max" in wanted:
            stats["max"] = F.max(F.get("_top", F.lit(tops.index(m))))
        parts += [stats[s].alias(f"{m}__{s}") for s in wanted]
    reduced = met.groupBy("cell_id", "_first", "_last").agg(*parts).withColumnRenamed("cell_id", "_cell")
    on = (F.col(cell) == F.col("_cell")) & (F.col(first) == F.col("_first")) & (F.col(last) == F.col("_last"))
    return rows.join(reduced, on, "left").drop("_cell", "_first", "_last")


def clipped_window_agg(rows: DataFrame, series: DataFrame, cell: str, first: str, last: str, index: str, metrics: Sequence[str], keys: Sequence[str]) -> DataFrame:
    """keys with {metric}__sum, __mean and __max over each row's range, see join_window_agg."""
    stats = ("sum", "mean", "max")
    joined = join_window_agg(rows, series, cell, first, last, index, {m: stats for m in metrics})
    return joined.select(*keys, *[f"{m}__{s}" for m in metrics for s in stats])


def climate_features(frame: DataFrame, temp: DataFrame, rain: DataFrame, annual: DataFrame, normal: DataFrame, windows: Mapping[str, int] = WINDOWS) -> DataFrame:
    """One wide row per anchor: count, rate, max_in_year and z of monthly metrics, mean, max and sum of annual
    ones, by window; truncation flags, fallback and lag.

    frame comes from anchor_frame with cell_id_temp and cell_id_rain; normal is (cell_id, group, metric, mu, sd).
    Jobs run while the frame is built: the windows are stored, and the longest spans of years looked up.
    """
    df = base = stored(window_rows(frame, windows), "windows")  # its ranges are read for every series
    keys = ["asset_id", "window"]
    ordinal = F.col("year") * 12 + F.col("month") - 1
    values = {}
    extremes = {m: ["mean", "max"] for m in EXTREMES} | {m: ["sum", "mean", "max"] for m in COUNTS}
    for group, monthly in (("temp", temp), ("rain", rain)):
        metrics = [m for m, g in ADDITIVE.items() if g == group]
        df = join_window_agg(df, monthly.withColumn("ordinal", ordinal), f"cell_id_{group}", "first_month", "last_month", "ordinal", {m: ["sum"] for m in metrics}, base)
        years = monthly.groupBy("cell_id", "year").agg(*[F.sum(m).alias(m) for m in metrics])
        wanted = {m: ["max"] for m in metrics}
        if group == "rain":
            years, wanted = years.join(annual, ["cell_id", "year"], "full"), wanted | extremes
        df = join_window_agg(df, years, f"cell_id_{group}", "first_year", "last_year", "year", wanted, base)
        df = df.withColumnsRenamed({f"{m}__sum": f"{m}__count" for m in metrics} | {f"{m}__max": f"{m}__max_in_year" for m in metrics})
        wide = normal.filter(F.col("group") == group).groupBy("cell_id").pivot("metric", metrics).agg(F.first("mu").alias("mu"), F.first("sd").alias("sd"))
        df = df.join(wide.withColumnRenamed("cell_id", f"cell_id_{group}"), f"cell_id_{group}", "left")
    for m in ADDITIVE:
        rate = F.when(F.col("obs_years") > 0, F.col(f"{m}__count") / F.col("obs_years"))
        values |= {f"{m}__count": F.col(f"{m}__count"), f"{m}__rate": rate, f"{m}__max_in_year": F.col(f"{m}__max_in_year"), f"{m}__z": F.when(F.col(f"{m}_sd") > 0, (rate - F.col(f"{m}_mu")) / F.col(f"{m}_sd"))}
    values |= {f"{m}__{s}": F.col(f"{m}__{s}") for m in EXTREMES for s in ("mean", "max")}
    values |= {f"{m}__{s}": F.col(f"{m}__{s}") for m in COUNTS for s in ("sum", "mean", "max")}
    made = df.select(*keys, "truncated", *[v.alias(n) for n, v in values.items()])
    wide = made.groupBy("asset_id").pivot("window", list(windows)).agg(*[F.first(n).alias(n) for n in [*values, "truncated"]])
    names = {f"{w}_{n}": f"climate__{n.replace('__', f'__{w}__', 1)}" for w in windows for n in values} | {f"{w}_truncated": f"climate__{w}__window_truncated" for w in windows}
    flags = frame.select("asset_id", "climate__oncoast_fallback", "climate__ceiling_lag_days")
    return wide.withColumnsRenamed(names).join(flags, "asset_id")


def plan_missing_months(have: DataFrame, first: str, last: str) -> DataFrame:
    """Months (first of each) from `first` to `last` that have no rows yet, over (date)."""
    spark = have.sparkSession
    wanted = spark.range(1).select(F.explode(F.sequence(F.lit(first).cast("date"), F.lit(last).cast("date"), F.expr("interval 1 month"))).alias("month"))
    return wanted.join(have.select(F.trunc("date", "month").alias("month")).distinct(), "month", "left_anti")


def full_years(daily: DataFrame) -> DataFrame:
    """Years of which all twelve months are there: those that compaction may rewrite."""
    return daily.groupBy(F.year("date").alias("year")).agg(F.count_distinct(F.month("date")).alias("months")).filter("months = 12").select("year")


