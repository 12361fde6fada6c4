"""Event exposure of assets over lookback windows, in one pass over the events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewall.operators.clean import DAYS_A_YEAR, SOURCES

#: Whole days of each window; a lifetime has no limit.
WINDOWS = {"2y": 730, "5y": 1826, "15y": 5478, "lifetime": None}
SUBSETS = ("all", "matched")
STATS = ("n_events", "freq", "cum_area", "max_event_area")
RECORD_ORIGIN = "1946-01-01"
# Point-like sub-types get a round corridor, the others one along their line, in metres.
CORRIDORS = {
    **{k: ("line", 20.0) for k in ("Embankment", "Engineered High Ground", "Natural High Ground", "Cliff", "Dunes", "Beach", "Barrier Beach")},
    **{k: ("line", 5.0) for k in ("Wall", "Quay", "Promenade", "Demountable Defence")},
    **{k: ("point", 5.0) for k in ("Flood Gate", "Weir", "Spillway", "Bridge Abutment")},
}


def corridor_regime(assets: DataFrame, regimes: dict[str, tuple[str, float]] = CORRIDORS) -> DataFrame:
    """Adds corridor_kind and corridor_distance by sub-type; unknown sub-types have nulls and `unknown` true."""
    spec = F.create_map(*[x for k, (kind, d) in regimes.items() for x in (F.lit(k), F.struct(F.lit(kind).alias("kind"), F.lit(d).alias("distance")))])
    found = F.when(F.col("sub_type").isNotNull(), F.try_element_at(spec, F.col("sub_type")))
    return assets.withColumn("_r", found).withColumns({"corridor_kind": F.col("_r.kind"), "corridor_distance": F.col("_r.distance"), "corridor_unknown": F.col("_r").isNull()}).drop("_r")


def event_grain(events: DataFrame) -> DataFrame:
    """(asset_id, event, event_area): outlines of one group are one event, ungrouped ones one each."""
    event = F.coalesce("rec_grp_id", F.concat(F.lit("outline:"), "rec_out_id"))
    return events.groupBy("asset_id", event.alias("event")).agg(F.sum("area").alias("event_area"))


def exposure_sums(events: DataFrame, anchors: DataFrame) -> DataFrame:
    """asset_id with n_events, cum_area and max_event_area of every subset and window ({subset}__{window}__{stat}).

    Outlines are summed by asset and event under eight conditions at once, then events by asset: one shuffle,
    whatever the number of windows. An event without an outline in a window is none of its.
    """
    matched = F.lit(False)
    for s in SOURCES:
        matched = matched | (F.col(f"src_{s}") & F.col(f"asset_src_{s}"))
    away = F.datediff("t_anchor", "start_date")
    inside = {f"{s}__{w}": (F.lit(True) if days is None else away <= days) & (F.lit(True) if s == "all" else F.coalesce(matched, F.lit(False))) for s in SUBSETS for w, days in WINDOWS.items()}
    event = F.coalesce("rec_grp_id", F.concat(F.lit("outline:"), "rec_out_id"))
    rows = events.join(anchors, "asset_id").filter(F.col("end_date") < F.col("t_anchor"))
    grain = rows.groupBy("asset_id", event.alias("event")).agg(*[F.sum(F.when(cond, F.coalesce("area", F.lit(0.0)))).alias(k) for k, cond in inside.items()])
    return grain.groupBy("asset_id").agg(*[f(k).alias(f"{k}__{stat}") for k in inside for stat, f in (("n_events", F.count), ("cum_area", F.sum), ("max_event_area", F.max))])


def exposure_long(events: DataFrame, anchors: DataFrame) -> DataFrame:
    """(asset_id, subset, window, n_events, cum_area, max_event_area): assets with an event in the window."""
    cell = lambda s, w: F.struct(F.lit(s).alias("subset"), F.lit(w).alias("window"), *[F.col(f"{s}__{w}__{stat}").alias(stat) for stat in ("n_events", "cum_area", "max_event_area")])
    return exposure_sums(events, anchors).select("asset_id", F.inline(F.array(*[cell(s, w) for s in SUBSETS for w in WINDOWS]))).filter("n_events > 0")


def exposure_features(events: DataFrame, anchors: DataFrame) -> DataFrame:
    """asset_id with exp__{subset}__{window}__{stat} and exp__{window}__window_truncated: 36 columns.

    No event is 0; a null anchor, or for `matched` a missing protection type, is null. The frequency is per
    observable year and null where there is none.
    """
    df = anchors.join(exposure_sums(events, anchors), "asset_id", "left")
    out = [F.col("asset_id")]
    for w, days in WINDOWS.items():
        start = [F.date_sub("t_anchor", days)] if days else []
        years = F.datediff("t_anchor", F.greatest(*start, "asset_start_date", F.lit(RECORD_ORIGIN).cast("date"))) / F.lit(DAYS_A_YEAR)
        for s in SUBSETS:
            unknown = F.col("t_anchor").isNull() | (F.col("protection_type_missing") if s == "matched" else F.lit(False))
            n = F.coalesce(f"{s}__{w}__n_events", F.lit(0))
            values = {"n_events": n, "freq": F.when(years > 0, n / years), "cum_area": F.coalesce(f"{s}__{w}__cum_area", F.lit(0.0)), "max_event_area": F.coalesce(f"{s}__{w}__max_event_area", F.lit(0.0))}
            out += [F.when(~unknown, v).alias(f"exp__{s}__{w}__{stat}") for stat, v in values.items()]
        if days:
            out.append((years < days / DAYS_A_YEAR).alias(f"exp__{w}__window_truncated"))
    return df.select(*out)


def exposure_checks(features: DataFrame) -> DataFrame:
    """(rule, n_bad) of the wide table: signs, finiteness, growth with the window, subset order, null pattern."""
    rules = {}
    for s in SUBSETS:
        for stat in STATS:
            cols = [F.col(f"exp__{s}__{w}__{stat}") for w in WINDOWS]
            rules[f"non_negative__{s}__{stat}"] = F.forall(F.array(*cols), lambda v: v.isNull() | ((v >= 0) & ~F.isnan(v)))
            if stat in ("n_events", "cum_area"):
                grows = F.lit(True)
                for a, b in zip(cols, cols[1:]):
                    grows = grows & (a.isNull() | (a <= b * (1 + 1e-9)))
                rules[f"grows__{s}__{stat}"] = grows
        first = F.col(f"exp__{s}__2y__n_events").isNull()
        same = F.lit(True)
        for w in WINDOWS:
            same = same & (F.col(f"exp__{s}__{w}__n_events").isNull() == first)
        rules[f"null_pattern__{s}"] = same
    for w in WINDOWS:
        a, m = F.col(f"exp__all__{w}__cum_area"), F.col(f"exp__matched__{w}__cum_area")
        rules[f"matched_within_all__{w}"] = m.isNull() | (m <= a * (1 + 1e-9))
    from tidewall.operators.clean import quality_gates

    return quality_gates(features, rules, ["asset_id"])
