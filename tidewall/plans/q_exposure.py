"""Queries of the event-exposure operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewall.operators import exposure
from tidewall.plans.registry import query, rounded
from tidewall.plans.standins import oracle, standin

_DAYS = {"2y": 730, "5y": 1826, "15y": 5478, "lifetime": None}
_MATCH = "(src_fluvial and asset_src_fluvial) or (src_coastal and asset_src_coastal) or (src_tidal and asset_src_tidal) or (src_surface_water and asset_src_surface_water)"


def _wide_sql() -> str:
    text = oracle("si_event", "si_anchor") + ", ev as (select e.*, a.t_anchor, " + _MATCH + " as matched from si_event e join si_anchor a on e.asset_id = a.asset_id where end_date < t_anchor)"
    joins, columns = "", ["a.asset_id"]
    for w, days in _DAYS.items():
        start = f", t_anchor - {days}" if days else ""
        years = f"((t_anchor - greatest(date '1946-01-01', asset_start_date{start})) / 365.25)"
        for s in ("all", "matched"):
            key = f"{s}_{w}"
            where = " and ".join(["true", *([f"start_date >= t_anchor - {days}"] if days else []), *(["matched"] if s == "matched" else [])])
            text += f", g_{key} as (select asset_id, coalesce(rec_grp_id, 'outline:' || rec_out_id) as event, sum(area) as event_area from ev where {where} group by 1, 2)"
            text += f", s_{key} as (select asset_id, count(*) as n_events, sum(event_area) as cum_area, max(event_area) as max_event_area from g_{key} group by 1)"
            joins += f" left join s_{key} on s_{key}.asset_id = a.asset_id"
            known = "t_anchor is not null" + (" and not protection_type_missing" if s == "matched" else "")
            for stat, value in {"n_events": f"coalesce(s_{key}.n_events, 0)", "freq": f"round(case when {years} > 0 then coalesce(s_{key}.n_events, 0) / {years} end, 6)", "cum_area": f"round(coalesce(s_{key}.cum_area, 0.0), 4)", "max_event_area": f"round(coalesce(s_{key}.max_event_area, 0.0), 4)"}.items():
                columns.append(f"case when {known} then {value} end as exp__{s}__{w}__{stat}")
        if days:
            columns.append(f"case when t_anchor is not null then {years} < {days} / 365.25 end as exp__{w}__window_truncated")
    return text + " select " + ", ".join(columns) + " from si_anchor a" + joins


def _features(spark: SparkSession, d: str) -> DataFrame:
    return exposure.exposure_features(standin(spark, d, "si_event"), standin(spark, d, "si_anchor"))


@query(_wide_sql())
def e_exposure_features(spark: SparkSession, d: str) -> DataFrame:
    df = _features(spark, d)
    return rounded(rounded(df, *[c for c in df.columns if c.endswith("_area")], digits=4), *[c for c in df.columns if c.endswith("freq")])


@query(oracle("si_event") + " select asset_id, coalesce(rec_grp_id, 'outline:' || rec_out_id) as event, round(sum(area), 4) as event_area from si_event group by 1, 2")
def event_grain(spark: SparkSession, d: str) -> DataFrame:
    return rounded(exposure.event_grain(standin(spark, d, "si_event")), digits=4)


@query(
    oracle("si_asset") + """ select asset_id, case when sub_type in ('Flood Gate', 'Weir') then 'point' when sub_type is not null then 'line' end as corridor_kind,
      case when sub_type in ('Wall', 'Quay', 'Demountable Defence', 'Flood Gate', 'Weir') then 5.0::double when sub_type is not null then 20.0::double end as corridor_distance, sub_type is null as corridor_unknown from si_asset"""
)
def corridor_regime(spark: SparkSession, d: str) -> DataFrame:
    return exposure.corridor_regime(standin(spark, d, "si_asset")).select("asset_id", "corridor_kind", "corridor_distance", "corridor_unknown")


_RULES = [*[f"{k}__{s}__{t}" for s in ("all", "matched") for k, t in (("non_negative", "n_events"), ("grows", "n_events"), ("non_negative", "freq"), ("non_negative", "cum_area"), ("grows", "cum_area"), ("non_negative", "max_event_area"))], "null_pattern__all", "null_pattern__matched", *[f"matched_within_all__{w}" for w in _DAYS], "unique_asset_id"]


@query(" union all ".join(f"select '{r}' as rule, cast(0 as bigint) as n_bad" for r in _RULES))
def exposure_checks(spark: SparkSession, d: str) -> DataFrame:
    return exposure.exposure_checks(_features(spark, d))


@query(
    oracle("si_event", "si_anchor") + f""", ev as (select e.asset_id, coalesce(rec_grp_id, 'outline:' || rec_out_id) as event, area from si_event e join si_anchor a on e.asset_id = a.asset_id
      where end_date < t_anchor and start_date >= t_anchor - 1826 and ({_MATCH})), g as (select asset_id, event, sum(area) as a from ev group by 1, 2)
    select asset_id, count(*) as n_events, round(sum(a), 4) as cum_area, round(max(a), 4) as max_event_area from g group by 1"""
)
def e_windowed_stats(spark: SparkSession, d: str) -> DataFrame:
    long = exposure.exposure_long(standin(spark, d, "si_event"), standin(spark, d, "si_anchor"))
    return rounded(long.filter((F.col("subset") == "matched") & (F.col("window") == "5y")).drop("subset", "window"), digits=4)
