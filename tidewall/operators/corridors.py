"""Corridors along assets by the regime of their sub-type, and their exact areas inside outlines.

A corridor is what lies within a distance of an asset's line, or of its centroid where the asset is point-like: a
union of capsules. Its area inside an outline is integrated along the boundary of both (Green's theorem): pieces of
circles about vertices and of sides along edges that lie in no other capsule and inside the outline, and pieces of
the outline's edges that lie in the corridor. Pieces are cut wherever boundaries meet and judged at their middles.

Pairs come from an equality of tiles. An outline's edges are filtered to the strip that decides about a corridor
before any leaves the JVM; a pair none of whose edges comes near the corridor is settled there by one point.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Mapping

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from tidewall.operators import spatial
from tidewall.operators.clean import QualityError
from tidewall.operators.exposure import CORRIDORS, corridor_regime


def _cut(first: float, last: float, *found: np.ndarray) -> np.ndarray:
    """Sorted places between first and last where a piece is cut, both ends among them."""
    inner = np.concatenate([np.empty(0), *found])
    return np.concatenate([[first], np.sort(inner[(inner > first) & (inner < last)]), [last]])


def _on_circles(p: np.ndarray, u: np.ndarray, centres: np.ndarray, d: float) -> np.ndarray:
    """t where p + t u is at distance d of a centre."""
    away = p - centres
    a, b, c = u @ u, away @ u, (away * away).sum(axis=1) - d * d
    met, root = _roots(a, b, c, d)
    return np.concatenate([(-b[met] + s * root) / a for s in (-1, 1)])


def _roots(a, b: np.ndarray, c: np.ndarray, d: float) -> tuple[np.ndarray, np.ndarray]:
    """Which a t^2 + 2 b t + c have zeros, and half their distance times a; a line that all but touches a circle of
    radius d touches it, so no sliver is cut off there."""
    square = b * b - a * c
    touch = np.abs(square) <= 1e-10 * a * d * d
    met = (square > 0) | touch
    return met, np.sqrt(np.where(touch, 0.0, np.maximum(square, 0.0)))[met]


def _on_segments(p: np.ndarray, u: np.ndarray, q: np.ndarray, w: np.ndarray) -> np.ndarray:
    """t where p + t u meets segments q + s w; of parallel ones, the t beside their ends."""
    cross, away = u[0] * w[:, 1] - u[1] * w[:, 0], q - p
    along = np.abs(cross) <= 1e-14 * math.sqrt(u @ u) * np.sqrt((w * w).sum(axis=1))
    safe = np.where(along, 1.0, cross)
    t, s = (away[:, 0] * w[:, 1] - away[:, 1] * w[:, 0]) / safe, (away[:, 0] * u[1] - away[:, 1] * u[0]) / safe
    ends = np.concatenate([q[along], q[along] + w[along]]) - p
    return np.concatenate([t[~along & (s > -1e-9) & (s < 1 + 1e-9)], ends @ u / (u @ u)])


def _angles(c: np.ndarray, d: float, centres: np.ndarray, q: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Angles at which the circle about c meets circles of the same size and segments q + s w."""
    away = centres - c
    far = np.hypot(away[:, 0], away[:, 1])
    met = (far > 0) & (far < 2 * d)
    turn, half = np.arctan2(away[met, 1], away[met, 0]), np.arccos(far[met] / (2 * d))
    a, b, k = (w * w).sum(axis=1), ((q - c) * w).sum(axis=1), ((q - c) ** 2).sum(axis=1) - d * d
    hits, root = _roots(a, b, k, d)
    points = []
    for s in (-1, 1):
        at = (-b[hits] + s * root) / a[hits]
        on = (at > -1e-9) & (at < 1 + 1e-9)
        points.append((q[hits] + at[:, None] * w[hits])[on] - c)
    spots = np.concatenate(points)
    out = np.concatenate([turn - half, turn + half, np.arctan2(spots[:, 1], spots[:, 0])])
    return np.where(out < 0, out + 2 * math.pi, out)


def _away(points: np.ndarray, a: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(distance, foot)[point, segment]."""
    square = np.maximum((w * w).sum(axis=1), 1e-300)
    t = np.clip(((points[:, None] - a[None]) * w[None]).sum(axis=2) / square, 0, 1)
    foot = a[None] + t[..., None] * w[None]
    return np.hypot(*np.moveaxis(points[:, None] - foot, 2, 0)), foot


def _inside(points: np.ndarray, q: np.ndarray, w: np.ndarray, eps: float) -> np.ndarray:
    """Points inside by an odd number of edges to the right, and on no edge."""
    x, y = points[:, :1], points[:, 1:]
    over = (q[None, :, 1] > y) != (q[None, :, 1] + w[None, :, 1] > y)
    at = q[None, :, 0] + (y - q[None, :, 1]) * w[None, :, 0] / np.where(w[:, 1] == 0, 1.0, w[:, 1])[None]
    odd = (over & (x < at)).sum(axis=1) % 2 == 1
    return odd & (_away(points, q, w)[0].min(axis=1, initial=np.inf) > eps)


def corridor_area(edges: np.ndarray, d: float, outline: np.ndarray | None = None) -> float:
    """Area within d of the edges (ax, ay, bx, by), a point being an edge without length; inside the outline, if
    one is given: its edges with the inside to the left, as far as they decide about the corridor."""
    if not d > 0 or not len(edges):
        return 0.0
    origin = edges[:, :2].mean(axis=0)
    ends = edges.reshape(-1, 2, 2) - origin
    ends = np.where((ends[:, 0] > ends[:, 1])[:, :1] | ((ends[:, :1, 0] == ends[:, 1:, 0]) & (ends[:, :1, 1] > ends[:, 1:, 1])), ends.reshape(-1, 4)[:, [2, 3, 0, 1]], ends.reshape(-1, 4))
    ends = np.unique(ends, axis=0)
    a, w = ends[:, :2], ends[:, 2:] - ends[:, :2]
    eps = 1e-9 * max(1.0, d, float(np.abs(ends).max()))
    vertices = np.unique(ends.reshape(-1, 2), axis=0)
    size = np.hypot(w[:, 0], w[:, 1])
    long = size > 0
    normal = np.stack([w[long, 1], -w[long, 0]], axis=1) / size[long, None] * d
    owner = np.tile(np.flatnonzero(long), 2)
    side, run = np.concatenate([a[long] + normal, a[long] + w[long] - normal]), np.concatenate([w[long], -w[long]])
    q, v = (outline[:, :2] - origin, outline[:, 2:] - outline[:, :2]) if outline is not None else (np.empty((0, 2)), np.empty((0, 2)))

    def kept(middles: np.ndarray, own: int | None) -> np.ndarray:
        far, foot = _away(middles, a, w)
        on = far.min(axis=1) >= d - eps
        if own is not None:  # a side that lies on that of an edge before it is the latter's
            shared = (far <= d + eps) & (np.abs(foot - foot[:, own : own + 1]).max(axis=2) <= eps)
            on &= ~shared[:, :own].any(axis=1)
        return on & _inside(middles, q, v, eps) if outline is not None else on

    total = 0.0
    for c in vertices:
        at = _cut(0.0, 2 * math.pi, _angles(c, d, vertices, np.concatenate([side, q]), np.concatenate([run, v])))
        middle = (at[1:] + at[:-1]) / 2
        on = kept(c + d * np.stack([np.cos(middle), np.sin(middle)], axis=1), None)
        b0, b1 = at[:-1][on], at[1:][on]
        total += 0.5 * float((d * d * (b1 - b0) + d * (c[0] * (np.sin(b1) - np.sin(b0)) - c[1] * (np.cos(b1) - np.cos(b0)))).sum())
    for p, u, own in zip(side, run, owner.tolist(), strict=True):
        t = _cut(0.0, 1.0, _on_circles(p, u, vertices, d), _on_segments(p, u, np.concatenate([side, q]), np.concatenate([run, v])))
        on = kept(p + ((t[1:] + t[:-1]) / 2)[:, None] * u, own)
        total += _straight(p, u, t, on)
    reach = (np.minimum(ends[:, :2], ends[:, 2:]).min(axis=0) - d, np.maximum(ends[:, :2], ends[:, 2:]).max(axis=0) + d)
    near = ((np.maximum(q, q + v) >= reach[0]) & (np.minimum(q, q + v) <= reach[1])).all(axis=1) & (v != 0).any(axis=1)
    for p, u in zip(q[near], v[near], strict=True):
        t = _cut(0.0, 1.0, _on_circles(p, u, vertices, d), _on_segments(p, u, side, run))
        middle = p + ((t[1:] + t[:-1]) / 2)[:, None] * u
        far, foot = _away(middle, a, w)
        least = far.argmin(axis=1)
        toward = foot[np.arange(len(foot)), least] - middle
        far = far.min(axis=1)
        on = (far < d - eps) | ((far <= d + eps) & (u[0] * toward[:, 1] - u[1] * toward[:, 0] > 0))
        total += _straight(p, u, t, on)
    return total


def _straight(p: np.ndarray, u: np.ndarray, t: np.ndarray, on: np.ndarray) -> float:
    """Half the integral of x dy - y dx along the pieces that are on."""
    return 0.5 * float((t[1:] - t[:-1])[on].sum()) * float(p[0] * u[1] - p[1] * u[0])


def build_corridors(assets: DataFrame, regimes: Mapping[str, tuple[str, float]] = CORRIDORS) -> DataFrame:
    """assets (sub_type, parts of a line, others) with `distance`, and parts that are the line's centroid for
    point-like sub-types. A sub-type without a regime, null too, raises."""
    df = corridor_regime(assets, regimes)
    unknown = [r[0] for r in df.filter("corridor_unknown").select("sub_type").distinct().limit(10).collect()]
    if unknown:
        raise QualityError(f"no corridor regime for sub-types {unknown}")
    parts = F.when(F.col("corridor_kind") == "point", F.array(F.array(spatial.line_centroid(F.col("parts"))))).otherwise(F.col("parts"))
    return df.withColumn("parts", parts).withColumnRenamed("corridor_distance", "distance").drop("corridor_kind", "corridor_unknown")


def _areas(df: DataFrame, out: str, outline: str | None = None) -> DataFrame:
    """Adds the area of `corridor` (arrays of four) within `distance`, inside `outline`; drops both arrays.

    A row costs milliseconds and few bytes, so rows are dealt to as many tasks as a shuffle has, not by size.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        flat = lambda v: np.array([tuple(e.values()) if isinstance(e, dict) else tuple(e) for e in v], float).reshape(-1, 4)
        for batch in batches:
            inside = (flat(v) for v in batch[outline]) if outline else iter([None] * len(batch))
            area = [corridor_area(flat(e), float(d), o) for e, d, o in zip(batch["corridor"], batch["distance"], inside, strict=True)]
            yield batch[kept].assign(**{out: np.array(area, float)})

    kept = [c for c in df.columns if c not in ("corridor", outline)]
    dealt = df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), df.columns[0])
    return dealt.mapInPandas(run, StructType([*[df.schema[c] for c in kept], StructField(out, DoubleType())]))


def intersect_areas(corridors: DataFrame, outlines: DataFrame, key: str, tile: float) -> DataFrame:
    """(key, poly_id, area): exact area of a corridor (key, parts, distance) inside each outline (poly_id, parts);
    pairs without any have no row. An outline may be of several polygons with holes; keys are unique.

    Areas are computed once for each distinct corridor and outline; equalities give both their copies.
    """
    lines, owners = spatial.distinct_rows(corridors.filter("distance > 0"), "_line", key, ["distance", "parts"])
    shapes, members = spatial.distinct_rows(outlines, "_shape", "poly_id", ["parts"])
    areas = _distinct_areas(lines.withColumnRenamed("_line", key), shapes.withColumnRenamed("_shape", "poly_id"), key, tile)
    return areas.select(F.col(key).alias("_line"), F.col("poly_id").alias("_shape"), "area").join(owners, "_line").join(members, "_shape").select(key, "poly_id", "area")


def _distinct_areas(corridors: DataFrame, outlines: DataFrame, key: str, tile: float) -> DataFrame:
    """`intersect_areas` of corridors and outlines that are each there once.

    A pair is looked at in one of the tiles that both meet, that of the lower left corner of what their bounds share.
    The tiles of few outlines are many and large, so they are never broadcast.
    """
    edge = lambda e: F.array(e["a"]["x"], e["a"]["y"], e["b"]["x"], e["b"]["y"])
    parts = F.transform("parts", lambda p: F.when(F.size(p) == 1, F.array(F.array(p[0]["x"], p[0]["y"], p[0]["x"], p[0]["y"]))).otherwise(F.transform(spatial._edges(p, False), edge)))
    d = F.col("distance")
    lines = spatial.with_bounds(corridors.select(key, "distance", "parts")).filter(d > 0)
    lines = lines.select(key, "distance", F.flatten(parts).alias("corridor"), F.get(F.get("parts", F.lit(0)), F.lit(0)).alias("at"), *[(F.col(f"{axis}{end}") + s * d).alias(f"{axis}{end}") for axis in "xy" for end, s in (("min", -1), ("max", 1))])
    whole = _areas(lines, "whole").select(key, "whole")
    shapes = spatial.with_bounds(outlines.select("poly_id", "parts")).select("poly_id", F.transform(spatial.oriented_edges(F.col("parts")), edge).alias("outline"), *[F.col(f"{axis}{end}").alias(f"p_{axis}{end}") for axis in "xy" for end in ("min", "max")])
    place = lambda c: F.floor(F.col(c) / tile).cast("long")
    tiles = lambda df, p: df.withColumn("tx", F.explode(F.sequence(place(f"{p}xmin"), place(f"{p}xmax")))).withColumn("ty", F.explode(F.sequence(place(f"{p}ymin"), place(f"{p}ymax"))))
    met = tiles(lines, "").join(tiles(shapes, "p_").hint("merge"), ["tx", "ty"])
    met = met.filter((F.col("xmin") <= F.col("p_xmax")) & (F.col("p_xmin") <= F.col("xmax")) & (F.col("ymin") <= F.col("p_ymax")) & (F.col("p_ymin") <= F.col("ymax")))
    met = met.filter((F.col("tx") == F.greatest(place("xmin"), place("p_xmin"))) & (F.col("ty") == F.greatest(place("ymin"), place("p_ymin"))))
    beside = lambda e, i, lo, hi: (F.greatest(e[i], e[i + 2]) >= F.col(lo)) & (F.least(e[i], e[i + 2]) <= F.col(hi))
    strip = F.filter("outline", lambda e: beside(e, 1, "ymin", "ymax") & (F.greatest(e[0], e[2]) >= F.col("xmin")))
    met = met.select(key, "distance", "poly_id", "at", "corridor", strip.alias("outline"), "xmin", "xmax")
    near = F.exists("outline", lambda e: F.least(e[0], e[2]) <= F.col("xmax"))
    met = met.withColumn("near", near)
    crossed = _areas(met.filter("near").select(key, "poly_id", "distance", "corridor", "outline"), "area", "outline").select(key, "poly_id", "area")
    above = lambda e, i: e[i] > F.col("at.y")
    right = F.filter("outline", lambda e: above(e, 1) != above(e, 3))  # edges that the ray from a point meets: all lie to the right
    held = met.filter(~F.col("near") & (F.size(right) % 2 == 1)).select(key, "poly_id").join(whole, key).select(key, "poly_id", F.col("whole").alias("area"))
    return crossed.filter("area > 0").unionByName(held)


def exposure_events(assets: DataFrame, outlines: DataFrame, key: str, tile: float, regimes: Mapping[str, tuple[str, float]] = CORRIDORS) -> DataFrame:
    """A row per asset and outline whose corridor and shape share area, with intersected_area_m2 and the outline's
    attributes; numeric rec_out_id and rec_grp_id become whole numbers as text."""
    areas = intersect_areas(build_corridors(assets, regimes), outlines, key, tile)
    kinds = dict(outlines.dtypes)
    ids = {c: F.col(c).cast("long").cast("string") for c in ("rec_out_id", "rec_grp_id") if c in kinds and kinds[c] != "string"}
    return areas.withColumnRenamed("area", "intersected_area_m2").join(outlines.drop("parts").withColumns(ids), "poly_id")
