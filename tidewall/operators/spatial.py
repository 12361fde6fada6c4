"""Geometry in columns: tile joins refined by exact predicates, areas, lengths, centroids.

A geometry is `parts`, array<array<struct<x:double,y:double>>>: the rings of one or several polygons in any order
and direction (closed or not), a line's parts, or one point. Metres on a plane. A ring in an odd number of other
rings is a hole, any other one a shell: an island in a hole adds again.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewall.sources.shared import stored

POINT = "struct<x:double,y:double>"
#: Levels that a quadtree goes down from the tiles of an outline's own extent.
DEPTH = 3


def _edges(ring: Column, closed: bool) -> Column:
    """(a, b) of a ring's edges."""
    turned = F.concat(F.slice(ring, 2, F.size(ring)), F.slice(ring, 1, 1)) if closed else F.slice(ring, 2, F.size(ring))
    return F.filter(F.arrays_zip(ring.alias("a"), turned.alias("b")), lambda e: e["b"].isNotNull())


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, v: acc + v)


def ring_area(ring: Column) -> Column:
    """Signed shoelace area."""
    return _total(F.transform(_edges(ring, True), lambda e: e["a"]["x"] * e["b"]["y"] - e["b"]["x"] * e["a"]["y"])) / 2


def ring_within(ring: Column, other: Column) -> Column:
    """Whether a ring lies in another that it does not cross: some vertex or middle of an edge is inside."""
    spots = F.concat(ring, F.transform(_edges(ring, True), lambda e: F.struct(((e["a"]["x"] + e["b"]["x"]) / 2).alias("x"), ((e["a"]["y"] + e["b"]["y"]) / 2).alias("y"))))
    least, most = (lambda r, axis: F.array_min(F.transform(r, _axis(axis)))), (lambda r, axis: F.array_max(F.transform(r, _axis(axis))))
    boxed = F.lit(True)
    for axis in "xy":
        boxed = boxed & (least(ring, axis) >= least(other, axis)) & (most(ring, axis) <= most(other, axis))
    return F.when(boxed, F.exists(spots, lambda p: contains(F.array(other), p["x"], p["y"]))).otherwise(False)


def ring_signs(parts: Column) -> Column:
    """1.0 for each shell, -1.0 for each hole, by the number of other rings that a ring lies in."""
    depth = lambda r, i: F.size(F.filter(parts, lambda o, j: (i != j) & ring_within(r, o)))
    return F.transform(parts, lambda r, i: F.when(depth(r, i) % 2 == 0, 1.0).otherwise(-1.0))


def oriented_edges(parts: Column) -> Column:
    """(a, b) of all rings' edges, with the inside to the left."""
    back = lambda edges: F.transform(edges, lambda e: F.struct(e["b"].alias("a"), e["a"].alias("b")))
    turned = lambda z: F.when(ring_area(z["r"]) * z["s"] >= 0, _edges(z["r"], True)).otherwise(back(_edges(z["r"], True)))
    return F.flatten(F.transform(F.arrays_zip(parts.alias("r"), ring_signs(parts).alias("s")), turned))


def area(parts: Column) -> Column:
    """Shells less holes."""
    return _total(F.zip_with(parts, ring_signs(parts), lambda r, s: s * F.abs(ring_area(r))))


def line_length(part: Column) -> Column:
    return _total(F.transform(_edges(part, False), lambda e: F.hypot(e["b"]["x"] - e["a"]["x"], e["b"]["y"] - e["a"]["y"])))


def length(parts: Column) -> Column:
    return _total(F.transform(parts, line_length))


def polygon_centroid(parts: Column) -> Column:
    """Struct (x, y), holes taken off by area; null without any area."""

    def moment(ring: Column, axis: str) -> Column:
        return _total(F.transform(_edges(ring, True), lambda e: (e["a"][axis] + e["b"][axis]) * (e["a"]["x"] * e["b"]["y"] - e["b"]["x"] * e["a"]["y"]))) / 6 * F.signum(ring_area(ring))

    def whole(axis: str) -> Column:
        return F.try_divide(_total(F.zip_with(parts, ring_signs(parts), lambda r, s: s * moment(r, axis))), area(parts))

    return F.struct(whole("x").alias("x"), whole("y").alias("y"))


def line_centroid(parts: Column) -> Column:
    """Struct (x, y): mean of edge midpoints, by length."""
    edges = F.flatten(F.transform(parts, lambda p: _edges(p, False)))
    size = lambda e: F.hypot(e["b"]["x"] - e["a"]["x"], e["b"]["y"] - e["a"]["y"])
    whole = _total(F.transform(edges, size))
    mean = lambda axis: _total(F.transform(edges, lambda e: size(e) * (e["a"][axis] + e["b"][axis]) / 2)) / whole
    return F.struct(mean("x").alias("x"), mean("y").alias("y"))


def contains(parts: Column, x: Column, y: Column) -> Column:
    """Whether a point lies strictly inside: an odd number of crossings to the right, and on no edge."""
    return inside_edges(F.flatten(F.transform(parts, lambda r: _edges(r, True))), x, y)


def inside_edges(edges: Column, x: Column, y: Column, sure: Column | int = 0) -> Column:
    """`contains` by the edges that matter for a point, of which `sure` more are known to be crossed."""

    def crosses(e: Column) -> Column:
        a, b = e["a"], e["b"]
        return ((a["y"] > y) != (b["y"] > y)) & (x < (b["x"] - a["x"]) * (y - a["y"]) / F.nullif(b["y"] - a["y"], F.lit(0.0)) + a["x"])

    def touches(e: Column) -> Column:
        a, b = e["a"], e["b"]
        on = (b["x"] - a["x"]) * (y - a["y"]) - (b["y"] - a["y"]) * (x - a["x"]) == 0
        return on & x.between(F.least(a["x"], b["x"]), F.greatest(a["x"], b["x"])) & y.between(F.least(a["y"], b["y"]), F.greatest(a["y"], b["y"]))

    return ((F.size(F.filter(edges, lambda e: F.coalesce(crosses(e), F.lit(False)))) + sure) % 2 == 1) & ~F.exists(edges, touches)


def segment_distance(x: Column, y: Column, a: Column, b: Column) -> Column:
    dx, dy = b["x"] - a["x"], b["y"] - a["y"]
    square = dx * dx + dy * dy
    t = F.when(square > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((x - a["x"]) * dx + (y - a["y"]) * dy) / square))).otherwise(0.0)
    return F.hypot(x - a["x"] - t * dx, y - a["y"] - t * dy)


def distance(parts: Column, x: Column, y: Column, closed: bool) -> Column:
    """To the nearest edge."""
    edges = F.flatten(F.transform(parts, lambda r: _edges(r, closed)))
    return F.array_min(F.transform(edges, lambda e: segment_distance(x, y, e["a"], e["b"])))


def with_bounds(df: DataFrame, parts: str = "parts") -> DataFrame:
    points = F.flatten(parts)
    return df.withColumns({f"{axis}{end}": f(F.transform(points, _axis(axis))) for axis in "xy" for end, f in (("min", F.array_min), ("max", F.array_max))})


def _axis(name: str):
    return lambda p: p[name]


def _start(axis: str):
    return lambda e: e["a"][axis]


def with_tiles(polygons: DataFrame, tile: float, margin: float = 0.0) -> DataFrame:
    """A row per tile (tx, ty) that a polygon's bounds, widened by margin, meet."""
    lo = lambda c: F.floor((F.col(c) - margin) / tile).cast("int")
    hi = lambda c: F.floor((F.col(c) + margin) / tile).cast("int")
    df = with_bounds(polygons).withColumn("tx", F.explode(F.sequence(lo("xmin"), hi("xmax"))))
    return df.withColumn("ty", F.explode(F.sequence(lo("ymin"), hi("ymax")))).drop("xmin", "xmax", "ymin", "ymax")


def quad_levels(polygons: DataFrame, tile: float, depth: int = DEPTH) -> range:
    """The levels that `quad_tiles` uses; one job over the outlines' bounds. Empty if no outline has any extent."""
    ends = with_bounds(polygons.select("parts")).select(_root_level(tile).alias("r")).agg(F.min("r"), F.max("r")).first()
    return range(0) if ends[0] is None else range(ends[0] - depth, ends[1] + 1)


def _root_level(tile: float) -> Column:
    """Level whose tiles are at least as long as the bounds; null for bounds without extent, in which nothing lies."""
    extent = F.greatest(F.col("xmax") - F.col("xmin"), F.col("ymax") - F.col("ymin"))
    return F.when(extent > 0, F.greatest(F.lit(-60), F.least(F.lit(60), F.ceil(F.log2(extent / tile))))).cast("int")


def quad_tiles(polygons: DataFrame, tile: float, depth: int = DEPTH) -> DataFrame:
    """(poly_id, level, tx, ty, whole, edges, sure): each outline as quadtree tiles of length tile * 2^level.

    An outline starts with the tiles of about its own extent, four at most, so its tiles are bounded by its shape
    and depth, not by its size. A tile that no edge meets is `whole` or, outside, dropped; others are split in four
    down to `depth` levels. A tile at the end keeps the edges that can matter for points in it, and in `sure` how
    many edges every ray to the right from it crosses. All of it happens within an outline's row: nothing is shuffled.
    """
    once = lambda value, name: F.explode(F.array(value)).alias(name)  # noqa: E731  # a step of its own, so that later ones do not compute it again
    df = polygons.select("poly_id", once(F.flatten(F.transform("parts", lambda r: _edges(r, True))), "edges"))
    ends = {f"{axis}{end}": f(F.transform("edges", _start(axis))) for axis in "xy" for end, f in (("min", F.array_min), ("max", F.array_max))}
    df = df.select("poly_id", "edges", once(F.struct(*[v.alias(k) for k, v in ends.items()]), "b")).select("poly_id", "edges", "b.*").withColumn("level", _root_level(tile)).filter("level is not null")
    df = df.select("*", once(tile * F.pow(F.lit(2.0), F.col("level")), "_s"))
    for axis in "xy":
        df = df.select("*", F.explode(F.sequence(F.floor(F.col(f"{axis}min") / F.col("_s")), F.floor(F.col(f"{axis}max") / F.col("_s")))).alias(f"t{axis}"))
    df = df.select("poly_id", F.explode(_judged(F.array(F.struct("level", "tx", "ty")), F.col("edges"), F.lit(0), tile)).alias("t"))
    for _ in range(depth):
        t = F.col("t")
        quarters = F.array(*[F.struct((t["level"] - 1).alias("level"), (t["tx"] * 2 + i).alias("tx"), (t["ty"] * 2 + j).alias("ty")) for i in (0, 1) for j in (0, 1)])
        df = df.select("poly_id", F.explode(F.when(t["whole"], F.array(t)).otherwise(_judged(quarters, t["edges"], t["sure"], tile))).alias("t"))
    return df.select("poly_id", "t.level", "t.tx", "t.ty", "t.whole", "t.edges", "t.sure")


def _judged(tiles: Column, edges: Column, sure: Column, tile: float) -> Column:
    """Of tiles (level, tx, ty), those that an edge meets or that lie wholly inside, with their edges; each step is bound once."""
    lo = lambda e, axis: F.least(e["a"][axis], e["b"][axis])
    hi = lambda e, axis: F.greatest(e["a"][axis], e["b"][axis])

    def sized(t: Column) -> Column:
        """Ends of the tile, with some slack: a point may be rounded into the tile beside its own."""
        size = tile * F.pow(F.lit(2.0), t["level"])
        half = size * (0.5 + 1e-12 * (F.abs(t["tx"]) + F.abs(t["ty"]) + 1))
        return F.struct(t["level"].alias("level"), t["tx"].alias("tx"), t["ty"].alias("ty"), ((t["tx"] + 0.5) * size).alias("x"), ((t["ty"] + 0.5) * size).alias("y"), half.alias("h"))

    def boxed(t: Column) -> Column:
        ends = {"x0": t["x"] - t["h"], "x1": t["x"] + t["h"], "y0": t["y"] - t["h"], "y1": t["y"] + t["h"]}
        return F.struct(*[t[k].alias(k) for k in ("level", "tx", "ty", "x", "y", "h")], *[v.alias(k) for k, v in ends.items()])

    def cut(t: Column) -> Column:
        always = lambda e: (lo(e, "x") > t["x1"]) & (lo(e, "y") <= t["y0"]) & (hi(e, "y") > t["y1"])
        matters = lambda e: (hi(e, "x") >= t["x0"]) & (lo(e, "y") <= t["y1"]) & (hi(e, "y") >= t["y0"]) & ~always(e)
        more = F.size(F.filter(edges, always))
        return F.named_struct(F.lit("t"), t, F.lit("edges"), F.filter(edges, matters), F.lit("sure"), sure + more)

    def met(k: Column) -> Column:
        """By the bounds, and by the side of an edge's line that the tile's corners lie on."""
        t = k["t"]

        def meets(e: Column) -> Column:
            dx, dy = e["b"]["x"] - e["a"]["x"], e["b"]["y"] - e["a"]["y"]
            side = F.abs(dx * (t["y"] - e["a"]["y"]) - dy * (t["x"] - e["a"]["x"]))
            return (lo(e, "x") <= t["x1"]) & (side <= (F.abs(dx) + F.abs(dy)) * t["h"] * (1 + 1e-9))

        return F.struct(k["t"].alias("t"), k["edges"].alias("edges"), k["sure"].alias("sure"), (~F.exists(k["edges"], meets)).alias("whole"))

    found = F.transform(F.transform(F.transform(F.transform(tiles, sized), boxed), cut), met)
    kept = F.filter(found, lambda k: ~k["whole"] | inside_edges(k["edges"], k["t"]["x"], k["t"]["y"], k["sure"]))
    bare = lambda k: F.struct(*[k["t"][c].alias(c) for c in ("level", "tx", "ty")], k["whole"].alias("whole"), F.when(~k["whole"], k["edges"]).alias("edges"), k["sure"].alias("sure"))
    return F.transform(kept, bare)


def distinct_rows(df: DataFrame, name: str, key: str, columns: list[str]) -> tuple[DataFrame, DataFrame]:
    """The distinct values of `columns`, each once under a text id `name`, and (name, key) of every row that has them.

    Geometry is tested once for all its copies; rows with a null among `columns` have no id."""
    once = df.groupBy(*columns).agg(F.min(key).alias("_least"))
    once = once.select(F.concat_ws("-", F.xxhash64(*columns), "_least").alias(name), *columns)
    return once, df.select(key, *columns).join(once, columns).select(name, key)


def _met(places: DataFrame, outlines: DataFrame, tile: float, depth: int, edges_too: bool = False) -> DataFrame | None:
    """(x, y, poly_id): places in outlines, of any type of poly_id, by an equality of tiles; None if no outline has any extent.

    The tiles of few outlines are many and large, so they are never broadcast."""
    sizes = [(level, tile * 2.0**level) for level in quad_levels(outlines, tile, depth)]
    if not sizes:
        return None
    at = [F.struct(F.lit(level).alias("level"), F.floor(F.col("x") / size).alias("tx"), F.floor(F.col("y") / size).alias("ty")) for level, size in sizes]
    cells = places.withColumn("_at", F.explode(F.array(*at)))
    tiles = quad_tiles(outlines, tile, depth).withColumn("_tile", F.struct("level", "tx", "ty")).select("_tile", "poly_id", "whole", "edges", "sure")
    same = reduce(Column.__and__, [F.col(f"_at.{k}") == F.col(f"_tile.{k}") for k in ("level", "tx", "ty")])
    held = F.col("whole") | inside_edges(F.col("edges"), F.col("x"), F.col("y"), F.col("sure"))
    if edges_too:
        held = held | F.exists("edges", lambda e: segment_distance(F.col("x"), F.col("y"), e["a"], e["b"]) == 0)
    return cells.join(tiles.hint("merge"), same & held).select("x", "y", "poly_id")


def sjoin_within(points: DataFrame, polygons: DataFrame, tile: float, how: str = "inner", depth: int = DEPTH) -> DataFrame:
    """points (x, y, ...) with the polygons (poly_id, parts) that strictly contain them; left keeps all points.

    Outlines are quadtree tiles (`quad_tiles`), a place has one tile of each of their levels, and the join is an
    equality of tiles: the exact test runs only in tiles that an edge meets, on the edges near by, once for each
    distinct place and outline; equalities give both their copies. Points without a place are in nothing.
    One small job runs while the frame is built (`quad_levels`).
    """
    shapes, members = distinct_rows(polygons, "_shape", "poly_id", ["parts"])
    pairs = _met(points.select("x", "y").distinct(), shapes.withColumnRenamed("_shape", "poly_id"), tile, depth)
    if pairs is None:
        nothing = F.lit(None).cast(polygons.schema["poly_id"].dataType).alias("poly_id")
        return points.select("*", nothing) if how == "left" else points.select("*", nothing).filter(F.lit(False))
    met = pairs.withColumnRenamed("poly_id", "_shape").join(members, "_shape").drop("_shape")
    return points.join(met, ["x", "y"], how).select(*points.columns, "poly_id")


def sjoin_smallest(points: DataFrame, polygons: DataFrame, tile: float, key: str) -> DataFrame:
    """(key, poly_id, area): the containing polygon of least area, ties to the smaller id.

    Of copies of an outline only the one with the smallest id can be it, and a place's is that of all points there."""
    shapes = polygons.groupBy("parts").agg(F.min("poly_id").alias("poly_id"))
    ranked = shapes.select(F.struct(area(F.col("parts")).alias("area"), "poly_id").alias("poly_id"), "parts")
    pairs = _met(points.select("x", "y").distinct(), ranked, tile, DEPTH)
    if pairs is None:
        return sjoin_within(points.select(key, "x", "y"), polygons, tile).select(key, "poly_id", F.lit(None).cast("double").alias("area"))
    at = pairs.groupBy("x", "y").agg(F.min("poly_id").alias("_b"))
    best = points.select(key, "x", "y").join(at, ["x", "y"]).groupBy(key).agg(F.min("_b").alias("_b"))
    return best.select(key, F.col("_b.poly_id").alias("poly_id"), F.col("_b.area").alias("area"))


def sjoin_nearest(points: DataFrame, polygons: DataFrame, tile: float, key: str) -> DataFrame:
    """(key, poly_id, distance): the nearest polygon of each point, 0 inside, ties to the smaller id.

    It is found for each distinct place among distinct outlines. Places inside or on the edge of outlines are settled
    by the quadtree (`_met`). Any other looks at the nine tiles around it, which show all polygons within a tile's
    length, and at those whose bounds are no farther: one whose best is within that length is done. The rest look
    again at tiles twice as long, and so on until none is left or a tile spans everything. What is left is stored
    each time. Without polygons, or without a place, nulls.
    """
    places = points.select("x", "y").filter("x is not null and y is not null").distinct()
    outlines = stored(polygons.groupBy("parts").agg(F.min("poly_id").alias("poly_id")).select("poly_id", "parts"), "outlines")
    bounded = with_bounds(outlines)
    ends = bounded.agg(F.min("xmin"), F.min("ymin"), F.max("xmax"), F.max("ymax")).first()
    reach = points.agg(F.min("x"), F.min("y"), F.max("x"), F.max("y")).first()
    known = None not in (*ends, *reach)
    span = max(max(ends[k + 2], reach[k + 2]) - min(ends[k], reach[k]) for k in (0, 1)) if known else 0.0
    dots = bounded.filter("xmin = xmax and ymin = ymax").select(F.col("xmin").alias("x"), F.col("ymin").alias("y"), "poly_id")
    held, met = places.join(dots, ["x", "y"]), _met(places, outlines, tile, DEPTH, edges_too=True)
    held = held if met is None else held.unionByName(met)
    held = stored(held.groupBy("x", "y").agg(F.min("poly_id").alias("poly_id")).withColumn("distance", F.lit(0.0)), "nearest")
    todo = stored(places.join(held.select("x", "y"), ["x", "y"], "left_anti"), "nearest")
    done, size = [held], tile
    while known and not todo.isEmpty():
        around = F.explode(F.sequence(F.lit(-1), F.lit(1)))
        cells = todo.withColumn("_dx", around).withColumn("_dy", F.explode(F.sequence(F.lit(-1), F.lit(1))))
        cells = cells.select("x", "y", (F.floor(F.col("x") / size) + F.col("_dx")).cast("int").alias("tx"), (F.floor(F.col("y") / size) + F.col("_dy")).cast("int").alias("ty"))
        tiles = with_tiles(bounded.withColumn("_box", F.struct("xmin", "xmax", "ymin", "ymax")), size)
        gap = lambda axis: F.greatest(F.col(f"_box.{axis}min") - F.col(axis), F.col(axis) - F.col(f"_box.{axis}max"), F.lit(0.0))
        near_by = (gap("x") <= size) & (gap("y") <= size) | F.lit(size > span)
        d = distance(F.col("parts"), F.col("x"), F.col("y"), True)
        best = cells.join(tiles.hint("merge"), ["tx", "ty"]).filter(near_by).groupBy("x", "y").agg(F.min(F.struct(d.alias("distance"), "poly_id")).alias("_b"))
        near = stored(best.filter((F.col("_b.distance") <= size) | F.lit(size > span)).select("x", "y", F.col("_b.poly_id").alias("poly_id"), F.col("_b.distance").alias("distance")), "nearest")
        done.append(near)
        if size > span:
            break
        todo = stored(todo.join(near.select("x", "y"), ["x", "y"], "left_anti"), "nearest")
        size *= 2
    return points.select(key, "x", "y").join(reduce(DataFrame.unionByName, done), ["x", "y"], "left").select(key, "poly_id", "distance")


def plan_tiles(df: DataFrame, pad: float = 30.0, resolution: float = 1.0, most: int = 3000) -> DataFrame:
    """Padded bounds, width and height in pixels, and whether the request is over size."""
    df = df.withColumns({"x0": F.col("xmin") - pad, "y0": F.col("ymin") - pad, "x1": F.col("xmax") + pad, "y1": F.col("ymax") + pad})
    df = df.withColumns({"width": F.ceil((F.col("x1") - F.col("x0")) / resolution).cast("int"), "height": F.ceil((F.col("y1") - F.col("y0")) / resolution).cast("int")})
    return df.withColumn("oversize", (F.col("width") > most) | (F.col("height") > most))


def bng_to_wgs84(df: DataFrame, east: str, north: str) -> DataFrame:
    """Adds lon and lat of British National Grid metres: inverse transverse Mercator on Airy 1830, then a
    Helmert shift to WGS 84; good to about 5 m. Each step is a column of its own, since later ones use it often."""
    a, b, f0 = 6377563.396, 6356256.909, 0.9996012717
    lat0, lon0, n0, e0 = math.radians(49), math.radians(-2), -100000.0, 400000.0
    e2 = 1 - b * b / (a * a)
    n = (a - b) / (a + b)
    c = F.col

    def arc(lat: Column) -> Column:
        d, s = lat - lat0, lat + lat0
        return b * f0 * ((1 + n + 1.25 * n**2 + 1.25 * n**3) * d - (3 * n + 3 * n**2 + 21 / 8 * n**3) * F.sin(d) * F.cos(s) + (15 / 8 * n**2 + 15 / 8 * n**3) * F.sin(2 * d) * F.cos(2 * s) - 35 / 24 * n**3 * F.sin(3 * d) * F.cos(3 * s))

    steps = F.sequence(F.lit(1), F.lit(6))
    y = c(north) - n0
    df = df.withColumn("_lat", F.aggregate(steps, F.lit(lat0) + y / (a * f0), lambda acc, _: acc + (y - arc(acc)) / (a * f0)))
    df = df.withColumn("_w", 1 - e2 * F.sin("_lat") * F.sin("_lat"))
    df = df.withColumns({"_nu": a * f0 / F.sqrt("_w"), "_rho": a * f0 * (1 - e2) / (c("_w") * F.sqrt("_w")), "_t": F.tan("_lat"), "_de": c(east) - e0})
    t, nu, rho, de = c("_t"), c("_nu"), c("_rho"), c("_de")
    df = df.withColumns({"_t2": t * t, "_q": de / nu, "_eta": nu / rho - 1})
    t2, q, eta = c("_t2"), c("_q"), c("_eta")
    phi = c("_lat") - t * nu / rho * (q * q / 2 - (5 + 3 * t2 + eta - 9 * t2 * eta) / 24 * F.pow(q, F.lit(4.0)) + (61 + 90 * t2 + 45 * t2 * t2) / 720 * F.pow(q, F.lit(6.0)))
    lam = lon0 + (q - (nu / rho + 2 * t2) / 6 * F.pow(q, F.lit(3.0)) + (5 + 28 * t2 + 24 * t2 * t2) / 120 * F.pow(q, F.lit(5.0)) - (61 + 662 * t2 + 1320 * t2 * t2 + 720 * t2 * t2 * t2) / 5040 * F.pow(q, F.lit(7.0))) / F.cos("_lat")
    df = df.withColumns({"_phi": phi, "_lam": lam})
    df = df.withColumn("_k", a / F.sqrt(1 - e2 * F.sin("_phi") * F.sin("_phi")))
    df = df.withColumns({"_x": c("_k") * F.cos("_phi") * F.cos("_lam"), "_y": c("_k") * F.cos("_phi") * F.sin("_lam"), "_z": c("_k") * (1 - e2) * F.sin("_phi")})
    s, rx, ry, rz = 1 - 20.4894e-6, *(math.radians(v / 3600) for v in (0.1502, 0.2470, 0.8421))
    x, yy, z = c("_x"), c("_y"), c("_z")
    df = df.withColumns({"_x2": 446.448 + s * x - rz * yy + ry * z, "_y2": -125.157 + rz * x + s * yy - rx * z, "_z2": 542.060 - ry * x + rx * yy + s * z})
    a2, b2 = 6378137.0, 6356752.314245
    w2 = 1 - b2 * b2 / (a2 * a2)
    df = df.withColumn("_p", F.hypot("_x2", "_y2"))
    lat = F.aggregate(steps, F.atan2(c("_z2"), c("_p") * (1 - w2)), lambda acc, _: F.atan2(c("_z2") + w2 * a2 / F.sqrt(1 - w2 * F.sin(acc) * F.sin(acc)) * F.sin(acc), c("_p")))
    df = df.withColumns({"lon": F.degrees(F.atan2("_y2", "_x2")), "lat": F.degrees(lat)})
    return df.drop(*[k for k in df.columns if k.startswith("_")])
