"""Exact top-k search by inner product with block-at-a-time pruning.

Vectors are put in blocks of like direction and bounded size, each a forward index of ids and components.
Each signed dimension is a term: a block keeps the most and the least value it has of each dimension, and
for a query the sum of the products of its components with those maxima bounds every score in the block.
Blocks lie in parts of a few blocks. Queries, in deals of bounded size, meet the maxima of all blocks first:
each query goes to the part with its best bound. There its blocks are ordered by their bounds and scored
one after another until the next bound is below its k-th score so far. That score is its floor when it goes
to every other part that has a block with a bound not below it, where the same descent takes place and the
floor goes on rising. A block is shipped once for a whole deal of queries.

Scores are exact integers of any size: products that doubles cannot hold exactly are made of Python's own
integers, row by row, and bounds are widened by what rounding may take off them.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewall.llm.common import stored
from tidewall.llm.exact import EXACT, LONGEST, exact_products, order_bytes

SCALE = 1024.0
BLOCKS = "part long, block long, ids binary, v binary, kind string, most binary, least binary"
MEETS = "query long, query_id long, q binary, floor double, part long"
FOUND = "query long, query_id long, vec_id long, score long, beyond binary"


def fine_vectors(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", also: tuple[Column, ...] = ()) -> DataFrame:
    """(vec_id, x) and the columns of `also`: double components, without null ids and null, empty or non-finite vectors."""
    x = F.col(vector).cast("array<double>")
    infinite = F.lit(float("inf"))
    fine = F.col(key).isNotNull() & F.col(vector).isNotNull() & (F.size(vector) > 0) & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < infinite))
    return vectors.filter(fine).select(F.col(key).cast("long").alias("vec_id"), x.alias("x"), *also)


def _padded(column: pd.Series, width: int) -> np.ndarray:
    """Rows of equal width; shorter vectors are as if ended by zeros."""
    out = np.zeros((len(column), width))
    for i, v in enumerate(column):
        out[i, : len(v)] = v
    return out


def _scaled(x: np.ndarray) -> np.ndarray:
    """floor(1024 x) as doubles; infinite where those end."""
    with np.errstate(over="ignore"):
        return np.floor(SCALE * x)


def _joined(column: pd.Series, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column), np.float64).reshape(-1, width)


def build_blocks(vectors: DataFrame, width: int, block_rows: int = 256, part_blocks: int = 16, planes: int = 6, seed: int = 5) -> DataFrame:
    """BLOCKS: forward index and maxima of each block; `v` holds scaled integers, or the components where those are large.

    A block holds vectors on one side of each of some random planes, so that maxima are close to the
    values; a full side is split by a hash of the row's place, so that vectors that repeat are spread too.
    """
    normals = np.random.default_rng(seed).normal(size=(planes, width))

    def side(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            x = _padded(batch["x"], width)
            largest = np.maximum(np.abs(x).max(axis=1, initial=0), 1e-300)[:, None]
            sides = (x / largest @ normals.T > 0) @ (1 << np.arange(planes))
            yield pd.DataFrame({"vec_id": batch["vec_id"], "x": [row.tobytes() for row in x], "side": sides.astype(np.int64)})

    sided = stored(vectors.mapInPandas(side, "vec_id long, x binary, side long"), "vectors")
    sizes = sided.groupBy("side").agg(F.ceil(F.count("*") / block_rows).alias("blocks"))
    dealt = sided.withColumn("place", F.xxhash64(F.monotonically_increasing_id())).join(sizes, "side").withColumn("at", F.pmod("place", "blocks"))
    dealt = dealt.select(F.shiftleft("side", 40).alias("base"), "at", "vec_id", "x").select((F.col("base") + F.floor(F.col("at") / part_blocks)).alias("part"), (F.col("base") + F.col("at")).alias("block"), "vec_id", "x")

    def pack(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("vec_id", kind="stable")
        x = _joined(group["x"], width)
        v = _scaled(x)
        largest = np.abs(v).max(initial=0)
        kind = "<i2" if largest < 1 << 15 else "<i4" if largest < 1 << 31 else "<f8"
        held = x if kind == "<f8" else v.astype(kind)
        return pd.DataFrame({"part": group["part"].iloc[:1], "block": group["block"].iloc[:1], "ids": [group["vec_id"].to_numpy(np.int64).tobytes()], "v": [held.tobytes()], "kind": [kind], "most": [v.max(axis=0).tobytes()], "least": [v.min(axis=0).tobytes()]})

    return dealt.groupBy("block").applyInPandas(pack, BLOCKS)


def _bounds(q: np.ndarray, most: np.ndarray, least: np.ndarray) -> np.ndarray:
    """bound[query, block]: the sum over dimensions of the query's component times the term's maximum, rounded up."""
    with np.errstate(over="ignore", invalid="ignore"):
        up, down = np.maximum(q, 0), np.minimum(q, 0)
        bound = up @ most.T + down @ least.T
        slack = (up @ np.abs(most).T - down @ np.abs(least).T) * (q.shape[1] + 2) * 2.0**-51
        return np.where(np.isfinite(bound + slack), bound + slack, np.inf)


def _products(q: np.ndarray, q_x: np.ndarray, v: np.ndarray, v_x: np.ndarray | None) -> np.ndarray:
    return exact_products(q, q_x, v, v_x, SCALE)


def _best(at: np.ndarray, ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best rows of each query: highest score, then least id."""
    if scores.dtype == object:
        order = np.array(sorted(range(len(at)), key=lambda i: (at[i], -scores[i], ids[i])), np.int64)
    else:
        order = np.lexsort((ids, -scores, at))
    ordered = at[order]
    first = np.searchsorted(ordered, ordered)
    return order[np.arange(len(order)) - first < k]


def descend(blocks: pd.DataFrame, queries: pd.DataFrame, width: int, k: int) -> pd.DataFrame:
    """FOUND: each query's k best in these blocks that reach its floor, by descending bounds with a rising floor."""
    q_x = _joined(queries["q"], width)
    q, own, floor = _scaled(q_x), queries["query_id"].to_numpy(), queries["floor"].to_numpy(float)
    bound = _bounds(q, _joined(blocks["most"], width), _joined(blocks["least"], width))
    order = np.argsort(-bound, axis=1, kind="stable")
    best = np.repeat(floor[:, None], k, axis=1)  # the k best scores so far, at least
    kept = (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))
    opened: dict[int, tuple] = {}
    for turn in range(len(blocks)):
        which = order[:, turn]
        kth = best.min(axis=1)
        going = bound[np.arange(len(q)), which] >= kth
        if not going.any():
            break
        for b in np.unique(which[going]).tolist():
            rows = np.flatnonzero(going & (which == b))
            if b not in opened:
                held = np.frombuffer(blocks["v"].iloc[b], blocks["kind"].iloc[b]).reshape(-1, width)
                large = blocks["kind"].iloc[b] == "<f8"
                opened[b] = (np.frombuffer(blocks["ids"].iloc[b], np.int64), _scaled(held) if large else held.astype(float), held if large else None)
            ids, v, v_x = opened[b]
            scores = _products(q[rows], q_x[rows], v, v_x)
            fits = (scores >= kth[rows][:, None]).astype(bool) & (ids[None, :] != own[rows][:, None])
            at, column = np.nonzero(fits)
            kept = tuple(np.concatenate([x, y]) for x, y in zip(kept, (rows[at], ids[column], scores[at, column]), strict=True))
            if scores.dtype == object and best.dtype != object:
                best = best.astype(object)
            merged = np.concatenate([best[rows], np.where(fits, scores, -math.inf)], axis=1)
            best[rows] = (np.sort(merged, axis=1) if merged.dtype == object else np.partition(merged, merged.shape[1] - k, axis=1))[:, -k:]
            if len(kept[0]) > 8 * k * len(q) + 100_000:
                places = _best(*kept, k)
                kept = tuple(x[places] for x in kept)
    places = _best(*kept, k)
    at, ids, scores = (x[places] for x in kept)
    whole = [int(s) for s in scores.tolist()]
    clipped = [max(-LONGEST - 1, min(LONGEST, s)) for s in whole]
    return pd.DataFrame({"query": queries["query"].to_numpy()[at], "query_id": own[at], "vec_id": ids, "score": np.array(clipped, np.int64), "beyond": [order_bytes(s) for s in whole]})


def top_k(vectors: DataFrame, k: int = 10, every: int = 100, block_rows: int = 256, part_blocks: int = 16, deal_queries: int = 4096) -> DataFrame:
    """query_id, rank, vec_id, score: the k best of all other vectors for every id divisible by `every`.

    Ties go to the smaller id. Rows with the query's own id are not candidates for it; other ids that
    repeat are candidates each time, and of equal query rows one is asked. Vectors of unlike length are
    compared as if ended by zeros. Ranks go by the whole score, however large; one that 64 bits cannot hold
    is told as the nearest number that they can. Fewer vectors than k give fewer ranks, an empty table none.
    """
    spark = vectors.sparkSession
    rows = fine_vectors(vectors)
    width = rows.agg(F.max(F.size("x"))).first()[0]
    if not width:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    blocks = stored(build_blocks(rows, width, block_rows, part_blocks), "blocks")

    def as_bytes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"query_id": batch["vec_id"], "q": [row.tobytes() for row in _padded(batch["x"], width)]})

    asked = rows.filter(F.pmod("vec_id", F.lit(every)) == 0).mapInPandas(as_bytes, "query_id long, q binary").distinct()
    asked = stored(asked.select(F.xxhash64("query_id", "q").alias("query"), "query_id", "q"), "queries")
    deals, packs = max(1, -(-asked.count() // deal_queries)), max(1, -(-blocks.count() // 2048))
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    deal = F.pmod(F.xxhash64("query"), F.lit(deals)).cast("int")
    maxima = blocks.select(F.pmod(F.xxhash64("part"), F.lit(packs)).cast("int").alias("pack"), "part", "most", "least").withColumn("deal", each(deals))

    def meets(floors: DataFrame, first: bool) -> DataFrame:
        """MEETS: per pack the part with the best bound of each query, or all parts with a bound at or above its floor."""

        def judge(maxima: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
            if not len(maxima) or not len(queries):
                return pd.DataFrame({c.split()[0]: pd.Series(dtype=object) for c in (MEETS + ", bound double").split(", ")})
            maxima = maxima.sort_values("part", kind="stable")
            parts, starts = np.unique(maxima["part"].to_numpy(), return_index=True)
            most, least = (_joined(maxima[c], width) for c in ("most", "least"))
            found = []
            for at in range(0, len(queries), 512):
                some = queries.iloc[at : at + 512]
                bound = np.maximum.reduceat(_bounds(_scaled(_joined(some["q"], width)), most, least), starts, axis=1)
                if first:
                    i, j = np.arange(len(some)), bound.argmax(axis=1)
                else:
                    i, j = np.nonzero((bound >= some["floor"].to_numpy()[:, None]) & (parts[None, :] != some["part"].to_numpy()[:, None]))
                found.append(some.iloc[i].assign(part=parts[j], bound=bound[i, j]))
            return pd.concat(found)[["query", "query_id", "q", "floor", "part", "bound"]]

        dealt = floors.withColumn("deal", deal).withColumn("pack", each(packs))
        met = maxima.groupBy("pack", "deal").cogroup(dealt.groupBy("pack", "deal")).applyInPandas(judge, MEETS + ", bound double")
        if first:
            best = Window.partitionBy("query").orderBy(F.col("bound").desc(), "part")
            met = met.withColumn("at", F.row_number().over(best)).filter(F.col("at") == 1).drop("at")
        return met.drop("bound")

    def found(met: DataFrame) -> DataFrame:
        dealt = met.withColumn("deal", deal)
        needed = blocks.join(dealt.select(F.col("part").alias("to_part"), F.col("deal").alias("to_deal")).distinct(), F.col("part") == F.col("to_part"))

        def run(blocks: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
            return descend(blocks, queries, width, k)

        return needed.groupBy("to_part", "to_deal").cogroup(dealt.groupBy("part", "deal")).applyInPandas(run, FOUND)

    none = F.lit(float("-inf"))
    best_first = Window.partitionBy("query").orderBy(F.col("score").desc(), F.col("beyond").desc(), "vec_id")
    home = stored(meets(asked.withColumns({"floor": none, "part": F.lit(-1).cast("long")}), True), "meets")
    near = stored(found(home), "found")
    below = F.when(F.min("score") > -EXACT, F.min("score").cast("double") * F.when(F.min("score") > 0, 1 - 2.0**-51).otherwise(1 + 2.0**-51)).otherwise(none)
    floors = near.groupBy("query").agg(F.when(F.count("*") >= k, below).otherwise(none).alias("kth"))
    rest = home.join(floors, "query", "left").select("query", "query_id", "q", F.coalesce("kth", none).alias("floor"), "part")
    ranked = near.unionByName(found(stored(meets(rest, False), "meets"))).withColumn("rank", F.row_number().over(best_first)).filter(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
