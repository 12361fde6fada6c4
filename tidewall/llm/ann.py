"""Approximate nearest neighbours by cross-polytope hashing.

A pseudo-rotation turns random signs and a fast Hadamard transform three times over. A hash rotates the unit
vector and takes the signed axis nearest to it; a bucket of a table is named by the axes of a few hashes. A query
probes buckets in all tables in the order of how much nearer its own axes are than those of the bucket, and the
rows of the buckets that it probes are its candidates, ranked by their exact distance.

How many buckets a query probes is fitted: a bounded sample of rows (`sample`, by least hash) is searched exactly
against all rows, and the least number of probes that finds the share `recall` of their neighbours is taken. All
rows are indexed. The more rows there are, the more hashes name a bucket; should the sample not reach its recall
by the probes that are listed, one hash less is used, and with one hash the list is that of all buckets.

A bucket's rows meet the queries that probe it in blocks of bounded size, each with its best k only, so neither
copies of a vector nor a cluster makes a list of pairs. Tables are made a few at a time; the shuffle of each turn
is freed before the next.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewall.llm.common import discard, stored
from tidewall.llm.topk import fine_vectors

INDEXED = "place int, bucket long, row long, vec_id long, x binary"
PROBES = "place int, bucket long, query long, query_id long, q binary"
FOUND = "query long, query_id long, row long, vec_id long, score double"
#: Axes of each hash that listed probes may take, by the number of hashes; with one hash all of them.
LISTED = {2: 48, 3: 14, 4: 7}


def _hadamard(x: np.ndarray) -> np.ndarray:
    """Rows times the orthonormal Hadamard matrix; their length is a power of two."""
    n, width = x.shape
    half = 1
    while half < width:
        pairs = x.reshape(n, -1, 2, half)
        x = np.stack([pairs[:, :, 0] + pairs[:, :, 1], pairs[:, :, 0] - pairs[:, :, 1]], axis=2).reshape(n, width)
        half *= 2
    return x / math.sqrt(width)


class CrossPolytope:
    """Buckets of `tables` hash tables, each named by the nearest signed axes of `hashes` pseudo-rotations."""

    def __init__(self, width: int, tables: int, hashes: int, seed: int = 11):
        self.size = 1 << max(0, width - 1).bit_length()
        self.tables, self.hashes = tables, hashes
        self.signs = np.random.default_rng(seed).choice((-1.0, 1.0), size=(tables, hashes, 3, self.size))

    def sides(self, x: np.ndarray, table: int, h: int) -> np.ndarray:
        """[row, signed axis]: the rotated unit vector along each axis and against it."""
        largest = np.abs(x).max(axis=1, keepdims=True, initial=np.finfo(float).tiny)
        y = np.zeros((len(x), self.size))
        y[:, : x.shape[1]] = x / largest
        y /= np.maximum(np.linalg.norm(y, axis=1, keepdims=True), 1e-300)
        for signs in self.signs[table, h]:
            y = _hadamard(y * signs)
        return np.concatenate([y, -y], axis=1)

    def buckets(self, x: np.ndarray, table: int) -> np.ndarray:
        name = np.zeros(len(x), np.int64)
        for h in range(self.hashes):
            name = name * (2 * self.size) + self.sides(x, table, h).argmax(axis=1)
        return name

    def probes(self, x: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
        """(table, bucket)[row, turn]: the listed buckets of all tables, likeliest first, `most` at most."""
        taken = min(2 * self.size, LISTED.get(self.hashes, 5) if self.hashes > 1 else 2 * self.size)
        combos = np.array(list(itertools.product(range(taken), repeat=self.hashes)))
        gaps, names = [], []
        for t in range(self.tables):
            gap, name = np.zeros((len(x), len(combos))), np.zeros((len(x), len(combos)), np.int64)
            for h in range(self.hashes):
                side = self.sides(x, t, h)
                axes = np.argsort(-side, axis=1, kind="stable")[:, :taken]
                short = (side.max(axis=1, keepdims=True) - np.take_along_axis(side, axes, axis=1)) ** 2
                gap += short[:, combos[:, h]]
                name = name * (2 * self.size) + axes[:, combos[:, h]]
            gaps.append(gap)
            names.append(name)
        order = np.argsort(np.concatenate(gaps, axis=1), axis=1, kind="stable")[:, :most]
        return (order // len(combos)).astype(np.int32), np.take_along_axis(np.concatenate(names, axis=1), order, axis=1)


def distances(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Euclidean distances of rows, from their differences; scaled where squares would end double precision."""
    with np.errstate(over="ignore", invalid="ignore"):
        away = np.abs(q - x)
        out = np.sqrt((away * away).sum(axis=1))
    for i in np.flatnonzero(~np.isfinite(out) | (out < 1e-150)).tolist():
        half = np.abs(q[i] / 2 - x[i] / 2)
        largest = half.max(initial=0)
        out[i] = 0.0 if not largest else min(float(largest * np.sqrt(((half / largest) ** 2).sum())), np.finfo(float).max / 2) * 2
    return out


def nearest(q: np.ndarray, own: np.ndarray, x: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, row, distance) of the k nearest rows with another id than the query's own, ties to smaller ids.

    Products sift first, widened by what rounding may take off them; what they leave is measured exactly.
    """
    with np.errstate(over="ignore", invalid="ignore"):
        qq, xx = (q * q).sum(axis=1)[:, None], (x * x).sum(axis=1)[None, :]
        square, slack = qq + xx - 2 * (q @ x.T), (qq + xx) * (q.shape[1] + 8) * 2.0**-50
        low, high = square - slack, square + slack
    unsure = ~np.isfinite(square)
    low[unsure], high[unsure] = -np.inf, np.inf
    low[own[:, None] == ids[None, :]] = high[own[:, None] == ids[None, :]] = np.inf
    kth = np.partition(high, k - 1, axis=1)[:, k - 1 : k] if len(ids) > k else np.full((len(q), 1), np.inf)
    i, j = np.nonzero((low <= kth) & (own[:, None] != ids[None, :]))
    score = np.concatenate([distances(q[i[a : a + 65536]], x[j[a : a + 65536]]) for a in range(0, len(i), 65536)] or [np.empty(0)])
    order = np.lexsort((ids[j], score, i))
    first = np.searchsorted(i[order], i[order])
    order = order[np.arange(len(order)) - first < k]
    return i[order], j[order], score[order]


def _matrix(column: pd.Series, width: int, kind: str) -> np.ndarray:
    return np.frombuffer(b"".join(column), kind).reshape(-1, width).astype(float)


def _sampled_neighbours(rows: DataFrame, sample: pd.DataFrame, width: int, kind: str, k: int) -> pd.DataFrame:
    """(query, x): the exact k nearest of each sampled row among all rows; the sample is of bounded size."""
    q, own = _matrix(sample["x"], width, kind), sample["vec_id"].to_numpy()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                i, j, score = nearest(q, own, _matrix(batch["x"], width, kind), batch["vec_id"].to_numpy(), k)
                yield pd.DataFrame({"query": i, "vec_id": batch["vec_id"].to_numpy()[j], "score": score, "x": batch["x"].to_numpy()[j]})

    near = rows.select("vec_id", "x").mapInPandas(run, "query long, vec_id long, score double, x binary")
    best = F.row_number().over(Window.partitionBy("query").orderBy("score", "vec_id"))
    return near.withColumn("rank", best).filter(F.col("rank") <= k).select("query", "x").toPandas()


def fit_probes(rows: DataFrame, n: int, width: int, kind: str, k: int, tables: int, recall: float, sample: int, bucket_rows: int, hashes: int | None = None) -> tuple[CrossPolytope, int]:
    """The hash tables and the number of buckets to probe, by the sample's exact neighbours."""
    some = rows.orderBy(F.xxhash64("row"), "row").limit(sample).select("vec_id", "x").toPandas()
    true = _sampled_neighbours(rows, some, width, kind, k)
    size = 1 << max(0, width - 1).bit_length()
    hashes = hashes or min(4, max(1, math.ceil(math.log(max(1.0, n / bucket_rows)) / math.log(2 * size))))
    if not len(true):
        return CrossPolytope(width, tables, 1), 1
    q, of, x = _matrix(some["x"], width, kind), true["query"].to_numpy(), _matrix(true["x"], width, kind)
    for used in range(hashes, 0, -1):
        hasher = CrossPolytope(width, tables, used)
        met = [hasher.buckets(x, t) for t in range(tables)]
        first = []
        for i in range(len(q)):
            table, bucket = hasher.probes(q[i : i + 1], 1 << 30)
            for j in np.flatnonzero(of == i).tolist():
                hit = np.flatnonzero(bucket[0] == np.array([m[j] for m in met])[table[0]])
                first.append(int(hit[0]) if len(hit) else 1 << 30)
        most = sorted(first)[min(len(first) - 1, math.ceil(recall * len(first)) - 1)]
        if most < 1 << 30:
            return hasher, most + 1
    raise AssertionError("one hash lists all buckets")


def nearest_neighbours(vectors: DataFrame, k: int = 10, every: int = 100, tables: int = 6, recall: float = 0.985, sample: int = 128, bucket_rows: int = 4096, block_rows: int = 8192, deal_queries: int = 4096, turn: int = 2, hashes: int | None = None) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest rows that are found for every id divisible by `every`.

    The score is the Euclidean distance of the vectors as they are, ties go to the smaller id. Vectors that are
    null, empty, zero or hold a null or a component that is not finite take no part, nor do null ids. Rows with
    the query's own id are not candidates for it; other ids that repeat are candidates each time, and of equal
    query rows one is asked. Vectors of unlike length are compared as if ended by zeros. Fewer rows than k give
    fewer ranks; an empty table gives none. Other columns are ignored.

    Jobs run while the frame is built: the rows are stored, counted and sampled, and each turn's best are stored.
    """
    spark = vectors.sparkSession
    fine = fine_vectors(vectors).filter(F.exists("x", lambda c: c != 0))
    kind = "<f4" if "array<float>" in dict(vectors.dtypes)["embedding"] else "<f8"
    width = fine.agg(F.max(F.size("x"))).first()[0]
    if not width:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")

    def as_bytes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            padded = (np.pad(np.asarray(v, float), (0, width - len(v))) for v in batch["x"])
            yield pd.DataFrame({"row": batch["row"], "vec_id": batch["vec_id"], "x": [v.astype(kind).tobytes() for v in padded]})

    numbered = fine.select(F.monotonically_increasing_id().alias("row"), "vec_id", "x")
    rows = stored(numbered.mapInPandas(as_bytes, "row long, vec_id long, x binary"), "vectors")
    n = rows.count()
    hasher, most = fit_probes(rows, n, width, kind, k, tables, recall, sample, bucket_rows, hashes)
    asked = stored(rows.filter(F.pmod("vec_id", F.lit(every)) == 0).select("vec_id", "x").distinct().select(F.xxhash64("vec_id", "x").alias("query"), F.col("vec_id").alias("query_id"), F.col("x").alias("q")), "queries")
    deals = max(1, -(-asked.count() // deal_queries))

    def index(which: range):
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                x = _matrix(batch["x"], width, kind)
                for t in which:
                    yield pd.DataFrame({"place": np.full(len(x), t, np.int32), "bucket": hasher.buckets(x, t), "row": batch["row"], "vec_id": batch["vec_id"], "x": batch["x"]})

        return run

    def probe(which: range):
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                for at in range(0, len(batch), 256):
                    some = batch.iloc[at : at + 256]
                    table, bucket = hasher.probes(_matrix(some["q"], width, kind), most)
                    i, j = np.nonzero((table >= which.start) & (table < which.stop))
                    yield some.iloc[i].assign(place=table[i, j], bucket=bucket[i, j])[["place", "bucket", "query", "query_id", "q"]]

        return run

    def rerank(block: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        if not len(block) or not len(queries):
            return pd.DataFrame({c.split()[0]: pd.Series(dtype=object) for c in FOUND.split(", ")})
        x, ids, parts = _matrix(block["x"], width, kind), block["vec_id"].to_numpy(), []
        for at in range(0, len(queries), 512):
            some = queries.iloc[at : at + 512]
            i, j, score = nearest(_matrix(some["q"], width, kind), some["query_id"].to_numpy(), x, ids, k)
            parts.append(pd.DataFrame({"query": some["query"].to_numpy()[i], "query_id": some["query_id"].to_numpy()[i], "row": block["row"].to_numpy()[j], "vec_id": ids[j], "score": score}))
        return pd.concat(parts)

    found = []
    for start in range(0, tables, turn):
        which = range(start, min(tables, start + turn))
        indexed = rows.mapInPandas(index(which), INDEXED)
        names = rows.mapInPandas(index(which), INDEXED).select("place", "bucket")
        parts = stored(names.groupBy("place", "bucket").agg(F.ceil(F.count("*") / block_rows).cast("int").alias("parts")), "parts")
        deal = F.pmod(F.xxhash64("query"), F.lit(deals)).cast("int").alias("deal")
        probes = asked.mapInPandas(probe(which), PROBES).join(parts, ["place", "bucket"])
        probes = probes.select("place", "bucket", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), deal, "query", "query_id", "q")
        wanted = probes.groupBy(F.col("place").alias("to_place"), F.col("bucket").alias("to_bucket")).agg(F.collect_set("deal").alias("to_deals"))
        sized = parts.join(wanted, (F.col("place") == F.col("to_place")) & (F.col("bucket") == F.col("to_bucket"))).select("to_place", "to_bucket", "parts", "to_deals")
        blocks = indexed.join(sized, (F.col("place") == F.col("to_place")) & (F.col("bucket") == F.col("to_bucket")))
        blocks = blocks.select("to_place", "to_bucket", F.pmod(F.xxhash64("row"), F.col("parts")).cast("int").alias("to_part"), F.explode("to_deals").alias("to_deal"), "row", "vec_id", "x")
        keys = ["place", "bucket", "part", "deal"]
        near = blocks.groupBy(*[f"to_{c}" for c in keys]).cogroup(probes.groupBy(*keys)).applyInPandas(rerank, FOUND)
        best = F.row_number().over(Window.partitionBy("query").orderBy("score", "vec_id", "row"))
        found.append(stored(near.groupBy("query", "query_id", "row", "vec_id").agg(F.min("score").alias("score")).withColumn("at", best).filter(F.col("at") <= k).drop("at"), "found"))
        discard(parts)
    discard(rows)
    rank = F.row_number().over(Window.partitionBy("query").orderBy("score", "vec_id", "row"))
    ranked = reduce(DataFrame.unionByName, found).dropDuplicates(["query", "row"]).withColumn("rank", rank).filter(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
