"""Hard-negative mining by exact scores, sifted by summaries of vector segments.

Each row is kept with the mean and the deviation of every segment of its vector, at levels of ever shorter segments.
Over a segment of w components the product of two vectors is w times the product of their means, give or take w times
the product of their deviations (Cauchy and Schwarz on what is left of the means), so a level's sums bound every
score from above and below. Rows whose bounds cannot matter to an anchor are left out level by level; what stays is
scored exactly.

Rows lie in blocks of bounded size. In a first pass a block is of one label, or of several that have few rows: each
anchor meets the blocks that hold its label and gets its positives. In a second, rows are dealt at random: each
anchor meets all blocks with the ranges of scores that its positives allow, and gets the negatives of each. In either pass, a task holds a
block and a deal of anchors at most and lets go of a few rows for each anchor.

Scores are exact integers of any size: what doubles cannot hold exactly is made of Python's own integers.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewall.llm.common import discard, stored
from tidewall.llm.exact import EXACT, LONGEST, exact_products, of_order, order_bytes
from tidewall.llm.topk import fine_vectors

SCALE = 256.0
MEETS = ("anchor", "anchor_id", "anchor_label", "q")
SCORED = "anchor long, anchor_id long, row long, vec_id long, score long, beyond binary"
RESULT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


def shifted_label(label: Column, key: Column) -> Column:
    """The label to work with: where the id is divisible by 7, the next of ten."""
    label = label.cast("long")
    return F.when(F.pmod(key, F.lit(7)) == 0, (label + 1) % 10).otherwise(label)


class Summaries:
    """Mean and deviation of each segment, at levels of shorter and shorter segments."""

    def __init__(self, x: np.ndarray, widths: tuple[int, ...]):
        self.levels = []
        for w in widths:
            cut = np.pad(x, ((0, 0), (0, -x.shape[1] % w))).reshape(len(x), -1, w)
            with np.errstate(over="ignore", invalid="ignore"):
                self.levels.append((cut.mean(axis=2), cut.std(axis=2)))

    def take(self, rows: np.ndarray) -> Summaries:
        some = Summaries.__new__(Summaries)
        some.levels = [(m[rows], d[rows]) for m, d in self.levels]
        return some


def segment_widths(width: int) -> tuple[int, ...]:
    """The whole vector, then quarters of it and quarters of those, down to a few components."""
    out = [width]
    while out[-1] > 7:
        out.append(-(-out[-1] // 4))
    return tuple(out)


def bounds(q: Summaries, x: Summaries, level: int, w: int) -> tuple[np.ndarray, np.ndarray]:
    """(lower, upper)[anchor, row] of the scores by one level, widened by what rounding may take off."""
    (qm, qd), (xm, xd) = q.levels[level], x.levels[level]
    with np.errstate(over="ignore", invalid="ignore"):
        middle, spread = w * (qm @ xm.T), w * (qd @ xd.T)
        slack = w * (np.abs(qm) @ np.abs(xm).T + qd @ xd.T) * (w * qm.shape[1] + 16) * 2.0**-48 + 1e-6
        low, high = middle - spread - slack, middle + spread + slack
    unsure = ~(np.isfinite(low) & np.isfinite(high))
    low[unsure], high[unsure] = -np.inf, np.inf
    return low, high


def _scaled(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.floor(SCALE * x)


def _sifted(q: Summaries, x: Summaries, fits: np.ndarray, widths: tuple[int, ...], least, most) -> tuple[np.ndarray, np.ndarray]:
    """(rows, fits): the rows that no level's bounds rule out for all anchors, and the anchors each may matter to.

    least(low, fits) is what a score must reach, by a level's lower bounds; it must not pass `most`.
    """
    rows = np.arange(fits.shape[1])
    for level, w in enumerate(widths):
        low, high = bounds(q, x if len(rows) == len(x.levels[0][0]) else x.take(rows), level, w)
        fits = fits & (high >= least(low, fits)) & (low <= most)
        keep = fits.any(axis=0)
        if not keep.all():
            rows, fits = rows[keep], fits[:, keep]
    return rows, fits


def _kth(values: np.ndarray, fits: np.ndarray, k: int) -> np.ndarray:
    """[anchor, 1]: the k-th highest value of those that fit, -inf where there are fewer."""
    if fits.shape[1] < k:
        return np.full((len(fits), 1), -np.inf)
    values = np.where(fits, values, -np.inf)
    return (np.sort(values, axis=1) if values.dtype == object else np.partition(values, fits.shape[1] - k, axis=1))[:, fits.shape[1] - k][:, None]


def _first(groups: np.ndarray, scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k first of each group: highest score, then least id."""
    if scores.dtype == object:
        order = np.array(sorted(range(len(groups)), key=lambda n: (groups[n], -scores[n], ids[n])), np.int64)
    else:
        order = np.lexsort((ids, -scores, groups))
    ordered = groups[order]
    return order[np.arange(len(order)) - np.searchsorted(ordered, ordered) < k]


class _Block:
    """The rows of one block, scaled and summarised."""

    def __init__(self, rows: pd.DataFrame, width: int):
        self.x = np.frombuffer(b"".join(rows["x"]), float).reshape(-1, width)
        self.v, self.widths = _scaled(self.x), segment_widths(width)
        self.sums = Summaries(self.v, self.widths)
        self.ids, self.rows, self.labels = (rows[c].to_numpy() for c in ("vec_id", "row", "label"))


def positives_in(block: pd.DataFrame, anchors: pd.DataFrame, width: int, k: int) -> pd.DataFrame:
    """SCORED: each anchor's k first rows of its label in this block."""
    b, found = _Block(block, width), []
    for at in range(0, len(anchors), 128):
        some = anchors.iloc[at : at + 128]
        q_x = np.frombuffer(b"".join(some["q"]), float).reshape(-1, width)
        q, own, label = _scaled(q_x), some["anchor_id"].to_numpy(), some["anchor_label"].to_numpy()
        fits = (label[:, None] == b.labels[None, :]) & (own[:, None] != b.ids[None, :])
        rows, fits = _sifted(Summaries(q, b.widths), b.sums, fits, b.widths, lambda low, fits: _kth(low, fits, k), np.inf)
        scores = exact_products(q, q_x, b.v[rows], b.x[rows], SCALE)
        i, j = np.nonzero(fits & (scores >= _kth(scores, fits, k)).astype(bool))
        s, j = scores[i, j], rows[j]
        best = _first(i, s, b.ids[j], k)
        found.append(_told(some, i[best], {"row": b.rows[j[best]], "vec_id": b.ids[j[best]]}, s[best]))
    return pd.concat(found)


def negatives_in(block: pd.DataFrame, anchors: pd.DataFrame, width: int, k: int, low: int, of: int) -> pd.DataFrame:
    """SCORED with `turn`: per anchor and distinct score of its positives, the k first rows of other labels in range."""
    b, found = _Block(block, width), []
    for at in range(0, len(anchors), 128):
        some = anchors.iloc[at : at + 128]
        q_x = np.frombuffer(b"".join(some["q"]), float).reshape(-1, width)
        q, label = _scaled(q_x), some["anchor_label"].to_numpy()
        ranges = [[(-(-low * p // of), p, t) for p, t in ((of_order(s, y), n) for n, (s, y) in enumerate(zip(scores, beyond, strict=True)))] for scores, beyond in zip(some["scores"], some["beyonds"], strict=True)]
        least = np.array([[_down(min(r[0] for r in rs))] for rs in ranges])
        most = np.array([[_up(max(r[1] for r in rs))] for rs in ranges])
        fits = label[:, None] != b.labels[None, :]
        rows, fits = _sifted(Summaries(q, b.widths), b.sums, fits, b.widths, lambda *_: least, most)
        scores = exact_products(q, q_x, b.v[rows], b.x[rows], SCALE)
        i, j = np.nonzero(fits & ((scores >= least) & (scores <= most)).astype(bool))
        s, j = scores[i, j], rows[j]
        cuts = np.searchsorted(i, np.arange(len(some) + 1))
        pair, at_range = [], []
        for a, rs in enumerate(ranges):
            mine = np.arange(cuts[a], cuts[a + 1])
            for lo, hi, t in rs if len(mine) else ():
                inside = mine[((s[mine] >= _down(lo)) & (s[mine] <= _up(hi))).astype(bool)]
                if s.dtype == object:
                    inside = np.array([n for n in inside.tolist() if lo <= s[n] <= hi], np.int64)
                inside = inside[_first(np.zeros(len(inside), int), s[inside], b.ids[j[inside]], k)]
                pair.append(inside)
                at_range.append(np.full(len(inside), t))
        which = np.concatenate(pair or [np.empty(0, np.int64)])
        out = _told(some, i[which], {"row": b.rows[j[which]], "vec_id": b.ids[j[which]]}, s[which])
        found.append(out.assign(turn=np.concatenate(at_range or [np.empty(0, np.int64)])))
    return pd.concat(found)


def _down(n: int) -> float:
    return float(n) if abs(n) < EXACT else -np.inf


def _up(n: int) -> float:
    return float(n) if abs(n) < EXACT else np.inf


def _told(anchors: pd.DataFrame, i: np.ndarray, columns: dict, scores: np.ndarray) -> pd.DataFrame:
    whole = [int(s) for s in scores.tolist()]
    clipped = np.array([max(-LONGEST - 1, min(LONGEST, s)) for s in whole], np.int64)
    return pd.DataFrame({"anchor": anchors["anchor"].to_numpy()[i], "anchor_id": anchors["anchor_id"].to_numpy()[i], **columns, "score": clipped, "beyond": [order_bytes(s) for s in whole]})


def _none(schema: str) -> pd.DataFrame:
    return pd.DataFrame({c.split()[0]: pd.Series(dtype=object) for c in schema.split(", ")})


def hard_negatives(vectors: DataFrame, every: int = 100, positives: int = 5, negatives: int = 5, low: int = 80, of: int = 100, block_rows: int = 8192, deal_anchors: int = 2048) -> DataFrame:
    """RESULT: for each anchor and each of its positives, the first `negatives` rows of other labels whose score is
    at least low/of of the positive's and at most the positive's.

    Anchors are the rows whose id is divisible by `every`; an anchor's positives are its first `positives` rows of
    its label with another id. Components count as floor(256 x). Rows with a null id, label or vector, an empty
    vector, or a component that is null or not finite take no part. Ids that repeat are rows of their own, and of
    equal anchor rows one is taken. Vectors of unlike length are compared as if ended by zeros. Anchors without
    positives, and positives without such rows, give none; neither does an empty table. A score that 64 bits cannot
    hold is compared whole and told as the nearest number that they can. Other columns are ignored.

    Jobs run while the frame is built: rows, anchors and positives are stored.
    """
    spark = vectors.sparkSession
    label = shifted_label(F.col("label"), F.col("vec_id").cast("long")).alias("label")
    fine = fine_vectors(vectors.filter(F.col("label").isNotNull()), also=(label,))
    width = fine.agg(F.max(F.size("x"))).first()[0]
    if not width:
        return spark.createDataFrame([], RESULT)

    def as_bytes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"row": batch["row"], "vec_id": batch["vec_id"], "label": batch["label"], "x": [np.pad(np.asarray(v, float), (0, width - len(v))).tobytes() for v in batch["x"]]})

    numbered = fine.select(F.monotonically_increasing_id().alias("row"), "vec_id", "label", "x")
    rows = stored(numbered.mapInPandas(as_bytes, "row long, vec_id long, label long, x binary"), "vectors")
    few = stored(rows.groupBy("label").agg(F.count("*").alias("n")), "labels")
    shared = max(1, -(-(few.filter(F.col("n") < block_rows).agg(F.sum("n")).first()[0] or 0) // block_rows))
    home = F.when(F.col("n") >= block_rows, F.col("label")).otherwise(F.pmod(F.xxhash64("label"), F.lit(shared))).alias("home")
    places = few.select("label", home, (F.col("n") >= block_rows).alias("own"), F.ceil(F.col("n") / block_rows).cast("int").alias("parts"))
    parts = F.when(F.col("own"), F.col("parts")).otherwise(1)
    keys = ["home", "own", "part"]
    placed = rows.join(places, "label").withColumn("part", F.pmod(F.xxhash64("row"), parts).cast("int")).drop("parts")
    anchors = rows.filter(F.pmod("vec_id", F.lit(every)) == 0).groupBy("vec_id", "label", "x").agg(F.min("row").alias("anchor"))
    anchors = stored(anchors.select("anchor", F.col("vec_id").alias("anchor_id"), F.col("label").alias("anchor_label"), F.col("x").alias("q")), "anchors")
    deals = max(1, -(-anchors.count() // deal_anchors))
    deal = F.pmod(F.xxhash64("anchor"), F.lit(deals)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), n - 1))

    def first_pass(block: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
        return positives_in(block, own, width, positives) if len(block) and len(own) else _none(SCORED)

    def second_pass(block: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
        return negatives_in(block, own, width, negatives, low, of) if len(block) and len(own) else _none(f"{SCORED}, turn int")

    at_home = anchors.join(places.withColumnRenamed("label", "anchor_label"), "anchor_label").withColumn("part", each(parts)).withColumn("deal", deal)
    wanted = at_home.select(*[F.col(c).alias(f"to_{c}") for c in (*keys, "deal")]).distinct()
    met = placed.join(wanted, [F.col(c) == F.col(f"to_{c}") for c in keys]).select("row", "vec_id", "label", "x", *[f"to_{c}" for c in (*keys, "deal")])
    near = met.groupBy(*[f"to_{c}" for c in (*keys, "deal")]).cogroup(at_home.select(*MEETS, *keys, "deal").groupBy(*keys, "deal")).applyInPandas(first_pass, SCORED)
    order = [F.col("score").desc(), F.col("beyond").desc(), "vec_id", "row"]
    at = F.row_number().over(Window.partitionBy("anchor").orderBy(*order))
    chosen = stored(near.withColumn("at", at).filter(F.col("at") <= positives).select("anchor", "anchor_id", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"), F.col("beyond").alias("positive_beyond"), "at"), "positives")
    asked = chosen.select("anchor", "positive_score", "positive_beyond").distinct().groupBy("anchor").agg(F.array_sort(F.collect_list(F.struct("positive_score", "positive_beyond"))).alias("scores"))
    turns = asked.select("anchor", F.posexplode("scores").alias("turn", "s")).select("anchor", "turn", "s.*")
    asked = asked.join(anchors, "anchor").select(*MEETS, F.col("scores.positive_score").alias("scores"), F.col("scores.positive_beyond").alias("beyonds"), deal.alias("deal"))
    packs = max(1, -(-rows.count() // block_rows))
    dealt = rows.withColumn("pack", F.pmod(F.xxhash64("row"), F.lit(packs)).cast("int")).withColumn("deal", each(F.lit(deals)))
    meets = asked.withColumn("pack", each(F.lit(packs)))
    far = dealt.groupBy("pack", "deal").cogroup(meets.groupBy("pack", "deal")).applyInPandas(second_pass, f"{SCORED}, turn int")
    rank = F.row_number().over(Window.partitionBy("anchor", "turn").orderBy(*order))
    hard = far.withColumn("rank", rank).filter(F.col("rank") <= negatives).select("anchor", "turn", "rank", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))
    paired = chosen.join(turns, ["anchor", "positive_score", "positive_beyond"]).join(hard, ["anchor", "turn"])
    discard(few)
    return paired.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")

