"""A quality classifier learned from positives and unlabelled text.

Trusted positives (labels of 1) and all documents as the unlabelled mass come from one corpus. Labels of 0
are never used. The class prior, the share of positives in the mass, is estimated from the two alone: a
logistic model of one half tells positives from the mass and ranks the other, and the prior is the least
ratio of the shares above a cut of the ranking, each with its statistical error. Then the non-negative unbiased risk
prior * E_pos[l(z)] + max(0, E_all[l(-z)] - prior * E_pos[l(-z)]) of a logistic model is minimised over the
whole corpus by Newton steps; where the inner risk would pass its bound, only so much of it counts as keeps
it there. Each step is an aggregation of a stored feature table, so the driver holds a matrix as wide as the
features and never a row.

Features: shares of byte classes, word statistics, and hashed character and word n-grams, as roots of shares.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewall.llm.common import FEW_BYTES, crc32_text, freed_shuffles, release_memory, stored

CLASSES = (b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" ", b"\n", b".,;:!?'\"()-", bytes(range(128, 256)))
STATISTICS = ("length", "words", "word_length", "distinct", "repeats")
#: Buckets of hashed character 3-grams, words and word pairs.
CHARACTERS, WORDS, PAIRS = 96, 64, 32
PLAIN = len(CLASSES) + 1 + len(STATISTICS)
#: Standardised n-gram features count this much of the others, as there are many and each says little.
NGRAM_WEIGHT = 0.1
WIDTH = PLAIN + CHARACTERS + WORDS + PAIRS

_CLASS = np.full(256, len(CLASSES), np.int64)
for _k, _bytes in enumerate(CLASSES):
    _CLASS[list(_bytes)] = _k
_LOWER = np.frombuffer(bytes(range(256)).lower(), np.uint8).astype(np.uint32)


def features(texts: list[bytes]) -> np.ndarray:
    """A row of WIDTH finite numbers a text; all zeros for the empty one."""
    n = len(texts)
    sizes = np.fromiter(map(len, texts), np.int64, n)
    data, row = np.frombuffer(b"".join(texts), np.uint8), np.repeat(np.arange(n), sizes)
    count = lambda rows, at, width: np.bincount(rows * width + at, minlength=n * width).reshape(n, width)
    share = lambda counts: np.sqrt(counts / np.maximum(counts.sum(axis=1, keepdims=True), 1))
    parts = [share(count(row, _CLASS[data], len(CLASSES) + 1))]
    words = [t.lower().split() for t in texts]
    of = np.fromiter(map(len, words), np.int64, n)
    distinct = np.fromiter((len(set(w)) for w in words), np.int64, n)
    repeats = np.fromiter((sum(map(bytes.__eq__, w, w[1:])) for w in words), np.int64, n)
    letters = np.fromiter((sum(map(len, w)) for w in words), np.int64, n)
    some = np.maximum(of, 1)
    parts.append(np.stack([np.log1p(sizes) / 10, np.log1p(of) / 10, np.log1p(letters / some) / 3, np.sqrt(distinct / some), np.sqrt(repeats / some)], axis=1))
    low = _LOWER[data]
    grams = (low[:-2] * np.uint32(0x9E3779B1) ^ low[1:-1] * np.uint32(0x85EBCA77) ^ low[2:] * np.uint32(0xC2B2AE3D)) if len(low) > 2 else low[:0]
    inside = row[:-2] == row[2:] if len(low) > 2 else np.zeros(0, bool)
    parts.append(share(count(row[: len(grams)][inside], _bucket(grams[inside].astype(np.uint64), CHARACTERS), CHARACTERS)))
    hashes = np.fromiter((xxhash.xxh3_64_intdigest(x) for w in words for x in w), np.uint64, int(of.sum()))
    row = np.repeat(np.arange(n), of)
    parts.append(share(count(row, _bucket(hashes, WORDS), WORDS)))
    inside = row[:-1] == row[1:]
    pairs = hashes[:-1] * np.uint64(0x9E3779B97F4A7C15) + hashes[1:]
    parts.append(share(count(row[:-1][inside], _bucket(pairs[inside], PAIRS), PAIRS)))
    return np.concatenate(parts, axis=1).astype(np.float32)


def _bucket(hashes: np.ndarray, width: int) -> np.ndarray:
    return (hashes * np.uint64(0xD6E8FEB86659FD93) >> np.uint64(40)).astype(np.int64) % width


def feature_bytes(text: Column, slice_bytes: int = 1 << 20) -> Column:
    """WIDTH floats as bytes of each text; null texts are empty. Only the text crosses to Python."""

    @F.pandas_udf("binary")
    def run(texts: pd.Series) -> pd.Series:
        release_memory()
        raw, out, at = [(t or "").encode() for t in texts], [], 0
        while at < len(raw):
            to, size = at, 0
            while to < len(raw) and (to == at or size + len(raw[to]) <= slice_bytes):
                size, to = size + len(raw[to]), to + 1
            out += [x.tobytes() for x in features(raw[at:to])]
            at = to
        return pd.Series(out, dtype=object)

    return run(text)


def _matrix(column: pa.Array) -> np.ndarray:
    x = np.frombuffer(b"".join(column.to_pylist()), np.float32)
    return x.reshape(len(column), -1).astype(float)


def _summed(rows: DataFrame, size: int, part: Callable) -> np.ndarray:
    """The sum of part(x, positive), `size` numbers, over batches of rows (x, positive).

    Each task adds up its rows, then 64 tasks' sums are added at a time, twice, so that a task's row of bytes
    in 4096 reaches the driver.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for batch in batches:
            if batch.num_rows:
                total += part(_matrix(batch.column(0)), batch.column(1).to_numpy(zero_copy_only=False).astype(bool))
        yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([total.tobytes()], pa.binary())], names=["task", "v"])

    def added(group: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"task": [int(group["task"].iloc[0]) // 64], "v": [_total(group["v"]).tobytes()]})

    def _total(sums) -> np.ndarray:
        return sum((np.frombuffer(v, float) for v in sums), np.zeros(size))

    parts = rows.select("x", "positive").mapInArrow(run, "task long, v binary")
    for _ in range(2):
        parts = parts.groupBy(F.floor(F.col("task") / 64)).applyInPandas(added, "task long, v binary")
    with freed_shuffles(rows.sparkSession):
        return _total(r.v for r in parts.select("v").collect())


class Sums:
    """Means over the mass (u) and the positives (p) at given weights."""

    def __init__(self, rows: DataFrame, weights: np.ndarray, scale: tuple[np.ndarray, np.ndarray]):
        d, (center, spread) = len(weights), scale

        def part(x: np.ndarray, positive: np.ndarray) -> np.ndarray:
            x = np.column_stack([np.ones(len(x)), (x - center) / spread])
            out = []
            for own in (x[~positive], x[positive]):
                z = own @ weights
                s = 1 / (1 + np.exp(-np.clip(z, -40, 40)))
                out += [[len(z), np.logaddexp(0, z).sum()], s @ own, own.sum(axis=0), ((own * (s * (1 - s))[:, None]).T @ own).ravel()]
            return np.concatenate(out)

        one = 2 + 2 * d + d * d
        for name, v in zip("up", _summed(rows, 2 * one, part).reshape(2, one), strict=True):
            n = max(v[0], 1.0)
            setattr(self, f"n_{name}", v[0])
            setattr(self, f"loss_{name}", v[1] / n)  # of l(-z)
            setattr(self, f"pull_{name}", v[2 : 2 + d] / n)
            setattr(self, f"mean_{name}", v[2 + d : 2 + 2 * d] / n)
            setattr(self, f"curve_{name}", v[2 + 2 * d :].reshape(d, d) / n)


def fit(rows: DataFrame, prior: float | None, scale: tuple[np.ndarray, np.ndarray], ridge: float = 1e-2, steps: int = 8, enough: float = 1e-5, slack: float = 1e-2, halvings: int = 6) -> np.ndarray:
    """Weights, the intercept first, over rows of (x, positive): the mass as not positive, positives again as positive.

    With a prior: the least non-negative risk. It is the larger of two convex functions, the outer risk and
    the outer with the inner one, so it is least where some mix of the two is: with the whole inner risk, if
    that then is not below its bound by more than `slack`; else with the part, found by halving, that holds
    it there. Without a prior: the logistic model of positives against the mass, both of weight one half.
    `rows` should be stored, as every step reads it. Without positives or mass all weights are zero but the
    intercept, which then gives the prior as every score.
    """
    d = len(scale[0]) + 1
    w = np.zeros(d)
    w[0] = np.log(prior / (1 - prior)) if prior else 0.0
    held = np.full(d, ridge)
    held[0] = 1e-9

    def inner(s: Sums) -> float:
        return s.loss_u - prior * s.loss_p

    def value(s: Sums, w: np.ndarray, part: float) -> float:
        back = s.loss_p - s.mean_p @ w  # of l(z), which is l(-z) - z
        return (prior * back + part * inner(s) if prior else 0.5 * back + 0.5 * s.loss_u) + held @ (w * w) / 2

    def least(s: Sums, w: np.ndarray, part: float) -> tuple[Sums, np.ndarray]:
        """Newton steps to the least value with this part of the inner risk."""
        for _ in range(steps):
            if prior:
                pull = prior * (s.pull_p - s.mean_p) + part * (s.pull_u - prior * s.pull_p)
                curve = prior * (1 - part) * s.curve_p + part * s.curve_u
            else:
                pull, curve = 0.5 * (s.pull_p - s.mean_p) + 0.5 * s.pull_u, 0.5 * (s.curve_u + s.curve_p)
            move, size, now = -np.linalg.solve(curve + np.diag(held), pull + held * w), 1.0, value(s, w, part)
            while size > 1e-3 and not value(after := Sums(rows, w + size * move, scale), w + size * move, part) <= now:
                size /= 4
            if size <= 1e-3:
                break
            w, s = w + size * move, after
            if now - value(s, w, part) < enough:
                break
        return s, w

    s = Sums(rows, w, scale)
    if not s.n_p or not s.n_u:
        return w
    s, w = least(s, w, 1.0)
    best, part, low, high = (value(s, w, inner(s) > 0 if prior else 1.0), w), 1.0, 0.0, 1.0
    for _ in range(halvings if prior else 0):
        if abs(inner(s)) <= slack or (inner(s) > 0 and part == 1.0):
            break
        low, high = (low, part) if inner(s) < 0 else (part, high)
        part = (low + high) / 2
        s, w = least(s, w, part)
        best = min(best, (value(s, w, inner(s) > 0), w), key=lambda x: x[0])
    return best[1]


def scale_of(rows: DataFrame, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """Mean of each feature over the mass, and what its distance from that is divided by: the spread, more for n-grams."""

    def part(x: np.ndarray, positive: np.ndarray) -> np.ndarray:
        own = x[~positive]
        return np.concatenate([[len(own)], own.sum(axis=0), (own * own).sum(axis=0)])

    v = _summed(rows, 1 + 2 * width, part)
    n = max(v[0], 1.0)
    center = v[1 : 1 + width] / n
    spread = np.sqrt(np.maximum(v[1 + width :] / n - center**2, 0)) + 1e-3
    spread[PLAIN:] /= NGRAM_WEIGHT
    return center, spread


def estimate_prior(rows: DataFrame, scale: tuple[np.ndarray, np.ndarray], bins: int = 2000, doubt: float = 0.1) -> float:
    """Share of positives in the mass: the least ratio of the two shares above a cut of the ranking, with their errors.

    The ranking is learned from one half of the rows, drawn by a hash of their features, and the shares are
    those in the other half, as a model ranks the positives that it has seen too high.
    """
    half = F.pmod(F.xxhash64("x"), F.lit(2))
    weights = fit(rows.filter(half == 0), None, scale, ridge=1e-3, steps=8, enough=1e-4)
    center, spread = scale

    def part(x: np.ndarray, positive: np.ndarray) -> np.ndarray:
        z = np.clip(weights[0] + (x - center) / spread @ weights[1:], -40, 40)
        at = np.minimum((bins / (1 + np.exp(-z))).astype(np.int64), bins - 1)
        return np.concatenate([np.bincount(at[positive == p], minlength=bins) for p in (False, True)]).astype(float)

    mass, positives = _summed(rows.filter(half == 1), 2 * bins, part).reshape(2, bins)[:, ::-1].cumsum(axis=1)
    if not mass[-1] or not positives[-1]:
        return 0.5
    mass, positives, error = mass / mass[-1], positives / positives[-1], np.sqrt(np.log(4 / doubt) / 2) * (mass[-1] ** -0.5 + positives[-1] ** -0.5)
    seen = positives > 0
    best = np.argmin((mass[seen] + error) / positives[seen])
    return float((mass[seen] / positives[seen])[best])


def score_quality(docs: DataFrame, labels: DataFrame, held_out: Column | None = None, prior: float | None = None, threshold: float = 0.7, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, held_out, score, predicted and the columns in `keep`, one row per row of docs, whatever its id.

    Positives are the rows with a label (doc_id, quality) of 1 and held_out not true; labels of 0 and null
    labels and ids teach nothing; an id with both labels is no trusted positive. The prior is estimated,
    and taken to lie between 0.05 and 0.95, unless given. lang, source and doc_id are never inputs.
    """
    held_out = held_out if held_out is not None else F.coalesce(F.pmod(crc32_text(F.col("doc_id")), F.lit(4)) == 2, F.lit(False))
    trusted = labels.select("doc_id", "quality").filter("doc_id is not null and quality is not null").filter(~held_out)
    trusted = trusted.groupBy("doc_id").agg(F.min("quality").alias("least")).filter("least = 1").select("doc_id")
    kept = [F.col(c).alias(f"_keep_{c}") for c in keep]
    table = stored(docs.select("doc_id", held_out.alias("held_out"), feature_bytes(F.col("text")).alias("x"), *kept), "features", batch_bytes=FEW_BYTES)
    positives = table.filter("doc_id is not null").select("doc_id", "x").join(trusted, "doc_id", "left_semi")
    rows = table.select("x", F.lit(False).alias("positive")).unionByName(stored(positives.select("x", F.lit(True).alias("positive")), "positives"))
    scale = scale_of(rows)
    if prior is None:
        prior = estimate_prior(rows, scale)
    weights = fit(rows, min(0.95, max(0.05, prior)), scale)
    center, spread = scale

    def logistic(x: pd.Series) -> np.ndarray:
        values = np.frombuffer(b"".join(x), np.float32).reshape(len(x), -1).astype(float)
        return 1 / (1 + np.exp(-np.clip(weights[0] + (values - center) / spread @ weights[1:], -700, 700)))

    @F.pandas_udf("double")
    def score(x: pd.Series) -> pd.Series:
        return pd.Series(logistic(x)) if len(x) else pd.Series(dtype=float)

    scored = table.withColumn("score", score("x"))
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= threshold).cast("int").alias("predicted"), *[F.col(f"_keep_{c}").alias(c) for c in keep])
