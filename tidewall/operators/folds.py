"""Spatial blocks and stratified group folds."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def grid_blocks(df: DataFrame, x: str, y: str, side: float) -> DataFrame:
    """Adds block, the text "col:row" of a square grid."""
    cell = lambda c: F.floor(F.col(c) / side).cast("string")
    return df.withColumn("block", F.concat_ws(":", cell(x), cell(y)))


def spatial_blocks(df: DataFrame, x: str, y: str, blocks: int = 50, seed: int = 0) -> DataFrame:
    """Adds block, a k-means cluster of the places."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import VectorAssembler

    placed = VectorAssembler(inputCols=[x, y], outputCol="_v").transform(df)
    model = KMeans(k=blocks, seed=seed, featuresCol="_v", predictionCol="block", maxIter=20).fit(placed)
    return model.transform(placed).drop("_v")


def assign_folds(df: DataFrame, block: str, target: str, folds: int = 10) -> DataFrame:
    """Adds fold_id: whole blocks dealt so that the folds' class shares stay even.

    Blocks with the widest spread of class counts go first (ties by name), each to the fold that keeps the mean
    over classes of the deviation of fold shares least, then to the fold with fewest rows. Only counts by block
    and class reach the driver; blocks are few by design.
    """
    counts: dict[object, dict[object, int]] = defaultdict(dict)
    for r in df.groupBy(block, target).count().collect():
        counts[r[0]][r[1]] = r[2]
    classes = sorted({c for by in counts.values() for c in by})
    table = {b: np.array([by.get(c, 0) for c in classes], float) for b, by in counts.items()}
    totals = sum(table.values(), np.zeros(len(classes)))
    held = np.zeros((folds, len(classes)))
    dealt = []
    for b in sorted(table, key=lambda b: (-table[b].std(), str(b))):
        costs = []
        for f in range(folds):
            held[f] += table[b]
            costs.append((round(float((held / totals).std(axis=0).mean()), 12), held[f].sum(), f))
            held[f] -= table[b]
        best = min(costs)[2]
        held[best] += table[b]
        dealt.append((b, best))
    kind = df.schema[block].dataType.simpleString()
    return df.join(df.sparkSession.createDataFrame(dealt, f"`{block}` {kind}, fold_id int"), block)


def folds_match(a: DataFrame, b: DataFrame, columns: Sequence[str] = ("asset_id", "fold_id")) -> DataFrame:
    """(only_a, only_b): rows that one assignment has and the other has not; both 0 if they agree."""
    x, y = a.select(*columns), b.select(*columns)
    return x.exceptAll(y).agg(F.count("*").alias("only_a")).crossJoin(y.exceptAll(x).agg(F.count("*").alias("only_b")))
