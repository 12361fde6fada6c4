"""Exact search against brute force."""

import math
import random

import numpy as np
import pandas as pd
import pytest

from tidewall.llm import topk
from tidewall.llm.topk import top_k


def _brute(rows, k):
    scaled = lambda x: int(x) * 1024 if abs(x) >= 2**53 else math.floor(1024 * x)
    good = [(i, [scaled(x) for x in v]) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    out = set()
    for i, q in {(i, tuple(v)) for i, v in good}:
        if i % 100 == 0:
            best = sorted((-sum(a * b for a, b in zip(q, v)), j) for j, v in good if j != i)[:k]
            out |= {(i, r + 1, j, max(-(2**63), min(2**63 - 1, -s))) for r, (s, j) in enumerate(best)}
    return out


def _rows(df, **sizes):
    return {(r.query_id, r.rank, r.vec_id, r.score) for r in top_k(df, **sizes).collect()}


@pytest.mark.parametrize("sizes", [{"block_rows": 4, "part_blocks": 2, "deal_queries": 3}, {}])
def test_equals_brute_force(spark, sizes):
    rng = random.Random(1)
    rows = [(i, [rng.uniform(-1, 1) for _ in range(6)]) for i in range(400)]
    rows += [(i, [0.5] * 6) for i in range(1000, 1050)]  # ties
    rows += [(2000, None), (2100, [None] * 6), (2200, [float("nan")] * 6), (2300, [float("inf")] * 6), (None, [1.0] * 6), (2400, []), (7, rows[7][1]), (300, [0.25, -0.5]), (-100, [0.0] * 6)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<float>, block int").repartition(3)
    exact = [(r.vec_id, r.embedding) for r in df.collect()]
    assert _rows(df, **sizes) == _brute(exact, 10)


def test_large_components_are_exact(spark):
    rng = random.Random(2)
    rows = [(i, [rng.choice((1, -1)) * rng.random() * 10 ** rng.choice((0, 3, 6, 11, 13, 30, 200)) for _ in range(3)]) for i in range(150)]
    rows += [(200, [1e13, 1.0]), (201, [1e11, 1.0]), (202, [1e11, 3.0]), (300, [1e11, 1.0]), (400, [1e308, -1e308]), (401, [1e308, 1e308]), (402, [1e308, 1e308])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(2)
    assert _rows(df, block_rows=16) == _brute(rows, 10)


def test_descent_skips_blocks_whose_bound_is_low(monkeypatch):
    """Clustered vectors: once the near block is scored, far ones are never opened."""
    rng, width = np.random.default_rng(3), 8
    opened, blocks = [], []
    products = topk._products
    monkeypatch.setattr(topk, "_products", lambda q, q_x, v, v_x: opened.append(len(q)) or products(q, q_x, v, v_x))
    for b in range(20):
        x = np.eye(width)[b % width] * (1 if b < width else -1) + rng.normal(0, 0.01, (50, width))
        v = np.floor(1024 * x)
        blocks.append((np.arange(b * 50, b * 50 + 50).tobytes(), v.astype("<i2").tobytes(), "<i2", v.max(axis=0).tobytes(), v.min(axis=0).tobytes()))
    queries = pd.DataFrame({"query": range(5), "query_id": [-1] * 5, "q": [np.eye(width)[i].tobytes() for i in range(5)], "floor": [-math.inf] * 5})
    got = topk.descend(pd.DataFrame(blocks, columns=["ids", "v", "kind", "most", "least"]), queries, width, 10)
    assert len(got) == 50 and sum(opened) <= 10  # one or two of 20 blocks a query


def test_few_and_none(spark):
    df = spark.createDataFrame([(0, [1.0]), (1, [2.0])], "vec_id long, embedding array<float>")
    assert [tuple(r) for r in top_k(df).collect()] == [(0, 1, 1, 2048 * 1024)]
    assert top_k(df.filter("vec_id = 1")).count() == 0 and top_k(df.filter("vec_id > 1")).count() == 0


def test_vectors_that_repeat_fill_several_blocks(spark):
    df = spark.createDataFrame([(i, [1.0, 2.0]) for i in range(300)], "vec_id long, embedding array<double>").repartition(3)
    assert topk.build_blocks(topk.fine_vectors(df), 2, block_rows=20).count() > 5
    assert {r.vec_id for r in top_k(df).collect() if r.query_id == 100} == set(range(10))
