"""Exact inner products of scaled vectors: doubles where those hold them, Python's integers elsewhere."""

from __future__ import annotations

import math

import numpy as np

EXACT = 2.0**53
LONGEST = (1 << 63) - 1


def integers(x: np.ndarray, scale: float) -> list[int]:
    """floor(scale x) as Python's integers; the scale is a power of two."""
    return [int(c) * int(scale) if abs(c) >= EXACT else math.floor(scale * c) for c in x.tolist()]


def exact_products(q: np.ndarray, q_x: np.ndarray, v: np.ndarray, v_x: np.ndarray | None, scale: float) -> np.ndarray:
    """Exact scores [query, vector] of scaled q and v: doubles where those hold them all, else Python's integers.

    q_x and v_x hold the components before scaling, for integers that doubles cannot hold; no v_x: v is exact.
    """
    with np.errstate(over="ignore", invalid="ignore"):
        scores = q @ v.T
        reach = q.shape[1] * np.abs(q).max(axis=1)[:, None] * np.abs(v).max(axis=1)[None, :]
    large = ~(reach < EXACT)
    if not large.any():
        return scores
    scores[large] = 0
    exact = np.array([[int(s) for s in row] for row in scores.tolist()], object).reshape(scores.shape)
    rows, columns = np.nonzero(large)
    own = {i: integers(q_x[i], scale) for i in set(rows.tolist())}
    other = {j: integers(v_x[j], scale) if v_x is not None else v[j].astype(np.int64).tolist() for j in set(columns.tolist())}
    for i, j in zip(rows.tolist(), columns.tolist(), strict=True):
        exact[i, j] = sum(a * b for a, b in zip(own[i], other[j], strict=True))
    return exact


def order_bytes(score: int) -> bytes:
    """Orders scores outside 64 bits among each other: less than, equal to or more than b"1" with more bytes behind."""
    if -LONGEST - 1 <= score <= LONGEST:
        return b"1"
    size = (abs(score).bit_length() + 7) // 8
    text = size.to_bytes(4, "big") + abs(score).to_bytes(size, "big")
    return b"2" + text if score > 0 else b"0" + bytes(255 - c for c in text)


def of_order(score: int, beyond: bytes) -> int:
    """The whole score out of what 64 bits hold of it and order_bytes."""
    if beyond[:1] == b"1":
        return int(score)
    text = beyond[1:] if beyond[:1] == b"2" else bytes(255 - c for c in beyond[1:])
    return int.from_bytes(text[4:], "big") * (1 if beyond[:1] == b"2" else -1)
