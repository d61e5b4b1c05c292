"""Pivots, shards and rounds of the exact search against brute force."""

import numpy as np
import pytest

from offerloom.llm import topk


def brute(rows, queries):
    out = set()
    for i, q in queries:
        scored = sorted((-int(np.dot(q, v)), j) for j, v in rows if j != i)
        out |= {(i, rank + 1, j, -s) for rank, (s, j) in enumerate(scored[: topk.TOP])}
    return out


@pytest.mark.parametrize("kind", ["clusters", "copies", "spread"])
def test_rounds_and_pruned_pivots(spark, monkeypatch, kind):
    """Many shards of many pivots: clusters far apart, one crowd of equal vectors, and no order at all."""
    monkeypatch.setattr(topk, "SHARD", 60)
    monkeypatch.setattr(topk, "BLOCK", 7)
    monkeypatch.setattr(topk, "PIVOTS", 6)
    rng = np.random.default_rng(5)
    v = rng.normal(size=(600, 5)) * (0.1 if kind == "clusters" else 1)
    if kind == "clusters":
        v += rng.normal(size=(8, 5))[rng.integers(0, 8, 600)] * 4
    if kind == "copies":
        v[:250] = 0.75
    df = spark.createDataFrame([(i, [float(x) for x in row]) for i, row in enumerate(v)], "vec_id long, embedding array<float>")
    vectors = topk.quantised(df)
    whole = [(i, np.floor(64.0 * row.astype(np.float32).astype(np.float64)).astype(int)) for i, row in enumerate(v)]
    got = topk.top_k(vectors, vectors.where("vec_id % 20 = 0")).collect()
    assert {tuple(r) for r in got} == brute(whole, whole[::20]) and len(got) == 30 * topk.TOP


def test_pivots_out_of_reach_are_left_out():
    pivots = topk.Pivots([np.array(x, "<f8").tobytes() for x in ([100.0, 0.0], [-100.0, 0.0])])
    pivots.radius = np.array([1.0, 1.0])
    upper = pivots.bounds([np.array([1.0, 0.0], "<f8").tobytes()])
    assert upper[0, 0] >= 101 > 0 > upper[0, 1] >= -99
