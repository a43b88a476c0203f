from __future__ import annotations

import math

import numpy as np
import pytest

from footfall.llm.topk import products, top_k

SCHEMA = "vec_id long, embedding array<float>, score string, row int"


def sound(v):
    return v is not None and all(x is not None and math.isfinite(x) for x in v)


def brute(data, every, k):
    rows = sorted({(i, tuple(math.floor(256 * x) for x in v)) for i, v in data if i is not None and sound(v)})
    out = []
    for query, q in rows:
        if query % every == 0:
            scored = [(-sum(a * b for a, b in zip(q, v)), i) for i, v in rows if len(v) == len(q) and (i, v) != (query, q)]
            out += [(query, rank, i, -s) for rank, (s, i) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out)


def floats(matrix):
    return [[float(x) for x in row] for row in np.asarray(matrix, np.float32)]


def found(spark, data, **options):
    table = spark.createDataFrame([(i, v, "mine", 7) for i, v in data], SCHEMA)
    return sorted(map(tuple, top_k(table, **options).collect()))


@pytest.mark.parametrize("lists, kind", [(2, "random"), (4, "negative"), (3, "near"), (2, "copies")])
def test_equals_brute_force(spark, lists, kind):
    rng = np.random.default_rng(len(kind))
    x = rng.normal(size=(600, 10))
    if kind == "negative":
        x = -np.abs(x) * np.where(np.arange(600) % 2, 1, -1)[:, None]
    if kind == "near":
        x[:300] = x[0] + rng.normal(size=(300, 10)) * 0.05
    if kind == "copies":
        x[rng.permutation(600)[:400]] = x[0]
    data = list(zip(range(600), floats(x / 3)))
    assert found(spark, data, every=20, k=5, lists=lists, depth=4, shard_rows=100, block=8) == brute(data, 20, 5)


def test_odd_rows_ties_and_few_candidates(spark):
    inf, nan = float("inf"), float("nan")
    data = [
        (0, [0.5, 0.25, 0.125]), (0, [0.5, 0.25, 0.125]), (0, [0.5, 0.5, 0.5]), (50, [0.5, 0.25, 0.125]), (7, [0.5, 0.25, 0.125]),
        (None, [1.0, 1.0, 1.0]), (100, None), (150, [1.0, None, 1.0]), (200, [1.0, nan, 1.0]), (3, [inf, 1.0, 1.0]),
        (250, []), (8, []), (300, [2.0]), (9, [1e9, 1.0]), (350, [3.0, -1e3]), (400, [0.0, 0.0, 0.0]),
    ]
    assert found(spark, data) == brute(data, 50, 5)


def test_every_row_alike(spark):
    data = [(i, [1.0, -1.0]) for i in range(120)]
    assert found(spark, data, shard_rows=50) == brute(data, 50, 5)


def test_products_are_exact_beyond_doubles():
    a = np.array([[3_000_000_019, 7]], np.int64)
    assert products(a, a).tolist() == [[3_000_000_019**2 + 49]]
    assert products(a[:, :0], a[:, :0]).tolist() == [[0]]


def test_empty_table(spark):
    assert found(spark, []) == []
