from __future__ import annotations

import numpy as np
import pytest

from footfall.llm.vectors import Index, _distances, nearest

SCHEMA = "vec_id long, embedding array<float>, score string"


def brute(data, every, k):
    out = {}
    for query, q, _ in data:
        if query % every:
            continue
        best = {}
        for vec, v, _ in data:
            if vec != query:
                best[vec] = max(best.get(vec, -np.inf), float(np.dot(np.array(q, float), np.array(v, float))))
        out[query] = sorted(((-s, v) for v, s in best.items()))[:k]
    return out


def test_probing_finds_every_code_within_the_radius():
    rng = np.random.default_rng(1)
    codes = rng.integers(0, 1 << 63, (300, 2), dtype=np.int64).view(np.uint64)
    codes = np.concatenate([codes, codes[:100] ^ np.uint64(0b1011), codes[:50]])
    index = Index(codes)
    for radius in (0, 3, 7, 8, 40, 60, 128):
        for code in codes[:20]:
            assert index.within(code, radius).tolist() == np.flatnonzero(_distances(codes, code) <= radius).tolist()


@pytest.mark.parametrize("kind", ["random", "clustered", "scaled"])
def test_recall(spark, kind):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(3000, 32))
    if kind == "clustered":
        x = x * 0.3 + rng.normal(size=(12, 32))[rng.integers(0, 12, 3000)]
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    if kind == "scaled":
        x *= rng.uniform(0.3, 2, size=(3000, 1))
    data = [(i, v.astype(np.float32).tolist(), "x") for i, v in enumerate(x)]
    rows = nearest(spark.createDataFrame(data, SCHEMA), every=20, k=20, sample=1000, shard_rows=900, block=64).collect()
    want = brute(data, 20, 20)
    got = {}
    for r in sorted(rows, key=lambda r: (r.query_id, r.rank)):
        got.setdefault(r.query_id, []).append((-r.score, r.vec_id, r["rank"]))
    assert set(got) == set(want)
    hits = sum(len({v for _, v, _ in got[q]} & {v for _, v in want[q]}) for q in want)
    assert hits / (20 * len(want)) >= 0.93
    for q, found in got.items():
        assert [n for *_, n in found] == list(range(1, 21)) and found == sorted(found)
        for score, vec, _ in found:
            assert abs(-score - np.dot(np.array(data[q][1]), np.array(data[vec][1]))) < 1e-12


def test_odd_rows_and_ties(spark):
    bad = [(40, None, ""), (60, [], ""), (80, [0.0, 0.0], ""), (100, [1.0, None], ""), (120, [float("nan"), 1.0], ""), (140, [float("inf"), 1.0], ""), (160, [1.0, 2.0, 3.0], ""), (None, [1.0, 0.0], "")]
    good = [(0, [1.0, 0.0], ""), (0, [1.0, 0.0], ""), (7, [1.0, 0.0], ""), (5, [1.0, 0.0], ""), (5, [0.5, 0.0], ""), (9, [-1.0, 0.0], ""), (20, [0.0, 1.0], "")]
    rows = nearest(spark.createDataFrame(bad + good, SCHEMA)).collect()
    got = {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in rows}
    assert got == {(0, 1): (5, 1.0), (0, 2): (7, 1.0), (0, 3): (20, 0.0), (0, 4): (9, -1.0), (20, 1): (0, 0.0), (20, 2): (5, 0.0), (20, 3): (7, 0.0), (20, 4): (9, 0.0)}
    for few in (bad, [], good[:1]):
        assert nearest(spark.createDataFrame(few, SCHEMA)).collect() == []
