from __future__ import annotations

import math
import random
import re

import pytest

from footfall.llm.common import prepared
from footfall.llm.lexical import search, terms

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def plain_terms(text):
    return TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, k):
    held = [(doc, plain_terms(text)) for doc, text in docs]
    number, total = sum(bool(t) for _, t in held), sum(len(t) for _, t in held)
    wanted, df = {}, {}
    for item, text in items:
        wanted.setdefault(item, set()).update(plain_terms(text))
    for _, t in held:
        for term in set(t):
            df[term] = df.get(term, 0) + 1
    out = []
    for item, vocabulary in wanted.items():
        found = []
        for doc, t in held:
            m = 50 + (50 * len(t) * number) // total if t else 0
            score = 0
            for term in vocabulary & set(t):
                w = math.floor(1000 * math.log((2 * number + 2) / (2 * df[term] + 1)))
                tf = t.count(term)
                score += w * ((1_000_000_000 * tf) // (1000 * tf + 20 * m))
            if score > 0:
                found.append((-score, doc is None, doc or 0, doc))
        out += [(item, rank, doc, -s) for rank, (s, _, _, doc) in enumerate(sorted(found)[:k], 1)]
    return sorted(out, key=repr)


def found(spark, docs, items, **options):
    prepared(spark)
    docs = spark.createDataFrame([(*d, "mine", 1) for d in docs], "doc_id long, text string, terms string, n int")
    items = spark.createDataFrame([(*i, "mine") for i in items], "item_id long, text string, term string")
    return sorted(map(tuple, search(docs, items, **options).collect()), key=repr)


def made(number, seed):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(120)] + ["Zoë", "straße", "x1y", "ÀB", "日本"]
    weights = [1 / (i + 1) for i in range(len(words))]
    text = lambda n: rng.choice([" ", ", ", "-"]).join(rng.choices(words, weights, k=n))
    docs = [(i, text(rng.choice([1, 5, 40, 200]))) for i in range(number)]
    docs += [(number + i, docs[3][1]) for i in range(60)]
    return rng, docs, [(i, text(rng.choice([1, 3, 12]))) for i in range(30)]


@pytest.mark.parametrize("shape", [dict(), dict(shard_rows=40, block_items=7), dict(shard_terms=300, block_terms=25)])
def test_equals_brute_force(spark, shape):
    _, docs, items = made(400, 2)
    assert found(spark, docs, items, k=8, **shape) == brute(docs, items, 8)


def test_odd_rows(spark):
    _, docs, items = made(30, 3)
    docs += [(None, "w1 w2"), (None, "w1 w2"), (None, None), (900, None), (901, ""), (902, " .;\n"), (5, "w1 W2 w2"), (5, "w1 W2 w2"), (903, "w3 " * 50_000 + "ÀB àb")]
    items += [(70, None), (71, ""), (72, "--"), (None, "w1 w3"), (None, "w4"), (3, "w1"), (3, "w2 ÀB"), (3, "w2 ÀB"), (73, "nowhere"), (74, "àb")]
    assert found(spark, docs, items, k=50, shard_rows=10, block_items=5) == brute(docs, items, 50)


def test_terms():
    text = "A-Zed_9 \x00ÀB\u00a0c\u2003D—e{f}~g\x7fh"
    assert [t.decode() for t in terms(text.encode())] == plain_terms(text)


def test_empty_tables(spark):
    assert found(spark, [], [(1, "a")]) == [] == found(spark, [(1, "a")], []) == found(spark, [(1, "b")], [(1, "a")])


def test_equal_scores_over_many_shards_go_by_doc_id(spark):
    """Copies that tie at the last place, in shards other than those searched first; null ids come last."""
    docs = [(i * 37 % 200, "stone water old") for i in range(200)] + [(1000 + i, "stone water") for i in range(100)] + [(None, "stone water old")] * 5
    docs += [(2000 + i, f"other word{i}") for i in range(300)]
    rows = spark.createDataFrame(docs, "doc_id long, text string")
    items = spark.createDataFrame([(1, "stone water old"), (2, "old"), (3, "nothing here")], "item_id long, text string")
    for k in (7, 50, 202):
        got = search(rows, items, k=k, shard_rows=16, block_items=1).collect()
        want = [*range(200), *[None] * 5][:k]
        for item in (1, 2):
            assert [r.doc_id for r in sorted((r for r in got if r.item_id == item), key=lambda r: r.rank)] == want
        assert {r.item_id for r in got} == {1, 2}
