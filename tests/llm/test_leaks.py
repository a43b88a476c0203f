from __future__ import annotations

import random
import re

import pytest

from footfall.llm.leaks import leaks, needed


def plain(docs, items, threshold, size=5):
    """Every document against every item."""

    def runs(text):
        words = re.findall(r"\w+", (text or "").lower())
        k = min(size, len(words))
        return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)} if k else set()

    best = {}
    for doc, text, *_ in docs:
        have = runs(text)
        for item, wanted in items:
            want = runs(wanted)
            if want and len(want & have) >= needed(threshold, len(want)):
                best[doc, item] = max(best.get((doc, item), (0, 0)), (len(want & have) / len(want), len(want)))
    return {(d, i, n, round(c, 9)) for (d, i), (c, n) in best.items()}


@pytest.mark.parametrize("threshold", [0.8, 1.0, 0.3])
def test_equals_all_pairs(spark, threshold):
    rng = random.Random(7)
    words = [f"w{i}" for i in range(400)]
    items = [(i, " ".join(rng.choices(words, k=rng.choice([6, 9, 13, 40, 90])))) for i in range(25)]
    items += [(100, None), (101, ""), (102, "w1 w2"), (3, items[3][1]), (104, items[4][1]), (None, items[5][1]), (105, "!!! ...")]
    docs = [(None, None, 0), (200, "", 0), (201, "W1, w2!", 0), (202, "w0 w1 w2", 0)]
    for i in range(120):
        text = rng.choices(words, k=rng.choice([0, 5, 50, 2000]))
        for _ in range(rng.randint(0, 3)):
            passage = (rng.choice(items)[1] or "").split()
            for _ in range(rng.randint(0, max(1, len(passage) // 8))):
                if passage:
                    passage[rng.randrange(len(passage))] = rng.choice(words)
            at = rng.randint(0, len(text))
            text[at:at] = [w.title() + "," for w in passage]
        docs.append((rng.choice([i, i, None, 5]), " ".join(text), 9))
    docs += docs[-5:]
    frame = spark.createDataFrame(docs, "doc_id long, text string, item_id int")
    found = leaks(frame, spark.createDataFrame(items, "item_id long, text string"), threshold)
    rows = found.collect()
    got = {(r.doc_id, r.item_id, r.n_shingles, round(r.containment, 9)) for r in rows}
    want = plain(docs, items, threshold)
    assert len(rows) == len(got) and got == want and len(want) > 20


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b c d e f g")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "a b c d e f")], "item_id long, text string")
    assert leaks(docs, items).count() == 1
    assert leaks(docs, items.limit(0)).count() == 0
    assert leaks(docs.limit(0), items).count() == 0
