from __future__ import annotations

import hashlib
import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from footfall.llm.components import components
from footfall.llm.golay import codewords_near
from footfall.llm.simhash import fingerprint, links, marks, near_copies, surplus, text_digest


def plain_fingerprint(text):
    words, word = [], ""
    for c in text or "":
        if c in " \t\n\x0b\x0c\r":
            words, word = words + [word] * bool(word), ""
        else:
            word += c.lower() if "A" <= c <= "Z" else c
    words += [word] * bool(word)
    runs = [" ".join(words[i : i + 3]) for i in range(max(len(words) - 2, 1))] if words else []
    hashes = [xxhash.xxh64(r.encode(), seed=42).intdigest() for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


def plain_components(bits):
    """Component number of each value, by comparing all pairs."""
    label = list(range(len(bits)))
    for i in range(len(bits)):
        for j in range(i):
            if (bits[i] ^ bits[j]).bit_count() <= 2 and label[i] != label[j]:
                low, high = sorted((label[i], label[j]))
                label = [low if x == high else x for x in label]
    return label


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def test_words_one_bit_apart_share_a_codeword():
    rng = np.random.default_rng(1)
    words = rng.integers(0, 1 << 23, 3000)
    keys = [set() for _ in words]
    for row, key in zip(*codewords_near(words)):
        keys[row].add(key)
    assert {len(k) for k in keys} == {1, 6}
    for bit in range(23):
        other = [set() for _ in words]
        for row, key in zip(*codewords_near(words ^ (1 << bit))):
            other[row].add(key)
        assert all(a & b for a, b in zip(keys, other))


def test_fingerprint_equals_the_definition():
    rng = random.Random(2)
    letters = "ABcdéß \t\n\x0b\x1cÀ"
    for text in ["", " \n", "One", "one TWO", "a b c", "ÀB\x0bc d"] + ["".join(rng.choices(letters, k=60)) for _ in range(200)]:
        assert fingerprint(text.encode()) % (1 << 64) == plain_fingerprint(text), text
    long = " ".join(rng.choices(["x", "y", "zz"], k=40_000))
    assert fingerprint(long.encode()) % (1 << 64) == plain_fingerprint(long)


@pytest.mark.parametrize("bucket", [256, 2])
def test_links_connect_what_all_pairs_connect(spark, bucket):
    rng = random.Random(3)
    bits = set()
    for _ in range(30):
        value = rng.getrandbits(64)
        for _ in range(12):
            bits.add(value)
            for _ in range(rng.randint(0, 4)):
                value ^= 1 << rng.randrange(64)
    bits = sorted(bits)
    frame = spark.createDataFrame([(signed(b),) for b in bits], "bits long")
    found = {r.node: r.root for r in components(links(frame, bucket)).collect()}
    label = plain_components(bits)
    groups = {}
    for b, x in zip(bits, label):
        groups.setdefault(x, set()).add(signed(b))
    for group in groups.values():
        roots = {found.get(b, b) for b in group}
        assert len(roots) == 1 and roots <= group


def test_near_copies_equals_all_pairs(spark):
    rng = random.Random(4)
    words = [f"w{i}" for i in range(300)]
    data = [(None, "odd row", 1), (900, None, 2), (901, "", 3), (902, "  \n", 4), (903, "Hi", 5), (903, "hi", 5)]
    for i in range(60):
        base = rng.choices(words, k=rng.choice([3, 30, 300]))
        for _ in range(rng.randint(1, 4)):
            copy = list(base)
            if rng.random() < 0.6:
                copy[rng.randrange(len(copy))] = "changed"
            data.append((len(data), " ".join(copy), 7))
    docs = spark.createDataFrame(data, "doc_id long, text string, bits int")
    rows = near_copies(docs).collect()
    bits = [plain_fingerprint(text) for _, text, _ in data]
    label = plain_components(bits)
    least = {}
    for (doc, _, _), x in zip(data, label):
        if doc is not None:
            least[x] = min(least.get(x, doc), doc)
    want = sorted(
        ((-1 if d is None else d), f"{b:016x}", least.get(x, -1)) for (d, _, _), b, x in zip(data, bits, label)
    )
    got = sorted(((-1 if r.doc_id is None else r.doc_id), r.fingerprint, -1 if r.component_id is None else r.component_id) for r in rows)
    assert got == want


def test_surplus_leaves_one_row_of_each_component(spark):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(300)]
    data = [(None, "odd row"), (None, "odd row"), (1, None), (1, ""), (None, ""), (2, "twice here"), (2, "twice here"), (2, "alone of its kind")]
    for i in range(40):
        base = " ".join(rng.choices(words, k=rng.choice([3, 30, 600])))
        for _ in range(rng.randint(1, 4)):
            data.append((rng.choice([None, 100 + i, 200 + i, 300 + rng.randrange(9)]), base + rng.choice(["", "", " one"])))
    docs = spark.createDataFrame(data, "doc_id long, text string").withColumns({"bits": F.lit("x"), "root": F.lit(1)})
    gone = {(r.doc_id, bytes(r.text_key)): (r.stays, r.rows) for r in surplus(docs).collect()}
    label = plain_components([plain_fingerprint(t) for _, t in data])
    key = lambda doc, text: (doc, hashlib.sha256((text or "").encode()).digest())
    groups, want = {}, {}
    for (doc, text), x in zip(data, label):
        groups.setdefault(x, []).append(key(doc, text))
    for group in groups.values():
        first = min(group, key=lambda k: (k[0] is None, k))
        for k in group:
            if k != first or group.count(k) > 1:
                want[k] = (k == first, group.count(k))
    assert gone == want and any(stays for stays, _ in want.values())


def test_text_digest_is_the_key_of_marks(spark):
    docs = spark.createDataFrame([(1, "Zoë\n"), (2, ""), (3, None)], "doc_id long, text string")
    marked = {r.doc_id: bytes(r.text_key) for r in marks(docs).collect()}
    assert marked == {r.doc_id: bytes(r.k) for r in docs.select("doc_id", text_digest(docs.text).alias("k")).collect()}


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert near_copies(docs).collect() == [] and surplus(docs).collect() == []
