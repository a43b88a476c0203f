from __future__ import annotations

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from footfall.llm.packing import pack, packed, plan, token_ids

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
EXACT = Tokenizer.from_file(VOCABULARY)


def ids(text):
    return EXACT.encode(text or "", add_special_tokens=False).ids


@settings(max_examples=300, deadline=None)
@given(st.text(st.characters(codec="utf-8")) | st.lists(st.sampled_from(["<|endoftext|>", " ", "  ", "\n", "a", "don't", "é", "12", "<|"])).map("".join))
def test_ids_are_those_of_the_library(text):
    assert token_ids(text, VOCABULARY).tolist() == ids(text)


def test_very_long_runs():
    for text in [" " * 200_000, "a" * 20_000, "\n" * 50_000 + "x", "ab" * 5_000]:
        assert token_ids(text, VOCABULARY).tolist() == ids(text)


def check_places(rows, size):
    filled = defaultdict(list)
    for r in rows:
        filled[r.sequence_id].append((r.offset, r.length))
    for places in filled.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end
            end += length
        assert end <= size
    return len(filled)


@pytest.mark.parametrize("seed", range(4))
def test_plan_places_every_piece_once(seed):
    rng = random.Random(seed)
    histogram = Counter(min(100, int(rng.expovariate(1 / 30)) + 1) for _ in range(rng.choice([1, 50, 5000])))
    rows = plan(histogram, 100)
    ends = {}
    for length, n in histogram.items():
        own = [r for r in rows.tolist() if r[0] == length]
        assert own[0][1] == 0
        ends[length] = n
    total = sum(length * n for length, n in histogram.items())
    sequences = set()
    bins = defaultdict(int)
    for length, n in histogram.items():
        own = [r for r in rows.tolist() if r[0] == length]
        for number, (_, first, copies, sequence, _) in enumerate(own):
            last = own[number + 1][1] if number + 1 < len(own) else n
            for rank in range(first, last):
                bins[sequence + (rank - first) // copies] += length
    assert max(bins.values()) <= 100 and sum(bins.values()) == total
    assert set(bins) == set(range(len(bins)))
    assert len(bins) <= max(-(-total // 100) * 1.02 + 1, len([1 for length, n in histogram.items() for _ in range(n) if length > 50]))


def test_two_pieces_fill_the_gap_better():
    # greedy: 6+3 leaves a gap of 1 of 10; two pieces of 2 fill it
    bins = plan({6: 1, 3: 1, 2: 2}, 10)
    assert {tuple(r[[0, 3]]) for r in bins} == {(6, 0), (2, 0), (3, 1)}


def test_hot_length_is_ranked_in_groups(spark, monkeypatch):
    monkeypatch.setattr("footfall.llm.packing.RANK_GROUP", 7)
    data = [(i, 0, 0, 5 if i % 3 else 1 + i % 16, i * 7) for i in range(200)] + [(1, 0, 0, 5, 7)] * 3 + [(None, 0, 0, 16, 1)]
    rows = pack(spark.createDataFrame(data, "doc_id long, piece int, start long, length long, ids_crc32 long"), 16).collect()
    assert Counter((r.doc_id, r.length) for r in rows) == Counter((d[0], d[3]) for d in data)
    assert check_places(rows, 16) <= len(data) / 2


def test_packed_documents(spark):
    rng = random.Random(5)
    texts = [None, "", "one", "<|endoftext|> x", "Dog " * 700] + [" ".join(rng.choices(["so", "many", "words", "Ünter"], k=rng.randint(1, 90))) for _ in range(60)]
    data = [(i, t, "clash") for i, t in enumerate(texts)] + [(2, "one", "clash"), (None, "nobody", "x")]
    docs = spark.createDataFrame(data, "doc_id long, text string, length string")
    rows = packed(docs, VOCABULARY, 128).collect()
    check_places(rows, 128)
    want = Counter()
    for doc, text, _ in data:
        full = np.array([*ids(text), 0], dtype="<u4")
        start, end, number = 0, len(full) % 128 or 128, 0
        while start < len(full):
            want[doc, number, start, end - start, zlib.crc32(full[start:end].tobytes())] += 1
            start, end, number = end, end + 128, number + 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want


def test_empty_table(spark):
    assert packed(spark.createDataFrame([], "doc_id long, text string"), VOCABULARY).collect() == []
