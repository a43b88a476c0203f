from __future__ import annotations

import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st

from footfall.llm.tokencounts import counter, token_counts

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")


def library(text):
    return len(counter(VOCABULARY).library.encode(text or "", add_special_tokens=False).ids)


def test_whole_tokens_are_proved():
    count = counter(VOCABULARY)
    assert len(count.whole) > 20_000
    for piece in sorted(count.whole)[::400]:
        assert library(piece) == 1


def test_every_plain_character():
    count = counter(VOCABULARY)
    for point in range(0x250):
        for text in (chr(point), f"a{chr(point)}b", f"'{chr(point)} 1{chr(point)}"):
            assert count.tokens(text) == library(text), hex(point)


PARTS = ["\u0301", "—", "e\u0301", "中", "\x1c", "\u3000", "ᄀ", "ᅡ", "K", "<|endoftext|>", "<|startoftext|>", "<|", "'s", "'LL", " ", "\n", "The", "the", "ÉTÉ", "ß", "12", "…", "Σ", "é", "!!'", "http://x"]


@settings(max_examples=400, deadline=None)
@given(st.text(st.characters(codec="utf-8")) | st.text(st.characters(max_codepoint=0x24F)) | st.lists(st.sampled_from(PARTS)).map("".join))
def test_counts_are_those_of_the_library(text):
    assert counter(VOCABULARY).tokens(text) == library(text)


def test_rows(spark):
    texts = [None, "", "Two words", "x " * 3000, "a" * 5000, "İstanbul 中文", "two words"]
    data = [(i, t, -1) for i, t in enumerate(texts)] + [(None, "x", -1), (2, "Two words", -1)]
    docs = spark.createDataFrame(data, "doc_id long, text string, n_tokens int")
    got = sorted(map(tuple, token_counts(docs, VOCABULARY).collect()), key=str)
    assert got == sorted(((d, len((t or "").encode()), library(t), library(t) > 2048) for d, t, _ in data), key=str)
    assert token_counts(docs.limit(0), VOCABULARY).collect() == []
