"""Token counts of whole texts by the whole-token shortcut.

The vocabulary ``word_bpe_49k`` cuts a text into pre-tokens (words, single digits, runs
of other signs) and merges each on its own. Which vocabulary strings come out as one
token is proved beforehand by the library itself: every entry that ends a word is
encoded alone and kept if it gives that one id. A pre-token in this set counts one;
only the others are merged by the library, and their counts remembered.

The cutting rule is applied here only to characters below U+0250, where lower case,
letters, digits and white space are the same in both. A stretch between blanks that has
any other character goes to the library whole; neither pre-tokens nor composed
characters reach over a blank. Special strings are cut out first, as the library does.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from footfall.llm.common import payloads

LIMIT = 2048
REMEMBERED = 200_000  # pre-tokens whose counts a task keeps
_WORD_END = "</w>"
_PLAIN = re.compile("[\x00-ɏ]*")
_BLANKS = re.compile(r"[ \t\r\n]+")
# Fixed value: the vocabulary's cutting rule; white space as it is below U+0250.
_SPACE = r"\t-\r \x85\xa0"
_PRE_TOKEN = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|\p{{L}}+|\p{{N}}|[^{_SPACE}\p{{L}}\p{{N}}]+")


def byte_letters() -> dict[str, int]:
    """The letters by which a byte-level vocabulary writes the 256 bytes: printable
    Latin-1 characters stand for themselves, the others follow from U+0100."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(0x100 + k): b for k, b in enumerate(others)}


class Counter(dict):
    """Tokens of a pre-token: known for whole tokens, else asked and remembered."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        super().__init__()
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.specials = sorted((t.content for t in self.library.get_added_tokens_decoder().values()), key=len, reverse=True)
        self.cut = re.compile("|".join(map(re.escape, self.specials))) if self.specials else None
        self.whole = self._whole_tokens()
        self.update(dict.fromkeys(self.whole, 1))

    def _whole_tokens(self) -> frozenset[str]:
        letters, strings = byte_letters(), {}
        for token, number in self.library.get_vocab(with_added_tokens=False).items():
            if token.endswith(_WORD_END) and all(c in letters for c in token[: -len(_WORD_END)]):
                try:
                    text = bytes(letters[c] for c in token[: -len(_WORD_END)]).decode()
                except UnicodeDecodeError:
                    continue
                if text and _PLAIN.fullmatch(text) and _PRE_TOKEN.findall(text) == [text]:
                    strings[text] = number
        encoded = self.library.encode_batch(list(strings), add_special_tokens=False)
        return frozenset(t for (t, n), e in zip(strings.items(), encoded) if e.ids == [n])

    def __missing__(self, piece: str) -> int:
        if len(self) > len(self.whole) + REMEMBERED:
            self.clear()
            self.update(dict.fromkeys(self.whole, 1))
        count = self[piece] = len(self.library.encode(piece, add_special_tokens=False).ids)
        return count

    def tokens(self, text: str) -> int:
        """As many as the library gives for the whole text."""
        total, start = 0, 0
        for special in self.cut.finditer(text) if self.cut else ():
            total += self._part(text[start : special.start()]) + 1
            start = special.end()
        return total + self._part(text[start:])

    def _part(self, text: str) -> int:
        if _PLAIN.fullmatch(text):
            return sum(map(self.__getitem__, _PRE_TOKEN.findall(text.lower())))
        total, others = 0, []
        for stretch in _BLANKS.split(text):
            if _PLAIN.fullmatch(stretch):
                total += sum(map(self.__getitem__, _PRE_TOKEN.findall(stretch.lower())))
            else:
                others.append(stretch)
        return total + sum(len(e.ids) for e in self.library.encode_batch(others, add_special_tokens=False))


@lru_cache(maxsize=2)
def counter(path: str) -> Counter:
    return Counter(path)


def token_counts(docs: DataFrame, vocabulary: str, limit: int = LIMIT) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of every row, from the whole text.

    A null text counts as empty: no bytes, no tokens. Repeated rows and null doc_ids are
    kept; other columns are ignored.
    """
    names = ["doc_id", "n_bytes", "n_tokens", "over_limit"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(vocabulary)
        for batch in batches:
            sizes, tokens = [], []
            for text in payloads(batch.column(1)):
                sizes.append(len(text))
                tokens.append(count.tokens(text.decode("utf-8", "replace")))
            over = [n > limit for n in tokens]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(tokens, pa.int64()), pa.array(over, pa.bool_())], names=names
            )

    chosen = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return chosen.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
