"""Packing token sequences of documents into as few training sequences as possible:
best-two-fit.

The plan is made on the histogram of piece lengths (at most ``size`` rows, whatever the
number of documents): fill a sequence greedily with the longest length that fits, then
take out its smallest piece and put in the two lengths that fill the larger gap more
tightly, if there are two; repeat this pattern as often as the counts allow. A pattern
uses up a length each time, so there are some thousands of patterns at most, each of
at most 63 different lengths. Pieces then take their places by rank among those of the
same length. Ranks are counted in salted groups, so one length may hold any share of
the rows.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from footfall.llm.common import payloads, written

RANK_GROUP = 50_000  # rows ranked in one group of a length
_SPECIAL = "<|endoftext|>"  # fixed values: the vocabulary's special token and its id
_SPECIAL_ID = 50256


@lru_cache(maxsize=2)
def _encoders(path: str):
    """The tokenizer of the file, and the same vocabulary in the faster library."""
    import public_tokenizers
    import tiktoken
    from tokenizers import Tokenizer

    with open(path.removesuffix(".json") + ".tiktoken", "rb") as ranks:
        mergeable = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, ranks)}
    fast = tiktoken.Encoding("pieces", pat_str=public_tokenizers.PATTERN, mergeable_ranks=mergeable, special_tokens={})
    return Tokenizer.from_file(path), fast


def token_ids(text: str, path: str) -> np.ndarray:
    """The ids that the library ``tokenizers`` gives without added special tokens; the
    special string inside a text is its special token, as is that library's default.

    The ids come from ``tiktoken`` with the same vocabulary, five times as fast. A text
    that its regular expressions give up on (very long runs of white space) goes to
    ``tokenizers`` itself.
    """
    exact, fast = _encoders(path)
    parts = []
    for number, part in enumerate(text.split(_SPECIAL)):
        if number:
            parts.append(np.array([_SPECIAL_ID], dtype="<u4"))
        try:
            parts.append(np.asarray(fast.encode_to_numpy(part, disallowed_special=()), dtype="<u4"))
        except BaseException as error:  # the library's panics are no Exception
            if isinstance(error, (KeyboardInterrupt, SystemExit, MemoryError)):
                raise
            parts.append(np.array(exact.encode(part, add_special_tokens=False).ids, dtype="<u4"))
    return np.concatenate(parts)


def pieces(docs: DataFrame, vocabulary: str, size: int = 2048, end_id: int = 0) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of every row: its ids and ``end_id``,
    cut only if longer than ``size``; then the first piece takes the odd rest."""
    schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for doc, text in zip(batch.column(0).to_pylist(), payloads(batch.column(1))):
                ids = np.append(token_ids(text.decode("utf-8", "replace"), vocabulary), np.uint32(end_id)).astype("<u4")
                start, end = 0, len(ids) % size or size
                for number in range(-(-len(ids) // size)):
                    out.append((doc, number, start, end - start, zlib.crc32(ids[start:end].tobytes())))
                    start, end = end, end + size
            columns = list(zip(*out)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

    chosen = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return chosen.mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def _two_for_one(counts: np.ndarray, gap: int, smallest: int) -> tuple[int, int] | None:
    """The two lengths in stock with the largest sum in the gap, if above ``smallest``."""
    stock = np.flatnonzero(counts[: gap + 1])
    if not len(stock):
        return None
    partner = stock[np.searchsorted(stock, gap - stock, side="right") - 1]
    fits = gap - stock >= stock[0]
    alone = fits & (partner == stock) & (counts[stock] < 2)  # the next shorter one then
    partner = np.where(alone, stock[np.maximum(np.searchsorted(stock, stock) - 1, 0)], partner)
    fits &= ~(alone & (partner == stock))
    sums = np.where(fits, stock + partner, 0)
    best = int(sums.argmax())
    return (int(stock[best]), int(partner[best])) if sums[best] > smallest else None


def plan(histogram: dict[int, int], size: int = 2048) -> np.ndarray:
    """Rows (length, first rank, copies in a sequence, first sequence, offset): the
    pieces of a length with ranks from ``first rank`` go, ``copies`` at a time, into
    consecutive sequences, side by side from ``offset``."""
    counts = np.zeros(size + 1, dtype=np.int64)
    for length, n in histogram.items():
        counts[length] = n
    used = np.zeros(size + 1, dtype=np.int64)
    rows, sequence = [], 0
    while counts.any():
        pattern: dict[int, int] = {}
        gap, stock = size, counts.copy()
        while gap and len(fitting := np.flatnonzero(stock[: gap + 1])):
            length = int(fitting[-1])
            copies = int(min(stock[length], gap // length))
            pattern[length] = copies
            stock[length] -= copies
            gap -= copies * length
        smallest = min(pattern)
        if gap:
            stock[smallest] += 1
            if two := _two_for_one(stock, gap + smallest, smallest):
                pattern[smallest] -= 1
                for length in two:
                    pattern[length] = pattern.get(length, 0) + 1
        pattern = {length: copies for length, copies in pattern.items() if copies}
        times = min(int(counts[length]) // copies for length, copies in pattern.items())
        offset = 0
        for length in sorted(pattern, reverse=True):
            copies = pattern[length]
            rows.append((length, int(used[length]), copies, sequence, offset))
            used[length] += copies * times
            counts[length] -= copies * times
            offset += copies * length
        sequence += times
    return np.array(sorted(rows), dtype=np.int64).reshape(-1, 5)


def _ranked(cut: DataFrame, total: int) -> DataFrame:
    """With a rank from 0 among the pieces of the same length."""
    groups = -(-max(total, 1) // RANK_GROUP)
    salted = cut.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(groups)))
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    firsts = salted.groupBy("length", "salt").agg(F.count("*").alias("n")).select(
        "length", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first")
    )
    within = Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "start", "ids_crc32")
    return (
        salted.withColumn("nth", F.row_number().over(within).cast("long"))
        .join(firsts, ["length", "salt"])
        .withColumn("rank", F.col("first") + F.col("nth") - 1).drop("salt", "nth", "first")
    )


def pack(cut: DataFrame, size: int = 2048) -> DataFrame:
    """``cut`` (doc_id, piece, start, length, ids_crc32; lengths 1 to ``size``) with
    sequence_id and offset. Rows that are alike in all columns get places of their own.
    An empty table gives an empty result."""
    histogram = {r.length: r.n for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}
    rows = plan(histogram, size)
    starts = (rows[:, 0] << 48) + rows[:, 1]
    shared = cut.sparkSession.sparkContext.broadcast((starts, rows))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        starts, rows = shared.value
        for batch in batches:
            length, rank = batch["length"].to_numpy(), batch["rank"].to_numpy()
            at = rows[np.searchsorted(starts, (length << 48) + rank, side="right") - 1] if len(length) else rows[:0]
            nth, copies = rank - at[:, 1], at[:, 2]
            placed = [batch[c] for c in ("doc_id", "piece", "start", "length", "ids_crc32")]
            placed += [pa.array(at[:, 3] + nth // copies), pa.array(at[:, 4] + nth % copies * length)]
            yield pa.RecordBatch.from_arrays(placed, names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return _ranked(cut, sum(histogram.values())).mapInArrow(
        run, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    )


def packed(docs: DataFrame, vocabulary: str, size: int = 2048, end_id: int = 0) -> DataFrame:
    """Places of all pieces of ``docs`` (doc_id, text): one row per piece.

    A null or empty text is the end id alone. Repeated rows and null doc_ids are packed
    like any other. Columns besides doc_id and text are ignored.
    """
    return pack(written(pieces(docs, vocabulary, size, end_id), "pieces"), size)
