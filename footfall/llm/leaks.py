"""Benchmark items that lie inside documents: size-partitioned MinHash containment search.

Items are put into classes by their number of different word shingles (up to 8, 16, 32,
...). Of each item the smallest hashes are kept, so many that an item of the class
cannot reach the threshold without one of them: with threshold t and at most u
shingles, u - ceil(t*u) + 1. So a document that holds enough of an item holds a kept
shingle, however long the document is, and no leak is missed.

The documents are read once. A task tests the hash of every shingle against two
bitmaps of fixed size (2 MB each; kept shingles, all shingles of items), built by
Spark from the items; only documents that hit the first pass on the shingles that hit
the second, as text. Joined with the items they give the exact containment. No
collection of items or documents reaches the driver or is broadcast.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from math import ceil

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from footfall.llm.common import payloads, written

SHINGLE, THRESHOLD = 5, 0.8
BITMAP_BITS = 24
_BUCKET = 1 << 15  # bits in one of Spark's bitmap buckets
_WORD = re.compile(r"\w+")


def needed(threshold: float, shingles: int) -> int:
    """Shingles that must match, of so many."""
    return max(1, ceil(threshold * shingles - 1e-9))


def shingles(text: bytes, size: int = SHINGLE) -> list[bytes]:
    """All runs of ``size`` lower-case words; the whole sequence if it is shorter."""
    words = [w.encode() for w in _WORD.findall(text.decode("utf-8", "replace").lower())]
    size = min(size, len(words))
    return [b" ".join(run) for run in zip(*(words[k:] for k in range(size)))] if size else []


def _hashes(runs: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, runs), dtype=np.uint64, count=len(runs))


def _places(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - BITMAP_BITS)).astype(np.int64)


def item_shingles(items: DataFrame, threshold: float = THRESHOLD, size: int = SHINGLE) -> DataFrame:
    """(item_id, item_key, size_class, n_shingles, shingle, place, kept): one row for each
    different shingle of each item; kept marks its MinHash sketch."""
    names = ["item_id", "item_key", "size_class", "n_shingles", "shingle", "place", "kept"]
    types = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.int64(), pa.bool_()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for item, text in zip(batch.column(0).to_pylist(), payloads(batch.column(1))):
                runs = sorted(set(shingles(text, size)))
                hashes = _hashes(runs)
                upper = 1 << max(3, (len(runs) - 1).bit_length())
                keep = set(np.argsort(hashes, kind="stable")[: upper - needed(threshold, upper) + 1].tolist())
                key = xxhash.xxh64_intdigest(text) >> 1
                places = _places(hashes).tolist()
                out += [(item, key, upper, len(runs), r, p, k in keep) for k, (r, p) in enumerate(zip(runs, places))]
            columns = list(zip(*out)) or [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=names)

    chosen = items.select(F.col("item_id").cast("long"), F.col("text").cast("string")).distinct()
    return chosen.mapInArrow(
        run, "item_id long, item_key long, size_class int, n_shingles long, shingle binary, place long, kept boolean"
    )


def _bitmap(rows: DataFrame) -> np.ndarray:
    """The places of the rows as bits; of the same size for any number of rows."""
    value = F.col("place") + 1
    parts = rows.groupBy(F.bitmap_bucket_number(value).alias("bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position(value)).alias("bits")
    )
    bits = np.zeros((1 << BITMAP_BITS) // 8, dtype=np.uint8)
    for row in parts.collect():  # at most 512 rows of 4 kB
        start = (row.bucket - 1) * _BUCKET // 8
        bits[start : start + _BUCKET // 8] = np.frombuffer(row.bits, dtype=np.uint8)
    return bits


def _in(bits: np.ndarray, places: np.ndarray) -> np.ndarray:
    return (bits[places >> 3] >> (places & 7).astype(np.uint8) & 1).astype(bool)


def _hits(docs: DataFrame, kept: np.ndarray, every: np.ndarray, size: int) -> DataFrame:
    """(doc_id, text_key, shingle): the different shingles of candidate documents that may
    be an item's; text_key is the SHA-256 of the whole text."""
    shared = docs.sparkSession.sparkContext.broadcast((kept, every))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, every = shared.value
        for batch in batches:
            out = []
            for doc, text in zip(batch.column(0).to_pylist(), payloads(batch.column(1))):
                runs = shingles(text, size)
                places = _places(_hashes(runs))
                if _in(kept, places).any():
                    key = hashlib.sha256(text).digest()
                    out += [(doc, key, r) for r in {runs[k] for k in np.flatnonzero(_in(every, places))}]
            columns = list(zip(*out)) or [()] * 3
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.binary(), pa.binary()))], names=["doc_id", "text_key", "shingle"]
            )

    chosen = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return chosen.mapInArrow(run, "doc_id long, text_key binary, shingle binary")


def _found(docs: DataFrame, items: DataFrame, threshold: float, size: int) -> DataFrame:
    """Each text under each id with each item that it holds."""
    wanted = written(item_shingles(items, threshold, size), "items")
    hits = _hits(docs, _bitmap(wanted.where("kept")), _bitmap(wanted), size)
    return (
        hits.join(wanted, "shingle")
        .groupBy("doc_id", "text_key", "item_id", "item_key", "size_class", "n_shingles")
        .agg(F.count_distinct("shingle").alias("n_found"), F.max("kept").alias("candidate"))
        .where(F.col("candidate") & (F.col("n_found") >= F.ceil(F.lit(threshold) * F.col("n_shingles") - 1e-9)))
    )


def leaked(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD, size: int = SHINGLE) -> DataFrame:
    """(doc_id, text_key) of the texts that hold any item, each once under each of its
    ids; text_key is the SHA-256 of the whole text. Otherwise as ``leaks``."""
    return _found(docs, items, threshold, size).select("doc_id", "text_key").distinct()


def leaks(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD, size: int = SHINGLE) -> DataFrame:
    """(doc_id, item_id, size_class, n_shingles, n_found, containment) for every item of
    which a document holds at least ``threshold`` of the different shingles.

    Words are runs of letters, digits and underscores, in lower case. Null, empty and
    wordless texts hold nothing and are never found; an item of fewer words than a
    shingle is one shingle, found in documents that are that sequence. Repeated rows
    give one result; of texts with the same id the best one counts. Null ids are
    compared like any other. Empty tables give an empty result.
    """
    found = _found(docs, items, threshold, size)
    best = F.max(F.struct((F.col("n_found") / F.col("n_shingles")).alias("containment"), "n_shingles", "n_found", "size_class"))
    return found.groupBy("doc_id", "item_id").agg(best.alias("best")).select(
        "doc_id", "item_id", "best.size_class", "best.n_shingles", "best.n_found", "best.containment"
    )
