"""Near copies by SimHash fingerprints that differ in few bits, found by Golay-code
fuzzy hashing.

A 64-bit fingerprint is cut into segments of 22, 21 and 21 bits. Two bit errors leave
one segment without error and another with at most one, and following the segments
round (1-2, 2-3, 3-1) at least one pair (exact segment, next segment with at most one
error) holds for every way to spread the errors. A key is such a pair: the exact
segment and the number of a Golay codeword near the next one, about 16 keys for each
different fingerprint. Links found in a bucket are verified by counting bits.

Equal fingerprints are merged first, so a text copied into a third of all rows is one
fingerprint. A bucket of up to BUCKET fingerprints is compared in memory and gives a
spanning set of its links. Fingerprints of larger buckets take an exact linear path:
two of them differ by at most two bits if and only if they share a point at distance
at most one, so each is grouped under its own value and its 64 one-bit changes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from footfall.llm.common import payloads, written
from footfall.llm.components import components
from footfall.llm.golay import codewords_near

SEED = 42
DISTANCE = 2  # what the key scheme covers
BUCKET = 256
SEGMENTS = ((0, 22), (22, 21), (43, 21))  # (lowest bit, bits)
_CHUNK = 1 << 14


def fingerprint(text: bytes, shingle: int = 3) -> int:
    """Majority of each bit over the XXH64 hashes of all word shingles (repeats count);
    zero without words. Fewer words than a shingle: one hash of all of them."""
    words = text.lower().split()  # bytes: A-Z only, and the six ASCII white spaces
    if not words:
        return 0
    shingle = min(shingle, len(words))
    ones, digest = np.zeros(64, dtype=np.int64), xxhash.xxh64_intdigest
    total = len(words) - shingle + 1
    for start in range(0, total, _CHUNK):
        end = min(start + _CHUNK, total)
        runs = zip(*(words[start + k : end + k] for k in range(shingle)))
        hashes = np.fromiter((digest(b" ".join(run), SEED) for run in runs), dtype="<u8", count=end - start)
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > total, bitorder="little").view("<i8")[0])


def text_digest(text: Column) -> Column:
    """SHA-256 of the whole text: what ``marks`` calls text_key. Null counts as empty."""
    return F.unhex(F.sha2(F.coalesce(text.cast("string"), F.lit("")), 256))


def marks(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """(doc_id, text_key, bits) for every row, bits as a signed long; a null text has no words."""
    schema = pa.schema([("doc_id", pa.int64()), ("text_key", pa.binary()), ("bits", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, bits = [], []
            for text in payloads(batch.column(1)):
                keys.append(hashlib.sha256(text).digest())
                bits.append(fingerprint(text, shingle))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(keys, pa.binary()), pa.array(bits, pa.int64())], schema=schema)

    chosen = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return chosen.mapInArrow(run, "doc_id long, text_key binary, bits long")


def fuzzy_keys(bits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the fingerprints and their keys, about 16 of each."""
    unsigned = bits.view(np.uint64)
    parts = [((unsigned >> np.uint64(at)) & np.uint64((1 << n) - 1)).astype(np.int64) for at, n in SEGMENTS]
    rows, keys = [], []
    for i in range(3):
        row, codeword = codewords_near(parts[(i + 1) % 3])
        rows.append(row)
        keys.append((np.int64(i) << 34) | (parts[i][row] << 12) | codeword)
    return np.concatenate(rows), np.concatenate(keys)


def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        bits = batch.column(0).to_numpy()
        rows, keys = fuzzy_keys(bits)
        yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(bits[rows])], names=["key", "bits"])


def _spanning(members: np.ndarray) -> Iterator[tuple[int, int]]:
    """Links that connect what pairs of members within DISTANCE connect."""
    unsigned = members.view(np.uint64)
    near = np.bitwise_count(unsigned[:, None] ^ unsigned[None, :]) <= DISTANCE
    left = np.ones(len(members), dtype=bool)
    for first in range(len(members)):
        if not left[first]:
            continue
        left[first], front = False, [first]
        while front:
            at = front.pop()
            found = np.flatnonzero(near[at] & left)
            left[found] = False
            front.extend(found.tolist())
            yield from ((int(members[at]), int(members[x])) for x in found)


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        links = [link for row in batch.column(0) for link in _spanning(row.values.to_numpy())]
        a, b = zip(*links) if links else ((), ())
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def links(different: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """Links (a, b) between fingerprints of ``different`` (bits, no value twice) that
    connect exactly those that a chain of pairs within two bits connects."""
    keyed = different.select("bits").mapInArrow(_keyed, "key long, bits long")
    sizes = keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    shared = keyed.join(sizes, "key")
    small = (
        shared.where(F.col("n") <= bucket).groupBy("key").agg(F.collect_list("bits").alias("members"))
        .select("members").mapInArrow(_verified, "a long, b long")
    )
    points = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda b: F.col("bits").bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), b)))
    around = (
        shared.where(F.col("n") > bucket).select("bits").distinct()
        .select("bits", F.explode(F.concat(F.array("bits"), points)).alias("point"))
    )
    hubs = around.groupBy("point").agg(F.collect_list("bits").alias("members")).where(F.size("members") > 1)  # 65 at most
    large = hubs.select(F.array_min("members").alias("a"), F.explode("members").alias("b"))
    return small.unionByName(large).where("a <> b").distinct()


def near_copies(docs: DataFrame, shingle: int = 3, bucket: int = BUCKET) -> DataFrame:
    """Each row's fingerprint and component: doc_id, bits, fingerprint (16 hex digits),
    component_id (the smallest doc_id reachable over links, itself included).

    Rows are kept as they are, repeated and null doc_ids included; a null doc_id is
    never a component's id unless it has no other. Null, empty and blank texts have
    fingerprint zero and are linked like any other. Other columns are ignored. An empty
    table gives an empty result.
    """
    marked = written(marks(docs, shingle), "fingerprints")
    different = marked.groupBy("bits").agg(F.min("doc_id").alias("least"))
    joined = _rooted(different, bucket)
    classes = joined.groupBy("root").agg(F.min("least").alias("class_least"))
    linked = joined.join(classes, "root").select("bits", "class_least")
    ids = different.join(linked, "bits", "left").select("bits", F.coalesce("class_least", "least").alias("component_id"))
    return marked.join(ids, "bits").select(
        "doc_id", "bits", F.lower(F.lpad(F.hex("bits"), 16, "0")).alias("fingerprint"), "component_id"
    )


def _rooted(different: DataFrame, bucket: int) -> DataFrame:
    """The linked rows of ``different`` (bits, no value twice) with the root of their component."""
    roots = components(links(different, bucket))
    return different.join(roots, F.col("bits") == F.col("node")).drop("node")


def surplus(docs: DataFrame, shingle: int = 3, bucket: int = BUCKET) -> DataFrame:
    """What has to go so that of each component of ``near_copies`` one row stays: that
    with the smallest doc_id, then the smallest text_key; null ids come after all others.

    (doc_id, text_key, stays, rows), one row for each different pair of id and text that
    doesn't stay, or that stays but occurs in more than one row. Null and empty texts
    count as one text. Other columns are ignored; an empty table gives an empty result.
    """
    marked = written(marks(docs, shingle), "fingerprints")
    keys = marked.groupBy("bits", "doc_id", "text_key").agg(F.count("*").alias("rows"))
    place = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_key")
    # one row a fingerprint before fingerprints meet their components
    leaders = written(keys.groupBy("bits").agg(F.min(place).alias("leader")), "leaders")
    joined = _rooted(leaders, bucket)
    first = joined.groupBy("root").agg(F.min("leader").alias("leader"))
    alone = leaders.join(joined, "bits", "left_anti")
    stay = alone.select("leader.*").unionByName(first.select("leader.*")).withColumn("found", F.lit(True))
    same = keys["doc_id"].eqNullSafe(stay["doc_id"]) & (keys["text_key"] == stay["text_key"])
    judged = keys.join(stay, same, "left").select(
        keys["doc_id"], keys["text_key"], F.col("found").isNotNull().alias("stays"), "rows"
    )
    return judged.where("not stays or rows > 1")
