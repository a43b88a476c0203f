"""A two-level capture index over archive records.

First level: lines sorted by reversed-host URL key, cut into compressed blocks, in
range partitions of the key (and page, so that one URL may have any share of the
records); each partition is a file of gzip members, one a block. Second level: a sparse
directory, a small table of its own, with each block's first key and place. A lookup
goes to the partitions its key can lie in (by their first keys, one for each of a
bounded number of partitions), binary-searches their directories, and reads the byte
ranges of the blocks found and no others; within them it searches the lines. What it
returns are byte ranges of records.
"""

from __future__ import annotations

import gzip
import json
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from footfall.llm import warc
from footfall.llm.common import written
from footfall.session import shared_dir

BLOCK_LINES = 3_000
PART_LINES = 250_000
_FIELDS = ("page_id", "record_type", "payload_digest", "file", "offset", "length")
_SCHEMA = "url_key string, page_id long, record_type string, payload_digest string, file string, offset long, length long"
_PLACE = "file string, offset long, length long"


def build(entries: DataFrame, block_lines: int = BLOCK_LINES, part_lines: int = PART_LINES) -> DataFrame:
    """The directory (part, block, first_key, n_lines, file, offset, length) of the blocks of
    ``entries`` (url_key, page_id, record_type, payload_digest, file, offset, length);
    blocks and directory are written to the shared folder. Keys hold no white space.
    A block is gzip over a line with its part and number and then a line ``key, space,
    JSON`` for each entry."""
    spark = entries.sparkSession
    entries = written(entries, "entries")  # counted, sampled for its ranges, then laid out
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-entries.count() // part_lines))

    def block(part: int, number: int, lines: list[str]) -> pa.RecordBatch:
        packed = warc.member("\n".join([f"{part} {number}", *lines]).encode())[:-1]
        return pa.RecordBatch.from_arrays([pa.array([packed], pa.binary())], names=["member"])

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number, lines = TaskContext.get().partitionId(), 0, []
        for batch in batches:
            for key, *values in zip(*(batch[c].to_pylist() for c in ("url_key", *_FIELDS))):
                lines.append(f"{key} {json.dumps(dict(zip(_FIELDS, values)))}")
                if len(lines) == block_lines:
                    yield block(part, number, lines)
                    number, lines = number + 1, []
        if lines:
            yield block(part, number, lines)

    def listed(file: str, offset: int, length: int, content: bytes) -> tuple:
        head, first, *rest = content.decode().split("\n")
        part, number = head.split(" ")
        return int(part), int(number), first.split(" ", 1)[0], 1 + len(rest), file, offset, length

    order = ["url_key", "page_id", "file", "offset"]
    laid = entries.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    path = shared_dir(spark, "index")
    warc.write_members(laid.mapInArrow(blocks, "member binary"), path)
    fields = [
        pa.field("part", pa.int32()), pa.field("block", pa.int32()), pa.field("first_key", pa.string()), pa.field("n_lines", pa.int64()),
        pa.field("file", pa.string()), pa.field("offset", pa.int64()), pa.field("length", pa.int64()),
    ]
    schema = f"part int, block int, first_key string, n_lines long, {_PLACE}"
    return written(warc.each_member(spark, path, listed, fields, schema), "directory")


def _span(firsts: list[str], key: str) -> range:
    """Places of the sorted first keys whose stretches can hold the key."""
    return range(max(bisect_left(firsts, key) - 1, 0), bisect_right(firsts, key))


def named_blocks(directory: DataFrame, keys: DataFrame, part_lines: int = PART_LINES) -> DataFrame:
    """The blocks (file, offset, length) that can hold each different key of ``keys``
    (url_key): what the directory alone tells, no block is read."""
    tops = directory.groupBy("part").agg(F.min("first_key").alias("first_key")).orderBy("part").collect()  # one row a partition
    parts, firsts = [r.part for r in tops], [r.first_key for r in tops]

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [(parts[k], key) for key in batch.column(0).to_pylist() for k in _span(firsts, key)]
            columns = list(zip(*out)) or [()] * 2
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int32()), pa.array(columns[1], pa.string())], names=["part", "url_key"])

    def search(wanted: pd.DataFrame, blocks: pd.DataFrame) -> pd.DataFrame:
        blocks = blocks.sort_values("block")
        own, places = blocks["first_key"].tolist(), list(zip(blocks["file"], blocks["offset"], blocks["length"]))
        out = [(key, *places[k]) for key in wanted["url_key"] for k in _span(own, key)]
        return pd.DataFrame(out, columns=["url_key", "file", "offset", "length"]).astype({"offset": "int64", "length": "int64"})

    different = keys.select("url_key").where("url_key is not null").distinct()
    routed = written(different.mapInArrow(route, "part int, url_key string"), "routed")
    # any number of keys may lie between two lines: a part's keys come in slices
    most = routed.groupBy("part").count().agg(F.max("count")).first()[0] or 0
    slices = -(-most // part_lines) or 1
    sliced = routed.withColumn("slice", F.pmod(F.xxhash64("url_key"), F.lit(slices)))
    copies = directory.withColumn("slice", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(slices - 1).cast("long"))))
    return sliced.groupBy("part", "slice").cogroup(copies.groupBy("part", "slice")).applyInPandas(search, f"url_key string, {_PLACE}")


def lookup(directory: DataFrame, keys: DataFrame, part_lines: int = PART_LINES) -> DataFrame:
    """The entries of all records whose key is among ``keys`` (url_key). Each different
    key is searched once; a null key finds nothing."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = (pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64())
        name, opened, place, own, lines = None, None, None, [], []
        for batch in batches:
            out = []
            for key, *at in zip(*(batch[c].to_pylist() for c in ("url_key", "file", "offset", "length"))):
                if at[0] != name:
                    if opened:
                        opened.close()
                    name, opened = at[0], warc._open(at[0])
                if at != place:
                    place = at
                    opened.seek(at[1])
                    lines = gzip.decompress(opened.read(at[2])).decode().split("\n")[1:]
                    own = [line.split(" ", 1)[0] for line in lines]
                for k in range(bisect_left(own, key), bisect_right(own, key)):
                    out.append((key, *json.loads(lines[k].split(" ", 1)[1]).values()))
            columns = list(zip(*out)) or [()] * len(types)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=["url_key", *_FIELDS])
        if opened:
            opened.close()

    named = named_blocks(directory, keys, part_lines)
    return warc.by_file(named).mapInArrow(read, _SCHEMA)
