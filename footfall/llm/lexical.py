"""Ranked lexical search of items in documents by dual trees of coordinate maxima.

A document is a vector with a coordinate for each of its terms (``impact``), an item one
with its terms' weights; the score is their inner product. A node of a tree holds, for
each term, the largest coordinate below it. The inner product of an item node and a
document node is therefore at least the score of every item below with every document
below: where it is less than the weakest k-th best score of these items, the whole batch
of pairs is left out, and nothing is lost.

The documents are read once. Of their terms those pass that may be an item's (a bitmap of
fixed size); with the documents' lengths they are all that is needed from here on. Rows
are sorted by the smallest hashes of their terms, so that like documents lie together, and
cut into shards, which are the document tree's upper nodes: their maxima are a table.
Items are dealt to blocks. Each block first searches the shards of its largest bounds;
the k-th scores found there are floors for all other shards. A shard whose bound is below
its block's weakest floor is never read again for it. Within a task (a block and a shard)
the trees go on: groups of items, items; runs of batches, batches of documents, documents.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from footfall.llm.common import payloads, written

K = 50
SHARD_ROWS, SHARD_TERMS = 8_192, 1 << 20  # documents, and terms kept of them
BLOCK_ITEMS, BLOCK_TERMS = 256, 1 << 14  # items, and terms of them
SEED_SHARDS = 2  # that a block searches first
ITEM_NODE, BATCH, RUN = 16, 32, 16  # items in a node; documents in a batch; batches in a run
BITMAP_BITS = 24
_BUCKET = 1 << 15  # bits in one of Spark's bitmap buckets
_REMEMBERED = 1 << 18

_PART_OF_TERM = [48 <= c <= 57 or 65 <= c <= 90 or 97 <= c <= 122 or c >= 128 for c in range(256)]
_FOLDED = bytes(c + 32 * (65 <= c <= 90) if part else 32 for c, part in enumerate(_PART_OF_TERM))


def terms(text: bytes) -> list[bytes]:
    """Maximal runs of ASCII letters and digits and all other characters beyond ASCII;
    only A-Z are lower-cased. (UTF-8 has no byte below 128 in characters beyond ASCII.)"""
    return text.translate(_FOLDED).split()


def impact(tf, n, number: int, total: int):
    """A term's coordinate in a document of ``n`` terms; of ``number`` documents with ``total`` terms."""
    m = 50 + (50 * n * number) // total
    return (1_000_000_000 * tf) // (1_000 * tf + 20 * m)


def weight(df: Column, number: int) -> Column:
    ratio = F.lit(float(2 * number + 2)) / (2 * df + 1).cast("double")
    return F.floor(F.lit(1000.0) * F.log(ratio)).cast("long")


def item_terms(items: DataFrame) -> DataFrame:
    """(item_id, term), each once; rows of one item_id are one item."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs = [(item, term) for item, text in zip(batch.column(0).to_pylist(), payloads(batch.column(1))) for term in set(terms(text))]
            ids, found = zip(*pairs) if pairs else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(found, pa.binary()).cast(pa.string())], names=["item_id", "term"])

    chosen = items.select(F.col("item_id").cast("long"), F.col("text").cast("string"))
    return chosen.mapInArrow(run, "item_id long, term string").distinct()


def _bitmap(vocabulary: DataFrame) -> np.ndarray:
    """A bit for the hash of each term; of the same size for any number of terms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            places = [(xxhash.xxh64_intdigest(t) >> (64 - BITMAP_BITS)) + 1 for t in payloads(batch.column(0))]
            yield pa.RecordBatch.from_arrays([pa.array(places, pa.int64())], names=["place"])

    places = vocabulary.select("term").mapInArrow(run, "place long")
    parts = places.groupBy(F.bitmap_bucket_number("place").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("place")).alias("bits"))
    bits = np.zeros((1 << BITMAP_BITS) // 8, dtype=np.uint8)
    for row in parts.collect():  # at most 512 rows of 4 kB
        start = (row.bucket - 1) * _BUCKET // 8
        bits[start : start + _BUCKET // 8] = np.frombuffer(row.bits, dtype=np.uint8)
    return bits


_COUNTED = "doc_id long, n long, like1 long, like2 long, terms array<string>, tfs array<long>"


def _counted(docs: DataFrame, bits: np.ndarray) -> DataFrame:
    """Each row with its number of terms, those of its terms that may be an item's with
    their occurrences, and two numbers that are equal in like documents."""
    shared = docs.sparkSession.sparkContext.broadcast(bits.tobytes())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, known = shared.value, {}
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.binary()), pa.list_(pa.int64()))
        for batch in batches:
            out = []
            for text in payloads(batch.column(1)):
                found = terms(text)
                kept, tfs, hashes = [], [], []
                for term, tf in Counter(found).items():
                    place = known.get(term)
                    if place is None:
                        place = xxhash.xxh64_intdigest(term)
                        at = place >> (64 - BITMAP_BITS)
                        place = place >> 1 if bits[at >> 3] >> (at & 7) & 1 else -1
                        if len(known) >= _REMEMBERED:
                            known.clear()
                        known[term] = place
                    if place >= 0:
                        kept.append(term)
                        tfs.append(tf)
                        hashes.append(place)
                hashes.sort()
                like = (hashes + [-1, -1])[:2]
                out.append((len(found), *like, kept, tfs))
            columns = list(zip(*out)) or [()] * 5
            arrays = [pa.array(c, t) for c, t in zip(columns, kinds)]
            arrays[3] = arrays[3].cast(pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([batch.column(0), *arrays], names=[c.split()[0] for c in _COUNTED.split(", ")])

    chosen = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return chosen.mapInArrow(run, _COUNTED)


def _starts(sizes: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(sizes)])


class _Postings:
    """Coordinates by rows (documents, batches, runs), as (row, term, value) in order of rows."""

    def __init__(self, row: np.ndarray, term: np.ndarray, value: np.ndarray, rows: int):
        self.row, self.term, self.value, self.rows = row, term, value, rows
        self.starts = np.searchsorted(row, np.arange(rows + 1))

    def above(self, size: int, width: int) -> _Postings:
        """The maxima of every ``size`` rows."""
        node = self.row // size
        key = node * width + self.term
        order = np.argsort(key, kind="stable")
        key = key[order]
        first = np.flatnonzero(np.diff(key, prepend=-1))
        values = np.maximum.reduceat(self.value[order], first) if len(first) else self.value[:0]
        return _Postings(key[first] // width, key[first] % width, values, -(-self.rows // size))

    def scores(self, weights: np.ndarray, start: int = 0, end: int | None = None) -> np.ndarray:
        """Inner products of the rows from start to end with a vector of weights."""
        end = self.rows if end is None else end
        low, high = self.starts[start], self.starts[end]
        sums = _starts(weights[self.term[low:high]] * self.value[low:high])
        return np.diff(sums[self.starts[start : end + 1] - low])


class _Best:
    """One item's k best documents so far, and the score that another one has to reach.
    Of those that reach just the floor, only the first ``ties`` by doc_id are wanted."""

    def __init__(self, k: int, floor: int, ties: int):
        self.k, self.least, self.floor, self.ties = k, max(floor, 1), floor, ties
        self.scores, self.places = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def offer(self, scores: np.ndarray, places: np.ndarray) -> None:
        good = (scores >= self.least) & ((scores > self.floor) | (places < self.ties))
        if good.any():
            scores, places = np.concatenate([self.scores, scores[good]]), np.concatenate([self.places, places[good]])
            order = np.lexsort((places, -scores))[: self.k]
            self.scores, self.places = scores[order], places[order]
            if len(order) == self.k:
                self.least = max(self.least, int(self.scores[-1]))


def _dual(docs: _Postings, place: np.ndarray, width: int, items: list[np.ndarray], best: list[_Best]) -> None:
    """Offer each item all documents that can be among its best. ``place``: the documents'
    order among equal scores; ``items``: dense weights."""
    batches = docs.above(BATCH, width)
    runs = batches.above(RUN, width)
    for first in range(0, len(items), ITEM_NODE):
        group = range(first, min(first + ITEM_NODE, len(items)))
        bounds = runs.scores(np.maximum.reduce([items[i] for i in group]))
        for run in np.argsort(-bounds, kind="stable"):
            if bounds[run] < min(best[i].least for i in group):
                break  # runs come by falling bounds
            start, end = run * RUN, min((run + 1) * RUN, batches.rows)
            for i in group:
                if runs.scores(items[i], run, run + 1)[0] < best[i].least:
                    continue
                inner = batches.scores(items[i], start, end)
                for at in np.argsort(-inner, kind="stable"):
                    if inner[at] < best[i].least:
                        break
                    low = (start + at) * BATCH
                    high = min(low + BATCH, docs.rows)
                    best[i].offer(docs.scores(items[i], low, high), place[low:high])


def _searched(docs: pa.Table, items: pa.Table, k: int, number: int, total: int) -> pa.Table:
    """(item_id, doc_id, score): of one shard all documents that can be among an item's best."""
    out = {"item_id": [], "doc_id": [], "score": []}
    if docs.num_rows and items.num_rows:
        held = items.column("terms").combine_chunks()
        coded = held.flatten().dictionary_encode()
        words, codes, values = coded.dictionary, coded.indices.to_numpy(), items.column("weights").combine_chunks().flatten().to_numpy()
        starts = _starts(pc.list_value_length(held).to_numpy())
        spans = [slice(a, b) for a, b in zip(starts, starts[1:])]
        # like items side by side: by their heaviest term
        order = sorted(range(len(spans)), key=lambda i: max(zip(values[spans[i]], codes[spans[i]]))[::-1])
        dense = np.zeros((len(order), len(words)), np.int64)
        for i, item in enumerate(order):
            dense[i, codes[spans[item]]] = values[spans[item]]
        docs = docs.sort_by("doc_id")  # null last
        doc_ids = docs.column("doc_id").to_pylist()
        known = docs.column("doc_id").drop_null().to_numpy()
        # a null id comes last, so before it all ties count
        ties = [len(doc_ids) if last is None else int(np.searchsorted(known, last)) for last in items.column("last").to_pylist()]
        floors = items.column("floor").to_pylist()
        best = [_Best(k, floors[item], ties[item]) for item in order]

        place = np.lexsort((docs.column("like2").to_numpy(), docs.column("like1").to_numpy()))
        docs = docs.take(place)
        held = docs.column("terms").combine_chunks()
        term = pc.index_in(held.flatten(), value_set=words).fill_null(-1).to_numpy().astype(np.int64)
        row = np.repeat(np.arange(len(held)), pc.list_value_length(held).to_numpy())
        tf = docs.column("tfs").combine_chunks().flatten().to_numpy()
        mine = term >= 0
        values = impact(tf[mine], docs.column("n").to_numpy()[row[mine]], number, total)
        _dual(_Postings(row[mine], term[mine], values, docs.num_rows), place, len(words), list(dense), best)
        item_ids = items.column("item_id").to_pylist()
        for item, found in zip(order, best):
            out["item_id"] += [item_ids[item]] * len(found.scores)
            out["doc_id"] += [doc_ids[p] for p in found.places]
            out["score"] += found.scores.tolist()
    return pa.table({c: pa.array(v, pa.int64()) for c, v in out.items()})


def search(
    docs: DataFrame, items: DataFrame, k: int = K, shard_rows: int = SHARD_ROWS, shard_terms: int = SHARD_TERMS,
    block_items: int = BLOCK_ITEMS, block_terms: int = BLOCK_TERMS,
) -> DataFrame:
    """(item_id, rank, doc_id, score): for each item its ``k`` documents of highest score
    above 0, equal scores by ascending doc_id (null last). Exact.

    ``docs`` has doc_id and text, ``items`` item_id and text; other columns are ignored.
    Every row of ``docs`` is a document, repeated rows and null ids too; rows of one
    item_id, null too, are one item with the terms of all its texts. Texts count whole.
    Null, empty and wordless texts have no terms: as documents they are not counted, as
    items they find nothing. Empty tables give an empty result.
    """
    spark = docs.sparkSession
    wanted = written(item_terms(items), "item_terms")
    numbered = _counted(docs, _bitmap(wanted.select("term").distinct())).withColumn("row", F.monotonically_increasing_id())
    counted = written(numbered, "counted")
    number, total, rows, places = counted.agg(
        F.count_if(F.col("n") > 0), F.sum("n"), F.count_if(F.size("terms") > 0), F.sum(F.size("terms"))
    ).first()
    if not rows:
        return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")

    # upper nodes of the document tree; the row number splits what is alike in all else
    shards = max(-(-rows // shard_rows), -(-places // shard_terms))
    placed = counted.where(F.size("terms") > 0).repartitionByRange(shards, "like1", "like2", "row").withColumn("shard", F.spark_partition_id())
    shard = written(placed.select("shard", "doc_id", "n", "like1", "like2", "terms", "tfs"), "shards")
    posting = shard.select("shard", "n", F.explode(F.arrays_zip("terms", "tfs")).alias("p")).select("shard", "n", "p.terms", "p.tfs")
    value = F.expr(f"(1000000000L * tfs) div (1000L * tfs + 20L * (50L + (50L * n * {number}L) div {total}L))")
    nodes = written(posting.groupBy("shard", F.col("terms").alias("term")).agg(F.max(value).alias("most"), F.count("*").alias("docs")), "nodes")

    df = nodes.groupBy("term").agg(F.sum("docs").alias("df"))
    weighted = written(wanted.join(df, "term").select("item_id", "term", weight(F.col("df"), number).alias("weight")).where("weight > 0"), "weights")
    entries, different = weighted.agg(F.count("*"), F.count_distinct(F.struct("item_id"))).first()
    blocks = max(1, -(-different // block_items), -(-entries // block_terms))
    block = F.pmod(F.xxhash64("item_id"), F.lit(blocks)).cast("int").alias("block")
    pairs = weighted.groupBy(block, "item_id").agg(F.collect_list(F.struct("term", "weight")).alias("found"))  # one item's terms
    item = written(pairs.select("block", "item_id", F.col("found.term").alias("terms"), F.col("found.weight").alias("weights")), "items")

    upper = weighted.groupBy(block, "term").agg(F.max("weight").alias("weight"))
    bound = F.sum(F.col("weight") * F.col("most")).alias("bound")
    bounds = written(nodes.join(upper, "term").groupBy("block", "shard").agg(bound), "bounds")

    def searched(pairs: DataFrame, floors: DataFrame) -> DataFrame:
        """The pairs of a block and a shard, each in a task of its own."""
        pairs = pairs.select("block", "shard")
        asked = floors.join(pairs, "block").groupBy("block", "shard")
        stored = shard.join(pairs, "shard").groupBy("block", "shard")
        return stored.cogroup(asked).applyInArrow(lambda d, i: _searched(d, i, k, number, total), "item_id long, doc_id long, score long")

    largest = Window.partitionBy("block").orderBy(F.desc("bound"), "shard")
    seeds = bounds.withColumn("place", F.row_number().over(largest)).where(F.col("place") <= SEED_SHARDS)
    first = written(searched(seeds, item.withColumns({"floor": F.lit(0).cast("long"), "last": F.lit(None).cast("long")})), "seeds")
    order = Window.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    ranked = first.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)
    kth = ranked.groupBy("item_id").agg(
        F.min("score").alias("kth"), F.max_by("doc_id", "place").alias("last"), F.count("*").alias("n")
    ).where(F.col("n") >= k)
    same = item["item_id"].eqNullSafe(kth["item_id"])
    floors = written(item.join(kth, same, "left").select(*[item[c] for c in item.columns], F.coalesce("kth", F.lit(0).cast("long")).alias("floor"), "last"), "floors")

    weakest = floors.groupBy("block").agg(F.min("floor").alias("weakest"))
    rest = bounds.join(seeds.select("block", "shard"), ["block", "shard"], "left_anti").join(weakest, "block").where("bound >= weakest")
    found = first.unionByName(searched(rest, floors)).withColumn("rank", F.row_number().over(order))
    return found.where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")


TERM_SQL = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def search_sql(k: int = K) -> str:
    """DuckDB SQL of ``search`` over documents and benchmark with different ids."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    found = f"regexp_extract_all(translate(text, '{upper}', '{lower}'), '{TERM_SQL}')"
    return f"""
WITH counted AS (
  SELECT doc_id, {found} AS t FROM documents
), sizes AS (
  SELECT count(*) FILTER (len(t) > 0) AS number, sum(len(t))::BIGINT AS total FROM counted
), postings AS (
  SELECT doc_id, n, term, count(*) AS tf FROM (SELECT doc_id, len(t) AS n, unnest(t) AS term FROM counted) GROUP BY ALL
), weights AS (
  SELECT term, CAST(floor(1000 * ln(CAST(2 * number + 2 AS DOUBLE) / (2 * count(*) + 1))) AS BIGINT) AS w FROM postings, sizes GROUP BY term, number
), items AS (
  SELECT DISTINCT item_id, unnest({found}) AS term FROM benchmark
), scores AS (
  SELECT item_id, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * number) // total)))) AS BIGINT) AS score
  FROM items JOIN weights USING (term) JOIN postings USING (term), sizes GROUP BY item_id, doc_id
), ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM scores WHERE score > 0
)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= {k}"""
