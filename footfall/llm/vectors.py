"""Nearest vectors by inner product: multi-index hashing over learned rotated binary codes.

Codes: vectors are scaled into the unit ball and lifted onto the sphere (so that the
largest inner product is the smallest angle), rotated by iterative quantisation
learned on a sample, and cut to signs; several learned rotations give BITS bits.
Codes are split into 16-bit substrings, each indexed by its value. If two codes differ
in at most R bits, then by the pigeonhole principle one of the first (R mod m) + 1 of
the m substrings differs in at most R // m bits, or one of the others in at most
R // m - 1: probing all values that near finds every code within R. The found codes
are compared in full, and those within R ranked by the original vectors.

R is learned on the sample too: a distance that nearly all true neighbours of sampled
queries keep, at the depth that k neighbours have in the whole table. The queries
that find fewer than k are searched again without a radius, so each gets its k.

The table is cut into shards of bounded size by a hash of the id and the queries into
blocks, so a task holds one shard's index and one block of queries; partial results of
k rows are merged by a window.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from footfall.llm.common import written

BITS = 256
SAMPLE, SAMPLE_QUERIES = 4_096, 256
SHARD_ROWS, BLOCK_QUERIES = 16_384, 4_096
KEPT = 0.98  # share of the sample's true neighbours within the radius


@dataclass(frozen=True)
class Codes:
    """What turns vectors into codes, and the radius to search."""

    rotations: np.ndarray  # (dimensions + 1, bits)
    scale: float
    radius: int

    def of_rows(self, vectors: np.ndarray) -> np.ndarray:
        inside = vectors / self.scale
        rest = np.sqrt(np.maximum(0.0, 1 - np.einsum("ij,ij->i", inside, inside)))
        return _signs(np.column_stack([inside, rest]) @ self.rotations)

    def of_queries(self, vectors: np.ndarray) -> np.ndarray:
        unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
        return _signs(np.column_stack([unit, np.zeros(len(unit))]) @ self.rotations)


def _signs(projected: np.ndarray) -> np.ndarray:
    return np.packbits(projected > 0, axis=1, bitorder="little").view("<u8")


def _rotation(lifted: np.ndarray, rng: np.random.Generator, rounds: int = 30) -> np.ndarray:
    """Iterative quantisation: the rotation that brings the sample nearest to its signs."""
    rotation = np.linalg.qr(rng.normal(size=(lifted.shape[1],) * 2))[0]
    for _ in range(rounds):
        signs = np.sign(lifted @ rotation)
        left, _, right = np.linalg.svd(lifted.T @ signs)
        rotation = left @ right
    return rotation


def learn(sample: np.ndarray, scale: float, rows: int, k: int, bits: int = BITS, kept: float = KEPT, seed: int = 0) -> Codes:
    """Rotations and radius from a sample of a table of ``rows`` vectors."""
    rng = np.random.default_rng(seed)
    inside = sample / scale
    lifted = np.column_stack([inside, np.sqrt(np.maximum(0.0, 1 - (inside**2).sum(axis=1)))])
    width = lifted.shape[1]
    rotations = np.column_stack([_rotation(lifted, rng) for _ in range(-(-bits // width))])[:, :bits]
    codes = Codes(rotations, scale, bits)
    asked = rng.permutation(len(sample))[:SAMPLE_QUERIES]
    depth = min(max(1, round(k * len(sample) / max(rows, 1))), len(sample) - 1)
    if depth < 1:
        return codes
    near = sample[asked] @ sample.T
    near[np.arange(len(asked)), asked] = -np.inf
    true = np.argpartition(-near, depth - 1, axis=1)[:, :depth]
    apart = _distances(codes.of_queries(sample[asked])[:, None], codes.of_rows(sample)[true])
    return Codes(rotations, scale, int(np.quantile(apart, kept, method="higher")))


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b).sum(axis=-1, dtype=np.int64)


_POPULATION = np.bitwise_count(np.arange(1 << 16, dtype=np.uint16))
_BY_POPULATION = np.argsort(_POPULATION, kind="stable").astype(np.uint16)
_WITHIN = np.searchsorted(_POPULATION[_BY_POPULATION], np.arange(17), side="right")


class Index:
    """Rows of codes, indexed by each 16-bit substring: the values that occur, in order,
    the rows of each, and each row's place among the values."""

    def __init__(self, codes: np.ndarray):
        self.codes = codes
        self.buckets = []
        for part in codes.view("<u2").T:
            order = np.argsort(part, kind="stable").astype(np.int32)
            values, places, sizes = np.unique(part, return_inverse=True, return_counts=True)
            self.buckets.append((values, np.concatenate([[0], np.cumsum(sizes)]), order, places.astype(np.int32)))

    def within(self, code: np.ndarray, radius: int) -> np.ndarray:
        """Positions of all codes within the radius, found by probing. Values near the
        query's are listed and looked up, or, if fewer values occur than are near,
        picked among those that occur."""
        found = np.zeros(len(self.codes), dtype=bool)
        pieces = code.view("<u2")
        for j, piece in enumerate(pieces):
            near = min(radius // len(pieces) - (j > radius % len(pieces)), 16)
            if near < 0:
                break
            values, ends, order, places = self.buckets[j]
            if _WITHIN[near] < len(values) // 8:
                listed = piece ^ _BY_POPULATION[: _WITHIN[near]]
                at = np.minimum(np.searchsorted(values, listed), len(values) - 1)
                for bucket in at[values[at] == listed]:
                    found[order[ends[bucket] : ends[bucket + 1]]] = True
            else:
                found |= (_POPULATION[values ^ piece] <= near)[places]
        rows = np.flatnonzero(found)
        return rows[_distances(self.codes[rows], code) <= radius]


def _matrix(column: pd.Series) -> np.ndarray:
    return np.array(column.tolist(), dtype=np.float64)


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, vector) of the rows that take part: with an id, not null or empty,
    no null or non-finite component, not all zero, and of the most frequent length (of
    equally frequent ones the largest). Rows equal in both count once."""
    # floats stay floats, half as wide to move; all sums are of doubles
    kind = "array<float>" if dict(vectors.dtypes)["embedding"] == "array<float>" else "array<double>"
    doubles = vectors.select(F.col("vec_id").cast("long"), F.col("embedding").cast(kind).alias("vector"))
    fit = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    good = doubles.where(
        F.col("vec_id").isNotNull() & (F.size("vector") > 0) & F.forall("vector", fit) & F.exists("vector", lambda x: x != 0)
    )
    lengths = good.groupBy(F.size("vector").alias("size")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("size")).first()
    return good.where(F.size("vector") == (lengths["size"] if lengths else 0)).distinct()


def nearest(
    vectors: DataFrame, every: int = 20, k: int = 20, sample: int = SAMPLE, shard_rows: int = SHARD_ROWS, block: int = BLOCK_QUERIES
) -> DataFrame:
    """(query_id, rank, vec_id, score): for each vector whose vec_id is divisible by
    ``every``, the ``k`` with the largest inner product among those found, nearest first,
    ties to the smaller vec_id; all others of the table if there are fewer.

    Rows that can't be compared (see ``usable``) take no part, as query or candidate.
    A candidate with the query's own id is left out. Different vectors with one id are
    candidates of their own; as queries they are searched as one, each vec_id with its
    best score. Other columns are ignored; an empty table gives an empty result.
    """
    spark = vectors.sparkSession
    rows = written(usable(vectors), "vectors")
    number, scale = rows.agg(F.count("*"), F.max(F.sqrt(F.aggregate("vector", F.lit(0.0), lambda a, x: a + x.cast("double") * x)))).first()
    output = "query_id long, vec_id long, score double"
    if not number:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    share = min(1.0, sample / number)
    draw = F.pmod(F.xxhash64("vec_id", F.lit("sample")), F.lit(1 << 30)) < int(share * (1 << 30))
    drawn = rows.where(draw).orderBy("vec_id", "vector").limit(2 * sample).select("vector").toPandas()
    taught = _matrix(drawn["vector"]) if len(drawn) else _matrix(rows.limit(1).toPandas()["vector"])
    codes = learn(taught, float(scale) * (1 + 1e-12), number, k)
    shared = spark.sparkContext.broadcast(codes)

    queries = rows.where(F.pmod("vec_id", F.lit(every)) == 0)
    shards = -(-number // shard_rows)
    place = lambda salt, n: F.pmod(F.xxhash64("vec_id", F.lit(salt)), F.lit(n)).cast("int")
    spread = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))

    def searched(queries: DataFrame, radius: int) -> DataFrame:
        def search(asked: pd.DataFrame, stored: pd.DataFrame) -> pd.DataFrame:
            codes, out = shared.value, [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
            if len(asked) and len(stored):
                ids, matrix, wanted = stored["vec_id"].to_numpy(), _matrix(stored["vector"]), _matrix(asked["vector"])
                index = Index(codes.of_rows(matrix))
                for query, vector, code in zip(asked["vec_id"].to_numpy(), wanted, codes.of_queries(wanted)):
                    found = index.within(code, radius)
                    found = found[ids[found] != query]
                    scores = np.einsum("ij,j->i", matrix[found], vector)
                    best = np.lexsort((ids[found], -scores))
                    best = best[np.sort(np.unique(ids[found][best], return_index=True)[1])[:k]]
                    out.append((np.full(len(best), query), ids[found][best], scores[best]))
            return pd.DataFrame(dict(zip(("query_id", "vec_id", "score"), map(np.concatenate, zip(*out)))))

        blocks = max(1, -(-queries.count() // block))
        asked = queries.select("vec_id", "vector", place("block", blocks).alias("block"), spread(shards).alias("shard"))
        stored = rows.select("vec_id", "vector", place("shard", shards).alias("shard"), spread(blocks).alias("block"))
        found = asked.groupBy("shard", "block").cogroup(stored.groupBy("shard", "block")).applyInPandas(search, output)
        order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
        best = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score")).withColumn("rank", F.row_number().over(order))
        return best.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

    first = written(searched(queries, codes.radius), "nearest")
    full = first.groupBy("query_id").agg(F.count("*").alias("n")).where(F.col("n") >= min(k, number - 1))
    short = queries.join(full, F.col("vec_id") == F.col("query_id"), "left_anti")
    if short.isEmpty():
        return first
    short = written(short, "short")
    again = searched(short, 64 * -(-codes.rotations.shape[1] // 64))
    return first.join(short.select(F.col("vec_id").alias("query_id")).distinct(), "query_id", "left_anti").unionByName(again)
