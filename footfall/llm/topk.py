"""Exact top-k search by a three-phase uniform threshold over local score lists.

A vector is cut into ``lists`` runs of components. The inner products of one run of a
query with the same run of every row are that query's local score list; a score is the
sum of its local scores, and no list knows the others.

1. Every list gives its best local scores. The rows they name are scored in full; the
   k-th best of them is a cutoff that the true k-th best score can't be below. (Local
   scores may be negative, so a sum with missing parts would be no safe cutoff.)
2. The cutoff goes to all lists. A row that reaches it in sum has at least one local
   score of a ``lists``-th part of it, so every list gives all its entries from that
   threshold on. Entries of a row are added up; what a list didn't give is below the
   threshold, so a row whose sum can't reach the k-th best complete sum is dropped.
3. The rows left with parts missing are scored in full.

Rows of equal vectors have equal scores, so vectors are searched once, whatever number
of rows hold them, and only the k + 1 smallest ids of each can be needed (one of them
may be the query's own). Fewer lists prune more, as the cutoff is shared out evenly;
more lists make narrower pieces.

The pieces are dealt to shards of bounded size and the queries to blocks, by hashes of
their numbers; a task holds one list of one shard and one block of queries.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from footfall.llm.common import written

LISTS, DEPTH = 2, 32
SHARD_ROWS, BLOCK_QUERIES = 16_384, 512
SALTS = 16
_ENTRIES = "query long, list int, row long, local long"


def scaled(column: str = "embedding", factor: int = 256) -> Column:
    """floor(factor * x) of every component, in doubles, as longs."""
    return F.transform(column, lambda x: F.floor(F.lit(float(factor)) * x.cast("double")))


def usable(column: str = "embedding") -> Column:
    """Neither null nor holding a null or non-finite component."""
    sound = F.forall(column, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    return F.col(column).isNotNull() & sound


def _matrix(pieces: pa.ChunkedArray) -> np.ndarray:
    flat = pieces.combine_chunks().flatten().to_numpy()
    return flat.reshape(len(pieces), len(flat) // max(len(pieces), 1))


def products(queries: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Integer inner products: by floats where these are exact, by integers beyond."""
    if not queries.size or not rows.size:
        return np.zeros((len(queries), len(rows)), np.int64)
    most = float(np.abs(queries.astype(np.float64)).max()) * float(np.abs(rows.astype(np.float64)).max())
    if most * queries.shape[1] < 2.0**52:
        return (queries.astype(np.float64) @ rows.astype(np.float64).T).astype(np.int64)
    return queries @ rows.T


def _best(local: np.ndarray, k: int) -> np.ndarray:
    """Places of each query's k best."""
    if local.shape[1] <= k:
        return np.broadcast_to(np.arange(local.shape[1]), local.shape)
    return np.argpartition(-local, k - 1, axis=1)[:, :k]


def _dealt(number: str, parts: int, salt: str) -> Column:
    return F.pmod(F.xxhash64(number, F.lit(salt)), F.lit(parts)).cast("int")


def _each(parts: int) -> Column:
    return F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))


def _pieces(number: str, vector: str, lists: int, *others: str) -> list[Column]:
    """Columns of a table with one row for each list: number, width, list, piece."""
    width = F.ceil(F.size(vector) / F.lit(lists)).cast("int")
    cut = F.transform(F.sequence(F.lit(0), F.lit(lists - 1)), lambda j: F.slice(vector, j * width + 1, width))
    return [F.col(number), F.size(vector).alias("width"), *[F.col(c) for c in others], F.posexplode(cut).alias("list", "piece")]


class _Lists:
    """The local score lists, as tables of pieces in shards and blocks."""

    def __init__(self, vectors: DataFrame, lists: int, shards: int, blocks: int):
        self.lists, self.shards, self.blocks = lists, shards, blocks
        stored = vectors.select(*_pieces("row", "vector", lists))
        self.stored = stored.select("*", _dealt("row", shards, "shard").alias("shard"), _each(blocks).alias("block"))

    def entries(self, queries: DataFrame, take, *others: str) -> DataFrame:
        """What ``take`` chooses (places of queries and rows) from local scores (block of queries by shard)."""
        keys = ["width", "list", "shard", "block"]

        def local(asked: pa.Table, stored: pa.Table) -> pa.Table:
            out = {"query": np.zeros(0, np.int64), "list": np.zeros(0, np.int32), "row": np.zeros(0, np.int64), "local": np.zeros(0, np.int64)}
            if asked.num_rows and stored.num_rows:
                scores = products(_matrix(asked.column("piece")), _matrix(stored.column("piece")))
                at, place = take(scores, *(asked.column(c).to_numpy() for c in others))
                which = np.full(len(at), asked.column("list")[0].as_py(), np.int32)
                out = {"query": asked.column("row").to_numpy()[at], "list": which, "row": stored.column("row").to_numpy()[place], "local": scores[at, place]}
            return pa.table(out)

        asked = queries.select(*_pieces("row", "vector", self.lists, *others))
        asked = asked.select("*", _dealt("row", self.blocks, "block").alias("block"), _each(self.shards).alias("shard"))
        return asked.groupBy(*keys).cogroup(self.stored.groupBy(*keys)).applyInArrow(local, _ENTRIES)


def _in_full(pairs: DataFrame, vectors: DataFrame) -> DataFrame:
    """(query, row, score) for pairs of vectors."""
    stored = vectors.select("row", "vector")
    asked = vectors.select(F.col("row").alias("query"), F.col("vector").alias("wanted"))
    product = F.zip_with("vector", "wanted", lambda a, b: a * b)
    return pairs.join(stored, "row").join(asked, "query").select(
        "query", "row", F.aggregate(product, F.lit(0).cast("long"), lambda a, x: a + x).alias("score")
    )


def _kth(scores: DataFrame, k: int) -> DataFrame:
    """(query, cutoff): the k-th best score, for queries that have so many."""
    best = Window.partitionBy("query").orderBy(F.desc("score"), "row")
    ranked = scores.withColumn("place", F.row_number().over(best)).where(F.col("place") <= k)
    return ranked.groupBy("query").agg(F.min("score").alias("cutoff"), F.count("*").alias("n")).where(F.col("n") >= k).drop("n")


def top_k(
    vectors: DataFrame, every: int = 50, k: int = 5, factor: int = 256, lists: int = LISTS, depth: int = DEPTH,
    shard_rows: int = SHARD_ROWS, block: int = BLOCK_QUERIES,
) -> DataFrame:
    """(query_id, rank, vec_id, score): for each vector whose vec_id is divisible by
    ``every`` the k rows with the highest integer inner product of the scaled vectors,
    ties to the smaller vec_id; all other rows if there are fewer. Exact.

    ``vectors`` has vec_id and embedding; other columns are ignored. Rows without an id
    and vectors that are null or hold a null or non-finite component take no part.
    Rows equal in both count once. Different vectors under one id are rows of their own:
    each is a query with its own ranks and a candidate for the others. Vectors are
    compared with those of their own length; empty ones score zero. Products and sums
    must fit a long; beyond it an overflow is raised. An empty table gives an empty result.
    """
    spark = vectors.sparkSession
    output = "query_id long, rank int, vec_id long, score long"
    rows = vectors.where(usable() & F.col("vec_id").isNotNull()).select(F.col("vec_id").cast("long").alias("vec_id"), scaled(factor=factor).alias("vector"))
    rows = written(rows.distinct(), "scaled")
    wanted = F.pmod("vec_id", F.lit(every)) == 0
    inside = Window.partitionBy("vector").orderBy("vec_id")
    fewest = rows.withColumn("place", F.row_number().over(inside)).where(F.col("place") <= k + 1)
    ids = fewest.groupBy("vector").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))  # k + 1 at most
    asked = rows.where(wanted).select("vector").distinct().withColumn("asked", F.lit(True))
    # a vector's number is that of its row in a written table
    classes = written(ids.join(asked, "vector", "left").withColumn("row", F.monotonically_increasing_id()), "classes")
    number, queries = classes.count(), classes.where("asked")
    if not number:
        return spark.createDataFrame([], output)
    need = k + 1
    searched = _Lists(classes, lists, -(-number // shard_rows), max(1, -(-queries.count() // block)))

    # 1: the best of every list, and what they come to
    reach = max(need, depth)

    def best(scores: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        places = _best(scores, reach)
        return np.repeat(np.arange(len(scores)), places.shape[1]), places.ravel()

    tops = Window.partitionBy("query", "list").orderBy(F.desc("local"), "row")
    gathered = searched.entries(queries, best).withColumn("place", F.row_number().over(tops)).where(F.col("place") <= reach)
    first = written(_in_full(gathered.select("query", "row").distinct(), classes), "first")
    cutoffs = _kth(first, need)

    # 2: all entries that a row reaching the cutoff may have
    low = F.lit(-(1 << 62)).cast("long")
    share = F.coalesce(F.expr(f"cutoff div {lists}") - 1, low)  # div rounds towards zero
    limited = queries.join(cutoffs, queries["row"] == cutoffs["query"], "left").select("row", "vector", share.alias("share"))
    limited = written(limited, "limited")

    def enough(scores: np.ndarray, share: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return np.nonzero(scores >= share[:, None])

    given = searched.entries(limited, enough, "share")
    sums = written(given.groupBy("query", "row").agg(F.sum("local").alias("partial"), F.count("*").cast("int").alias("known")), "sums")
    whole = sums.where(F.col("known") == lists).select("query", "row", F.col("partial").alias("score"))
    bounds = limited.select(F.col("row").alias("query"), "share").join(_kth(whole, need), "query", "left")
    missing = (F.lit(lists) - F.col("known")) * (F.col("share") - 1)
    open_ = sums.where(F.col("known") < lists).join(bounds, "query").where(
        F.col("cutoff").isNull() | (F.col("partial") + missing >= F.col("cutoff"))
    )

    # 3: what is still open, in full
    # only those of a query's best scores, ties included, meet their ids
    best_first = Window.partitionBy("query").orderBy(F.desc("score"))
    scores = whole.unionByName(_in_full(open_.select("query", "row"), classes)).withColumn("place", F.rank().over(best_first))
    found = scores.where(F.col("place") <= need).drop("place").join(classes.select("row", "ids"), "row").withColumn("least", F.element_at("ids", 1))
    order = Window.partitionBy("query").orderBy(F.desc("score"), "least", "row")
    lead = found.withColumn("place", F.row_number().over(order)).where(F.col("place") <= need)
    answer = lead.groupBy("query").agg(F.collect_list(F.struct("score", "row", "ids")).alias("lead"))  # k + 1 at most

    # back to the rows that ask: a vector of very many of them is met in salted parts
    answers = classes.select("vector", F.col("row").alias("query")).join(answer, "query").select("vector", "query", "lead", _each(SALTS).alias("salt"))
    asking = rows.where(wanted).select(F.col("vec_id").alias("query_id"), "vector", _dealt("vec_id", SALTS, "salt").alias("salt"))
    each = asking.join(answers, ["vector", "salt"]).select("query_id", "query", F.explode("lead").alias("lead"))
    listed = each.select("query_id", "query", F.explode("lead.ids").alias("vec_id"), "lead.row", "lead.score")
    others = listed.where("vec_id <> query_id or row <> query")
    last = Window.partitionBy("query_id", "query").orderBy(F.desc("score"), "vec_id", "row")
    ranked = others.withColumn("rank", F.row_number().over(last)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def top_k_sql(every: int, k: int, factor: int) -> str:
    """DuckDB SQL of ``top_k`` over a table ``embeddings`` with different ids."""
    return f"""
WITH scaled AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor({factor} * CAST(x AS DOUBLE))) AS v
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scores AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
  FROM scaled q JOIN scaled c ON q.vec_id % {every} = 0 AND q.vec_id <> c.vec_id AND len(q.v) = len(c.v)
), ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM scores
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= {k}"""
