"""Merkle manifest of a table: a persistent, path-copying hash tree.

The rows of a source are the leaves of its tree, in order; every FAN consecutive nodes
become one, level by level, and the sources' roots are the leaves of the tree above. A
row that was changed afterwards makes a version of the tree: only the nodes from its
leaf to the root are new, all others are shared with the tree as it was.

Trees are cut into aligned blocks of FAN ** LEVELS nodes, so that a block's nodes have
all their ancestors up to the block's top in it. A task climbs one block; the tops are
the nodes of the next blocks, until each source has one node and all sources have one.
Then the way back: a block gets the siblings along its top's path to the root, which are
FAN - 1 digests a level, and each version goes on from its copies within the block
through these upper levels. So no task holds a tree, or the versions of one: a block
has a bounded number of leaves whatever its source holds.

Places are found by one range partitioning; a source with a third of all rows is spread
over many partitions and blocks.
"""

from __future__ import annotations

from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from footfall.llm.common import written

FAN, LEVELS = 3, 8
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
_NODE = "tree long, pos long, n long, digest string"
_PATH = "path array<struct<before: string, after: string>>"
_IN_PARTITION = (1 << 33) - 1  # the part of monotonically_increasing_id that counts rows


def node(parts: str) -> str:
    return sha256(parts.encode()).hexdigest()


def leaf(*fields: Column) -> Column:
    """Digest of a row: each field as its UTF-8 length, a colon and its value; ``-`` for null."""
    one = lambda c: F.coalesce(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c), F.lit("-"))
    return F.sha2(F.concat(*(one(c.cast("string")) for c in fields)), 256)


def height(n: int) -> int:
    """Levels above ``n`` nodes until one remains."""
    levels = 0
    while n > 1:
        n, levels = -(-n // FAN), levels + 1
    return levels


def _numbered(rows: DataFrame, *order: str) -> DataFrame:
    """``rows`` with their number in this order, nulls first, and the partition they are in."""
    keys = [F.col(c).asc_nulls_first() for c in order]
    inside = F.monotonically_increasing_id().bitwiseAND(F.lit(_IN_PARTITION))
    placed = written(
        rows.repartitionByRange(*keys).sortWithinPartitions(*keys).select("*", F.spark_partition_id().alias("part"), inside.alias("at")), "placed"
    )
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = placed.groupBy("part").agg(F.count("*").alias("size"))
    starts = sizes.select("part", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("start"))
    # one row a partition of the range partitioning: bounded by spark.sql.shuffle.partitions
    return placed.join(F.broadcast(starts), "part").withColumn("number", F.col("start") + F.col("at")).drop("start", "at")


def _planted(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows (source, doc_id, leaf, altered, row) with their tree, place and tree size; and
    the number of each tree with its source."""
    numbered = _numbered(rows, "source", "doc_id", "leaf", "row")
    spans = numbered.groupBy("source").agg(F.min("number").alias("first"), F.count("*").alias("n"))
    trees = written(_numbered(spans, "source").withColumnRenamed("number", "tree").drop("part"), "trees")
    # a source's rows meet their tree partition by partition, not all at once
    here = numbered.select(F.col("source").alias("of"), F.col("part").alias("in_part")).distinct()
    spread = here.join(trees, F.col("of").eqNullSafe(trees["source"])).drop("source")
    same = numbered["source"].eqNullSafe(spread["of"]) & (numbered["part"] == spread["in_part"])
    planted = numbered.join(spread, same).withColumn("pos", F.col("number") - F.col("first"))
    return written(planted.select("tree", "pos", "n", "doc_id", "source", "leaf", "altered"), "leaves"), trees


def _levels(digests: list[str], n: int, most: int) -> list[list[str]]:
    """A block's nodes level by level, up to its top; ``n`` counts the nodes of the whole tree."""
    levels = [digests]
    for _ in range(min(most, height(n))):
        below = levels[-1]
        levels.append([node("".join(below[k : k + FAN])) for k in range(0, len(below), FAN)])
    return levels


def _climbed(nodes: DataFrame, most: int) -> DataFrame:
    """The tops of all blocks, as nodes of the next blocks."""

    def climb(table: pa.Table) -> pa.Table:
        table = table.sort_by("pos")
        tree, pos, n = (table.column(c)[0].as_py() for c in ("tree", "pos", "n"))
        (top,) = _levels(table.column("digest").to_pylist(), n, most)[-1]
        return pa.table({"tree": [tree], "pos": [pos // FAN**most], "n": [-(-n // FAN**most)], "digest": [top]})

    return nodes.groupBy("tree", F.expr(f"pos div {FAN**most}").alias("block")).applyInArrow(climb, _NODE)


def _tower(nodes: DataFrame, most: int) -> list[DataFrame]:
    """Nodes, tops, tops of tops, ... until every tree has one."""
    tower = [nodes]
    while (tower[-1].agg(F.max("n")).first()[0] or 1) > 1:
        tower.append(written(_climbed(tower[-1], most), "nodes"))
    return tower


def _ways(levels: list[list[str]], at: int) -> list[dict[str, str]]:
    """The siblings of a block's node on each level up to the block's top."""
    out = []
    for level in levels[:-1]:
        start = at - at % FAN
        out.append({"before": "".join(level[start:at]), "after": "".join(level[at + 1 : start + FAN])})
        at //= FAN
    return out


def copies(digest: str, path: list[dict[str, str]]) -> list[str]:
    """The ancestors of a leaf, from its parent to the root, computed from its siblings."""
    out = []
    for step in path:
        digest = node(step["before"] + digest + step["after"])
        out.append(digest)
    return out


def _met(nodes: DataFrame, upper: DataFrame, most: int, run, schema: str) -> DataFrame:
    """``run`` on every block of nodes with the path of its top."""
    block = F.expr(f"pos div {FAN**most}").alias("block")
    return nodes.groupBy("tree", block).cogroup(upper.groupBy("tree", F.col("pos").alias("block"))).applyInArrow(run, schema)


def _descended(nodes: DataFrame, upper: DataFrame, most: int) -> DataFrame:
    """(tree, pos, path) of all nodes, from the paths of their blocks' tops."""
    schema = pa.schema([("tree", pa.int64()), ("pos", pa.int64()), ("path", pa.list_(pa.struct([("before", pa.string()), ("after", pa.string())])))])

    def descend(below: pa.Table, above: pa.Table) -> pa.Table:
        below = below.sort_by("pos")
        levels = _levels(below.column("digest").to_pylist(), below.column("n")[0].as_py(), most)
        rest = above.column("path")[0].as_py()
        paths = [_ways(levels, at) + rest for at in range(below.num_rows)]
        return pa.table([below.column("tree"), below.column("pos"), pa.array(paths, schema.field("path").type)], schema=schema)

    return written(_met(nodes, upper, most, descend, f"tree long, pos long, {_PATH}"), "paths")


def checked(docs: DataFrame, now: Column, changed: Column, levels: int = LEVELS) -> DataFrame:
    """The manifest of ``docs`` (FIELDS) and the check of every row against it.

    ``now`` is the text as it is found where ``changed`` holds (null: it doesn't). Per row:
    doc_id, source, leaf, pos and n (place among the n leaves of its source), subroot,
    root, proof (the siblings' digests, level by level via subroot to root, left to right),
    copied (the version that a changed row makes: its new ancestors from the parent to
    the root; null for others), folded_root (root recomputed from the row as it is now
    and the siblings as they were), verified (it equals root).

    Leaves of a source ascend by doc_id, null first; rows of the same id by their leaf.
    Sources ascend bytewise, null first, which is a source of its own. Repeated rows are
    leaves of their own. Texts are hashed whole; empty ones differ from null. Other
    columns are ignored; an empty table gives an empty result.
    """
    fields = [F.col(c) for c in FIELDS]
    later = [now if c == "text" else F.col(c) for c in FIELDS]
    rows = docs.select(
        F.col("source").cast("string").alias("source"), F.col("doc_id").cast("long").alias("doc_id"), leaf(*fields).alias("leaf"),
        F.when(F.coalesce(changed, F.lit(False)), leaf(*later)).alias("altered"),
    )
    # numbers of a written table tell rows apart that are equal in all else
    planted, trees = _planted(written(rows.withColumn("row", F.monotonically_increasing_id()), "rows"))
    tower = _tower(planted.select("tree", "pos", "n", F.col("leaf").alias("digest")), levels)
    number = F.lit(trees.count()).cast("long")
    upper = _tower(tower[-1].select(F.lit(0).cast("long").alias("tree"), F.col("tree").alias("pos"), number.alias("n"), "digest"), levels)
    path = F.array().cast("array<struct<before: string, after: string>>").alias("path")
    paths = upper[-1].select("tree", "pos", path)
    for nodes in upper[-2::-1]:
        paths = _descended(nodes, paths, levels)
    paths = paths.select(F.col("pos").alias("tree"), F.lit(0).cast("long").alias("pos"), "path")
    for nodes in tower[-2:0:-1]:
        paths = _descended(nodes, paths, levels)
    output = (
        "doc_id long, source string, leaf string, pos long, n long, subroot string, root string, "
        "proof array<string>, copied array<string>, folded_root string, verified boolean"
    )
    types = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.list_(pa.string()), pa.list_(pa.string()), pa.string(), pa.bool_()]
    names = [column.split()[0] for column in output.split(", ")]

    def check(below: pa.Table, above: pa.Table) -> pa.Table:
        below = below.sort_by("pos")
        leaves, n = below.column("leaf").to_pylist(), below.column("n")[0].as_py()
        inner, rest, up, out = _levels(leaves, n, levels), above.column("path")[0].as_py(), height(n), []
        for at, (first, altered) in enumerate(zip(leaves, below.column("altered").to_pylist())):
            way = _ways(inner, at) + rest
            was = [first, *copies(first, way)]
            new = None if altered is None else copies(altered, way)
            folded = was[-1] if altered is None else [altered, *new][-1]
            siblings = [digest[k : k + 64] for step in way for digest in step.values() for k in range(0, len(digest), 64)]
            out.append((was[up], was[-1], siblings, new, folded, folded == was[-1]))
        columns = [below.column(c).combine_chunks() for c in names[:5]] + [pa.array(c, t) for c, t in zip(zip(*out), types[5:])]
        return pa.table(columns, names=names)

    return _met(planted, paths, levels, check, output)


def _nodes_sql(name: str, start: str) -> str:
    """All nodes of trees whose leaves (tree, pos, n, digest) ``start`` gives, by level."""
    return f"""{name} AS (
  SELECT tree, 0 AS lev, pos, n, digest FROM {start}
  UNION ALL
  SELECT tree, lev + 1, pos // {FAN}, (n + {FAN - 1}) // {FAN}, sha256(string_agg(digest, '' ORDER BY pos))
  FROM {name} WHERE n > 1 GROUP BY tree, lev, pos // {FAN}, n
)"""


def _folds_sql(name: str, start: str, nodes: str) -> str:
    """The way of each row (id, tree, pos, digest, proof) up its tree, level by level."""
    return f"""{name} AS (
  SELECT id, tree, 0 AS lev, pos, digest, proof FROM {start}
  UNION ALL
  SELECT f.id, f.tree, f.lev + 1, f.pos // {FAN}, sha256(string_agg(CASE WHEN s.pos = f.pos THEN f.digest ELSE s.digest END, '' ORDER BY s.pos)),
    f.proof || coalesce(string_agg(s.digest, '' ORDER BY s.pos) FILTER (s.pos <> f.pos), '')
  FROM {name} f JOIN {nodes} s ON s.tree = f.tree AND s.lev = f.lev AND s.pos // {FAN} = f.pos // {FAN} AND s.n > 1
  GROUP BY f.id, f.tree, f.lev, f.pos, f.digest, f.proof
)"""


def _field_sql(value: str) -> str:
    return f"coalesce(strlen({value}) || ':' || {value}, '-')"


def checked_sql(changed: str, now: str) -> str:
    """DuckDB SQL of the digest columns of ``checked``."""

    def leaf_sql(text: str) -> str:
        return f"sha256(concat({', '.join(_field_sql(f'CAST({c} AS VARCHAR)') for c in (*FIELDS[:-1], text))}))"

    return f"""
WITH RECURSIVE trees AS (
  SELECT source AS of, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS tree FROM (SELECT DISTINCT source FROM documents)
), leaves AS (
  SELECT row_number() OVER () AS id, doc_id, tree, {leaf_sql("text")} AS digest,
    CASE WHEN {changed} THEN {leaf_sql(now)} END AS altered
  FROM documents d JOIN trees t ON d.source IS NOT DISTINCT FROM t.of
), planted AS MATERIALIZED (
  SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, digest) - 1 AS pos, count(*) OVER (PARTITION BY tree) AS n FROM leaves
), {_nodes_sql("nodes", "planted")},
subroots AS (SELECT 0 AS tree, tree AS pos, (SELECT count(*) FROM trees) AS n, digest FROM nodes WHERE n = 1),
{_nodes_sql("upper_nodes", "subroots")},
starts AS (SELECT id, tree, pos, coalesce(altered, digest) AS digest, '' AS proof FROM planted),
{_folds_sql("folds", "starts", "nodes")},
upper_starts AS (SELECT id, 0 AS tree, tree AS pos, arg_max(digest, lev) AS digest, arg_max(proof, lev) AS proof FROM folds GROUP BY id, tree),
{_folds_sql("upper_folds", "upper_starts", "upper_nodes")},
folded AS (SELECT id, arg_max(digest, lev) AS folded_root, sha256(arg_max(proof, lev)) AS proof_sha256 FROM upper_folds GROUP BY id),
top AS (SELECT digest AS root FROM upper_nodes WHERE n = 1)
SELECT p.doc_id, p.digest AS leaf, s.digest AS subroot, root, proof_sha256, folded_root, folded_root = root AS verified
FROM planted p JOIN subroots s ON s.pos = p.tree JOIN folded USING (id) CROSS JOIN top"""
