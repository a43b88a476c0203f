"""Connected components of an undirected graph given by links, by alternating stars.

A round links every node's larger neighbours to its smallest one (large star), then
its smaller neighbours (small star), until each component is one star. Rounds are
logarithmic in practice; a hub costs one partial minimum per task, and the joins back
are split by Spark where a node has very many links.
"""

from __future__ import annotations

from itertools import count

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from footfall.llm.common import written_to
from footfall.session import shared_dir
from footfall.sources.tables import remove


def _with_least(links: DataFrame) -> DataFrame:
    """Links (a, b) with m, the smallest of a and all its b."""
    least = links.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a"), F.least("a", "m").alias("m"))
    return links.join(least, "a")


def _large_star(links: DataFrame) -> DataFrame:
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    return _with_least(both).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(links: DataFrame) -> DataFrame:
    down = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    stars = _with_least(down)
    return (
        stars.select("b", "m").unionByName(stars.select(F.col("a").alias("b"), "m"))
        .where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
    )


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of ``links`` (a, b: any ordered type); root is the
    smallest node of its component, and is itself listed. No links: no rows. Links
    with a null end and links from a node to itself are left out."""
    spark, path = links.sparkSession, shared_dir(links.sparkSession, "links")
    now = written_to(
        links.select("a", "b").where("a <> b")
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(),
        f"{path}/0",
    )
    for rounds in count(1):
        after = written_to(_small_star(_large_star(now)), f"{path}/{rounds}")
        same = after.exceptAll(now).isEmpty() and now.exceptAll(after).isEmpty()
        remove(spark, f"{path}/{rounds - 1}")
        now = after
        if same:
            break
    leaves = now.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return leaves.unionByName(leaves.select(F.col("root").alias("node"), "root").distinct())
