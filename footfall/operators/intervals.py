"""Interval algebra: merging of overlapping or adjacent ranges and point lookup.

Work is split by block, a coarse key derived from the lower bound (the /16 of an
IPv4 address, the first 32 bits of an IPv6 address). Blocks exchange only one
summary row each.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

Step = Callable[[Column], Column]


def v4_block(value: Column) -> Column:
    return F.shiftright(value, 16)


def v6_block(value: Column) -> Column:
    return F.substring(value, 1, 9)


def _carry(rows: DataFrame, value: Column, name: str) -> DataFrame:
    """Running maximum of ``value`` over all rows of earlier blocks and earlier
    rows of the own block (``name`` is NULL where there are none).

    Only one row per block meets the window over all blocks; for IPv4 that is at
    most 65,536 rows, and a block holds at most 65,536 distinct lower bounds.
    """
    earlier = Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = (
        rows.groupBy("_block")
        .agg(F.max(value).alias("_block_max"))
        .select("_block", F.max("_block_max").over(earlier).alias("_before"))
    )
    within = (
        Window.partitionBy("_block").orderBy("lo").rowsBetween(Window.unboundedPreceding, -1)
    )
    return (
        rows.withColumn("_inside", F.max(value).over(within))
        .join(blocks, "_block")
        .withColumn(name, F.greatest("_inside", "_before"))
        .drop("_inside", "_before")
    )


def merge_intervals(ranges: DataFrame, *, block: Step, successor: Step) -> DataFrame:
    """Disjoint, non-adjacent ranges covering the same values as (lo, hi) rows."""
    rows = (
        ranges.filter(F.col("lo").isNotNull() & F.col("hi").isNotNull())
        .groupBy("lo")
        .agg(F.max("hi").alias("hi"))
        .withColumn("_block", block(F.col("lo")))
    )
    rows = _carry(rows, F.col("hi"), "_reach")
    gap = F.col("_reach").isNull() | (F.col("lo") > successor(F.col("_reach")))
    rows = rows.withColumn("_start", F.when(gap, F.col("lo")))
    # the island of a row is the last start at or before it
    rows = _carry(rows, F.col("_start"), "_earlier_start")
    island = F.coalesce("_start", "_earlier_start")
    return rows.groupBy(island.alias("lo")).agg(F.max("hi").alias("hi"))


def by_block(merged: DataFrame) -> DataFrame:
    """Merged IPv4 ranges with one row per block they touch. Disjoint ranges
    touch at most two blocks partly, so there are at most 65,536 rows more."""
    first, last = v4_block(F.col("lo")), v4_block(F.col("hi"))
    return merged.withColumn("block", F.explode(F.sequence(first, last)))
