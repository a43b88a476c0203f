"""Bloom filters as rows of a table: which groups may hold a value, without opening them.

A group's filter is cut into blocks of Spark's bitmap size, as many as its number of
different values asks for; a value sets PROBES bits of one block. So a filter is built
with partial aggregates, whatever the size of the group, and a look-up is an equi join
on the block's number.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLOCK_BITS = 1 << 15  # what bitmap_construct_agg holds
VALUE_BITS, PROBES = 24, 8  # a value that isn't there is taken as there once in 25,000 times
MOST_BLOCKS = 1 << 20
_PLACE = 15  # bits of a place in a block


def _hash(value: str) -> Column:
    return F.xxhash64(value)


def _places(hashed: Column) -> list[Column]:
    """The bits that a value sets, from two more hashes of it."""
    low = F.lit((1 << _PLACE) - 1).cast("long")
    return [
        F.shiftright(F.xxhash64(hashed, F.lit(salt)), _PLACE * k).bitwiseAND(low) for salt in range(PROBES // 4) for k in range(4)
    ]


def build_filters(rows: DataFrame, group: Sequence[str], value: str) -> DataFrame:
    """(group..., blocks, block, bits) of the values in each group. A group of nulls only
    has a filter that holds nothing. Different groups may be of any size: values are
    counted, and bits set, before rows of a group meet."""
    values = rows.select(*group, F.when(F.col(value).isNotNull(), _hash(value)).alias("_hash")).distinct()
    sizes = values.groupBy(*group).agg(F.count("_hash").alias("_n"))
    wanted = F.greatest(F.ceil(F.col("_n") * F.lit(VALUE_BITS) / F.lit(BLOCK_BITS)), F.lit(1))
    blocks = F.least(F.pow(F.lit(2), F.ceil(F.log2(wanted))), F.lit(MOST_BLOCKS)).cast("int")
    sized = sizes.select(*[F.col(c).alias(f"_{c}") for c in group], blocks.alias("blocks"))
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in group]
    block = F.coalesce(F.pmod("_hash", F.col("blocks")), F.lit(0)).cast("int").alias("block")
    bits = values.join(sized, same).select(*group, "blocks", block, F.explode(F.array(*_places(F.col("_hash")))).alias("_place"), "_hash")
    place = F.when(F.col("_hash").isNotNull(), F.col("_place"))
    return bits.groupBy(*group, "blocks", "block").agg(F.bitmap_construct_agg(place).alias("bits"))


def _set(bits: Column, place: Column) -> Column:
    byte = F.conv(F.hex(F.substring(bits, F.shiftright(place, 3).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return F.call_function("shiftright", byte, place.bitwiseAND(F.lit(7)).cast("int")).bitwiseAND(F.lit(1)) == 1


def may_hold(probes: DataFrame, filters: DataFrame, value: str, on: Sequence[str] = ()) -> DataFrame:
    """``probes`` with the other columns of ``filters``' groups that may hold their value;
    ``on`` names group columns that both have. No group that holds a value is missed."""
    group = [c for c in filters.columns if c not in ("blocks", "block", "bits", *on)]
    # a value asks as many questions as there are sizes of filters, at most 21
    sizes = sorted(r.blocks for r in filters.select("blocks").distinct().collect()) or [1]
    # each probe meets a filter of every group: many tests on few bytes, so the number of
    # tasks goes by cores, not by bytes
    spread = probes.where(F.col(value).isNotNull()).repartition(probes.sparkSession.sparkContext.defaultParallelism)
    asked = spread.withColumn("_hash", _hash(value)).withColumn("blocks", F.explode(F.array(*map(F.lit, sizes))))
    places = _places(F.col("_hash"))
    asked = asked.select("*", F.pmod("_hash", F.col("blocks")).cast("int").alias("block"), *[p.alias(f"_place{i}") for i, p in enumerate(places)])
    hit = F.lit(True)
    for i in range(len(places)):
        hit = hit & _set(F.col("bits"), F.col(f"_place{i}"))
    return asked.join(filters, [*on, "blocks", "block"]).where(hit).select(*probes.columns, *group)
