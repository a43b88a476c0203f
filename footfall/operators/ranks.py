"""Exact nearest-rank percentiles of a column, without gathering its values."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

_STEPS = 64  # classes to a factor of e; a double has some 45,000 of them


def nearest_ranks(rows: DataFrame, column: str, shares: Sequence[float]) -> DataFrame:
    """One row (p0, p1, ...): the value at rank ceil(share * n); NULL without values.

    Values are counted by class of size first, and each wanted rank lies in one class.
    Only the values of those classes are then counted one by one, so no task sees
    more than the different values of one class.
    """
    value = F.col(column)
    size = F.floor(F.ln(F.abs(value) + 1) * _STEPS)
    classed = rows.filter(value.isNotNull()).select(
        value.alias("_value"), F.when(value < 0, -1 - size).otherwise(size).alias("_class")
    )
    counts = classed.groupBy("_class").agg(F.count("*").alias("_n"))
    before = Window.orderBy("_class").rowsBetween(Window.unboundedPreceding, -1)
    wanted = F.array(
        *[F.struct(F.lit(i).alias("i"), F.ceil(F.lit(p) * F.col("_total")).alias("rank")) for i, p in enumerate(shares)]
    )
    places = (
        counts.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
        .withColumn("_total", F.sum("_n").over(Window.partitionBy()))
        .withColumn("_wanted", F.explode(wanted))
        .withColumn("_rank", F.greatest(F.col("_wanted.rank"), F.lit(1)) - F.col("_before"))
        .filter((F.col("_rank") >= 1) & (F.col("_rank") <= F.col("_n")))
        .select("_class", F.col("_wanted.i").alias("_i"), "_rank")
    )
    upto = Window.partitionBy("_class").orderBy("_value")
    values = (
        classed.join(places.select("_class").distinct(), "_class", "left_semi")
        .groupBy("_class", "_value").agg(F.count("*").alias("_n"))
        .withColumn("_upto", F.sum("_n").over(upto))
    )
    found = values.join(places, "_class").filter(
        (F.col("_upto") >= F.col("_rank")) & (F.col("_upto") - F.col("_n") < F.col("_rank"))
    )
    return found.agg(*[F.max(F.when(F.col("_i") == i, F.col("_value"))).alias(f"p{i}") for i in range(len(shares))])
