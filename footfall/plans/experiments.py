"""A/B experiment results and variant assignment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from footfall.functions.predicates import first_rows
from footfall.functions.statistics import NO_RESULT, ratio, z_test_label


def experiment_stats(
    experiments: DataFrame,
    variants: DataFrame,
    events: DataFrame,
    *,
    experiment_id: str | None = None,
) -> DataFrame:
    """Impressions, conversions, uplift and significance per variant.

    All experiments in one plan. Events shrink to one row per session and
    variant, with a flag for the experiment's metric, before they are counted.
    """
    if experiment_id is not None:
        chosen = experiments.filter(F.col("experiment_id") == experiment_id)
    else:
        chosen = experiments.filter(F.col("status").isin("active", "completed"))
    chosen = chosen.select(
        "experiment_id", F.col("name").alias("experiment_name"), "status", "metric_event_type"
    )
    sessions = (
        events.filter(F.col("experiment_id").isNotNull() & F.col("session_id").isNotNull())
        .join(chosen.select("experiment_id", "metric_event_type"), "experiment_id")
        .groupBy("experiment_id", "variant_id", "session_id")
        .agg(F.max(F.col("event_type") == F.col("metric_event_type")).alias("converted"))
    )
    counted = sessions.groupBy("experiment_id", "variant_id").agg(
        F.count("*").alias("impressions"), F.count_if("converted").alias("conversions")
    )
    rows = (
        chosen.join(variants.drop("config"), "experiment_id")
        .join(counted, ["experiment_id", "variant_id"], "left")
        .fillna(0, ["impressions", "conversions"])
        .withColumn("conversion_rate", ratio(F.col("conversions"), F.col("impressions")))
    )
    control = (
        rows.filter(F.col("is_control") == 1)
        .groupBy("experiment_id")
        .agg(
            F.min_by(
                F.struct("impressions", "conversions", "conversion_rate"), "variant_id"
            ).alias("control")
        )
    )
    judged = (F.col("is_control") == 0) & (F.col("control.impressions") > 0)
    uplift = (F.col("conversion_rate") - F.col("control.conversion_rate")) / F.nullif(
        F.col("control.conversion_rate"), F.lit(0.0)
    )
    verdict = z_test_label(
        F.col("control.conversions"),
        F.col("control.impressions"),
        F.col("conversions"),
        F.col("impressions"),
    )
    return (
        rows.join(control, "experiment_id", "left")
        .select(
            "experiment_id", "experiment_name", "status", "metric_event_type",
            "variant_id", "name", "weight", "is_control", "impressions", "conversions",
            "conversion_rate",
            F.when(judged, uplift).alias("relative_uplift"),
            F.when(judged, verdict).otherwise(NO_RESULT).alias("significance"),
        )
        .orderBy("experiment_id", F.desc("is_control"), "variant_id")
    )


def experiment_list(experiments: DataFrame, *, limit: int | None = None) -> DataFrame:
    """Newest first; all of them, or the newest ``limit``."""
    return first_rows(experiments.orderBy(F.desc("created_at"), "experiment_id"), limit)


def experiment_conversions(events: DataFrame, experiments: DataFrame) -> DataFrame:
    """Rows whose type is the experiment's metric, per experiment name and variant."""
    metric = experiments.select(
        "experiment_id", F.col("name").alias("experiment"), "metric_event_type"
    )
    return (
        events.filter(F.col("experiment_id").isNotNull())
        .join(metric, "experiment_id")
        .filter(F.col("event_type") == F.col("metric_event_type"))
        .groupBy("experiment", "variant_id")
        .agg(
            F.count("*").alias("conversions"),
            F.countDistinct("visitor_id").alias("unique_converters"),
        )
        .orderBy("experiment", "variant_id")
    )


def assign_variants(
    requests: DataFrame, experiments: DataFrame, variants: DataFrame
) -> DataFrame:
    """Stable weighted variant for each (visitor, experiment) asked for.

    A visitor takes part when its hash falls below the allocation percentage; a
    second hash modulo the total weight picks the variant whose cumulative
    weight range contains it. The ranges of one experiment are one array, so a
    request meets one dimension row, not one per variant.
    """
    span = Window.partitionBy("experiment_id").orderBy("variant_id")
    ranges = (
        variants.withColumn("upto", F.sum("weight").over(span))
        .groupBy("experiment_id")
        .agg(
            F.sort_array(F.collect_list(F.struct("upto", "variant_id"))).alias("ranges"),
            F.sum("weight").alias("total"),
        )
    )
    live = (
        experiments.filter(F.col("status") == "active")
        .select("experiment_id", "allocation_percent")
        .join(ranges, "experiment_id")
    )

    def hashed(purpose: str) -> Column:
        text = F.concat_ws("|", F.lit(purpose), "experiment_id", "visitor_id")
        return F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("bigint")

    return (
        requests.select("visitor_id", "experiment_id")
        .distinct()
        .join(live, "experiment_id")
        .filter(hashed("gate") % 100 < F.col("allocation_percent"))
        .withColumn("slot", hashed("variant") % F.col("total"))
        .select(
            "visitor_id",
            "experiment_id",
            F.expr("element_at(filter(ranges, r -> slot < r.upto), 1).variant_id").alias(
                "variant_id"
            ),
        )
    )
