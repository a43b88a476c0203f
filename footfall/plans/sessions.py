"""Rules of the browser session as jobs over navigation rows, and web vitals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from footfall.operators.windows import last_before

UTM = ("utm_campaign", "utm_source", "utm_medium", "utm_content", "utm_term")

# Upper bounds of good and of needs-improvement, per metric.
VITALS = {"LCP": (2500, 4000), "CLS": (0.1, 0.25), "INP": (200, 500)}
CLS_SCALE = 1000  # CLS is sent as an integer number of thousandths


def drop_repeats(
    navigations: DataFrame, *, session: str = "session_id", order: tuple[str, ...] = ("ts", "id")
) -> DataFrame:
    """Without navigations to the path the session is already on."""
    known = last_before(
        navigations, F.col("path"), "_previous", keys=[session], order=order, include_current=False
    )
    same = F.coalesce(F.col("path") == F.col("_previous"), F.lit(False))
    return known.filter(~same).drop("_previous")


def carry_campaign(
    navigations: DataFrame, *, session: str = "session_id", order: tuple[str, ...] = ("ts", "id")
) -> DataFrame:
    """A campaign holds, with all its parameters, until the session's next one."""
    present = [c for c in UTM if c in navigations.columns]
    own = F.when(F.nullif("utm_campaign", F.lit("")).isNotNull(), F.struct(*present))
    carried = last_before(
        navigations, own, "_utm", keys=[session], order=order, include_current=True
    )
    for name in present:
        carried = carried.withColumn(name, F.col("_utm")[name])
    return carried.drop("_utm")


def session_navigations(navigations: DataFrame) -> DataFrame:
    return carry_campaign(drop_repeats(navigations))


def vital_rating(metric: Column, value: Column) -> Column:
    rating = None
    for name, (good, fair) in VITALS.items():
        scale = CLS_SCALE if name == "CLS" else 1
        grade = (
            F.when(value <= good * scale, "good")
            .when(value <= fair * scale, "needs-improvement")
            .otherwise("poor")
        )
        rating = F.when(metric == name, grade) if rating is None else rating.when(metric == name, grade)
    return rating.otherwise("unknown")


def vital_ratings(events: DataFrame) -> DataFrame:
    """Number of web-vital events per metric and rating."""
    metric = F.get_json_object("data", "$.metric")
    value = F.get_json_object("data", "$.value").try_cast("double")
    return (
        events.filter(F.col("event_type") == "web_vital")
        .select(metric.alias("metric"), vital_rating(metric, value).alias("rating"))
        .groupBy("metric", "rating")
        .agg(F.count("*").alias("count"))
        .orderBy("metric", "rating")
    )
