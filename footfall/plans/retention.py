"""Retention: keep-filters per table and the counts of what they drop."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from footfall.functions.predicates import at, days_back, is_bot, is_clean, within
from footfall.session import shared_dir
from footfall.sources.folders import read_facts
from footfall.sources.tables import overwrite_partitions, remove

ROLLUP_DAYS = 730


def _old(ts: str, as_of: datetime | None, days: int) -> Column:
    return F.col(ts) < at(days_back(as_of, days))


def _machine() -> Column:
    """Bot rows and API rows (negative score) share one retention period."""
    return is_bot() | (F.col("bot_score") < 0)


def expired_clean(as_of: datetime | None, days: int) -> Column:
    return F.coalesce(_old("created_at", as_of, days) & is_clean(), F.lit(False))


def expired_machine(as_of: datetime | None, days: int) -> Column:
    return F.coalesce(_old("created_at", as_of, days) & _machine(), F.lit(False))


def expired_daily(as_of: datetime | None) -> Column:
    return F.coalesce(F.col("date") < F.lit(days_back(as_of, ROLLUP_DAYS)), F.lit(False))


def expired_metrics(as_of: datetime | None, days: int) -> Column:
    return F.coalesce(_old("recorded_at", as_of, days), F.lit(False))


def retained(
    tables: dict[str, DataFrame],
    *,
    as_of: datetime | None = None,
    days: int = 90,
    bot_days: int | None = None,
) -> dict[str, DataFrame]:
    """The tables without their expired rows."""
    bot_days = days if bot_days is None else bot_days
    facts = ~(expired_clean(as_of, days) | expired_machine(as_of, bot_days))
    keep = {
        "visitor_views": facts,
        "semantic_events": facts,
        "visitor_views_daily": ~expired_daily(as_of),
        "perf_metrics": ~expired_metrics(as_of, days),
    }
    return {name: df.filter(keep[name]) if name in keep else df for name, df in tables.items()}


def purge_counts(
    tables: dict[str, DataFrame],
    *,
    as_of: datetime | None = None,
    days: int = 90,
    bot_days: int | None = None,
) -> DataFrame:
    """One row with the six numbers of rows that ``retained`` drops."""
    bot_days = days if bot_days is None else bot_days

    def counts(name: str, **conditions: Column) -> DataFrame:
        return tables[name].agg(*[F.count_if(c).alias(n) for n, c in conditions.items()])

    clean, machine = expired_clean(as_of, days), expired_machine(as_of, bot_days)
    parts = [
        counts("visitor_views", views_deleted=clean, bot_views_deleted=machine),
        counts("semantic_events", events_deleted=clean, bot_events_deleted=machine),
        counts("visitor_views_daily", daily_deleted=expired_daily(as_of)),
        counts("perf_metrics", perf_deleted=expired_metrics(as_of, days)),
    ]
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part, allowMissingColumns=True)
    names = (
        "views_deleted", "events_deleted", "bot_views_deleted", "bot_events_deleted",
        "daily_deleted", "perf_deleted",
    )
    return rows.agg(*[F.sum(n).alias(n) for n in names])


def purge_stored(
    spark: SparkSession,
    path: str,
    *,
    as_of: datetime | None = None,
    days: int = 90,
    bot_days: int | None = None,
) -> int:
    """Delete the expired rows of a fact table stored by site and day; their number.

    Only folders of days that can hold expired rows are read. A folder that keeps some
    rows is written again, through a staged copy; one that keeps none is removed.
    """
    bot_days = days if bot_days is None else bot_days
    facts = read_facts(spark, path)
    folders = [c for c in ("site_id", "event_date", "batch_id") if c in facts.columns]
    expired = expired_clean(as_of, days) | expired_machine(as_of, bot_days)
    old = within(facts, before=days_back(as_of, min(days, bot_days)))
    # one row a folder that has expired rows
    touched = (
        old.groupBy(*folders)
        .agg(F.count_if(expired).alias("gone"), F.count("*").alias("rows"))
        .filter("gone > 0").collect()
    )
    emptied = [r for r in touched if r["gone"] == r["rows"]]
    if len(emptied) < len(touched):
        thinned = spark.createDataFrame(
            [tuple(r[c] for c in folders) for r in touched if r["gone"] < r["rows"]],
            facts.select(*folders).schema,
        )
        stage = shared_dir(spark, "purge")
        old.filter(~expired).join(thinned, folders, "left_semi").write.parquet(stage)
        overwrite_partitions(spark.read.schema(facts.schema).parquet(stage), path, *folders)
        remove(spark, stage)
    for row in emptied:
        remove(spark, "/".join([path, *(f"{c}={row[c]}" for c in folders)]))
    return sum(r["gone"] for r in touched)
