"""Retroactive bot evidence: fingerprint clusters and views without any event."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from footfall.functions.predicates import ago, at, is_clean, now_utc, within
from footfall.sources.folders import FOLDER, folders_with, live_folders, read_folders
from footfall.sources.tables import overwrite_partitions, remove

# Cluster sizes, points, ages.
CLUSTER, TAINTED_CLUSTER, LARGE_CLUSTER = 6, 4, 8
NORMAL_POINTS, LARGE_POINTS, NO_EVENT_POINTS = 30, 50, 15
PRINT_SECONDS = 20 * 60
NO_EVENT_MIN_SECONDS, NO_EVENT_MAX_SECONDS = 5 * 60, 30 * 60


@dataclass(frozen=True)
class Sweep:
    views: DataFrame
    events: DataFrame
    confirmed: DataFrame  # ip_hash, kind, ts
    penalties: DataFrame  # site_id, visitor_id, penalty, _detail


def _unmarked(marker: str) -> Column:
    """The detail does not carry the marker yet."""
    return ~F.coalesce(F.col("bot_score_detail").contains(f'"{marker}"'), F.lit(False))


def _with_marker(marker: str, value: Column) -> Column:
    """The detail JSON with one member added."""
    member = F.concat(F.lit(f'"{marker}":'), value)
    old = F.rtrim(F.trim(F.coalesce("bot_score_detail", F.lit("{}"))))
    inner = F.regexp_extract(old, "(?s)^\\{(.*)\\}$", 1)
    return F.concat(F.lit("{"), F.concat_ws(",", F.nullif(inner, F.lit("")), member), F.lit("}"))


def _raised(points: Column) -> Column:
    return F.least(F.col("bot_score") + points, F.lit(100))


def penalise_no_events(
    views: DataFrame,
    events: DataFrame,
    *,
    as_of: datetime | None = None,
    min_seconds: int = NO_EVENT_MIN_SECONDS,
    max_seconds: int = NO_EVENT_MAX_SECONDS,
) -> DataFrame:
    """+15, once, for clean views of a recent age whose visitor has no event on
    the site. The event table is first reduced to the few visitors in question."""
    oldest, newest = ago(as_of, seconds=max_seconds), ago(as_of, seconds=min_seconds)
    recent = F.col("created_at").between(at(oldest), at(newest))
    judged = F.coalesce(recent & is_clean() & _unmarked("no_events"), F.lit(False))
    who = ["visitor_id", "site_id"]
    candidates = within(views.filter(judged), oldest)
    active = (
        events.select(*who)
        .join(candidates.select(*who).distinct(), who, "left_semi")
        .distinct()
        .withColumn("_active", F.lit(True))
    )
    quiet = F.col("_active").isNull()
    marked = (
        candidates.join(active, who, "left")
        .withColumn(
            "bot_score_detail",
            F.when(quiet, _with_marker("no_events", F.lit("true"))).otherwise(
                F.col("bot_score_detail")
            ),
        )
        .withColumn(
            "bot_score",
            F.when(quiet, _raised(F.lit(NO_EVENT_POINTS))).otherwise(F.col("bot_score")),
        )
        .select(*views.columns)
    )
    return views.filter(~judged).unionByName(marked)


def fingerprint_text() -> Column:
    fp = F.col("fingerprint")
    return F.concat_ws(
        "|",
        fp["os_name"],
        fp["browser_name"],
        fp["browser_version"],
        F.concat(
            fp["screen_width"].cast("string"), F.lit("x"), fp["screen_height"].cast("string")
        ),
        fp["country_code"],
        fp["accept_language"],
    )


def recent_prints(
    prints: DataFrame, *, as_of: datetime | None = None, seconds: int = PRINT_SECONDS
) -> DataFrame:
    start = at(ago(as_of, seconds=seconds))
    return prints.filter(F.col("ts") >= start).withColumn("fp", fingerprint_text())


def find_clusters(recent: DataFrame) -> DataFrame:
    """Site and fingerprint groups seen from enough addresses.

    Prints shrink to one row per group and address before addresses are counted.
    """
    addresses = recent.groupBy("site_id", "fp", "ip_hash").agg(
        F.max("headless_tainted").alias("tainted"), F.min("ts").alias("first_ts")
    )
    groups = addresses.groupBy("site_id", "fp").agg(
        F.count("*").alias("cluster_size"),
        F.max("tainted").alias("tainted"),
        F.min("first_ts").alias("first_ts"),
    )
    needed = F.when(F.col("tainted"), TAINTED_CLUSTER).otherwise(CLUSTER)
    large = F.col("tainted") | (F.col("cluster_size") >= LARGE_CLUSTER)
    return groups.filter(F.col("cluster_size") >= needed).withColumn(
        "penalty", F.when(large, LARGE_POINTS).otherwise(NORMAL_POINTS)
    )


def cluster_penalties(recent: DataFrame, clusters: DataFrame) -> DataFrame:
    """One penalty per site and visitor: that of the first cluster met, by time
    of its first print."""
    members = recent.select("site_id", "fp", "visitor_id").distinct()
    detail = F.concat(
        F.lit('{"reason":"correlated","penalty":'), F.col("penalty").cast("string"),
        F.lit(',"cluster_size":'), F.col("cluster_size").cast("string"),
        F.lit(',"tainted":'), F.col("tainted").cast("string"),
        F.lit(',"fingerprint":'),
        F.regexp_extract(F.to_json(F.struct(F.col("fp").alias("v"))), '^\\{"v":(.*)\\}$', 1),
        F.lit("}"),
    )
    return (
        members.join(clusters.withColumn("_detail", detail), ["site_id", "fp"])
        .groupBy("site_id", "visitor_id")
        .agg(F.min_by(F.struct("penalty", "_detail"), F.struct("first_ts", "fp")).alias("_hit"))
        .select("site_id", "visitor_id", "_hit.*")
    )


def apply_penalties(facts: DataFrame, penalties: DataFrame) -> DataFrame:
    """Raise clean, unmarked rows of the penalised visitors and mark them. Only rows
    that can be raised meet the penalties; rows without a visitor never do."""
    judged = _can_be_raised("correlated")
    hit = F.col("penalty").isNotNull()
    raised = (
        facts.filter(judged)
        .join(penalties, ["site_id", "visitor_id"], "left")
        .withColumn(
            "bot_score_detail",
            F.when(hit, _with_marker("correlated", F.col("_detail"))).otherwise(F.col("bot_score_detail")),
        )
        .withColumn("bot_score", F.when(hit, _raised(F.col("penalty"))).otherwise(F.col("bot_score")))
        .select(*facts.columns)
    )
    return facts.filter(~judged).unionByName(raised)


def _can_be_raised(marker: str) -> Column:
    return F.coalesce(F.col("visitor_id").isNotNull() & is_clean() & _unmarked(marker), F.lit(False))


def touched_partitions(facts: DataFrame, penalties: DataFrame) -> DataFrame:
    """Site and day (and micro-batch, in tables that have them) of the rows that
    ``apply_penalties`` would raise, with their number."""
    batch = [c for c in FOLDER[2:] if c in facts.columns]
    return (
        facts.filter(_can_be_raised("correlated"))
        .join(penalties.select("site_id", "visitor_id"), ["site_id", "visitor_id"], "left_semi")
        .groupBy("site_id", F.to_date("created_at").alias("event_date"), *batch)
        .agg(F.count("*").alias("rows"))
    )


def confirmed_markers(recent: DataFrame, clusters: DataFrame, as_of: datetime | None) -> DataFrame:
    """Addresses of the clusters, as markers for the address penalty."""
    return (
        recent.select("site_id", "fp", "ip_hash")
        .distinct()
        .join(clusters, ["site_id", "fp"], "left_semi")
        .select("ip_hash")
        .distinct()
        .select("ip_hash", F.lit("confirmed").alias("kind"), at(now_utc(as_of)).alias("ts"))
    )


def sweep(
    views: DataFrame,
    events: DataFrame,
    prints: DataFrame,
    *,
    as_of: datetime | None = None,
    window_seconds: int = PRINT_SECONDS,
    min_seconds: int = NO_EVENT_MIN_SECONDS,
    max_seconds: int = NO_EVENT_MAX_SECONDS,
) -> Sweep:
    """One correlation run: the no-event penalty first, then the clusters."""
    judged = penalise_no_events(
        views, events, as_of=as_of, min_seconds=min_seconds, max_seconds=max_seconds
    )
    recent = recent_prints(prints, as_of=as_of, seconds=window_seconds)
    clusters = find_clusters(recent)
    penalties = cluster_penalties(recent, clusters)
    return Sweep(
        views=apply_penalties(judged, penalties),
        events=apply_penalties(events, penalties),
        confirmed=confirmed_markers(recent, clusters, as_of),
        penalties=penalties,
    )


def _stored_by(facts: DataFrame) -> list[str]:
    return [c for c in FOLDER if c in facts.columns]


def _staged(df: DataFrame, path: str) -> DataFrame:
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _rewritten(path: str, facts: DataFrame, touched: DataFrame, change, stage: str) -> None:
    """Rewrite the touched folders of a stored table with ``change`` applied. The new
    rows are staged first: nothing reads a folder it overwrites."""
    folders = _stored_by(facts)
    new = change(facts.join(touched.select(*folders), folders, "left_semi"))
    overwrite_partitions(_staged(new, stage).select(*facts.columns), path, *folders)
    remove(facts.sparkSession, stage)


def sweep_stored(
    spark: SparkSession,
    views_path: str,
    events_path: str,
    prints: DataFrame,
    *,
    stage_dir: str,
    as_of: datetime | None = None,
    window_seconds: int = PRINT_SECONDS,
    min_seconds: int = NO_EVENT_MIN_SECONDS,
    max_seconds: int = NO_EVENT_MAX_SECONDS,
) -> DataFrame:
    """One correlation run over stored tables by site and day. Returns the confirmed
    markers (ip_hash, kind, ts), which the ingest jobs take as they are.

    Views are read in the folders of the days that quiet visits may lie in, and in those
    that may hold a penalised visitor by their filters; events in those that may hold a
    penalised or a quiet visitor. No other folder is listed or opened, however long the
    tables' history is. Only folders with rows to raise are written again.
    """
    recent = recent_prints(prints, as_of=as_of, seconds=window_seconds)
    clusters = find_clusters(recent)
    penalties = _staged(cluster_penalties(recent, clusters), f"{stage_dir}/penalties")
    span = dict(as_of=as_of, min_seconds=min_seconds, max_seconds=max_seconds)

    oldest, newest = ago(as_of, seconds=max_seconds), ago(as_of, seconds=min_seconds)
    days = [oldest.date() + timedelta(days=d) for d in range((newest.date() - oldest.date()).days + 1)]
    near = live_folders(spark, views_path, days=days)
    held = folders_with(spark, views_path, penalties)
    views = read_folders(spark, views_path, sorted({*near, *held}, key=lambda f: f.path))
    if views is not None:
        aged = within(views, oldest).filter(F.col("created_at") <= at(newest)).filter(_can_be_raised("no_events"))
        quiet = _staged(aged.select("visitor_id", *_stored_by(views)).distinct(), f"{stage_dir}/quiet")
        seen = read_folders(spark, events_path, folders_with(spark, events_path, quiet))
        if seen is None:
            seen = quiet.limit(0)
        touched = quiet.select(*_stored_by(views)).unionByName(touched_partitions(views, penalties).select(*_stored_by(views)))
        _rewritten(
            views_path, views, touched.distinct(),
            lambda rows: apply_penalties(penalise_no_events(rows, seen, **span), penalties), f"{stage_dir}/views",
        )
    events = read_folders(spark, events_path, folders_with(spark, events_path, penalties))
    if events is not None:
        _rewritten(
            events_path, events, touched_partitions(events, penalties),
            lambda rows: apply_penalties(rows, penalties), f"{stage_dir}/events",
        )
    return confirmed_markers(recent, clusters, as_of)
