"""Request-rate and address-reputation flags."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from footfall.functions.identity import ip_hash
from footfall.functions.useragent import matches_any
from footfall.operators.windows import anchored_count, latest_within, seen_within
from footfall.plans.scoring import CONFIRMED_IP, SUSPECTED_IP
from footfall.settings import Settings


def with_burst_count(
    hits: DataFrame, settings: Settings, *, key: str = "ip", order: str = "hit_id", chunk_seconds: int | None = None
) -> DataFrame:
    """Number of the hit in the address's current burst window."""
    return anchored_count(
        hits,
        keys=[key],
        ts="ts",
        tiebreak=order,
        seconds=settings.burst_seconds,
        name="burst_count",
        chunk_seconds=chunk_seconds,
    ).drop("window_start")


def with_rate_limit(
    hits: DataFrame, settings: Settings, *, key: str = "ip", order: str = "hit_id", chunk_seconds: int | None = None
) -> DataFrame:
    """Flag hits beyond the allowed number per window; 0 switches the limit off."""
    if settings.rate_limit_max <= 0:
        return hits.withColumn("is_limited", F.lit(False))
    numbered = anchored_count(
        hits,
        keys=[key],
        ts="ts",
        tiebreak=order,
        seconds=settings.rate_limit_seconds,
        name="_number",
        chunk_seconds=chunk_seconds,
    )
    return numbered.withColumn(
        "is_limited", F.col("_number") > settings.rate_limit_max
    ).drop("_number", "window_start")


def with_burst_read(
    posts: DataFrame, counted_hits: DataFrame, settings: Settings, *, key: str = "ip"
) -> DataFrame:
    """The burst count as event posts see it: read, not advanced.

    ``counted_hits`` is the output of ``anchored_count`` with ``burst_count`` and
    ``window_start``. An address without an open window reads 0.
    """
    state = counted_hits.select(
        key, "ts", F.struct("burst_count", "window_start").alias("_state")
    )
    read = latest_within(
        posts,
        state,
        "_state",
        keys=[key],
        probe_ts="ts",
        fact_ts="ts",
        seconds=settings.burst_seconds,
        name="_open",
    )
    age = F.expr(f"ts - _open.window_start <= INTERVAL '{settings.burst_seconds}' SECOND")
    return read.withColumn(
        "burst_count", F.when(age, F.col("_open.burst_count")).otherwise(0)
    ).drop("_open")


def with_ip_penalty(
    hits: DataFrame, markers: DataFrame, settings: Settings, *, key: str = "ip"
) -> DataFrame:
    """50 for an address confirmed within an hour, else 20 for one suspected
    within half an hour, else 0. ``markers`` has the key, ``kind`` and ``ts``."""
    flagged = hits
    for kind, seconds in (
        ("confirmed", settings.confirmed_seconds),
        ("suspected", settings.suspected_seconds),
    ):
        flagged = seen_within(
            flagged,
            markers.filter(F.col("kind") == kind),
            keys=[key],
            probe_ts="ts",
            marker_ts="ts",
            seconds=seconds,
            name=f"_{kind}",
        )
    penalty = F.when(F.col("_confirmed"), CONFIRMED_IP).when(F.col("_suspected"), SUSPECTED_IP)
    return flagged.withColumn("ip_penalty", penalty.otherwise(0)).drop("_confirmed", "_suspected")


def suspected_markers(requests: DataFrame, settings: Settings) -> DataFrame:
    """Markers of addresses that any request showed a known bot agent from, by address
    hash as those of the correlator."""
    seen = requests.filter(
        matches_any(F.col("user_agent"), settings.bot_agents) & (F.col("ip") != "unknown")
    )
    hashed = ip_hash(settings.secret, F.col("ip")).alias("ip_hash")
    return seen.select(hashed, F.lit("suspected").alias("kind"), "ts")
