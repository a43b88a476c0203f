"""Event posts (JSON bodies of the browser tracker) to behavioural events."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from footfall.functions.decode import site_or_default, url_origin, variant_text, with_parsed
from footfall.functions.identity import event_number, valid_cookie, valid_session, visitor_hash
from footfall.functions.network import client_country, client_ip
from footfall.functions.useragent import event_device_class, matches_any
from footfall.plans.anonymize import anonymize_events
from footfall.plans.enrich import (
    Dimensions,
    active_campaigns,
    is_discarded,
    site_reject,
    with_signals,
)
from footfall.plans.reputation import with_burst_read
from footfall.plans.scoring import with_bot_score
from footfall.schemas import EVENTS
from footfall.settings import Settings

# Event types the tracker may send.
EVENT_TYPES = (
    "bounce", "session_end", "session_resume", "scroll_depth", "click", "ad_click",
    "form_focus", "form_blur", "form_submit", "hover", "outbound", "download",
    "web_vital", "custom",
)

BODY = "struct<events: array<string>>"
DATA = "struct<data: string>"


@dataclass(frozen=True)
class Events:
    events: DataFrame
    rejects: DataFrame  # whole posts: post_id, ts, reject_reason
    event_rejects: DataFrame  # single events: post_id, ts, position, reject_reason


def decode_posts(posts: DataFrame, settings: Settings) -> DataFrame:
    """Parsed body, identity and context of every post.

    The body is read as VARIANT to test member types, and its events are kept as
    texts, so that an entry of a wrong type is an entry like any other.
    """
    bodies = with_parsed(posts, _json=F.try_parse_json("body"))
    is_list = F.try_variant_get("_json", "$.events", "array<variant>").isNotNull()  # entries are not looked into
    lists = with_parsed(
        bodies, _events=F.when(is_list, F.from_json("body", BODY)["events"])
    )
    site = F.coalesce(variant_text(F.col("_json"), "$.siteId"), F.lit("default"))
    parsed = (
        with_parsed(lists, ip=client_ip(settings), site_id=site_or_default(site))
        .withColumn("country_code", client_country(settings))
        .withColumn("referrer", url_origin(F.col("referer")))
        .withColumn(
            "device_type", event_device_class(F.col("sec_ch_ua_mobile"), F.col("user_agent"))
        )
    )
    cookie = valid_cookie(F.col("cookie_ev"))
    hashed = visitor_hash(
        settings.secret, F.col("ip"), F.col("user_agent"), F.col("site_id"), F.to_date("ts")
    )
    return with_parsed(parsed, visitor_id=F.coalesce(cookie, hashed)).withColumn(
        "is_returning", F.when(cookie.isNotNull(), 1).otherwise(0)
    )


def check_posts(decoded: DataFrame, dims: Dimensions, settings: Settings) -> DataFrame:
    excluded = dims.excluded.select("visitor_id").distinct().withColumn("_excluded", F.lit(True))
    reason = (
        F.when(matches_any(F.col("user_agent"), settings.bot_agents), "known_bot")
        .when(F.octet_length("body") > settings.post_bytes, "too_large")
        .when(F.col("_json").isNull(), "invalid_json")
        .when(F.coalesce(F.size("_events"), F.lit(0)) <= 0, "no_events")
        .when(site_reject(settings).isNotNull(), site_reject(settings))
        .when(F.col("_excluded"), "excluded")
    )
    return (
        with_parsed(decoded.join(excluded, "visitor_id", "left"), reject_reason=reason)
        .drop("_excluded")
    )


def enrich_posts(
    posts: DataFrame,
    dims: Dimensions,
    settings: Settings,
    *,
    counted_hits: DataFrame | Callable[[DataFrame], DataFrame] | None = None,
    stage_dir: str | None = None,
    list_once: bool = False,
) -> Events:
    """Accepted events, one row each; rejected posts, and rejected events of accepted
    posts, with a reason each.

    ``counted_hits`` (ip, ts, burst_count, window_start) are the pageview hits with
    their burst windows, or give those of the checked posts; a post reads what its
    address's window shows at its time. Without them the factor does not fire. With
    ``stage_dir``, a folder all executors share, the checked and the scored posts are
    written there once and read for all outputs; with ``list_once``, for jobs that store
    both events and rejected events, so are the single events.
    """

    def stage(df: DataFrame, name: str) -> DataFrame:
        if stage_dir is None:
            return df
        df.write.mode("overwrite").parquet(f"{stage_dir}/{name}")
        return df.sparkSession.read.parquet(f"{stage_dir}/{name}")

    # the events of a body stand in _events, so the body ends here
    checked = stage(check_posts(decode_posts(posts, settings), dims, settings).drop("_json", "body"), "checked")
    accepted = checked.filter(F.col("reject_reason").isNull())
    if counted_hits is not None:
        counted = counted_hits(checked) if callable(counted_hits) else counted_hits
        accepted = with_burst_read(accepted, counted, settings)
    # the agents are listed from what is stored, where it is
    signals = with_signals(accepted, dims, settings, raw=posts if stage_dir is None else checked)
    # the outputs read these columns only
    scored = with_bot_score(signals, settings, pageview=False).select(
        "post_id", "ts", "site_id", "visitor_id", "device_type", "referrer", "is_returning",
        "bot_score", "bot_score_detail", "_events",
    )
    scored = stage(scored, "scored")
    kept = scored.filter(~is_discarded(settings))

    raw = F.col("_event")
    listed = with_parsed(
        kept.select(*[c for c in kept.columns if c != "_events"], F.posexplode("_events").alias("position", "_text")),
        _event=F.try_parse_json("_text"),
        data=F.coalesce(F.from_json("_text", DATA)["data"], F.lit("{}")),
    )
    kind = variant_text(raw, "$.type")
    reason = (
        F.when(F.col("position") >= settings.post_events, "too_many_events")
        .when(~F.coalesce(F.ltrim("_text").startswith("{"), F.lit(False)), "not_an_object")
        .when(~F.coalesce(kind.isin(*EVENT_TYPES), F.lit(False)), "unknown_type")
        .when(F.length("data") > settings.event_data_length, "data_too_long")
    )
    judged = with_parsed(listed, event_type=kind, _reason=reason)
    members = dict(
        session_id=valid_session(variant_text(raw, "$.sessionId")),
        experiment_id=variant_text(raw, "$.data.experiment_id"),
        variant_id=variant_text(raw, "$.data.variant_id"),
        utm_campaign=variant_text(raw, "$.utmCampaign"),
    )
    if list_once:
        good = F.col("_reason").isNull()
        wanted = {"data": F.col("data"), **members}
        judged = stage(
            judged.select(
                *[c for c in judged.columns if c not in ("_event", "_text", "data")],
                *[F.when(good, c).alias(name) for name, c in wanted.items()],
            ),
            "judged",
        )
    accepted_events = judged.filter(F.col("_reason").isNull())
    events = (
        (accepted_events if list_once else with_parsed(accepted_events, **members))
        .join(active_campaigns(dims.campaigns), ["site_id", "utm_campaign"], "left")
        .withColumn("utm_campaign", F.when(F.col("_active"), F.col("utm_campaign")))
        .withColumn("hour", F.hour("ts"))
        .withColumn("month", F.month("ts"))
        .withColumn("day_of_week", F.dayofweek("ts") - 1)
        .withColumn("id", event_number("post_id", F.col("position"), api=False))
        .withColumn("created_at", F.col("ts"))
        .select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in EVENTS.fields])
    )
    rejects = checked.filter(F.col("reject_reason").isNotNull()).select(
        "post_id", "ts", "reject_reason"
    )
    discarded = scored.filter(is_discarded(settings)).select(
        "post_id", "ts", F.lit("discarded").alias("reject_reason")
    )
    return Events(
        events=anonymize_events(events, settings),
        rejects=rejects.unionByName(discarded),
        event_rejects=judged.filter(F.col("_reason").isNotNull()).select(
            "post_id", "ts", "position", F.col("_reason").alias("reject_reason")
        ),
    )
