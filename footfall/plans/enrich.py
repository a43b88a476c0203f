"""Raw pixel requests to scored pageviews and correlation prints."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from footfall.functions.decode import (
    base64_text,
    leading_int,
    parameter_text,
    site_or_default,
    url_origin,
    with_parsed,
)
from footfall.functions.identity import (
    hmac_hex,
    ip_hash,
    valid_cookie,
    valid_session,
    visitor_hash,
)
from footfall.functions.network import client_country, client_ip
from footfall.functions.referrer import UNKNOWN, referrer_class
from footfall.functions.useragent import (
    browser_name,
    browser_version,
    device_class,
    matches_any,
    os_name,
)
from footfall.operators.windows import continue_windows
from footfall.plans.anonymize import anonymize_views
from footfall.plans.reputation import with_ip_penalty
from footfall.plans.scoring import CONFIRMED_IP, MAX_SCREEN, with_bot_score
from footfall.plans.threats import Feeds, with_threat_flags
from footfall.schemas import VIEWS
from footfall.settings import Settings

# Plausible interaction time in ms.
MIN_INTERACTION, MAX_INTERACTION = 800, 3_600_000
UTM = {"utm_source": "us", "utm_medium": "um", "utm_content": "uct", "utm_term": "ut"}


@dataclass(frozen=True)
class Dimensions:
    """Tables the ingest jobs look things up in."""

    campaigns: DataFrame
    excluded: DataFrame
    markers: DataFrame | None = None  # ip_hash, kind, ts
    feeds: Feeds | None = None


@dataclass(frozen=True)
class Pageviews:
    views: DataFrame
    prints: DataFrame
    rejects: DataFrame
    bursts: DataFrame | None  # hit_id, ip, ts, burst_count, window_start of accepted hits
    checked: DataFrame  # decoded hits with their reject_reason


def site_reject(settings: Settings) -> Column:
    site = F.lower("site_id")
    reason = F.when(site.isin(*[s.lower() for s in settings.ignored_sites]), "ignored_site")
    if settings.allowed_sites:
        allowed = site.isin(*[s.lower() for s in settings.allowed_sites])
        reason = reason.when(~allowed, "site_not_allowed")
    return reason


def active_campaigns(campaigns: DataFrame) -> DataFrame:
    return (
        campaigns.filter(F.col("status") == "active")
        .select("site_id", "utm_campaign")
        .distinct()
        .withColumn("_active", F.lit(True))
    )


def decode_hits(hits: DataFrame, settings: Settings) -> DataFrame:
    """Decoded parameters, identity and country; raw parameters stay for scoring."""
    spa = F.coalesce(F.col("v") == "spa", F.lit(False))
    width = leading_int(F.col("sw"))
    valid_screen = width.between(1, MAX_SCREEN)
    origin = url_origin(base64_text(F.nullif("ref", F.lit(""))))
    # what several columns are made of or tested by is computed once a row
    decoded = (
        with_parsed(
            hits,
            ip=client_ip(settings),
            site_id=site_or_default(F.coalesce("s", F.lit("default"))),
            path=parameter_text(F.col("p")),
            interaction_ms=F.when(spa, F.lit(0)).otherwise(leading_int(F.col("v"))),
        )
        .withColumn("country_code", client_country(settings))
        .withColumn("is_spa", spa)
        .withColumn("referrer", F.coalesce(origin, F.lit(UNKNOWN)))
        .withColumn("session_id", valid_session(F.col("sid")))
        .withColumn("screen_width", F.when(valid_screen, width).cast("int"))
        .withColumn(
            "screen_height",
            F.when(valid_screen, leading_int(F.col("sh")).try_cast("int")),
        )
        .withColumn("utm_campaign", parameter_text(F.col("uc")))
    )
    cookie = valid_cookie(F.col("cookie_ev"))
    by_cookie = F.coalesce(F.col("ck") == "1", F.lit(False))
    # a first visit in cookie mode gets an id of its own, the same on every re-run
    fresh = F.substring(
        hmac_hex(settings.secret, F.concat_ws("|", F.lit("new"), "hit_id", F.col("ts").cast("string"))),
        1,
        16,
    )
    hashed = visitor_hash(
        settings.secret, F.col("ip"), F.col("user_agent"), F.col("site_id"), F.to_date("ts")
    )
    return with_parsed(
        decoded, visitor_id=F.when(by_cookie, F.coalesce(cookie, fresh)).otherwise(hashed)
    ).withColumn("is_returning", F.when(by_cookie & cookie.isNotNull(), 1).otherwise(0))


def check_hits(decoded: DataFrame, dims: Dimensions, settings: Settings) -> DataFrame:
    """Add ``reject_reason``: why a hit is not recorded, NULL if it is."""
    plausible = F.col("is_spa") | F.col("interaction_ms").between(
        MIN_INTERACTION, MAX_INTERACTION
    )
    excluded = dims.excluded.select("visitor_id").distinct().withColumn("_excluded", F.lit(True))
    reason = (
        F.when(matches_any(F.col("user_agent"), settings.bot_agents), "known_bot")
        .when(site_reject(settings).isNotNull(), site_reject(settings))
        .when(~F.coalesce(plausible, F.lit(False)), "interaction")
        .when(~F.coalesce(F.col("path").startswith("/"), F.lit(False)), "path")
        .when(F.col("_excluded"), "excluded")
    )
    return (
        with_parsed(decoded.join(excluded, "visitor_id", "left"), reject_reason=reason)
        .drop("_excluded")
    )


def _with_campaign(hits: DataFrame, campaigns: DataFrame) -> DataFrame:
    """Campaign parameters count only for a campaign registered and active on the site."""
    active = F.col("_active")
    columns = {
        column: F.when(active, parameter_text(F.col(parameter)))
        for column, parameter in UTM.items()
    }
    return (
        hits.join(active_campaigns(campaigns), ["site_id", "utm_campaign"], "left")
        .withColumns({**columns, "utm_campaign": F.when(active, F.col("utm_campaign"))})
        .drop("_active")
    )


def with_signals(
    rows: DataFrame, dims: Dimensions, settings: Settings, *, raw: DataFrame
) -> DataFrame:
    """Address reputation and feed matches, where the tables are given."""
    if dims.markers is not None:
        hashed = with_parsed(rows, ip_hash=ip_hash(settings.secret, F.col("ip")))
        rows = with_ip_penalty(hashed, dims.markers, settings, key="ip_hash").drop("ip_hash")
    if dims.feeds is not None:
        rows = with_threat_flags(rows, dims.feeds, agents_of=raw)
    return rows


def _prints(scored: DataFrame, settings: Settings) -> DataFrame:
    unknown = lambda c: F.coalesce(c, F.lit("unknown"))
    tainted = (
        F.col("ip_penalty") >= CONFIRMED_IP if "ip_penalty" in scored.columns else F.lit(False)
    )
    return scored.select(
        ip_hash(settings.secret, F.col("ip")).alias("ip_hash"),
        "visitor_id",
        "site_id",
        F.struct(
            unknown(F.col("os_name")).alias("os_name"),
            unknown(F.col("browser_name")).alias("browser_name"),
            unknown(F.col("browser_version")).alias("browser_version"),
            F.coalesce("screen_width", F.lit(0)).alias("screen_width"),
            F.coalesce("screen_height", F.lit(0)).alias("screen_height"),
            unknown(F.col("country_code")).alias("country_code"),
            unknown(F.col("accept_language")).alias("accept_language"),
        ).alias("fingerprint"),
        tainted.alias("headless_tainted"),
        "ts",
    )


def is_discarded(settings: Settings) -> Column:
    if settings.discard_threshold <= 0:
        return F.lit(False)
    return F.col("bot_score") >= settings.discard_threshold


def burst_windows(
    accepted: DataFrame, settings: Settings, open_windows: DataFrame | None = None
) -> DataFrame:
    """hit_id, ip, ts, burst_count and window_start of accepted hits, on three narrow
    columns; ``open_windows`` are those that hits before these have left open."""
    return continue_windows(
        accepted.select("hit_id", "ip", "ts"), open_windows,
        keys=["ip"], ts="ts", tiebreak="hit_id", seconds=settings.burst_seconds, name="burst_count",
    )


def _with_bursts(accepted: DataFrame, counted: DataFrame, settings: Settings) -> DataFrame:
    """Only hits beyond the burst threshold get a ``burst_count``, so little is joined."""
    bursting = counted.filter(F.col("burst_count") > settings.burst_threshold)
    return accepted.join(bursting.select("hit_id", "burst_count"), "hit_id", "left")


def enrich_hits(
    hits: DataFrame,
    dims: Dimensions,
    settings: Settings,
    *,
    count_bursts: bool = True,
    open_windows: DataFrame | None = None,
    stage_dir: str | None = None,
    before: Pageviews | None = None,
) -> Pageviews:
    """Views to store, prints for the correlator, and rejected hits with a reason.

    Everything is a projection except the burst count (shuffled by address and
    time) and the joins with small dimensions. Prints are taken before the
    discard test, so discarded hits still count in fingerprint clusters.

    With ``stage_dir``, a folder all executors share, the checked hits and the
    scored hits are each written there once: the burst count does not decode the
    log again, and the three outputs do not score it again. ``open_windows`` are burst
    windows that earlier hits have left open (see ``open_after``). ``before`` are the
    pageviews of the same hits with other markers or feeds: the hits as they were checked
    and counted then are taken over, and scored again.
    """

    def stage(df: DataFrame, name: str) -> DataFrame:
        if stage_dir is None:
            return df
        df.write.mode("overwrite").parquet(f"{stage_dir}/{name}")
        return df.sparkSession.read.parquet(f"{stage_dir}/{name}")

    checked = before.checked if before else stage(check_hits(decode_hits(hits, settings), dims, settings), "checked")
    accepted = _with_campaign(checked.filter(F.col("reject_reason").isNull()), dims.campaigns)
    bursts = None
    if count_bursts:
        bursts = before.bursts if before else None
        if bursts is None:
            bursts = stage(burst_windows(accepted, settings, open_windows), "bursts")
        accepted = _with_bursts(accepted, bursts, settings)
    # the agents are listed from what is stored, where it is
    raw = hits if stage_dir is None else checked
    scored = with_bot_score(with_signals(accepted, dims, settings, raw=raw), settings)
    agent = F.col("user_agent")
    scored = scored.withColumns(
        {
            "os_name": os_name(agent),
            "browser_name": browser_name(agent),
            "browser_version": browser_version(agent),
            "device_type": device_class(F.col("screen_width")),
            "referrer_type": referrer_class(F.col("referrer")),
            "is_pwa": F.coalesce((F.col("pwa") == "1").cast("int"), F.lit(0)),
            "id": F.col("hit_id"),
            "created_at": F.col("ts"),
        }
    )
    # the outputs read these columns only; the raw parameters end here
    wanted = {"hit_id", "ts", "ip", "accept_language", "ip_penalty", *(f.name for f in VIEWS.fields)}
    scored = stage(scored.select(*[c for c in scored.columns if c in wanted]), "scored")
    views = scored.filter(~is_discarded(settings)).select(
        *[F.col(f.name).cast(f.dataType).alias(f.name) for f in VIEWS.fields]
    )
    rejects = checked.filter(F.col("reject_reason").isNotNull()).select(
        "hit_id", "ts", "reject_reason"
    )
    discarded = scored.filter(is_discarded(settings)).select(
        "hit_id", "ts", F.lit("discarded").alias("reject_reason")
    )
    return Pageviews(
        views=anonymize_views(views, settings),
        prints=_prints(scored, settings),
        rejects=rejects.unionByName(discarded),
        bursts=bursts,
        checked=checked,
    )
