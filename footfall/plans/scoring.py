"""Heuristic bot score of a request, with the points of every factor."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from footfall.functions.decode import leading_int, segment_count, with_parsed
from footfall.functions.referrer import UNKNOWN
from footfall.settings import Settings

# Points per factor.
CDN_VERIFIED_BOT = 15
CDN_LADDER = ((2, 50), (29, 30), (50, 10))  # CDN score up to -> points
TIMING_LADDER = ((850, 20), (1000, 8))  # interaction below -> points
BURST = 25
NO_LANGUAGE = 10
NO_CLIENT_HINTS = 10
BAD_SCREEN = 10
MAX_SCREEN = 10_000
DEEP_WITHOUT_REFERRER = 5
CRAWLER_FEED = 30
AI_CRAWLER_FEED = 40
DATACENTER = 15
NO_PROOF_OF_WORK = 50
CONFIRMED_IP = 50
SUSPECTED_IP = 20


def cdn_points(settings: Settings) -> Column | None:
    if not settings.behind_cloudflare:
        return None
    parsed = leading_int(F.col("cf_bot_score"))
    score = F.when(parsed.between(1, 99), parsed)
    ladder = F.when(F.col("cf_verified_bot") == "true", CDN_VERIFIED_BOT)
    for upto, points in CDN_LADDER:
        ladder = ladder.when(score <= upto, points)
    return F.when(score.isNotNull(), ladder)


def timing_points() -> Column:
    ladder = None
    for below, points in TIMING_LADDER:
        fast = F.col("interaction_ms") < below
        ladder = F.when(fast, points) if ladder is None else ladder.when(fast, points)
    return F.when(~F.col("is_spa"), ladder)


def country_points(settings: Settings) -> Column:
    suspect = F.col("country_code").isin(*settings.suspect_countries)
    return F.when(suspect, settings.suspect_points)


def site_country_points(settings: Settings) -> Column | None:
    suspect = F.lit(False)
    for site, countries in settings.site_suspect_countries.items():
        suspect = suspect | (
            (F.lower("site_id") == site.lower()) & F.col("country_code").isin(*countries)
        )
    if not settings.site_suspect_countries:
        return None
    return F.when(suspect, settings.suspect_points)


def header_points() -> Column:
    language = F.when(F.col("accept_language").isNull(), NO_LANGUAGE).otherwise(0)
    hints = F.when(
        F.col("sec_ch_ua").isNull() & F.col("sec_fetch_site").isNull(), NO_CLIENT_HINTS
    ).otherwise(0)
    return F.nullif(language + hints, F.lit(0))


def screen_points() -> Column:
    """A dimension that was sent but is no number is no evidence; a missing one is."""

    def bad(raw: str) -> Column:
        size = leading_int(F.col(raw))
        return F.when(F.col(raw).isNull(), True).otherwise(
            F.coalesce((size <= 0) | (size > MAX_SCREEN), F.lit(False))
        )

    sent = F.col("sw").isNotNull() | F.col("sh").isNotNull()
    return F.when(sent & (bad("sw") | bad("sh")), BAD_SCREEN)


def referrer_points() -> Column:
    direct = F.col("referrer").isNull() | F.col("referrer").isin("", UNKNOWN)
    return F.when(direct & (segment_count(F.col("path")) >= 2), DEEP_WITHOUT_REFERRER)


def _flag_points(df: DataFrame, flag: str, points: int) -> Column | None:
    return F.when(F.col(flag), points) if flag in df.columns else None


def with_bot_score(df: DataFrame, settings: Settings, *, pageview: bool = True) -> DataFrame:
    """Add ``bot_score`` (0..100) and ``bot_score_detail`` (JSON of the factors).

    Factors whose input column is absent do not fire. Event posts carry no
    timing, screen, path or referrer, so those factors are for pageviews only.
    """
    heuristics: dict[str, Column | None] = {
        "cf": cdn_points(settings),
        "timing": timing_points() if pageview else None,
        "geo": country_points(settings),
        "geo_site": site_country_points(settings),
        "burst": F.when(F.col("burst_count") > settings.burst_threshold, BURST)
        if "burst_count" in df.columns
        else None,
        "headers": header_points(),
        "screen": screen_points() if pageview else None,
        "referrer": referrer_points() if pageview else None,
        "crawler_feed": _flag_points(df, "crawler_match", CRAWLER_FEED),
        "ai_crawler_feed": _flag_points(df, "ai_crawler_match", AI_CRAWLER_FEED),
        "datacenter_ip": _flag_points(df, "datacenter_ip", DATACENTER),
    }
    proof = F.coalesce("pow_result", F.lit("missing"))
    no_proof = proof != "valid"
    tokens = {
        "pow": F.when(no_proof, NO_PROOF_OF_WORK),
        "pow_result": F.when(no_proof, proof),
        "bot_ip": F.nullif("ip_penalty", F.lit(0)) if "ip_penalty" in df.columns else None,
    }
    given = {name: c for name, c in {**heuristics, **tokens}.items() if c is not None}
    detail = F.struct(*[c.alias(name) for name, c in given.items()])

    def points(names) -> Column:
        total = F.lit(0)
        for name in names:
            if name in given and name != "pow_result":
                total = total + F.coalesce(F.col("_factors")[name], F.lit(0))
        return total

    heuristic = F.least(points(heuristics), F.lit(100))
    return (
        with_parsed(df, _factors=detail)
        .withColumn("bot_score", F.least(heuristic + points(tokens), F.lit(100)))
        .withColumn("bot_score_detail", F.to_json("_factors"))
        .drop("_factors")
    )
