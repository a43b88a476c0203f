"""Site owner settings used by the ingest and scoring jobs."""

from __future__ import annotations

from dataclasses import dataclass, field

# User-agent substrings of clients that are never tracked.
KNOWN_BOT_AGENTS = (
    "googlebot", "bingbot", "slurp", "duckduckbot", "baiduspider", "yandexbot",
    "sogou", "exabot", "facebot", "facebookexternalhit", "ia_archiver",
    "applebot", "adsbot-google", "mediapartners-google", "apis-google",
    "ahrefsbot", "semrushbot", "mj12bot", "dotbot", "petalbot", "blexbot",
    "gptbot", "chatgpt-user", "oai-searchbot", "claudebot", "claude-web",
    "bytespider", "ccbot", "dataforseobot", "amazonbot", "anthropic-ai",
    "perplexitybot", "youbot", "scrapy", "curl", "wget", "python-requests",
    "go-http-client", "headlesschrome", "amzn-searchbot",
)


@dataclass(frozen=True)
class Settings:
    secret: str = "change-me"
    # scoring
    suspect_countries: tuple[str, ...] = ("CN",)
    suspect_points: int = 30
    site_suspect_countries: dict[str, tuple[str, ...]] = field(default_factory=dict)
    burst_seconds: int = 300
    burst_threshold: int = 15
    discard_threshold: int = 50  # 0 keeps every hit
    # acceptance
    allowed_sites: tuple[str, ...] = ()  # empty accepts all sites
    ignored_sites: tuple[str, ...] = ("smoke-test",)
    bot_agents: tuple[str, ...] = KNOWN_BOT_AGENTS
    # what a sender may post; what goes beyond is rejected with a reason
    post_bytes: int = 16_384
    post_events: int = 20
    event_data_length: int = 2_048
    batch_length: int = 1_048_576
    batch_events: int = 100
    metric_bytes: int = 65_536
    metrics: int = 100
    # header trust
    behind_cloudflare: bool = False
    trust_proxy: bool = False
    trust_geo_headers: bool = False
    # rate limit
    rate_limit_max: int = 100
    rate_limit_seconds: int = 60
    # bot address markers
    suspected_seconds: int = 1800
    confirmed_seconds: int = 3600
    # storage
    anonymize_sites: tuple[str, ...] = ()
    retention_days: int = 90
    bot_retention_days: int = 90
    rollup_retention_days: int = 730
