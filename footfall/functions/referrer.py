"""Traffic source of a referrer: ai, search, social or direct_or_unknown."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from footfall.functions.decode import let

# Domains per class; a host belongs to the first class that lists
# it or a parent domain of it.
AI = (
    "perplexity.ai", "chat.openai.com", "chatgpt.com", "claude.ai", "you.com",
    "phind.com", "copilot.microsoft.com", "gemini.google.com", "poe.com",
)
SEARCH = (
    "google.com", "google.co.uk", "google.de", "google.fr", "google.fi", "google.nl",
    "google.pl", "google.se", "google.no", "google.it", "google.pt", "google.es",
    "google.hu", "google.cz", "google.ro", "google.sk", "google.rs", "bing.com",
    "yahoo.com", "duckduckgo.com", "yandex.com", "yandex.ru", "ecosia.org",
)
SOCIAL = (
    "facebook.com", "twitter.com", "x.com", "reddit.com", "linkedin.com",
    "instagram.com", "t.co",
)
UNKNOWN = "direct_or_unknown"


def _below(host: Column, domains: tuple[str, ...]) -> Column:
    return host.rlike("(^|\\.)(" + "|".join(map(re.escape, domains)) + ")$")


def referrer_class(referrer: Column) -> Column:
    def kind(host: Column) -> Column:
        return (
            F.when(_below(host, AI), "ai")
            .when(_below(host, SEARCH), "search")
            .when(_below(host, SOCIAL), "social")
            .otherwise(UNKNOWN)
        )

    return let(F.lower(F.try_parse_url(referrer, F.lit("HOST"))), kind)
