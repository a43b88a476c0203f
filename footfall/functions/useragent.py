"""Device, operating system and browser from screen width and user agent."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Windows NT versions with a product name.
WINDOWS = {"10.0": "Windows 10/11", "6.3": "Windows 8.1", "6.1": "Windows 7"}

# Browser name and the pattern of its version, first match wins.
BROWSERS = (
    ("Edge", r"Edg(?:e|A|iOS)?/(\d+(?:\.\d+)*)"),
    ("Opera", r"(?:OPR|Opera)/(\d+(?:\.\d+)*)"),
    ("Samsung Browser", r"SamsungBrowser/(\d+(?:\.\d+)*)"),
    ("UC Browser", r"UCBrowser/(\d+(?:\.\d+)*)"),
    ("Chrome", r"(?:Chrome|CriOS)/(\d+(?:\.\d+)*)"),
    ("Firefox", r"(?:Firefox|FxiOS)/(\d+(?:\.\d+)*)"),
    ("Safari", r"Version/(\d+(?:\.\d+)*)\s.*Safari"),
)
MOBILE = "(?i)mobile|android|iphone|ipad"


def device_class(width: Column) -> Column:
    return F.when(width < 768, "mobile").when(width <= 1024, "tablet").when(
        width > 1024, "desktop"
    )


def event_device_class(mobile_hint: Column, agent: Column) -> Column:
    """Client hint if given, else the user agent."""
    return (
        F.when(mobile_hint == "?1", "mobile")
        .when(mobile_hint == "?0", "desktop")
        .when(agent.rlike(MOBILE), "mobile")
        .otherwise("desktop")
    )


def _found(agent: Column, pattern: str) -> Column:
    return F.nullif(F.regexp_extract(agent, pattern, 1), F.lit(""))


def os_name(agent: Column) -> Column:
    ios = F.replace(_found(agent, r"CPU (?:iPhone )?OS (\d+[_.]\d+(?:[_.]\d+)?)"), F.lit("_"), F.lit("."))
    android = _found(agent, r"Android (\d+(?:\.\d+)?)")
    windows = _found(agent, r"Windows NT (\d+\.\d+)")
    mac = F.replace(_found(agent, r"Mac OS X (\d+[_.]\d+(?:[_.]\d+)?)"), F.lit("_"), F.lit("."))
    mac_major = F.substring_index(mac, ".", 1).try_cast("int")
    windows_name = F.concat(F.lit("Windows NT "), windows)
    for version, name in WINDOWS.items():
        windows_name = F.when(windows == version, name).otherwise(windows_name)
    return (
        F.when(ios.isNotNull(), F.concat(F.lit("iOS "), ios))
        .when(android.isNotNull(), F.concat(F.lit("Android "), android))
        .when(windows.isNotNull(), windows_name)
        .when(mac_major >= 11, F.concat(F.lit("macOS "), mac_major.cast("string")))
        .when(mac.isNotNull(), F.concat(F.lit("macOS "), mac))
        .when(agent.contains("CrOS"), "ChromeOS")
        .when(agent.contains("Linux") & ~agent.contains("Android"), "Linux")
    )


def _browser(agent: Column, result: Callable[[str, Column], Column | str]) -> Column:
    choice = None
    for label, pattern in BROWSERS:
        found = _found(agent, pattern)
        fits = found.isNotNull()
        if label == "Chrome":
            fits = fits & ~agent.rlike("Edg|OPR")
        value = result(label, found)
        choice = F.when(fits, value) if choice is None else choice.when(fits, value)
    return choice


def browser_name(agent: Column) -> Column:
    return _browser(agent, lambda label, version: label)


def browser_version(agent: Column) -> Column:
    return _browser(agent, lambda label, version: version)


def matches_any(agent: Column, names: tuple[str, ...]) -> Column:
    """Case-insensitive substring match against a list of names."""
    if not names:
        return F.lit(False)
    return F.coalesce(F.lower(agent).rlike(_any_of({n.lower() for n in names})), F.lit(False))


def _any_of(words: set[str]) -> str:
    """A pattern that finds a text with any of the words in it. A place in the text is tried
    against the letters that words begin with, not against each word."""
    if "" in words:
        return ""  # what the longer words add to it makes no difference
    firsts = sorted({w[0] for w in words})
    branches = [re.escape(c) + _any_of({w[1:] for w in words if w[0] == c}) for c in firsts]
    if len(firsts) == 1:
        return branches[0]
    return "(?=[" + "".join(re.escape(c) for c in firsts) + "])(?:" + "|".join(branches) + ")"
