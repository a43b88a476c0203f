"""Pseudonyms for the views and events of listed sites.

Within a day the same value gets the same pseudonym, so the reports still add
up; the secret and the day are part of every hash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from footfall.functions.identity import hmac_hex
from footfall.functions.labels import TERMINALS
from footfall.settings import Settings

# Neutral pools, built from a rule; only their sizes matter.
POOLS = {"country": 32, "session": 50, "referrer": 40, "word": 40, "os": 24}
BROWSER_NAMES, BROWSER_PARTS = 24, 16
MAX_MAJOR, MAX_MINOR = 150, 10

DEVICES = {"desktop": "large", "tablet": "medium", "mobile": "small"}
OTHER_DEVICE = "other"

# Data keys that are kept per event type, and the typed-in ones
# among them that are scrambled.
KEPT_KEYS = {
    "scroll_depth": ("depth", "path"),
    "bounce": ("dwell", "trigger", "path"),
    "session_end": ("dwell_s", "path"),
    "session_resume": ("path",),
    "web_vital": ("metric", "value", "rating", "path"),
    "click": ("tag", "path"),
    "ad_click": ("tag", "path"),
    "hover": ("tag", "path"),
    "form_focus": ("tag", "input_type", "field_name", "form_id", "form_name", "path"),
    "form_blur": (
        "tag", "input_type", "field_name", "form_id", "form_name", "value",
        "value_length", "path",
    ),
    "form_submit": ("method", "id", "name", "label", "path"),
    "outbound": ("host", "path"),
    "download": ("ext", "path"),
}
SCRAMBLED = {"form_blur": "value"}


def _key(secret: str, value: Column) -> Column:
    """Daily keyed hash of a value: 64 hex digits."""
    return hmac_hex(secret, F.concat_ws("|", F.date_format("created_at", "yyyy-MM-dd"), value))


def _number(digits: Column, start: int, length: int) -> Column:
    return F.conv(F.substring(digits, start, length), 16, 10).cast("bigint")


def _pick(digits: Column, pool: str) -> Column:
    """Name of a pool entry chosen by the first 32 bits."""
    slot = _number(digits, 1, 8) % POOLS[pool]
    return F.concat(F.lit(f"{pool}-"), F.lpad(slot.cast("string"), 2, "0"))


def pseudonym(secret: str, value: Column, pool: str) -> Column:
    return F.when(F.nullif(value, F.lit("")).isNotNull(), _pick(_key(secret, value), pool))


def path_pseudonym(secret: str, path: Column) -> Column:
    """Each segment gets its own pseudonym, so the path keeps its shape."""
    segments = F.filter(F.split(path, "/"), lambda s: s != "")
    named = F.transform(segments, lambda s: _pick(_key(secret, s), "word"))
    return F.when(path.isNotNull(), F.concat(F.lit("/"), F.array_join(named, "/")))


def browser_name_pseudonym(secret: str, name: Column) -> Column:
    digits = _key(secret, name)
    first = (_number(digits, 1, 8) % BROWSER_NAMES).cast("string")
    second = (_number(digits, 9, 8) % BROWSER_PARTS).cast("string")
    return F.when(name != "", F.concat(F.lit("browser-"), first, F.lit("-"), second))


def version_pseudonym(secret: str, version: Column) -> Column:
    digits = _key(secret, version)
    major = (_number(digits, 1, 4) % MAX_MAJOR + 1).cast("string")
    minor = (_number(digits, 5, 2) % MAX_MINOR).cast("string")
    return F.when(version != "", F.concat(major, F.lit("."), minor))


def referrer_pseudonym(secret: str, referrer: Column) -> Column:
    digits = _key(secret, referrer)
    url = F.concat(
        F.lit("https://referrer.invalid/"), _pick(digits, "referrer"), F.lit("-"),
        F.substring(digits, 1, 4),
    )
    return F.when(referrer != "", url)


def device_pseudonym(device: Column) -> Column:
    name = None
    for kind, alias in DEVICES.items():
        same = F.lower(device) == kind
        name = F.when(same, alias) if name is None else name.when(same, alias)
    return F.when(device != "", name.otherwise(OTHER_DEVICE))


def screen_pseudonym(secret: str, width: Column, height: Column) -> Column:
    """Struct of the width and height of a classic terminal."""
    size = F.concat_ws(
        "x",
        F.coalesce(width, F.lit(0)).cast("string"),
        F.coalesce(height, F.lit(0)).cast("string"),
    )
    slot = (_number(_key(secret, size), 1, 8) % len(TERMINALS)).cast("int")
    sizes = F.array(
        *[F.struct(F.lit(w).alias("width"), F.lit(h).alias("height")) for w, h, _ in TERMINALS]
    )
    return F.when(width.isNotNull() | height.isNotNull(), F.get(sizes, slot))


def scramble(secret: str, text: Column) -> Column:
    """Replace letters and digits by others of their class; keep all else and the length."""
    letters = "abcdefghijklmnopqrstuvwxyz"
    digits = _key(secret, text)

    def replaced(position: Column) -> Column:
        char = F.substring(text, position, F.lit(1))
        at = F.pmod((position - 1) * 2, F.lit(64)) + 1
        byte = F.conv(F.substring(digits, at, F.lit(2)), 16, 10).cast("int")

        def from_class(members: str) -> Column:
            return F.substring(F.lit(members), byte % len(members) + 1, F.lit(1))

        return (
            F.when(char.rlike("^[a-z]$"), from_class(letters))
            .when(char.rlike("^[A-Z]$"), from_class(letters.upper()))
            .when(char.rlike("^[0-9]$"), from_class("0123456789"))
            .otherwise(char)
        )

    positions = F.sequence(F.lit(1), F.greatest(F.length(text), F.lit(1)))
    return F.when(F.length(text) > 0, F.array_join(F.transform(positions, replaced), "")).otherwise(
        text
    )


def clean_data(secret: str, event_type: Column, data: Column) -> Column:
    """The JSON with only the keys kept for the event type, in their listed order."""
    result = None
    for kind, keys in KEPT_KEYS.items():
        members = []
        for key in keys:
            # a member's raw JSON text: quoted for strings, as it is for the rest
            member = F.variant_get(F.col("_data"), f"$.{key}", "variant")
            text = F.to_json(member)
            if SCRAMBLED.get(kind) == key:
                typed = F.try_variant_get(F.col("_data"), f"$.{key}", "string")
                is_text = F.schema_of_variant(member) == "STRING"
                hidden = F.to_json(F.struct(scramble(secret, typed).alias("v")))
                inner = F.regexp_extract(hidden, '^\\{"v":(.*)\\}$', 1)
                text = F.when(is_text, inner).otherwise(text)
            members.append(F.concat(F.lit(f'"{key}":'), text))
        joined = F.concat(F.lit("{"), F.concat_ws(",", *members), F.lit("}"))
        same = event_type == kind
        result = F.when(same, joined) if result is None else result.when(same, joined)
    return F.coalesce(result, F.lit("{}"))


def _listed(settings: Settings) -> Column:
    return F.lower("site_id").isin(*[s.lower() for s in settings.anonymize_sites])


def _replace(df: DataFrame, settings: Settings, columns: dict[str, Column]) -> DataFrame:
    """Replace the columns on rows of listed sites, from the row's old values."""
    listed = _listed(settings)
    return df.select(
        *[
            F.when(listed, columns[f.name]).otherwise(F.col(f.name)).cast(f.dataType).alias(f.name)
            if f.name in columns
            else F.col(f.name)
            for f in df.schema.fields
        ]
    )


def anonymize_views(views: DataFrame, settings: Settings) -> DataFrame:
    if not settings.anonymize_sites:
        return views
    s = settings.secret
    screen = screen_pseudonym(s, F.col("screen_width"), F.col("screen_height"))
    words = ("utm_source", "utm_medium", "utm_campaign", "utm_content", "utm_term")
    return _replace(
        views,
        settings,
        {
            "visitor_id": F.substring(_key(s, F.col("visitor_id")), 1, 16),
            "path": path_pseudonym(s, F.col("path")),
            "session_id": pseudonym(s, F.col("session_id"), "session"),
            "country_code": pseudonym(s, F.col("country_code"), "country"),
            "screen_width": screen["width"],
            "screen_height": screen["height"],
            "device_type": device_pseudonym(F.col("device_type")),
            "os_name": pseudonym(s, F.col("os_name"), "os"),
            "browser_name": browser_name_pseudonym(s, F.col("browser_name")),
            "browser_version": version_pseudonym(s, F.col("browser_version")),
            "referrer": referrer_pseudonym(s, F.col("referrer")),
            **{w: pseudonym(s, F.col(w), "word") for w in words},
        },
    )


def anonymize_events(events: DataFrame, settings: Settings) -> DataFrame:
    if not settings.anonymize_sites:
        return events
    s = settings.secret

    def tagged(column: str, tag: str) -> Column:
        short = F.substring(_key(s, F.col(column)), 1, 8)
        return F.when(F.col(column) != "", F.concat(F.lit(f"{tag}-"), short))

    parsed = events.withColumn("_data", F.try_parse_json("data"))
    return _replace(
        parsed,
        settings,
        {
            "visitor_id": F.when(
                F.col("visitor_id") != "", F.substring(_key(s, F.col("visitor_id")), 1, 16)
            ),
            "session_id": pseudonym(s, F.col("session_id"), "session"),
            "device_type": F.coalesce(device_pseudonym(F.col("device_type")), F.lit(OTHER_DEVICE)),
            "referrer": referrer_pseudonym(s, F.col("referrer")),
            "data": clean_data(s, F.col("event_type"), F.col("data")),
            "experiment_id": tagged("experiment_id", "experiment"),
            "variant_id": tagged("variant_id", "variant"),
            "utm_campaign": pseudonym(s, F.col("utm_campaign"), "word"),
        },
    ).drop("_data")
