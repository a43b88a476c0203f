"""Decoding of request parameters: base64, percent escapes, numbers, ids, URLs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SITE_ID = "^[a-zA-Z0-9._-]{1,64}$"
WEB_SCHEMES = ("http", "https", "ftp", "ws", "wss")
# Texts that are malformed at first sight: a failed conversion costs a Java exception, many
# times as much as a good one.
NOT_BASE64 = "[!-*,.:-<>-@\\[-`{-~-]"
USUAL_BASE64 = "\\A[A-Za-z0-9+/]*+=*+\\z"
WITH_SCHEME = "^[a-zA-Z][a-zA-Z0-9+.-]*:[^\\s]*$"


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once, however often ``use`` names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def base64_text(value: Column) -> Column:
    """Base64 to text, one character per byte; NULL when malformed. Padding is optional.
    Without functions of lists, so that what a row is decoded by is compiled."""

    def decoded(bare: Column) -> Column:
        padded = F.concat(bare, F.repeat(F.lit("="), F.pmod(-F.length(bare), F.lit(4))))
        return F.decode(F.try_to_binary(padded, F.lit("base64")), "ISO-8859-1")

    bare = F.regexp_replace(value, "\\s|=+$", "")
    return F.when(value.rlike(USUAL_BASE64), decoded(F.rtrim(value, F.lit("=")))).when(
        ~bare.rlike(NOT_BASE64), decoded(bare)
    )


def percent_text(value: Column) -> Column:
    """Percent escapes only: a plus sign stays a plus sign."""
    return F.try_url_decode(F.replace(value, F.lit("+"), F.lit("%2B")))


def parameter_text(value: Column) -> Column:
    """A base64 and percent encoded parameter, whole."""
    return percent_text(base64_text(F.nullif(value, F.lit(""))))


def leading_int(value: Column) -> Column:
    """The integer a text starts with ('900abc' is 900), else NULL."""
    return F.regexp_extract(value, "^\\s*([+-]?\\d+)", 1).try_cast("bigint")


def site_or_null(site: Column) -> Column:
    return F.when(site.rlike(SITE_ID), site)


def site_or_default(site: Column) -> Column:
    return F.coalesce(site_or_null(site), F.lit("default"))


def url_origin(url: Column) -> Column:
    """scheme://host[:port] of an absolute URL, NULL when there is none."""

    def parsed(text: Column) -> Column:
        return F.struct(
            F.lower(F.try_parse_url(text, F.lit("PROTOCOL"))).alias("scheme"),
            F.lower(F.try_parse_url(text, F.lit("HOST"))).alias("host"),
            F.regexp_extract(F.try_parse_url(text, F.lit("AUTHORITY")), ":(\\d+)$", 1).alias("port"),
        )

    def origin(parts: Column) -> Column:
        scheme, port = parts["scheme"], parts["port"]
        usual = F.when(scheme == "http", "80").when(scheme == "https", "443").otherwise("")
        suffix = F.when((port == "") | (port == usual), "").otherwise(F.concat(F.lit(":"), port))
        web = F.concat(scheme, F.lit("://"), parts["host"], suffix)
        return F.when(scheme.isin(*WEB_SCHEMES), web).when(scheme.isNotNull(), "null")

    # without a scheme there is no origin, whatever else the text is
    return let(url, lambda text: F.when(text.rlike(WITH_SCHEME), let(parsed(text), origin)))


def segment_count(path: Column) -> Column:
    return F.size(F.filter(F.split(path, "/"), lambda s: s != ""))


def with_parsed(df: DataFrame, **columns: Column) -> DataFrame:
    """Add columns that are costly to compute, such as parsed JSON, exactly once
    per row: filters on what is derived from them stay above the generator and
    do not repeat the parsing below it. A column of the same name is replaced."""
    parsed = F.struct(*[c.alias(name) for name, c in columns.items()])
    kept = [df[f"`{c}`"] for c in df.columns if c not in columns] if set(columns) & set(df.columns) else ["*"]
    return df.select(*kept, F.inline(F.array(parsed)))


def variant_text(variant: Column, path: str) -> Column:
    """A JSON string member of a VARIANT; NULL for members of any other type."""
    member = F.try_variant_get(variant, path, "variant")
    return F.when(
        F.schema_of_variant(member) == "STRING", F.try_variant_get(variant, path, "string")
    )
