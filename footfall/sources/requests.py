"""Raw request logs: query strings and headers to the columns of HITS and POSTS."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from footfall.schemas import HITS, POSTS

HEADERS = {
    "cf_connecting_ip": "cf-connecting-ip",
    "x_forwarded_for": "x-forwarded-for",
    "x_real_ip": "x-real-ip",
    "user_agent": "user-agent",
    "accept_language": "accept-language",
    "sec_ch_ua": "sec-ch-ua",
    "sec_ch_ua_mobile": "sec-ch-ua-mobile",
    "sec_fetch_site": "sec-fetch-site",
    "cf_ipcountry": "cf-ipcountry",
    "cloudfront_viewer_country": "cloudfront-viewer-country",
    "x_country_code": "x-country-code",
    "cf_bot_score": "cf-bot-score",
    "cf_verified_bot": "cf-verified-bot",
    "referer": "referer",
}
PARAMETERS = {"v": "_v"}  # column -> parameter where the names differ


def query_parameters(query: Column) -> Column:
    """Map of a query string; the first of repeated parameters counts."""
    pairs = F.filter(F.split(query, "&"), lambda p: p != "")
    entries = F.transform(
        pairs,
        lambda p: F.struct(
            F.substring_index(p, "=", 1).alias("k"),
            F.try_url_decode(
                F.when(F.contains(p, F.lit("=")), F.regexp_replace(p, "^[^=]*=", "")).otherwise("")
            ).alias("v"),
        ),
    )
    return F.map_from_entries(
        F.aggregate(
            entries,
            F.expr("cast(array() as array<struct<k: string, v: string>>)"),
            lambda seen, e: F.when(
                F.exists(seen, lambda s: s["k"] == e["k"]), seen
            ).otherwise(F.concat(seen, F.array(e))),
        )
    )


def _cookie(headers: Column, name: str) -> Column:
    found = F.regexp_extract(F.try_element_at(headers, F.lit("cookie")), f"(?:^|;\\s*){name}=([^;]*)", 1)
    return F.nullif(found, F.lit(""))


def _columns(schema, headers: Column, given: dict[str, Column]) -> list[Column]:
    columns = []
    for field in schema.fields:
        if field.name in given:
            column = given[field.name]
        else:
            column = F.try_element_at(headers, F.lit(HEADERS[field.name]))
        columns.append(column.cast(field.dataType).alias(field.name))
    return columns


def hits_from_log(log: DataFrame) -> DataFrame:
    """``log``: id, ts, remote_addr, query, headers (map, lower-case names) and
    pow_result (the verdict of the proof-of-work check)."""
    headers, query = F.col("headers"), F.col("_query")
    given = {
        "hit_id": F.col("id"),
        "ts": F.col("ts"),
        "remote_addr": F.col("remote_addr"),
        "cookie_ev": _cookie(headers, "_ev"),
        "pow_result": F.col("pow_result"),
    }
    for field in HITS.fields:
        if field.name not in given and field.name not in HEADERS:
            name = PARAMETERS.get(field.name, field.name)
            given[field.name] = F.try_element_at(query, F.lit(name))
    parsed = log.withColumn("_query", query_parameters(F.col("query")))
    return parsed.select(*_columns(HITS, headers, given))


def posts_from_log(log: DataFrame) -> DataFrame:
    """``log``: id, ts, remote_addr, headers, body and pow_result."""
    headers = F.col("headers")
    given = {
        "post_id": F.col("id"),
        "ts": F.col("ts"),
        "remote_addr": F.col("remote_addr"),
        "cookie_ev": _cookie(headers, "_ev"),
        "body": F.col("body"),
        "pow_result": F.col("pow_result"),
    }
    return log.select(*_columns(POSTS, headers, given))
