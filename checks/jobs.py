"""Registered jobs J01-J19: the Spark job and its SQL check side by side."""

from __future__ import annotations

from dataclasses import replace
from datetime import timedelta
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from checks.adapters import as_of, table
from checks.reports import CLEAN, NOW, register, when
from footfall.functions.identity import ip_hash
from footfall.functions.network import client_ip
from footfall.plans import (
    compact,
    anonymize,
    correlate,
    enrich,
    experiments,
    ingest,
    posts,
    reputation,
    retention,
    rollup,
    scoring,
    sessions,
    sketched as sketched_reports,
    threats,
)
from footfall.plans.threats import Feeds
from footfall.session import shared_dir
from footfall.settings import Settings
from footfall.sources.folders import read_facts
from footfall.sources.tables import append_facts, insert_absent, read_table, upsert
from footfall.streaming.sinks import write_facts

SECRET = "check-secret"
SETTINGS = Settings(
    secret=SECRET,
    behind_cloudflare=True,
    trust_proxy=True,
    trust_geo_headers=True,
    site_suspect_countries={"site-1": ("NO", "US")},
    burst_seconds=6 * 3600,
    burst_threshold=3,
    rate_limit_max=2,
    rate_limit_seconds=3 * 3600,
    suspected_seconds=6 * 3600,
    confirmed_seconds=12 * 3600,
    discard_threshold=90,
)
PATTERNS = ("(?<name>Feed)[A-Z]heck", "(broken", "(?P<no>curl)", "(?<name>s)pider")
AI_NAMES = ("U; And", "C++bot")

# --- rollup and retention -----------------------------------------------------------


def rollup_day(sf: str):
    return as_of(sf).date() - timedelta(days=1)


register(
    "J01_daily_rollup",
    lambda spark, sf: rollup.daily_rollup(
        table(spark, sf, "views"), table(spark, sf, "excluded"), rollup_day(sf)
    ),
    f"""SELECT site_id, strftime(date, '%Y-%m-%d') AS date, device_type, country_code, is_returning,
      visits, unique_visitors, avg_interaction_ms
     FROM daily d WHERE d.date = CAST({NOW} AS DATE) - 1""",
    daily=True,
)
register(
    "J01_rollup_all_days",
    lambda spark, sf: rollup.rollup_days(table(spark, sf, "views"), table(spark, sf, "excluded")),
    """SELECT site_id, strftime(date, '%Y-%m-%d') AS date, device_type, country_code, is_returning,
      visits, unique_visitors, avg_interaction_ms FROM daily""",
    daily=True,
)


def sketched(spark: SparkSession, sf: str) -> DataFrame:
    """Visits per site, and whether the merged sketches are within 3 % of the exact count."""
    views, excluded = table(spark, sf, "views"), table(spark, sf, "excluded")
    approx = rollup.approx_uniques(rollup.rollup_sketches(views, excluded), "site_id")
    exact = (
        rollup.countable_views(views).join(excluded, "visitor_id", "left_anti")
        .groupBy("site_id").agg(F.countDistinct("visitor_id").alias("exact"))
    )
    error = F.abs(F.col("approx_visitors") - F.col("exact"))
    return approx.join(exact, "site_id").select(
        "site_id", "visits", (error <= F.col("exact") * 0.03).alias("within_bound")
    )


register(
    "J01b_rollup_sketches",
    sketched,
    f"""SELECT site_id, count(*) AS visits, true AS within_bound FROM views v
     WHERE {CLEAN} AND NOT EXISTS (SELECT 1 FROM excluded x WHERE x.visitor_id = v.visitor_id) GROUP BY site_id""",
    "views", "excluded",
)


def written(df: DataFrame, name: str) -> DataFrame:
    """Stored, as the sketches are that a report reads."""
    path = shared_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remaining(spark: SparkSession, sf: str) -> DataFrame:
    """Exact views of each day and site, and whether the visitors left when the excluded
    ones are taken from the stored sketches are within five standard errors."""
    views, excluded = table(spark, sf, "views"), table(spark, sf, "excluded")
    by = ["site_id", "date"]
    sketches = written(sketched_reports.rollup_visitors(views), "visitor_sketches")
    approx = sketched_reports.remaining_visitors(sketches, excluded, *by)
    exact = (
        rollup.countable_views(views).join(excluded.select("visitor_id").distinct().withColumn("out", F.lit(True)), "visitor_id", "left")
        .groupBy(*by).agg(F.count("*").alias("views"), F.countDistinct(F.when(F.col("out").isNull(), F.col("visitor_id"))).alias("exact"))
    )
    error = F.abs(F.col("unique_visitors") - F.col("exact"))
    return exact.join(approx, by).select(*by, "views", "exact", (error <= 5 * F.col("error")).alias("within_bound"))


register(
    "A15_remaining_visitors",
    remaining,
    f"""SELECT site_id, strftime(CAST(created_at AS DATE), '%Y-%m-%d') AS date, count(*) AS views,
      count(DISTINCT CASE WHEN x.visitor_id IS NULL THEN v.visitor_id END) AS exact, true AS within_bound
     FROM views v LEFT JOIN (SELECT DISTINCT visitor_id FROM excluded) x ON v.visitor_id = x.visitor_id
     WHERE {CLEAN} GROUP BY 1, 2""",
    "views", "excluded",
)


def kinds(spark: SparkSession, sf: str) -> DataFrame:
    """Exact visitors by kind over all stored days, and whether the sketched numbers are
    within 5 % of all visitors of them."""
    views, excluded = table(spark, sf, "views"), table(spark, sf, "excluded")
    sketches = written(sketched_reports.rollup_visitors(views), "visitor_sketches")
    approx = sketched_reports.visitor_kinds(sketches, excluded, "site_id")
    seen = (
        rollup.countable_views(views).join(excluded.select("visitor_id").distinct(), "visitor_id", "left_anti")
        .groupBy("site_id", "visitor_id").agg(F.min("is_returning").alias("low"), F.max("is_returning").alias("high"))
    )
    exact = seen.groupBy("site_id").agg(
        F.count_if(F.col("high") == 0).alias("new"), F.count_if(F.col("low") == 1).alias("old"),
        F.count_if(F.col("low") < F.col("high")).alias("again"),
    )
    bound = (F.col("new") + F.col("old") + F.col("again")) * 0.05
    near = [F.abs(F.col(a) - F.col(b)) <= bound for a, b in (("only_new", "new"), ("only_returning", "old"), ("came_back", "again"))]
    return approx.join(exact, "site_id").select("site_id", "new", "old", "again", (near[0] & near[1] & near[2]).alias("within_bound"))


register(
    "A15_visitor_kinds",
    kinds,
    f"""SELECT site_id, count(*) FILTER (high = 0) AS new, count(*) FILTER (low = 1) AS old,
      count(*) FILTER (low < high) AS again, true AS within_bound
     FROM (SELECT site_id, visitor_id, min(is_returning) AS low, max(is_returning) AS high FROM views v
      WHERE {CLEAN} AND NOT EXISTS (SELECT 1 FROM excluded x WHERE x.visitor_id = v.visitor_id) GROUP BY 1, 2)
     GROUP BY site_id""",
    "views", "excluded",
)


def latencies(spark: SparkSession, sf: str) -> DataFrame:
    """Exact counts and means of each path, and whether the sketched percentiles have ranks
    within 1 % of those wanted."""
    requests = table(spark, sf, "requests")
    parts = written(sketched_reports.latency_parts(requests, "1 hour"), "latency_parts")
    found = sketched_reports.latency(parts, "path")
    names = {"p50_ms": 0.5, "p95_ms": 0.95, "p99_ms": 0.99}
    ranked = requests.join(found.select("path", *names), "path").groupBy("path").agg(
        *[F.avg((F.col("duration_ms") < F.col(n)).cast("int")).alias(f"below_{n}") for n in names],
        *[F.avg((F.col("duration_ms") <= F.col(n)).cast("int")).alias(f"upto_{n}") for n in names],
    )
    right = F.lit(True)
    for name, share in names.items():
        right = right & (F.col(f"below_{name}") <= share + 0.01) & (F.col(f"upto_{name}") >= share - 0.01)
    return found.join(ranked, "path").select("path", "requests", "errors", "max_ms", right.alias("within_bound"))


register(
    "A16_latency_sketches",
    latencies,
    """SELECT path, count(*) AS requests, count(*) FILTER (status >= 500) AS errors,
      max(duration_ms) AS max_ms, true AS within_bound FROM requests GROUP BY path""",
    "requests",
)


def purgeable(spark: SparkSession, sf: str) -> dict[str, DataFrame]:
    views, excluded = table(spark, sf, "views"), table(spark, sf, "excluded")
    return {
        "visitor_views": views,
        "semantic_events": table(spark, sf, "sem_events"),
        "visitor_views_daily": rollup.rollup_days(views, excluded),
        "perf_metrics": table(spark, sf, "metrics"),
    }


# Two years ahead of the data everything of the rollup's first days is due as well.
PURGE = dict(days=10, bot_days=5)
MACHINE = "(bot_score >= 50 OR bot_score < 0)"


def due(column: str, days: int, ahead: int = 0) -> str:
    return f"{column} < CAST({NOW} AS DATE) + {ahead} - {days}"


register(
    "J02_purge_counts",
    lambda spark, sf: retention.purge_counts(purgeable(spark, sf), as_of=as_of(sf), **PURGE),
    f"""SELECT
      (SELECT count(*) FROM views WHERE {due('created_at', 10)} AND {CLEAN}) AS views_deleted,
      (SELECT count(*) FROM sem_events WHERE {due('created_at', 10)} AND {CLEAN}) AS events_deleted,
      (SELECT count(*) FROM views WHERE {due('created_at', 5)} AND {MACHINE}) AS bot_views_deleted,
      (SELECT count(*) FROM sem_events WHERE {due('created_at', 5)} AND {MACHINE}) AS bot_events_deleted,
      (SELECT count(*) FROM daily WHERE {due('date', 730)}) AS daily_deleted,
      (SELECT count(*) FROM metrics WHERE {due('recorded_at', 10)}) AS perf_deleted""",
    "sem_events", "metrics",
    daily=True,
)
register(
    "J02_retained_rollup",
    lambda spark, sf: retention.retained(
        purgeable(spark, sf), as_of=as_of(sf) + timedelta(days=715), **PURGE
    )["visitor_views_daily"],
    f"""SELECT site_id, strftime(date, '%Y-%m-%d') AS date, device_type, country_code, is_returning,
      visits, unique_visitors, avg_interaction_ms FROM daily d WHERE NOT {due('d.date', 730, 715)}""",
    daily=True,
)
register(
    "J02_retained_views",
    lambda spark, sf: retention.retained(purgeable(spark, sf), as_of=as_of(sf), **PURGE)[
        "visitor_views"
    ].select("id", "bot_score", "created_at"),
    f"""SELECT id, bot_score, {when('v.created_at')} AS created_at FROM views v
     WHERE NOT ({due('v.created_at', 10)} AND {CLEAN}) AND NOT ({due('v.created_at', 5)} AND {MACHINE})""",
    "views",
)
register(
    "S10_insert_absent",
    lambda spark, sf: insert_absent(
        table(spark, sf, "excluded"),
        table(spark, sf, "views")
        .groupBy("visitor_id")
        .agg(F.max("bot_score").alias("top"), F.max("created_at").alias("created_at"))
        .filter("top >= 95")
        .select("visitor_id", F.lit("score").alias("label"), "created_at"),
        "visitor_id",
    ),
    f"""SELECT visitor_id, label, {when('x.created_at')} AS created_at FROM excluded x
     UNION ALL SELECT visitor_id, 'score', {when('max(v.created_at)')} FROM views v
     WHERE NOT EXISTS (SELECT 1 FROM excluded x WHERE x.visitor_id = v.visitor_id)
     GROUP BY visitor_id HAVING max(bot_score) >= 95""",
    "views", "excluded",
)
register(
    "S10_upsert",
    lambda spark, sf: upsert(
        table(spark, sf, "excluded"),
        table(spark, sf, "views").select(
            "visitor_id", F.col("path").alias("label"), "created_at", "id"
        ),
        "visitor_id",
        order=F.desc("id"),
    ).select("visitor_id", "label", "created_at"),
    f"""SELECT visitor_id, label, {when('x.created_at')} AS created_at FROM excluded x
     WHERE NOT EXISTS (SELECT 1 FROM views v WHERE v.visitor_id = x.visitor_id)
     UNION ALL SELECT visitor_id, path, {when('v.created_at')} FROM views v
     QUALIFY row_number() OVER (PARTITION BY visitor_id ORDER BY id DESC) = 1""",
    "views", "excluded",
)

# --- hits to pageviews ------------------------------------------------------------------


def pads(secret: str) -> tuple[str, str]:
    key = secret.encode().ljust(64, b"\0")
    return bytes(b ^ 0x36 for b in key).hex(), bytes(b ^ 0x5C for b in key).hex()


def hmac(message: str) -> str:
    inner, outer = pads(SECRET)
    return f"sha256(unhex('{outer}') || unhex(sha256(unhex('{inner}') || encode({message}))))"


KNOWN_BOT = "regexp_matches(lower(user_agent), 'curl|wget|googlebot|gptbot')"
IP = """CASE WHEN x_forwarded_for IS NOT NULL THEN trim(split_part(x_forwarded_for, ',', 1)) ELSE remote_addr END"""
COUNTRY = """upper(coalesce(CASE WHEN cf_ipcountry NOT IN ('XX','T1') THEN cf_ipcountry END, cloudfront_viewer_country, x_country_code))"""
SITE_ID = r"CASE WHEN regexp_matches({}, '^[a-zA-Z0-9._-]{{1,64}}$') THEN {} ELSE 'default' END"


def text(column: str) -> str:
    return f"url_decode(CAST(decode(TRY(from_base64({column}))) AS VARCHAR))"


def number(column: str) -> str:
    return f"TRY_CAST(nullif(regexp_extract({column}, '^\\s*([+-]?\\d+)', 1), '') AS BIGINT)"


def origin(url: str) -> str:
    return (
        f"CASE WHEN regexp_matches({url}, '^https?://[^/ ]+') THEN "
        f"regexp_extract({url}, '^(https?://[^/:?# ]+)', 1) || coalesce(nullif(regexp_extract({url}, '^https?://[^/:?# ]+(:\\d+)', 1), ''), '') END"
    )


DECODED = f"""
decoded0 AS (
 SELECT *, {IP} AS ip, {COUNTRY} AS country, {SITE_ID.format('s', 's')} AS site_id,
  {text('p')} AS path, coalesce(v = 'spa', false) AS is_spa,
  CASE WHEN v = 'spa' THEN 0 ELSE {number('v')} END AS interaction_ms,
  decode(TRY(from_base64(ref))) AS ref_url, {number('sw')} AS w, {number('sh')} AS h,
  {text('uc')} AS campaign
 FROM hits),
decoded AS (
 SELECT * EXCLUDE (ref_url), coalesce({origin('ref_url')}, 'direct_or_unknown') AS referrer,
  CASE WHEN coalesce(ck = '1', false) THEN CASE WHEN regexp_matches(cookie_ev, '^[0-9a-f]{{16}}$') THEN cookie_ev
    ELSE substr({hmac("'new|' || hit_id || '|' || (CASE WHEN ts = date_trunc('second', ts) THEN strftime(ts, '%Y-%m-%d %H:%M:%S') ELSE rtrim(strftime(ts, '%Y-%m-%d %H:%M:%S.%f'), '0') END)")}, 1, 16) END
   ELSE substr({hmac("ip || '|' || user_agent || '|' || site_id || '|' || CAST(CAST(ts AS DATE) AS VARCHAR)")}, 1, 16) END AS visitor_id,
  CAST(coalesce(ck = '1', false) AND coalesce(regexp_matches(cookie_ev, '^[0-9a-f]{{16}}$'), false) AS INT) AS is_returning
 FROM decoded0),
checked AS (
 SELECT *, CASE WHEN {KNOWN_BOT} THEN 'known_bot' WHEN site_id = 'smoke-test' THEN 'ignored_site'
  WHEN NOT coalesce(is_spa OR interaction_ms BETWEEN 800 AND 3600000, false) THEN 'interaction'
  WHEN NOT coalesce(starts_with(path, '/'), false) THEN 'path'
  WHEN visitor_id IN (SELECT visitor_id FROM excluded) THEN 'excluded' END AS reject_reason
 FROM decoded)"""


def anchored(source: str, key: str, order: str, seconds: int, name: str) -> str:
    """Anchored windows: each time points to the next start, and starts are the
    times reached from the first one."""
    return f"""
{name}_next AS (
 SELECT DISTINCT {key}, ts, min(ts) OVER (PARTITION BY {key} ORDER BY ts
  RANGE BETWEEN INTERVAL {seconds * 1_000_000 + 1} MICROSECOND FOLLOWING AND UNBOUNDED FOLLOWING) AS following FROM {source}),
{name}_starts AS (
 SELECT {key}, min(ts) AS s FROM {source} GROUP BY {key}
 UNION ALL
 SELECT st.{key}, n.following FROM {name}_starts st JOIN {name}_next n ON n.{key} = st.{key} AND n.ts = st.s
 WHERE n.following IS NOT NULL),
{name}_opened AS (
 SELECT h.*, max(st.s) OVER (PARTITION BY h.{key} ORDER BY h.ts) AS window_start
 FROM {source} h LEFT JOIN {name}_starts st ON st.{key} = h.{key} AND st.s = h.ts),
{name} AS (
 SELECT *, row_number() OVER (PARTITION BY {key}, window_start ORDER BY ts, {order}) AS n FROM {name}_opened)"""


def penalty(source: str, markers: str = "markers") -> str:
    def seen(kind: str, seconds: int) -> str:
        return (
            f"EXISTS (SELECT 1 FROM {markers} m WHERE m.ip = {source}.ip AND m.kind = '{kind}' "
            f"AND m.ts <= {source}.ts AND m.ts >= {source}.ts - INTERVAL {seconds} SECOND)"
        )

    return (
        f"CASE WHEN {seen('confirmed', SETTINGS.confirmed_seconds)} THEN 50 "
        f"WHEN {seen('suspected', SETTINGS.suspected_seconds)} THEN 20 ELSE 0 END"
    )


def quad(ip: str) -> str:
    parts = [f"CAST(split_part({ip}, '.', {i}) AS BIGINT) * {256 ** (4 - i)}" for i in (1, 2, 3, 4)]
    return f"CASE WHEN regexp_matches({ip}, '^\\d+\\.\\d+\\.\\d+\\.\\d+$') THEN {' + '.join(parts)} END"


def hextet(ip: str) -> str:
    """Third group of the test data's IPv6 addresses, the only one that varies."""
    return f"CASE WHEN starts_with({ip}, '2001:db8:') THEN CAST('0x' || split_part({ip}, ':', 3) AS BIGINT) END"


def merged(name: str, number: str, width: int) -> str:
    """Ranges of the prefixes and their merge, for prefixes of up to ``width`` bits."""
    return f"""
{name}_ranges AS (
 SELECT a - a % size AS lo, a - a % size + size - 1 AS hi FROM (
  SELECT {number} AS a, CAST(pow(2, {width} - bits) AS BIGINT) AS size FROM (
   SELECT cidr, CAST(split_part(cidr, '/', 2) AS INT) AS bits FROM prefixes) WHERE bits BETWEEN 0 AND {width}) WHERE a IS NOT NULL),
{name}_islands AS (
 SELECT lo, hi, sum(fresh) OVER (ORDER BY lo, hi) AS island FROM (
  SELECT lo, hi, CASE WHEN lo > max(hi) OVER (ORDER BY lo, hi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 1
   THEN 1 ELSE 0 END AS fresh FROM {name}_ranges)),
{name}_merged AS (SELECT min(lo) AS lo, max(hi) AS hi FROM {name}_islands GROUP BY island)"""


RANGES = (
    merged("v4", quad("split_part(cidr, '/', 1)"), 32) + "," + merged("v6", hextet("cidr"), 48)
)


def in_ranges(ip: str) -> str:
    bare = f"replace({ip}, '::ffff:', '')"
    return (
        f"(EXISTS (SELECT 1 FROM v4_ranges r WHERE {quad(bare)} BETWEEN r.lo AND r.hi) "
        f"OR EXISTS (SELECT 1 FROM v6_ranges r WHERE {hextet(ip)} BETWEEN r.lo AND r.hi))"
    )


CRAWLER = "regexp_matches(user_agent, '(?i)Feed[A-Z]heck|spider')"
AI = r"regexp_matches(user_agent, '(?i)U; And|C\+\+bot')"


def factors(pageview: bool, burst: str) -> dict[str, str]:
    cf = f"CASE WHEN {number('cf_bot_score')} BETWEEN 1 AND 99 THEN {number('cf_bot_score')} END"
    found = {
        "cf": f"CASE WHEN ({cf}) IS NULL THEN NULL WHEN cf_verified_bot = 'true' THEN 15 WHEN ({cf}) <= 2 THEN 50 "
        f"WHEN ({cf}) <= 29 THEN 30 WHEN ({cf}) <= 50 THEN 10 END",
        "timing": "CASE WHEN is_spa THEN NULL WHEN interaction_ms < 850 THEN 20 WHEN interaction_ms < 1000 THEN 8 END",
        "geo": "CASE WHEN country = 'CN' THEN 30 END",
        "geo_site": "CASE WHEN site_id = 'site-1' AND country IN ('NO','US') THEN 30 END",
        "burst": burst,
        "headers": "nullif(CASE WHEN accept_language IS NULL THEN 10 ELSE 0 END + "
        "CASE WHEN sec_ch_ua IS NULL AND sec_fetch_site IS NULL THEN 10 ELSE 0 END, 0)",
        "screen": "CASE WHEN (sw IS NOT NULL OR sh IS NOT NULL) AND (sw IS NULL OR sh IS NULL OR w <= 0 OR w > 10000 "
        "OR h <= 0 OR h > 10000) THEN 10 END",
        "referrer": "CASE WHEN referrer = 'direct_or_unknown' AND len([x FOR x IN string_split(path, '/') IF x <> '']) >= 2 THEN 5 END",
        "crawler_feed": f"CASE WHEN {CRAWLER} THEN 30 END",
        "ai_crawler_feed": f"CASE WHEN {AI} THEN 40 END",
        "datacenter_ip": f"CASE WHEN {in_ranges('ip')} THEN 15 END",
    }
    if not pageview:
        found = {k: v for k, v in found.items() if k not in ("timing", "screen", "referrer")}
    return {k: v for k, v in found.items() if v}


def scored(source: str, pageview: bool, burst: str = "", ip_penalty: str = "0") -> str:
    named = factors(pageview, burst)
    listed = ", ".join(f"{sql} AS f_{name}" for name, sql in named.items())
    total = " + ".join(f"coalesce(f_{name}, 0)" for name in named)
    detail = ", ".join(f"""'"{name}":' || f_{name}""" for name in named)
    return f"""
{source}_factors AS (
 SELECT *, {listed}, CASE WHEN pow_result <> 'valid' THEN 50 END AS f_pow, nullif({ip_penalty}, 0) AS f_bot_ip FROM {source}),
{source}_scored AS (
 SELECT *, least(least({total}, 100) + coalesce(f_pow, 0) + coalesce(f_bot_ip, 0), 100) AS bot_score,
  '{{' || concat_ws(',', {detail}, '"pow":' || f_pow, CASE WHEN f_pow IS NOT NULL THEN '"pow_result":"' || pow_result || '"' END,
   '"bot_ip":' || f_bot_ip) || '}}' AS bot_score_detail
 FROM {source}_factors)"""


BROWSER = (
    ("Edge", r"Edg(?:e|A|iOS)?/(\d+(?:\.\d+)*)"), ("Opera", r"(?:OPR|Opera)/(\d+(?:\.\d+)*)"),
    ("Samsung Browser", r"SamsungBrowser/(\d+(?:\.\d+)*)"), ("UC Browser", r"UCBrowser/(\d+(?:\.\d+)*)"),
    ("Chrome", r"(?:Chrome|CriOS)/(\d+(?:\.\d+)*)"), ("Firefox", r"(?:Firefox|FxiOS)/(\d+(?:\.\d+)*)"),
    ("Safari", r"Version/(\d+(?:\.\d+)*)\s.*Safari"),
)


def browser_case(result: str) -> str:
    arms = " ".join(
        f"WHEN regexp_matches(user_agent, '{rx}') THEN "
        + (f"'{name}'" if result == "name" else f"regexp_extract(user_agent, '{rx}', 1)")
        for name, rx in BROWSER
    )
    return f"CASE {arms} END"


def agent(rx: str) -> str:
    return f"regexp_extract(user_agent, '{rx}', 1)"


OS = rf"""CASE WHEN regexp_matches(user_agent, 'CPU (?:iPhone )?OS \d') THEN 'iOS ' || replace({agent(r'OS (\d+[_.]\d+(?:[_.]\d+)?)')}, '_', '.')
 WHEN regexp_matches(user_agent, 'Android \d') THEN 'Android ' || {agent(r'Android (\d+(?:\.\d+)?)')}
 WHEN contains(user_agent, 'Windows NT 10.0') THEN 'Windows 10/11' WHEN contains(user_agent, 'Windows NT 6.1') THEN 'Windows 7'
 WHEN regexp_matches(user_agent, 'Mac OS X \d') THEN 'macOS ' || replace({agent(r'Mac OS X (\d+[_.]\d+(?:[_.]\d+)?)')}, '_', '.')
 WHEN contains(user_agent, 'Linux') THEN 'Linux' END"""
REFERRER_TYPE = r"""CASE WHEN regexp_matches(referrer, '//(.*\.)?chat\.openai\.com(:|$)') THEN 'ai'
 WHEN regexp_matches(referrer, '//(.*\.)?google\.com(:|$)') THEN 'search'
 WHEN regexp_matches(referrer, '//(.*\.)?t\.co(:|$)') THEN 'social' ELSE 'direct_or_unknown' END"""

BURST = f"CASE WHEN n > {SETTINGS.burst_threshold} THEN 25 END"
VIEW_CTES = f"""RECURSIVE {{tables}}, {DECODED}, {RANGES},
accepted AS (SELECT * FROM checked WHERE reject_reason IS NULL),
{anchored('accepted', 'ip', 'hit_id', SETTINGS.burst_seconds, 'counted')},
{scored('counted', True, BURST, penalty('counted'))},
finished AS (
 SELECT c.*, {OS} AS os_name, {browser_case('name')} AS browser_name, {browser_case('version')} AS browser_version,
  CASE WHEN w BETWEEN 1 AND 10000 THEN w END AS screen_width, CASE WHEN w BETWEEN 1 AND 10000 THEN h END AS screen_height,
  CASE WHEN regexp_matches(sid, '^[0-9a-f-]{{36}}$') THEN sid END AS session_id,
  {REFERRER_TYPE} AS referrer_type, k.utm_campaign AS active
 FROM counted_scored c LEFT JOIN campaigns k ON k.status = 'active' AND k.site_id = c.site_id AND k.utm_campaign = c.campaign)"""
HIT_TABLES = ("hits", "excluded", "campaigns", "markers", "prefixes")


def utm(parameter: str, name: str) -> str:
    return f"CASE WHEN active IS NOT NULL THEN {text(parameter)} END AS {name}"


@lru_cache(maxsize=None)
def _published(app: str, sf: str) -> str:
    """Merged ranges are stored once per session, as the feed refresh does."""
    spark = SparkSession.getActiveSession() or SparkSession.builder.getOrCreate()
    path = shared_dir(spark, "ranges")
    threats.publish_ranges(table(spark, sf, "prefixes"), path)
    return path


def feeds(spark: SparkSession, sf: str) -> Feeds:
    path = _published(spark.sparkContext.applicationId, sf)
    ranges = [spark.read.parquet(f"{path}/{kind}") for kind in ("v4", "v6")]
    return Feeds(PATTERNS, AI_NAMES, *ranges)


def hashed(markers: DataFrame) -> DataFrame:
    return markers.select(ip_hash(SECRET, F.col("ip")).alias("ip_hash"), "kind", "ts")


def dims(spark: SparkSession, sf: str) -> enrich.Dimensions:
    return enrich.Dimensions(
        campaigns=table(spark, sf, "campaigns"),
        excluded=table(spark, sf, "excluded"),
        markers=hashed(table(spark, sf, "markers")),
        feeds=feeds(spark, sf),
    )


def pageviews(spark: SparkSession, sf: str) -> enrich.Pageviews:
    return enrich.enrich_hits(
        table(spark, sf, "hits"), dims(spark, sf), SETTINGS, stage_dir=shared_dir(spark, "hits")
    )


def as_double(df: DataFrame, *names: str) -> DataFrame:
    """Whole numbers that may be missing, as doubles in both engines."""
    return df.withColumns({n: F.col(n).cast("double") for n in names})


VIEWS_SQL = f"""SELECT hit_id AS id, visitor_id, path, site_id, session_id, interaction_ms, CAST(screen_width AS DOUBLE) AS screen_width,
      CAST(screen_height AS DOUBLE) AS screen_height,
      CASE WHEN screen_width < 768 THEN 'mobile' WHEN screen_width <= 1024 THEN 'tablet' WHEN screen_width > 1024 THEN 'desktop' END AS device_type,
      os_name, browser_name, browser_version, country AS country_code, is_returning, referrer, referrer_type, bot_score, bot_score_detail,
      CAST(coalesce(pwa = '1', false) AS INT) AS is_pwa, {utm('us', 'utm_source')}, {utm('um', 'utm_medium')}, active AS utm_campaign,
      {utm('uct', 'utm_content')}, {utm('ut', 'utm_term')}, {when('ts')} AS created_at
     FROM finished WHERE bot_score < 90"""
register(
    "J04_pageviews",
    lambda spark, sf: as_double(pageviews(spark, sf).views, "screen_width", "screen_height"),
    VIEWS_SQL,
    *HIT_TABLES,
    before=VIEW_CTES,
)
register(
    "J04_prints",
    lambda spark, sf: pageviews(spark, sf).prints.select(
        "ip_hash", "visitor_id", "site_id", "fingerprint.*", "headless_tainted", "ts"
    ),
    f"""SELECT {hmac('ip')} AS ip_hash, visitor_id, site_id, coalesce(os_name,'unknown') AS os_name,
      coalesce(browser_name,'unknown') AS browser_name, coalesce(browser_version,'unknown') AS browser_version,
      CAST(coalesce(screen_width,0) AS INT) AS screen_width, CAST(coalesce(screen_height,0) AS INT) AS screen_height,
      coalesce(country,'unknown') AS country_code, coalesce(accept_language,'unknown') AS accept_language,
      coalesce(f_bot_ip,0) >= 50 AS headless_tainted, {when('f.ts')} AS ts FROM finished f""",
    *HIT_TABLES,
    before=VIEW_CTES,
)
register(
    "J04_rejects",
    lambda spark, sf: pageviews(spark, sf).rejects,
    f"""SELECT hit_id, {when('c.ts')} AS ts, reject_reason FROM checked c WHERE reject_reason IS NOT NULL
     UNION ALL SELECT hit_id, {when('f.ts')}, 'discarded' FROM finished f WHERE bot_score >= 90""",
    *HIT_TABLES,
    before=VIEW_CTES,
)
register(
    "J08_bot_score",
    lambda spark, sf: scoring.with_bot_score(
        threats.with_threat_flags(
            enrich.decode_hits(table(spark, sf, "hits"), SETTINGS),
            feeds(spark, sf),
        ),
        SETTINGS,
    ).select("hit_id", "bot_score", "bot_score_detail"),
    "SELECT hit_id, bot_score, bot_score_detail FROM decoded_scored",
    "hits", "prefixes",
    before=f"{{tables}}, {DECODED.split('checked AS')[0].rstrip().rstrip(',')}, {RANGES}, {scored('decoded', True)}",
)

# --- event posts --------------------------------------------------------------------------

# of a name given twice the last counts
SENT_SITE = """coalesce(list_last(regexp_extract_all(body, '"siteId":"([^"]*)"', 1)), 'default')"""
BURST_OPEN = f"INTERVAL {SETTINGS.burst_seconds} SECOND"
POSTS = f"""RECURSIVE {{tables}}, {DECODED}, {RANGES},
accepted AS (SELECT * FROM checked WHERE reject_reason IS NULL),
{anchored('accepted', 'ip', 'hit_id', SETTINGS.burst_seconds, 'counted')},
parsed AS (
 SELECT p.*, TRY_CAST(body AS JSON) AS j, {IP} AS ip, {COUNTRY} AS country FROM posts p),
posted AS (
 SELECT *, {SITE_ID.format(SENT_SITE, SENT_SITE)} AS site_id FROM parsed),
known AS (
 SELECT *, CASE WHEN regexp_matches(cookie_ev, '^[0-9a-f]{{16}}$') THEN cookie_ev ELSE
   substr({hmac("ip || '|' || user_agent || '|' || site_id || '|' || CAST(CAST(ts AS DATE) AS VARCHAR)")}, 1, 16) END AS visitor_id,
  CAST(coalesce(regexp_matches(cookie_ev, '^[0-9a-f]{{16}}$'), false) AS INT) AS is_returning
 FROM posted),
tested AS (
 SELECT *, CASE WHEN {KNOWN_BOT} THEN 'known_bot' WHEN j IS NULL THEN 'invalid_json'
  WHEN coalesce(json_array_length(j, '$.events'), 0) = 0 THEN 'no_events' WHEN site_id = 'smoke-test' THEN 'ignored_site'
  WHEN visitor_id IN (SELECT visitor_id FROM excluded) THEN 'excluded' END AS reject_reason FROM known),
open_at AS (
 SELECT k.post_id, arg_max({{'n': c.n, 'w': c.window_start}}, {{'t': c.ts, 'n': c.n, 'w': c.window_start}}) AS st
 FROM tested k JOIN counted c ON c.ip = k.ip AND c.ts <= k.ts AND c.ts >= k.ts - {BURST_OPEN} GROUP BY k.post_id),
kept AS (
 SELECT t.*, CASE WHEN st.w >= t.ts - {BURST_OPEN} THEN st.n ELSE 0 END AS n
 FROM tested t LEFT JOIN open_at o ON o.post_id = t.post_id WHERE reject_reason IS NULL),
{scored('kept', False, BURST, penalty('kept'))},
listed AS (
 SELECT *, unnest(CAST(j->'$.events' AS JSON[])) AS e, generate_subscripts(CAST(j->'$.events' AS JSON[]), 1) - 1 AS position
 FROM kept_scored WHERE bot_score < 90),
single AS (
 SELECT *, CASE WHEN position >= 20 THEN 'too_many_events' WHEN coalesce(json_type(e), '') <> 'OBJECT' THEN 'not_an_object'
  WHEN coalesce(e->>'$.type', '') NOT IN ('click', 'custom', 'hover') THEN 'unknown_type'
  WHEN length(CAST(e->'$.data' AS VARCHAR)) > 2048 THEN 'data_too_long' END AS event_reason FROM listed)"""
POST_TABLES = ("posts", "excluded", "campaigns", "markers", "prefixes")


def counted_hits(spark: SparkSession, sf: str) -> DataFrame:
    """Burst windows of the accepted pageview hits."""
    checked = enrich.check_hits(enrich.decode_hits(table(spark, sf, "hits"), SETTINGS), dims(spark, sf), SETTINGS)
    accepted = checked.filter("reject_reason IS NULL").select("hit_id", "ip", "ts")
    # windows look at the hits three times: they are decoded and checked once before that
    return enrich.burst_windows(written(accepted, "accepted"), SETTINGS)


def accepted_posts(spark: SparkSession, sf: str) -> posts.Events:
    return posts.enrich_posts(
        table(spark, sf, "posts"), dims(spark, sf), SETTINGS,
        counted_hits=counted_hits(spark, sf), stage_dir=shared_dir(spark, "posts"),
    )


EVENTS_SQL = f"""SELECT (post_id * 1024 + position) * 2 AS id, e->>'$.type' AS event_type, s.site_id,
      CASE WHEN regexp_matches(e->>'$.sessionId', '^[0-9a-f-]{{36}}$') THEN e->>'$.sessionId' END AS session_id, visitor_id,
      coalesce(CAST(e->'$.data' AS VARCHAR), '{{}}') AS data, e->>'$.data.experiment_id' AS experiment_id, e->>'$.data.variant_id' AS variant_id,
      k.utm_campaign, CASE WHEN sec_ch_ua_mobile = '?1' THEN 'mobile' WHEN sec_ch_ua_mobile = '?0' THEN 'desktop'
       WHEN regexp_matches(user_agent, '(?i)mobile|android|iphone|ipad') THEN 'mobile' ELSE 'desktop' END AS device_type,
      {origin('referer')} AS referrer, CAST(extract(hour FROM ts) AS INT) AS hour, CAST(extract(month FROM ts) AS INT) AS month,
      CAST(dayofweek(ts) AS INT) AS day_of_week, is_returning, bot_score, bot_score_detail, {when('ts')} AS created_at
     FROM single s LEFT JOIN campaigns k ON k.status = 'active' AND k.site_id = s.site_id AND k.utm_campaign = e->>'$.utmCampaign'
     WHERE event_reason IS NULL"""
register(
    "J05_events",
    lambda spark, sf: accepted_posts(spark, sf).events,
    EVENTS_SQL,
    *POST_TABLES,
    before=POSTS,
)
register(
    "J05_event_rejects",
    lambda spark, sf: accepted_posts(spark, sf).event_rejects,
    f"""SELECT post_id, {when('s.ts')} AS ts, CAST(position AS INT) AS position, event_reason AS reject_reason
     FROM single s WHERE event_reason IS NOT NULL""",
    *POST_TABLES,
    before=POSTS,
)
register(
    "J05_rejects",
    lambda spark, sf: accepted_posts(spark, sf).rejects,
    f"""SELECT post_id, {when('t.ts')} AS ts, reject_reason FROM tested t WHERE reject_reason IS NOT NULL
     UNION ALL SELECT post_id, {when('t.ts')}, 'discarded' FROM kept_scored t WHERE bot_score >= 90""",
    *POST_TABLES,
    before=POSTS,
)

# --- API batches and metrics ---------------------------------------------------------------

UUID = "'(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$'"
BATCHED = f"""{{tables}},
parsed AS (SELECT *, TRY_CAST(body AS JSON) AS j FROM batches),
judged AS (
 SELECT *, CASE WHEN j IS NULL THEN 'Invalid JSON'
  WHEN coalesce(json_type(j, '$.v'), '') NOT IN ('UBIGINT', 'DOUBLE') OR coalesce(j->>'$.v', '') NOT IN ('1', '1.0') THEN 'Unsupported protocol version'
  WHEN NOT regexp_matches(j->>'$.batch_id', {UUID}) THEN 'Invalid batch_id'
  WHEN NOT regexp_matches(j->>'$.context.session_id', {UUID}) THEN 'Invalid session_id'
  WHEN NOT regexp_matches(j->>'$.events[0].type', '^[a-zA-Z_][a-zA-Z0-9_]*$') THEN 'Invalid event type: ' || (j->>'$.events[0].type')
  END AS message FROM parsed),
listed AS (
 SELECT raw_id, received_at, j, unnest(CAST(j->'$.events' AS JSON[])) AS e, generate_subscripts(CAST(j->'$.events' AS JSON[]), 1) AS pos
 FROM judged WHERE message IS NULL),
sent AS (SELECT *, e->>'$.event_id' AS event_id FROM listed),
firsts AS (SELECT * FROM sent QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY received_at, raw_id, pos) = 1)"""
SESSION_CONTEXT = '"session_context":{"device_class":"desktop","viewport":"800x600","screen":"1920x1080","language":"en"}'
# purchases keep their text unless it has a name of ours; clicks always have one, and their members go in order
SENT_DATA = f"""CASE WHEN e->>'$.type' = 'click' THEN '{{"a":"qé","b":{{"c":[1,"2"]}},"experiment_id":"exp-2","variant_id":null,'
  ELSE '{{"amount":' || (e->>'$.data.amount') || CASE
   WHEN e->>'$.experiments[0].experiment_id' IS NOT NULL THEN ',"experiment_id":"exp-1","variant_id":"b"'
   WHEN e->>'$.data.experiment_id' IS NOT NULL THEN ',"experiment_id":"own"' ELSE '' END || ',' END || '{SESSION_CONTEXT}}}'"""
INGESTED_SQL = f"""SELECT event_id, CASE e->>'$.type' WHEN 'click' THEN '2024-01-02' ELSE '2024-01-01' END || ' 00:00:00.000000' AS event_ts, (raw_id * 1024 + pos - 1) * 2 + 1 AS id, e->>'$.type' AS event_type,
      coalesce(j->>'$.context.site_id', 'default') AS site_id, j->>'$.context.session_id' AS session_id, CAST(NULL AS VARCHAR) AS visitor_id,
      {SENT_DATA} AS data,
      e->>'$.experiments[0].experiment_id' AS experiment_id, e->>'$.experiments[0].variant_id' AS variant_id,
      CAST(NULL AS VARCHAR) AS utm_campaign, j->>'$.context.device_class' AS device_type, CAST(NULL AS VARCHAR) AS referrer,
      CAST(extract(hour FROM received_at) AS INT) AS hour, CAST(extract(month FROM received_at) AS INT) AS month,
      CAST(dayofweek(received_at) AS INT) AS day_of_week, 0 AS is_returning, -1 AS bot_score,
      '{{"source":"api_ingest"}}' AS bot_score_detail, {when('received_at')} AS created_at FROM firsts"""
register(
    "J06_ingested_events",
    lambda spark, sf: ingest.ingest_batches(table(spark, sf, "batches")).events,
    INGESTED_SQL,
    "batches",
    before=BATCHED,
)
register(
    "J06_rejected_batches",
    lambda spark, sf: ingest.ingest_batches(table(spark, sf, "batches")).rejects,
    "SELECT raw_id, message FROM judged WHERE message IS NOT NULL",
    "batches",
    before=BATCHED,
)
register(
    "J06_batch_counts",
    lambda spark, sf: ingest.ingest_batches(table(spark, sf, "batches")).counts,
    """SELECT s.raw_id, count(f.raw_id) AS accepted, count(*) - count(f.raw_id) AS duplicate
     FROM sent s LEFT JOIN firsts f ON f.raw_id = s.raw_id AND f.pos = s.pos GROUP BY s.raw_id""",
    "batches",
    before=BATCHED,
)
METRIC_POSTS = """{tables},
parsed AS (SELECT *, TRY_CAST(body AS JSON) AS j FROM metric_posts),
judged AS (
 SELECT *, CASE WHEN json_type(j) <> 'ARRAY' THEN 'Expected array of metrics (max 100)'
  WHEN j->>'$[0].category' = '' THEN 'Each metric requires category (string), metric (string), value (number), unit (string)'
  END AS message FROM parsed)"""
register(
    "J07_perf_ingest",
    lambda spark, sf: ingest.ingest_metrics(table(spark, sf, "metric_posts")).events,
    f"""SELECT raw_id, i AS position, {when('received_at')} AS recorded_at, m->>'$.category' AS category, m->>'$.metric' AS metric,
      m->>'$.unit' AS unit, m->>'$.commit_hash' AS commit_hash, m->>'$.branch' AS branch, CAST(m->>'$.value' AS DOUBLE) AS value,
      CAST(NULL AS VARCHAR) AS metadata
     FROM (SELECT raw_id, received_at, CAST(i AS INT) AS i, j->('$[' || i || ']') AS m FROM judged, range(2) r(i) WHERE message IS NULL)""",
    "metric_posts",
    before=METRIC_POSTS,
)
register(
    "J07_perf_rejects",
    lambda spark, sf: ingest.ingest_metrics(table(spark, sf, "metric_posts")).rejects,
    "SELECT raw_id, message FROM judged WHERE message IS NOT NULL",
    "metric_posts",
    before=METRIC_POSTS,
)

# --- correlation ------------------------------------------------------------------------------

WINDOW = 10 * 86_400
QUIET = (12 * 3600, 10 * 86_400)


def prints(spark: SparkSession, sf: str) -> DataFrame:
    fields = (
        "os_name", "browser_name", "browser_version", "screen_width", "screen_height",
        "country_code", "accept_language",
    )
    return table(spark, sf, "prints").select(
        "ip_hash", "visitor_id", "site_id", F.struct(*fields).alias("fingerprint"),
        "headless_tainted", "ts",
    )


def sweep(spark: SparkSession, sf: str) -> correlate.Sweep:
    return correlate.sweep(
        table(spark, sf, "views"),
        table(spark, sf, "sem_events"),
        prints(spark, sf),
        as_of=as_of(sf),
        window_seconds=WINDOW,
        min_seconds=QUIET[0],
        max_seconds=QUIET[1],
    )


def marked(marker: str, value: str) -> str:
    return (
        f"""CASE WHEN coalesce(bot_score_detail, '{{}}') = '{{}}' THEN '{{"{marker}":' || {value} || '}}' """
        f"""ELSE left(bot_score_detail, length(bot_score_detail) - 1) || ',"{marker}":' || {value} || '}}' END"""
    )


def unmarked(marker: str) -> str:
    return f"""(bot_score_detail IS NULL OR bot_score_detail NOT LIKE '%"{marker}"%')"""


JUDGED = f"""{{tables}},
judged AS (
 SELECT * REPLACE (CASE WHEN quiet THEN {marked('no_events', "'true'")} ELSE bot_score_detail END AS bot_score_detail,
  CASE WHEN quiet THEN least(bot_score + 15, 100) ELSE bot_score END AS bot_score) FROM (
  SELECT v.*, created_at >= {NOW} - INTERVAL {QUIET[1]} SECOND AND created_at <= {NOW} - INTERVAL {QUIET[0]} SECOND
   AND {CLEAN} AND {unmarked('no_events')} AND NOT EXISTS (
    SELECT 1 FROM sem_events e WHERE e.visitor_id = v.visitor_id AND e.site_id = v.site_id) AS quiet FROM views v)),
recent AS (
 SELECT *, concat_ws('|', os_name, browser_name, browser_version, screen_width || 'x' || screen_height, country_code, accept_language) AS fp
 FROM prints WHERE ts >= {NOW} - INTERVAL {WINDOW} SECOND),
clusters AS (
 SELECT site_id, fp, count(DISTINCT ip_hash) AS size, bool_or(headless_tainted) AS tainted, min(ts) AS first_ts
 FROM recent GROUP BY site_id, fp HAVING count(DISTINCT ip_hash) >= CASE WHEN bool_or(headless_tainted) THEN 4 ELSE 6 END),
hits_of AS (
 SELECT DISTINCT r.site_id, r.visitor_id, c.fp, c.first_ts, CASE WHEN tainted OR size >= 8 THEN 50 ELSE 30 END AS penalty,
  '{{"reason":"correlated","penalty":' || CASE WHEN tainted OR size >= 8 THEN 50 ELSE 30 END || ',"cluster_size":' || size
  || ',"tainted":' || tainted || ',"fingerprint":"' || c.fp || '"}}' AS info
 FROM recent r JOIN clusters c ON c.site_id = r.site_id AND c.fp = r.fp),
penalties AS (
 SELECT * FROM hits_of QUALIFY row_number() OVER (PARTITION BY site_id, visitor_id ORDER BY first_ts, fp) = 1)"""


def penalised(source: str) -> str:
    hit = f"p.penalty IS NOT NULL AND {CLEAN} AND {unmarked('correlated')}"
    return f"""SELECT id, CASE WHEN {hit} THEN least(bot_score + p.penalty, 100) ELSE bot_score END AS bot_score,
      CASE WHEN {hit} THEN {marked('correlated', 'p.info')} ELSE bot_score_detail END AS bot_score_detail
     FROM {source} f LEFT JOIN penalties p ON p.site_id = f.site_id AND p.visitor_id = f.visitor_id"""


SCORE = ("id", "bot_score", "bot_score_detail")
SWEEP_TABLES = ("views", "sem_events", "prints")
register(
    "J09_sweep_views",
    lambda spark, sf: sweep(spark, sf).views.select(*SCORE),
    penalised("judged"),
    *SWEEP_TABLES,
    before=JUDGED,
)
register(
    "J09_sweep_events",
    lambda spark, sf: sweep(spark, sf).events.select(*SCORE),
    penalised("sem_events"),
    *SWEEP_TABLES,
    before=JUDGED,
)
register(
    "J09_confirmed_addresses",
    lambda spark, sf: sweep(spark, sf).confirmed,
    f"""SELECT DISTINCT ip_hash, 'confirmed' AS kind, {when(NOW)} AS ts
     FROM recent r JOIN clusters c ON c.site_id = r.site_id AND c.fp = r.fp""",
    *SWEEP_TABLES,
    before=JUDGED,
)
register(
    "J09_touched_partitions",
    lambda spark, sf: correlate.touched_partitions(table(spark, sf, "views"), sweep(spark, sf).penalties),
    f"""SELECT site_id, strftime(created_at, '%Y-%m-%d') AS event_date, count(*) AS rows
     FROM views v WHERE {CLEAN} AND {unmarked('correlated')} AND EXISTS (
      SELECT 1 FROM penalties p WHERE p.site_id = v.site_id AND p.visitor_id = v.visitor_id) GROUP BY ALL""",
    *SWEEP_TABLES,
    before=JUDGED,
)


def swept_again(spark: SparkSession, sf: str) -> DataFrame:
    """Stored views after a sweep of the stored tables."""
    base = shared_dir(spark, "facts")
    append_facts(table(spark, sf, "views"), f"{base}/views")
    append_facts(table(spark, sf, "sem_events"), f"{base}/events")
    correlate.sweep_stored(
        spark, f"{base}/views", f"{base}/events", prints(spark, sf), stage_dir=f"{base}/stage",
        as_of=as_of(sf), window_seconds=WINDOW, min_seconds=QUIET[0], max_seconds=QUIET[1],
    )
    return read_table(spark, f"{base}/views", "visitor_views").select(*SCORE)


register("J09_stored_views", swept_again, penalised("judged"), *SWEEP_TABLES, before=JUDGED)


def in_batches(df: DataFrame, path: str, batches: int = 3) -> None:
    """The rows as a stream of micro-batches would have stored them."""
    for batch in range(batches):
        write_facts(df.where(F.pmod(F.xxhash64("id"), F.lit(batches)) == batch), path, batch)


def swept_by_filter(spark: SparkSession, sf: str) -> DataFrame:
    """Stored views after a sweep that opens only folders that may hold its visitors."""
    base = shared_dir(spark, "facts")
    in_batches(table(spark, sf, "views"), f"{base}/views")
    in_batches(table(spark, sf, "sem_events"), f"{base}/events")
    correlate.sweep_stored(
        spark, f"{base}/views", f"{base}/events", prints(spark, sf), stage_dir=f"{base}/stage",
        as_of=as_of(sf), window_seconds=WINDOW, min_seconds=QUIET[0], max_seconds=QUIET[1],
    )
    return read_facts(spark, f"{base}/views").select(*SCORE)


def compacted(spark: SparkSession, sf: str) -> DataFrame:
    """Stored views after two compactions, with batches before, between and after them."""
    path, views = f"{shared_dir(spark, 'facts')}/views", table(spark, sf, "views")
    part = F.pmod(F.xxhash64("id"), F.lit(7))
    for batch in range(7):
        write_facts(views.where(part == batch), path, batch)
        if batch in (3, 5):
            compact.compact(spark, path, target_bytes=100_000, kept_batches=1)
    return read_facts(spark, path).select("id", "visitor_id", "site_id", "path", "bot_score", "created_at")


register(
    "S08_compacted", compacted,
    f"SELECT id, visitor_id, site_id, path, bot_score, {when('created_at')} AS created_at FROM views", "views",
)
register("J09_filtered_views", swept_by_filter, penalised("judged"), *SWEEP_TABLES, before=JUDGED)


def feedback(spark: SparkSession, sf: str) -> DataFrame:
    """Views scored with the markers of a sweep over the prints of the same hits."""
    first = pageviews(spark, sf)
    recent = correlate.recent_prints(first.prints, as_of=as_of(sf, "hits", "ts"), seconds=WINDOW)
    found = correlate.confirmed_markers(recent, correlate.find_clusters(recent), as_of(sf, "hits", "ts") - timedelta(days=1))
    again = replace(dims(spark, sf), markers=found)
    views = enrich.enrich_hits(table(spark, sf, "hits"), again, SETTINGS, stage_dir=shared_dir(spark, "hits"), before=first).views
    return views.select(*SCORE)


HIT_NOW = "(SELECT max(ts) FROM hits)"
FEEDBACK = f"""{VIEW_CTES},
printed AS (
 SELECT ip, site_id, ts, coalesce(f_bot_ip, 0) >= 50 AS tainted, concat_ws('|', coalesce(os_name, 'unknown'), coalesce(browser_name, 'unknown'),
  coalesce(browser_version, 'unknown'), coalesce(screen_width, 0) || 'x' || coalesce(screen_height, 0), coalesce(country, 'unknown'),
  coalesce(accept_language, 'unknown')) AS fp FROM finished WHERE ts >= {HIT_NOW} - INTERVAL {WINDOW} SECOND),
grouped AS (
 SELECT site_id, fp FROM printed GROUP BY site_id, fp HAVING count(DISTINCT ip) >= CASE WHEN bool_or(tainted) THEN 4 ELSE 6 END),
found AS (
 SELECT DISTINCT ip, 'confirmed' AS kind, {HIT_NOW} - INTERVAL 1 DAY AS ts FROM printed JOIN grouped USING (site_id, fp)),
twice AS (SELECT * FROM counted),
{scored('twice', True, BURST, penalty('twice', 'found'))}"""
register(
    "J09_feedback",
    feedback,
    "SELECT hit_id AS id, bot_score, bot_score_detail FROM twice_scored WHERE bot_score < 90",
    *HIT_TABLES,
    before=FEEDBACK,
)
register(
    "J10_no_event_penalty",
    lambda spark, sf: correlate.penalise_no_events(
        table(spark, sf, "views"), table(spark, sf, "sem_events"),
        as_of=as_of(sf), min_seconds=QUIET[0], max_seconds=QUIET[1],
    ).select(*SCORE),
    "SELECT id, bot_score, bot_score_detail FROM judged",
    *SWEEP_TABLES,
    before=JUDGED,
)

# --- anonymisation ------------------------------------------------------------------------------

PRIVATE = Settings(secret=SECRET, anonymize_sites=("Site-1",))


def daily_key(value: str) -> str:
    return hmac(f"strftime(created_at, '%Y-%m-%d') || '|' || {value}")


def slot(digits: str, start: int, length: int) -> str:
    return f"CAST('0x' || substr({digits}, {start}, {length}) AS BIGINT)"


def picked(value: str, pool: str) -> str:
    number = f"{slot(daily_key(value), 1, 8)} % {anonymize.POOLS[pool]}"
    return f"'{pool}-' || lpad(CAST({number} AS VARCHAR), 2, '0')"


def alias(value: str, pool: str) -> str:
    return f"CASE WHEN {value} <> '' THEN {picked(value, pool)} END"


def private(**columns: str) -> str:
    return ", ".join(
        f"CASE WHEN site_id = 'site-1' THEN {sql} ELSE {name} END AS {name}"
        for name, sql in columns.items()
    )


TERMINAL = ", ".join(f"{{'w': {w}, 'h': {h}}}" for w, h, _ in anonymize.TERMINALS)
SIZE = daily_key("coalesce(screen_width,0) || 'x' || coalesce(screen_height,0)")
SCREEN = f"CASE WHEN screen_width IS NOT NULL OR screen_height IS NOT NULL THEN ([{TERMINAL}])[1 + {slot(SIZE, 1, 8)} % 16] END"
DEVICE = "CASE device_type WHEN 'desktop' THEN 'large' WHEN 'tablet' THEN 'medium' WHEN 'mobile' THEN 'small' END"
register(
    "J11_anonymised_views",
    lambda spark, sf: as_double(
        anonymize.anonymize_views(table(spark, sf, "views"), PRIVATE),
        "interaction_ms", "screen_width", "screen_height",
    ),
    f"""SELECT id, {private(
        visitor_id=f"substr({daily_key('visitor_id')}, 1, 16)",
        path=f"'/' || array_to_string([{picked('x', 'word')} FOR x IN string_split(path, '/') IF x <> ''], '/')",
        session_id=alias('session_id', 'session'), country_code=alias('country_code', 'country'),
        os_name=alias('os_name', 'os'), device_type=DEVICE,
        browser_name=f"CASE WHEN browser_name <> '' THEN 'browser-' || ({slot(daily_key('browser_name'), 1, 8)} % 24) || '-' || ({slot(daily_key('browser_name'), 9, 8)} % 16) END",
        browser_version=f"CASE WHEN browser_version <> '' THEN ({slot(daily_key('browser_version'), 1, 4)} % 150 + 1) || '.' || ({slot(daily_key('browser_version'), 5, 2)} % 10) END",
        referrer=f"CASE WHEN referrer <> '' THEN 'https://referrer.invalid/' || {picked('referrer', 'referrer')} || '-' || substr({daily_key('referrer')}, 1, 4) END",
        **{u: alias(u, 'word') for u in ('utm_source', 'utm_medium', 'utm_campaign', 'utm_content', 'utm_term')},
     )}, site_id, CAST(interaction_ms AS DOUBLE) AS interaction_ms,
      CAST(CASE WHEN site_id = 'site-1' THEN ({SCREEN}).w ELSE screen_width END AS DOUBLE) AS screen_width,
      CAST(CASE WHEN site_id = 'site-1' THEN ({SCREEN}).h ELSE screen_height END AS DOUBLE) AS screen_height,
      is_returning, referrer_type, bot_score, bot_score_detail, is_pwa, {when('v.created_at')} AS created_at
     FROM views v""",
    "views",
)
KEPT = """CASE event_type WHEN 'click' THEN '{"tag":"A","path":' || CAST(CAST(data AS JSON)->'$.path' AS VARCHAR) || '}' WHEN 'form_submit'
 THEN '{"path":' || CAST(CAST(data AS JSON)->'$.path' AS VARCHAR) || '}' ELSE '{}' END"""
register(
    "J11_anonymised_events",
    lambda spark, sf: anonymize.anonymize_events(table(spark, sf, "sem_events"), PRIVATE),
    f"""SELECT id, event_type, site_id, {private(
        session_id=alias('session_id', 'session'), visitor_id=f"substr({daily_key('visitor_id')}, 1, 16)", data=KEPT,
        experiment_id=f"CASE WHEN experiment_id <> '' THEN 'experiment-' || substr({daily_key('experiment_id')}, 1, 8) END",
        variant_id=f"CASE WHEN variant_id <> '' THEN 'variant-' || substr({daily_key('variant_id')}, 1, 8) END",
        utm_campaign=alias('utm_campaign', 'word'), device_type=DEVICE)},
      referrer, hour, month, day_of_week, is_returning, bot_score, bot_score_detail, {when('e.created_at')} AS created_at
     FROM sem_events e""",
    "sem_events",
)

# --- threat feeds ----------------------------------------------------------------------------------

register(
    "J12_threat_flags",
    lambda spark, sf: threats.with_threat_flags(
        table(spark, sf, "hits").withColumn("ip", client_ip(SETTINGS)),
        feeds(spark, sf),
    ).select("hit_id", "ip", "crawler_match", "ai_crawler_match", "datacenter_ip"),
    f"""SELECT hit_id, ip, {CRAWLER} AS crawler_match, {AI} AS ai_crawler_match, {in_ranges('ip')} AS datacenter_ip
     FROM (SELECT *, {IP} AS ip FROM hits) h""",
    "hits", "prefixes",
    before=f"{{tables}}, {RANGES}",
)
def guarded(spark: SparkSession, sf: str) -> DataFrame:
    old = table(spark, sf, "prefixes")
    of = lambda p: old.filter(F.col("provider") == p)
    fresh = {"aws": of("aws").filter("cidr LIKE '10.0.0.1%'"), "gcp": of("gcp").filter("cidr LIKE '203.%'")}
    return threats.accept_feeds(fresh, old, shrink=0.2)


register(
    "U05_feed_guard",
    guarded,
    """, fresh AS (SELECT * FROM prefixes WHERE (provider = 'aws' AND cidr LIKE '10.0.0.1%') OR (provider = 'gcp' AND cidr LIKE '203.%')),
     taken AS (SELECT o.provider, (SELECT count(*) FROM fresh f WHERE f.provider = o.provider) AS n, count(*) AS m FROM prefixes o GROUP BY 1)
     SELECT f.provider, f.cidr FROM fresh f JOIN taken t USING (provider) WHERE n > 0 AND n >= 0.2 * m
     UNION ALL SELECT o.provider, o.cidr FROM prefixes o JOIN taken t USING (provider) WHERE NOT (n > 0 AND n >= 0.2 * m)""",
    "prefixes",
)
register(
    "J13_merged_ranges",
    lambda spark, sf: threats.merged_v4(table(spark, sf, "prefixes")),
    "SELECT lo, hi FROM v4_merged",
    "prefixes",
    before=f"{{tables}}, {RANGES}",
)
register(
    "J13_merged_ranges_v6",
    lambda spark, sf: threats.merged_v6(table(spark, sf, "prefixes")),
    f"""SELECT '020010db8' || lpad(lower(to_hex(lo)), 4, '0') || '{'0' * 20}' AS lo,
      '020010db8' || lpad(lower(to_hex(hi)), 4, '0') || '{'f' * 20}' AS hi FROM v6_merged""",
    "prefixes",
    before=f"{{tables}}, {RANGES}",
)

# --- sessions, vitals, assignment ---------------------------------------------------------------------

register(
    "J14_session_campaigns",
    lambda spark, sf: sessions.session_navigations(table(spark, sf, "navigations")),
    f""", moved AS (
      SELECT * FROM navigations n QUALIFY session_id IS NULL
       OR path IS DISTINCT FROM lag(path) OVER (PARTITION BY session_id ORDER BY n.ts, id)),
     carried AS (
      SELECT id, session_id, ts, path, last_value(CASE WHEN utm_campaign IS NOT NULL THEN {{'c': utm_campaign, 's': utm_source}} END IGNORE NULLS)
       OVER (PARTITION BY session_id, CASE WHEN session_id IS NULL THEN id END ORDER BY ts, id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS u FROM moved)
     SELECT id, session_id, {when('c.ts')} AS ts, path, u.c AS utm_campaign, u.s AS utm_source FROM carried c""",
    "navigations",
)
register(
    "J15_vital_ratings",
    lambda spark, sf: sessions.vital_ratings(table(spark, sf, "vitals")),
    """SELECT metric, CASE metric WHEN 'LCP' THEN CASE WHEN v <= 2500 THEN 'good' WHEN v <= 4000 THEN 'needs-improvement' ELSE 'poor' END
       WHEN 'CLS' THEN CASE WHEN v <= 100 THEN 'good' WHEN v <= 250 THEN 'needs-improvement' ELSE 'poor' END
       WHEN 'INP' THEN CASE WHEN v <= 200 THEN 'good' WHEN v <= 500 THEN 'needs-improvement' ELSE 'poor' END ELSE 'unknown' END AS rating,
      count(*) AS count
     FROM (SELECT data->>'$.metric' AS metric, CAST(data->>'$.value' AS DOUBLE) AS v FROM vitals) GROUP BY 1, 2""",
    "vitals",
)


def share_hash(purpose: str) -> str:
    return f"CAST('0x' || substr(sha256('{purpose}|' || experiment_id || '|' || visitor_id), 1, 8) AS BIGINT)"


register(
    "J16_variant_assignment",
    lambda spark, sf: experiments.assign_variants(
        table(spark, sf, "sem_events").filter("experiment_id IS NOT NULL"),
        table(spark, sf, "experiments"),
        table(spark, sf, "variants"),
    ),
    f""", asked AS (SELECT DISTINCT e.visitor_id, x.experiment_id, x.allocation_percent FROM sem_events e
       JOIN experiments x ON x.experiment_id = e.experiment_id WHERE x.status = 'active'),
     weights AS (SELECT experiment_id, variant_id, sum(weight) OVER (PARTITION BY experiment_id ORDER BY variant_id) AS upto,
       sum(weight) OVER (PARTITION BY experiment_id) AS total, weight FROM variants),
     slots AS (SELECT *, {share_hash('variant')} % (SELECT max(total) FROM weights w WHERE w.experiment_id = asked.experiment_id) AS slot
       FROM asked WHERE {share_hash('gate')} % 100 < allocation_percent)
     SELECT s.visitor_id, s.experiment_id, w.variant_id FROM slots s JOIN weights w
      ON w.experiment_id = s.experiment_id AND s.slot < w.upto AND s.slot >= w.upto - w.weight""",
    "sem_events", "experiments", "variants",
)

# --- anchored windows and markers ------------------------------------------------------------------------


def addressed(spark: SparkSession, sf: str) -> DataFrame:
    hits = table(spark, sf, "hits")
    return hits.withColumn("ip", client_ip(SETTINGS)).select("hit_id", "ip", "ts")


ADDRESSED = f"RECURSIVE {{tables}}, addressed AS (SELECT hit_id, {IP} AS ip, ts FROM hits)"
register(
    "J18_burst_count",
    lambda spark, sf: reputation.with_burst_count(addressed(spark, sf), SETTINGS),
    f"SELECT hit_id, ip, {when('c.ts')} AS ts, n AS burst_count FROM counted c",
    "hits",
    before=f"{ADDRESSED}, {anchored('addressed', 'ip', 'hit_id', SETTINGS.burst_seconds, 'counted')}",
)
register(
    "J18_burst_count_long_chunks",
    lambda spark, sf: reputation.with_burst_count(
        addressed(spark, sf), SETTINGS, chunk_seconds=2 * 86_400
    ),
    f"SELECT hit_id, ip, {when('c.ts')} AS ts, n AS burst_count FROM counted c",
    "hits",
    before=f"{ADDRESSED}, {anchored('addressed', 'ip', 'hit_id', SETTINGS.burst_seconds, 'counted')}",
)
register(
    "J18_rate_limit",
    lambda spark, sf: reputation.with_rate_limit(addressed(spark, sf), SETTINGS),
    f"SELECT hit_id, ip, {when('c.ts')} AS ts, n > {SETTINGS.rate_limit_max} AS is_limited FROM counted c",
    "hits",
    before=f"{ADDRESSED}, {anchored('addressed', 'ip', 'hit_id', SETTINGS.rate_limit_seconds, 'counted')}",
)
register(
    "J19_ip_penalty",
    lambda spark, sf: reputation.with_ip_penalty(
        addressed(spark, sf), table(spark, sf, "markers"), SETTINGS
    ),
    f"SELECT hit_id, ip, {when('a.ts')} AS ts, {penalty('a')} AS ip_penalty FROM addressed a",
    "hits", "markers",
    before=ADDRESSED.replace("RECURSIVE ", ""),
)
