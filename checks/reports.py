"""Registered reports P01-P59: the Spark query and its SQL check side by side.

Windows of minutes are longer than the library defaults where the test data,
with minutes between events, would leave them empty.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from datetime import timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from checks.adapters import as_of, ctes, table
from footfall.operators.paging import onward
from footfall.plans import campaigns, experiments, live, overview, performance, samples, visitors
from footfall.plans.rollup import rollup_days

Query = Callable[[SparkSession, str], DataFrame]

SITE = "site-0"
DAYS = 14
NOW = "(SELECT max(created_at) FROM views)"
TODAY = f"CAST({NOW} AS DATE)"
CLEAN = "bot_score BETWEEN 0 AND 49"


@dataclass(frozen=True)
class Check:
    run: Query
    sql: str | None = None


def as_text(df: DataFrame) -> DataFrame:
    """Times and dates as text, so both engines hand over plain values."""
    formats = {"timestamp_ntz": "yyyy-MM-dd HH:mm:ss.SSSSSS", "date": "yyyy-MM-dd"}
    return df.select(
        *[
            F.date_format(name, formats[kind]).alias(name) if kind in formats else F.col(name)
            for name, kind in df.dtypes
        ]
    )


def when(column: str) -> str:
    return f"strftime({column}, '%Y-%m-%d %H:%M:%S.%f')"


# One rollup row per day and segment, as the rollup job writes them.
DAILY = f"""
daily AS (
 SELECT site_id, CAST(created_at AS DATE) AS date, coalesce(device_type,'unknown') AS device_type,
  coalesce(country_code,'unknown') AS country_code, is_returning, count(*) AS visits,
  count(DISTINCT visitor_id) AS unique_visitors,
  coalesce(CAST(trunc(avg(CASE WHEN interaction_ms > 0 THEN interaction_ms END)) AS BIGINT), 0) AS avg_interaction_ms
 FROM views v WHERE {CLEAN} AND NOT EXISTS (SELECT 1 FROM excluded x WHERE x.visitor_id = v.visitor_id)
 GROUP BY ALL)
"""


def with_tables(sql: str, *names: str, daily: bool = False, before: str = "{tables}") -> str:
    """``before`` holds further common tables of a check, after its ``{tables}``."""
    names = names + (("views", "excluded") if daily else ())
    text = "WITH " + before.replace("{tables}", ctes("duckdb", *names))
    if daily:
        text = f"{text}, {DAILY}"
    return f"{text} {sql}"  # a check may begin with ', more AS (...)'



CHECKS: dict[str, Check] = {}


def register(name: str, run: Query, sql: str | None = None, *names: str, **parts) -> None:
    query = lambda spark, sf: as_text(run(spark, sf))
    CHECKS[name] = Check(query, with_tables(sql, *names, **parts) if sql else None)


def daily_table(spark: SparkSession, sf: str) -> DataFrame:
    return rollup_days(table(spark, sf, "views"), table(spark, sf, "excluded"))


def scope(sf: str, **more) -> dict:
    return dict(site=SITE, as_of=as_of(sf), **more)


# --- overview -----------------------------------------------------------------

HISTORY = f"site_id = '{SITE}' AND date >= {TODAY} - {DAYS}"
CLOSED = f"{HISTORY} AND date < {TODAY}"
FRESH = f"site_id = '{SITE}' AND created_at >= {TODAY} AND {CLEAN}"
RECENT = f"site_id = '{SITE}' AND created_at >= {TODAY} - {DAYS} AND {CLEAN}"

for name, fn, sql in (
    ("P01_overview_visits", overview.overview_visits, f"""
     SELECT CAST((SELECT coalesce(sum(visits),0) FROM daily WHERE {CLOSED})
          + (SELECT count(*) FROM views WHERE {FRESH}) AS BIGINT) AS visits"""),
    ("P02_overview_unique_visitors", overview.overview_unique_visitors, f"""
     SELECT CAST((SELECT coalesce(sum(uv),0) FROM (SELECT max(unique_visitors) AS uv FROM daily WHERE {CLOSED} GROUP BY date))
          + (SELECT count(DISTINCT visitor_id) FROM views WHERE {FRESH}) AS BIGINT) AS unique_visitors"""),
):
    register(
        name,
        lambda spark, sf, fn=fn: fn(
            table(spark, sf, "views"), daily_table(spark, sf), **scope(sf, days=DAYS)
        ),
        sql,
        daily=True,
    )

for name, fn, sql in (
    ("P03_overview_avg_interaction", overview.overview_avg_interaction, f"""
     SELECT coalesce(CAST(trunc(avg(avg_interaction_ms)) AS BIGINT), 0) AS avg_interaction_ms FROM daily WHERE {CLOSED}"""),
    ("P05_devices", overview.devices, f"""
     SELECT device_type, CAST(sum(visits) AS BIGINT) AS visits FROM daily WHERE {HISTORY} GROUP BY device_type"""),
    ("P06_countries", overview.countries, f"""
     SELECT country_code, CAST(sum(visits) AS BIGINT) AS visits, CAST(sum(unique_visitors) AS BIGINT) AS visitors
     FROM daily WHERE {HISTORY} AND country_code != 'unknown' GROUP BY country_code
     ORDER BY visits DESC, country_code LIMIT 10"""),
    ("P11_daily_trend", overview.daily_trend, f"""
     SELECT strftime(date, '%Y-%m-%d') AS date, CAST(sum(visits) AS BIGINT) AS visits, CAST(sum(unique_visitors) AS BIGINT) AS visitors
     FROM daily d WHERE {HISTORY.replace('date >=', 'd.date >=')} GROUP BY d.date"""),
):
    register(
        name,
        lambda spark, sf, fn=fn: fn(daily_table(spark, sf), **scope(sf, days=DAYS)),
        sql,
        daily=True,
    )


def grouped(key: str, label: str, name: str, where: str = RECENT, limit: int = 20) -> str:
    """Views and visitors by a key, largest first; labelled after grouping."""
    return f"""
     SELECT {label} AS {name}, views, visitors FROM (
      SELECT {key} AS k, count(*) AS views, count(DISTINCT visitor_id) AS visitors
      FROM views WHERE {where} GROUP BY 1 ORDER BY views DESC, k NULLS FIRST LIMIT {limit})"""


for name, fn, sql in (
    ("P04_top_paths", overview.top_paths, grouped("path", "k", "path")),
    ("P07_referrers", overview.referrers, f"""
     SELECT referrer_type, count(*) AS views FROM views WHERE {RECENT} GROUP BY referrer_type"""),
    ("P08_os_systems", overview.os_systems, grouped("os_name", "coalesce(k, 'Unknown')", "os_name")),
    ("P09_browsers", overview.browsers, grouped(
        "coalesce(browser_name || ' ' || browser_version, browser_name, 'Unknown')", "k", "browser")),
    ("P10_resolutions", overview.resolutions, grouped(
        "coalesce(screen_width,0) || 'x' || coalesce(screen_height,0)", "k", "resolution")),
):
    register(
        name,
        lambda spark, sf, fn=fn: fn(table(spark, sf, "views"), **scope(sf, days=DAYS)),
        sql,
        "views",
    )

# --- live -----------------------------------------------------------------------

MINUTES = 360


def recent(minutes: int, source: str = "views", site: bool = True) -> str:
    now = NOW if source == "views" else f"(SELECT max(created_at) FROM {source})"
    where = f"created_at >= {now} - INTERVAL {minutes} MINUTE"
    return f"site_id = '{SITE}' AND {where}" if site else where


for name, fn, sql in (
    ("P12_realtime_active", live.realtime_active, f"""
     SELECT count(DISTINCT visitor_id) AS active_visitors, count(*) AS pageviews
     FROM views WHERE {recent(MINUTES)} AND {CLEAN}"""),
    ("P13_realtime_paths", live.realtime_paths, f"""
     SELECT path, count(*) AS views FROM views WHERE {recent(MINUTES)} AND {CLEAN}
     GROUP BY path ORDER BY views DESC, path LIMIT 10"""),
    ("P14_dashboard_now", live.dashboard_now, f"""
     SELECT count(DISTINCT CASE WHEN {CLEAN} THEN visitor_id END) AS active_visitors,
      count(DISTINCT CASE WHEN bot_score >= 50 THEN visitor_id END) AS estimated_bots,
      count(CASE WHEN {CLEAN} THEN 1 END) AS pageviews
     FROM views WHERE {recent(MINUTES)}"""),
    ("P19_recent_visitors", live.recent_visitors, f"""
     SELECT visitor_id, max(device_type) AS device_type, max(os_name) AS os_name,
      max(browser_name || ' ' || browser_version) AS browser, max(country_code) AS country_code,
      {when('max(created_at)')} AS created_at, count(*) AS view_count
     FROM views WHERE {recent(MINUTES)} AND {CLEAN}
     GROUP BY visitor_id ORDER BY max(created_at) DESC, visitor_id LIMIT 20"""),
):
    register(
        name,
        lambda spark, sf, fn=fn: fn(table(spark, sf, "views"), **scope(sf, minutes=MINUTES)),
        sql,
        "views",
    )


def trend(fmt: str, name: str, source: str, minutes: int) -> str:
    return f"""
     SELECT strftime(created_at, '{fmt}') AS {name}, count(*) AS count FROM {source}
     WHERE {recent(minutes, source)} AND {CLEAN} GROUP BY 1"""


for key, fn, source, span, sql in (
    ("P15_minute_trend_views", live.minute_trend, "views", {"minutes": 600},
     trend("%H:%M", "minute", "views", 600)),
    ("P16_minute_trend_events", live.minute_trend, "sem_events", {"minutes": 600},
     trend("%H:%M", "minute", "sem_events", 600)),
    ("P17_hour_trend_views", live.hour_trend, "views", {}, trend("%H:00", "hour", "views", 1440)),
    ("P18_hour_trend_events", live.hour_trend, "sem_events", {},
     trend("%H:00", "hour", "sem_events", 1440)),
    ("P20_recent_events", live.recent_events, "sem_events", {"minutes": 600}, f"""
     SELECT event_type, site_id, visitor_id, {when('created_at')} AS created_at FROM (
      SELECT * FROM sem_events WHERE {recent(600, 'sem_events')} AND {CLEAN}
      ORDER BY created_at DESC, id LIMIT 20)"""),
):
    register(
        key,
        lambda spark, sf, fn=fn, source=source, span=span: fn(
            table(spark, sf, source), site=SITE, as_of=as_of(sf, source), **span
        ),
        sql,
        source,
    )

TRAFFIC = f"""
 CAST(coalesce(sum(CASE WHEN {CLEAN} THEN 1 ELSE 0 END),0) AS BIGINT) AS human_views,
 CAST(coalesce(sum(CASE WHEN bot_score >= 50 THEN 1 ELSE 0 END),0) AS BIGINT) AS bot_views,
 count(DISTINCT visitor_id) AS unique_visitors"""
register(
    "P31_summary_24h",
    lambda spark, sf: live.summary_24h(table(spark, sf, "views"), as_of=as_of(sf)),
    f"SELECT count(*) AS total_views, {TRAFFIC} FROM views WHERE {recent(1440, site=False)}",
    "views",
)
register(
    "P32_live_stats",
    lambda spark, sf: live.live_stats(table(spark, sf, "views"), as_of=as_of(sf), minutes=MINUTES),
    f"SELECT {TRAFFIC} FROM views WHERE {recent(MINUTES, site=False)}",
    "views",
)

# --- campaigns --------------------------------------------------------------------

CAMPAIGN_SINCE = f"created_at >= {TODAY} - {DAYS} AND {CLEAN}"
SPRING = f"{CAMPAIGN_SINCE} AND utm_campaign = 'spring' AND site_id = '{SITE}'"

register(
    "P21_campaign_stats",
    lambda spark, sf: campaigns.campaign_stats(
        table(spark, sf, "campaigns"), table(spark, sf, "views"), days=DAYS, as_of=as_of(sf)
    ),
    f"""SELECT c.id, c.name, c.utm_campaign, c.site_id, c.status, count(v.id) AS views,
      count(DISTINCT v.visitor_id) AS visitors
     FROM campaigns c LEFT JOIN views v ON v.utm_campaign = c.utm_campaign AND v.site_id = c.site_id
      AND v.created_at >= {TODAY} - {DAYS} AND v.bot_score BETWEEN 0 AND 49
     GROUP BY ALL""",
    "campaigns",
)
for name, fn, sql in (
    ("P22_campaign_by_source", campaigns.campaign_by_source,
     grouped("utm_source", "coalesce(k,'direct')", "utm_source", SPRING)),
    ("P23_campaign_by_medium", campaigns.campaign_by_medium,
     grouped("utm_medium", "coalesce(k,'none')", "utm_medium", SPRING)),
    ("P24_campaign_daily", campaigns.campaign_daily, f"""
     SELECT strftime(created_at, '%Y-%m-%d') AS date, count(*) AS views, count(DISTINCT visitor_id) AS visitors
     FROM views WHERE {SPRING} GROUP BY 1"""),
    ("P25_campaign_top_paths", campaigns.campaign_top_paths, grouped("path", "k", "path", SPRING)),
    ("P26_campaign_by_content", campaigns.campaign_by_content, f"""
     SELECT coalesce(utm_content,'none') AS utm_content, count(*) AS views FROM views
     WHERE {SPRING} GROUP BY views.utm_content"""),
    ("P27_campaign_by_term", campaigns.campaign_by_term, f"""
     SELECT coalesce(utm_term,'none') AS utm_term, count(*) AS views FROM views
     WHERE {SPRING} GROUP BY views.utm_term"""),
):
    register(
        name,
        lambda spark, sf, fn=fn: fn(
            table(spark, sf, "views"), **scope(sf, days=DAYS, utm_campaign="spring")
        ),
        sql,
        "views",
    )

CONVERSION = f"""
 SELECT uc.id AS campaign_id, uc.name AS campaign_name, v.utm_campaign, v.visitors,
  coalesce(e.event_visitors,0) AS event_visitors, coalesce(e.events,0) AS events,
  CASE WHEN v.visitors > 0 THEN coalesce(e.event_visitors,0) / v.visitors ELSE 0 END AS event_rate,
  CASE WHEN v.visitors > 0 THEN coalesce(e.events,0) / v.visitors ELSE 0 END AS events_per_visitor
 FROM (SELECT utm_campaign, count(DISTINCT visitor_id) AS visitors FROM views
       WHERE {CAMPAIGN_SINCE} AND site_id = '{SITE}' GROUP BY utm_campaign) v
 LEFT JOIN (SELECT utm_campaign, count(DISTINCT visitor_id) AS event_visitors, count(*) AS events
       FROM sem_events WHERE {CAMPAIGN_SINCE} AND site_id = '{SITE}' GROUP BY utm_campaign) e
  ON e.utm_campaign IS NOT DISTINCT FROM v.utm_campaign
 LEFT JOIN campaigns uc ON uc.utm_campaign = v.utm_campaign AND uc.site_id = '{SITE}'
"""
register(
    "P28_campaign_events",
    lambda spark, sf: campaigns.campaign_events(
        table(spark, sf, "views"), table(spark, sf, "sem_events"), table(spark, sf, "campaigns"),
        **scope(sf, days=DAYS),
    ),
    CONVERSION,
    "campaigns", "sem_events",
)
TYPES = f"""
 SELECT utm_campaign, event_type, count, unique_visitors FROM (
  SELECT *, row_number() OVER (PARTITION BY utm_campaign ORDER BY count DESC, event_type) AS rn FROM (
   SELECT utm_campaign, event_type, count(*) AS count, count(DISTINCT visitor_id) AS unique_visitors
   FROM sem_events WHERE {CAMPAIGN_SINCE} AND site_id = '{SITE}' GROUP BY 1, 2)) WHERE rn <= 10"""
register(
    "P29_campaign_event_types",
    lambda spark, sf: campaigns.campaign_event_types(
        table(spark, sf, "sem_events"), **scope(sf, days=DAYS)
    ),
    TYPES,
    "sem_events", "views",
)
register(
    "S13_campaign_events_document",
    lambda spark, sf: campaigns.campaign_events_document(
        table(spark, sf, "views"), table(spark, sf, "sem_events"), table(spark, sf, "campaigns"),
        **scope(sf, days=DAYS),
    ).select("utm_campaign", "visitors", F.to_json("event_types").alias("event_types")),
    f"""SELECT c.utm_campaign, c.visitors, '[' || coalesce((SELECT string_agg(
      '{{"event_type":"' || t.event_type || '","count":' || t.count || ',"unique_visitors":' || t.unique_visitors || '}}',
      ',' ORDER BY t.count DESC, t.event_type)
      FROM ({TYPES}) t WHERE t.utm_campaign IS NOT DISTINCT FROM c.utm_campaign), '') || ']' AS event_types
     FROM ({CONVERSION}) c""",
    "campaigns", "sem_events",
)
register(
    "P58_campaign_list",
    lambda spark, sf: campaigns.campaign_list(table(spark, sf, "campaigns")),
    f"""SELECT id, name, utm_campaign, site_id, status, {when('c.created_at')} AS created_at
     FROM campaigns c""",
    "campaigns",
)

# --- experiments --------------------------------------------------------------------

register(
    "P30_experiment_stats",
    lambda spark, sf: experiments.experiment_stats(
        *[table(spark, sf, n) for n in ("experiments", "variants", "sem_events")]
    ),
    """, counted AS (
      SELECT e.experiment_id, e.variant_id, count(DISTINCT e.session_id) AS n,
       count(DISTINCT CASE WHEN e.event_type = x.metric_event_type THEN e.session_id END) AS c
      FROM sem_events e JOIN experiments x ON x.experiment_id = e.experiment_id GROUP BY 1, 2),
     joined AS (
      SELECT x.experiment_id, x.name AS experiment_name, x.status, x.metric_event_type, v.variant_id, v.name, v.weight,
       v.is_control, coalesce(n,0) AS impressions, coalesce(c,0) AS conversions,
       CASE WHEN coalesce(n,0) > 0 THEN c / n ELSE 0 END AS conversion_rate
      FROM experiments x JOIN variants v ON v.experiment_id = x.experiment_id
      LEFT JOIN counted k ON k.experiment_id = v.experiment_id AND k.variant_id = v.variant_id
      WHERE x.status IN ('active','completed')),
     paired AS (
      SELECT j.*, o.impressions AS n1, o.conversions AS c1, o.conversion_rate AS r1,
       (o.conversions + j.conversions) / nullif(o.impressions + j.impressions, 0) AS pool
      FROM joined j LEFT JOIN joined o ON o.experiment_id = j.experiment_id AND o.is_control = 1),
     scored AS (
      SELECT *, sqrt(pool * (1 - pool) * (1 / nullif(n1,0) + 1 / nullif(impressions,0))) AS se FROM paired)
     SELECT experiment_id, experiment_name, status, metric_event_type, variant_id, name, weight, is_control,
      impressions, conversions, conversion_rate,
      CASE WHEN is_control = 0 AND n1 > 0 AND r1 > 0 THEN (conversion_rate - r1) / r1 END AS relative_uplift,
      CASE WHEN is_control = 1 OR n1 IS NULL OR n1 = 0 THEN 'Not enough data'
       WHEN least(n1, impressions) < 100 THEN 'Not yet — need more data (' || least(n1, impressions) || ' < 100 impressions)'
       WHEN se = 0 THEN 'No variance'
       WHEN abs(conversion_rate - r1) / se >= 2.576 THEN 'Statistically significant at 99%'
       WHEN abs(conversion_rate - r1) / se >= 1.96 THEN 'Statistically significant at 95%'
       WHEN abs(conversion_rate - r1) / se >= 1.645 THEN 'Marginally significant at 90%'
       ELSE 'Not statistically significant' END AS significance
     FROM scored""",
    "experiments", "variants", "sem_events",
)
register(
    "P55_doc_experiment_conversions",
    lambda spark, sf: experiments.experiment_conversions(
        table(spark, sf, "sem_events"), table(spark, sf, "experiments")
    ),
    """SELECT e.name AS experiment, se.variant_id, count(*) AS conversions, count(DISTINCT se.visitor_id) AS unique_converters
     FROM sem_events se JOIN experiments e ON e.experiment_id = se.experiment_id
     WHERE se.event_type = e.metric_event_type GROUP BY 1, 2""",
    "sem_events", "experiments",
)
register(
    "P58_experiment_list",
    lambda spark, sf: experiments.experiment_list(table(spark, sf, "experiments")),
    f"""SELECT experiment_id, name, description, status, metric_event_type, allocation_percent,
      {when('e.created_at')} AS created_at FROM experiments e""",
    "experiments",
)

# --- visitors -------------------------------------------------------------------------


def distinct_list(value: str, name: str) -> str:
    return f"string_agg(DISTINCT {value}, ',' ORDER BY {value}) AS {name}"


FLAG = "CAST(EXISTS(SELECT 1 FROM excluded x WHERE x.visitor_id = t.visitor_id) AS INT) AS is_excluded"
register(
    "P33_suspicious_visitors",
    lambda spark, sf: visitors.suspicious_visitors(
        table(spark, sf, "views"), table(spark, sf, "excluded"), limit=100
    ),
    f"""SELECT t.*, {FLAG}, CASE WHEN max_bot_score >= 50 THEN 'high' WHEN max_bot_score >= 25 THEN 'med' ELSE 'low' END AS band FROM (
      SELECT visitor_id, max(bot_score) AS max_bot_score, count(*) AS pageviews,
       {when('min(created_at)')} AS first_seen, {when('max(created_at)')} AS last_seen,
       {distinct_list('site_id', 'sites')}, {distinct_list('device_type', 'devices')},
       {distinct_list('country_code', 'countries')}, {distinct_list('os_name', 'os_names')},
       {distinct_list("browser_name || ' ' || browser_version", 'browsers')}
      FROM views WHERE bot_score >= 25 GROUP BY visitor_id
      ORDER BY max_bot_score DESC, pageviews DESC, visitor_id LIMIT 100) t""",
    "views", "excluded",
)
register(
    "P34_excluded_report",
    lambda spark, sf: visitors.excluded_report(
        table(spark, sf, "excluded"), table(spark, sf, "views")
    ).withColumn("max_bot_score", F.col("max_bot_score").cast("double")),
    f"""SELECT x.visitor_id, x.label, {when('x.created_at')} AS created_at, count(v.id) AS pageviews,
      CAST(max(v.bot_score) AS DOUBLE) AS max_bot_score
     FROM excluded x LEFT JOIN views v ON v.visitor_id = x.visitor_id
     GROUP BY x.visitor_id, x.label, x.created_at""",
    "views", "excluded",
)

VISITOR = "0000000000000013"
register(
    "P35_visitor_history",
    lambda spark, sf: visitors.visitor_history(
        *[table(spark, sf, n) for n in ("views", "sem_events", "excluded")], visitor_id=VISITOR
    )
    .withColumn("interaction_ms", F.col("interaction_ms").cast("double"))
    .withColumn("is_pwa", F.col("is_pwa").cast("double")),
    f"""SELECT t.*, {FLAG.replace('t.visitor_id', f"'{VISITOR}'")} FROM (
      (SELECT 'view' AS kind, path, NULL AS event_type, site_id, CAST(interaction_ms AS DOUBLE) AS interaction_ms, device_type, os_name,
       browser_name, browser_version, country_code, referrer_type, NULL AS data, bot_score, CAST(is_pwa AS DOUBLE) AS is_pwa,
       {when('v.created_at')} AS created_at
       FROM views v WHERE visitor_id = '{VISITOR}')
      UNION ALL
      (SELECT 'event', NULL, event_type, site_id, NULL, device_type, NULL, NULL, NULL, NULL, NULL, data, bot_score, NULL,
       {when('e.created_at')} FROM sem_events e WHERE visitor_id = '{VISITOR}')) t""",
    "views", "sem_events", "excluded",
)
register(
    "P36_visitor_summary",
    lambda spark, sf: visitors.visitor_summary(
        table(spark, sf, "views"), table(spark, sf, "sem_events"), visitor_id=VISITOR
    ),
    f"""SELECT count(*) AS total_views,
      (SELECT count(*) FROM sem_events WHERE visitor_id = '{VISITOR}') AS total_events,
      {when('min(t.created_at)')} AS first_seen, {when('max(t.created_at)')} AS last_seen,
      CAST(coalesce(sum(interaction_ms),0) AS BIGINT) AS total_interaction,
      {distinct_list('device_type', 'devices')}, {distinct_list('country_code', 'countries')}, {distinct_list('site_id', 'sites')}
     FROM views t WHERE visitor_id = '{VISITOR}'""",
    "views", "sem_events",
)


def scored_id(spark: SparkSession, sf: str) -> int:
    scored = table(spark, sf, "views").filter(F.col("bot_score_detail").contains("geo"))
    return scored.agg(F.min("id")).first()[0]


register(
    "P37_score_detail",
    lambda spark, sf: visitors.score_detail(
        table(spark, sf, "views"), row_id=scored_id(spark, sf)
    ),
    """SELECT v.bot_score AS score, j.key AS factor, CAST(j.value AS VARCHAR) AS points FROM
     (SELECT * FROM views WHERE id = (SELECT min(id) FROM views WHERE bot_score_detail LIKE '%geo%')) v
     LEFT JOIN json_each(v.bot_score_detail) j ON true""",
    "views",
)
register(
    "P38_visitors_listing",
    lambda spark, sf: visitors.visitors_listing(
        table(spark, sf, "views"), table(spark, sf, "excluded"), sort="views_desc", page=2,
        site=SITE, search="0001", bot="suspect",
    ).rows,
    f"""SELECT t.*, {FLAG} FROM (
      SELECT visitor_id, count(*) AS view_count, {when('max(created_at)')} AS last_seen, {when('min(created_at)')} AS first_seen,
       max(device_type) AS device_type, max(os_name) AS os_name, max(browser_name || ' ' || browser_version) AS browser,
       max(country_code) AS country_code, max(is_returning) AS is_returning, max(bot_score) AS max_bot_score
      FROM views WHERE site_id = '{SITE}' AND visitor_id ILIKE '%0001%'
      GROUP BY visitor_id HAVING max(bot_score) >= 50
      ORDER BY view_count DESC, visitor_id LIMIT 25 OFFSET
       25 * (SELECT least(2, greatest(1, CAST(ceil(count(*) / 25.0) AS BIGINT))) - 1 FROM (
         SELECT visitor_id FROM views WHERE site_id = '{SITE}' AND visitor_id ILIKE '%0001%'
         GROUP BY visitor_id HAVING max(bot_score) >= 50))) t""",
    "views", "excluded",
)
register(
    "P39_pageviews_listing",
    lambda spark, sf: visitors.pageviews_listing(
        table(spark, sf, "views"), page=2, zone="Europe/Oslo", bot="clean", search="DOCS/p"
    ).rows.select("id", "visitor_id", "path", "site_id", "bot_score", "created_at", "shown_at"),
    f"""SELECT id, visitor_id, path, site_id, bot_score, {when('t.created_at')} AS created_at,
      strftime(t.created_at + INTERVAL 1 HOUR, '%Y-%m-%d %H:%M') AS shown_at
     FROM (SELECT * FROM views WHERE {CLEAN} AND (visitor_id ILIKE '%DOCS/p%' OR path ILIKE '%DOCS/p%')
      ORDER BY created_at DESC, id LIMIT 25 OFFSET 25) t""",
    "views",
)


def next_views(spark: SparkSession, sf: str) -> DataFrame:
    rows = visitors.pageview_list(table(spark, sf, "views"), bot="clean", search="DOCS/p")
    last = onward(rows, "created_at", "id").collect()[-1]
    return onward(rows, "created_at", "id", (last.created_at, last.id)).select("id", "path", "created_at")


register(
    "L05_next_page",
    next_views,
    f"""SELECT id, path, {when('t.created_at')} AS created_at
     FROM (SELECT * FROM views WHERE {CLEAN} AND (visitor_id ILIKE '%DOCS/p%' OR path ILIKE '%DOCS/p%')
      ORDER BY created_at DESC, id LIMIT 25 OFFSET 25) t""",
    "views",
)
register(
    "P40_events_listing",
    lambda spark, sf: visitors.events_listing(
        table(spark, sf, "sem_events"), event_type="custom", search="PURCHASE", page=3
    ).rows,
    f"""SELECT event_type, site_id, visitor_id, data, device_type, bot_score, is_returning, {when('t.created_at')} AS created_at
     FROM (SELECT * FROM sem_events WHERE event_type = 'custom' AND (event_type ILIKE '%PURCHASE%' OR data ILIKE '%PURCHASE%')
      ORDER BY created_at DESC, id LIMIT 25 OFFSET 50) t""",
    "sem_events",
)
register(
    "P41_event_type_counts",
    lambda spark, sf: visitors.event_type_counts(table(spark, sf, "sem_events"), site=SITE),
    f"SELECT event_type, count(*) AS count FROM sem_events WHERE site_id = '{SITE}' GROUP BY event_type",
    "sem_events",
)
register(
    "P42_facets",
    lambda spark, sf: visitors.facets(table(spark, sf, "views"), current_site="default"),
    """SELECT DISTINCT 'device' AS facet, device_type AS value FROM views WHERE device_type IS NOT NULL
     UNION SELECT 'country', country_code FROM views WHERE country_code IS NOT NULL
     UNION SELECT 'site', site_id FROM views WHERE site_id IS NOT NULL UNION SELECT 'site', 'default'""",
    "views",
)
DAY = "CAST((SELECT max(created_at) FROM sem_events) AS DATE)"
register(
    "P59_daily_summary",
    lambda spark, sf: visitors.daily_summary(
        table(spark, sf, "sem_events"), day=as_of(sf, "sem_events").date()
    ),
    f""", d AS (SELECT *, data ->> '$.path' AS path FROM sem_events
      WHERE created_at >= {DAY} AND created_at < {DAY} + 1)
     SELECT 'total_events' AS section, NULL AS name, count(*) AS n FROM d
     UNION ALL SELECT 'unique_sessions', NULL, count(DISTINCT session_id) FROM d
     UNION ALL (SELECT 'top_paths', path, count(*) FROM d WHERE path IS NOT NULL GROUP BY path ORDER BY count(*) DESC, path LIMIT 10)
     UNION ALL (SELECT 'top_event_types', event_type, count(*) FROM d GROUP BY event_type ORDER BY count(*) DESC, event_type LIMIT 10)
     UNION ALL (SELECT 'device_breakdown', device_type, count(DISTINCT session_id) FROM d GROUP BY device_type)""",
    "sem_events",
)

# --- metrics and requests -----------------------------------------------------------------

METRIC_NOW = "(SELECT max(recorded_at) FROM metrics)"
METRIC_COLUMNS = f"id, {when('t.recorded_at')} AS recorded_at, commit_hash, branch, category, metric, value, unit, metadata"
register(
    "P43_perf_query",
    lambda spark, sf: performance.query_metrics(
        table(spark, sf, "metrics"), category="purchase", metric="m1",
        since=as_of(sf, "metrics", "recorded_at") - timedelta(days=10), limit=100,
    ),
    f"""SELECT {METRIC_COLUMNS} FROM (SELECT * FROM metrics WHERE category = 'purchase' AND metric = 'm1'
      AND recorded_at >= {METRIC_NOW} - INTERVAL 10 DAY ORDER BY recorded_at DESC, id LIMIT 100) t""",
    "metrics",
)
register(
    "P44_perf_trends",
    lambda spark, sf: performance.metric_trends(table(spark, sf, "metrics")),
    f"""SELECT {METRIC_COLUMNS}, category || '/' || metric AS key FROM metrics t
     QUALIFY row_number() OVER (PARTITION BY category, metric ORDER BY t.recorded_at DESC, id) <= 30""",
    "metrics",
)
REQUEST_SINCE = "ts >= (SELECT max(ts) FROM requests) - INTERVAL 600 MINUTE"
register(
    "P45_request_stats",
    lambda spark, sf: performance.request_stats(
        table(spark, sf, "requests"), as_of=as_of(sf, "requests", "ts"), minutes=600
    ),
    f"""SELECT count(*) AS total_requests, count(*) FILTER (status >= 500) AS total_errors,
      count(*) FILTER (recent) AS recent_requests,
      coalesce(round(avg(duration_ms) FILTER (recent), 2), 0.0) AS avg_response_ms,
      coalesce(quantile_disc(duration_ms, 0.5) FILTER (recent), 0.0) AS p50_ms,
      coalesce(quantile_disc(duration_ms, 0.95) FILTER (recent), 0.0) AS p95_ms,
      coalesce(quantile_disc(duration_ms, 0.99) FILTER (recent), 0.0) AS p99_ms,
      coalesce(max(duration_ms) FILTER (recent), 0.0) AS max_ms,
      round(count(*) FILTER (recent) / 36000.0, 2) AS rps,
      round(count(*) FILTER (status >= 500) * 100.0 / count(*), 2) AS error_rate
     FROM (SELECT *, {REQUEST_SINCE} AS recent FROM requests)""",
    "requests",
)
register(
    "P46_slow_paths",
    lambda spark, sf: performance.slow_paths(
        table(spark, sf, "requests"), as_of=as_of(sf, "requests", "ts"), minutes=600
    ),
    f"""SELECT path, CAST(floor(sum(duration_ms) / count(*) + 0.5) AS BIGINT) AS avg_ms, count(*) AS count
     FROM requests WHERE {REQUEST_SINCE} GROUP BY path ORDER BY avg_ms DESC, path LIMIT 5""",
    "requests",
)

# --- sample reports --------------------------------------------------------------------------

HUMAN = "bot_score < 50"


def last(days: int, source: str = "views") -> str:
    return f"created_at >= CAST((SELECT max(created_at) FROM {source}) AS DATE) - {days}"


for name, fn, sql in (
    ("P47_doc_views_per_day", samples.views_per_day, f"""
     SELECT strftime(created_at, '%Y-%m-%d') AS day, count(*) AS views FROM views WHERE {HUMAN}
     GROUP BY 1"""),
    ("P53_doc_utm_performance", samples.utm_performance, f"""
     SELECT utm_campaign, count(*) AS pageviews, count(DISTINCT visitor_id) AS visitors,
      round(avg(interaction_ms) / 1000.0, 1) AS avg_seconds
     FROM views WHERE utm_campaign IS NOT NULL AND {HUMAN} GROUP BY utm_campaign"""),
):
    register(name, lambda spark, sf, fn=fn: fn(table(spark, sf, "views")), sql, "views")

for name, fn, sql in (
    ("P48_doc_top_pages_week", samples.top_pages_week,
     grouped("path", "k", "path", f"{HUMAN} AND {last(7)}")),
    ("P49_doc_uniques_by_country", samples.uniques_by_country, f"""
     SELECT country_code, count(DISTINCT visitor_id) AS visitors FROM views WHERE {HUMAN} AND {last(30)} GROUP BY country_code"""),
    ("P50_doc_device_share", samples.device_share, f"""
     SELECT device_type, count(*) AS views, round(count(*) * 100.0 / sum(count(*)) OVER (), 1) AS pct
     FROM views WHERE {HUMAN} AND {last(30)} GROUP BY device_type"""),
    ("P51_doc_avg_interaction_by_page", samples.avg_interaction_by_page, f"""
     SELECT path, count(*) AS views, round(avg(interaction_ms) / 1000.0, 1) AS avg_seconds FROM views
     WHERE {HUMAN} AND interaction_ms > 0 AND {last(30)} GROUP BY path ORDER BY avg_seconds DESC, path LIMIT 20"""),
    ("P52_doc_returning_vs_new", samples.returning_vs_new, f"""
     SELECT CASE is_returning WHEN 1 THEN 'returning' ELSE 'new' END AS type, count(DISTINCT visitor_id) AS visitors,
      count(*) AS pageviews FROM views WHERE {HUMAN} AND {last(30)} GROUP BY is_returning"""),
    ("P54_doc_bot_categories", samples.bot_categories, f"""
     SELECT CASE WHEN bot_score >= 50 THEN 'likely bot' WHEN bot_score >= 25 THEN 'suspect' ELSE 'likely human' END AS category,
      count(*) AS views, round(count(*) * 100.0 / sum(count(*)) OVER (), 1) AS pct
     FROM views WHERE {last(7)} GROUP BY category"""),
    ("P56_doc_hourly_pattern", samples.hourly_pattern, f"""
     SELECT CAST(extract(hour FROM created_at) AS INT) AS hour_utc, count(*) AS views FROM views
     WHERE {HUMAN} AND {last(7)} GROUP BY 1"""),
):
    register(
        name, lambda spark, sf, fn=fn: fn(table(spark, sf, "views"), as_of=as_of(sf)), sql, "views"
    )
register(
    "P57_doc_event_types",
    lambda spark, sf: samples.event_types(
        table(spark, sf, "sem_events"), as_of=as_of(sf, "sem_events")
    ),
    f"SELECT event_type, count(*) AS count FROM sem_events WHERE {HUMAN} AND {last(30, 'sem_events')} GROUP BY event_type",
    "sem_events",
)
