"""Model tables derived from the driver's ``events`` table.

Each table is one SELECT over ``base`` or over another model table, written once
and used by both engines, so that a query and its check read the same rows.
Pageviews come from the view and error events, behavioural events from the rest.
"""

from __future__ import annotations

from datetime import datetime
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from footfall.session import shared_dir

BASE = """
SELECT event_id, ts, user_id, event_type, value,
       CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) AS k
FROM events
"""

VIEWS = """
SELECT event_id AS id,
 CASE WHEN event_id % 19 = 0 THEN 'f' || lpad(CAST(user_id AS STRING),15,'0')
      ELSE lpad(CAST(user_id AS STRING),16,'0') END AS visitor_id,
 CASE WHEN k % 10 = 0 THEN '/' WHEN k % 3 = 0 THEN '/p' || CAST(k % 20 AS STRING)
      ELSE '/docs/p' || CAST(k % 20 AS STRING) END AS path,
 'site-' || CAST(event_id % 3 AS STRING) AS site_id,
 lpad(CAST(user_id AS STRING),16,'0') || '-' || CAST(CAST(ts AS DATE) AS STRING) AS session_id,
 CASE WHEN k % 10 = 1 THEN NULL WHEN k % 10 = 2 THEN 0
      ELSE 800 + event_id * 37 % 5000 END AS interaction_ms,
 CASE user_id % 5 WHEN 0 THEN 390 WHEN 1 THEN 820 WHEN 2 THEN 1366 WHEN 3 THEN 1920 END AS screen_width,
 CASE user_id % 5 WHEN 0 THEN 844 WHEN 1 THEN 1180 WHEN 2 THEN 768 WHEN 3 THEN 1080 END AS screen_height,
 CASE user_id % 5 WHEN 0 THEN 'mobile' WHEN 1 THEN 'tablet' WHEN 2 THEN 'desktop'
      WHEN 3 THEN 'desktop' END AS device_type,
 CASE user_id % 5 WHEN 0 THEN 'iOS 17.2' WHEN 1 THEN 'Android 14' WHEN 2 THEN 'Windows 10/11'
      WHEN 3 THEN 'macOS 14' END AS os_name,
 CASE user_id % 4 WHEN 0 THEN 'Safari' WHEN 1 THEN 'Chrome' WHEN 2 THEN 'Edge' END AS browser_name,
 CASE user_id % 4 WHEN 0 THEN '17.2' WHEN 1 THEN '120.0.0.0' END AS browser_version,
 CASE (user_id + k) % 5 WHEN 0 THEN 'NO' WHEN 1 THEN 'US' WHEN 2 THEN 'DE' WHEN 3 THEN 'CN' END AS country_code,
 CAST(user_id % 2 AS INT) AS is_returning,
 CASE k % 5 WHEN 0 THEN 'https://www.google.com' WHEN 1 THEN 'https://t.co'
      WHEN 2 THEN 'https://chatgpt.com' WHEN 3 THEN 'https://example.com'
      ELSE 'direct_or_unknown' END AS referrer,
 CASE k % 5 WHEN 0 THEN 'search' WHEN 1 THEN 'social' WHEN 2 THEN 'ai'
      ELSE 'direct_or_unknown' END AS referrer_type,
 CAST(CASE WHEN event_id % 17 = 0 THEN -1 ELSE (k * 7 + user_id) % 101 END AS INT) AS bot_score,
 CASE WHEN k % 6 = 0 THEN '{"geo":30,"headers":10}' WHEN k % 6 = 1 THEN '{"correlated":{"penalty":30}}'
      WHEN k % 6 = 2 THEN '{}' END AS bot_score_detail,
 CAST(CASE WHEN k % 11 = 0 THEN 1 ELSE 0 END AS INT) AS is_pwa,
 CASE WHEN k % 4 < 3 AND k % 7 > 0 THEN 'src-' || CAST(k % 7 AS STRING) END AS utm_source,
 CASE WHEN k % 4 < 3 AND k % 3 > 0 THEN CASE WHEN k % 3 = 1 THEN 'email' ELSE 'cpc' END END AS utm_medium,
 CASE k % 4 WHEN 0 THEN 'spring' WHEN 1 THEN 'summer' WHEN 2 THEN 'ghost' END AS utm_campaign,
 CASE WHEN k % 4 < 3 AND k % 2 = 0 THEN 'hero' END AS utm_content,
 CASE WHEN k % 4 < 3 AND k % 6 = 1 THEN 'shoes' END AS utm_term,
 ts AS created_at
FROM base WHERE event_type IN ('view','error')
"""

EVENTS = """
SELECT event_id AS id,
 CASE event_type WHEN 'signup' THEN 'form_submit' WHEN 'purchase' THEN 'custom' ELSE 'click' END AS event_type,
 'site-' || CAST(event_id % 3 AS STRING) AS site_id,
 lpad(CAST(user_id AS STRING),16,'0') || '-' || CAST(CAST(ts AS DATE) AS STRING) AS session_id,
 lpad(CAST(user_id AS STRING),16,'0') AS visitor_id,
 CASE event_type WHEN 'purchase' THEN '{"name":"purchase","amount":' || CAST(k AS STRING) || '}'
      ELSE '{"tag":"A","path":"/p' || CAST(k % 20 AS STRING) || '"}' END AS data,
 CASE k % 3 WHEN 0 THEN 'exp-1' WHEN 1 THEN 'exp-2' END AS experiment_id,
 CASE WHEN k % 3 = 2 THEN NULL WHEN user_id % 2 = 0 THEN 'control' ELSE 'b' END AS variant_id,
 CASE k % 4 WHEN 0 THEN 'spring' WHEN 1 THEN 'summer' WHEN 2 THEN 'ghost' END AS utm_campaign,
 CASE WHEN user_id % 5 < 2 THEN 'mobile' ELSE 'desktop' END AS device_type,
 CAST(NULL AS STRING) AS referrer,
 CAST(extract(hour FROM ts) AS INT) AS hour,
 CAST(extract(month FROM ts) AS INT) AS month,
 CAST({dow} AS INT) AS day_of_week,
 CAST(user_id % 2 AS INT) AS is_returning,
 CAST(CASE WHEN event_id % 17 = 0 THEN -1 ELSE (k * 7 + user_id) % 101 END AS INT) AS bot_score,
 CASE WHEN k % 6 = 0 THEN '{"geo":30,"headers":10}' WHEN k % 6 = 1 THEN '{"correlated":{"penalty":30}}' END AS bot_score_detail,
 ts AS created_at
FROM base WHERE event_type IN ('click','signup','purchase')
"""

# Visitors taken out by the site owner: a list derived from the user table.
EXCLUDED = """
SELECT lpad(CAST(user_id AS STRING),16,'0') AS visitor_id,
       'office ' || CAST(user_id AS STRING) AS label, min(ts) AS created_at
FROM base WHERE user_id % 13 = 0 GROUP BY user_id
"""

# Registered campaigns: those seen on a site except 'ghost', plus one per site never seen.
CAMPAIGNS = """
SELECT utm_campaign || '@' || site_id AS id, upper(utm_campaign) AS name, utm_campaign, site_id,
       CASE utm_campaign WHEN 'summer' THEN 'paused' ELSE 'active' END AS status,
       min(created_at) AS created_at
FROM views WHERE utm_campaign IN ('spring','summer') GROUP BY utm_campaign, site_id
UNION ALL
SELECT 'nobody@' || site_id, 'Never seen', 'nobody', site_id, 'active', max(created_at)
FROM views GROUP BY site_id
"""

EXPERIMENTS = """
SELECT experiment_id, 'Test ' || experiment_id AS name, CAST(NULL AS STRING) AS description,
       CASE experiment_id WHEN 'exp-1' THEN 'active' ELSE 'completed' END AS status,
       CASE experiment_id WHEN 'exp-1' THEN 'custom' ELSE 'form_submit' END AS metric_event_type,
       80 AS allocation_percent, min(created_at) AS created_at
FROM sem_events WHERE experiment_id IS NOT NULL GROUP BY experiment_id
UNION ALL
SELECT 'exp-3', 'Draft', CAST(NULL AS STRING), 'draft', 'click', 100, max(created_at) FROM sem_events
"""

VARIANTS = """
SELECT experiment_id, variant_id, upper(variant_id) AS name,
       CASE variant_id WHEN 'control' THEN 50 ELSE 30 END AS weight,
       CASE variant_id WHEN 'control' THEN 1 ELSE 0 END AS is_control,
       CAST(NULL AS STRING) AS config
FROM sem_events WHERE experiment_id IS NOT NULL GROUP BY experiment_id, variant_id
UNION ALL
SELECT experiment_id, 'c', 'C', 20, 0, CAST(NULL AS STRING) FROM sem_events
WHERE experiment_id = 'exp-2' GROUP BY experiment_id
"""

METRICS = """
SELECT event_id AS id, ts AS recorded_at, CAST(NULL AS STRING) AS commit_hash,
       CAST(NULL AS STRING) AS branch, event_type AS category, 'm' || CAST(k % 3 AS STRING) AS metric,
       value, 'ms' AS unit, CAST(NULL AS STRING) AS metadata
FROM base
"""

REQUESTS = """
SELECT event_id AS id, ts, value AS duration_ms, '/api/r' || CAST(k % 10 AS STRING) AS path,
       CASE WHEN event_type = 'error' THEN 500 ELSE 200 END AS status
FROM base
"""

PRINTS = """
SELECT 'ip-' || CAST(id % 12 AS STRING) AS ip_hash, visitor_id, site_id,
       coalesce(os_name, 'unknown') AS os_name, coalesce(browser_name, 'unknown') AS browser_name,
       coalesce(browser_version, 'unknown') AS browser_version,
       coalesce(screen_width, 0) AS screen_width, coalesce(screen_height, 0) AS screen_height,
       coalesce(country_code, 'unknown') AS country_code,
       CASE id % 3 WHEN 0 THEN 'en' WHEN 1 THEN 'nb' ELSE 'de' END AS accept_language,
       id % 97 = 0 AS headless_tainted, created_at AS ts
FROM views
"""

# Raw pixel requests, one per event.
HITS = """
SELECT event_id AS hit_id, ts,
 CASE WHEN user_id % 5 = 4 THEN '2001:db8:' || lower(hex(user_id % 4096)) || '::1'
      WHEN user_id % 10 = 3 THEN '::ffff:10.0.' || CAST(user_id % 4 AS STRING) || '.' || CAST(user_id % 200 AS STRING)
      ELSE '10.0.' || CAST(user_id % 4 AS STRING) || '.' || CAST(user_id % 200 AS STRING) END AS remote_addr,
 CAST(NULL AS STRING) AS cf_connecting_ip,
 CASE WHEN user_id % 7 = 0 THEN '203.0.113.' || CAST(user_id % 250 AS STRING) || ', 10.9.9.9' END AS x_forwarded_for,
 CAST(NULL AS STRING) AS x_real_ip,
 CASE user_id % 9
  WHEN 0 THEN 'Mozilla/5.0 (Windows NT 10.0; Win64; x64) AppleWebKit/537.36 (KHTML, like Gecko) Chrome/120.0.0.0 Safari/537.36'
  WHEN 1 THEN 'Mozilla/5.0 (Windows NT 6.1) AppleWebKit/537.36 (KHTML, like Gecko) Chrome/119.0.0.0 Safari/537.36 Edg/119.0.2151.58'
  WHEN 2 THEN 'Mozilla/5.0 (X11; Linux x86_64; rv:121.0) Gecko/20100101 Firefox/121.0'
  WHEN 3 THEN 'Mozilla/5.0 (iPhone; CPU iPhone OS 17_2 like Mac OS X) AppleWebKit/605.1.15 (KHTML, like Gecko) Version/17.2 Mobile/15E148 Safari/604.1'
  WHEN 4 THEN 'Mozilla/5.0 (Macintosh; Intel Mac OS X 10_15_7) AppleWebKit/537.36 (KHTML, like Gecko) Chrome/118.0.0.0 Safari/537.36 OPR/104.0.0.0'
  WHEN 5 THEN 'Mozilla/5.0 (Linux; Android 14; SM-S901B) AppleWebKit/537.36 (KHTML, like Gecko) SamsungBrowser/23.0 Chrome/115.0.0.0 Mobile Safari/537.36'
  WHEN 6 THEN 'Mozilla/5.0 (Linux; U; Android 12) AppleWebKit/537.36 UCBrowser/13.4.0.1306 Mobile Safari/537.36'
  WHEN 7 THEN 'curl/8.4.0'
  ELSE 'Mozilla/5.0 (compatible; FeedCheck/1.0; +http://feeds.example)' END AS user_agent,
 CASE WHEN k % 9 > 0 THEN 'en-US,en;q=0.' || CAST(k % 3 AS STRING) END AS accept_language,
 CASE WHEN k % 4 = 0 THEN '"Chromium";v="120"' END AS sec_ch_ua,
 CASE WHEN k % 5 > 0 THEN 'same-origin' END AS sec_fetch_site,
 CASE (user_id + k) % 6 WHEN 0 THEN 'no' WHEN 1 THEN 'US' WHEN 2 THEN 'XX' WHEN 3 THEN 'CN' WHEN 4 THEN 'T1' END AS cf_ipcountry,
 CAST(NULL AS STRING) AS cloudfront_viewer_country,
 CASE WHEN k % 8 = 0 THEN 'de' END AS x_country_code,
 CASE k % 12 WHEN 0 THEN '1' WHEN 1 THEN '25' WHEN 2 THEN '45' WHEN 3 THEN '99' WHEN 4 THEN 'junk' WHEN 5 THEN '150' END AS cf_bot_score,
 CASE WHEN k % 24 = 0 THEN 'true' ELSE 'false' END AS cf_verified_bot,
 CASE WHEN user_id % 3 = 0 THEN lpad(CAST(user_id AS STRING),16,'0') WHEN user_id % 3 = 1 THEN 'not-a-cookie' END AS cookie_ev,
 CASE WHEN event_id % 41 = 0 THEN '%%%' WHEN event_id % 43 = 0 THEN NULL
      ELSE {b64:'/docs/p' || CAST(k % 20 AS STRING) || CASE WHEN k % 3 = 0 THEN '/caf%C3%A9+x' ELSE '' END} END AS p,
 CASE WHEN event_id % 53 = 0 THEN 'smoke-test' WHEN event_id % 59 = 0 THEN 'bad site!'
      ELSE 'site-' || CAST(event_id % 3 AS STRING) END AS s,
 CASE WHEN k % 10 > 0 THEN 'aaaaaaaa-0000-0000-0000-' || lpad(CAST(user_id AS STRING),12,'0') ELSE 'short' END AS sid,
 CASE k % 6 WHEN 0 THEN {b64:'https://www.google.com/search?q=x'} WHEN 1 THEN {b64:'http://news.t.co:8080/abc'}
      WHEN 2 THEN {b64:'https://chat.openai.com/'} WHEN 3 THEN {b64:'not a url'} WHEN 4 THEN '***' END AS ref,
 CASE user_id % 6 WHEN 0 THEN '390' WHEN 1 THEN '820px' WHEN 2 THEN '1366' WHEN 3 THEN '0' WHEN 4 THEN '20000' END AS sw,
 CASE user_id % 6 WHEN 0 THEN '844' WHEN 1 THEN '1180' WHEN 2 THEN '768' WHEN 3 THEN '0' END AS sh,
 CASE WHEN event_id % 13 = 0 THEN 'spa' WHEN k % 50 = 7 THEN '500' WHEN k % 50 = 8 THEN 'x'
      ELSE CAST(800 + event_id * 37 % 5000 AS STRING) END AS v,
 CASE WHEN k % 2 = 0 THEN '1' END AS ck,
 CASE WHEN k % 11 = 0 THEN '1' END AS pwa,
 CASE k % 4 WHEN 0 THEN {b64:'spring'} WHEN 1 THEN {b64:'summer'} WHEN 2 THEN {b64:'ghost'} END AS uc,
 CASE WHEN k % 7 > 0 THEN {b64:'src%20' || CAST(k % 7 AS STRING)} END AS us,
 CASE WHEN k % 3 = 1 THEN {b64:'email'} WHEN k % 3 = 2 THEN '!!' END AS um,
 CASE WHEN k % 2 = 0 THEN {b64:'hero'} END AS uct,
 CASE WHEN k % 6 = 1 THEN {b64:'shoes'} END AS ut,
 CASE WHEN event_id % 11 = 0 THEN 'missing' WHEN event_id % 23 = 0 THEN 'invalid' ELSE 'valid' END AS pow_result
FROM base
"""

# Event posts, one per event, most with one to three client events; some with entries
# that are no objects, with more events than a post may have, or with long data.
POSTS = """
SELECT hit_id AS post_id, ts, remote_addr, cf_connecting_ip, x_forwarded_for, x_real_ip, user_agent,
 accept_language, sec_ch_ua,
 CASE hit_id % 3 WHEN 0 THEN '?1' WHEN 1 THEN '?0' END AS sec_ch_ua_mobile,
 sec_fetch_site, cf_ipcountry, cloudfront_viewer_country, x_country_code, cf_bot_score, cf_verified_bot,
 cookie_ev,
 CASE hit_id % 4 WHEN 0 THEN 'https://shop.example:8443/a/b?c=d' WHEN 1 THEN 'nonsense' END AS referer,
 CASE WHEN hit_id % 37 = 0 THEN '{broken' WHEN hit_id % 31 = 0 THEN '{"events":[]}'
 WHEN hit_id % 17 = 0 THEN '{"events":[5,{"type":"click","data":{"tag":"A"}},null,"x",[1],{"type":"custom"}],"siteId":"' || s || '"}'
 WHEN hit_id % 19 = 0 THEN '{"siteId":"' || s || '","events":[' || repeat('{"type":"click","data":{}},', 24) || '{"type":"custom","data":{"n":25}}]}'
 WHEN hit_id % 23 = 0 THEN '{"events":[{"type":"hover","data":{"t":"' || repeat('x', 2040) || '"}},{"type":"hover","data":{"t":"' || repeat('y', 2040 + hit_id % 2) || '"}}],"siteId":"' || s || '","siteId":"site-2"}'
 ELSE '{"events":[{"type":"click","data":{"tag":"A","path":"/p' || CAST(hit_id % 20 AS STRING)
  || '","experiment_id":"exp-1","variant_id":"b"},"sessionId":"' || sid || '","utmCampaign":"spring"}'
  || CASE WHEN hit_id % 2 = 0 THEN ',{"type":"unknown_type","data":{}},{"type":"custom","data":{"name":"buy","n":'
  || CAST(hit_id % 7 AS STRING) || '},"utmCampaign":"ghost"}' ELSE '' END
  || '],"siteId":"' || s || '","tok":"t"}' END AS body,
 pow_result
FROM hits
"""

# API batches, one per event; batch and event ids repeat for every tenth event. Some
# have several events, the version as text, or data that has one of our own names.
BATCHES = """
SELECT event_id AS raw_id, ts AS received_at,
 CASE WHEN event_id % 29 = 0 THEN '{"v":2}' WHEN event_id % 47 = 0 THEN 'junk' ELSE
 '{"v":' || CASE WHEN event_id % 71 = 0 THEN '"1"' WHEN event_id % 73 = 0 THEN 'true' WHEN event_id % 79 = 0 THEN '1.0' ELSE '1' END || ',"batch_id":"' || CASE WHEN event_id % 61 = 0 THEN 'nope' ELSE '00000000-0000-4000-8000-' || lpad(CAST(event_id AS STRING),12,'0') END
 || '","sent_at":"2024-01-01T00:00:00Z","context":{"session_id":"11111111-0000-4000-8000-' || lpad(CAST(user_id AS STRING),12,'0') || '"'
 || CASE WHEN k % 2 = 0 THEN ',"site_id":"site-' || CAST(event_id % 3 AS STRING) || '"' ELSE '' END
 || ',"viewport_width":800,"viewport_height":600,"screen_width":1920,"screen_height":1080,"device_class":"desktop","language":"en"},"events":[{"event_id":"22222222-0000-4000-8000-'
 || lpad(CAST(CASE WHEN event_id % 10 = 9 THEN event_id - 1 ELSE event_id END AS STRING),12,'0')
 || '","type":"' || CASE WHEN event_id % 67 = 0 THEN '9bad' ELSE 'purchase' END || '","ts":"2024-01-01T00:00:00Z"'
 || CASE WHEN k % 3 = 0 THEN ',"experiments":[{"experiment_id":"exp-1","variant_id":"b"}]' ELSE '' END
 || ',"data":{"amount":' || CAST(k AS STRING) || CASE WHEN k % 7 = 0 THEN ',"experiment_id":"own"' ELSE '' END || '}}'
 || CASE WHEN k % 4 = 1 THEN ',{"event_id":"33333333-0000-4000-8000-' || lpad(CAST(event_id - event_id % 3 AS STRING),12,'0')
  || '","type":"click","ts":"2024-01-02T00:00:00Z","experiments":[{"experiment_id":"exp-2"}],"data":{"variant_id":"z","b":{"c":[1,"2"]},"a":"q\\u00e9"}}' ELSE '' END
 || ']}' END AS body
FROM base
"""

# Performance-metric posts, one per event.
METRIC_POSTS = """
SELECT event_id AS raw_id, ts AS received_at,
 CASE WHEN event_id % 29 = 0 THEN '{"category":"x"}' WHEN event_id % 31 = 0 THEN '[{"category":"","metric":"m","value":1,"unit":"ms"}]'
 ELSE '[{"category":"' || event_type || '","metric":"m' || CAST(k % 3 AS STRING) || '","value":' || CAST(k AS STRING)
 || ',"unit":"ms","branch":"main"},{"category":"load","metric":"lcp","value":' || CAST(k * 2 AS STRING) || '.5,"unit":"ms"}]' END AS body
FROM base
"""

# Cloud prefixes of two providers, spread over the address plan of the hits.
PREFIXES = """
SELECT 'aws' AS provider, '10.0.' || CAST(user_id % 4 AS STRING) || '.' || CAST(user_id % 200 AS STRING) || '/30' AS cidr
FROM base WHERE event_type = 'error' GROUP BY user_id
UNION ALL
SELECT 'gcp', '203.0.' || CAST(user_id % 256 AS STRING) || '.0/' || CAST(20 + user_id % 8 AS STRING)
FROM base WHERE event_type = 'signup' GROUP BY user_id
UNION ALL
SELECT 'gcp', '198.51.100.' || CAST(user_id AS STRING) || '/33' FROM base GROUP BY user_id
UNION ALL
SELECT 'aws', '2001:db8:' || lower(hex(user_id % 4096)) || '::/' || CAST(41 + user_id % 8 AS STRING)
FROM base WHERE event_type = 'click' AND user_id % 3 = 0 GROUP BY user_id
"""

# Addresses of proven or suspected bots with the time they were seen.
MARKERS = """
SELECT '10.0.' || CAST(user_id % 4 AS STRING) || '.' || CAST(user_id % 200 AS STRING) AS ip,
       CASE WHEN k % 2 = 0 THEN 'confirmed' ELSE 'suspected' END AS kind, ts
FROM base WHERE event_type = 'error'
"""

# Page navigations with the campaign parameters of their URL.
NAVIGATIONS = """
SELECT event_id AS id, CASE WHEN user_id % 5 > 0 THEN lpad(CAST(user_id AS STRING),16,'0') END AS session_id, ts,
       '/p' || CAST(k % 4 AS STRING) AS path,
       CASE WHEN k % 5 = 0 THEN 'c' || CAST(k % 3 AS STRING) END AS utm_campaign,
       CASE WHEN k % 5 = 0 AND k % 2 = 0 THEN 's' || CAST(k AS STRING) END AS utm_source
FROM base
"""

# Web-vital events as the tracker posts them (CLS scaled by 1000).
VITALS = """
SELECT event_id AS id, 'web_vital' AS event_type,
 '{"metric":"' || CASE k % 4 WHEN 0 THEN 'LCP' WHEN 1 THEN 'CLS' WHEN 2 THEN 'INP' ELSE 'FID' END
 || '","value":' || CAST(CASE k % 4 WHEN 0 THEN k * 60 WHEN 1 THEN k * 4 ELSE k * 9 END AS STRING) || '}' AS data
FROM base
"""

# Name in SQL -> (text, tables it reads)
TABLES = {
    "base": (BASE, ()),
    "views": (VIEWS, ("base",)),
    "sem_events": (EVENTS, ("base",)),
    "excluded": (EXCLUDED, ("base",)),
    "campaigns": (CAMPAIGNS, ("views",)),
    "experiments": (EXPERIMENTS, ("sem_events",)),
    "variants": (VARIANTS, ("sem_events",)),
    "metrics": (METRICS, ("base",)),
    "requests": (REQUESTS, ("base",)),
    "prints": (PRINTS, ("views",)),
    "hits": (HITS, ("base",)),
    "posts": (POSTS, ("hits",)),
    "batches": (BATCHES, ("base",)),
    "metric_posts": (METRIC_POSTS, ("base",)),
    "prefixes": (PREFIXES, ("base",)),
    "markers": (MARKERS, ("base",)),
    "navigations": (NAVIGATIONS, ("base",)),
    "vitals": (VITALS, ("base",)),
}

_ENGINE = {
    "spark": {"dow": "dayofweek(ts) - 1", "b64": "base64(CAST({} AS BINARY))"},
    "duckdb": {"dow": "dayofweek(ts)", "b64": "to_base64(encode({}))"},
}


def render(text: str, engine: str) -> str:
    """Fill in the two expressions that the engines spell differently."""
    names = _ENGINE[engine]
    text = text.replace("{dow}", names["dow"])
    while "{b64:" in text:
        start = text.index("{b64:")
        end = text.index("}", start)
        text = text[:start] + names["b64"].format(text[start + 5 : end]) + text[end + 1 :]
    return text


def _closure(names: tuple[str, ...]) -> list[str]:
    ordered: list[str] = []

    def visit(name: str) -> None:
        for needed in TABLES[name][1]:
            visit(needed)
        if name not in ordered:
            ordered.append(name)

    for name in names:
        visit(name)
    return ordered


def ctes(engine: str, *names: str) -> str:
    return ", ".join(f"{n} AS ({render(TABLES[n][0], engine)})" for n in _closure(names))


# Tables that stand for raw logs, whose decoding is the costly part.
RAW = ("hits", "posts", "batches")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    cores = spark.sparkContext.defaultParallelism
    if name in RAW:
        # a raw log has many files; a test file may be cut into more parts than it has row
        # groups, and parts without one are tasks without rows
        events = events.repartition(max(cores, events.rdd.getNumPartitions()))
    return _select(spark, events, name)


STREAM_FILES = 4
ROW_GROUP = 4 << 20  # bytes; a file of any size is read by many tasks


@lru_cache(maxsize=None)
def _in_order(app: str, sf_dir: str) -> str:
    """The events as files that follow each other in time, a micro-batch each."""
    spark = SparkSession.getActiveSession() or SparkSession.builder.getOrCreate()
    path = shared_dir(spark, "arrivals")
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    parts = [i / STREAM_FILES for i in range(1, STREAM_FILES)]
    bounds = events.agg(F.percentile(at, parts)).first()[0]
    place = sum(((at > b).cast("int") for b in bounds), F.lit(0))
    for number in range(STREAM_FILES):
        part = events.filter(place == number).repartition(1)  # the input is read by all tasks
        part.write.mode("append").option("parquet.block.size", ROW_GROUP).parquet(path)
    return path


def stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The same table over a stream of files, one in each micro-batch; for tables that
    are projections."""
    path = _in_order(spark.sparkContext.applicationId, sf_dir)
    schema = spark.read.parquet(path).schema
    files = spark.readStream.schema(schema).option("maxFilesPerTrigger", "1").parquet(path)
    if name in RAW:  # decoded by all tasks, as in ``table``
        files = files.repartition(spark.sparkContext.defaultParallelism)
    return _select(spark, files, name)


def _select(spark: SparkSession, events: DataFrame, name: str) -> DataFrame:
    sources = _closure((name,))
    before = [n for n in sources if n != name]
    prefix = ", ".join(f"{n} AS ({render(TABLES[n][0], 'spark')})" for n in before)
    text = (f"WITH {prefix} " if prefix else "") + render(TABLES[name][0], "spark")
    # only whole-word 'events' names the source; 'sem_events' stays a CTE
    text = text.replace("FROM events\n", "FROM {events}\n")
    return spark.sql(
        text.replace("{", "{{").replace("}", "}}").replace("{{events}}", "{events}"),
        events=events,
    )


@lru_cache(maxsize=None)
def _latest(sf_dir: str, name: str, column: str) -> datetime:
    spark = SparkSession.getActiveSession() or SparkSession.builder.getOrCreate()
    return table(spark, sf_dir, name).agg({column: "max"}).first()[0]


def as_of(sf_dir: str, name: str = "views", column: str = "created_at") -> datetime:
    """'Now' of a data set: its newest row."""
    return _latest(sf_dir, name, column)
