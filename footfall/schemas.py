"""Table schemas. Times are UTC wall-clock values (TIMESTAMP_NTZ), so that no
result depends on the session time zone and time filters reach the scan."""

from pyspark.sql.types import StructType


def _table(**columns: str | StructType) -> StructType:
    schema = StructType()
    for name, kind in columns.items():
        schema.add(name, kind)
    return schema


VIEWS = _table(
    id="long", visitor_id="string", path="string", site_id="string", session_id="string",
    interaction_ms="long", screen_width="integer", screen_height="integer",
    device_type="string", os_name="string", browser_name="string", browser_version="string",
    country_code="string", is_returning="integer", referrer="string",
    referrer_type="string", bot_score="integer", bot_score_detail="string",
    is_pwa="integer", utm_source="string", utm_medium="string", utm_campaign="string",
    utm_content="string", utm_term="string", created_at="timestamp_ntz",
)

EVENTS = _table(
    id="long", event_type="string", site_id="string", session_id="string",
    visitor_id="string", data="string", experiment_id="string", variant_id="string",
    utm_campaign="string", device_type="string", referrer="string", hour="integer",
    month="integer", day_of_week="integer", is_returning="integer", bot_score="integer",
    bot_score_detail="string", created_at="timestamp_ntz",
)

DAILY = _table(
    site_id="string", date="date", device_type="string", country_code="string",
    is_returning="integer", visits="long", unique_visitors="long",
    avg_interaction_ms="long",
)

EXCLUDED = _table(
    visitor_id="string", label="string", created_at="timestamp_ntz",
)

EXPERIMENTS = _table(
    experiment_id="string", name="string", description="string", status="string",
    metric_event_type="string", allocation_percent="integer", created_at="timestamp_ntz",
    started_at="timestamp_ntz", ended_at="timestamp_ntz",
)

VARIANTS = _table(
    experiment_id="string", variant_id="string", name="string", weight="integer",
    is_control="integer", config="string",
)

CAMPAIGNS = _table(
    id="string", name="string", utm_campaign="string", site_id="string", status="string",
    created_at="timestamp_ntz",
)

METRICS = _table(
    id="long", recorded_at="timestamp_ntz", commit_hash="string", branch="string",
    category="string", metric="string", value="double", unit="string", metadata="string",
)

REQUESTS = _table(
    id="long", ts="timestamp_ntz", duration_ms="double", path="string", status="integer",
)

# One tracking-pixel request: headers, cookie and query parameters as received.
HITS = _table(
    hit_id="long", ts="timestamp_ntz", remote_addr="string", cf_connecting_ip="string",
    x_forwarded_for="string", x_real_ip="string", user_agent="string",
    accept_language="string", sec_ch_ua="string", sec_fetch_site="string",
    cf_ipcountry="string", cloudfront_viewer_country="string", x_country_code="string",
    cf_bot_score="string", cf_verified_bot="string", cookie_ev="string", p="string",
    s="string", sid="string", ref="string", sw="string", sh="string", v="string",
    ck="string", pwa="string", uc="string", us="string", um="string", uct="string",
    ut="string", pow_result="string",
)

# One event post: the same headers plus the JSON body.
POSTS = _table(
    post_id="long", ts="timestamp_ntz", remote_addr="string", cf_connecting_ip="string",
    x_forwarded_for="string", x_real_ip="string", user_agent="string",
    accept_language="string", sec_ch_ua="string", sec_ch_ua_mobile="string",
    sec_fetch_site="string", cf_ipcountry="string", cloudfront_viewer_country="string",
    x_country_code="string", cf_bot_score="string", cf_verified_bot="string",
    cookie_ev="string", referer="string", body="string", pow_result="string",
)

# API batches and performance-metric posts: body as received.
RAW_BODIES = _table(
    raw_id="long", received_at="timestamp_ntz", body="string",
)

PRINTS = _table(
    ip_hash="string", visitor_id="string", site_id="string",
    fingerprint=_table(
        os_name="string", browser_name="string", browser_version="string",
        screen_width="integer", screen_height="integer", country_code="string",
        accept_language="string",
    ),
    headless_tainted="boolean", ts="timestamp_ntz",
)

MAINTENANCE_LOG = _table(
    date="date", status="string", rollup_rows="long", purge_views="long",
    purge_events="long",
)

TABLES = {
    "visitor_views": VIEWS,
    "semantic_events": EVENTS,
    "visitor_views_daily": DAILY,
    "excluded_visitors": EXCLUDED,
    "experiments": EXPERIMENTS,
    "experiment_variants": VARIANTS,
    "utm_campaigns": CAMPAIGNS,
    "perf_metrics": METRICS,
    "request_log": REQUESTS,
}
