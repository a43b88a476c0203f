from __future__ import annotations

import hmac

from datetime import timedelta

import pytest
from pyspark.sql import functions as F

from footfall import schemas
from footfall.functions.labels import display_date, display_time, resolution_label
from footfall.operators.paging import paginate
from footfall.plans import campaigns, experiments, live, overview, performance, visitors
from footfall.plans.reputation import suspected_markers
from footfall.settings import Settings
from footfall.sources.tables import row_by_id
from tests.conftest import NOW

TODAY = NOW.date()
SCOPE = dict(site="site", as_of=NOW)


def daily(table, *changes):
    row = dict(
        site_id="site", date=TODAY - timedelta(days=1), device_type="desktop", country_code="NO",
        is_returning=0, visits=1, unique_visitors=1, avg_interaction_ms=1000,
    )
    return table(schemas.DAILY, *[row | c for c in changes])


def test_overview_of_nothing_is_zero_and_empty(views, table):
    empty = views({}).limit(0)
    sections = overview.overview(empty, daily(table, {}).limit(0), **SCOPE)
    assert sections["visits"].first()[0] == 0
    assert sections["unique_visitors"].first()[0] == 0
    assert sections["avg_interaction_ms"].first()[0] == 0
    for name in ("top_paths", "devices", "countries", "referrers", "daily_trend"):
        assert sections[name].collect() == []


def test_overview_adds_history_and_today(views, table):
    history = daily(
        table,
        {"visits": 50, "unique_visitors": 30},
        {"visits": 1, "unique_visitors": 40, "device_type": "mobile", "avg_interaction_ms": 2001},
        {"visits": 99, "unique_visitors": 99, "date": TODAY},  # today's rollup is not counted twice
        {"visits": 7, "date": TODAY - timedelta(days=60)},
    )
    fresh = views({}, {"visitor_id": "v2"}, {"visitor_id": "bot", "bot_score": 80}, {"bot_score": -1})
    assert overview.overview_visits(fresh, history, **SCOPE).first()[0] == 53
    assert overview.overview_unique_visitors(fresh, history, **SCOPE).first()[0] == 42
    assert overview.overview_avg_interaction(history, **SCOPE).first()[0] == 1500
    assert overview.devices(history, **SCOPE).first().asDict() == {
        "device_type": "desktop", "visits": 149,
    }


def test_realtime_counts_people_only(views):
    old = NOW - timedelta(minutes=6)
    table = views(
        {}, {"visitor_id": "v2", "bot_score": 10}, {"visitor_id": "b", "bot_score": 70},
        {"visitor_id": "v3", "created_at": old}, {"visitor_id": "api", "bot_score": -1},
    )
    assert tuple(live.realtime_active(table, **SCOPE).first()) == (2, 2)
    assert tuple(live.dashboard_now(table, **SCOPE).first()) == (2, 1, 2)
    assert tuple(live.summary_24h(table, as_of=NOW).first()) == (5, 3, 1, 5)


def test_labels(value, spark):
    got = value(
        resolution_label(F.lit("80x25")), resolution_label(F.lit("1920x1080")),
        display_time(F.lit("2024-07-01 22:30:00").cast("timestamp_ntz"), "Europe/Oslo"),
        display_time(F.lit(None).cast("timestamp_ntz")),
    )
    assert got == ("80×25 (IBM PC)", "1920x1080", "2024-07-02 00:30", "-")


def campaign_row(**change):
    return dict(id="c1", name="Spring", utm_campaign="spring", site_id="site", status="active", created_at=NOW) | change


def test_campaign_stats_keep_zeros(views, table):
    registered = table(schemas.CAMPAIGNS, campaign_row(), campaign_row(id="c2", utm_campaign="none"))
    seen = views({"utm_campaign": "spring"}, {"utm_campaign": "spring", "visitor_id": "v2"}, {})
    got = [(r.id, r.views, r.visitors) for r in campaigns.campaign_stats(registered, seen, as_of=NOW).collect()]
    assert got == [("c1", 2, 2), ("c2", 0, 0)]
    one = campaigns.campaign_stats(registered, seen, campaign_id="c2", as_of=NOW)
    assert [r.id for r in one.collect()] == ["c2"]


def test_organic_views_meet_organic_events(views, events, table):
    registered = table(schemas.CAMPAIGNS, campaign_row())
    seen = views({}, {"visitor_id": "v2"}, {"utm_campaign": "spring"})
    done = events({}, {}, {"utm_campaign": "spring", "event_type": "custom"})
    got = campaigns.campaign_events(seen, done, registered, **SCOPE).collect()
    organic, spring = got
    assert (organic.utm_campaign, organic.visitors, organic.event_visitors, organic.events) == (None, 2, 1, 2)
    assert organic.event_rate == 0.5 and organic.events_per_visitor == 1.0
    assert (spring.campaign_id, spring.visitors) == ("c1", 1)
    document = campaigns.campaign_events_document(seen, done, registered, event_type="custom", **SCOPE)
    by_campaign = {r.utm_campaign: r for r in document.collect()}
    assert by_campaign[None].events == 0  # the type filter does not apply to the breakdown
    assert [t.event_type for t in by_campaign[None].event_types] == ["click"]


def experiment_tables(table):
    exps = table(
        schemas.EXPERIMENTS,
        dict(experiment_id="e", name="E", status="active", metric_event_type="buy"),
        dict(experiment_id="d", name="D", status="draft", metric_event_type="buy"),
    )
    vs = table(
        schemas.VARIANTS,
        dict(experiment_id="e", variant_id="control", name="C", weight=1, is_control=1),
        dict(experiment_id="e", variant_id="b", name="B", weight=1, is_control=0),
        dict(experiment_id="d", variant_id="control", name="C", weight=1, is_control=1),
    )
    return exps, vs


def shown(variant, first, count, converted):
    base = dict(experiment_id="e", variant_id=variant)
    seen = [base | dict(session_id=f"{variant}{i}", event_type="view") for i in range(first, first + count)]
    return seen + [base | dict(session_id=f"{variant}{i}", event_type="buy") for i in range(first, first + converted)]


def test_experiment_results(events, table):
    exps, vs = experiment_tables(table)
    few = experiments.experiment_stats(exps, vs, events(*shown("control", 0, 5, 1)))
    control, other = few.collect()
    assert (control.impressions, control.conversions, control.significance) == (5, 1, "Not enough data")
    assert (other.impressions, other.relative_uplift) == (0, -1.0)
    assert other.significance == "Not yet — need more data (0 < 100 impressions)"
    assert experiments.experiment_stats(exps, vs, events({}), experiment_id="d").count() == 1

    many = events(*shown("control", 0, 200, 20), *shown("b", 0, 200, 60))
    assert experiments.experiment_stats(exps, vs, many).collect()[1].significance.endswith("99%")
    level = events(*shown("control", 0, 100, 0), *shown("b", 0, 100, 0))
    row = experiments.experiment_stats(exps, vs, level).collect()[1]
    assert (row.significance, row.relative_uplift) == ("No variance", None)


def test_variant_assignment_is_stable_and_weighted(spark, table):
    exps = table(schemas.EXPERIMENTS, dict(experiment_id="e", status="active", allocation_percent=100))
    vs = table(
        schemas.VARIANTS,
        dict(experiment_id="e", variant_id="a", weight=3), dict(experiment_id="e", variant_id="b", weight=1),
    )
    asked = spark.range(4000).select(F.col("id").cast("string").alias("visitor_id"), F.lit("e").alias("experiment_id"))
    counts = dict(experiments.assign_variants(asked, exps, vs).groupBy("variant_id").count().collect())
    assert sum(counts.values()) == 4000 and 900 < counts["b"] < 1100


@pytest.mark.parametrize(
    "page, number, size", [(1, 1, 25), (3, 3, 10), (9, 3, 10), (-5, 1, 25)]
)
def test_paging_clamps(spark, page, number, size):
    got = paginate(spark.range(60), "id", page=page)
    assert (got.page, got.total, got.total_pages, got.rows.count()) == (number, 60, 3, size)


def test_paging_of_nothing(spark):
    got = paginate(spark.range(0), "id", page=4)
    assert (got.page, got.total_pages, got.rows.count()) == (1, 1, 0)


def test_listing_filters(views, excluded):
    table = views(
        {"visitor_id": "a_1", "path": "/100%"}, {"visitor_id": "ab1", "bot_score": 60},
        {"visitor_id": "ab1", "is_returning": 1}, {"visitor_id": "A_2"},
    )
    found = visitors.visitors_listing(table, excluded("a_1"), search="a_").rows.collect()
    assert [(r.visitor_id, r.is_excluded) for r in found] == [("A_2", 0), ("a_1", 1)]
    assert visitors.visitor_list(table, bot="suspect").count() == 1
    assert visitors.visitor_list(table, returning="returning").count() == 1
    assert visitors.pageview_list(table, search="0%").count() == 1
    with pytest.raises(ValueError):
        visitors.pageviews_listing(table, sort="views_desc")


def test_score_detail(views):
    table = views({"bot_score": 40, "bot_score_detail": '{"geo":30,"headers":10}'}, {"bot_score_detail": "{bad"})
    got = visitors.score_detail(table, row_id=1).collect()
    assert {(r.score, r.factor, r.points) for r in got} == {(40, "geo", "30"), (40, "headers", "10")}
    assert [tuple(r) for r in visitors.score_detail(table, row_id=2).collect()] == [(0, None, None)]


def test_suspicious_and_excluded(views, excluded):
    table = views(
        {"bot_score": 60}, {"bot_score": 30, "device_type": "mobile"}, {"visitor_id": "v2", "bot_score": 10},
    )
    top = visitors.suspicious_visitors(table, excluded("v1")).collect()
    assert [(r.visitor_id, r.max_bot_score, r.devices, r.is_excluded, r.band) for r in top] == [
        ("v1", 60, "desktop,mobile", 1, "high")
    ]
    report = visitors.excluded_report(excluded("v1", "ghost"), table).collect()
    assert {(r.visitor_id, r.pageviews, r.max_bot_score) for r in report} == {("v1", 2, 60), ("ghost", 0, None)}


def test_request_stats(spark):
    log = spark.createDataFrame(
        [(i, NOW - timedelta(seconds=i), float(i), "/a", 500 if i == 1 else 200) for i in range(1, 101)]
        + [(200, NOW - timedelta(hours=1), 9999.0, "/old", 200)],
        schemas.REQUESTS,
    )
    r = performance.request_stats(log, as_of=NOW).first()
    assert (r.total_requests, r.total_errors, r.recent_requests) == (101, 1, 100)
    assert (r.p50_ms, r.p95_ms, r.p99_ms, r.max_ms) == (50.0, 95.0, 99.0, 100.0)
    assert (r.rps, r.error_rate) == (0.33, 0.99)
    none = performance.request_stats(log.limit(0), as_of=NOW).first()
    assert (none.total_requests, none.p99_ms, none.error_rate) == (0, 0.0, 0.0)


def test_campaign_detail_sections(views):
    seen = views({"utm_campaign": "spring", "utm_source": "news"}, {"utm_campaign": "spring"}, {})
    detail = campaigns.campaign_detail(seen, utm_campaign="spring", **SCOPE)
    got = {name: [tuple(r) for r in df.collect()] for name, df in detail.items()}
    assert sorted(got["by_source"]) == [("direct", 1, 1), ("news", 1, 1)]
    assert got["by_medium"] == [("none", 2, 1)] and got["by_term"] == [("none", 2)]
    assert got["daily_trend"] == [("2024-03-10", 2, 1)] and got["top_paths"] == [("/", 2, 1)]


def test_small_helpers(spark, views, hits, value):
    assert row_by_id(views({}, {"path": "/x"}), 2).first().path == "/x"
    assert value(display_date(F.lit("2024-03-10 23:30:00").cast("timestamp_ntz"), "Asia/Tokyo")) == ("2024-03-11",)
    seen = hits({"user_agent": "Wget/1"}, {}).withColumn("ip", F.col("remote_addr"))
    (marker,) = suspected_markers(seen, Settings()).collect()
    digest = hmac.new(b"change-me", b"198.51.100.1", "sha256").hexdigest()
    assert (marker.ip_hash, marker.kind) == (digest, "suspected")
