from __future__ import annotations

from datetime import timedelta

import pytest
from pyspark.sql import functions as F

from footfall import schemas
from footfall.plans import correlate, enrich, ingest, maintenance, posts, retention, rollup, sessions
from footfall.session import shared_dir
from footfall.settings import Settings
from footfall.sources.tables import append_facts, insert_absent, overwrite_partitions, read_table, upsert
from tests.conftest import NOW

DAY = NOW.date()


# --- rollup and retention ---------------------------------------------------------------


def test_rollup_segments_and_filters(views, excluded):
    table = views(
        {}, {"visitor_id": "v2", "interaction_ms": 2001}, {"visitor_id": "v2", "interaction_ms": 0},
        {"visitor_id": "v3", "device_type": None, "country_code": None, "interaction_ms": None},
        {"visitor_id": "bot", "bot_score": 50}, {"visitor_id": "api", "bot_score": -1},
        {"visitor_id": "office"}, {"created_at": NOW + timedelta(days=1)},
    )
    got = {r.device_type: r for r in rollup.daily_rollup(table, excluded("office"), str(DAY)).collect()}
    assert (got["desktop"].visits, got["desktop"].unique_visitors, got["desktop"].avg_interaction_ms) == (3, 2, 1500)
    assert (got["unknown"].country_code, got["unknown"].avg_interaction_ms) == ("unknown", 0)
    with pytest.raises(ValueError):
        rollup.daily_rollup(table, excluded(), "10 March")


def test_sketches_merge_over_days(views, excluded):
    table = views({}, {"created_at": NOW + timedelta(days=1)}, {"visitor_id": "v2"})
    sketches = rollup.rollup_sketches(table, excluded())
    assert rollup.approx_uniques(sketches, "site_id").first().approx_visitors == 2


def test_purge(views, events, table):
    old = NOW - timedelta(days=1000)
    young = NOW - timedelta(days=10)
    metrics = table(schemas.METRICS, dict(id=1, recorded_at=old), dict(id=2, recorded_at=NOW))
    tables = {
        "visitor_views": views({"created_at": old}, {}, {"created_at": young, "bot_score": 90}),
        "semantic_events": events({"created_at": old}, {}, {"created_at": young, "bot_score": -1}),
        "visitor_views_daily": table(schemas.DAILY, dict(date=old.date()), dict(date=DAY)),
        "perf_metrics": metrics,
    }
    counts = retention.purge_counts(tables, as_of=NOW, days=30, bot_days=5).first().asDict()
    assert set(counts.values()) == {1}
    kept = retention.retained(tables, as_of=NOW, days=30, bot_days=5)
    assert {n: df.count() for n, df in kept.items()} == {n: 1 for n in tables}
    again = retention.purge_counts(kept, as_of=NOW, days=30, bot_days=5).first().asDict()
    assert set(again.values()) == {0}


def test_nightly_backfills_and_repeats(spark, views, events, excluded, table):
    yesterday, earlier = DAY - timedelta(days=1), DAY - timedelta(days=5)
    tables = {
        "visitor_views": views(
            {"created_at": NOW - timedelta(days=1)}, {"created_at": NOW - timedelta(days=5)},
            {"created_at": NOW - timedelta(days=3)},
        ),
        "semantic_events": events({}),
        "excluded_visitors": excluded(),
        "perf_metrics": table(schemas.METRICS, dict(id=1, recorded_at=NOW)),
    }
    log = table(schemas.MAINTENANCE_LOG, dict(date=earlier, status="failed"))
    path = shared_dir(spark, "daily")
    first = maintenance.run_nightly(spark, tables, log, daily_path=path, as_of=NOW)
    # the failed day and those that nobody logged
    days = {earlier + timedelta(days=i) for i in range(4)}
    assert {(r.date, r.status, r.rollup_rows) for r in first.log.collect()} == {
        *[(d, "complete", None) for d in days], (yesterday, "complete", 1),
    }
    maintenance.run_nightly(spark, tables, log, daily_path=path, as_of=NOW)
    assert {r.date for r in spark.read.parquet(path).collect()} == {earlier, yesterday, DAY - timedelta(days=3)}
    assert spark.read.parquet(path).count() == 3


def test_stored_nightly_run(spark, views, events, excluded, monkeypatch):
    root = shared_dir(spark, "root")
    at = lambda days, **more: {"created_at": NOW - timedelta(days=days), **more}
    append_facts(views(at(1), at(2), at(40), at(8), at(8, bot_score=80), at(9, bot_score=-1)), f"{root}/visitor_views")
    append_facts(events(at(1), at(40)), f"{root}/semantic_events")
    options = dict(as_of=NOW, days=30, bot_days=5)
    with monkeypatch.context() as broken:
        broken.setattr(maintenance, "rollup_days", lambda *_: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            maintenance.run_stored(spark, root, excluded(), **(options | {"as_of": NOW - timedelta(days=1)}))
    yesterday = DAY - timedelta(days=1)
    assert [(r.date, r.status) for r in maintenance.read_log(spark, root).collect()] == [(DAY - timedelta(days=2), "failed")]
    log = {r.date: r for r in maintenance.run_stored(spark, root, excluded(), **options).collect()}
    assert {d: r.status for d, r in log.items()} == {DAY - timedelta(days=2): "complete", yesterday: "complete"}
    assert tuple(log[yesterday][2:]) == (1, 3, 1)
    assert spark.read.parquet(f"{root}/visitor_views_daily").count() == 2
    left = spark.read.parquet(f"{root}/visitor_views").collect()
    assert sorted((r.created_at, r.bot_score) for r in left) == [(NOW - timedelta(days=d), 0) for d in (8, 2, 1)]
    assert {r.event_date for r in spark.read.parquet(f"{root}/semantic_events").collect()} == {yesterday}
    again = maintenance.run_stored(spark, root, excluded(), **options)
    assert again.filter(F.col("date") == F.lit(yesterday)).first().purge_views == 0


def test_table_sinks(spark, views, excluded):
    path = shared_dir(spark, "facts")
    append_facts(views({}, {"created_at": NOW + timedelta(days=1)}), path)
    assert read_table(spark, path, "visitor_views").count() == 2
    changed = spark.read.parquet(path).filter(F.col("event_date") == F.lit(DAY)).withColumn("bot_score", F.lit(9))
    overwrite_partitions(changed.checkpoint(), path, "site_id", "event_date")
    assert sorted(r.bot_score for r in spark.read.parquet(path).collect()) == [0, 9]
    assert insert_absent(excluded("a"), excluded("a", "b", "b"), "visitor_id").count() == 2
    new = excluded("a", "c").withColumn("label", F.lit("new"))
    assert {(r.visitor_id, r.label) for r in upsert(excluded("a", "b"), new, "visitor_id").collect()} == {
        ("a", "new"), ("b", "label"), ("c", "new"),
    }


def test_other_formats(spark, views):
    for fmt in ("json", "csv", "orc"):
        path = shared_dir(spark, fmt)
        options = {"header": "true"} if fmt == "csv" else {}
        views({}, {"path": "/x"}).write.options(**options).format(fmt).save(path)
        extra = {"multiLine": "false"} if fmt == "json" else {}
        got = read_table(spark, path, "visitor_views", fmt, **extra)
        assert got.schema == schemas.VIEWS and {r.path for r in got.collect()} == {"/", "/x"}
        assert got.first().created_at == NOW


# --- correlation ----------------------------------------------------------------------------

PRINT = dict(
    os_name="Linux", browser_name="Chrome", browser_version="139", screen_width=1920, screen_height=1080,
    country_code="US", accept_language="en",
)


@pytest.fixture(scope="module")
def prints(spark):
    def build(count, site="site", tainted=False, prefix="ip", **change):
        row = tuple((PRINT | change).values())
        return [(f"{prefix}{i}", f"{prefix}-v{i}", site, row, tainted and i == 0, NOW) for i in range(count)]

    return lambda *groups: spark.createDataFrame(sum(groups, []), schemas.PRINTS), build


def swept(views, events, prints, groups, **kwargs):
    make, build = prints
    table = make(*[build(**g) for g in groups])
    who = [{"visitor_id": r.visitor_id, "site_id": r.site_id, **kwargs} for r in table.collect()]
    done = events(*[w | {"bot_score": 0} for w in who])
    return correlate.sweep(views(*who), done, table, as_of=NOW), table


@pytest.mark.parametrize(
    "groups, points",
    [
        ([dict(count=5)], 0),
        ([dict(count=6)], 30),
        ([dict(count=8)], 50),
        ([dict(count=4, tainted=True)], 50),
        ([dict(count=3), dict(count=3, prefix="x", browser_version="140")], 0),
        ([dict(count=3), dict(count=3, prefix="x", accept_language="de")], 0),
        ([dict(count=3), dict(count=3, prefix="x", site="other")], 0),
    ],
)
def test_cluster_sizes(views, events, prints, groups, points):
    result, _ = swept(views, events, prints, groups)
    assert {r.bot_score for r in result.views.collect()} == {points}
    assert {r.bot_score for r in result.events.collect()} == {points}
    assert result.confirmed.count() == (sum(g["count"] for g in groups) if points else 0)


def test_sweep_is_idempotent_and_leaves_flagged_rows(views, events, prints):
    result, table = swept(views, events, prints, [dict(count=6)])
    stored = result.views.checkpoint()
    again = correlate.sweep(stored, result.events.checkpoint(), table, as_of=NOW)
    assert {r.bot_score for r in again.views.collect()} == {30}
    detail = stored.first().bot_score_detail
    assert detail.startswith('{"correlated":{"reason":"correlated","penalty":30,"cluster_size":6')
    flagged, _ = swept(views, events, prints, [dict(count=6)], bot_score=60)
    assert {r.bot_score for r in flagged.views.collect()} == {60}


def test_stored_sweep_feeds_the_scores(spark, views, events, prints, hits, dims):
    from dataclasses import replace

    from footfall.functions.identity import ip_hash

    make, build = prints
    table = make(build(6), build(2, prefix="x", browser_version="1"))
    base = shared_dir(spark, "facts")
    who = [{"visitor_id": r.visitor_id, "site_id": r.site_id} for r in table.collect()]
    append_facts(views(*who, {"visitor_id": None}, {"visitor_id": "ip-v1", "site_id": "other"}), f"{base}/views")
    append_facts(events(*who), f"{base}/events")
    real = table.withColumn("ip_hash", ip_hash("change-me", F.col("ip_hash")))
    markers = correlate.sweep_stored(spark, f"{base}/views", f"{base}/events", real, stage_dir=f"{base}/stage", as_of=NOW)
    for name in ("views", "events"):
        stored = read_table(spark, f"{base}/{name}", {"views": "visitor_views", "events": "semantic_events"}[name])
        raised = {r.visitor_id for r in stored.filter("bot_score = 30").collect()}
        assert raised == {f"ip-v{i}" for i in range(6)} and stored.filter("bot_score = 30").count() == 6
    rows = hits({"remote_addr": "ip1", "ts": NOW + timedelta(minutes=1)}, {"hit_id": 2, "remote_addr": "x1", "ts": NOW + timedelta(minutes=1)})
    keep_all = Settings(discard_threshold=0)
    scored = enrich.enrich_hits(rows, replace(dims, markers=markers), keep_all, count_bursts=False).views.collect()
    assert {r.id: r.bot_score for r in scored} == {1: 50, 2: 0}


def test_no_event_penalty(views, events):
    aged = NOW - timedelta(minutes=10)
    table = views(
        {"visitor_id": "quiet", "created_at": aged}, {"visitor_id": "busy", "created_at": aged},
        {"visitor_id": "fresh", "created_at": NOW}, {"visitor_id": "bot", "created_at": aged, "bot_score": 70},
        {"visitor_id": "old", "created_at": NOW - timedelta(hours=1)},
    )
    once = correlate.penalise_no_events(table, events({"visitor_id": "busy"}), as_of=NOW).checkpoint()
    twice = correlate.penalise_no_events(once, events({"visitor_id": "busy"}), as_of=NOW)
    got = {r.visitor_id: (r.bot_score, r.bot_score_detail) for r in twice.collect()}
    assert got["quiet"] == (15, '{"no_events":true}')
    assert {k: v[0] for k, v in got.items() if k != "quiet"} == {"busy": 0, "fresh": 0, "bot": 70, "old": 0}


# --- hits and posts -----------------------------------------------------------------------------


@pytest.fixture(scope="module")
def dims(spark, excluded, table):
    campaign = dict(id="c", name="C", utm_campaign="spring", site_id="site", status="active", created_at=NOW)
    return enrich.Dimensions(table(schemas.CAMPAIGNS, campaign), excluded("00000000000000ff"))


CASES = [
    (dict(), None),
    (dict(user_agent="curl/8"), "known_bot"),
    (dict(s="Smoke-Test"), "ignored_site"),
    (dict(v="500"), "interaction"),
    (dict(v=None), "interaction"),
    (dict(v="spa"), None),
    (dict(p="%%%"), "path"),
    (dict(p="bm90LWEtcGF0aA=="), "path"),
    (dict(p="Lw"), None),  # base64 without its padding
    (dict(ck="1", cookie_ev="00000000000000ff"), "excluded"),
    (dict(pow_result="missing"), "discarded"),
]


def test_hit_acceptance(hits, dims):
    table = hits(*[c | {"hit_id": i} for i, (c, _) in enumerate(CASES)])
    result = enrich.enrich_hits(table, dims, Settings(), count_bursts=False)
    rejected = {r.hit_id: r.reject_reason for r in result.rejects.collect()}
    assert [rejected.get(i) for i in range(len(CASES))] == [want for _, want in CASES]
    stored = result.views.collect()
    assert {r.id for r in stored} == {i for i, (_, want) in enumerate(CASES) if want is None}
    assert result.prints.count() == len(stored) + 1  # the discarded hit leaves a print
    spa = next(r for r in stored if r.id == 5)
    assert spa.interaction_ms == 0


def test_hit_columns(hits, dims):
    table = hits(
        {"uc": "c3ByaW5n", "us": "bmV3cyUyMQ==", "ref": "aHR0cHM6Ly93d3cuR29vZ2xlLmNvbTo0NDMveD95"},
        {"hit_id": 2, "uc": "Z2hvc3Q=", "us": "eA==", "sw": "20000", "ck": "1", "cookie_ev": "00000000000000aa"},
    )
    one, two = enrich.enrich_hits(table, dims, Settings(), count_bursts=False).views.orderBy("id").collect()
    assert (one.utm_campaign, one.utm_source, one.referrer, one.referrer_type) == (
        "spring", "news!", "https://www.google.com", "search",
    )
    assert (one.device_type, one.os_name, one.browser_name) == ("desktop", "Linux", "Firefox")
    assert (two.utm_campaign, two.utm_source, two.screen_width, two.device_type) == (None,) * 4
    assert (two.visitor_id, two.is_returning, two.bot_score) == ("00000000000000aa", 1, 10)
    assert len(one.visitor_id) == 16 and one.is_returning == 0


def test_bursts_raise_the_score(hits, dims):
    table = hits(*[{"hit_id": i, "ts": NOW + timedelta(seconds=i)} for i in range(17)])
    scores = {r.id: r.bot_score for r in enrich.enrich_hits(table, dims, Settings()).views.collect()}
    assert [i for i, s in scores.items() if s == 25] and {i for i, s in scores.items() if s == 25} == {15, 16}


def test_event_posts(table, dims):
    body = (
        '{"siteId":"site","events":[%s,{"type":"nope"},{"type":"custom","data":{"big":"%s"}},'
        '{"type":"custom","data":{"b":1,"a":"é"},"sessionId":7,"utmCampaign":"ghost"}]}'
    ) % ('{"type":"click","sessionId":"aaaaaaaa-0000-0000-0000-000000000001","utmCampaign":"spring"}', "x" * 2100)
    base = dict(ts=NOW, remote_addr="1.2.3.4", user_agent="Mozilla/5.0 (iPhone)", accept_language="en",
                sec_ch_ua="x", pow_result="valid", referer="https://a.example/x")
    changes = [
        dict(post_id=1, body=body), dict(post_id=2, body="{bad"), dict(post_id=3, body='{"events":[]}'),
        dict(post_id=4, body=body, user_agent="Wget/1"), dict(post_id=5, body=body, pow_result="invalid"),
        dict(post_id=6, body='{"events":[' + ",".join(['{"type":"hover"}'] * 25) + "]}"),
        dict(post_id=7, body='{"events":[{"type":"hover"}],"pad":"' + "x" * 17000 + '"}'),
    ]
    result = posts.enrich_posts(table(schemas.POSTS, *[base | c for c in changes]), dims, Settings())
    assert {r.post_id: r.reject_reason for r in result.rejects.collect()} == {
        2: "invalid_json", 3: "no_events", 4: "known_bot", 5: "discarded", 7: "too_large",
    }
    got = result.events.collect()
    assert sum(r.id // 2048 == 6 for r in got) == 20
    refused = {(r.post_id, r.position): r.reject_reason for r in result.event_rejects.collect()}
    assert refused == {(1, 1): "unknown_type", (1, 2): "data_too_long"} | {(6, i): "too_many_events" for i in range(20, 25)}
    click, custom = sorted((r for r in got if r.id // 2048 == 1), key=lambda r: r.event_type)
    assert (click.data, click.utm_campaign, click.device_type, click.referrer) == (
        "{}", "spring", "mobile", "https://a.example",
    )
    assert (custom.data, custom.session_id, custom.utm_campaign) == ('{"b":1,"a":"é"}', None, None)
    assert (click.hour, click.month, click.day_of_week) == (12, 3, 0)


def test_one_bad_entry_costs_one_event(table, dims):
    body = '{"siteId":"site","events":[5,null,"x",[1],{"type":"click","data":{"tag":"A"}},{}]}'
    post = dict(post_id=1, ts=NOW, remote_addr="1.2.3.4", user_agent="x", accept_language="en", sec_ch_ua="x", pow_result="valid", body=body)
    result = posts.enrich_posts(table(schemas.POSTS, post), dims, Settings())
    assert [r.data for r in result.events.collect()] == ['{"tag":"A"}'] and result.rejects.count() == 0
    assert {r.position: r.reject_reason for r in result.event_rejects.collect()} == {
        **{i: "not_an_object" for i in range(4)}, 5: "unknown_type",
    }


# --- API batches and metrics ---------------------------------------------------------------------

UID = "00000000-0000-4000-8000-00000000000%d"


def batch(event=None, context=None, drop=None, **top):
    import json

    one = {"event_id": UID % 1, "type": "buy", "ts": "2024-01-01T00:00:00Z"} | (event or {})
    body = {"v": 1, "batch_id": UID % 2, "context": {"session_id": UID % 3, "language": "en"} | (context or {}), "events": [one]}
    return json.dumps({k: v for k, v in (body | top).items() if k != drop})


BATCHES = [
    ("5", "Body must be a JSON object"), ("[]", "Unsupported protocol version"), ("{", "Invalid JSON"), (batch(v=2), "Unsupported protocol version"),
    (batch(batch_id="x"), "Invalid batch_id"), (batch(drop="context"), "Missing context"),
    (batch(context={"session_id": 5}), "Invalid session_id"), (batch(context={"site_id": "a b"}), "Invalid site_id"),
    (batch(events=[]), "Events array is empty or missing"), (batch(events=[{}] * 101), "Too many events (max 100)"),
    (batch(events=[3]), "Invalid event object"), (batch(events=[[]]), "Invalid event_id: undefined"), (batch({"event_id": "x"}), "Invalid event_id: x"),
    (batch({"type": ""}), "Event missing type"), (batch({"type": "9x"}), "Invalid event type: 9x"),
    (batch({"ts": 5}), "Event missing ts"), (batch(), None), (batch(v="1"), "Unsupported protocol version"),
    (batch(v=True), "Unsupported protocol version"), (batch(v=1.0), None), (batch().replace('"v": 1', '"v": 2, "v": 1'), None),
]


def test_batch_rules(table):
    raw = table(schemas.RAW_BODIES, *[dict(raw_id=i, received_at=NOW, body=b) for i, (b, _) in enumerate(BATCHES)])
    got = {r.raw_id: r.message for r in ingest.ingest_batches(raw).rejects.collect()}
    assert [got.get(i) for i in range(len(BATCHES))] == [m for _, m in BATCHES]


def test_batch_events_and_duplicates(table):
    event = {"data": {"z": 1}, "experiments": [{"experiment_id": "e", "variant_id": "b"}]}
    raw = table(
        schemas.RAW_BODIES,
        dict(raw_id=1, received_at=NOW, body=batch(event, {"site_id": "shop", "viewport_width": 1, "viewport_height": 2})),
        dict(raw_id=2, received_at=NOW + timedelta(seconds=1), body=batch()),
    )
    result = ingest.ingest_batches(raw)
    row = result.events.collect()
    assert len(row) == 1 and (row[0].site_id, row[0].bot_score, row[0].experiment_id) == ("shop", -1, "e")
    assert row[0].data == (
        '{"z":1,"experiment_id":"e","variant_id":"b","session_context":'
        '{"viewport":"1x2","screen":"undefinedxundefined","language":"en"}}'
    )
    assert {tuple(r) for r in result.counts.collect()} == {(1, 1, 0), (2, 0, 1)}


def test_own_names_in_data_are_replaced(table):
    event = {"data": {"session_context": 1, "experiment_id": "own", "z": "é", "a": [1]}, "experiments": [{"experiment_id": "e"}]}
    plain = {"event_id": UID % 5, "data": {"experiment_id": "own"}}
    doubled = batch({"event_id": UID % 6, "data": {"k": 1}}).replace('"k": 1', '"k": 1, "k": 2')
    raw = table(schemas.RAW_BODIES, *[dict(raw_id=i, received_at=NOW, body=b) for i, b in enumerate([batch(event), batch(plain), doubled])])
    session = '"session_context":{"viewport":"undefinedxundefined","screen":"undefinedxundefined","language":"en"}}'
    assert {r.raw_id if "raw_id" in r else r.id // 2048: r.data for r in ingest.ingest_batches(raw).events.collect()} == {
        0: '{"a":[1],"z":"é","experiment_id":"e","variant_id":null,' + session,
        1: '{"experiment_id": "own",'.replace(": ", ":") + session,
        2: '{"k":2,' + session,
    }


def test_metric_posts(table):
    good = '[{"category":"%s","metric":"m","value":1.5,"unit":"ms","metadata":{"a":1}}]' % ("c" * 200)
    bodies = [good, "{}", "[]", '[{"category":"c","metric":"m","value":"1","unit":"ms"}]', "nope"]
    raw = table(schemas.RAW_BODIES, *[dict(raw_id=i, received_at=NOW, body=b) for i, b in enumerate(bodies)])
    result = ingest.ingest_metrics(raw)
    (row,) = result.events.collect()
    assert (len(row.category), row.value, row.metadata) == (200, 1.5, '{"a":1}')
    assert {r.raw_id for r in result.rejects.collect()} == {1, 3, 4}


def test_session_rules(spark):
    rows = [
        (1, "s", NOW, "/a", "c1", "x"), (2, "s", NOW + timedelta(hours=1), "/a", None, None),
        (3, "s", NOW + timedelta(days=2), "/b", None, None), (4, "s", NOW + timedelta(days=3), "/c", "c2", None),
        (5, "s", NOW + timedelta(days=9), "/d", None, None), (6, "t", NOW, "/a", None, None),
    ]
    table = spark.createDataFrame(rows, "id long, session_id string, ts timestamp_ntz, path string, utm_campaign string, utm_source string")
    got = {r.id: (r.utm_campaign, r.utm_source) for r in sessions.session_navigations(table).collect()}
    assert got == {1: ("c1", "x"), 3: ("c1", "x"), 4: ("c2", None), 5: ("c2", None), 6: (None, None)}
    strangers = [(1, None, NOW, "/a", "c1", "x"), (2, None, NOW, "/a", None, None), (3, None, NOW + timedelta(days=1), "/a", None, None)]
    got = {r.id: r.utm_campaign for r in sessions.session_navigations(spark.createDataFrame(strangers, table.schema)).collect()}
    assert got == {1: "c1", 2: None, 3: None}


def test_vitals(events):
    data = ['{"metric":"CLS","value":100}', '{"metric":"CLS","value":101}', '{"metric":"LCP","value":5000}', '{"metric":"X","value":1}']
    table = events(*[{"event_type": "web_vital", "data": d} for d in data])
    got = {(r.metric, r.rating) for r in sessions.vital_ratings(table).collect()}
    assert got == {("CLS", "good"), ("CLS", "needs-improvement"), ("LCP", "poor"), ("X", "unknown")}
