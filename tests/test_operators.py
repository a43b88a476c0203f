from __future__ import annotations

import random
from datetime import timedelta

import pytest
from pyspark.sql import functions as F

from footfall.functions.network import next_number
from footfall.operators.intervals import by_block, merge_intervals, v4_block
from footfall.operators.paging import onward
from footfall.operators.ranks import nearest_ranks
from footfall.operators.windows import anchored_count, last_before, latest_within, seen_within
from footfall.plans.reputation import with_burst_read, with_ip_penalty, with_rate_limit
from footfall.session import shared_dir
from footfall.settings import Settings
from footfall.sources import feeds
from footfall.sources.requests import hits_from_log, posts_from_log
from footfall.streaming import bursts, ingest, trends
from tests.conftest import NOW


def plain_merge(ranges):
    merged = []
    for lo, hi in sorted(ranges):
        if merged and lo <= merged[-1][1] + 1:
            merged[-1][1] = max(merged[-1][1], hi)
        else:
            merged.append([lo, hi])
    return [tuple(m) for m in merged]


CASES = [
    [(0, 10), (5, 20)], [(0, 10), (11, 20)], [(0, 10), (12, 20)], [(0, 100), (20, 30)], [(50, 60), (0, 10)],
    [(0, 2**32 - 1), (5, 6)], [(65530, 65540), (65541, 70000), (131071, 131072)],
    [(0, 200000), (65536, 65537), (300000, 300001)],
]


def random_ranges(seed):
    pick = random.Random(seed)
    ranges = []
    for _ in range(400):
        lo = pick.randrange(0, 2**20)
        ranges.append((lo, lo + pick.choice([0, 1, 50, 3000, 200000 if pick.random() < 0.01 else 7])))
    return ranges


def test_interval_merge_matches_a_plain_one(spark):
    for ranges in CASES + [random_ranges(1), random_ranges(2)]:
        table = spark.createDataFrame(ranges, "lo long, hi long")
        got = merge_intervals(table, block=v4_block, successor=next_number)
        assert sorted(tuple(r) for r in got.collect()) == plain_merge(ranges)
    blocks = by_block(spark.createDataFrame([(65535, 131072)], "lo long, hi long"))
    assert sorted(r.block for r in blocks.collect()) == [0, 1, 2]


def plain_windows(times, length):
    """Window number of each hit in time order: (start, count)."""
    found, start, count = [], None, 0
    for t in times:
        if start is None or t - start > length:
            start, count = t, 0
        count += 1
        found.append((start, count))
    return found


def random_hits(seed, keys=4, size=600, span=20_000):
    pick = random.Random(seed)
    # one key has most of the hits
    rows = [(f"k{0 if pick.random() < 0.7 else pick.randrange(keys)}", pick.randrange(span)) for _ in range(size)]
    return [(i, k, NOW + timedelta(seconds=s)) for i, (k, s) in enumerate(rows)]


@pytest.mark.parametrize("chunk_seconds", [None, 300, 1500, 86_400])
def test_anchored_windows_match_a_plain_scan(spark, chunk_seconds):
    rows = random_hits(7)
    table = spark.createDataFrame(rows, "id int, k string, ts timestamp_ntz")
    got = anchored_count(
        table, keys=["k"], ts="ts", tiebreak="id", seconds=300, name="n", chunk_seconds=chunk_seconds
    )
    want = {}
    for key in {k for _, k, _ in rows}:
        mine = sorted((t, i) for i, k, t in rows if k == key)
        windows = plain_windows([t for t, _ in mine], timedelta(seconds=300))
        want |= {i: w for (_, i), w in zip(mine, windows)}
    assert {r.id: (r.window_start, r.n) for r in got.collect()} == want


def test_markers_and_lookback_match_plain_ones(spark):
    probes = random_hits(3, size=300)
    marks = random_hits(4, size=60)
    p = spark.createDataFrame(probes, "id int, k string, ts timestamp_ntz")
    m = spark.createDataFrame(marks, "id int, k string, at timestamp_ntz")
    life = timedelta(seconds=200)
    seen = seen_within(p, m, keys=["k"], probe_ts="ts", marker_ts="at", seconds=200, name="seen")
    want = {i: any(k == mk and t - life <= mt <= t for _, mk, mt in marks) for i, k, t in probes}
    assert {r.id: r.seen for r in seen.collect()} == want

    late = latest_within(p, m.withColumnRenamed("id", "v"), "v", keys=["k"], probe_ts="ts", fact_ts="at", seconds=200, name="v")
    def newest(k, t):
        near = [(mt, mi) for mi, mk, mt in marks if mk == k and t - life <= mt <= t]
        return max(near)[1] if near else None
    assert {r.id: r.v for r in late.collect()} == {i: newest(k, t) for i, k, t in probes}

    values = {i: (i if i % 5 == 0 else None) for i, _, _ in probes}
    carried = last_before(
        p, F.when(F.col("id") % 5 == 0, F.col("id")), "last", keys=["k"], order=("ts", "id"), include_current=False, seconds=1000
    )
    def previous(k, t, i):
        earlier = [(pt, pi) for pi, pk, pt in probes if pk == k and (pt, pi) < (t, i) and values[pi] is not None]
        return max(earlier)[1] if earlier else None
    assert {r.id: r.last for r in carried.collect()} == {i: previous(k, t, i) for i, k, t in probes}


def test_penalty_limit_and_burst_reading(spark):
    at = lambda s: NOW + timedelta(seconds=s)
    hits = spark.createDataFrame(
        [(1, "a", at(0)), (2, "a", at(1800)), (3, "a", at(1801)), (4, "b", at(10)), (5, "c", at(3600))],
        "hit_id int, ip string, ts timestamp_ntz",
    )
    markers = spark.createDataFrame(
        [("a", "suspected", at(0)), ("b", "confirmed", at(11)), ("c", "confirmed", at(0)), ("c", "suspected", at(3600))],
        "ip string, kind string, ts timestamp_ntz",
    )
    got = {r.hit_id: r.ip_penalty for r in with_ip_penalty(hits, markers, Settings()).collect()}
    assert got == {1: 20, 2: 20, 3: 0, 4: 0, 5: 50}

    many = spark.createDataFrame([(i, "a", at(i // 10)) for i in range(105)], "hit_id int, ip string, ts timestamp_ntz")
    limited = with_rate_limit(many, Settings()).filter("is_limited").collect()
    assert sorted(r.hit_id for r in limited) == [100, 101, 102, 103, 104]
    assert with_rate_limit(many, Settings(rate_limit_max=0)).filter("is_limited").count() == 0

    counted = anchored_count(many, keys=["ip"], ts="ts", tiebreak="hit_id", seconds=300, name="burst_count")
    posts = spark.createDataFrame(
        [(1, "a", at(2)), (2, "a", at(300)), (3, "a", at(301)), (4, "z", at(2))], "post_id int, ip string, ts timestamp_ntz"
    )
    read = {r.post_id: r.burst_count for r in with_burst_read(posts, counted, Settings()).collect()}
    assert read == {1: 30, 2: 105, 3: 0, 4: 0}


# --- streams over several files -------------------------------------------------------------


def files_of(spark, table, ts, count):
    """The table cut into files by time, read back as a stream of one file per batch."""
    path = shared_dir(spark, "input")
    ordered = table.orderBy(ts).collect()
    size = -(-len(ordered) // count)
    for i in range(count):
        part = spark.createDataFrame(ordered[i * size : (i + 1) * size], table.schema)
        part.coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(table.schema).option("maxFilesPerTrigger", 1).parquet(path)


def finish(query):
    query.awaitTermination()
    assert query.exception() is None


def test_streamed_bursts_equal_batch(spark):
    table = spark.createDataFrame(random_hits(11, size=300, span=3000), "id int, k string, ts timestamp_ntz")
    options = dict(keys=["k"], ts="ts", tiebreak="id", seconds=300)
    path = shared_dir(spark, "bursts")
    finish(bursts.start_bursts(files_of(spark, table, "ts", 4), path, name="n", **options))
    got = spark.read.parquet(f"{path}/counted")
    assert got.select("batch_id").distinct().count() == 4
    want = {r.id: (r.window_start, r.n) for r in anchored_count(table, name="n", **options).collect()}
    assert {r.id: (r.window_start, r.n) for r in got.collect()} == want


def test_hits_out_of_order_find_their_window(spark):
    at = lambda s: NOW + timedelta(seconds=s)
    batches = [[(1, "a", at(0)), (2, "a", at(10)), (3, "b", at(900))], [(4, "a", at(20))], [(5, "c", at(2000))], [(6, "a", at(30))]]
    schema, path = "id int, k string, ts timestamp_ntz", shared_dir(spark, "late")
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{path}/in")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/in")
    finish(bursts.start_bursts(stream, path, keys=["k"], ts="ts", tiebreak="id", seconds=300, name="n", late=600))
    # the last hit of a comes more than the window and ten minutes late
    assert {r.id: r.n for r in spark.read.parquet(f"{path}/counted").collect()} == {1: 1, 2: 2, 3: 1, 4: 3, 5: 1, 6: 1}


def test_streamed_sweeps_mark_clusters(spark, views, events):
    from footfall import schemas
    from footfall.sources.tables import append_facts
    from footfall.streaming.correlate import read_markers, start_sweeps

    path = shared_dir(spark, "sweeps")
    who = [{"visitor_id": f"v{i}", "created_at": NOW - timedelta(minutes=1)} for i in range(7)]
    append_facts(views(*who), f"{path}/views")
    append_facts(events(*who), f"{path}/events")
    row = ("Linux", "Chrome", "139", 1920, 1080, "US", "en")
    # three addresses in each batch: a cluster only together, and the last one too late for it
    times = [0, 0, 0, 60, 60, 60, 4000]
    prints = spark.createDataFrame(
        [(f"ip{i}", f"v{i}", "site", row, False, NOW + timedelta(seconds=s)) for i, s in enumerate(times)], schemas.PRINTS
    )
    finish(start_sweeps(files_of(spark, prints, "ts", 3), f"{path}/views", f"{path}/events", path, every=None))
    assert {r.ip_hash for r in read_markers(spark, path).collect()} == {f"ip{i}" for i in range(6)}
    for name in ("views", "events"):
        scores = {r.visitor_id: r.bot_score for r in spark.read.parquet(f"{path}/{name}").collect()}
        assert scores == {f"v{i}": 30 if i < 6 else 0 for i in range(7)}


def test_missing_state_is_an_error(spark):
    from pyspark.errors import AnalysisException

    from footfall.streaming.sinks import read_state

    assert read_state(spark, "/nowhere", 0) is None
    with pytest.raises(AnalysisException):
        read_state(spark, "/nowhere", 3)


def test_streamed_trends_equal_batch(spark, views):
    table = views(*[{"created_at": NOW + timedelta(seconds=37 * i), "visitor_id": f"v{i % 7}", "bot_score": i % 60} for i in range(120)])
    stream = files_of(spark, table, "created_at", 3)
    path, other = shared_dir(spark, "minutes"), shared_dir(spark, "active")
    finish(trends.start_parts(stream, lambda rows: trends.window_counts(rows, "1 minute"), path))
    want = {(r.start, r["count"]) for r in trends.window_counts(table, "1 minute").collect()}
    assert {(r.start, r["count"]) for r in trends.read_counts(spark, path).collect()} == want
    since = NOW + timedelta(minutes=30)
    late = trends.read_counts(spark, path, since=since)
    assert {(r.start, r["count"]) for r in late.collect()} == {w for w in want if w[0] >= since}
    finish(trends.start_parts(stream, trends.window_visitors, other))
    want = {tuple(r) for r in trends.active_visitors(trends.window_visitors(table)).collect()}
    assert {tuple(r) for r in trends.active_visitors(trends.read_visitors(spark, other)).collect()} == want


def test_streamed_ingest_drops_duplicates(spark, table):
    from footfall import schemas
    from tests.test_jobs import batch

    rows = [dict(raw_id=i, received_at=NOW + timedelta(seconds=i), body=batch({"event_id": f"00000000-0000-4000-8000-{i % 4:012d}"})) for i in range(12)]
    raw = table(schemas.RAW_BODIES, *rows)
    path = shared_dir(spark, "batches")
    finish(ingest.start_batches(files_of(spark, raw, "received_at", 3), path, every=None))
    events = spark.read.parquet(f"{path}/events").collect()
    assert sorted(r.id // 2048 for r in events) == [0, 1, 2, 3]
    counts = {r.raw_id: (r.accepted, r.duplicate) for r in spark.read.parquet(f"{path}/counts").collect()}
    assert counts == {i: (1, 0) if i < 4 else (0, 1) for i in range(12)}
    assert spark.read.parquet(f"{path}/rejects").count() == 0


def test_streamed_pageviews_and_events_reread_dimensions(spark, hits, table, excluded):
    from footfall import schemas
    from footfall.plans.enrich import Dimensions

    campaign = dict(id="c", name="C", utm_campaign="spring", site_id="site", status="active", created_at=NOW)
    loads = []

    def load():
        loads.append(1)
        return Dimensions(table(schemas.CAMPAIGNS, campaign), excluded())

    stream = files_of(spark, hits({}, {"hit_id": 2, "ts": NOW + timedelta(seconds=9), "v": "1"}), "ts", 2)
    path = shared_dir(spark, "pageviews")
    finish(ingest.start_pageviews(stream, load, Settings(), path, every=None))
    assert spark.read.parquet(f"{path}/views").count() == 1 and len(loads) == 2
    assert [r.reject_reason for r in spark.read.parquet(f"{path}/rejects").collect()] == ["interaction"]

    post = dict(post_id=1, ts=NOW, remote_addr="1.2.3.4", user_agent="x", accept_language="en", sec_ch_ua="x",
                pow_result="valid", body='{"siteId":"site","events":[{"type":"click"}]}')
    path = shared_dir(spark, "events")
    finish(ingest.start_events(files_of(spark, table(schemas.POSTS, post), "ts", 1), load, Settings(), path, every=None))
    assert spark.read.parquet(f"{path}/events").first().event_type == "click"


def test_exact_ranks(spark):
    pick = random.Random(5)
    for values in ([pick.choice([pick.uniform(-5, 900), 7.25, None]) for _ in range(700)], [1.0], [None], []):
        rows = spark.createDataFrame([(v,) for v in values], "v double")
        known, shares = sorted(v for v in values if v is not None), (0.0, 0.5, 0.95, 0.99, 1.0)
        want = [known[max(-(-int(p * 100) * len(known) // 100), 1) - 1] if known else None for p in shares]
        assert list(nearest_ranks(rows, "v", shares).first()) == want


def test_onward_pages(spark):
    rows = spark.createDataFrame([(i, NOW + timedelta(seconds=i // 4)) for i in range(23)], "id int, ts timestamp_ntz")
    for descending in (True, False):
        seen, last = [], None
        while page := onward(rows, "ts", "id", last, descending=descending, per_page=5).collect():
            seen += [r.id for r in page]
            last = (page[-1].ts, page[-1].id)
        assert seen == sorted(range(23), key=lambda i: (-(i // 4) if descending else i // 4, i))


def test_reports_read_only_their_days(spark, views, events, excluded):
    from footfall.plans import campaigns, correlate, live, overview, rollup
    from footfall.sources.tables import append_facts

    path = shared_dir(spark, "facts")
    append_facts(views({}, {"created_at": NOW - timedelta(days=40)}), f"{path}/v")
    append_facts(events({}, {"created_at": NOW - timedelta(days=40)}), f"{path}/e")
    v, e = spark.read.parquet(f"{path}/v"), spark.read.parquet(f"{path}/e")
    registered = spark.createDataFrame([], "id string, name string, utm_campaign string, site_id string, status string")
    plans = {
        "P04": overview.top_paths(v, site="site", as_of=NOW),
        "P12": live.realtime_active(v, site="site", as_of=NOW),
        "P21": campaigns.campaign_stats(registered, v, as_of=NOW),
        "P31": live.summary_24h(v, as_of=NOW),
        "J01": rollup.daily_rollup(v, excluded(), NOW.date()),
        "J10": correlate.penalise_no_events(v, e, as_of=NOW),
    }
    for name, df in plans.items():
        plan = df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
        assert any("PartitionFilters" in line and "event_date" in line for line in plan.split("\n")), name


# --- sources ------------------------------------------------------------------------------------


def test_request_log(spark):
    headers = {"user-agent": "UA", "cookie": "a=b; _ev=00000000000000aa; c=d", "x-forwarded-for": "1.1.1.1, 2.2.2.2"}
    log = spark.createDataFrame(
        [(1, NOW, "9.9.9.9", "p=Lw%3D%3D&s=site&_v=spa&s=second&flag", headers, "{}", "valid")],
        "id long, ts timestamp_ntz, remote_addr string, query string, headers map<string,string>, body string, pow_result string",
    )
    hit, post = hits_from_log(log).first(), posts_from_log(log).first()
    assert (hit.p, hit.s, hit.v, hit.cookie_ev, hit.user_agent, hit.x_forwarded_for) == (
        "Lw==", "site", "spa", "00000000000000aa", "UA", "1.1.1.1, 2.2.2.2",
    )
    assert hit.sw is None and (post.body, post.cookie_ev, post.post_id) == ("{}", "00000000000000aa", 1)


def test_feed_files(spark, tmp_path):
    files = {
        "crawlers": '[{"pattern":"Bot\\\\/"},{"pattern":"(bad"},{"url":"x"}]',
        "ai": '{"A.I":{"x":1},"B":{}}',
        "aws": '{"prefixes":[{"ip_prefix":"10.0.0.0/9"},{"ip_prefix":"10.128.0.0/9"}],"ipv6_prefixes":[{"ipv6_prefix":"2600::/16"}]}',
        "gcp": '{"prefixes":[{"ipv4Prefix":"11.0.0.0/8"},{"ipv6Prefix":"2601::/16"},{"ipv4Prefix":"junk"}]}',
    }
    for name, text in files.items():
        (tmp_path / name).write_text(text)
    at = lambda name: str(tmp_path / name)
    assert feeds.crawler_patterns(spark, at("crawlers")) == ("Bot\\/", "(bad")
    assert sorted(feeds.ai_names(spark, at("ai"))) == ["A.I", "B"]
    both = feeds.cloud_prefixes(feeds.aws_prefixes(spark, at("aws")), feeds.gcp_prefixes(spark, at("gcp")))
    assert both.count() == 6

    from footfall.plans.threats import latest_version, publish_ranges, refresh_feeds

    path = shared_dir(spark, "versions")
    aws = spark.createDataFrame([(f"10.{i}.0.0/16",) for i in range(20)], "cidr string")
    assert latest_version(spark, path) is None
    refresh_feeds(spark, {"aws": aws, "gcp": both.limit(1)}, path, version="1")
    v4, _ = refresh_feeds(spark, {"aws": aws.limit(1), "gcp": aws.limit(0)}, path, version="2")
    assert latest_version(spark, path).endswith("/2")
    assert spark.read.parquet(f"{path}/2/prefixes").groupBy("provider").count().count() == 2
    assert spark.read.parquet(f"{path}/2/prefixes").count() == 21 and v4.count() >= 1

    v4, v6 = publish_ranges(both, shared_dir(spark, "ranges"))
    assert [tuple(r) for r in v4.collect()] == [(167772160, 201326591)]
    assert [tuple(r) for r in v6.collect()] == [("02600" + "0" * 28, "02601" + "f" * 28)]
