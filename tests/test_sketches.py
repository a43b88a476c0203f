from __future__ import annotations

from datetime import timedelta

import pytest
from pyspark.sql import functions as F

from footfall.plans import sketched
from footfall.session import shared_dir
from footfall.streaming import trends
from tests.conftest import NOW
from tests.test_operators import files_of, finish


def test_windows_of_streamed_panes_equal_batch(spark, views):
    table = views(*[{"created_at": NOW + timedelta(seconds=37 * i), "visitor_id": f"v{i % 7}", "bot_score": i % 60} for i in range(120)])
    stream = files_of(spark, table, "created_at", 3)
    exact, approx = shared_dir(spark, "panes"), shared_dir(spark, "sketches")
    finish(trends.start_parts(stream, trends.pane_visitors, exact))
    finish(trends.start_parts(stream, trends.pane_sketches, approx))
    want = {tuple(r) for r in trends.active_visitors(trends.window_visitors(table)).collect()}
    slid = trends.slide_visitors(trends.read_panes(spark, exact))
    assert {tuple(r) for r in trends.active_visitors(slid).collect()} == want
    got = trends.approx_active(trends.read_panes(spark, approx)).select("site_id", "start", "active_visitors", "pageviews")
    assert {tuple(r) for r in got.collect()} == want  # few visitors are counted exactly


def test_panes_of_many_visitors_stay_one_row(spark, views):
    table = views({}).select("*").crossJoin(spark.range(50_000).select(F.col("id").alias("n"))).withColumn("visitor_id", F.col("n").cast("string"))
    panes = trends.pane_sketches(table)
    assert panes.count() == 1
    got = trends.approx_active(panes).collect()
    assert len(got) == 5 and all(r.pageviews == 50_000 and abs(r.active_visitors - 50_000) < 50_000 * 0.03 for r in got)


def test_panes_must_make_up_the_windows(spark, views):
    panes = trends.pane_sketches(views({}), "2 minutes")
    with pytest.raises(ValueError):
        trends.approx_active(panes, "2 minutes", "5 minutes", "1 minute")


def test_excluded_visitors_are_taken_from_stored_days(spark, views, excluded):
    table = views(
        *[{"visitor_id": f"v{i}", "created_at": NOW + timedelta(days=i % 3), "is_returning": i % 2} for i in range(30)],
        *[{"visitor_id": f"v{i}", "created_at": NOW + timedelta(days=4), "is_returning": 1} for i in range(10)],
        {"visitor_id": "bot", "bot_score": 80}, {"visitor_id": None},
    )
    stored = sketched.rollup_visitors(table)
    for gone in ([], ["v0", "v1", "v25", "nobody"], [f"v{i}" for i in range(30)]):
        out = excluded(*gone) if gone else excluded("x").limit(0)
        left = [i for i in range(30) if f"v{i}" not in gone]
        row = sketched.remaining_visitors(stored, out, "site_id").first()
        assert (row.unique_visitors, row.all_visitors, row.error) == (len(left), 30, 0)
        kinds = sketched.visitor_kinds(stored, out).first()
        again = {i for i in left if i < 10 and i % 2 == 0}
        assert (kinds.only_new, kinds.came_back) == (len([i for i in left if i % 2 == 0]) - len(again), len(again))
        assert kinds.only_returning == len([i for i in left if i % 2])


def test_a_difference_keeps_its_error(spark, views, excluded):
    many = views({}).crossJoin(spark.range(200_000).select(F.col("id").alias("n"))).withColumn("visitor_id", F.col("n").cast("string"))
    out = spark.range(150_000).select(F.col("id").cast("string").alias("visitor_id"))
    row = sketched.remaining_visitors(sketched.rollup_visitors(many), out, "site_id").first()
    assert 0 < row.error < 2_000 and abs(row.unique_visitors - 50_000) <= 5 * row.error


def test_no_views_and_no_requests(spark, views, excluded, table):
    empty = sketched.rollup_visitors(views({}).limit(0))
    assert sketched.remaining_visitors(empty, excluded("a"), "site_id").collect() == []
    requests = spark.createDataFrame([], "path string, ts timestamp_ntz, duration_ms double, status int")
    row = sketched.latency(sketched.latency_parts(requests)).first()
    assert set(row.asDict().values()) == {0, 0.0}


def test_latency_of_merged_parts(spark):
    data = [(f"/p{i % 3}", NOW - timedelta(seconds=i), float(i * 7919 % 10_007) if i % 50 else None, 500 if i % 40 == 0 else 200) for i in range(6_000)]
    requests = spark.createDataFrame(data, "path string, ts timestamp_ntz, duration_ms double, status int")
    parts = sketched.latency_parts(requests).repartition(5)
    for minutes in (None, 30):
        inside = [r for r in data if minutes is None or r[1] >= NOW - timedelta(minutes=minutes)]
        values = sorted(r[2] for r in inside if r[2] is not None)
        row = sketched.latency(parts, as_of=NOW, minutes=minutes).first()
        assert (row.requests, row.timed, row.max_ms) == (len(inside), len(values), values[-1])
        assert row.errors == sum(r[3] >= 500 for r in inside) and row.avg_ms == pytest.approx(sum(values) / len(values), abs=0.01)
        for name, share in (("p50_ms", 0.5), ("p95_ms", 0.95), ("p99_ms", 0.99)):
            rank = sum(v <= row[name] for v in values) / len(values)
            assert abs(rank - share) < 0.01
    by_path = {r.path: r.requests for r in sketched.latency(parts, "path").collect()}
    assert by_path == {f"/p{i}": 2_000 for i in range(3)}


def test_paths_without_durations_read_zero(spark):
    requests = spark.createDataFrame([("/a", NOW, None, 200), (None, NOW, 5.0, 500)], "path string, ts timestamp_ntz, duration_ms double, status int")
    got = {r.path: (r.requests, r.errors, r.p50_ms) for r in sketched.latency(sketched.latency_parts(requests), "path").collect()}
    assert got == {"/a": (1, 0, 0.0), None: (1, 1, 5.0)}
