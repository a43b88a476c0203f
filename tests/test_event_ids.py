"""Each event has a number of its own, and an event id counts once, however late it comes again."""

from __future__ import annotations

from datetime import timedelta

import pytest
from pyspark.sql import functions as F

from footfall import schemas
from footfall.functions.identity import POSITIONS, event_number
from footfall.operators.paging import onward
from footfall.plans import ingest as batch_ingest
from footfall.session import shared_dir
from footfall.streaming import ingest, sinks
from tests.conftest import NOW
from tests.test_jobs import batch
from tests.test_operators import finish

ID = "00000000-0000-4000-8000-{:012d}"


def bodies(table, *rows):
    return table(schemas.RAW_BODIES, *[dict(raw_id=i, received_at=t, body=b) for i, t, b in rows])


def started(spark, source, path):
    raw = spark.readStream.schema(schemas.RAW_BODIES).option("maxFilesPerTrigger", 1).parquet(source)
    finish(ingest.start_batches(raw, path, every=None))
    events = spark.read.parquet(f"{path}/events").collect()
    counts = {r.raw_id: (r.accepted, r.duplicate) for r in spark.read.parquet(f"{path}/counts").collect()}
    return sorted((r.event_id, r.created_at) for r in events), counts


def test_an_id_is_refused_after_a_month_and_a_restart(spark, table):
    source, path = shared_dir(spark, "bodies"), shared_dir(spark, "stream")
    add = lambda *rows: bodies(table, *rows).coalesce(1).write.mode("append").parquet(source)
    many = [{"event_id": ID.format(k), "type": "buy", "ts": "2024-01-01T00:00:00Z"} for k in (5, 6, 5)]
    add((1, NOW, batch({"event_id": ID.format(1)})), (2, NOW + timedelta(seconds=1), batch({"event_id": ID.format(1)})), (3, NOW, batch(events=many)))
    events, counts = started(spark, source, path)
    first = [(ID.format(1), NOW), (ID.format(5), NOW), (ID.format(6), NOW)]
    assert events == first and counts == {1: (1, 0), 2: (0, 1), 3: (2, 1)}
    later = NOW + timedelta(days=30)
    add((4, later, batch({"event_id": ID.format(1)})), (5, later, batch({"event_id": ID.format(2)})), (6, later, "{"))
    add((7, later + timedelta(days=300), batch({"event_id": ID.format(2)})))
    events, counts = started(spark, source, path)
    assert events == sorted([*first, (ID.format(2), later)])
    assert counts == {1: (1, 0), 2: (0, 1), 3: (2, 1), 4: (0, 1), 5: (1, 0), 7: (0, 1)}


def test_an_id_of_a_rejected_batch_is_still_new(spark, table):
    source, path = shared_dir(spark, "bodies"), shared_dir(spark, "stream")
    bodies(table, (1, NOW, batch({"event_id": ID.format(1)}, v=2))).coalesce(1).write.mode("append").parquet(source)
    bodies(table, (2, NOW, batch({"event_id": ID.format(1)}))).coalesce(1).write.mode("append").parquet(source)
    events, counts = started(spark, source, path)
    assert [e for e, _ in events] == [ID.format(1)] and counts == {2: (1, 0)}


def test_a_batch_that_failed_halfway_is_whole_when_tried_again(spark, table, monkeypatch):
    source, path = shared_dir(spark, "bodies"), shared_dir(spark, "stream")
    for k in range(3):
        bodies(table, (k, NOW, batch({"event_id": ID.format(k // 2)}))).coalesce(1).write.mode("append").parquet(source)
    real, failures = sinks.write_facts, iter([True, False, True, False])

    def failing(*args, **options):
        real(*args, **options)
        if next(failures, False):
            raise OSError("store away")

    monkeypatch.setattr(ingest, "write_facts", failing)
    monkeypatch.setattr(sinks.time, "sleep", lambda seconds: None)
    events, counts = started(spark, source, path)
    assert [e for e, _ in events] == [ID.format(0), ID.format(1)]
    assert sorted(counts.values()) == [(0, 1), (1, 0), (1, 0)]


def test_streamed_ids_equal_one_run_over_all(spark, table):
    import random

    pick, rows = random.Random(3), []
    for k in range(40):
        sent = [{"event_id": ID.format(pick.randrange(60)), "type": "buy", "ts": "2024-01-01T00:00:00Z"} for _ in range(pick.randrange(1, 6))]
        rows.append((k, NOW + timedelta(hours=k), batch(events=sent)))
    source, path = shared_dir(spark, "bodies"), shared_dir(spark, "stream")
    for part in range(0, 40, 10):
        bodies(table, *rows[part : part + 10]).coalesce(1).write.mode("append").parquet(source)
    events, counts = started(spark, source, path)
    whole = batch_ingest.ingest_batches(bodies(table, *rows))
    assert events == sorted((r.event_id, r.created_at) for r in whole.events.collect())
    assert counts == {r.raw_id: (r.accepted, r.duplicate) for r in whole.counts.collect()}


def test_paging_over_posts_of_many_events_misses_none(spark, table):
    sent = lambda k: [{"event_id": ID.format(10 * k + i), "type": "buy", "ts": "2024-01-01T00:00:00Z"} for i in range(7)]
    events = batch_ingest.ingest_batches(bodies(table, *[(k, NOW, batch(events=sent(k))) for k in range(3)])).events
    listed, last = [], None
    while page := onward(events, "created_at", "id", last, per_page=4).collect():
        listed += [r.event_id for r in page]
        last = (page[-1].created_at, page[-1].id)
    assert sorted(listed) == sorted(ID.format(10 * k + i) for k in range(3) for i in range(7))


def test_numbers_of_events_differ(spark):
    places = spark.range(3).crossJoin(spark.range(POSITIONS).withColumnRenamed("id", "position"))
    ids = places.select(event_number("id", places.position, api=False).alias("id"))
    both = ids.unionByName(places.select(event_number("id", places.position, api=True).alias("id")))
    assert both.distinct().count() == both.count() == 6 * POSITIONS
    with pytest.raises(Exception, match="more than"):
        spark.range(1).select(event_number("id", F.lit(POSITIONS), api=False)).collect()
