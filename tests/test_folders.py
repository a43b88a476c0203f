from __future__ import annotations

import glob
from datetime import timedelta

import pytest
from pyspark.sql import functions as F

from footfall.functions.predicates import at
from footfall.plans import compact as compact_module
from footfall.plans import correlate
from footfall.plans.compact import compact
from footfall.session import shared_dir
from footfall.sources.folders import (
    Folder,
    all_folders,
    folders_with,
    live_folders,
    out_of_use,
    read_facts,
    read_folders,
    write_filters,
    write_manifest,
)
from footfall.sources.tables import with_day
from footfall.streaming.sinks import write_facts
from tests.conftest import NOW

DAYS = 90


def stored(rows, path):
    """A batch for each day, filters of all of them."""
    dated = with_day(rows).withColumn("batch_id", F.datediff(F.lit(NOW.date()), "event_date"))
    write_filters(dated, path, 0)
    dated.coalesce(1).write.partitionBy("site_id", "event_date", "batch_id").parquet(path)
    return rows


def spoil(path, kept):
    """Make every file unreadable but those of the days kept."""
    files = [f for f in glob.glob(f"{path}/site_id=*/event_date=*/batch_id=*/*.parquet") if not any(f"event_date={d}" in f for d in kept)]
    for name in files:
        with open(name, "wb") as file:
            file.write(b"not to be opened")
    return len(files)


def test_a_sweep_opens_only_folders_that_may_hold_its_visitors(spark, views, events):
    from footfall import schemas

    day = lambda d: NOW - timedelta(days=d)
    others = [{"visitor_id": f"o{d}-{i}", "created_at": day(d)} for d in range(DAYS) for i in range(5)]
    bots = [{"visitor_id": f"v{i}", "created_at": day(d)} for i in range(6) for d in (0, 17, 63)]
    quiet = [{"visitor_id": q, "created_at": NOW - timedelta(minutes=10)} for q in ("quiet", "busy")]
    base = shared_dir(spark, "sweep")
    stored(views(*others, *bots, *quiet), f"{base}/views")
    stored(events(*others, {"visitor_id": "busy", "created_at": day(40)}, {"visitor_id": "v3", "created_at": day(5)}), f"{base}/events")
    kept = {name: {str(day(d).date()) for d in days} for name, days in {"views": (0, 17, 63), "events": (40, 5)}.items()}
    assert [spoil(f"{base}/{name}", kept[name]) for name in kept] == [DAYS - 3, DAYS - 2]
    row = ("Linux", "Chrome", "139", 1920, 1080, "US", "en")
    prints = spark.createDataFrame([(f"ip{i}", f"v{i}", "site", row, False, NOW) for i in range(6)], schemas.PRINTS)
    markers = correlate.sweep_stored(spark, f"{base}/views", f"{base}/events", prints, stage_dir=f"{base}/stage", as_of=NOW)
    assert {r.ip_hash for r in markers.collect()} == {f"ip{i}" for i in range(6)}

    def scores(name):
        folders = [f for f in all_folders(spark, f"{base}/{name}") if str(f.event_date) in kept[name]]
        return {(r.visitor_id, r.event_date): r.bot_score for r in read_folders(spark, f"{base}/{name}", folders).collect()}

    seen = scores("views")
    assert {v for (v, _), s in seen.items() if s == 30} == {f"v{i}" for i in range(6)} and sum(s == 30 for s in seen.values()) == 18
    assert {v for (v, _), s in seen.items() if s == 15} == {"quiet"}
    assert {v for (v, _), s in scores("events").items() if s == 30} == {"v3"}


def test_folders_without_a_filter_are_opened(spark, views):
    path = shared_dir(spark, "facts")
    rows = with_day(views({"visitor_id": "a"}, {"visitor_id": "b", "created_at": NOW - timedelta(days=1)})).withColumn("batch_id", F.lit(1))
    write_filters(rows.where(F.col("created_at") == at(NOW)), path, 1)
    rows.write.partitionBy("site_id", "event_date", "batch_id").parquet(path)
    who = lambda v: spark.createDataFrame([("site", v), ("nowhere", v)], "site_id string, visitor_id string")
    assert len(folders_with(spark, path, who("a"))) == 2
    assert [f.event_date for f in folders_with(spark, path, who("x"))] == [(NOW - timedelta(days=1)).date()]


def test_readers_follow_the_manifest(spark, views):
    path = shared_dir(spark, "facts")
    rows = with_day(views(*[{"visitor_id": f"v{i}", "site_id": s} for i in range(4) for s in ("a b", "007")]))
    rows = rows.withColumn("batch_id", F.expr("(id - 1) div 2 % 2"))
    rows.write.partitionBy("site_id", "event_date", "batch_id").parquet(path)
    assert read_facts(spark, path).count() == 8 and len(all_folders(spark, path)) == 4
    assert out_of_use(spark, path) == (0, {})
    dead = {("007", NOW.date(), 1): "replaced", (None, None, None): "pending"}
    write_manifest(spark, path, 1, dead)
    assert out_of_use(spark, path) == (1, dead)
    with pytest.raises(RuntimeError):
        write_manifest(spark, path, 1, {})
    live = live_folders(spark, path)
    assert len(live) == 3 and all(isinstance(f, Folder) and f.key not in dead for f in live)
    left = read_facts(spark, path)
    assert left.schema["site_id"].dataType.simpleString() == "string"
    assert left.where("site_id = '007'").count() == 2
    assert read_facts(spark, path, sites=["a b"], days=[NOW.date()]).count() == 4
    assert read_facts(spark, path, sites=["none"]).count() == 0


def files_in(path):
    return len(glob.glob(f"{path}/site_id=*/event_date=*/batch_id=*/*.parquet"))


def test_compaction_swaps_rows_in_one_step(spark, views, monkeypatch):
    path = f"{shared_dir(spark, 'facts')}/views"
    batches = [views(*[{"id": 100 * b + i, "visitor_id": f"v{i}", "site_id": s, "created_at": NOW - timedelta(days=i % 2)} for i in range(8) for s in ("a", "b")]) for b in range(6)]
    for number, batch in enumerate(batches[:5]):
        write_facts(batch, path, number)
    rows = lambda: sorted((r.id, r.site_id, r.visitor_id) for r in read_facts(spark, path).collect())
    want = rows()
    assert len(want) == 80 and len(all_folders(spark, path)) == 20

    # a run that ends before the swap changes nothing for readers
    with monkeypatch.context() as broken:
        real, calls = compact_module.write_manifest, []

        def fail(*args):
            calls.append(args)
            if len(calls) == 2:
                raise OSError("no swap")
            return real(*args)

        broken.setattr(compact_module, "write_manifest", fail)
        with pytest.raises(OSError):
            compact(spark, path)
    assert rows() == want and len(calls) == 2

    before = read_facts(spark, path)  # a reader that has begun
    first = compact(spark, path)
    assert (first.folders, first.files, first.deleted) == (12, 4, 4)
    assert rows() == want and before.count() == 80
    write_facts(batches[4], path, 4)  # the newest batch is repeated
    write_facts(batches[0], path, 0)  # and, by mistake, one that was compacted
    assert rows() == want
    write_facts(batches[5], path, 5)
    want = rows()
    second = compact(spark, path)
    assert second.deleted == 12 and second.folders == 8 and rows() == want and len(want) == 96
    third = compact(spark, path)
    assert third.folders == 0 and third.deleted == 8 and rows() == want
    assert files_in(path) <= 4 + sum(1 for f in all_folders(spark, path) if f.batch_id >= 4) * 4
    assert {f.batch_id for f in all_folders(spark, path)} >= {4, 5}
    who = spark.createDataFrame([("a", "v3"), ("b", "none")], "site_id string, visitor_id string")
    assert {(f.site_id, f.event_date) for f in folders_with(spark, path, who)} == {("a", (NOW - timedelta(days=1)).date())}
    parts = {p.rsplit("=")[-1] for p in glob.glob(f"{path}_visitors/part=*")}
    assert parts == {str(f.batch_id) for f in all_folders(spark, path)}


def test_folders_that_change_are_left_as_they_were(spark, views, monkeypatch):
    path = f"{shared_dir(spark, 'facts')}/views"
    for number in range(4):
        write_facts(views({"id": number}, {"id": number, "site_id": "b"}), path, number)
    real, swept = compact_module.exists, []

    def sweep(spark, folder):
        if "site_id=site" in folder and not swept:  # after the copy: site, but not b
            swept.append(folder)
            write_facts(views({"id": 77}, {"id": 77}), path, 1)
        return real(spark, folder)

    monkeypatch.setattr(compact_module, "exists", sweep)
    assert compact(spark, path, kept_batches=1).folders == 3
    got = sorted(r.id for r in read_facts(spark, path).where("site_id = 'site'").collect())
    assert got == [0, 2, 3, 77, 77]


def test_large_files_are_left_alone_and_parts_have_their_size(spark, views):
    path = f"{shared_dir(spark, 'facts')}/views"
    for number in range(3):
        write_facts(views(*[{"id": 1000 * number + i, "path": f"/{number}/{i}"} for i in range(400)]), path, number)
    size = sum(len(open(f, "rb").read()) for f in glob.glob(f"{path}/site_id=*/*/batch_id=*/*.parquet"))
    done = compact(spark, path, target_bytes=size // 3, kept_batches=0)
    assert 3 <= done.files <= 4 and read_facts(spark, path).count() == 1200
    assert compact(spark, path, target_bytes=2000, kept_batches=0).folders == 0


def test_a_batch_that_fails_is_tried_again(spark):
    from footfall.streaming.sinks import retried

    tries = []

    def write(batch, batch_id):
        tries.append(batch_id)
        if len(tries) < 3:
            raise OSError("busy")

    retried(write, 3, 0.0)(None, 7)
    assert tries == [7, 7, 7]
    with pytest.raises(OSError):
        retried(lambda b, n: (_ for _ in ()).throw(OSError("down")), 2, 0.0)(None, 1)
