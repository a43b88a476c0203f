"""Markers of addresses: written by the pageview stream, read as dimensions, deleted when over."""

from __future__ import annotations

from datetime import timedelta

from footfall.functions.identity import ip_hash
from footfall.plans.enrich import Dimensions
from footfall.session import shared_dir
from footfall.settings import Settings
from footfall.streaming import ingest
from footfall.streaming.correlate import expire_markers, read_markers
from tests.conftest import NOW
from tests.test_operators import files_of, finish

BOT = "Mozilla/5.0 (compatible; Googlebot/2.1)"


def test_suspected_addresses_are_marked_and_expire(spark, hits, table, excluded):
    from pyspark.sql import functions as F

    from footfall import schemas

    dims = Dimensions(table(schemas.CAMPAIGNS), excluded())
    rows = hits(
        {"user_agent": BOT}, {"hit_id": 2, "ts": NOW + timedelta(seconds=1)},
        {"hit_id": 3, "user_agent": BOT, "remote_addr": "198.51.100.2", "ts": NOW + timedelta(hours=2)},
        {"hit_id": 4, "user_agent": BOT, "remote_addr": "198.51.100.2", "ts": NOW + timedelta(hours=2)},
    )
    path = shared_dir(spark, "pageviews")
    finish(ingest.start_pageviews(files_of(spark, rows, "ts", 2), lambda: dims, Settings(), path, every=None))
    hashed = lambda ip: spark.range(1).select(ip_hash(Settings().secret, F.lit(ip))).first()[0]
    first, second = ((hashed(f"198.51.100.{k}"), "suspected", NOW + timedelta(hours=2 * k - 2)) for k in (1, 2))
    assert sorted(map(tuple, read_markers(spark, path).collect())) == sorted([first, second])
    assert [tuple(r) for r in read_markers(spark, path, since=NOW + timedelta(hours=1)).collect()] == [second]
    assert expire_markers(spark, path, NOW) == 0
    assert expire_markers(spark, path, NOW + timedelta(hours=1)) == 1
    assert [tuple(r) for r in read_markers(spark, path, shared_dir(spark, "none")).collect()] == [second]
    assert expire_markers(spark, shared_dir(spark, "none"), NOW) == 0
