"""Work that must be done once, or by many tasks, however large its input is."""

from __future__ import annotations

import base64
import glob
import re
from dataclasses import replace
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from checks import adapters
from footfall.functions import useragent
from footfall.functions.decode import base64_text, url_origin, with_parsed
from footfall.plans import enrich, posts, threats
from footfall.plans import ingest as batch_ingest
from footfall.session import shared_dir
from footfall.settings import Settings
from footfall.streaming import ingest

START = datetime(2024, 1, 1)


@pytest.fixture(scope="module")
def folder(spark):
    """Events as the driver gives them, one file with one row group."""
    rows = [
        (i, START + timedelta(minutes=17 * i), i % 50, ("view", "error", "click", "signup", "purchase")[i % 5], 1.0, f'{{"k": {i % 100}}}')
        for i in range(400)
    ]
    path = shared_dir(spark, "driver")
    schema = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{path}/events.parquet")
    return path


def test_published_ranges_read_the_prefixes_once(spark):
    seen = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def prefix(i):
        seen.add(1)
        return f"10.{i}.0.0/16" if i % 2 else f"2001:db8:{i}::/48"

    prefixes = spark.range(0, 20, 1, 2).select(prefix("id").alias("cidr"))
    v4, v6 = threats.publish_ranges(prefixes, shared_dir(spark, "ranges"))
    assert (v4.count(), v6.count(), seen.value) == (10, 10, 20)


def test_a_parsed_prefix_is_tested_after_rows_are_grouped(spark):
    """The test of an address is not made on every row that prefixes come from."""
    many = spark.range(100).select((F.col("id") % 3).alias("k")).groupBy(F.concat(F.lit("10.0."), F.col("k"), F.lit(".0/24")).alias("cidr")).count()
    plan = threats._parsed(many, threats.ipv4_number)._jdf.queryExecution().optimizedPlan().toString()
    below = plan[plan.rindex("Aggregate"):]
    assert "Filter" not in below and "transform" not in below


def test_micro_batches_of_one_file_are_decoded_by_all_tasks(spark, folder):
    found = []
    path = shared_dir(spark, "checkpoint")

    def look(batch, batch_id):
        found.append((batch.rdd.getNumPartitions(), batch.count()))

    query = adapters.stream(spark, folder, "hits").writeStream.option("checkpointLocation", path).foreachBatch(look)
    query = query.trigger(availableNow=True).start()
    query.awaitTermination()
    assert query.exception() is None
    assert [tasks for tasks, _ in found] == [spark.sparkContext.defaultParallelism] * adapters.STREAM_FILES
    assert sum(rows for _, rows in found) == 400


def test_batch_stream_stores_few_files(spark, folder):
    path = shared_dir(spark, "batches")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "23")
    try:
        query = ingest.start_batches(adapters.stream(spark, folder, "batches"), path, every=None)
        query.awaitTermination()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert query.exception() is None
    sizes = {}
    for name in glob.glob(f"{path}/events/site_id=*/event_date=*/batch_id=*/*.parquet".replace("file:", "")):
        sizes[name.rsplit("/", 1)[0]] = sizes.get(name.rsplit("/", 1)[0], 0) + 1
    assert sizes and max(sizes.values()) <= spark.sparkContext.defaultParallelism


def test_stages_keep_only_what_outputs_read(spark, folder):
    campaigns = spark.createDataFrame([], "site_id string, utm_campaign string, status string")
    dims = enrich.Dimensions(campaigns=campaigns, excluded=spark.createDataFrame([], "visitor_id string"))
    for name, job, gone in (("hits", enrich.enrich_hits, "p"), ("posts", posts.enrich_posts, "body")):
        stage = shared_dir(spark, name)
        job(adapters.table(spark, folder, name), dims, Settings(secret="k"), stage_dir=stage)
        assert gone not in spark.read.parquet(f"{stage}/scored").columns


def test_conversions_of_malformed_texts(spark):
    texts = ["***", "!!", "QUJD", "QU JD==", "QUI", "Q", "", "ä", "QU-_", None]
    got = spark.createDataFrame([(t,) for t in texts], "x string").select("x", base64_text(F.col("x")).alias("y")).collect()
    whole = spark.createDataFrame([(t,) for t in texts], "x string").select("x", F.expr("decode(try_to_binary(x, 'base64'), 'ISO-8859-1')").alias("y")).collect()
    assert {r.x: r.y for r in got if r.x in ("***", "!!", "QUJD", "ä", None)} == {r.x: r.y for r in whole if r.x in ("***", "!!", "QUJD", "ä", None)}
    urls = {"not a url": None, "a/b": None, "HTTP://A:80/": "http://a", "mailto:x": "null", "https://a b": None, "1x://a": None}
    got = spark.createDataFrame([(u,) for u in urls], "x string").select("x", url_origin(F.col("x")).alias("y")).collect()
    assert {r.x: r.y for r in got} == urls


def test_a_parsed_column_replaces_one_of_its_name(spark):
    row = with_parsed(spark.createDataFrame([("a", 1)], "x string, n int"), x=F.concat("x", F.lit("b"))).first()
    assert row.asDict() == {"x": "ab", "n": 1}


def test_a_raw_log_of_one_row_group_is_read_by_all_tasks_however_often_it_is_cut(spark, folder):
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "400")
    try:
        assert spark.read.parquet(f"{folder}/events.parquet").rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
        sizes = adapters.table(spark, folder, "hits").rdd.glom().map(len).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert sum(sizes) == 400 and sum(s > 0 for s in sizes) >= spark.sparkContext.defaultParallelism


def test_known_agents_are_tried_by_letters_and_found_as_by_their_list(spark):
    words = (*Settings(secret="s").bot_agents, "a.b", "A", "é-ü", "bot")
    pattern = useragent._any_of({w.lower() for w in Settings(secret="s").bot_agents})
    assert pattern.startswith("(?=[") and pattern.count("|") < len(Settings(secret="s").bot_agents)
    texts = [*words, *(w[1:] for w in words), *(f"Mozilla/5.0 {w.upper()}/1" for w in words), "axb", "", None, "Mozilla/5.0 (X11; Linux)"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    for names in (Settings(secret="s").bot_agents, ("a.b", "é-ü"), ("bot", "googlebot"), ("x]y^", "x-z", "x&&"), ("",)):
        found = [r.m for r in rows.select(useragent.matches_any(F.col("t"), names).alias("m")).collect()]
        assert found == [t is not None and any(n.lower() in t.lower() for n in names) for t in texts]


def test_hits_scored_again_are_not_decoded_again(spark, folder):
    hits = adapters.table(spark, folder, "hits")
    dims = enrich.Dimensions(
        adapters.table(spark, folder, "campaigns"), adapters.table(spark, folder, "excluded"),
        hits.select(F.lit("none").alias("ip_hash"), F.lit("confirmed").alias("kind"), "ts"),
    )
    settings = Settings(secret="s", burst_threshold=1, burst_seconds=86_400)
    first = enrich.enrich_hits(hits, dims, settings, stage_dir=shared_dir(spark, "hits"))
    marks = first.prints.select("ip_hash", F.lit("confirmed").alias("kind"), "ts")
    other = replace(dims, markers=marks)
    path = shared_dir(spark, "hits")
    again = enrich.enrich_hits(hits, other, settings, stage_dir=path, before=first)
    anew = enrich.enrich_hits(hits, other, settings, stage_dir=shared_dir(spark, "hits"))
    assert [p.rsplit("/", 1)[1] for p in glob.glob(f"{path}/*")] == ["scored"]
    for name in ("views", "prints", "rejects"):
        rows = [sorted(map(str, getattr(x, name).collect())) for x in (again, anew)]
        assert rows[0] == rows[1]
    assert again.prints.where("headless_tainted").count() == again.prints.count() > 0
    assert first.prints.where("headless_tainted").count() == 0


def compiled(df):
    """Of each generator in the plan, whether it runs as compiled code, by the first column it makes."""
    conf = df.sparkSession.conf
    conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = df.select("*")._jdf.queryExecution().executedPlan().toString()
    finally:
        conf.set("spark.sql.adaptive.enabled", "true")
    found = re.findall(r"(\*\(\d+\) )?Generate inline\(array\(struct\((\w+)", plan)
    return {name: bool(star) for star, name in found}


def test_rows_are_decoded_and_judged_by_compiled_code(spark, folder):
    hits = enrich.decode_hits(adapters.table(spark, folder, "hits"), Settings(secret="k"))
    assert compiled(hits)["ip"]
    batches = batch_ingest.check_batches(adapters.table(spark, folder, "batches"))
    assert compiled(batches)["_broken"]


def test_state_of_event_ids_leaves_memory_with_its_batch(spark, folder):
    """A changelog keeps what was written in memory, of each partition, until a snapshot."""
    path = shared_dir(spark, "state")
    query = ingest.start_batches(adapters.stream(spark, folder, "batches"), path, every=None)
    query.awaitTermination()
    assert query.exception() is None
    names = glob.glob(f"{path}/checkpoint/state/**".replace("file:", ""), recursive=True)
    assert any(n.endswith(".zip") for n in names) and not any(n.endswith(".changelog") for n in names)
    assert spark.conf.get("spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage") == "true"


def test_agents_are_listed_from_the_stage(spark, folder):
    campaigns = spark.createDataFrame([], "site_id string, utm_campaign string, status string")
    feeds = threats.Feeds(crawler_patterns=("feed",), ai_names=("bot",))
    dims = enrich.Dimensions(campaigns=campaigns, excluded=spark.createDataFrame([], "visitor_id string"), feeds=feeds)
    for name, job, key in (("hits", enrich.enrich_hits, "hit_id"), ("posts", posts.enrich_posts, "post_id")):
        seen = spark.sparkContext.accumulator(0)

        @F.udf("string")
        def looked_at(agent):
            seen.add(1)
            return agent

        raw = adapters.table(spark, folder, name)
        job(raw.withColumn("user_agent", looked_at("user_agent")), dims, Settings(secret="k"), stage_dir=shared_dir(spark, name))
        assert seen.value == raw.select(key).count()


def test_single_events_are_listed_once_for_all_outputs(spark, folder):
    campaigns = spark.createDataFrame([("site-1", "spring", "active")], "site_id string, utm_campaign string, status string")
    dims = enrich.Dimensions(campaigns=campaigns, excluded=spark.createDataFrame([], "visitor_id string"))
    table, kept = adapters.table(spark, folder, "posts"), Settings(secret="k", discard_threshold=0)
    each = posts.enrich_posts(table, dims, kept, stage_dir=shared_dir(spark, "each"))
    once = posts.enrich_posts(table, dims, kept, stage_dir=shared_dir(spark, "once"), list_once=True)
    for name in ("events", "rejects", "event_rejects"):
        before, after = getattr(each, name), getattr(once, name)
        assert before.columns == after.columns and before.count() > 0
        assert before.exceptAll(after).count() == after.exceptAll(before).count() == 0
    for rows in (once.events, once.event_rejects):
        assert "parseJson" not in rows._jdf.queryExecution().optimizedPlan().toString()


def test_posts_read_the_burst_windows_of_their_time_only(spark, folder):
    """A micro-batch does not read windows of hits after its last post."""
    read, path = [], shared_dir(spark, "timed")
    hits = adapters.table(spark, folder, "hits").selectExpr("hit_id", "remote_addr AS ip", "ts")
    windows = shared_dir(spark, "windows")
    enrich.burst_windows(hits, Settings(burst_seconds=3600)).write.parquet(windows)
    campaigns = spark.createDataFrame([], "site_id string, utm_campaign string, status string")
    dims = enrich.Dimensions(campaigns=campaigns, excluded=spark.createDataFrame([], "visitor_id string"))
    real = posts.with_burst_read

    def looked(accepted, counted, settings, **options):
        read.append(counted.count())
        return real(accepted, counted, settings, **options)

    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(posts, "with_burst_read", looked)
        query = ingest.start_events(
            adapters.stream(spark, folder, "posts"), lambda: dims, Settings(secret="k", burst_seconds=3600), path,
            load_bursts=lambda: spark.read.parquet(windows), every=None,
        )
        query.awaitTermination()
    assert query.exception() is None
    assert len(read) == adapters.STREAM_FILES and max(read) < 120  # of 400


@pytest.mark.parametrize("value", ["QUI", "QUI=", "QQ==", "QQ= =", "Q Q==", "QQ==\n", "=", "====", "Q", "QUJD"])
def test_usual_base64_reads_as_any_other(spark, value):
    """What goes the short way gives what the long way gives."""
    bare = re.sub("\\s|=+\\Z|=+(?=\n\\Z)", "", value)
    try:
        known = base64.b64decode(bare + "=" * (-len(bare) % 4), validate=True).decode("latin-1")
    except ValueError:
        known = None
    got = spark.createDataFrame([(value,)], "x string").select(base64_text(F.col("x"))).first()[0]
    assert got == known
