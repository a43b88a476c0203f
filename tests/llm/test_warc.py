from __future__ import annotations

import base64
import gzip
import hashlib
import io

import pytest
from pyspark.sql import functions as F

from footfall.llm import capture_index, warc

PAGES = [
    (1, "http://b.example.com/x", "<p>one</p>\r\n\r\nWARC/1.1"), (2, "http://a.example.com:8080/x?q=1#f", "<p>one</p>\r\n\r\nWARC/1.1"),
    (3, "https://b.example.com/x", ""), (4, None, None), (5, "http://b.example.com/a b\n", "ü\0\x1f" * 40_000),
    (6, "http://b.example.com/x", "<p>one</p>\r\n\r\nWARC/1.1"), (7, "", "other"), (7, "", "other"), (None, "http://n/", "other"), (None, "http://n/", "own"),
]


def plain(pages, least=0):
    out = []
    for page, _, html in pages:
        data = (html or "").encode()
        same = [p for p, _, h in pages if (h or "").encode() == data and p is not None]
        first = min(same) if same and len(data) >= least else None
        refers = first if first is not None and first != page else None
        out.append((page, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "revisit" if refers is not None else "response", refers))
    return sorted(out, key=str)


def read(spark, pages, least=0, rows=3):
    frame = spark.createDataFrame([(*p, "clash") for p in pages], "page_id long, url string, html string, payload_digest string")
    path = warc.write_archives(frame, least, rows)
    entries = warc.scanned(spark, path)
    index = capture_index.build(entries, block_lines=2, part_lines=3)
    keys = spark.createDataFrame([(warc.url_key(p[1] or ""),) for p in pages] + [("com,nowhere)/",), (None,)], "url_key string")
    return path, index, warc.read_records(capture_index.lookup(index, keys)).collect()


@pytest.mark.parametrize("least", [0, 4, 10**9])
def test_round_trip(spark, least):
    _, index, rows = read(spark, PAGES, least)
    got = sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in rows), key=str)
    assert got == plain(PAGES, least)
    full = {p: h or "" for p, _, h in PAGES}
    assert all(r.html == full[r.page_id] for r in rows if r.record_type == "response" and r.page_id)
    assert all((r.html is None) == (r.record_type == "revisit") for r in rows)


def test_archives_are_plain_gzip_members(spark):
    path, *_ = read(spark, PAGES)
    total = 0
    for row in spark.read.format("binaryFile").load(path).collect():
        text = gzip.decompress(row.content)
        assert text.startswith(b"WARC/1.1\r\n") and text.endswith(b"\r\n\r\n")
        total += text.count(b"\r\nWARC-Record-ID: ")
    assert total == len(PAGES)


def test_long_member_ends_in_a_zero():
    packed = warc.member(b"x" * (1 << 24))
    assert packed[-1] == 0 and gzip.decompress(packed) == b"x" * (1 << 24)
    both = packed + warc.member(b"y")
    spans = [(offset, length) for offset, length, _ in warc._spans(both)]
    assert [len(gzip.decompress(both[o : o + n])) for o, n in spans] == [1 << 24, 1]


def test_damage_is_noticed():
    good = warc.record(1, "http://x/", b"payload", warc.digest(b"payload"), None)
    assert warc.parsed(good)["payload"] == b"payload"
    for bad in (good.replace(b"payload\r\n", b"pAyload\r\n"), good[:-2], b"WARC" + good):
        with pytest.raises(ValueError):
            warc.parsed(bad)


def test_url_keys():
    assert warc.url_key("https://user@www.Example.com:81/A/b?c#d") == "com,example,www:81)/A/b?c"
    assert warc.url_key("") == ")" and " " not in warc.url_key("http://a b/c d")


def test_hot_url_spans_blocks_and_parts(spark):
    entries = spark.range(500).select(
        F.when(F.col("id") < 400, "com,hot)/").otherwise(F.concat(F.lit("com,cold)/"), "id")).alias("url_key"), F.col("id").alias("page_id"),
        F.lit("response").alias("record_type"), F.lit("d").alias("payload_digest"), F.lit("f").alias("file"), F.col("id").alias("offset"), F.lit(1).cast("long").alias("length"),
    )
    index = capture_index.build(entries, block_lines=7, part_lines=40)
    assert index.agg(F.sum("n_lines"), F.max("n_lines")).first()[:] == (500, 7)
    keys = spark.createDataFrame([("com,hot)/",), ("com,cold)/444",), ("com,hot",), ("zzz",)], "url_key string")
    assert sorted(r.page_id for r in capture_index.lookup(index, keys).collect()) == [*range(400), 444]


def test_a_lookup_reads_the_blocks_it_names_alone(spark):
    pages = spark.createDataFrame([(i, f"http://h/{i:04d}", f"page {i}") for i in range(400)], "page_id long, url string, html string")
    index = capture_index.build(warc.scanned(spark, warc.write_archives(pages)), block_lines=10, part_lines=100)
    blocks = index.collect()
    assert len(blocks) >= 40 and sum(r.n_lines for r in blocks) == 400
    one = spark.createDataFrame([("h)/0123",), ("h)/0123",)], "url_key string")
    named = [(r.file, r.offset, r.length) for r in capture_index.named_blocks(index, one).collect()]
    assert 1 <= len(named) <= 3 and set(named) < {(r.file, r.offset, r.length) for r in blocks}
    assert [r.page_id for r in capture_index.lookup(index, one).collect()] == [123]


def test_many_keys_of_one_part_come_in_slices(spark):
    pages = spark.createDataFrame([(i, f"http://h/{i:04d}", None) for i in range(0, 400, 4)], "page_id long, url string, html string")
    index = capture_index.build(warc.scanned(spark, warc.write_archives(pages)), block_lines=7)
    keys = spark.range(400).select(F.format_string("h)/%04d", "id").alias("url_key"))
    assert sorted(r.page_id for r in capture_index.lookup(index, keys, part_lines=9).collect()) == [*range(0, 400, 4)]


def test_archives_are_read_as_streams():
    class Slow(io.RawIOBase):  # gives at most ten bytes at a time
        def __init__(self, data):
            self.left = io.BytesIO(data)

        def read(self, size=-1):
            return self.left.read(min(size, 10))

    contents = [b"a" * 5, bytes(range(256)) * 999, b"c" * (1 << 24), b"d"]
    data = b"".join(map(warc.member, contents))
    spans = list(warc._spans(Slow(data)))
    assert [c for _, _, c in spans] == contents
    assert [gzip.decompress(data[o : o + n]) for o, n, _ in spans] == contents
    with pytest.raises(ValueError):
        list(warc._spans(Slow(data[:-3])))


def test_empty_table(spark):
    frame = spark.createDataFrame([], "page_id long, url string, html string")
    index = capture_index.build(warc.scanned(spark, warc.write_archives(frame)))
    keys = spark.createDataFrame([("x",)], "url_key string")
    assert warc.read_records(capture_index.lookup(index, keys)).collect() == []


def test_a_page_that_comes_again_with_another_payload(spark):
    pages = [(1, "http://x/1", "a"), (2, "http://x/2", "a"), (2, "http://x/2", "own"), (3, "http://x/3", "b"), (4, "http://x/4", "a"), (4, "http://x/5", "b")]
    _, _, rows = read(spark, pages)
    got = sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in rows), key=str)
    assert got == plain(pages)
    assert [r.html for r in rows if r.page_id == 2 and r.record_type == "response"] == ["own"]
