from __future__ import annotations

import textwrap
from pathlib import Path

import duckdb
import pandas as pd
import pytest

from footfall.llm.license_texts import ISC, LICENSES, MIT
from footfall.llm.licenses import scan, scan_sql


def found(spark, data):
    docs = spark.createDataFrame(data, "doc_id long, text string, license_id string")
    return {(r.doc_id, r.scope, r.license_id, r.n_found) for r in scan(docs).collect()}


def test_variants_of_whole_texts(spark):
    data = [
        (1, MIT, "x"),
        (2, "Copyright (c) 2020 Somebody\n\n" + MIT.upper().replace(",", " ,").replace("\n\n", "\r\n") + "\nAll rights reserved.", "x"),
        (3, MIT.replace("sublicense", "sub-licence").replace("MIT License\n\n", "MIT Licence\n© 1999 A, B\n"), "x"),
        (4, MIT + " And one more condition.", "x"),
        (5, ISC, "x"), (5, ISC, "x"), (None, ISC, "x"),
        (6, None, "x"), (7, "", "x"), (8, " \n.,;\n", "x"),
        (9, "Some prose.\nReleased under the MIT Licence\nmore\nreleased under the mit license!\nLicensed under CC BY-NC 4.0.", "x"),
        (10, "They were released under the MIT License in spring.", "x"),
    ]
    whole = {r for r in found(spark, data) if r[1] == "document"}
    assert whole == {(1, "document", "MIT", 1), (2, "document", "MIT", 1), (3, "document", "MIT", 1), (5, "document", "ISC", 2), (None, "document", "ISC", 1)}
    lines = {r for r in found(spark, data) if r[1] == "line"}
    assert lines == {(9, "line", "MIT", 2), (9, "line", "CC-BY-NC-4.0", 1)}


def test_every_known_text_finds_itself(spark):
    data = [(n, t, i) for n, (i, t) in enumerate((i, t) for i, texts in LICENSES.items() for t in texts)]
    got = {(d, i) for d, scope, i, _ in found(spark, data) if scope == "document"}
    assert got == {(d, i) for d, _, i in data}


def test_empty_table(spark):
    assert found(spark, []) == set()


def both(spark, texts):
    """What Spark and the SQL find in whole documents."""
    docs = pd.DataFrame({"doc_id": range(len(texts)), "text": texts})
    con = duckdb.connect()
    con.register("documents", docs)
    columns = "doc_id long, text string"
    in_spark = {(r.doc_id, r.scope, r.license_id, r.n_found) for r in scan(spark.createDataFrame(list(enumerate(texts)), columns)).collect()}
    in_sql = set(con.execute(scan_sql()).fetchall())
    assert in_spark == in_sql
    return {(d, i) for d, scope, i, _ in in_spark if scope == "document"}


def test_line_breaks_make_no_difference(spark):
    texts, ids = [], []
    for i, known in LICENSES.items():
        for text in known[-2:]:
            for width in range(40, 121, 2):
                wrapped = "\n\n".join(textwrap.fill(p, width, break_long_words=False, break_on_hyphens=False) for p in text.split("\n\n"))
                texts.append(wrapped if width % 4 else f"Copyright (c) 2019-2020 J. R. Somebody, Inc.\nAll rights reserved.\n\n{wrapped}")
                ids.append(i)
    assert both(spark, texts) == set(enumerate(ids))


def test_a_copyright_line_ends_where_a_known_text_begins(spark):
    flat = " ".join(MIT.removeprefix("MIT License").split())
    owned = ("Copyright (c) 2020 X.", "Copyright 1999, 2004 A. N. Other Ltd. All rights reserved.", "© The Authors", "(C) 2001 Y")
    texts = [f"{line} {flat}" for line in owned] + [f"Copyright of all this is mine. {flat}", f"{owned[0]} And more. {flat} And more."]
    assert both(spark, texts) == {(n, "MIT") for n in range(4)}


def test_full_texts(spark):
    folder = Path("/usr/share/common-licenses")
    files = {"Apache-2.0": "Apache-2.0", "CC0-1.0": "CC0-1.0", "GPL-2.0-only": "GPL-2", "GPL-3.0-only": "GPL-3", "MPL-2.0": "MPL-2.0", "LGPL-2.1-only": "LGPL-2.1"}
    there = {i: (folder / f).read_text(encoding="utf-8") for i, f in files.items() if (folder / f).exists()}
    if not there:
        pytest.skip("no licence texts on this machine")
    texts = [*there.values(), *(t.upper().replace("\n", "\r\n") for t in there.values()), *(t + "\nBut not here." for t in there.values())]
    assert both(spark, texts) == {(n, i) for n, i in enumerate([*there, *there])}


def test_a_very_long_text(spark):
    assert both(spark, ["word " * 1_000_000 + "\n" + MIT, MIT + "\n" * 100_000]) == {(1, "MIT")}
