from __future__ import annotations

import re

import public_tokenizers
import pytest

import corpus_pipeline
from footfall.llm.common import prepared, table
from footfall.llm.languages import fit, predicted
from footfall.llm.packing import token_ids
from tests.llm.test_leaks import plain as plain_leaks
from tests.llm.test_packing import check_places
from tests.llm.test_simhash import plain_components, plain_fingerprint

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    """The documents before and after each stage."""
    docs = table(prepared(spark), DATA, "documents")
    odd = spark.createDataFrame(
        [(9000, None, "en", "s", 0), (9001, "", "en", "s", 0), (9002, "12 34", "en", "s", 5), (None, "the and of " * 9, "en", "s", 99)], docs.schema
    )
    found = [docs.unionByName(odd)]
    for _, stage in corpus_pipeline.STAGES:
        found.append(stage(spark, found[-1], DATA).cache())
    return found


def test_stages_keep_the_columns(stages):
    assert all(df.columns == stages[0].columns for df in stages[1:-1])


def test_only_unknown_languages_go(spark, stages):
    kept = {(r.doc_id, r.text) for r in stages[1].collect()}
    rows = predicted(stages[0], fit(stages[0])).collect()
    assert kept == {(r.doc_id, r.text) for r in rows if r.lang_pred != "und" and r.score >= 0.5}
    gone = {(r.doc_id, r.text) for r in stages[0].collect()} - kept
    assert {9000, 9001, 9002} <= {d for d, _ in gone} and all(d is not None for d, _ in gone)
    assert all(not re.search(r"[^\W\d_]", t or "") or len(t) < 60 for _, t in gone)


def test_one_of_each_group_of_copies_stays(stages):
    before = [(r.doc_id, r.text) for r in stages[1].collect()]
    label = plain_components([plain_fingerprint(t) for _, t in before])
    groups = {}
    for (doc, _), x in zip(before, label):
        if doc is not None:
            groups.setdefault(x, []).append(doc)
    left = {r.doc_id for r in stages[2].collect()}
    assert left == {min(g) for g in groups.values()} | {None} and max(map(len, groups.values())) > 1


def test_documents_with_items_go(spark, stages):
    before = [(r.doc_id, r.text) for r in stages[2].collect()]
    items = [(r.item_id, r.text) for r in table(spark, DATA, "benchmark").collect()]
    leaked = {d for d, *_ in plain_leaks(before, items, 0.8)}
    assert leaked and {r.doc_id for r in stages[3].collect()} == {d for d, _ in before} - leaked


def test_all_that_is_left_is_packed(stages):
    rows = stages[4].collect()
    path = public_tokenizers.path("byte_bpe_50k.json")
    sizes = {r.doc_id: len(token_ids(r.text, path)) + 1 for r in stages[3].collect()}
    packed = {}
    for r in rows:
        packed[r.doc_id] = packed.get(r.doc_id, 0) + r.length
    assert packed == sizes
    assert check_places(rows, 2048) <= -(-sum(sizes.values()) // 2048) + 1


def test_run_writes_every_stage(spark):
    assert corpus_pipeline.run(spark, DATA).count() > 0
