from __future__ import annotations

from pyspark.sql import functions as F

import corpus_pipeline
from footfall.llm.common import prepared, table

DATA = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def test_rows_without_an_id_and_repeated_rows(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(40)) for x in "abc")
    rows = [(None, a), (None, a), (7, a), (7, a), (7, b), (3, b.upper()), (None, c), (None, c.title()), (7, "alone"), (None, "alone, too")]
    docs = prepared(spark).createDataFrame([(*r, "en", "s", 1) for r in rows], SCHEMA)
    left = sorted(((r.doc_id, r.text) for r in corpus_pipeline.near_copies(spark, docs, DATA).collect()), key=str)
    assert [r for r in left if r[1].lower() != c] == sorted([(7, a), (3, b.upper()), (7, "alone"), (None, "alone, too")], key=str)
    assert [r[0] for r in left if r[1].lower() == c] == [None]


def test_columns_of_clashing_names_are_kept(spark):
    text = "one two three four five six"
    names = ["text_key", "bits", "root", "row", "stays", "rows", "lang_pred", "score"]
    docs = prepared(spark).createDataFrame([(1, text, "en", "s", 1), (2, text, "en", "s", 1)], SCHEMA)
    docs = docs.withColumns({n: F.lit("mine") for n in names})
    item = table(spark, DATA, "benchmark").where("text is not null").first().text
    docs = docs.unionByName(docs.where("doc_id = 1").withColumns({"doc_id": F.lit(9).cast("long"), "text": F.lit(item)}))
    for stage, kept in ((corpus_pipeline.known_language, {1, 2, 9}), (corpus_pipeline.near_copies, {1, 9}), (corpus_pipeline.without_benchmark, {1, 2})):
        found = stage(spark, docs, DATA)
        assert found.columns == docs.columns and found.schema["score"].dataType.simpleString() == "string"
        got = found.collect()
        assert {r.doc_id for r in got} <= kept and all(r[n] == "mine" for r in got for n in names)
        if stage is not corpus_pipeline.known_language:
            assert {r.doc_id for r in got} == kept


def test_empty_tables(spark):
    docs = prepared(spark).createDataFrame([], SCHEMA)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, DATA).count() == 0


def test_leaks_go_by_their_text(spark):
    item = table(prepared(spark), DATA, "benchmark").where("text is not null").first().text
    clean = "a text of its own that holds nothing of the kind"
    rows = [(None, f"so {item} it is"), (None, clean), (4, clean), (4, f"as {item} is"), (5, f"as {item} is")]
    docs = spark.createDataFrame([(*r, "en", "s", 1) for r in rows], SCHEMA)
    left = {(r.doc_id, r.text) for r in corpus_pipeline.without_benchmark(spark, docs, DATA).collect()}
    assert left == {(None, clean), (4, clean)}
