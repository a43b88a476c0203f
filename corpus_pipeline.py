"""The corpus pipeline: stages over ``documents``, each written and read again."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from footfall.llm import languages, leaks, packing, simhash
from footfall.llm.common import may_be_in, prepared, table, written

LEAST_SCORE = 0.5


def _keyed(docs: DataFrame) -> DataFrame:
    """The whole rows as one column, which no helper column can clash with, and their keys."""
    return docs.select(
        F.struct(*docs.columns).alias("row"), F.col("doc_id").cast("long").alias("doc_id"),
        simhash.text_digest(F.col("text")).alias("text_key"),
    )


def _same(keyed: DataFrame, other: DataFrame) -> Column:
    return keyed.doc_id.eqNullSafe(other.doc_id) & (keyed.text_key == other.text_key)


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents go whose language isn't known: no letters (null and empty texts too), or
    a score below LEAST_SCORE. Texts count whole, however long; repeated rows and null
    ids are judged each by their own text; further columns of any name are kept; an
    empty table gives an empty one."""
    prepared(spark)
    names = [c if c == "text" else f"column_{i}" for i, c in enumerate(docs.columns)]  # no clash with what is predicted
    found = languages.predicted(docs.toDF(*names), languages.fit(docs))
    known = (found.lang_pred != languages.UNKNOWN) & (found.score >= LEAST_SCORE)
    return found.where(known).select(names).toDF(*docs.columns)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of near copies (SimHash of three-word shingles, linked at two or fewer differing
    bits, in chains) one row stays: that with the smallest id, then the smallest digest
    of its text. A row without an id comes after all others; of rows equal in both, one
    stays. Null and empty texts are copies of each other. Texts count whole; further
    columns of any name are kept; an empty table gives an empty one."""
    prepared(spark)
    judged = written(simhash.surplus(docs), "surplus")
    keyed, named = _keyed(docs), may_be_in(judged, "text_key")
    # most rows stay without a shuffle of their texts; the others meet what is judged by key
    asked = written(keyed.where(named(F.col("text_key"))), "asked")
    repeated = judged.where("stays")
    once = asked.join(judged, _same(asked, judged), "left_anti")
    again = asked.join(repeated, _same(asked, repeated), "left_semi").dropDuplicates(["doc_id", "text_key"])
    return keyed.where(~named(F.col("text_key"))).unionByName(once).unionByName(again).select("row.*")


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows go whose text holds a benchmark item. Rows of one id are judged each by its
    own text, null ids too; repeated rows stay or go together; null and empty texts hold
    nothing; texts count whole; further columns of any name are kept; an empty table
    gives an empty one."""
    prepared(spark)
    leaked = written(leaks.leaked(docs, table(spark, sf_dir, "benchmark")), "leaked")
    keyed, named = _keyed(docs), may_be_in(leaked, "text_key")
    asked = keyed.where(named(F.col("text_key")))
    clear = keyed.where(~named(F.col("text_key")))
    return clear.unionByName(asked.join(leaked, _same(asked, leaked), "left_anti")).select("row.*")


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places of all pieces of all rows in training sequences (columns of ``packing.packed``).
    Null and empty texts are their end token alone; repeated rows and null ids are packed
    like any other; other columns are ignored; an empty table gives an empty result."""
    prepared(spark)
    return packing.packed(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("known_language", known_language),
    ("near_copies", near_copies),
    ("without_benchmark", without_benchmark),
    ("packed", packed),
]

# The language model and fingerprints have no SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(prepared(spark), sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
