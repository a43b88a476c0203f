"""The fixed-size test of keys misses none and passes few others."""

from pyspark.sql import functions as F

from footfall.llm.common import may_be_in


def test_every_key_passes_and_few_others(spark):
    rows = spark.range(20_000).select(F.unhex(F.sha2(F.col("id").cast("string"), 256)).alias("key"), "id")
    passed = may_be_in(rows.where("id % 10 = 0"), "key")
    found = rows.where(passed(F.col("key")))
    assert found.where("id % 10 = 0").count() == 2_000
    assert found.where("id % 10 <> 0").count() < 20


def test_no_keys_pass_nothing(spark):
    rows = spark.range(100).select(F.col("id").cast("string").cast("binary").alias("key"))
    passed = may_be_in(rows.limit(0), "key")
    assert rows.where(passed(F.col("key"))).count() == 0
    assert rows.where(~passed(F.col("key"))).count() == 100
