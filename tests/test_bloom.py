from __future__ import annotations

from pyspark.sql import functions as F

from footfall.operators.bloom import build_filters, may_hold


def test_filters_miss_nothing_and_seldom_say_yes(spark):
    rows = spark.range(40_000).selectExpr(
        "CASE WHEN id < 30000 THEN 'large' WHEN id < 39990 THEN concat('g', id % 7) ELSE 'nulls' END AS site_id",
        "id % 3 AS part", "CASE WHEN id < 39990 THEN concat('v', id) END AS v",
    ).unionByName(spark.range(5).selectExpr("CAST(NULL AS STRING) AS site_id", "id % 3 AS part", "concat('n', id) AS v"))
    filters = build_filters(rows, ["site_id", "part"], "v")
    assert filters.where("site_id = 'large'").agg(F.max("blocks")).first()[0] == 8
    assert filters.where("site_id = 'nulls'").count() == 3 and filters.where("site_id is null").count() == 3
    found = may_hold(rows.where("site_id is not null").select("site_id", "v").distinct(), filters, "v", ["site_id"])
    real = rows.where("v is not null and site_id is not null").distinct()
    assert real.exceptAll(found.select(*rows.columns).distinct()).count() == 0
    others = spark.range(20_000).selectExpr("'large' AS site_id", "concat('x', id) AS v")
    assert may_hold(others, filters, "v", ["site_id"]).count() < 20
    assert may_hold(others.withColumn("site_id", F.lit("nulls")), filters, "v", ["site_id"]).count() == 0


def test_few_bytes_of_probes_are_tested_by_all_tasks(spark):
    rows = spark.range(3_000).selectExpr("concat('s', id % 3) AS site_id", "id % 7 AS part", "concat('v', id) AS v")
    filters = build_filters(rows, ["site_id", "part"], "v").localCheckpoint()
    probes = spark.range(0, 500, 1, 1).selectExpr("concat('s', id % 3) AS site_id", "concat('v', id) AS v")
    found = may_hold(probes, filters, "v", ["site_id"])
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    # only sizes of filters that there are: one here
    assert "Repartition" in plan and "1048576" not in plan
    assert sorted(map(tuple, found.select("site_id", "part", "v").where("part = 0").collect())) >= sorted(
        (f"s{i % 3}", 0, f"v{i}") for i in range(0, 500) if i % 7 == 0
    )
    assert may_hold(probes, filters.limit(0), "v", ["site_id"]).count() == 0
