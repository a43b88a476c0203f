"""Threat feeds from JSON files: agent patterns, AI bot names, cloud prefixes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MOST_ENTRIES = 20_000


def _json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("multiLine", "true").json(path)


def _short_list(df: DataFrame, column: str, most: int) -> tuple[str, ...]:
    """A configuration-sized list; a feed of more than ``most`` entries is an error,
    never a shorter list."""
    rows = df.select(column).limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"feed has more than {most} entries")
    return tuple(r[0] for r in rows)


def crawler_patterns(spark: SparkSession, path: str, *, most: int = MOST_ENTRIES) -> tuple[str, ...]:
    """File: a list of objects with a ``pattern``. ``most`` bounds what the driver holds."""
    feed = _json(spark, path, "pattern STRING").filter("pattern IS NOT NULL")
    return _short_list(feed, "pattern", most)


def ai_names(spark: SparkSession, path: str, *, most: int = MOST_ENTRIES) -> tuple[str, ...]:
    """File: one object whose keys are the names. ``most`` bounds what the driver holds."""
    text = spark.read.text(path, wholetext=True)
    names = text.select(
        F.explode(F.map_keys(F.from_json("value", "map<string,string>"))).alias("name")
    ).filter("name <> ''")
    return _short_list(names, "name", most)


def aws_prefixes(spark: SparkSession, path: str) -> DataFrame:
    feed = _json(
        spark,
        path,
        "prefixes ARRAY<STRUCT<ip_prefix: STRING>>, ipv6_prefixes ARRAY<STRUCT<ipv6_prefix: STRING>>",
    )
    both = F.concat(
        F.coalesce("prefixes.ip_prefix", F.expr("cast(array() as array<string>)")),
        F.coalesce("ipv6_prefixes.ipv6_prefix", F.expr("cast(array() as array<string>)")),
    )
    return feed.select(F.lit("aws").alias("provider"), F.explode(both).alias("cidr"))


def gcp_prefixes(spark: SparkSession, path: str) -> DataFrame:
    feed = _json(spark, path, "prefixes ARRAY<STRUCT<ipv4Prefix: STRING, ipv6Prefix: STRING>>")
    return (
        feed.select(F.explode("prefixes").alias("p"))
        .select(
            F.lit("gcp").alias("provider"),
            F.explode(F.array("p.ipv4Prefix", "p.ipv6Prefix")).alias("cidr"),
        )
        .filter("cidr IS NOT NULL")
    )


def cloud_prefixes(*feeds: DataFrame) -> DataFrame:
    """All providers in one table."""
    rows = feeds[0]
    for feed in feeds[1:]:
        rows = rows.unionByName(feed)
    return rows
