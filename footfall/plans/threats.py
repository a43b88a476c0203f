"""Matching of user agents and addresses against threat feeds."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.errors import IllegalArgumentException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from footfall.functions.decode import with_parsed
from footfall.functions.network import (
    ipv4_number,
    ipv4_range,
    ipv6_hex,
    ipv6_range,
    next_hex,
    next_number,
    prefix_address,
    prefix_bits,
    unmapped,
)
from footfall.operators.intervals import by_block, merge_intervals, v4_block, v6_block
from footfall.sources.tables import remove

SHRINK = 0.1  # a feed that shrinks below this share of its old size is not taken over


def merged_v4(prefixes: DataFrame) -> DataFrame:
    """Malformed and IPv6 prefixes drop out."""
    parsed = _parsed(prefixes, ipv4_number)
    ranges = parsed.select(ipv4_range(F.col("_address"), F.col("_bits")).alias("r")).select("r.*")
    return merge_intervals(ranges, block=v4_block, successor=next_number)


def merged_v6(prefixes: DataFrame) -> DataFrame:
    parsed = _parsed(prefixes, ipv6_hex)
    ranges = parsed.select(ipv6_range(F.col("_address"), F.col("_bits")).alias("r")).select("r.*")
    return merge_intervals(ranges, block=v6_block, successor=next_hex)


def _parsed(prefixes: DataFrame, address: Callable[[Column], Column]) -> DataFrame:
    """Every prefix once, parsed after that: the test of its address stays behind the
    generator, or it would be made on every row that prefixes are derived from."""
    return with_parsed(
        prefixes.select("cidr").distinct(),
        _address=address(prefix_address(F.col("cidr"))),
        _bits=prefix_bits(F.col("cidr")),
    ).filter(F.col("_address").isNotNull())


def accept_feed(new: DataFrame, old: DataFrame | None, *, shrink: float = SHRINK) -> DataFrame:
    """The new feed unless it is empty or has shrunk below ``shrink`` of the old one's
    size; then the old one stays."""
    if old is None:
        return new
    size = new.count()
    return old if size == 0 or size < shrink * old.count() else new


def accept_feeds(
    fresh: dict[str, DataFrame], old: DataFrame | None, *, shrink: float = SHRINK
) -> DataFrame:
    """Prefixes (provider, cidr) of all providers, each guarded on its own; a provider
    that has no fresh feed keeps its old one."""
    parts = [
        accept_feed(
            new.select(F.lit(provider).alias("provider"), "cidr"),
            None if old is None else old.filter(F.col("provider") == provider).select("provider", "cidr"),
            shrink=shrink,
        )
        for provider, new in fresh.items()
    ]
    if old is not None:
        parts.append(old.filter(~F.col("provider").isin(*fresh)).select("provider", "cidr"))
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part)
    return rows


@dataclass(frozen=True)
class Feeds:
    """Agent patterns and names are configuration-sized lists; the address ranges
    are merged tables (lo, hi) as ``publish_ranges`` stores them."""

    crawler_patterns: tuple[str, ...] = ()
    ai_names: tuple[str, ...] = ()
    ranges_v4: DataFrame | None = None
    ranges_v6: DataFrame | None = None


def refresh_feeds(
    spark: SparkSession,
    fresh: dict[str, DataFrame],
    path: str,
    *,
    version: str,
    shrink: float = SHRINK,
) -> tuple[DataFrame, DataFrame]:
    """Guard, merge and publish the cloud prefixes of all providers.

    Every refresh writes a folder of its own, so jobs that run go on reading theirs;
    ``version`` has to sort after those before it. A refresh that breaks off leaves
    a folder that nobody takes for a version.
    """
    latest = latest_version(spark, path)
    old = None if latest is None else spark.read.parquet(f"{latest}/prefixes")
    target = f"{path}/{version}"
    accept_feeds(fresh, old, shrink=shrink).write.mode("overwrite").parquet(f"{target}/prefixes")
    return publish_ranges(spark.read.parquet(f"{target}/prefixes"), target)


def latest_version(spark: SparkSession, path: str) -> str | None:
    """Folder of the newest refresh that was written to its end."""
    ends = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/*/v6/_SUCCESS")
    found = ends.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(ends) or []
    names = sorted(status.getPath().getParent().getParent().toString() for status in found)
    return names[-1] if names else None


def publish_ranges(prefixes: DataFrame, path: str) -> tuple[DataFrame, DataFrame]:
    """Merge a refreshed prefix table once and store it for the ingest jobs. Its distinct
    prefixes are stored for that time, so both merges read the table once."""
    spark = prefixes.sparkSession
    prefixes.select("cidr").distinct().write.mode("overwrite").parquet(f"{path}/distinct")
    distinct = spark.read.schema("cidr string").parquet(f"{path}/distinct")
    merged_v4(distinct).write.mode("overwrite").parquet(f"{path}/v4")
    merged_v6(distinct).write.mode("overwrite").parquet(f"{path}/v6")
    remove(spark, f"{path}/distinct")
    return spark.read.parquet(f"{path}/v4"), spark.read.parquet(f"{path}/v6")


def checked_patterns(
    spark: SparkSession, patterns: tuple[str, ...]
) -> tuple[list[str], list[str]]:
    """Patterns that Spark's own regular expressions (Java's) take, and those they refuse."""
    good, refused = [], []
    for pattern in patterns:
        try:
            spark._jvm.java.util.regex.Pattern.compile(pattern)
        except IllegalArgumentException:
            refused.append(pattern)
        else:
            good.append(pattern)
    return good, refused


# A named group or a back-reference means something else once patterns are joined.
_OF_ITS_OWN = re.compile(r"\(\?<[A-Za-z]|\\[1-9k]")


def _agent_match(patterns: list[str]) -> Column:
    alone = [p for p in patterns if _OF_ITS_OWN.search(p)]
    joined = "|".join(f"(?:{p})" for p in patterns if not _OF_ITS_OWN.search(p))
    found = F.lit(False)
    for pattern in [*([joined] if joined else []), *alone]:
        found = found | F.coalesce(F.col("user_agent").rlike(f"(?i){pattern}"), F.lit(False))
    return found


def with_agent_flags(
    hits: DataFrame, feeds: Feeds, *, agents_of: DataFrame | None = None
) -> DataFrame:
    """Hundreds of patterns are tried once per distinct agent. Only the matching
    agents are joined back, a short list that normally fits a broadcast.

    ``agents_of`` may name the raw table the hits come from, so that listing the
    agents reads one column of it instead of repeating the work done on hits.
    """
    source = hits if agents_of is None else agents_of
    agents = (
        source.select("user_agent")
        .distinct()
        .withColumn(
            "crawler_match", _agent_match(checked_patterns(hits.sparkSession, feeds.crawler_patterns)[0])
        )
        .withColumn("ai_crawler_match", _agent_match([re.escape(n) for n in feeds.ai_names if n]))
        .filter("crawler_match OR ai_crawler_match")
    )
    return hits.join(agents, "user_agent", "left").fillna(
        False, ["crawler_match", "ai_crawler_match"]
    )


def _v6_narrow(merged: DataFrame) -> DataFrame:
    """Ranges inside one /32, keyed by it."""
    return merged.filter(v6_block(F.col("lo")) == v6_block(F.col("hi"))).withColumn(
        "block", v6_block(F.col("lo"))
    )


def _v6_wide(merged: DataFrame) -> DataFrame:
    """Larger ranges, one row for each of the at most 65,536 /16 they touch."""

    def top(value: Column) -> Column:
        return F.conv(F.substring(value, 1, 5), 16, 10).cast("int")

    return merged.filter(v6_block(F.col("lo")) != v6_block(F.col("hi"))).withColumn(
        "block", F.explode(F.sequence(top(F.col("lo")), top(F.col("hi"))))
    )


def _in_range(hits: DataFrame, ranges: DataFrame, value: str, block: Column, name: str) -> DataFrame:
    """Point in range as an equi join on the block plus a range test. The ranges
    are disjoint, so a hit meets at most one of them and no row is doubled."""
    known = ranges.select(
        F.col("block").alias("_block"), F.col("lo").alias("_lo"), F.col("hi").alias("_hi")
    )
    inside = (block == F.col("_block")) & F.col(value).between(F.col("_lo"), F.col("_hi"))
    return hits.join(known, inside, "left").select(
        *hits.columns, F.col("_lo").isNotNull().alias(name)
    )


def with_datacenter_flag(
    hits: DataFrame, ranges_v4: DataFrame, ranges_v6: DataFrame, *, key: str = "ip"
) -> DataFrame:
    """True for addresses inside a merged range, IPv4 or IPv6."""
    address = F.col(key)
    flagged = with_parsed(hits, _n4=ipv4_number(unmapped(address)), _n6=ipv6_hex(address))
    n4, n6 = F.col("_n4"), F.col("_n6")
    top = F.conv(F.substring(n6, 1, 5), 16, 10).cast("int")
    flagged = _in_range(flagged, by_block(ranges_v4), "_n4", v4_block(n4), "_in4")
    flagged = _in_range(flagged, _v6_narrow(ranges_v6), "_n6", v6_block(n6), "_in6")
    flagged = _in_range(flagged, _v6_wide(ranges_v6), "_n6", top, "_in6_wide")
    found = F.col("_in4") | F.col("_in6") | F.col("_in6_wide")
    return flagged.select(*hits.columns, found.alias("datacenter_ip"))


def with_threat_flags(
    hits: DataFrame, feeds: Feeds, *, key: str = "ip", agents_of: DataFrame | None = None
) -> DataFrame:
    flagged = with_agent_flags(hits, feeds, agents_of=agents_of)
    if feeds.ranges_v4 is None or feeds.ranges_v6 is None:
        return flagged.withColumn("datacenter_ip", F.lit(False))
    return with_datacenter_flag(flagged, feeds.ranges_v4, feeds.ranges_v6, key=key)
