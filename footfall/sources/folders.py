"""Fact tables folder by folder: site, day and micro-batch.

Three things lie beside a fact table ``path``. ``path``_manifest says which folders are
out of use (see ``plans.compact``); readers leave them out. ``path``_visitors holds a
Bloom filter of the visitors of each batch's folders, so that a job that looks for few
visitors opens few folders. Both are small, and a table without them is read whole.
"""

from __future__ import annotations

import json
from collections.abc import Iterable
from dataclasses import dataclass
from datetime import date
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from footfall.operators.bloom import build_filters, may_hold
from footfall.sources.tables import exists, with_day

FOLDER = ("site_id", "event_date", "batch_id")
_NULL = "__HIVE_DEFAULT_PARTITION__"


@dataclass(frozen=True)
class Folder:
    path: str
    site_id: str | None
    event_date: date | None
    batch_id: int | None = None  # none in tables that aren't written in micro-batches

    @property
    def key(self) -> tuple:
        return self.site_id, self.event_date, self.batch_id


def _folder(path: str) -> Folder:
    values = dict(part.split("=", 1) for part in path.split("/") if "=" in part)
    site, day, batch = ((None if values.get(c, _NULL) == _NULL else unquote(values[c])) for c in FOLDER)
    return Folder(path, site, day and date.fromisoformat(day), batch and int(batch))


def store_of(spark: SparkSession, path: str):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()), target


def _listed(spark: SparkSession, pattern: str) -> list[str]:
    """Folders that match."""
    store, target = store_of(spark, pattern)
    return sorted(s.getPath().toString() for s in store.globStatus(target) or () if s.isDirectory())


def _named(spark: SparkSession, column: str, value: str) -> str:
    """The name of a value's partition folder."""
    catalog = spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils
    return f"{column}={catalog.escapePathName(value)}"


def all_folders(spark: SparkSession, path: str, sites: Iterable[str] | None = None, days: Iterable[date] | None = None) -> list[Folder]:
    """The innermost folders of a fact table, of the given sites and days only."""
    tops = ["site_id=*"] if sites is None else [_named(spark, "site_id", s) for s in sites]
    dates = ["event_date=*"] if days is None else [f"event_date={d.isoformat()}" for d in days]
    found = []
    for top in tops:
        for day in dates:
            outer = _listed(spark, f"{path}/{top}/{day}")
            inner = _listed(spark, f"{path}/{top}/{day}/batch_id=*")
            parents = {p.rsplit("/", 1)[0] for p in inner}
            found += [_folder(p) for p in inner + [p for p in outer if p not in parents]]
    return found


def out_of_use(spark: SparkSession, path: str) -> tuple[int, dict[tuple, str]]:
    """Version of the manifest (0: none) and the keys of the folders out of use, each
    with what it was replaced by or ``pending``."""
    store, target = store_of(spark, f"{path}_manifest/v*.json")
    files = sorted(s.getPath().toString() for s in store.globStatus(target) or ())
    if not files:
        return 0, {}
    text = "\n".join(r.value for r in spark.read.text(files[-1], wholetext=True).collect())
    content = json.loads(text)
    dead = {(site, day and date.fromisoformat(day), batch): why for site, day, batch, why in content["out_of_use"]}
    return content["version"], dead


def write_manifest(spark: SparkSession, path: str, version: int, dead: dict[tuple, str]) -> None:
    """The next version, in one step: the file is complete before it gets its name. Two
    writers of one version: the second fails."""
    rows = sorted(([s, d and d.isoformat(), b, why] for (s, d, b), why in dead.items()), key=repr)
    store, target = store_of(spark, f"{path}_manifest/v{version:012d}.json")
    _, draft = store_of(spark, f"{path}_manifest/.v{version:012d}-{spark.sparkContext.applicationId}")
    out = store.create(draft, True)
    out.write(bytearray(json.dumps({"version": version, "out_of_use": rows}).encode()))
    out.close()
    if store.exists(target) or not store.rename(draft, target):
        raise RuntimeError(f"version {version} of the manifest of {path} is there already")


def live_folders(spark: SparkSession, path: str, sites: Iterable[str] | None = None, days: Iterable[date] | None = None) -> list[Folder]:
    """The folders in use. The manifest is read first, so that a change of it in between
    takes effect with the next reader."""
    _, dead = out_of_use(spark, path)
    return [f for f in all_folders(spark, path, sites, days) if f.key not in dead]


def read_folders(spark: SparkSession, path: str, folders: list[Folder]) -> DataFrame | None:
    """The rows of these folders; no other is listed or opened. None without a folder."""
    if not folders:
        return None
    reader = spark.read.option("basePath", path)
    paths = [f.path for f in folders]
    found = reader.parquet(paths[0]).schema  # one footer
    kinds = {"site_id": "string", "event_date": "date", "batch_id": "long"}
    schema = StructType()
    for field in found.fields:
        schema.add(field.name, kinds.get(field.name, field.dataType))
    return reader.schema(schema).parquet(*paths)


def read_facts(spark: SparkSession, path: str, *, sites: Iterable[str] | None = None, days: Iterable[date] | None = None) -> DataFrame:
    """The fact table as its manifest says; without one, as it lies there."""
    if not exists(spark, f"{path}_manifest") and sites is None and days is None:
        return spark.read.parquet(path)
    rows = read_folders(spark, path, live_folders(spark, path, sites, days))
    return spark.read.parquet(path).limit(0) if rows is None else rows


def write_filters(rows: DataFrame, path: str, part: int, *, ts: str = "created_at") -> None:
    """Filters of the visitors in each folder of ``rows``, in a part of the filter table of
    their own. To be called before the rows are written: a filter may hold visitors
    that never come, but no folder is there before its filter."""
    names = [c for c in FOLDER if c in rows.columns or c == "event_date"]
    days = rows if "event_date" in rows.columns else with_day(rows, ts)
    build_filters(days, names, "visitor_id").write.mode("overwrite").parquet(f"{path}_visitors/part={part}")


def folders_with(spark: SparkSession, path: str, visitors: DataFrame) -> list[Folder]:
    """The folders in use that may hold rows of ``visitors`` (site_id, visitor_id): those
    whose filter doesn't say no, and those without a filter."""
    sites = [r.site_id for r in visitors.select("site_id").distinct().collect() if r.site_id is not None]
    folders = live_folders(spark, path, sites)
    if not exists(spark, f"{path}_visitors"):
        return folders
    filters = spark.read.parquet(f"{path}_visitors").where(F.col("site_id").isin(sites)).drop("part")
    keyed = lambda df: {(r.site_id, r.event_date, r.batch_id) for r in df.select(*FOLDER).distinct().collect()}
    known = keyed(filters)
    maybe = keyed(may_hold(visitors.select("site_id", "visitor_id").distinct(), filters, "visitor_id", ["site_id"]))
    return [f for f in folders if f.key not in known or f.key in maybe]
