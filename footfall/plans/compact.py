"""Compaction of fact tables that streams write: many small folders into few large files.

A stream leaves one folder for each site, day and micro-batch. Compaction writes the
rows of closed batches anew, as one folder for each site and day with files of a target
size, and swaps it in with one step: the next version of the table's manifest names the
old folders as replaced. Until then the new folder is named as pending, so at no time
does a reader see rows twice or miss them, and a failed run leaves nothing in use.
Replaced folders stay for readers that have begun; the next run deletes them.

The newest batches are left alone, as a stream may repeat them. A batch that is written
again after it was compacted, by whatever mistake, is a replaced folder and not read.
If a folder changes while it is copied (a sweep, a purge), its site and day are left as
they were.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from footfall.sources.folders import (
    FOLDER,
    Folder,
    all_folders,
    out_of_use,
    read_folders,
    store_of,
    write_filters,
    write_manifest,
)
from footfall.sources.tables import exists, remove

TARGET_BYTES = 128 << 20
KEPT_BATCHES = 2  # of the newest ones
PENDING, REPLACED = "pending", "replaced"


@dataclass(frozen=True)
class Compacted:
    version: int  # of the manifest
    folders: int  # replaced
    files: int  # written in their place
    deleted: int  # folders that the run before replaced


def _files(spark: SparkSession, folder: Folder) -> dict[str, tuple[int, int]]:
    """Size and time of each data file."""
    store, target = store_of(spark, folder.path)
    found = (s for s in store.listStatus(target) if s.isFile() and not s.getPath().getName().startswith(("_", ".")))
    return {s.getPath().getName(): (s.getLen(), s.getModificationTime()) for s in found}


def vacuum(spark: SparkSession, path: str) -> int:
    """Delete the folders that are out of use, and the filters of batches that have no
    folder left. Only for tables whose readers of the version before are done."""
    version, dead = out_of_use(spark, path)
    folders = all_folders(spark, path)
    gone = [f for f in folders if f.key in dead]
    for folder in gone:
        remove(spark, folder.path)
    left = {f.batch_id for f in folders if f.key not in dead}
    for batch in {f.batch_id for f in gone} - left:
        remove(spark, f"{path}_visitors/part={batch}")
    if dead:
        write_manifest(spark, path, version + 1, {})
    return len(gone)


def compact(spark: SparkSession, path: str, *, target_bytes: int = TARGET_BYTES, kept_batches: int = KEPT_BATCHES) -> Compacted:
    """Compact the closed batches of the fact table at ``path``. One run at a time; streams
    and readers may go on. Folders of large files are left alone, so a run's work is
    what came since the last one. Only names and sizes of folders pass the driver."""
    deleted = vacuum(spark, path)
    version, _ = out_of_use(spark, path)
    folders = [f for f in all_folders(spark, path) if f.batch_id is not None]
    newest = max((f.batch_id for f in folders), default=-1)
    small: dict[tuple, dict[Folder, dict]] = {}
    for folder in folders:
        if folder.batch_id <= newest - kept_batches:
            files = _files(spark, folder)
            if sum(size for size, _ in files.values()) < len(files) * target_bytes / 2:
                small.setdefault(folder.key[:2], {})[folder] = files
    small = {key: held for key, held in small.items() if sum(map(len, held.values())) > 1}
    if not small:
        return Compacted(version, 0, 0, deleted)

    batch = -(version + 1)  # no stream has it, and no run before
    new = {key: "/".join([*next(iter(held)).path.rsplit("/", 1)[:1], f"batch_id={batch}"]) for key, held in small.items()}
    pending = {(*key, batch): PENDING for key in small}
    write_manifest(spark, path, version + 1, pending)
    shares, first = [], 0  # each file of the result is a partition of its own
    for key, held in small.items():
        parts = max(1, -(-sum(size for files in held.values() for size, _ in files.values()) // target_bytes))
        shares.append((*key, first, parts))
        first += parts
    parts = spark.createDataFrame(shares, "of_site string, of_day date, first int, parts int")
    rows = read_folders(spark, path, [f for held in small.values() for f in held])
    same = F.col("site_id").eqNullSafe(F.col("of_site")) & F.col("event_date").eqNullSafe(F.col("of_day"))
    names = [c for c in rows.columns if c not in FOLDER]
    file = (F.col("first") + F.pmod(F.xxhash64(*names[:1], "created_at"), "parts")).cast("int").alias("_file")
    new_rows = rows.join(parts, same).select(*names, "site_id", "event_date", F.lit(batch).cast("long").alias("batch_id"), file)
    whole = new_rows.repartitionById(first, F.col("_file"))
    order = [c for c in ("visitor_id", "created_at") if c in names]
    if "visitor_id" in names and exists(spark, f"{path}_visitors"):
        write_filters(new_rows, path, batch)
    (
        whole.sortWithinPartitions(*order).drop("_file")
        .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*FOLDER).parquet(path)
    )

    done = {key: held for key, held in small.items() if all(exists(spark, f.path) and _files(spark, f) == files for f, files in held.items())}
    if done:
        old = read_folders(spark, path, [f for held in done.values() for f in held]).count()
        copied = read_folders(spark, path, [Folder(new[key], *key, batch) for key in done]).count()
        if old != copied:
            raise RuntimeError(f"{copied} of {old} rows of {path} were copied; nothing was replaced")
    dead = {f.key: REPLACED for held in done.values() for f in held}
    dead |= {(*key, batch): PENDING for key in small.keys() - done.keys()}
    write_manifest(spark, path, version + 2, dead)
    files = sum(len(_files(spark, Folder(new[key], *key, batch))) for key in done)
    return Compacted(version + 2, sum(map(len, done.values())), files, deleted)
