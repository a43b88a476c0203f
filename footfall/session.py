"""Session helpers: UTC sessions and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

_local_scratch: dict[str, str] = {}


# Settings every job relies on or gains from. The JVM does not compile methods
# beyond 8,000 bytes of bytecode, so larger generated ones would be interpreted.
SQL_SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.codegen.hugeMethodLimit": "8000",
    # of a name given twice in a JSON object the last counts, as in JavaScript
    "spark.sql.variant.allowDuplicateKeys": "true",
    # state of streams on the executors' disks, hash-partitioned; a batch stores what it changed.
    # An executor has a store for each of its partitions, and without a bound common to them
    # they hold as much memory as there is state: so one cache for all, and what a batch
    # wrote leaves memory with its end (a changelog would keep it there)
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "false",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "256",
    "spark.sql.streaming.stateStore.rocksdb.trackTotalNumberOfRows": "false",  # a look-up more for each key
}


def apply_settings(spark: SparkSession) -> None:
    """Set them on a session that was built elsewhere."""
    for key, value in SQL_SETTINGS.items():
        spark.conf.set(key, value)


def build_session(app: str = "footfall", master: str | None = None, **conf: str) -> SparkSession:
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.sources.partitionOverwriteMode", "dynamic")
    )
    for key, value in SQL_SETTINGS.items():
        builder = builder.config(key, value)
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession, purpose: str) -> str:
    """A fresh folder below the shared folder named by ``spark.checkpoint.dir``.

    Only a local-mode session without that setting falls back to a temporary
    folder: on a cluster the executors would not see the driver's disk.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        app = spark.sparkContext.applicationId
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        base = _local_scratch.setdefault(app, tempfile.mkdtemp(prefix="footfall-"))
    return f"{base.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"
