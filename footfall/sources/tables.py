"""Tables on files: readers by declared schema, and idempotent writers.

Facts are parquet partitioned by site and day, the rollup by day. Updates and
deletes rewrite whole partitions: rows with the old and the new partition set
are written in one job, and readers see the change when the job commits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from footfall.schemas import TABLES


def read_table(
    spark: SparkSession, path: str, schema: StructType | str, fmt: str = "parquet", **options: str
) -> DataFrame:
    """Parquet, ORC, CSV or JSON files with a declared schema, never inferred.
    Columns added later read as NULL in older files."""
    wanted = TABLES[schema] if isinstance(schema, str) else schema
    if fmt == "json":
        options = {"multiLine": "true", **options}
    elif fmt == "csv":
        options = {"header": "true", **options}
    return spark.read.schema(wanted).options(**options).format(fmt).load(path)


def row_by_id(df: DataFrame, row_id: int, column: str = "id") -> DataFrame:
    return df.filter(F.col(column) == row_id).limit(1)


def with_day(df: DataFrame, ts: str = "created_at") -> DataFrame:
    return df.withColumn("event_date", F.to_date(ts))


def append_facts(df: DataFrame, path: str, *, ts: str = "created_at") -> None:
    """Append rows under site and day folders. Every task writes the rows it has:
    there is no shuffle, so a dominant site is written by many tasks."""
    with_day(df, ts).write.mode("append").partitionBy("site_id", "event_date").parquet(path)


def overwrite_partitions(df: DataFrame, path: str, *by: str) -> None:
    """Replace just the partitions that occur in ``df``."""
    (
        df.write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(*by)
        .parquet(path)
    )


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder of the job's own, in whatever store it is."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def exists(spark: SparkSession, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


def publish(spark: SparkSession, source: str, target: str) -> bool:
    """Make a finished folder appear under another name by one rename; False, and nothing
    done, where that name is taken already."""
    jvm = spark._jvm.org.apache.hadoop.fs
    start, end = jvm.Path(source), jvm.Path(target)
    store = end.getFileSystem(spark._jsc.hadoopConfiguration())
    if store.exists(end):
        return False
    store.mkdirs(end.getParent())
    if not store.rename(start, end):
        raise OSError(f"{source} could not be renamed to {target}")
    return True


def insert_absent(old: DataFrame, new: DataFrame, *keys: str) -> DataFrame:
    """Old rows plus the new rows whose key is not there yet."""
    fresh = new.dropDuplicates(list(keys)).join(old.select(*keys), list(keys), "left_anti")
    return old.unionByName(fresh, allowMissingColumns=True)


def upsert(old: DataFrame, new: DataFrame, *keys: str, order: Column | None = None) -> DataFrame:
    """New rows replace old ones of the same key; ``order`` picks among new rows."""
    latest = new
    if order is not None:
        rank = Window.partitionBy(*keys).orderBy(order)
        latest = (
            new.withColumn("_rank", F.row_number().over(rank))
            .filter(F.col("_rank") <= 1)
            .drop("_rank")
        )
    kept = old.join(latest.select(*keys), list(keys), "left_anti")
    return kept.unionByName(latest, allowMissingColumns=True)
