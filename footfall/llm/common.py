"""What the operators share: written tables and Arrow batches of texts."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from footfall.session import shared_dir

# Rows in an Arrow batch: bounds a Python worker's memory when texts are long.
BATCH_ROWS = 512
KEY_BITS = 26  # 8 MB
_BUCKET = 1 << 15  # bits in one of Spark's bitmap buckets


def prepared(spark: SparkSession) -> SparkSession:
    """Settings that the operators with Arrow steps rely on."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return spark


def written_to(df: DataFrame, path: str) -> DataFrame:
    """Write and read back: cuts the lineage, survives lost executors."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def written(df: DataFrame, name: str) -> DataFrame:
    """The same in a fresh folder of the shared folder, where it stays for the result
    that reads it."""
    return written_to(df, shared_dir(df.sparkSession, name))


def payloads(column: pa.Array) -> Iterator[bytes]:
    """UTF-8 bytes of a text column, one row at a time; empty for null."""
    for value in column.cast(pa.binary()):
        yield value.as_py() or b""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _place(key: Column) -> Column:
    return F.shiftrightunsigned(F.xxhash64(key), 64 - KEY_BITS)


def may_be_in(keys: DataFrame, column: str) -> Callable[[Column], Column]:
    """A test for values of ``column``: where it is false, ``keys`` doesn't hold the value.
    A bitmap of one size for any number of keys; the more keys, the more it lets pass."""
    number = _place(F.col(column)) + 1
    parts = keys.groupBy(F.bitmap_bucket_number(number).alias("bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position(number)).alias("bits")
    )
    bits = np.zeros((1 << KEY_BITS) // 8, dtype=np.uint8)
    for row in parts.collect():  # at most 2,048 rows of 4 kB
        start = (row.bucket - 1) * _BUCKET // 8
        bits[start : start + _BUCKET // 8] = np.frombuffer(row.bits, dtype=np.uint8)
    shared = keys.sparkSession.sparkContext.broadcast(bits.tobytes())

    @F.pandas_udf("boolean")
    def is_set(places: pd.Series) -> pd.Series:
        at = places.to_numpy()
        return pd.Series((np.frombuffer(shared.value, np.uint8)[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1)

    return lambda key: is_set(_place(key))
