"""Helpers shared by the training-data operators."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows an Arrow batch may hold, so that a batch of long texts stays small.
BATCH_ROWS = 500
BATCH_BYTES = 16 << 20


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share. Where none is named, one of our own, but only if driver and executors are one process."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="tallyforge-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def settle(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    schema = df.schema
    df.write.parquet(path)
    return spark.read.schema(schema).parquet(path)


def small_batches(spark: SparkSession) -> None:
    """Bound an Arrow batch's rows and bytes. A session setting, since plans read it when they run; it lowers what is set, never raises it."""
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)):
        now = spark.conf.get(key, None)
        if now is None or not now.isdigit() or not 0 < int(now) <= most:
            spark.conf.set(key, str(most))


#: A key is hot if it holds one row of so many; there are no more hot keys than that.
HOT_SHARE = 1000


def join_uneven(rows: DataFrame, side: DataFrame, key: str, weight: str, total: int) -> DataFrame:
    """``rows`` joined with ``side``, a table with one row a key whose ``weight`` is at least the number of the key's rows.

    Hot keys hold a thousandth of ``total`` rows or more each, so they are few: they are broadcast, and their rows stay
    where they are. The others are joined by a shuffle, in which no key stands out.
    """
    is_hot = F.col(weight) * HOT_SHARE >= total
    hot = F.broadcast(side.where(is_hot))
    rest = rows.join(hot.select(key), key, "left_anti").join(side.where(~is_hot).hint("merge"), key)
    return rows.join(hot, key).unionByName(rest)


def text_of(name: str = "text") -> Column:
    """The text, with null as the empty text."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
