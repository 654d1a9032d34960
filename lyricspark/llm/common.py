"""Shared plumbing of the corpus operators: the shared folder, kept tables, id filters."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_OWN: dict[str, str] = {}

#: Words as the operators see them.
WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir where it is set.

    A temporary folder takes its place only where the setting is missing and all runs on this machine, as
    in local tests; on a cluster a missing setting is an error.
    """
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        _OWN[app] = "file://" + tempfile.mkdtemp(prefix="lyricspark-")
    return _OWN[app]


def keep(df: DataFrame, name: str) -> DataFrame:
    """Writes df to the shared folder and reads it back: lineage ends here, and lost executors cost nothing."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/lyricspark/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._kept_path = path
    return out


def again(df: DataFrame) -> DataFrame:
    """A table made by keep(), read once more: for the two sides of a cogroup."""
    return df.sparkSession.read.schema(df.schema).parquet(df._kept_path)


def drop_kept(df: DataFrame) -> None:
    """Deletes the files behind a table made by keep(); for steps of a loop that nothing reads any more."""
    spark, path = df.sparkSession, getattr(df, "_kept_path", None)
    if path:
        target = spark._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Arrow batches that stay small with long texts; a smaller setting of the session is left alone."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key, "10000")) > rows:
        spark.conf.set(key, str(rows))


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def text_of(col: str = "text"):
    return F.coalesce(F.col(col), F.lit(""))


class IdFilter:
    """A bitmap over hashed ids, of fixed size: lets through every id put in, and some others."""

    BITS = 1 << 25

    def __init__(self, bitmap) -> None:
        self.bitmap = bitmap

    @staticmethod
    def place(ids: np.ndarray) -> np.ndarray:
        h = ids.astype(np.int64).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return (h >> np.uint64(64 - 25)).astype(np.int64)

    def may_hold(self, ids: pa.Array) -> np.ndarray:
        at = self.place(ids.fill_null(0).to_numpy(zero_copy_only=False))
        return (np.frombuffer(self.bitmap.value, dtype=np.uint8)[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)


def id_filter(ids: DataFrame, column: str) -> IdFilter:
    """A filter for the ids of a column, to leave rows out before they are shuffled; a join must follow.

    Each task sends the words of its bitmap that hold a bit; 4 MB at most reach the driver and the
    executors, whatever the number of ids.
    """
    schema = pa.schema([("at", pa.int64()), ("bits", pa.int64())])

    def marked(batches):
        bitmap = np.zeros(IdFilter.BITS // 8, dtype=np.uint8)
        for batch in batches:
            at = IdFilter.place(batch.column(0).drop_null().to_numpy(zero_copy_only=False))
            np.bitwise_or.at(bitmap, at >> 3, np.left_shift(1, at & 7).astype(np.uint8))
        words = bitmap.view("<i8")
        used = np.flatnonzero(words)
        yield pa.record_batch([pa.array(used), pa.array(words[used])], schema=schema)

    words = ids.select(F.col(column).cast("long")).mapInArrow(marked, "at long, bits long").groupBy("at").agg(F.bit_or("bits").alias("bits")).toPandas()
    bitmap = np.zeros(IdFilter.BITS // 64, dtype="<i8")
    bitmap[words["at"].to_numpy(np.int64)] = words["bits"].to_numpy(np.int64)
    return IdFilter(ids.sparkSession.sparkContext.broadcast(bitmap.tobytes()))
