"""Exact global ranks without a single-partition window."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Hex digits of a key that name its range: 65,536 ranges.
DIGITS = 4


def hash_order(id_col: str | Column, seed: int = 42) -> Column:
    """A random order that depends on the id and the seed alone: the md5 of both, in hex."""
    return F.md5(F.concat_ws("_", F.lit(str(seed)), (F.col(id_col) if isinstance(id_col, str) else id_col).cast("string")))


def global_rank(df: DataFrame, key: Column, ties: Sequence[str], name: str = "rank") -> DataFrame:
    """df with a dense position from 1, ordered by key, a hash in hex, then by the tie columns.

    A row's range is the start of its key, whatever its partition and its other columns. Rows are
    numbered within their range; the ranges' bases are prefix sums over one count for each of them.
    """
    ranged = df.withColumn("_key", key).withColumn("_range", F.substring("_key", 1, DIGITS))
    local = ranged.withColumn("_local", F.row_number().over(Window.partitionBy("_range").orderBy("_key", *ties)))
    counts = df.select(F.substring(key, 1, DIGITS).alias("_range")).groupBy("_range").agg(F.count("*").alias("_n"))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    # 16 ** DIGITS rows of two numbers at most are broadcast
    return local.join(F.broadcast(bases), "_range").withColumn(name, F.col("_base") + F.col("_local")).drop("_key", "_range", "_local", "_base")
