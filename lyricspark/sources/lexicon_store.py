"""Lexicons as folders of buckets: an override rewrites the buckets of its words alone."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def _placed(lexicon: DataFrame, buckets: int) -> DataFrame:
    return lexicon.withColumn("buckets", F.lit(buckets)).withColumn("bucket", F.pmod(F.xxhash64(F.lower("word")), F.lit(buckets)).cast("int"))


def save_buckets(lexicon: DataFrame, path: str, buckets: int = 64) -> None:
    """A lexicon(word, ...) in so many buckets by the hash of the lower-cased word, sorted within; replaces what is there."""
    rows = _placed(lexicon, buckets).repartition(buckets, "bucket").sortWithinPartitions("bucket", "word")
    rows.write.mode("overwrite").partitionBy("buckets", "bucket").parquet(path)


def load_buckets(spark: SparkSession, path: str) -> DataFrame:
    """The rows of save_buckets. A filter on `bucket`, which `bucket_of` gives for a word, reads that bucket alone."""
    return spark.read.parquet(path)


def bucket_of(word, buckets):
    return F.pmod(F.xxhash64(F.lower(word)), buckets).cast("int")


def override_words(spark: SparkSession, path: str, new: DataFrame, several: bool = False) -> list[int]:
    """Entries of `new` replace or join those of the same word, in any case; the buckets that were rewritten.

    Of several new entries for a word the last by all columns counts, or with `several` they all stay, as
    those of a saved lexicon do that holds a word in more than one case. Old rows stay in the tasks that
    read them, and nothing of them is shuffled; other buckets aren't read or touched. An override of
    no words does nothing.
    """
    old = load_buckets(spark, path)
    # one number a store
    buckets = old.select("buckets").first()["buckets"]
    columns = [c for c in old.columns if c not in ("buckets", "bucket")]
    last = Window.partitionBy(F.lower("word")).orderBy(*(F.desc(c) for c in columns))
    fresh = new.select(*columns)
    if not several:
        fresh = fresh.withColumn("_n", F.row_number().over(last)).filter("_n = 1").drop("_n")
    fresh = _placed(fresh, buckets)
    # as many numbers as there are buckets
    touched = sorted(r.bucket for r in fresh.select("bucket").distinct().collect())
    if not touched:
        return []
    stay = old.filter(F.col("bucket").isin(touched)).join(fresh.select(F.lower("word").alias("_w")), F.lower("word") == F.col("_w"), "left_anti")
    # each bucket gets the sorted rows that stay and the sorted new ones
    rows = stay.select(*columns, "buckets", "bucket").unionByName(fresh).sortWithinPartitions("bucket", "word")
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("buckets", "bucket").parquet(path)
    return touched
