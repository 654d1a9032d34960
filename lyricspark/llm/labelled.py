"""Bounded samples of labelled texts that the classifiers learn from."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fold_of(doc_id: Column, folds: int) -> Column:
    """crc32 of the decimal doc_id, modulo the number of folds."""
    return F.crc32(doc_id.cast("string").cast("binary")) % folds


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, folds: int, held_out: int, each: int, longest: int) -> pd.DataFrame:
    """(doc_id, text, y): up to `each` labelled texts of either class, in hash order, none of the held-out fold.

    Texts of more than `longest` characters are not learned from, so that the sample's size is bounded
    by 2 * each * longest characters. Rows without doc_id or label are left out; equal texts count once,
    and not at all where their labels differ.
    """
    usable = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("y")).filter("doc_id is not null and y is not null")
    usable = usable.groupBy("doc_id").agg(F.max("y").alias("y")).filter(fold_of(F.col("doc_id"), folds) != held_out)
    picked = None
    for y in (0, 1):
        some = usable.filter(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(each)
        picked = some if picked is None else picked.union(some)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").filter(F.char_length("text") <= longest)
    # at most 2 * each rows of two numbers are broadcast
    found = texts.join(F.broadcast(picked), "doc_id").groupBy("text").agg(F.min("doc_id").alias("doc_id"), F.min("y").alias("y"), F.max("y").alias("most")).filter("y = most")
    return found.select("doc_id", "text", "y").toPandas().sort_values(["doc_id", "text"], ignore_index=True)
