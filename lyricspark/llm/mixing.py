"""Mixing sources to target weights by cube-method balanced sampling.

Each source's target is turned into a rate of copies for its documents. Whole copies are taken
outright; the fractional rest is an inclusion probability. The flight phase moves probabilities of
three documents at a time along the null space of two constraints, the document and the word total,
until one of them is 0 or 1. Large sources are flown in blocks; what the blocks leave open, two
documents each at most, is flown together until one block is left, whose landing settles the rest.
"""

from __future__ import annotations

import random
import zlib
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, keep, text_of

#: Documents in a block of the flight phase, on average.
BLOCK = 5_000
_EPS = 1e-9


def flight(p: list[float], size: Sequence[int], rng: random.Random) -> list[int]:
    """Moves p in place until two positions at most are neither 0 nor 1; returns these."""
    open_: list[int] = []
    waiting = [i for i in range(len(p)) if _EPS < p[i] < 1 - _EPS]
    for i in range(len(p)):
        if p[i] <= _EPS or p[i] >= 1 - _EPS:
            p[i] = float(round(p[i]))
    for i in waiting:
        open_.append(i)
        while len(open_) == 3:
            a, b, c = open_
            u = (size[c] - size[b], size[a] - size[c], size[b] - size[a])
            if not any(u):
                u = (1, -1, 0)
            up = min((1 - p[k]) / x if x > 0 else p[k] / -x for k, x in zip(open_, u) if x)
            down = min(p[k] / x if x > 0 else (1 - p[k]) / -x for k, x in zip(open_, u) if x)
            step = up if rng.random() * (up + down) < down else -down
            for k, x in zip((a, b, c), u):
                p[k] += step * x
                if p[k] <= _EPS:
                    p[k] = 0.0
                elif p[k] >= 1 - _EPS:
                    p[k] = 1.0
            open_ = [k for k in open_ if 0 < p[k] < 1]
    return open_


def landing(p: list[float], size: Sequence[int], left: list[int], reach: int = 10) -> None:
    """Settles the last documents: among them and `reach` settled ones, the choice that moves the totals least."""
    some = left + [i for i in range(len(p) - 1, -1, -1) if i not in left][:reach]
    if not some:
        return
    now, sizes = np.array([p[i] for i in some]), np.array([size[i] for i in some], dtype=np.float64)
    choice = (np.arange(1 << len(some))[:, None] >> np.arange(len(some)) & 1) - now
    off = np.abs(choice @ sizes) + 0.05 * sizes.mean() * np.abs(choice.sum(1)) + 1e-6 * np.abs(choice).sum(1)
    for i, x in zip(some, (choice[int(np.argmin(off))] + now).tolist()):
        p[i] = float(round(x))


def source_targets(sized: DataFrame, weights: Sequence[int] = (3, 1, 2), share: float = 1.5, most: int = 2) -> DataFrame:
    """(source, source_size, n_docs, target) from rows of (source, size).

    Sources by code point, null last, have the given weights in turn. The targets share `share` of all
    words by weight; a target stops at `most` times its source's words, and what is beyond goes to the
    others by weight, until none is above.
    """
    totals = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs"))
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    cycle = F.array(*(F.lit(int(w)) for w in weights))
    ranked = totals.withColumn("weight", F.element_at(cycle, (rank % len(weights) + 1).cast("int"))).withColumn("cap", F.col("source_size") * most)
    by_room = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    below = by_room.rowsBetween(Window.unboundedPreceding, -1)
    above = by_room.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy()
    filled = (
        ranked.withColumn("goal", F.sum("source_size").over(everything) * F.lit(float(share)))
        .withColumn("full", F.col("cap") / F.col("weight") * F.sum("weight").over(above) + F.coalesce(F.sum("cap").over(below), F.lit(0)) <= F.col("goal"))
        .withColumn("taken_by_full", F.coalesce(F.sum(F.when(F.col("full"), F.col("cap"))).over(everything), F.lit(0)))
        .withColumn("open_weight", F.sum(F.when(~F.col("full"), F.col("weight"))).over(everything))
    )
    target = F.when(F.col("full"), F.col("cap").cast("double")).otherwise((F.col("goal") - F.col("taken_by_full")) * F.col("weight") / F.col("open_weight"))
    return filled.select("source", "source_size", "n_docs", target.alias("target"))


def _flown(seed: int):
    """The flight of one block of a source, and its landing where it is the last."""

    def fly(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        # rows that tie in all of these differ in their key alone, and are interchangeable
        frame = frame.sort_values(["no_id", "id", "size", "tie", "key"], kind="stable")
        p, sizes = frame["p"].tolist(), frame["size"].tolist()
        left = flight(p, sizes, random.Random(zlib.crc32(f"{seed}:{key[0]}:{key[1]}".encode())))
        if frame["blocks"].iloc[0] <= 1:
            landing(p, sizes, left)
        return frame.drop(columns="block").assign(p=p)

    return fly


def mix_sources(docs: DataFrame, weights: Sequence[int] = (3, 1, 2), share: float = 1.5, most: int = 2, seed: int = 7, carry: Sequence[str] = ()) -> DataFrame:
    """(doc_id, size, source_size, target, copies, taken) for each row of docs(doc_id, text, source).

    size counts a text's words (null: 0; very long ones whole), taken is size times copies, and copies
    is 0 to `most`. The draw depends on the rows and the seed alone, so reruns agree. Null sources are a
    source of their own, the last; a source without words has target 0 and no copies; a null doc_id
    stays null; repeated rows are drawn each on its own; columns named in carry are passed through,
    others are left out; an empty table gives an empty result.

    Numbers alone go through Python, by a row key that is written with the rows; ids and carried columns
    are joined back by it. The targets are windows over one row for each source, in one task.
    """
    size = F.regexp_count(text_of(), F.lit(WORD)).cast("long")
    name = F.col("source").cast("string")
    sized = docs.select("doc_id", name.alias("source"), size.alias("size"), F.xxhash64("text", *carry).alias("tie"), F.monotonically_increasing_id().alias("key"), *(F.col(c).alias(f"carried_{i}") for i, c in enumerate(carry)))
    sized = keep(sized, "sized")
    targets = keep(source_targets(sized.select("source", "size"), weights, share, most), "targets")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    # a source in the group key is a number: nulls and any text fit
    numbered = keep(targets.withColumn("no", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))).withColumn("rate", rate), "numbered")
    rows = (
        sized.alias("s").join(numbered.alias("t"), F.col("s.source").eqNullSafe(F.col("t.source")))
        .select("key", "no", F.col("doc_id").isNull().alias("no_id"), F.xxhash64("doc_id").alias("id"), "size", "tie", F.floor("rate").alias("whole"), (F.col("rate") - F.floor("rate")).alias("p"), F.ceil(F.col("n_docs") / BLOCK).cast("long").alias("blocks"))
    )
    waiting, schema = rows, rows.schema
    settled: list[DataFrame] = []
    level = 0
    while True:
        last = not waiting.filter("blocks > 1").limit(1).count()
        block = F.pmod(F.xxhash64("id", "size", F.lit(seed + level)), F.greatest("blocks", F.lit(1)))
        flown = keep(waiting.withColumn("block", block).groupBy("no", "block").applyInPandas(_flown(seed + level), schema), "flown")
        settled.append(flown.filter("p = 0 or p = 1").select("key", "no", (F.col("whole") + F.col("p")).cast("long").alias("copies")))
        if last:
            break
        waiting = flown.filter("p > 0 and p < 1").withColumn("blocks", F.ceil(F.col("blocks") * 2 / BLOCK).cast("long"))
        level += 1
    drawn = settled[0]
    for s in settled[1:]:
        drawn = drawn.union(s)
    out = sized.join(drawn, "key").join(numbered.select("no", "source_size", "target"), "no")
    return out.select("doc_id", "size", "source_size", "target", "copies", (F.col("size") * F.col("copies")).alias("taken"), *(F.col(f"carried_{i}").alias(c) for i, c in enumerate(carry)))
