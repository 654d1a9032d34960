"""Exact top-k inner products with elimination by a table of distances to pivots.

The distances of every vector to a set of pivots are worked out beforehand. For a query q and a vector
v, the largest difference of their distances to one pivot bounds |q - v| from below, and so bounds
the inner product (|q|^2 + |v|^2 - |q - v|^2) / 2 from above. The vectors with the highest bounds are
evaluated first, in steps that grow, and a query stops once no bound left can reach its k-th score.
Where a step would take a quarter of the block or more, one product over the block's rows is
cheaper than gathering them; what the bounds rule out is left out of it all the same.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import again, keep

#: Vectors and queries of a block, on average.
VECTORS, QUERIES = 8_192, 1_024
#: Rows of the sample out of which pivots are chosen.
SAMPLE = 2_000


def choose_pivots(sample: np.ndarray, n: int) -> np.ndarray:
    """Vectors far from one another: each next one is the farthest from those chosen."""
    chosen = [int(np.argmax(((sample - sample.mean(0)) ** 2).sum(1)))]
    away = ((sample - sample[chosen[0]]) ** 2).sum(1)
    while len(chosen) < min(n, len(sample)):
        chosen.append(int(np.argmax(away)))
        away = np.minimum(away, ((sample - sample[chosen[-1]]) ** 2).sum(1))
    return sample[chosen]


def block_top(q: np.ndarray, qid: np.ndarray, dq: np.ndarray, v: np.ndarray, vid: np.ndarray, dv: np.ndarray, k: int, step: int = 256) -> Iterator[tuple[int, np.ndarray, np.ndarray, int]]:
    """(place of the query, places of vectors, scores, vectors evaluated): each query's k best vectors of a block.

    qid and vid name rows, of which a query's own is left out. Ties go to the earlier place of a vector.
    """
    nq, nv = (q * q).sum(1), (v * v).sum(1)
    # whole numbers: single precision is exact while no partial sum can pass 2^24
    kind = np.float32 if len(v) and len(q) and nq.max() * nv.max() < 2.0**48 else np.float64
    q, v = q.astype(kind), v.astype(kind)
    table = np.ascontiguousarray(dv.T, dtype=np.float32)
    # distances in single precision are off by a 2^-23rd at most
    slip = 1e-3 + float(max(dv.max(initial=0), dq.max(initial=0))) * 2.0**-20
    half = nv / 2
    for i in range(len(q)):
        away = np.zeros(len(v), dtype=np.float32)
        for p in range(len(table)):
            gap = table[p] - np.float32(dq[i, p])
            np.maximum(away, np.abs(gap, out=gap), out=away)
        np.maximum(away - np.float32(slip), 0, out=away)
        bound = half - away.astype(np.float64) ** 2 / 2 + nq[i] / 2
        bound[vid == qid[i]] = -np.inf
        scores, places = np.empty(0), np.empty(0, np.int64)
        left, seen, take, least = np.flatnonzero(bound > -np.inf), 0, step, -np.inf
        while len(left):
            if 4 * take >= len(v):
                some, left = left, left[:0]
                score = (v @ q[i])[some]
            else:
                if len(left) > take:
                    split = np.argpartition(-bound[left], take)
                    some, left = left[split[:take]], left[split[take:]]
                else:
                    some, left = left, left[:0]
                score = v[some] @ q[i]
            seen += len(some)
            if len(places) + len(some) > k:
                high = score >= max(least, np.partition(score, -k)[-k] if len(score) > k else -np.inf)
                some, score = some[high], score[high]
            scores, places = np.concatenate([scores, score]), np.concatenate([places, some])
            first = np.lexsort((places, -scores))[:k]
            scores, places = scores[first], places[first]
            if len(scores) >= k:
                least = scores[-1]
                left = left[bound[left] >= least - 0.5]
            take *= 4
        yield i, places, scores, seen


def top_inner_products(vectors: DataFrame, every: int = 20, k: int = 20, scale: int = 64, pivots: int = 32) -> DataFrame:
    """(query_id, rank, vec_id, score): the k highest scores of each query among all other vectors.

    Components become floor(scale * x) as whole numbers; the score is their inner product. Queries are
    the rows whose vec_id is divisible by `every`; ties go to the smaller vec_id. Queries meet vectors
    in blocks of both; each pair of blocks yields k rows a query at most, which are then merged.

    Vectors that are null, empty, or hold null or non-finite components take no part, nor do rows
    without vec_id. A query leaves out its own row alone: rows that repeat its vec_id are candidates,
    and each query row has a result of its own. Vectors of different lengths never meet. Other columns
    are ignored; an empty table gives an empty result.
    """
    spark = vectors.sparkSession
    x = F.col("embedding")
    finite = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    whole = F.transform(x, lambda c: F.floor(c.cast("double") * scale).cast("double"))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").filter(F.col("vec_id").isNotNull() & x.isNotNull() & (F.size(x) > 0) & finite)
    rows = keep(rows.select("vec_id", whole.alias("x"), F.size(x).alias("dim"), F.monotonically_increasing_id().alias("row")), "vectors")
    counts = rows.agg(F.count("*"), F.count_if(F.col("vec_id") % every == 0)).first()
    found = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).select("dim", "x").toPandas()
    chosen = {int(d): choose_pivots(np.array(g["x"].tolist(), dtype=np.float64), pivots) for d, g in found.groupby("dim")}
    table = spark.sparkContext.broadcast(chosen)
    stacked = lambda f, c: np.concatenate(f[c].to_numpy()).astype(np.float64).reshape(len(f), -1)

    def with_distances(frames):
        for frame in frames:
            out = np.empty(len(frame), dtype=object)
            for d, at in frame.groupby("dim").indices.items():
                a = stacked(frame.iloc[at], "x")
                p = table.value.get(int(d), np.zeros((1, int(d))))
                # squares of whole numbers: exact, up to 2^53
                away = np.sqrt(np.maximum((a * a).sum(1)[:, None] - 2 * (a @ p.T) + (p * p).sum(1), 0))
                for i, j in enumerate(at):
                    out[j] = away[i]
            yield frame.assign(away=out)

    measured = keep(rows.mapInPandas(with_distances, "vec_id long, x array<double>, dim int, row long, away array<double>"), "distances")
    n_vectors, n_queries = max(1, -(-counts[0] // VECTORS)), max(1, -(-counts[1] // QUERIES))
    cand = measured.withColumn("vb", F.pmod(F.xxhash64("row"), F.lit(n_vectors))).withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(n_queries - 1))))
    asked = again(measured).filter(F.col("vec_id") % every == 0).withColumn("qb", F.pmod(F.xxhash64("row"), F.lit(n_queries)).cast("int")).withColumn("vb", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_vectors - 1).cast("long"))))

    def meet(queries: pd.DataFrame, block: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(queries) and len(block):
            block = block.sort_values("vec_id", kind="stable", ignore_index=True)
            ids, asked_ids, asked_rows = (f[c].to_numpy() for f, c in ((block, "vec_id"), (queries, "vec_id"), (queries, "row")))
            for i, places, scores, _ in block_top(stacked(queries, "x"), asked_rows, stacked(queries, "away"), stacked(block, "x"), block["row"].to_numpy(), stacked(block, "away"), k):
                out.append((np.full(len(places), asked_rows[i]), np.full(len(places), asked_ids[i]), ids[places], scores.astype(np.int64)))
        columns = [np.concatenate(c) for c in zip(*out)] if out else [np.empty(0, np.int64)] * 4
        return pd.DataFrame(dict(zip(("row", "query_id", "vec_id", "score"), columns)))

    keys = ["dim", "qb", "vb"]
    near = asked.groupBy(*keys).cogroup(cand.groupBy(*keys)).applyInPandas(meet, "row long, query_id long, vec_id long, score long")
    order = Window.partitionBy("row").orderBy(F.desc("score"), "vec_id")
    return near.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
