"""Hard negatives by threshold joins of whole vectors over a partial inverted index, in the manner of L2AP.

Anchors, a bounded block of them at a time, are sent to all tasks; the vectors stay where they are. A
task indexes its vectors batch by batch. A vector's leading dimensions stay out of the index as long as
their norm alone can't lift it to any anchor's threshold; the lists of the others are read from the last
dimension on and partial scores added up, and a pair whose partial score and norms of the unread
dimensions stay below its threshold is dropped. What is left is scored exactly. Thresholds start near
the highest score that norms allow and are lowered until an anchor's windows are full or at their end;
the last score that a full window holds is its threshold in the next batch.

The first join finds each anchor's positives, the second fills one window of scores for each positive.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import keep

#: Anchors that are sent to the tasks at once, and vectors that are indexed at once, at most.
ANCHORS, VECTORS = 1_024, 4_096
#: A task reads so many vectors at least, if there are as many: each task hands on full windows of its own.
TASK = 16_384
#: Dimensions whose lists are read together.
GROUP = 8
#: Each lowering leaves so much of a threshold.
LOWER = 0.7


def _norms(x: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """The norm of each row's dimensions before each cut."""
    squares = np.add.reduceat(x * x, cuts[:-1], axis=1)
    return np.sqrt(np.concatenate([np.zeros((len(x), 1)), np.cumsum(squares, axis=1)], axis=1))


class PartialIndex:
    """Lists of whole vectors by dimension, without the leading dimensions of each that `ratio` covers.

    ratio is the least threshold, divided by its anchor's norm: a shorter prefix can't reach it.
    """

    def __init__(self, x: np.ndarray, ratio: float) -> None:
        self.cuts = np.append(np.arange(0, x.shape[1], GROUP), x.shape[1])
        norms = _norms(x, self.cuts)
        omitted = np.maximum((norms < ratio).sum(1) - 1, 0)
        # vectors with fewer omitted dimensions first: each dimension's list is a leading stretch of them
        self.order = np.argsort(omitted, kind="stable")
        self.x, self.norms, self.omitted = x[self.order], norms[self.order], omitted[self.order]
        self.listed = np.searchsorted(self.omitted, np.arange(len(self.cuts) - 1), side="right")

    def above(self, q: np.ndarray, threshold: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(place in q, place in x, score) of all pairs with a score of the anchor's threshold at least."""
        q_norms, partial, groups = _norms(q, self.cuts), np.zeros((len(q), len(self.x))), len(self.listed)
        for g in range(groups - 1, -1, -1):
            n, at = self.listed[g], slice(self.cuts[g], self.cuts[g + 1])
            partial[:, :n] += q[:, at] @ self.x[:n, at].T
            if g in (groups // 2, groups // 4, 0):
                unread = np.maximum(self.omitted, g)
                bound = partial + q_norms[:, unread] * self.norms[np.arange(len(self.x)), unread]
                # half a point is more than the rounding of norms
                i, j = np.nonzero(bound >= threshold[:, None] - 0.5)
                # the few that are left are cheaper one by one than in further lists
                if not g or 16 * len(i) < partial.size:
                    break
        score = np.empty(len(i))
        for s in range(0, len(i), 1 << 16):
            score[s : s + (1 << 16)] = np.einsum("ij,ij->i", q[i[s : s + (1 << 16)]], self.x[j[s : s + (1 << 16)]])
        reached = score >= threshold[i]
        return i[reached], self.order[j[reached]], score[reached]


class Windows:
    """The k best (score, id) of each anchor within each of its windows of scores, ties to smaller ids."""

    def __init__(self, low: np.ndarray, high: np.ndarray, k: int) -> None:
        #: Bounds by anchor and window; a window that an anchor lacks has low above high.
        self.low, self.high, self.k = low, high, k
        self.least = low.copy()
        self.held = [(np.empty(0, np.int64), np.empty(0), np.empty(0, np.int64)) for _ in range(low.shape[1])]

    def add(self, anchor: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        for w, held in enumerate(self.held):
            fits = (score >= self.least[anchor, w]) & (score <= self.high[anchor, w])
            if fits.any():
                a, s, v = (np.concatenate([h, new[fits]]) for h, new in zip(held, (anchor, score, ids)))
                order = np.lexsort((v, -s, a))
                a, s, v = a[order], s[order], v[order]
                place = np.arange(len(a)) - np.searchsorted(a, a)
                full = place == self.k - 1
                self.least[a[full], w] = s[full]
                self.held[w] = tuple(c[place < self.k] for c in (a, s, v))

    def thresholds(self) -> np.ndarray:
        """The lowest score that an anchor can still use; infinite without windows."""
        return np.where(self.low <= self.high, self.least, np.inf).min(1, initial=np.inf)


def threshold_join(q: np.ndarray, x: np.ndarray, windows: Windows, anchors: np.ndarray, ids: np.ndarray, allowed) -> None:
    """Puts all pairs of anchors q and vectors x into windows, as far as they can matter.

    anchors are the places of q's rows in windows, ids those of x's; allowed(i, j) says which pairs count.
    """
    q_norm, cap = np.sqrt((q * q).sum(1)), float(np.sqrt((x * x).sum(1).max(initial=0)))
    seen, open_ = np.full(len(q), np.inf), np.arange(len(q))
    # what is above all of an anchor's windows is not looked for first
    start = np.minimum(LOWER * q_norm * cap, np.where(windows.low <= windows.high, windows.high, -np.inf)[anchors].max(1, initial=-np.inf))
    while len(open_):
        goal = windows.thresholds()[anchors[open_]]
        lower = np.where(np.isinf(seen[open_]), start[open_], np.where(seen[open_] > 1, LOWER * seen[open_], -np.inf))
        t = np.maximum(goal, lower)
        live = t < seen[open_]
        open_, t = open_[live], t[live]
        if not len(open_):
            break
        norm = q_norm[open_]
        ratio = np.where(t <= 0, 0, t / np.maximum(norm, 1e-9)).min()
        i, j, score = PartialIndex(x, float(ratio)).above(q[open_], t)
        new = (score < seen[open_][i]) & allowed(open_[i], j)
        windows.add(anchors[open_[i[new]]], score[new], ids[j[new]])
        seen[open_] = t
        open_ = open_[windows.thresholds()[anchors[open_]] < t]


def _stacked(frame: pd.DataFrame) -> np.ndarray:
    return np.concatenate(frame["x"].to_numpy()).astype(np.float64).reshape(len(frame), -1)


def _best(rows: DataFrame, anchors: pd.DataFrame, low: np.ndarray, high: np.ndarray, k: int, same: bool) -> DataFrame:
    """(anchor, window, vec_id, score): each task's k best of each window, of rows with the anchor's label or with others."""
    at = {int(d): g for d, g in anchors.groupby("dim").indices.items()}
    block = rows.sparkSession.sparkContext.broadcast((at, {d: _stacked(anchors.iloc[i]) for d, i in at.items()}, anchors["row"].to_numpy(), anchors["label"].to_numpy(), low, high))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, q_of, q_row, q_label, low, high = block.value
        windows = Windows(low, high, k)
        for frame in frames:
            for s in range(0, len(frame), VECTORS):
                some = frame.iloc[s : s + VECTORS]
                for dim, places in some.groupby("dim").indices.items():
                    if int(dim) not in at:
                        continue
                    own, q, part = at[int(dim)], q_of[int(dim)], some.iloc[places]
                    x, row, label, ids = _stacked(part), part["row"].to_numpy(), part["label"].to_numpy(), part["vec_id"].to_numpy()
                    if not same:
                        threshold_join(q, x, windows, own, ids, lambda i, j: q_label[own[i]] != label[j])
                        continue
                    for value in np.intersect1d(label, q_label[own]):
                        a, b = np.flatnonzero(q_label[own] == value), np.flatnonzero(label == value)
                        threshold_join(q[a], x[b], windows, own[a], ids[b], lambda i, j: q_row[own[a[i]]] != row[b[j]])
        for w, (a, score, v) in enumerate(windows.held):
            yield pd.DataFrame({"anchor": q_row[a], "window": np.full(len(a), w), "vec_id": v, "score": score.astype(np.int64)})

    return rows.mapInPandas(run, "anchor long, window int, vec_id long, score long")


def hard_negatives(vectors: DataFrame, every: int = 100, positives: int = 5, negatives: int = 10, scale: int = 256, low: int = 30, high: int = 90) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for vectors(vec_id, embedding, label).

    Components become floor(scale * x); a score is an inner product of these. Anchors are the rows whose
    vec_id is divisible by `every`. An anchor's positives are the other rows of its label with the
    highest scores; a positive's negatives are the rows of other labels with the highest scores from
    low to high percent of the positive's, both included. Ties go to the smaller vec_id.

    Rows without vec_id or label and vectors that are null, empty or hold null or non-finite components
    take no part. An anchor leaves out its own row alone: rows that repeat its vec_id are other rows, and
    each repeated anchor has results of its own. Vectors of different lengths never meet. A positive
    with a negative score has no negatives. Other columns are ignored; an empty table gives an empty result.
    """
    x = F.col("embedding")
    finite = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    able = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & x.isNotNull() & (F.size(x) > 0) & finite
    whole = F.transform(x, lambda c: F.floor(c.cast("double") * scale).cast("double"))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), "embedding").filter(able)
    rows = keep(rows.select("vec_id", "label", whole.alias("x"), F.size(x).alias("dim"), F.monotonically_increasing_id().alias("row")), "vectors")
    asked = keep(rows.filter(F.col("vec_id") % every == 0), "anchors")
    rows = rows.coalesce(max(1, -(-rows.count() // TASK)))
    after, found = -1, None
    order = Window.partitionBy("anchor", "window").orderBy(F.desc("score"), "vec_id")
    ranked = lambda df, k: df.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    while True:
        # ANCHORS rows at most reach the driver, and `positives` rows for each of them
        block = asked.filter(F.col("row") > after).orderBy("row").limit(ANCHORS).toPandas()
        if block.empty and found is not None:
            return found
        after = block["row"].max()
        one = np.full((len(block), 1), np.inf)
        near = ranked(_best(rows, block, -one, one, positives, True), positives).toPandas()
        place = pd.Series(np.arange(len(block)), index=block["row"])
        a, w, p = place.loc[near["anchor"]].to_numpy(np.int64), near["rank"].to_numpy() - 1, near["score"].to_numpy(np.int64)
        floor, ceiling = np.full((len(block), positives), np.inf), np.full((len(block), positives), -np.inf)
        floor[a, w], ceiling[a, w] = -(-low * p // 100), high * p // 100
        far = ranked(_best(rows, block, floor, ceiling, negatives, False), negatives)
        pairs = pd.DataFrame({"anchor": near["anchor"].astype("int64"), "window": w.astype("int32"), "anchor_id": block["vec_id"].to_numpy()[a].astype("int64"), "positive_id": near["vec_id"].astype("int64"), "positive_score": p})
        pairs = rows.sparkSession.createDataFrame(pairs, "anchor long, window int, anchor_id long, positive_id long, positive_score long")
        named = far.join(F.broadcast(pairs), ["anchor", "window"]).select("anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
        named = keep(named, "negatives")
        found = named if found is None else found.unionByName(named)
        if len(block) < ANCHORS:
            return found
