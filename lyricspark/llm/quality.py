"""Quality of texts by a byte-level convolutional network in numpy.

Learned filters over a few neighbouring bytes run over overlapping chunks that cover the whole text;
their largest responses, over positions and chunks, are combined into one probability. The filters and
all weights are learned; their number, their width and the chunk size are fixed.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches
from .labelled import fold_of, labelled_sample

#: Bytes of a chunk: a chunk's responses stay in the processor's cache.
CHUNK = 8192


@dataclass
class ByteNet:
    """taps: [width, 256, filters] filter weights by byte; bias: of filters; out: weights of the pooled responses; shift: of the logit."""

    taps: np.ndarray
    bias: np.ndarray
    out: np.ndarray
    shift: float

    @classmethod
    def new(cls, width: int = 6, filters: int = 12, seed: int = 3) -> ByteNet:
        rng = np.random.default_rng(seed)
        sign = np.where(np.arange(filters) % 3, -1.0, 1.0)
        return cls(rng.normal(0, 0.15, (width, 256, filters)).astype(np.float32), np.zeros(filters, np.float32), (sign * 0.5).astype(np.float32), 0.5)

    def pairs(self) -> np.ndarray:
        """The filters by two bytes at a time, for half as many look-ups."""
        w, _, f = self.taps.shape
        return (self.taps[0::2, :, None, :] + self.taps[1::2, None, :, :]).transpose(0, 2, 1, 3).reshape(w // 2, 65536, f)

    def responses(self, data: np.ndarray, pairs: np.ndarray) -> np.ndarray:
        width = len(self.taps)
        two = data[:-1].astype(np.uint16) | (data[1:].astype(np.uint16) << 8)
        n = len(data) - width + 1
        r = pairs[0][two[:n]]
        for j in range(1, width // 2):
            r += pairs[j][two[2 * j : 2 * j + n]]
        return r

    def pooled(self, data: np.ndarray, pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The largest responses, rectified, and where they stand (-1: nowhere)."""
        width, f = len(self.taps), self.taps.shape[2]
        best, at = np.zeros(f, np.float32), np.full(f, -1)
        for i in range(0, len(data) - width + 1, CHUNK):
            r = self.responses(data[i : i + CHUNK + width - 1], pairs)
            top = r.argmax(0)
            value = r[top, np.arange(f)] + self.bias
            more = value > best
            best[more], at[more] = value[more], top[more] + i
        return best, at

    def score(self, data: np.ndarray, pairs: np.ndarray) -> float:
        z = float(self.pooled(data, pairs)[0] @ self.out) + self.shift
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def train(texts: list[bytes], y: np.ndarray, epochs: int = 8, rate: float = 0.01, seed: int = 3) -> ByteNet:
    """Adam on the logistic loss, in mini-batches; both classes weigh the same."""
    net, rng = ByteNet.new(seed=seed), np.random.default_rng(seed)
    data = [np.frombuffer(t, dtype=np.uint8) for t in texts]
    params = [net.taps, net.bias, net.out]
    m, v = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    weight = np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum())) * len(y)
    width, filters = len(net.taps), net.taps.shape[2]
    shift_m = shift_v = step = 0.0
    for _ in range(epochs):
        order = rng.permutation(len(data))
        for b in range(0, len(order), 32):
            pairs, grads, shift_g = net.pairs(), [np.zeros_like(p) for p in params], 0.0
            for i in order[b : b + 32]:
                h, at = net.pooled(data[i], pairs)
                z = float(h @ net.out) + net.shift
                g = float((1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[i]) * weight[i]) / 32
                grads[2] += g * h
                shift_g += g
                for f in np.flatnonzero(at >= 0):
                    grads[1][f] += g * net.out[f]
                    grads[0][np.arange(width), data[i][at[f] : at[f] + width], f] += g * net.out[f]
            step += 1
            for p, q, a, c in zip(params, grads, m, v):
                a += 0.1 * (q - a)
                c += 0.001 * (q * q - c)
                p -= rate * (a / (1 - 0.9**step)) / (np.sqrt(c / (1 - 0.999**step)) + 1e-8)
            shift_m += 0.1 * (shift_g - shift_m)
            shift_v += 0.001 * (shift_g**2 - shift_v)
            net.shift -= rate * (shift_m / (1 - 0.9**step)) / (np.sqrt(shift_v / (1 - 0.999**step)) + 1e-8)
    return net


def fit_quality(docs: DataFrame, labels: DataFrame, folds: int = 5, held_out: int = 0, each: int = 800, longest: int = 20_000) -> ByteNet:
    """A network learned from up to `each` labelled texts of either class, without the held-out fold.

    Without a text of both classes the network stays untrained.
    """
    sample = labelled_sample(docs, labels, "quality", folds, held_out, each, longest)
    if sample["y"].nunique() < 2:
        return ByteNet.new()
    return train([t.encode() for t in sample["text"]], sample["y"].to_numpy())


def score_quality(docs: DataFrame, net: ByteNet, folds: int = 5, held_out: int = 0, threshold: float = 0.3) -> DataFrame:
    """docs with held_out, score (0 to 1, higher: label 1 likelier) and predicted, for every row.

    Whole texts are scored; null texts count as empty, and texts shorter than a filter have no
    responses. A null doc_id is not held out. Columns of docs named like the new ones are replaced; all
    others stay; equal rows get equal scores; an empty table gives an empty result.
    """
    small_batches(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(net)

    @F.pandas_udf("double")
    def score(texts):
        model = held.value
        pairs = model.pairs()
        out = np.empty(len(texts))
        column = pa.array(texts, pa.large_string())
        for i, t in enumerate(pc.fill_null(column, "").cast(pa.large_binary()).to_pylist()):
            out[i] = model.score(np.frombuffer(t, dtype=np.uint8), pairs)
        return type(texts)(out)

    out = docs.drop("held_out", "score", "predicted").withColumn("score", score(F.col("text")))
    fold = F.coalesce(fold_of(F.col("doc_id"), folds) == held_out, F.lit(False))
    return out.withColumn("held_out", fold).withColumn("predicted", (F.col("score") >= threshold).cast("int"))
