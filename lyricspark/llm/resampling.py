"""Importance resampling towards a target by hashed word features, with their CRCs in matrices.

A batch's texts become one byte array, in which words are found at once. Distinct features go into
one matrix of bytes for each length, a row each; the CRCs of all rows advance column by column, and
their buckets are scattered back to where the features stand. Long features are cut into rows of one
width, whose CRCs are then joined: that of a row, shifted by a row's width, and the next one's.

Two passes over the texts: one counts buckets, a bounded table for each task, and one adds up gains.
Only numbers are shuffled after that.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import drop_kept, keep

#: Bytes of text that are worked on at once, unless one text is longer.
SLICE = 1 << 22
#: Columns of a matrix at most.
WIDTH = 256
_POLY = 0xEDB88320


def _table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, (t >> 1) ^ np.uint32(_POLY), t >> 1)
    return t


_STEP = _table()
_WORD = np.zeros(256, dtype=bool)
_WORD[48:58] = _WORD[97:123] = _WORD[128:] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] = _LOWER[97:123]
_SHIFT: dict[int, np.ndarray] = {}


def _columns(crc: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """The CRC registers of all rows of a matrix of bytes, column by column."""
    for column in np.ascontiguousarray(rows.T):
        crc = _STEP[(crc ^ column) & np.uint32(0xFF)] ^ (crc >> np.uint32(8))
    return crc


def _shifted(crc: np.ndarray) -> np.ndarray:
    """Registers after WIDTH zero bytes: linear, so one look-up for each of their four bytes."""
    if WIDTH not in _SHIFT:
        start = np.arange(256, dtype=np.uint32) << (np.arange(4, dtype=np.uint32)[:, None] * np.uint32(8))
        _SHIFT[WIDTH] = _columns(start.ravel(), np.zeros((1024, WIDTH), dtype=np.uint8)).reshape(4, 256)
    tables = _SHIFT[WIDTH]
    return tables[0][crc & 0xFF] ^ tables[1][crc >> 8 & 0xFF] ^ tables[2][crc >> 16 & 0xFF] ^ tables[3][crc >> 24]


def crc32_of(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The CRC-32 of each stretch of bytes of data."""
    out = np.empty(len(starts), dtype=np.uint32)
    ones = np.uint32(0xFFFFFFFF)
    order = np.argsort(lengths, kind="stable")
    cuts = np.flatnonzero(np.diff(lengths[order], prepend=-1))
    for at in np.split(order, cuts[1:]) if len(order) else ():
        n = int(lengths[at[0]])
        head = n % WIDTH or min(n, WIDTH)
        # rows of whole features, or of their first pieces, of which the first is the short one
        crc = _columns(np.full(len(at), ones), data[starts[at][:, None] + np.arange(head)])
        pieces = (n - head) // WIDTH
        if pieces:
            places = starts[at][:, None] + head + WIDTH * np.arange(pieces)
            parts = _pieces(data, places.ravel()).reshape(len(at), pieces)
            for part in parts.T:
                crc = _shifted(crc) ^ part
        out[at] = crc ^ ones
    return out


def _pieces(data: np.ndarray, places: np.ndarray) -> np.ndarray:
    """Registers, from zero, of the WIDTH bytes at each place; a bounded matrix at a time."""
    out = np.empty(len(places), dtype=np.uint32)
    for i in range(0, len(places), 1 << 12):
        some = places[i : i + (1 << 12)]
        out[i : i + len(some)] = _columns(np.zeros(len(some), dtype=np.uint32), data[some[:, None] + np.arange(WIDTH)])
    return out


def _runs(data: np.ndarray, bounds: np.ndarray, longest: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, starts, lengths, text) of all runs of 1 to `longest` words of each text, words lower-cased with one space between."""
    data = _LOWER[data]
    word = _WORD[data]
    # a text ends a word, whatever follows
    first = word.copy()
    first[1:] &= ~word[:-1]
    begins = bounds[:-1][bounds[:-1] < bounds[1:]]
    first[begins] = word[begins]
    starts = np.flatnonzero(first)
    if not len(starts):
        none = np.empty(0, np.int64)
        return data[:0], none, none, none
    text = np.searchsorted(bounds, starts, side="right") - 1
    # the words side by side, with one space after each
    number = np.cumsum(first) - 1
    inside = np.flatnonzero(word)
    packed = np.full(len(inside) + len(starts), 0x20, dtype=np.uint8)
    packed[np.arange(len(inside)) + number[inside]] = data[inside]
    lengths = np.bincount(number[inside], minlength=len(starts))
    places = np.concatenate([[0], np.cumsum(lengths + 1)[:-1]])
    found = [(places, lengths, text)]
    for n in range(2, longest + 1):
        if len(starts) >= n:
            same = np.flatnonzero(text[: len(text) - n + 1] == text[n - 1 :])
            found.append((places[same], places[same + n - 1] + lengths[same + n - 1] - places[same], text[same]))
    return packed, *(np.concatenate(c) for c in zip(*found))


def bucketed(texts: pa.Array, longest: int, buckets: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first text, texts, bucket of each feature, text of each feature, counted from the first) for slices of a batch."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    n = len(texts)
    if not n:
        return
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + n + 1]
    data = np.frombuffer(texts.buffers()[2], dtype=np.uint8) if texts.buffers()[2] else np.empty(0, np.uint8)
    i = 0
    while i < n:
        j = min(n, max(i + 1, int(np.searchsorted(offsets, offsets[i] + SLICE, side="right")) - 1))
        packed, starts, lengths, text = _runs(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], longest)
        places = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)
        if longest == 1 and len(starts):
            spaces = np.zeros(len(packed), dtype=bool)
            spaces[starts + lengths] = True
            flat = packed[~spaces]
        else:
            flat = packed[np.repeat(starts - places[:-1], lengths) + np.arange(places[-1])]
        features = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(places), pa.py_buffer(np.ascontiguousarray(flat))]).dictionary_encode()
        own = features.dictionary
        ends = np.frombuffer(own.buffers()[1], dtype=np.int64)[own.offset : own.offset + len(own) + 1] if len(own) else np.zeros(1, np.int64)
        raw = np.frombuffer(own.buffers()[2], dtype=np.uint8) if len(own) else np.empty(0, np.uint8)
        of_own = (crc32_of(raw, ends[:-1], np.diff(ends)) % np.uint32(buckets)).astype(np.int64)
        yield i, j - i, of_own[features.indices.to_numpy()], text
        i = j


def bucket_counts(texts: DataFrame, longest: int, buckets: int) -> np.ndarray:
    """How many features of the column `text` fall in each bucket; a task sends one row for each bucket at most."""
    schema = pa.schema([("bucket", pa.int64()), ("n", pa.int64())])

    def count(batches):
        total = np.zeros(buckets, dtype=np.int64)
        for batch in batches:
            for _, _, bucket, _ in bucketed(batch.column(0), longest, buckets):
                total += np.bincount(bucket, minlength=buckets)
        used = np.flatnonzero(total)
        yield pa.record_batch([pa.array(used), pa.array(total[used])], schema=schema)

    out = np.zeros(buckets, dtype=np.int64)
    for bucket, n in texts.select("text").mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n")).collect():
        out[bucket] = n
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 * ln of the target's rate over the source's) of each bucket, each count raised by one."""
    s_all, t_all, n = int(source.sum()), int(target.sum()), len(source)
    return np.array([math.floor(1000 * math.log(((t + 1) * (s_all + n)) / ((s + 1) * (t_all + n)))) for s, t in zip(source.tolist(), target.tolist())], dtype=np.int64)


def noise_of(doc_id: Column, seed: int) -> Column:
    """floor(-1000 * ln(-ln(u))) with u in (0, 1) from the sha256 of seed and doc_id; null without doc_id."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), doc_id.cast("string")).cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / F.lit(4294967296.0))))


def resample(docs: DataFrame, target: DataFrame, percent: int = 10, least_words: int = 20, longest: int = 1, buckets: int = 10_000, seed: int = 2024) -> DataFrame:
    """(doc_id, n_features, weight, score, rank) of each row of docs(doc_id, text), drawn towards target(text).

    Words are runs of letters, digits and all that isn't ASCII, A-Z lower-cased; features are runs of 1
    to `longest` words, repeats counted. The weight adds up the gains of a text's features, the score
    adds noise that depends on seed and doc_id, and floor(percent * N / 100) of the N rows of
    `least_words` words or more with the highest scores are drawn: a sample without replacement,
    in proportion to the exponential of the weights in thousandths. rank counts them by score, ties by doc_id.

    Null texts count as empty: no features, weight 0. Rows without doc_id have neither score nor rank
    and don't count in N. Repeated rows are drawn each on its own, equal ones in any order. An empty
    target, or no documents, leave counts of zero. Very long texts and words are read as a whole.
    Other columns are ignored; an empty table gives an empty result.
    """
    gain = gains(bucket_counts(docs, longest, buckets), bucket_counts(target, longest, buckets))
    table = docs.sparkSession.sparkContext.broadcast(gain)
    names = ["doc_id", "n_features", "n_words", "weight"]
    schema = pa.schema([(n, pa.int64()) for n in names])

    def weigh(batches):
        for batch in batches:
            ids = batch.column("doc_id")
            for first, n, bucket, text in bucketed(batch.column("text"), longest, buckets):
                features = np.bincount(text, minlength=n)
                # whole numbers, added as such
                weight = np.zeros(n, dtype=np.int64)
                np.add.at(weight, text, table.value[bucket])
                # a text of w words has w + (w - 1) + ... runs, as far as they go
                words = features if longest == 1 else np.array([_words(f, longest) for f in features.tolist()], dtype=np.int64)
                yield pa.record_batch([ids.slice(first, n), *(pa.array(c.astype(np.int64)) for c in (features, words, weight))], schema=schema)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(weigh, "doc_id long, n_features long, n_words long, weight long")
    scored = keep(rows.withColumn("score", F.col("weight") + noise_of(F.col("doc_id"), seed)).withColumn("row", F.monotonically_increasing_id()), "weights")
    able = (F.col("n_words") >= least_words) & F.col("doc_id").isNotNull()
    out = ["doc_id", "n_features", "weight", "score"]
    # ranges of scores, sorted within; a row's rank is its place after all earlier ranges. Rows that are alike in doc_id
    # and score are parted by their row numbers.
    order = [F.desc("score"), F.asc("doc_id"), F.asc("row")]
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = scored.filter(able).select(*out, "row").repartitionByRange(parts, *order).sortWithinPartitions(*order)
    at = F.monotonically_increasing_id()
    ranked = keep(ranged.select(*out, F.shiftright(at, 33).alias("part"), (at.bitwiseAND(F.lit((1 << 33) - 1)) + 1).alias("at")), "ranges")
    # one row for each range: as many as there are partitions
    sizes = ranked.groupBy("part").agg(F.max("at").alias("n"))
    bases = sizes.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("base"), F.sum("n").over(Window.partitionBy()).alias("all"))
    rank = F.col("base") + F.col("at")
    drawn = F.floor(F.lit(percent) * F.col("all") / 100)
    placed = ranked.join(F.broadcast(bases), "part").select(*out, F.when(rank <= drawn, rank).cast("long").alias("rank"))
    return placed.unionByName(scored.filter(~able).select(*out, F.lit(None).cast("long").alias("rank")))


def _words(features: int, longest: int) -> int:
    """How many words a text has that has so many runs of 1 to `longest` words."""
    w = 0
    while features > 0:
        w += 1
        features -= min(w, longest)
    return w
