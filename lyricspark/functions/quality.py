"""Overlap scores between a prediction and a reference text, as Columns."""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from .constants import STOPWORDS
from .text import let, strings, tokenize


def _jaccard(a: Column, b: Column) -> Column:
    return let(F.struct(a.alias("a"), b.alias("b")), lambda s: _overlap(s["a"], s["b"]))


def _overlap(a: Column, b: Column) -> Column:
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b)))


def word_jaccard(a: Column, b: Column, stopwords: Iterable[str] = STOPWORDS) -> Column:
    """Overlap of the word sets without stop words."""
    stop = strings(stopwords)
    return _jaccard(*(F.array_except(tokenize(x, "ascii"), stop) for x in (a, b)))


def ngrams(words: Column, n: int) -> Column:
    """The n-grams of an array of words, joined by spaces."""
    return F.when(F.size(words) < n, F.array().cast("array<string>")).otherwise(F.transform(F.sequence(F.lit(1), F.size(words) - n + 1), lambda i: F.array_join(F.slice(words, i, n), " ")))


def bigram_jaccard(a: Column, b: Column) -> Column:
    return _jaccard(*(let(tokenize(x, "ascii"), lambda w: F.array_distinct(ngrams(w, 2))) for x in (a, b)))


def is_repetitive(text: Column, at_least: int = 10, times: int = 5) -> Column:
    """Ten words or more, and a 2-, 3- or 4-gram that stands five times or more."""

    def often(w: Column, n: int) -> Column:
        # sorted, an n-gram that stands `times` times equals the one `times - 1` places on
        return let(F.array_sort(ngrams(w, n)), lambda g: F.exists(F.arrays_zip(g.alias("x"), F.slice(g, times, 1 << 30).alias("y")), lambda p: p["x"] == p["y"]))

    def again(w: Column) -> Column:
        return F.coalesce((F.size(w) >= at_least) & (often(w, 2) | often(w, 3) | often(w, 4)), F.lit(False))

    return F.when(text.isNotNull(), let(tokenize(text, "ascii"), again))


def _ranked(row: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """A number for each pair of row and id, from 0 on."""
    return np.unique(row * (int(ids.max(initial=0)) + 1) + ids, return_inverse=True)[1]


def _shared(rows: int, row: np.ndarray, ids: np.ndarray, side: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(distinct ids of side 0, of side 1, of both) by row."""
    at = _ranked(row, ids)
    n = int(at.max(initial=-1)) + 1
    held = [np.bincount(at[side == k], minlength=n) > 0 for k in (0, 1)]
    of = np.zeros(n, np.int64)
    of[at] = row
    return tuple(np.bincount(of[x], minlength=rows) for x in (*held, held[0] & held[1]))


def _share(a: np.ndarray, b: np.ndarray, both: np.ndarray) -> np.ndarray:
    return np.where((a == 0) | (b == 0), 0.0, both / np.maximum(a + b - both, 1))


def overlaps(pred: Column, ref: Column, stopwords: Iterable[str] = STOPWORDS, at_least: int = 10, times: int = 5, repeats: bool = True) -> Column:
    """struct<words, bigrams, repetitive> of two arrays of words: word_jaccard, bigram_jaccard, and with `repeats` is_repetitive of the first one; null where an array is null."""
    stop = pa.array(list(stopwords), pa.string())

    @F.arrow_udf("struct<words:double,bigrams:double,repetitive:boolean>")
    def run(p: pa.Array, r: pa.Array) -> pa.Array:
        rows = len(p)
        flat = pa.concat_arrays([p.flatten(), r.flatten()])
        coded = flat.dictionary_encode()
        ids = np.asarray(coded.indices).astype(np.int64)
        sizes = [np.asarray(pc.fill_null(pc.list_value_length(x), 0)).astype(np.int64) for x in (p, r)]
        row = np.concatenate([np.repeat(np.arange(rows), n) for n in sizes])
        side = np.repeat([0, 1], [n.sum() for n in sizes])
        plain = ~np.asarray(pc.is_in(coded.dictionary, stop))[ids] if len(ids) else np.zeros(0, bool)
        single = _share(*_shared(rows, row[plain], ids[plain], side[plain]))
        inside = np.flatnonzero((row[:-1] == row[1:]) & (side[:-1] == side[1:]))
        two = np.unique(ids[inside] * (len(coded.dictionary) + 1) + ids[inside + 1], return_inverse=True)[1]
        double = _share(*_shared(rows, row[inside], two, side[inside]))
        again = np.zeros(rows, bool)
        if repeats:
            heard = side == 0
            row, ids = row[heard], ids[heard]
            long = sizes[0][row] >= at_least
            row, ids = row[long], ids[long]
            at, runs = np.arange(len(ids)), ids
            for further in (1, 2, 3):
                # the word that makes a run one longer, as far as it is in its row
                ahead = at + further
                kept = ahead < len(ids)
                kept[kept] = row[ahead[kept]] == row[at[kept]]
                at, runs = at[kept], runs[kept] * (int(ids.max(initial=0)) + 1) + ids[ahead[kept]]
                runs = _ranked(row[at], np.unique(runs, return_inverse=True)[1])
                often = np.bincount(runs, minlength=1)[runs] >= times
                again[row[at[often]]] = True
        lost = np.asarray(pc.or_(pc.is_null(p), pc.is_null(r)))
        nothing = np.asarray(pc.is_null(p))
        return pa.StructArray.from_arrays([pa.array(single, mask=lost), pa.array(double, mask=lost), pa.array(again, mask=nothing)], ["words", "bigrams", "repetitive"])

    return run(pred, ref)


def alignment_score(pred: Column, ref: Column) -> Column:
    return let(overlaps(tokenize(pred, "ascii"), tokenize(ref, "ascii"), repeats=False), lambda o: 0.4 * o["words"] + 0.6 * o["bigrams"])


def combined_score(pred: Column, ref: Column, repetitive: Column | None = None) -> Column:
    """The same, times 0.3 if the prediction is repetitive, to four decimals; `repetitive` where that is known."""

    def score(o: Column) -> Column:
        both = 0.4 * o["words"] + 0.6 * o["bigrams"]
        return F.bround(F.when(o["again"], both * 0.3).otherwise(both), 4)

    scores = overlaps(tokenize(pred, "ascii"), tokenize(ref, "ascii"), repeats=repetitive is None)
    return let(scores, lambda o: let(F.struct(o["words"].alias("words"), o["bigrams"].alias("bigrams"), (o["repetitive"] if repetitive is None else repetitive).alias("again")), score))
