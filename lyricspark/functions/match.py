"""Transcripts corrected by reference lyrics, as Arrow-batched functions: word pairs, how alike they sound, and what is chosen."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from .align import _all_distances, _char_sides, _coded, _diff_places, _offsets, _Side
from .constants import PHONETIC_PAIRS

_SOURCES = ("exact", "reference", "phonetic", "transcription")
EXACT, REFERENCE, PHONETIC, TRANSCRIPTION = range(4)


def _alike(x: list[str], y: list[str], pairs: Mapping[str, Iterable[str]]) -> np.ndarray:
    """metrics.phonetic_similarity of words in lower case that aren't empty or equal."""
    known = {(p, v) for k, vs in pairs.items() for w in vs for p, v in ((k, w), (w, k))}
    longest = np.fromiter((max(len(p), len(q)) for p, q in zip(x, y)), np.int64, len(x))
    out = 1 - _all_distances(*_char_sides(x, y)) / np.maximum(longest, 1)
    out[np.fromiter((p.rstrip("g") == q.rstrip("g") for p, q in zip(x, y)), bool, len(x))] = 0.9
    out[np.fromiter(((p, q) in known for p, q in zip(x, y)), bool, len(x))] = 0.95
    return out


def _matched(t: pa.Array, r: pa.Array, threshold: float, prefer_reference: bool, pairs: Mapping[str, Iterable[str]]):
    """(both sides, their words, row, places, (chosen, confidence, source)) of all word pairs; as metrics.score_pair, each pair of words worked out once."""
    sides, words = _coded(t, r)
    row, *places = _diff_places(*sides)
    heard, meant = (np.full(len(row), -1, np.int64) for _ in sides)
    for side, place, ids in zip(sides, places, (heard, meant)):
        on = place >= 0
        ids[on] = side.ids[(side.starts[row] + place)[on]]
    confidence, source, chosen = np.ones(len(row)), np.full(len(row), EXACT, np.int8), np.where(meant < 0, heard, meant)
    confidence[meant < 0], source[meant < 0] = 0.4, TRANSCRIPTION
    confidence[heard < 0], source[heard < 0] = 0.6, REFERENCE
    other = np.flatnonzero((heard >= 0) & (meant >= 0) & (heard != meant))
    if len(other):
        both, at = np.unique(heard[other] * len(words) + meant[other], return_inverse=True)
        sim = _alike(*(words.take(pa.array(n)).to_pylist() for n in np.divmod(both, len(words))), pairs)[at]
        near, same = sim >= threshold, sim >= 0.9
        confidence[other] = np.where(same, 0.9, np.where(near, sim, 0.5 if prefer_reference else 0.4))
        source[other] = np.where(same, PHONETIC, REFERENCE if prefer_reference else np.where(near, REFERENCE, TRANSCRIPTION))
        if not prefer_reference:
            chosen[other] = np.where(same | near, meant[other], heard[other])
    return sides, words, row, (heard, meant), (chosen, confidence, source)


def match_words(trans: Column, ref: Column, threshold: float = 0.6, prefer_reference: bool = True, pairs: Mapping[str, Iterable[str]] = PHONETIC_PAIRS) -> Column:
    """struct of two arrays of words in lower case: the matched text, the sum of its words' confidences, how many came from where, and the word errors before and after.

    Pairs count where both sides hold words.
    """

    @F.arrow_udf("struct<matched:string,sure:double,exact:int,corrections:int,phonetic:int,uncertain:int,total:int,before:int,after:int>")
    def run(t: pa.Array, r: pa.Array) -> pa.Array:
        (a, b), words, row, (_, meant), (chosen, confidence, source) = _matched(t, r, threshold, prefer_reference, pairs)
        every, offsets = row, _offsets(row, len(t))
        matched = pc.binary_join(pa.ListArray.from_arrays(offsets, words.take(pa.array(chosen)).cast(pa.string())), " ")
        counted = (a.sizes > 0) & (b.sizes > 0)
        some = counted[row]
        row, confidence, source = row[some], confidence[some], source[some]
        n = lambda test: np.bincount(row[test], minlength=len(t)).astype(np.int32)
        sure = np.bincount(row, confidence, len(t))
        counts = [n(source == EXACT), n(source == REFERENCE), n(source == PHONETIC), n(confidence < 0.6), n(slice(None))]
        errors = [_all_distances(a, b).astype(np.int32)]
        if prefer_reference:
            # what is chosen holds all words of the reference in order, so the others are the errors
            errors.append(np.bincount(every[meant < 0], minlength=len(t)).astype(np.int32))
        else:
            errors.append(_all_distances(_Side(chosen.astype(b.ids.dtype), np.diff(offsets).astype(np.int64)), b).astype(np.int32))
        fields = [matched, *(pa.array(x) for x in (sure, *counts, *errors))]
        return pa.StructArray.from_arrays(fields, ["matched", "sure", "exact", "corrections", "phonetic", "uncertain", "total", "before", "after"])

    return run(trans, ref)


def match_alignments(trans: Column, ref: Column, threshold: float = 0.6, prefer_reference: bool = True, pairs: Mapping[str, Iterable[str]] = PHONETIC_PAIRS) -> Column:
    """array<struct<trans, ref, s: struct<chosen, confidence, source>>> of two arrays of words in lower case; empty where a side is."""

    @F.arrow_udf("array<struct<trans:string,ref:string,s:struct<chosen:string,confidence:double,source:string>>>")
    def run(t: pa.Array, r: pa.Array) -> pa.Array:
        (a, b), words, row, both, (chosen, confidence, source) = _matched(t, r, threshold, prefer_reference, pairs)
        some = ((a.sizes > 0) & (b.sizes > 0))[row]
        word = lambda ids: words.take(pa.array(ids[some], mask=ids[some] < 0))
        scored = pa.StructArray.from_arrays([word(chosen), pa.array(confidence[some]), pa.array(_SOURCES).take(pa.array(source[some]))], ["chosen", "confidence", "source"])
        return pa.ListArray.from_arrays(_offsets(row[some], len(t)), pa.StructArray.from_arrays([*map(word, both), scored], ["trans", "ref", "s"]))

    return run(trans, ref)
