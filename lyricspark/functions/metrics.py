"""Error rates, similarities, grades and term sets as Columns."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from .align import char_distances, distances, error_rates
from .constants import CATEGORY_ADLIBS, CATEGORY_SLANG, PHONETIC_PAIRS, SLANG_VARIANTS
from .text import normalize_delete, strings, tokenize


def word_distance(ref: Column, hyp: Column) -> Column:
    """Edit distance between two arrays of words.

    The built-in levenshtein would need each word as one character, looked up in an array in linear
    time for every word, which long texts don't allow.
    """
    return distances(ref, hyp)["errors"]


def wer(ref: Column, hyp: Column, profile: str = "delete", empty_ref: str = "count", round_to: int | None = None) -> Column:
    """Word error rate. Of an empty reference: 0 for an empty hypothesis, else the hypothesis's words (count) or 1 (one)."""
    rate = error_rates(tokenize(ref, profile), tokenize(hyp, profile), empty_ref)
    return F.bround(rate, round_to) if round_to is not None else rate


#: Up to this length the built-in levenshtein, whose time grows with the product of the lengths, is the faster one.
SHORT = 64


def char_distance(a: Column, b: Column) -> Column:
    """Edit distance of two texts: built in for short ones, by bits of long integers beyond."""
    short = (F.char_length(a) <= SHORT) & (F.char_length(b) <= SHORT)
    beyond = char_distances(F.when(~short, a), F.when(~short, b))
    return F.when(short, F.levenshtein(a, b)).otherwise(beyond)


def cer(ref: Column, hyp: Column) -> Column:
    """Character error rate of the normalized texts, spaces included."""
    return char_rate(normalize_delete(ref), normalize_delete(hyp))


def char_rate(r: Column, h: Column) -> Column:
    """The same of texts that are normalized."""
    return F.when(r == "", F.char_length(h).cast("double")).otherwise(char_distance(r, h) / F.char_length(r))


def levenshtein_ratio(a: Column, b: Column) -> Column:
    longest = F.greatest(F.char_length(a), F.char_length(b))
    return F.when(longest == 0, F.lit(1.0)).when((a == "") | (b == ""), F.lit(0.0)).otherwise(1 - F.levenshtein(a, b) / longest)


def phonetic_similarity(a: Column, b: Column, pairs: Mapping[str, Iterable[str]] = PHONETIC_PAIRS) -> Column:
    x, y = F.lower(F.trim(a)), F.lower(F.trim(b))
    known = sorted({f"{p}\t{v}" for k, vs in pairs.items() for v in vs for p, v in ((k, v), (v, k))})
    listed = F.array_contains(strings(known), F.concat(x, F.lit("\t"), y))
    bare = lambda w: F.regexp_replace(w, "g+$", "")
    return F.when(x == y, 1.0).when(listed, 0.95).when(bare(x) == bare(y), 0.9).otherwise(levenshtein_ratio(x, y))


def score_pair(trans: Column, ref: Column, sim: Column | None = None, phonetic_threshold: float = 0.6, prefer_reference: bool = True) -> Column:
    """struct<chosen, confidence, source> of an aligned pair of words, either of which may be null; sim is their phonetic similarity where it is known."""
    sim = phonetic_similarity(trans, ref) if sim is None else sim

    def out(word: Column, confidence, source: str) -> Column:
        return F.struct(word.alias("chosen"), (F.lit(confidence) if isinstance(confidence, float) else confidence).cast("double").alias("confidence"), F.lit(source).alias("source"))

    otherwise = out(ref, 0.5, "reference") if prefer_reference else out(trans, 0.4, "transcription")
    heard = F.when(sim >= 0.9, out(ref, 0.9, "phonetic")).when(sim >= phonetic_threshold, out(ref, sim, "reference")).otherwise(otherwise)
    return (
        F.when(ref.isNull(), out(trans, 0.4, "transcription")).when(trans.isNull(), out(ref, 0.6, "reference"))
        .when(F.lower(trans) == F.lower(ref), out(ref, 1.0, "exact")).otherwise(heard)
    )


def alignment_marker(confidence: Column) -> Column:
    return F.when(confidence >= 0.9, "✓").when(confidence >= 0.6, "~").otherwise("?")


def wer_grade(rate: Column, labels: Iterable[str] = ("Excellent", "Good", "Fair", "Poor", "Very Poor")) -> Column:
    best, good, fair, poor, rest = labels
    return F.when(rate < 0.1, best).when(rate < 0.2, good).when(rate < 0.3, fair).when(rate < 0.5, poor).otherwise(rest)


def is_homophone(a: Column, b: Column) -> Column:
    la, lb = F.char_length(a), F.char_length(b)
    start = (la >= 3) & (lb >= 3) & (F.substring(a, 1, 3) == F.substring(b, 1, 3)) & (F.abs(la - lb) <= 2)
    return F.coalesce((la > 0) & (lb > 0) & (start | ((la >= 4) & (lb >= 4) & (F.levenshtein(a, b) <= 2))), F.lit(False))


def is_truncation(a: Column, b: Column) -> Column:
    return F.coalesce((F.char_length(a) > 0) & (F.char_length(b) > 0) & (a.startswith(b) | b.startswith(a)), F.lit(False))


def error_category(op: Column, ref: Column, hyp: Column, slang: Iterable[str] = CATEGORY_SLANG, adlibs: Iterable[str] = CATEGORY_ADLIBS) -> Column:
    """The category of an alignment row, null for a correct one."""
    r, h = F.lower(F.coalesce(ref, F.lit(""))), F.lower(F.coalesce(hyp, F.lit("")))
    slang, adlibs = list(slang), list(adlibs)
    swapped = F.when(r.isin(slang), "slang_miss").when(is_homophone(r, h), "homophone").when(is_truncation(r, h), "truncation").otherwise("other_sub")
    added = F.when(h.isin(adlibs), "adlib_miss").otherwise("hallucination")
    dropped = F.when(r.isin(adlibs), "adlib_miss").when(r.isin(slang), "slang_miss").otherwise("dropped_word")
    return F.when(op == "substitution", swapped).when(op == "insertion", added).when(op == "deletion", dropped)


def extract_terms(text: Column, terms: Iterable[str]) -> Column:
    """The words of the text that are terms, with repeats, in order."""
    known = strings(terms)
    return F.filter(F.regexp_extract_all(F.lower(text), F.lit(r"(?U)\b[\w']+\b"), F.lit(0)), lambda w: F.array_contains(known, w))


def term_accuracy(ref: Column, hyp: Column, terms: Iterable[str], variants: Mapping[str, Iterable[str]] | None = SLANG_VARIANTS) -> Column:
    """struct of the correct, missed and extra terms, token counts, recall, precision, F1 and variants recovered."""
    r, h = extract_terms(ref, terms), extract_terms(hyp, terms)
    rs, hs = F.array_distinct(r), F.array_distinct(h)
    good, missed, extra = F.array_intersect(rs, hs), F.array_except(rs, hs), F.array_except(hs, rs)
    recall = F.when(F.size(rs) == 0, 1.0).otherwise(F.size(good) / F.size(rs))
    precision = F.when(F.size(hs) == 0, 1.0).otherwise(F.size(good) / F.size(hs))
    f1 = F.when(recall + precision == 0, 0.0).otherwise(2 * precision * recall / (precision + recall))
    fields = [r.alias("ref_terms"), h.alias("hyp_terms"), good.alias("correct"), missed.alias("missed"), extra.alias("extra"), recall.alias("recall"), precision.alias("precision"), f1.alias("f1")]
    if variants:
        low = F.lower(hyp)
        heard = [F.when(F.array_contains(missed, k) & F.exists(strings(vs), lambda v: F.contains(low, v)), F.lit(k)) for k, vs in variants.items()]
        fields.append(F.filter(F.array(*heard), lambda x: x.isNotNull()).alias("recovered"))
    return F.struct(*fields)
