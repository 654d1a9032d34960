"""Text functions as Columns: normalization, token maps, punctuation, lines and structure.

Unless said otherwise a null text gives null. Patterns carry (?U), so that letters, digits and spaces
are Unicode's.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .constants import CAPITALIZED, CENSORED, CONTRACTIONS, SLANG_EXPANSIONS


def literal_map(pairs: Mapping[str, str]) -> Column:
    return F.create_map(*(F.lit(x) for kv in pairs.items() for x in kv))


def strings(words: Iterable[str]) -> Column:
    return F.array(*(F.lit(w) for w in words))


def let(value: Column, body) -> Column:
    """body(value) with value worked out once, however often the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


#: All but a-z, 0-9 and ASCII's white space; a class that is negated and stays in the basic plane takes Java several times as long.
_NOT_PLAIN = r"[\x00-\x08\x0E-\x1F!-/:-`{-\x{10FFFF}]"


def collapse_whitespace(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def words(text: Column) -> Column:
    """Parts between white space; none of an empty text."""
    return F.filter(F.split(text, r"(?U)\s+"), lambda w: w != "")


def normalize_delete(text: Column) -> Column:
    return collapse_whitespace(F.regexp_replace(F.lower(text), r"(?U)[^\w\s']", ""))


def normalize_space(text: Column) -> Column:
    return collapse_whitespace(F.regexp_replace(F.lower(text), r"(?U)[^\w\s']", " "))


def normalize_ascii(text: Column) -> Column:
    return collapse_whitespace(F.regexp_replace(F.lower(text), _NOT_PLAIN, ""))


def tokenize(text: Column, profile: str = "delete") -> Column:
    """The words of the normalized text; its white space needn't be collapsed for them."""
    # plain characters first: Unicode's letters are slow to tell
    pattern, put = {"delete": (r"(?U)[^a-z0-9 '\w\s]", ""), "space": (r"(?U)[^a-z0-9 '\w\s]", " "), "ascii": (_NOT_PLAIN, "")}[profile]
    return words(F.regexp_replace(F.lower(text), pattern, put))


@F.pandas_udf(StringType())
def nfc(texts):
    """Canonical composition, for which there is no built-in function."""
    return texts.str.normalize("NFC")


def unicode_clean(text: Column, fold_quotes: bool = False) -> Column:
    """Dashes and ellipses as ASCII, bullets and zero-width marks dropped, NFC, no unprintable characters but tab and line feed."""
    out = F.replace(F.translate(text, "—–•·​﻿", "--"), F.lit("…"), F.lit("..."))
    if fold_quotes:
        out = F.translate(out, "‘’“”", "''\"\"")
    # only texts with characters beyond Latin-1 letters can change under NFC
    out = F.when(out.rlike(r"[^\x00-ÿ]"), nfc(out)).otherwise(out)
    return F.regexp_replace(out, r"[\p{C}\p{Z}&&[^ \n\t]]", "")


def strip_annotations(text: Column) -> Column:
    return F.regexp_replace(text, r"(?d)\[.*?\]", "")


def map_words(text: Column, mapping: Mapping[str, str]) -> Column:
    """Each word replaced by the map's entry for it in lower case; joined by single spaces."""
    table = literal_map(mapping)
    return F.array_join(F.transform(words(text), lambda w: F.coalesce(F.element_at(table, F.lower(w)), w)), " ")


def expand_contractions(text: Column, mapping: Mapping[str, str] = CONTRACTIONS) -> Column:
    return map_words(text, mapping)


def expand_slang(text: Column, mapping: Mapping[str, str] = SLANG_EXPANSIONS) -> Column:
    return map_words(text, mapping)


def remove_punctuation(text: Column, keep_apostrophes: bool = True) -> Column:
    return F.regexp_replace(text, r"(?U)[^\w\s']" if keep_apostrophes else r"(?U)[^\w\s]", "")


def clean_punctuation(text: Column) -> Column:
    out = F.regexp_replace(text, r"([!?.]){2,}", "$1")
    out = F.regexp_replace(out, r"(?U)\s*([,;:!?])\s*", "$1 ")
    return F.regexp_replace(out, r"(?U)\s*\.\s*", ". ")


def normalize_lyrics(text: Column, lowercase: bool = True, annotations: bool = True, punctuation: bool = False, apostrophes: bool = True, unicode: bool = True, contractions: bool = False) -> Column:
    """The normalizer's steps in their order, each behind its flag; a null or empty text gives an empty one."""
    out = F.coalesce(text, F.lit(""))
    out = unicode_clean(out) if unicode else out
    out = strip_annotations(out) if annotations else out
    out = F.lower(out) if lowercase else out
    out = expand_contractions(out) if contractions else out
    out = remove_punctuation(out, apostrophes) if punctuation else clean_punctuation(out)
    return collapse_whitespace(out)


def preprocess_lyrics(text: Column, **flags: bool) -> Column:
    """Normalized, without a repeat mark such as x4 or (2x) at the very end."""
    return F.trim(F.regexp_replace(normalize_lyrics(text, **flags), r"(?iU)\s*\(?\s*(?:x\s*\d+|\d+\s*x)\s*\)?\s*$", ""))


def extract_ad_libs(text: Column) -> Column:
    """struct<text, ad_libs>: the text without parentheses, and what stood in them."""
    return F.struct(F.trim(F.regexp_replace(text, r"\(([^)]+)\)", "")).alias("text"), F.regexp_extract_all(text, F.lit(r"\(([^)]+)\)"), F.lit(1)).alias("ad_libs"))


def tokenizer_preprocess(text: Column, masked: Iterable[tuple[str, str]] = (("f**k", "fuck"), ("s**t", "shit"), ("b***h", "bitch"), ("a**", "ass"))) -> Column:
    out = F.replace(F.lower(text), F.lit("…"), F.lit("..."))
    for old, new in masked:
        out = F.replace(out, F.lit(old), F.lit(new))
    return collapse_whitespace(strip_annotations(out))


#: Characters whose upper case is more than one character, and what stands for them in upper case alone.
_WIDER = [c for c in map(chr, (*range(0xD800), *range(0xE000, 0x20000))) if len(c.upper()) > 1]
_SINGLE = ["ẞ" if c == "ß" else c.title() if len(c.title()) == 1 else c for c in _WIDER]


def upper(text: Column) -> Column:
    """Upper case, in which each character stays one: ß becomes ẞ, as in SQL, so that lower case leads back."""
    one = lambda c: F.when(F.char_length(F.upper(c)) > 1, F.translate(c, "".join(_WIDER), "".join(_SINGLE))).otherwise(F.upper(c))
    return F.when(F.char_length(F.upper(text)) == F.char_length(text), F.upper(text)).otherwise(F.array_join(F.transform(F.split(text, ""), one), ""))


def _capitalize(word: Column) -> Column:
    return F.concat(upper(F.substring(word, 1, 1)), F.lower(F.substring(word, 2, 1 << 30)))


def capitalize_words(text: Column, always: Iterable[str] = CAPITALIZED) -> Column:
    """The first word capitalized, and i with its contractions anywhere."""
    known = strings(always)

    def one(w: Column, i: Column) -> Column:
        raised = F.concat(upper(F.substring(w, 1, 1)), F.substring(w, 2, 1 << 30))
        return F.when(F.array_contains(known, F.lower(w)), raised).when(i == 0, _capitalize(w)).otherwise(w)

    return F.array_join(F.transform(words(text), one), " ")


def restore_punctuation(text: Column) -> Column:
    """A full stop behind a last letter or digit; every sentence capitalized, the rest of it in lower case."""
    ended = F.when(text.rlike(r"(?U)[\p{L}\p{N}]$"), F.concat(text, F.lit("."))).otherwise(text)
    return F.array_join(F.transform(F.split(ended, r"\. ", -1), _capitalize), ". ")


def censor(text: Column, rules: Iterable[tuple[str, str]] = CENSORED) -> Column:
    for word, mask in rules:
        text = F.regexp_replace(text, rf"(?iU)\b{word}\b", mask)
    return text


def postprocess_text(text: Column, slang: bool = False, capitalize: bool = True, punctuation: bool = False, masked: bool = False) -> Column:
    out = collapse_whitespace(F.coalesce(text, F.lit("")))
    out = expand_slang(out) if slang else out
    out = capitalize_words(out) if capitalize else out
    out = restore_punctuation(out) if punctuation else out
    return censor(out) if masked else out


def format_adlibs(text: Column, adlibs: Iterable[str]) -> Column:
    """Runs of up to three ad-libs in parentheses. Of a longer run all but the last three words stay bare."""
    known = strings(adlibs)

    def marked(tokens: Column) -> Column:
        hits = F.transform(tokens, lambda w: F.array_contains(known, F.lower(F.regexp_replace(w, r"^[.,!?]+|[.,!?]+$", ""))))
        return let(F.struct(tokens.alias("w"), hits.alias("h")), wrapped)

    def wrapped(s: Column) -> Column:
        def one(w: Column, i: Column) -> Column:
            on = lambda n: F.coalesce(F.get(s["h"], i + n), F.lit(False))
            # words of the run from here on, 4 for more than three
            left = F.when(~on(1), 1).when(~on(2), 2).when(~on(3), 3).otherwise(4)
            opens = on(0) & ((left == 3) | ((left < 3) & ~on(-1)))
            return F.concat(F.when(opens, "(").otherwise(""), w, F.when(on(0) & ~on(1), ")").otherwise(""))

        return F.array_join(F.transform(s["w"], one), " ")

    return let(words(text), marked)


def break_lines(text: Column, longest: int = 60) -> Column:
    """array of lines: broken after . ! ?, yeah and ayy, then wrapped greedily."""
    parts = F.split(text, r"(?U)(?<=[.!?])\s+|(?<=yeah)\s+|(?<=ayy)\s+")

    def wrap(part: Column) -> Column:
        start = F.struct(F.array().cast("array<string>").alias("lines"), F.lit("").alias("line"))

        def step(s: Column, w: Column) -> Column:
            full = (s["line"] != "") & (F.char_length(s["line"]) + F.char_length(w) + 1 > longest)
            lines = F.when(full, F.concat(s["lines"], F.array(s["line"]))).otherwise(s["lines"])
            line = F.when(full | (s["line"] == ""), w).otherwise(F.concat(s["line"], F.lit(" "), w))
            return F.struct(lines.alias("lines"), line.alias("line"))

        return F.aggregate(words(part), start, step, lambda s: F.when(s["line"] == "", s["lines"]).otherwise(F.concat(s["lines"], F.array(s["line"]))))

    return F.flatten(F.transform(parts, wrap))


def mark_structure(lines: Column) -> Column:
    """Repeated lines open a [Chorus], the first other line after one a [Verse], each behind an empty line."""

    def marked(s: Column) -> Column:
        again = F.transform(s["keys"], lambda k: F.element_at(s["counts"], k) > 1)
        return let(F.struct(s["lines"].alias("lines"), again.alias("again")), opened)

    def opened(s: Column) -> Column:
        def one(x: Column, i: Column) -> Column:
            now, before = F.get(s["again"], i), F.coalesce(F.get(s["again"], i - 1), F.lit(False))
            head = F.when(now & ~before, F.lit("[Chorus]")).when(~now & before, F.lit("[Verse]"))
            return F.when(head.isNotNull(), F.array(F.lit(""), head, x)).otherwise(F.array(x))

        return F.flatten(F.transform(s["lines"], one))

    def counted(s: Column) -> Column:
        # sorted, equal lines are neighbours, and a line's count is the distance of its first and last place
        ends = F.filter(F.transform(s["sorted"], lambda k, i: F.when(k != F.coalesce(F.get(s["sorted"], i + 1), F.lit("\0")), F.struct(k.alias("k"), i.alias("i")))), lambda e: e.isNotNull())
        return let(F.struct(s["lines"].alias("lines"), s["keys"].alias("keys"), ends.alias("ends")), mapped)

    def mapped(s: Column) -> Column:
        counts = F.map_from_entries(F.transform(s["ends"], lambda e, i: F.struct(e["k"], e["i"] - F.coalesce(F.get(s["ends"], i - 1)["i"], F.lit(-1)))))
        return let(F.struct(s["lines"].alias("lines"), s["keys"].alias("keys"), counts.alias("counts")), marked)

    keyed = lambda lines: F.struct(lines.alias("lines"), F.transform(lines, lambda x: F.lower(F.trim(x))).alias("keys"))
    ordered = lambda s: F.struct(s["lines"].alias("lines"), s["keys"].alias("keys"), F.array_sort(s["keys"]).alias("sorted"))
    return let(lines, lambda x: let(keyed(x), lambda s: let(ordered(s), counted)))


def format_lyrics(text: Column, adlibs: Iterable[str]) -> Column:
    return let(format_adlibs(text, adlibs), lambda t: let(break_lines(t), lambda lines: F.array_join(mark_structure(lines), "\n")))


def clean_transcript(text: Column, as_lyrics: bool = False, adlibs: Iterable[str] = (), **flags: bool) -> Column:
    out = postprocess_text(text, **flags)
    return let(out, lambda t: format_lyrics(t, adlibs)) if as_lyrics else out
