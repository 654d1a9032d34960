"""Metadata of lyric pages: patterns, editorial lines, flags, page text."""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .constants import EDITORIAL_KEYWORDS, METADATA_FLAGS, METADATA_PATTERNS
from .text import let, strings


def _is_editorial(line: Column, keywords: Iterable[str] = EDITORIAL_KEYWORDS, hits: int = 2, longer_than: int = 40) -> Column:
    # in lower case once, not once for each keyword
    known = let(F.lower(line), lambda low: F.size(F.filter(strings(keywords), lambda k: F.contains(low, k))))
    return (F.char_length(line) > longer_than) & (known >= hits)


def editorial_lines(text: Column) -> Column:
    """The lines that read like a description of the song."""
    return F.filter(F.split(text, "\n", -1), lambda x: _is_editorial(x))


def strip_metadata(text: Column, patterns: Iterable[tuple[str, str]] = METADATA_PATTERNS) -> Column:
    for pattern, _ in patterns:
        text = F.regexp_replace(text, f"(?imdU){pattern}", "\n")
    kept = F.array_join(F.filter(F.split(text, "\n", -1), lambda x: ~_is_editorial(x)), "\n")
    return F.regexp_replace(F.regexp_replace(kept, r"\n{3,}", "\n\n"), r"(?U)^\s+|\s+$", "")


_CHANGES = "array<struct<type:string,removed:string,position:int>>"


def metadata_changes(text: Column) -> Column:
    """array<struct<type, removed, position>>: what strip_metadata takes out, in the order of the patterns, last match first.

    An editorial line has its number of keywords in its type and its line number as position.
    """
    compiled = [(re.compile(p, re.M | re.I), name) for p, name in METADATA_PATTERNS]
    brief = lambda cut: cut[:80] + "..." * (len(cut) > 80)

    def one(t: str | None) -> list:
        out, rest = [], t or ""
        for pattern, name in compiled:
            taken = [(m.start(), m[0].strip()) for m in pattern.finditer(rest)]
            out += [(name, brief(cut), at) for at, cut in taken[::-1] if cut]
            if taken:
                rest = pattern.sub("\n", rest)
        for number, line in enumerate(rest.split("\n")):
            low = line.lower()
            known = sum(k in low for k in EDITORIAL_KEYWORDS) if len(line) > 40 else 0
            if known >= 2:
                out.append((f"editorial_line ({known} keywords)", brief(line), number))
        return [dict(zip(("type", "removed", "position"), x)) for x in out]

    @F.pandas_udf(_CHANGES)
    def changes(texts):
        return texts.map(one)

    return changes(text)


def metadata_flags(text: Column, flags: Iterable[tuple[str, str]] = METADATA_FLAGS) -> Column:
    return F.filter(F.array(*(F.when(text.rlike(f"(?imdU){p}"), F.lit(n)) for p, n in flags)), lambda x: x.isNotNull())


def contamination(df: DataFrame, text: str = "text") -> DataFrame:
    """df with changes, cleaned, original_len, cleaned_len, reduction_pct and contaminated: whether there are any changes."""
    out = df.withColumn("changes", metadata_changes(F.col(text))).withColumn("cleaned", strip_metadata(F.col(text))).withColumn("original_len", F.char_length(text)).withColumn("cleaned_len", F.char_length("cleaned"))
    share = (1 - F.col("cleaned_len") / F.greatest("original_len", F.lit(1))) * 100
    return out.withColumn("reduction_pct", F.bround(share, 1)).withColumn("contaminated", F.size("changes") > 0)


def contamination_report(df: DataFrame, text: str = "text") -> DataFrame:
    return contamination(df, text).agg(F.count("*").alias("total"), F.count_if("contaminated").alias("contaminated"), F.count_if(~F.col("contaminated")).alias("clean"))


def apply_fixes(df: DataFrame, text: str = "text") -> DataFrame:
    """The cleaned text in place of each contaminated one, and fixed."""
    marked = contamination(df, text)
    return marked.withColumn(text, F.when(F.col("contaminated"), F.col("cleaned")).otherwise(F.col(text))).withColumn("fixed", F.col("contaminated")).select(*df.columns, "fixed")


def extract_page_text(html: Column, container: str = "div", attribute: tuple[str, str] | None = ("data-lyrics-container", "true")) -> Column:
    """Text of every container element, <br> as line breaks, joined by line breaks; null if there is none."""
    from html.parser import HTMLParser

    class Reader(HTMLParser):
        def __init__(self) -> None:
            super().__init__(convert_charrefs=True)
            self.depth, self.parts, self.found = 0, [], []

        def handle_starttag(self, tag, attrs):
            if self.depth:
                self.depth += tag == container
                if tag == "br":
                    self.parts.append("\n")
            elif tag == container and (attribute is None or dict(attrs).get(attribute[0]) == attribute[1]):
                self.depth = 1

        def handle_startendtag(self, tag, attrs):
            if self.depth and tag == "br":
                self.parts.append("\n")

        def handle_endtag(self, tag):
            if self.depth and tag == container:
                self.depth -= 1
                if not self.depth:
                    self.found.append("".join(self.parts))
                    self.parts = []

        def handle_data(self, data):
            if self.depth:
                self.parts.append(data)

    def one(page: str | None) -> str | None:
        reader = Reader()
        reader.feed(page or "")
        reader.close()
        if reader.parts:
            reader.found.append("".join(reader.parts))
        return "\n".join(reader.found) if reader.found else None

    @F.pandas_udf("string")
    def read(pages):
        return pages.map(one)

    return read(html)


def clean_page_lyrics(text: Column) -> Column:
    out = F.regexp_replace(text, r"(?d)\[.*?\]", "")
    out = F.regexp_replace(out, r"(?U)^\d+\s*Contributors?", "")
    out = F.regexp_replace(out, r"(?d)^.*?Lyrics", "")
    out = F.regexp_replace(out, r"(?is)is a (?:track|song) by.*?Read More", "")
    dropped = r"(?U)^$|Lyrics$|^See .* [Ll]ive|Embed|Contributors?$|^\d+$"
    lines = F.transform(F.split(out, "\n", -1), lambda x: F.regexp_replace(x, r"(?U)^\s+|\s+$", ""))
    return F.array_join(F.filter(lines, lambda x: ~x.rlike(dropped)), "\n")
