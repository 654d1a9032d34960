"""Corrections by a table of rules, compiled to an automaton that every task holds."""

from __future__ import annotations

import re
import uuid
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .constants import CONTEXT_HINTS, CONTEXT_WORDS, IN_CONTEXT

#: Rules of a table at most; it is sent to every task.
MOST_RULES = 100_000
_CLEAN = re.compile(r"[^\w']")
_COMPILED: dict[str, RuleAutomaton] = {}


#: Letters beyond ASCII that match ASCII ones where case is ignored.
FOLDED = re.compile("[\u0130\u0131\u017f\u212a]")


def cores(pattern: str) -> list[str]:
    """Texts that every match of a pattern holds, in lower case, the longest first, as far as that is plain to see."""
    if re.search(r"[|(\[]", pattern):
        return []
    runs, run, i = [], "", 0
    while i < len(pattern):
        c, plain = pattern[i], pattern[i] not in ".^$*+?{}"
        i += 1
        if c == "\\":
            c, plain = pattern[i : i + 1], not pattern[i : i + 1].isalnum()
            i += 1
        elif c == "{":
            i = pattern.find("}", i) + 1 or len(pattern)
        # what may be missing, and what isn't a character of its own, ends a run
        if plain and pattern[i : i + 1] not in ("*", "?", "{"):
            run += c
        else:
            runs.append(run)
            run = ""
    return sorted((r.lower() for r in [*runs, run] if r and r.isascii()), key=len, reverse=True)


def core(pattern: str) -> str | None:
    """The longest of them."""
    return next(iter(cores(pattern)), None)


class RuleAutomaton:
    """rows of (category, priority, pattern, replacement): phrases in order of priority, words by category.

    An Aho-Corasick automaton finds in one pass which phrases can match at all; only those are tried, in
    order, and after a replacement the text is searched again for the ones that follow.
    """

    def __init__(self, rows: Sequence[tuple[str, int, str, str]]) -> None:
        import ahocorasick

        self.words: dict[str, dict[str, str]] = {"dialect": {}, "slang": {}, "explicit": {}}
        phrases = []
        for category, priority, pattern, replacement in sorted(rows, key=lambda r: (r[1], r[2])):
            if category == "phrase":
                note = f"phrase: '{pattern}' → '{replacement}'"
                phrases.append((re.compile(pattern, re.IGNORECASE), replacement.replace("\\", r"\\"), note, core(pattern)))
            else:
                self.words.setdefault(category, {})[pattern] = replacement
        self.phrases = [p[:3] for p in phrases]
        #: Phrases whose text isn't plain are tried always.
        self.always = [n for n, (*_, c) in enumerate(phrases) if c is None]
        self.search = ahocorasick.Automaton()
        held: dict[str, list[int]] = {}
        for n, (*_, c) in enumerate(phrases):
            if c is not None:
                held.setdefault(c, []).append(n)
        for c, numbers in held.items():
            self.search.add_word(c, numbers)
        if held:
            self.search.make_automaton()

    def _tried(self, text: str, after: int) -> list[int]:
        found = set(self.always)
        if FOLDED.search(text):
            return list(range(after + 1, len(self.phrases)))
        if len(self.search):
            for _, numbers in self.search.iter(text.lower()):
                found.update(numbers)
        return sorted(n for n in found if n > after)

    def phrase(self, text: str, changes: list[str]) -> str:
        text = text.lower().strip(" ")
        tried = self._tried(text, -1)
        while tried:
            n = tried.pop(0)
            pattern, replacement, note = self.phrases[n]
            new = pattern.sub(replacement, text)
            if new != text:
                changes.append(note)
                text, tried = new, self._tried(new, n)
        return text

    def word(self, text: str, category: str, changes: list[str]) -> str:
        tokens, mapping, out = text.split(), self.words[category], []
        around = lambda i, before, after: (" ".join(tokens[max(i - before, 0) : i]).lower(), " ".join(tokens[i + 1 : i + 1 + after]).lower())
        for i, w in enumerate(tokens):
            clean, found = _CLEAN.sub("", w.lower()), None
            if category == "slang" and clean == "well" and "jam" in around(i, 2, 0)[0]:
                found = IN_CONTEXT["well"]
            elif category == "explicit" and clean == "her" and "these" in around(i, 2, 1)[0] and "gon" in around(i, 2, 1)[1]:
                found = IN_CONTEXT["her"]
            elif category == "explicit" and clean == "na" and any(h in "".join(around(i, 3, 2)) for h in CONTEXT_HINTS):
                found = IN_CONTEXT["na"]
            elif category == "explicit" or clean not in CONTEXT_WORDS:
                found = mapping.get(clean)
            out.append(w if found is None else found + w[len(clean) :])
        new = " ".join(out)
        changes += (f"{category}: {_CLEAN.sub('', x.lower())} → {_CLEAN.sub('', y.lower())}" for x, y in zip(tokens, new.split()) if x != y)
        return new

    def correct(self, text: str, aggressive: bool) -> tuple[str, list[str]]:
        """The corrected text and the changes, category by category, in order."""
        changes: list[str] = []
        text = self.phrase(text, changes)
        for category in ("dialect", "slang", "explicit") if aggressive else ("dialect", "slang"):
            text = self.word(text, category, changes)
        return text, changes


def correct_by_table(df: DataFrame, rules: DataFrame, text: str = "text", aggressive: bool = False, with_changes: bool = False) -> DataFrame:
    """df with `corrected`: the text after all rules(category, priority, pattern, replacement), as rules.correct does.

    with_changes adds changes (category: before → after, in order), n_changes and was_modified, as
    rules.correct_with_changes does. rules may be the default ones or what extend_rules made of them:
    MOST_RULES at most, or an error. Null texts stay null, with no changes; columns of these names are
    replaced; without rules texts are lower-cased and trimmed.
    """
    rows = [tuple(r) for r in rules.select("category", "priority", "pattern", "replacement").limit(MOST_RULES + 1).collect()]
    if len(rows) > MOST_RULES:
        raise ValueError(f"more than {MOST_RULES} rules")
    held, key = df.sparkSession.sparkContext.broadcast(rows), uuid.uuid4().hex

    @F.pandas_udf("struct<corrected:string,changes:array<string>>" if with_changes else "struct<corrected:string>")
    def run(texts: pd.Series) -> pd.DataFrame:
        if key not in _COMPILED:
            # a worker holds one table at a time
            _COMPILED.clear()
            _COMPILED[key] = RuleAutomaton(held.value)
        automaton = _COMPILED[key]
        found = [(None, []) if t is None else automaton.correct(t, aggressive) for t in texts]
        return pd.DataFrame(found, columns=["corrected", "changes"])[["corrected", "changes"] if with_changes else ["corrected"]]

    out = df.withColumn("_r", run(text)).withColumn("corrected", F.col("_r.corrected"))
    if with_changes:
        out = out.withColumn("changes", F.col("_r.changes")).withColumn("n_changes", F.size("changes")).withColumn("was_modified", F.size("changes") > 0)
    return out.drop("_r")
