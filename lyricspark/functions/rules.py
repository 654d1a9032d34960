"""Rule-based correction of transcripts: ordered phrases, then words by dialect, slang and context."""

from __future__ import annotations

import re
from collections.abc import Iterable, Mapping

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .constants import CONTEXT_WORDS, DIALECT_RULES, EXPLICIT_RULES, IN_CONTEXT, PHRASE_RULES, SLANG_RULES
from .rule_table import FOLDED, cores
from .text import let, literal_map, strings, words


def _java(replacement: str) -> str:
    return replacement.replace("\\", "\\\\").replace("$", "\\$")


def _guarded(pattern: str) -> str:
    """The same pattern, but a letter behind a leading word boundary is looked at first, as boundaries are slow to tell."""
    return f"(?iU)(?={pattern[2]}){pattern}" if re.match(r"\\b[a-z][^*?{|]", pattern) and "|" not in pattern else f"(?iU){pattern}"


def _phrases(text: Column, rules: Iterable[tuple[str, str]], with_notes: bool = False) -> Column:
    """struct<t> of the text after all rules, in order, with_notes with c, the notes of those that changed it.

    A rule's pattern is only searched for where the texts that each match of it holds are there; letters beyond ASCII
    that match ASCII ones have them all searched for.
    """

    def needed(pattern: str) -> list[str]:
        return [*dict.fromkeys(cores(pattern)), "", "", ""][:3]

    table = F.array(*(
        F.struct(F.lit(_guarded(p)).alias("p"), F.lit(_java(r)).alias("r"), F.lit(f"phrase: '{p}' → '{r}'").alias("note"), *(F.lit(x).alias(f"l{i}") for i, x in enumerate(needed(p))))
        for p, r in rules
    ))
    start = F.trim(F.lower(text))
    if not rules:
        return F.struct(start.alias("t"), F.array().cast("array<string>").alias("c"))
    odd = start.rlike(FOLDED.pattern)

    def step(s: Column, rule: Column) -> Column:
        tried = (F.contains(s["t"], rule["l0"]) & F.contains(s["t"], rule["l1"]) & F.contains(s["t"], rule["l2"])) | s["odd"]

        def changed(new: Column) -> Column:
            notes = F.when(new != s["t"], F.concat(s["c"], F.array(rule["note"]))).otherwise(s["c"]) if with_notes else s["c"]
            return F.struct(new.alias("t"), s["odd"].alias("odd"), notes.alias("c"))

        return F.when(tried, let(F.regexp_replace(s["t"], rule["p"], rule["r"]), changed)).otherwise(s)

    return F.aggregate(table, F.struct(start.alias("t"), F.coalesce(odd, F.lit(False)).alias("odd"), F.array().cast("array<string>").alias("c")), step)


def apply_phrase_rules(text: Column, rules: Iterable[tuple[str, str]] = PHRASE_RULES) -> Column:
    """Lower case, trimmed; each pattern sees what the ones before it left."""
    return _phrases(text, list(rules))["t"]


def _clean(word: Column) -> Column:
    return F.regexp_replace(F.lower(word), r"(?U)[^\w']", "")


def _tail(word: Column, clean: Column) -> Column:
    """What stands behind as many characters as the clean word has."""
    return F.substring(word, F.char_length(clean) + 1, 1 << 30)


def _mapped_words(tokens: Column, mapping: Mapping[str, str], context: Iterable[str], special=lambda w, i, all_, clean: None, cues: Iterable[str] = ()) -> Column:
    """The tokens, of which those are replaced that the mapping, or for the words in `cues` the special rule, knows."""
    context = set(context)
    known = {k: v for k, v in mapping.items() if k not in context}
    table = literal_map(known) if known else None
    # the words of a line are cleaned together: none of them holds a space
    cleaned = F.split(F.regexp_replace(F.lower(F.array_join(tokens, " ")), r"(?U)[^a-z0-9' \w]", ""), " ", -1)

    def one(pair: Column, i: Column) -> Column:
        w, clean = pair["w"], pair["c"]
        # a map is searched from its start, a set isn't
        found = F.when(clean.isin(list(known)), F.element_at(table, clean)) if known else F.lit(None).cast("string")
        extra = special(w, i, tokens, clean)
        if extra is not None:
            found = F.coalesce(extra, found)
        return let(found, lambda f: F.when(f.isNotNull(), F.concat(f, _tail(w, clean))).otherwise(w))

    if not (asked := [*known, *cues]):
        return tokens
    # most lines hold no such word
    some = lambda c: F.when(F.arrays_overlap(c, strings(asked)), F.transform(F.arrays_zip(tokens.alias("w"), c.alias("c")), one)).otherwise(tokens)
    return F.when(F.size(tokens) > 0, let(cleaned, some)).otherwise(tokens)


def _mapped(text: Column, mapping: Mapping[str, str], context: Iterable[str], special=lambda w, i, all_, clean: None, cues: Iterable[str] = ()) -> Column:
    return F.array_join(let(words(text), lambda t: _mapped_words(t, mapping, context, special, cues)), " ")


def apply_dialect_rules(text: Column, mapping: Mapping[str, str] = DIALECT_RULES, context: Iterable[str] = CONTEXT_WORDS) -> Column:
    return _mapped(text, mapping, context)


def _around(tokens: Column, i: Column, before: int, after: int) -> tuple[Column, Column]:
    first = F.greatest(i - before, F.lit(0))
    return F.lower(F.array_join(F.slice(tokens, first + 1, i - first), " ")), F.lower(F.array_join(F.slice(tokens, i + 2, F.lit(after)), " "))


def _jam(w: Column, i: Column, tokens: Column, clean: Column) -> Column:
    return F.when((clean == "well") & F.contains(_around(tokens, i, 2, 0)[0], F.lit("jam")), F.lit(IN_CONTEXT["well"]))


def apply_slang_rules(text: Column, mapping: Mapping[str, str] = SLANG_RULES, context: Iterable[str] = CONTEXT_WORDS) -> Column:
    """As the dialect rules; well becomes 12 only where jam stands in the two words before."""
    return _mapped(text, mapping, context, _jam, ("well",))


def _near(w: Column, i: Column, tokens: Column, clean: Column) -> Column:
    b2, a1 = _around(tokens, i, 2, 1)
    b3, a2 = _around(tokens, i, 3, 2)
    near = F.concat(b3, a2)
    hinted = near.rlike("try|gang|jam|young|ass|can't")
    return F.when((clean == "her") & F.contains(b2, F.lit("these")) & F.contains(a1, F.lit("gon")), F.lit(IN_CONTEXT["her"])).when((clean == "na") & hinted, F.lit(IN_CONTEXT["na"]))


def apply_explicit_rules(text: Column, mapping: Mapping[str, str] = EXPLICIT_RULES) -> Column:
    """Two context rules, then the map; the contexts are joined without a space in between."""
    return _mapped(text, mapping, (), _near, ("her", "na"))


def correct(text: Column, aggressive: bool = False, phrases: Iterable[tuple[str, str]] = PHRASE_RULES, dialect: Mapping[str, str] = DIALECT_RULES, slang: Mapping[str, str] = SLANG_RULES, explicit: Mapping[str, str] = EXPLICIT_RULES) -> Column:
    out = apply_phrase_rules(text, phrases)
    if any(v == "" or re.search(r"\s", v) for v in dialect.values()):
        out = apply_slang_rules(apply_dialect_rules(out, dialect), slang)
    else:
        # no word falls apart, so a text is split once
        mapped = let(words(out), lambda t: let(_mapped_words(t, dialect, CONTEXT_WORDS), lambda u: _mapped_words(u, slang, CONTEXT_WORDS, _jam, ("well",))))
        out = F.array_join(mapped, " ")
    return apply_explicit_rules(out, explicit) if aggressive else out


def _wider(pattern: str) -> str | None:
    """A pattern of plain characters that is found wherever this one is; none where nothing is known of it."""
    wide = pattern.replace(r"\b", "").replace(r"\s+", "[^a-z0-9]+")
    if re.fullmatch(r"[a-z' ,?]+", wide.replace("[^a-z0-9]+", " ")) and re.match(r"[a-z'](?!\?)", wide):
        return wide
    longest = max(cores(pattern), key=len, default="")
    return re.escape(longest) if re.fullmatch(r"[a-z' ]+", longest) else None


def may_change(text: Column, phrases: Iterable[tuple[str, str]] = PHRASE_RULES, dialect: Mapping[str, str] = DIALECT_RULES, slang: Mapping[str, str] = SLANG_RULES) -> Column:
    """False where `correct`, not aggressive, leaves the words of a text as they are in lower case: no rule's phrase or word can be there."""
    wide = [_wider(p) for p, _ in phrases]
    asked = sorted({*dialect, *slang, "well"})
    known = None not in wide and all(re.fullmatch(r"[a-z0-9']+", w) for w in asked)
    phrase, word = "|".join(map(str, wide)) or "[^\\s\\S]", f"(?:^|\\s)(?:{'|'.join(asked)})(?:\\s|$)"

    @F.arrow_udf("boolean")
    def run(t: pa.Array) -> pa.Array:
        if not known:
            return pa.array([True] * len(t))
        low = pc.utf8_lower(t)
        # a word is looked for among the letters that stay of it, whatever white space is around
        bare = pc.replace_substring_regex(pc.replace_substring_regex(low, r"[\s\x0B\x{85}\pZ]+", " "), "[^a-z0-9' ]", "")
        tried = pc.or_(pc.match_substring_regex(low, phrase), pc.match_substring_regex(bare, word))
        return pc.fill_null(pc.or_(tried, pc.match_substring_regex(t, FOLDED.pattern)), False)

    return run(text)


def correct_with_changes(df: DataFrame, text: str = "text", aggressive: bool = False) -> DataFrame:
    """df with corrected, changes (category: before → after, in order), n_changes and was_modified.

    Each step is a column of its own; word steps compare the words before and after, phrase steps the
    text before and after every rule, folded through the ordered rules.
    """
    phrase = _phrases(F.col(text), PHRASE_RULES, True)

    steps = [("dialect", DIALECT_RULES, CONTEXT_WORDS, lambda *_: None, ()), ("slang", SLANG_RULES, CONTEXT_WORDS, _jam, ("well",)), ("explicit", EXPLICIT_RULES, (), _near, ("her", "na"))]
    # the tables' words hold no space, so a text is split once
    out = df.withColumn("_p", phrase).withColumn("_w0", words(F.col("_p.t")))
    changes, last = [F.col("_p.c")], "_w0"
    for n, (kind, *rest) in enumerate(steps[: 3 if aggressive else 2], 1):
        out = out.withColumn(f"_w{n}", _mapped_words(F.col(last), *rest))
        pairs = F.filter(F.arrays_zip(F.col(last).alias("x"), F.col(f"_w{n}").alias("y")), lambda p: p["x"] != p["y"])
        head = F.lit(f"{kind}: ")
        changes.append(F.transform(pairs, lambda p: F.concat(head, _clean(p["x"]), F.lit(" → "), _clean(p["y"]))))  # noqa: B023
        last = f"_w{n}"
    out = out.withColumn("corrected", F.array_join(last, " ")).withColumn("changes", F.concat(*changes))
    out = out.withColumn("n_changes", F.size("changes")).withColumn("was_modified", F.size("changes") > 0)
    return out.drop("_p", "_w0", "_w1", "_w2", "_w3")


def rule_table(spark: SparkSession) -> DataFrame:
    """(category, priority, pattern, replacement): the default rules as rows."""
    rows = [("phrase", i, p, r) for i, (p, r) in enumerate(PHRASE_RULES)]
    for category, mapping in (("dialect", DIALECT_RULES), ("slang", SLANG_RULES), ("explicit", EXPLICIT_RULES)):
        rows += [(category, i, p, r) for i, (p, r) in enumerate(mapping.items())]
    return spark.createDataFrame(rows, "category string, priority int, pattern string, replacement string")


def extend_rules(rules: DataFrame, custom: DataFrame) -> DataFrame:
    """Custom word rules replace those of the same category and pattern, in lower case; phrases come last."""
    last = rules.groupBy("category").agg(F.max("priority").alias("last"))
    added = custom.withColumn("pattern", F.when(F.col("category") == "phrase", F.col("pattern")).otherwise(F.lower("pattern"))).withColumn("replacement", F.when(F.col("category") == "phrase", F.col("replacement")).otherwise(F.lower("replacement")))
    added = added.join(F.broadcast(last), "category", "left").withColumn("priority", F.col("priority") + F.coalesce("last", F.lit(0)) + 1).drop("last")
    every = rules.withColumn("_new", F.lit(0)).unionByName(added.withColumn("_new", F.lit(1)))
    order = Window.partitionBy("category", "pattern").orderBy(F.desc("_new"), F.desc("priority"))
    return every.withColumn("_n", F.row_number().over(order)).filter((F.col("_n") == 1) | (F.col("category") == "phrase")).select("category", "priority", "pattern", "replacement")


def rule_stats(rules: DataFrame) -> DataFrame:
    """Rules by category, and in total."""
    return rules.rollup("category").agg(F.count("*").alias("rules")).select(F.coalesce("category", F.lit("total")).alias("category"), "rules")
