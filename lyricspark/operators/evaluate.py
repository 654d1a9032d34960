"""Evaluation of transcripts: per-sample metrics, error rows, summaries and reports."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lyricspark.functions.align import align_errors, distances, edit_ops, error_rates
from lyricspark.functions.match import match_alignments, match_words
from lyricspark.functions.metrics import char_rate, error_category, normalize_delete, term_accuracy, wer
from lyricspark.functions.rules import correct, may_change
from lyricspark.functions.text import let, tokenize, words


def sample_metrics(df: DataFrame, ref: str = "reference", hyp: str = "hypothesis") -> DataFrame:
    """df with wer, cer, accuracies, insertions, deletions, substitutions and word and character counts; nulls count as empty."""
    out = df.withColumns({f"_n{c[0]}": normalize_delete(F.coalesce(F.col(c[1]), F.lit(""))) for c in (("r", ref), ("h", hyp))})
    out = out.select("*", F.inline(F.array(edit_ops(words(F.col("_nr")), words(F.col("_nh"))))))
    out = out.withColumns({"cer": char_rate(F.col("_nr"), F.col("_nh")), "ref_chars": F.char_length("_nr"), "hyp_chars": F.char_length("_nh")})
    # the words of an empty reference count as the rate itself
    out = out.withColumn("wer", (F.col("insertions") + F.col("deletions") + F.col("substitutions")) / F.greatest("ref_words", F.lit(1)))
    out = out.withColumn("word_accuracy", F.greatest(F.lit(0.0), 1 - F.col("wer"))).withColumn("char_accuracy", F.greatest(F.lit(0.0), 1 - F.col("cer")))
    rates = ["cer", "insertions", "deletions", "substitutions", "ref_words", "hyp_words", "ref_chars", "hyp_chars", "wer", "word_accuracy", "char_accuracy"]
    return out.select(*df.columns, *rates)


def word_errors(df: DataFrame, ref: str = "reference", hyp: str = "hypothesis") -> DataFrame:
    """df with errors and ref_words."""
    r, h = tokenize(F.coalesce(F.col(ref), F.lit(""))), tokenize(F.coalesce(F.col(hyp), F.lit("")))
    # through a generator, so that the optimizer doesn't put the distance in each place that names a field of it
    return df.select("*", F.inline(F.array(distances(r, h))))


def batch_metrics(metrics: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Micro and macro rates and totals by key; character errors are whole numbers, cut off, of each row."""
    errors = F.col("insertions") + F.col("deletions") + F.col("substitutions")
    chars = F.floor(F.col("cer") * F.col("ref_chars"))
    out = metrics.groupBy(*keys).agg(
        F.count("*").alias("samples"), F.sum(errors).alias("total_errors"), F.sum("ref_words").alias("total_ref_words"), F.sum(chars).alias("char_errors"), F.sum("ref_chars").alias("total_ref_chars"),
        F.avg("wer").alias("macro_wer"), F.avg("cer").alias("macro_cer"), F.sum("insertions").alias("insertions"), F.sum("deletions").alias("deletions"), F.sum("substitutions").alias("substitutions"),
    )
    out = out.withColumn("wer", F.col("total_errors") / F.greatest("total_ref_words", F.lit(1))).withColumn("cer", F.col("char_errors") / F.greatest("total_ref_chars", F.lit(1)))
    return out.withColumn("word_accuracy", 1 - F.col("wer")).withColumn("char_accuracy", 1 - F.col("cer"))


def running_metrics(df: DataFrame, keys: Sequence[str], order: Sequence[str], values: Sequence[str] = ("wer", "cer")) -> DataFrame:
    """Count and means of each key's rows up to each one, in order."""
    so_far = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.select("*", F.count("*").over(so_far).alias("seen"), *(F.avg(v).over(so_far).alias(f"running_{v}") for v in values))


def error_rows(df: DataFrame, ids: Sequence[str], ref: str = "reference", hyp: str = "hypothesis", keep: Sequence[str] = ()) -> DataFrame:
    """One row for each wrong word of the alignment: ids, position, op, ref_word, hyp_word, category."""
    r, h = (tokenize(F.coalesce(F.col(c), F.lit(""))) for c in (ref, hyp))
    rows = df.select(*ids, *keep, F.explode(align_errors(r, h)).alias("a")).select(*ids, *keep, "a.*")
    return rows.withColumn("category", error_category(F.col("op"), F.col("ref_word"), F.col("hyp_word")))


def overall_summary(df: DataFrame) -> DataFrame:
    return df.agg(F.count("*").alias("samples"), F.avg("wer").alias("avg_wer"), F.sum("errors").alias("total_errors"), F.sum("ref_words").alias("total_words"))


def category_shares(errors: DataFrame) -> DataFrame:
    counts = errors.groupBy("category").agg(F.count("*").alias("n"))
    total = counts.agg(F.greatest(F.sum("n"), F.lit(1)).alias("total"))
    return counts.crossJoin(F.broadcast(total)).select("category", "n", (F.col("n") / F.col("total") * 100).alias("pct"))


def rate_by_tag(df: DataFrame, tags: str = "tags", value: str = "wer") -> DataFrame:
    return df.select(F.explode(tags).alias("tag"), value).groupBy("tag").agg(F.avg(value).alias(f"avg_{value}"), F.count("*").alias("samples"))


def top_substitutions(errors: DataFrame, k: int = 20) -> DataFrame:
    swapped = errors.filter("op = 'substitution' and ref_word <> '' and hyp_word <> ''")
    return swapped.groupBy(F.lower("ref_word").alias("ref_word"), F.lower("hyp_word").alias("hyp_word")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "ref_word", "hyp_word").limit(k)


def category_examples(errors: DataFrame, ids: Sequence[str], k: int = 5) -> DataFrame:
    order = Window.partitionBy(*ids, "category").orderBy("position")
    return errors.withColumn("example", F.row_number().over(order)).filter(F.col("example") <= k)


def rank_samples(df: DataFrame, ids: Sequence[str], k: int = 3, value: str = "wer") -> DataFrame:
    """The k worst and the k best samples."""
    worst = df.orderBy(F.desc(value), *ids).limit(k).withColumn("side", F.lit("worst"))
    return worst.unionByName(df.orderBy(value, *ids).limit(k).withColumn("side", F.lit("best")))


#: Advice: category, share in percent above which it is due, text.
ADVICE = (("slang_miss", 20, "extend the slang lexicon"), ("hallucination", 15, "filter silent audio"), ("dropped_word", 20, "segment more finely"), ("adlib_miss", 10, "add ad-lib data"))


def recommendations(shares: DataFrame, advice: Iterable[tuple[str, int, str]] = ADVICE) -> DataFrame:
    """The categories above their limits, and the largest of all."""
    due = F.coalesce(*(F.when((F.col("category") == c) & (F.col("pct") > limit), F.lit(t)) for c, limit, t in advice))
    biggest = shares.agg(F.max(F.struct("n", "category")).alias("b"))
    return shares.crossJoin(F.broadcast(biggest)).select("category", "pct", due.alias("advice"), (F.col("category") == F.col("b.category")).alias("biggest")).filter("advice is not null or biggest")


def compare_models(metrics: DataFrame, model: str = "model", seconds: str | None = None) -> DataFrame:
    """Rates and errors by model, the best one marked (the first by name on ties), and with `seconds` the total and mean time of its samples.

    Samples without a time count as samples alone; a model without any time has none.
    """
    by = batch_metrics(metrics, [model]).select(model, "wer", "total_errors", "substitutions", "insertions", "deletions")
    best = by.agg(F.min_by(model, F.struct("wer", model)).alias("_best"))
    out = by.crossJoin(F.broadcast(best)).withColumn("best", F.col(model) == F.col("_best")).drop("_best")
    if seconds is None:
        return out
    times = metrics.groupBy(F.col(model).alias("_model")).agg(F.sum(seconds).alias("total_seconds"), F.avg(seconds).alias("avg_seconds"))
    return out.join(times, F.col(model).eqNullSafe(F.col("_model")), "left").drop("_model")


def category_changes(df: DataFrame, ref: str = "reference", hyp: str = "hypothesis", aggressive: bool = False) -> DataFrame:
    """(category, before, after, fixed, pct_fixed): the error rows by category before and after correction.

    A category that is found on one side alone counts 0 on the other; pct_fixed is 0 where nothing was there before.
    """
    sides = df.select(ref, F.explode(F.array(F.struct(F.lit(0).alias("side"), F.col(hyp).alias("said")), F.struct(F.lit(1).alias("side"), correct(F.col(hyp), aggressive).alias("said")))).alias("v")).select(ref, "v.side", "v.said")
    rows = error_rows(sides, ["side"], ref, "said")
    counts = rows.groupBy("category").agg(F.count_if(F.col("side") == 0).alias("before"), F.count_if(F.col("side") == 1).alias("after"))
    fixed = F.col("before") - F.col("after")
    return counts.withColumn("fixed", fixed).withColumn("pct_fixed", F.when(F.col("before") > 0, F.col("fixed") / F.col("before") * 100).otherwise(0.0))


def before_after(df: DataFrame, ref: str = "reference", hyp: str = "hypothesis", aggressive: bool = False) -> DataFrame:
    """df with wer and errors before and after correction, their reductions and the improvement in percent."""
    out = df.withColumn("_after", correct(F.col(hyp), aggressive))
    out = word_errors(out, ref, hyp).withColumnRenamed("errors", "errors_before").drop("ref_words")
    out = word_errors(out, ref, "_after").withColumnRenamed("errors", "errors_after")
    rate = lambda e: F.bround(F.col(e) / F.greatest("ref_words", F.lit(1)), 4)
    out = out.withColumn("wer_before", rate("errors_before")).withColumn("wer_after", rate("errors_after")).withColumn("wer_reduction", F.col("wer_before") - F.col("wer_after")).withColumn("errors_fixed", F.col("errors_before") - F.col("errors_after"))
    return out.withColumn("pct_improvement", F.when(F.col("wer_before") > 0, F.col("wer_reduction") / F.col("wer_before") * 100).otherwise(0.0)).drop("_after")


def match_lyrics(df: DataFrame, trans: str = "hypothesis", ref: str = "reference", phonetic_threshold: float = 0.6, prefer_reference: bool = True) -> DataFrame:
    """df with matched, confidence, alignments, stats and the word error rates before and after: the transcript corrected by reference lyrics."""
    t, r = tokenize(F.coalesce(F.col(trans), F.lit("")), "space"), tokenize(F.coalesce(F.col(ref), F.lit("")), "space")
    out = df.withColumn("_t", t).withColumn("_r", r)
    # the alignments are a function of their own, which isn't run where nothing asks for them
    out = out.withColumn("alignments", match_alignments(F.col("_t"), F.col("_r"), phonetic_threshold, prefer_reference))
    out = out.select("*", F.inline(F.array(match_words(F.col("_t"), F.col("_r"), phonetic_threshold, prefer_reference).alias("m"))).alias(*(f"_m{i}" for i in range(9))))
    no_t, no_r = F.size("_t") == 0, F.size("_r") == 0
    matched, sure, exact, corrections, phonetic, uncertain, total, before, after = (F.col(f"_m{i}") for i in range(9))
    confidence = F.when(no_t & no_r, 1.0).when(no_r, 0.5).when(no_t, 0.3).otherwise(sure / total)
    stats = F.struct(exact.alias("exact"), corrections.alias("corrections"), phonetic.alias("phonetic"), uncertain.alias("uncertain"), total.alias("total"))
    out = out.withColumn("matched", matched).withColumn("confidence", confidence).withColumn("stats", stats)
    rate = lambda errors: F.when(no_r, 0.0).otherwise(errors / F.size("_r"))
    out = out.withColumn("wer_before", rate(before)).withColumn("wer_after", F.when(no_t, 0.0).otherwise(rate(after)))
    return out.drop("_t", "_r", *(f"_m{i}" for i in range(9)))


def stage_report(df: DataFrame, ids: Sequence[str], ref: str = "reference", hyp: str = "hypothesis", matched: str | None = None) -> DataFrame:
    """Per sample the word error rate of the raw, the corrected and the matched text.

    The text matched against lyrics is that of the column `matched`, or the corrected one without it.
    """
    out = df.withColumn("_c", correct(F.col(hyp)))
    rates = [(hyp, "raw"), ("_c", "corrected"), (matched or "_c", "matched")]
    for c, name in rates:
        # through a generator, as in word_errors
        out = out.select("*", F.explode(F.array(wer(F.col(ref), F.col(c), profile="space", empty_ref="one"))).alias(f"wer_{name}"))
    return out.select(*ids, *(f"wer_{n}" for _, n in rates), (F.col("wer_raw") - F.col("wer_matched")).alias("reduction"))


def matched_stage_report(df: DataFrame, ids: Sequence[str], ref: str = "reference", hyp: str = "hypothesis", phonetic_threshold: float = 0.6, prefer_reference: bool = True) -> DataFrame:
    """stage_report of match_lyrics in one go: each text is split once, and the matched words aren't split and compared anew."""
    t, r = (tokenize(F.coalesce(F.col(c), F.lit("")), "space") for c in (hyp, ref))
    out = df.select("*", t.alias("_t"), r.alias("_r"))
    out = out.select("*", F.inline(F.array(match_words(F.col("_t"), F.col("_r"), phonetic_threshold, prefer_reference).alias("m"))).alias(*(f"_m{i}" for i in range(9))))
    # where no rule changes a text, its words and errors stay as they are
    plain = F.array_join(words(F.trim(F.lower(hyp))), " ")
    out = out.withColumn("_c", F.when(may_change(F.col(hyp)), let(correct(F.col(hyp)), lambda c: F.when(c != plain, tokenize(c, "space")))))
    out = out.select("*", F.explode(F.array(error_rates(F.when(F.col("_c").isNotNull(), F.col("_r")), F.col("_c"), "one"))).alias("_corrected"))

    def rate(errors: str, empty: Column) -> Column:
        return F.when(F.col(ref).isNotNull(), F.when(F.size("_r") > 0, F.col(errors) / F.size("_r")).when(empty, 0.0).otherwise(1.0))

    no_t = F.size("_t") == 0
    raw = rate("_m7", no_t & F.col(hyp).isNotNull())
    corrected = F.when(F.col("_c").isNull(), raw).when(F.col(ref).isNotNull(), F.col("_corrected"))
    out = out.withColumns({"wer_raw": raw, "wer_corrected": corrected, "wer_matched": rate("_m8", no_t)})
    return out.select(*ids, "wer_raw", "wer_corrected", "wer_matched", (F.col("wer_raw") - F.col("wer_matched")).alias("reduction"))


def stage_averages(report: DataFrame) -> DataFrame:
    """One row: the mean rate of each stage, and how much the last one is below the first."""
    out = report.agg(F.count("*").alias("samples"), *(F.avg(f"wer_{n}").alias(f"wer_{n}") for n in ("raw", "corrected", "matched")))
    return out.withColumn("reduction", F.col("wer_raw") - F.col("wer_matched"))


def batch_term_accuracy(df: DataFrame, terms: Iterable[str], keys: Sequence[str] = (), ref: str = "reference", hyp: str = "hypothesis") -> DataFrame:
    """Recall, precision and F1 by key: distinct correct terms of each row over term tokens."""
    s = df.withColumn("_s", term_accuracy(F.col(ref), F.col(hyp), list(terms), None))
    out = s.groupBy(*keys).agg(F.sum(F.size("_s.correct")).alias("correct"), F.sum(F.size("_s.ref_terms")).alias("ref_terms"), F.sum(F.size("_s.hyp_terms")).alias("hyp_terms"))
    recall = F.when(F.col("ref_terms") == 0, 1.0).otherwise(F.col("correct") / F.col("ref_terms"))
    precision = F.when(F.col("hyp_terms") == 0, 1.0).otherwise(F.col("correct") / F.col("hyp_terms"))
    out = out.withColumn("recall", recall).withColumn("precision", precision)
    return out.withColumn("f1", F.when(F.col("recall") + F.col("precision") == 0, 0.0).otherwise(2 * F.col("recall") * F.col("precision") / (F.col("recall") + F.col("precision"))))


def most_missed(df: DataFrame, terms: Iterable[str], k: int = 10, ref: str = "reference", hyp: str = "hypothesis") -> DataFrame:
    missed = df.select(F.explode(term_accuracy(F.col(ref), F.col(hyp), list(terms), None)["missed"]).alias("term"))
    return missed.groupBy("term").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "term").limit(k)
