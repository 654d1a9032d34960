"""Vocabularies, token ids, phonemes and lexicon look-ups."""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lyricspark.functions.constants import PHONEMES, SPECIALS
from lyricspark.functions.text import strings, tokenizer_preprocess, words


def word_counts(df: DataFrame, text: str = "text") -> DataFrame:
    return df.select(F.explode(words(F.col(text))).alias("word")).groupBy("word").agg(F.count("*").alias("n"))


def char_counts(df: DataFrame, text: str = "text") -> DataFrame:
    return df.select(F.explode(F.filter(F.split(text, ""), lambda c: c != "")).alias("char")).groupBy("char").agg(F.count("*").alias("n"))


def vocabulary(df: DataFrame, min_frequency: int = 2, text: str = "text") -> DataFrame:
    return word_counts(df, text).filter(F.col("n") >= min_frequency)


def vocab_stats(df: DataFrame, min_frequency: int = 2, text: str = "text", top: int = 20) -> DataFrame:
    """One row: total_words, unique_words, vocab_size, unique_chars, and top as array<struct<word, n>>."""
    counts = word_counts(df, text)
    numbers = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total_words"), F.count("*").alias("unique_words"), F.count_if(F.col("n") >= min_frequency).alias("vocab_size"))
    best = counts.orderBy(F.desc("n"), "word").limit(top).agg(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("k"), "word", "n"))).alias("t"))
    best = best.select(F.transform("t", lambda x: F.struct(x["word"].alias("word"), x["n"].alias("n"))).alias("top"))
    return numbers.crossJoin(char_counts(df, text).agg(F.count("*").alias("unique_chars"))).crossJoin(best)


def build_vocab(df: DataFrame, vocab_size: int = 8192, min_frequency: int = 2, level: str = "word", domain: Iterable[str] = (), id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, token): specials, then domain tokens, then words or characters by count; ties by first occurrence.

    Corpus tokens are capped at vocab_size less the specials, before domain tokens are added. Ids are
    given to at most vocab_size survivors of the ranking, so that the last window is small.
    """
    spark = df.sparkSession
    prepared = tokenizer_preprocess(F.col(text)) if domain else F.trim(F.regexp_replace(F.lower(text), r"(?U)\s+", " "))
    parts = words(prepared) if level == "word" else F.filter(F.split(prepared, ""), lambda c: c != "")
    tokens = df.select(id_col, F.posexplode(parts).alias("at", "token"))
    ranked = tokens.groupBy("token").agg(F.count("*").alias("n"), F.min(F.struct(id_col, "at")).alias("first")).filter(F.col("n") >= min_frequency)
    domain = list(dict.fromkeys(domain))
    fixed = spark.createDataFrame([(0, i, t) for i, t in enumerate([*SPECIALS, *(d for d in domain if d not in SPECIALS)])], "kind int, at long, token string")
    kept = ranked.orderBy(F.desc("n"), "first").limit(vocab_size - len(SPECIALS))
    corpus = kept.withColumn("at", F.row_number().over(Window.orderBy(F.desc("n"), "first")).cast("long")).select(F.lit(1).alias("kind"), "at", "token")
    every = fixed.unionByName(corpus.join(F.broadcast(fixed.select("token")), "token", "left_anti").select("kind", "at", "token"))
    return every.select((F.row_number().over(Window.orderBy("kind", "at")) - 1).alias("id"), "token")


#: A vocabulary of up to so many entries is looked up in every task; a larger one is joined.
SMALL_VOCAB = 1 << 16


def _table(vocab: DataFrame, key: str, value: str) -> dict | None:
    """The vocabulary as a dict, or None if it has more than SMALL_VOCAB entries."""
    rows = vocab.select(key, value).limit(SMALL_VOCAB + 1).collect()
    return dict(map(tuple, rows)) if len(rows) <= SMALL_VOCAB else None


def _looked_up(lists: pa.Array, table: dict, key: pa.DataType, value: pa.DataType, unknown) -> pa.Array:
    """The lists with the table's value for each item; items never become objects of Python, which take many times their size."""
    at = pc.index_in(lists.flatten().cast(key), value_set=pa.array(list(table), key))
    values = pa.array([*table.values(), unknown], value).take(pc.fill_null(at, len(table)))
    return pa.ListArray.from_arrays(np.cumsum([0, *np.asarray(pc.list_value_length(lists))]).astype(np.int32), values)


def encode(df: DataFrame, vocab: DataFrame, add_special: bool = True, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """df's id and ids: token ids in order, unknown ones 1, within 2 and 3; a row for each row of df, a null text as an empty one."""
    rows = df.select(id_col, F.coalesce(words(tokenizer_preprocess(F.col(text))), F.array().cast("array<string>")).alias("tokens"))
    table = _table(vocab, "token", "id")
    if table is not None:
        held = df.sparkSession.sparkContext.broadcast(table)

        @F.arrow_udf("array<int>")
        def look_up(lists: pa.Array) -> pa.Array:
            return _looked_up(lists, held.value, pa.string(), pa.int32(), 1)

        found = rows.select(id_col, look_up("tokens").alias("ids"))
    else:
        found = _joined(rows, "tokens", vocab, "token", "id", F.lit(1), id_col).withColumnRenamed("values", "ids")
    ids = F.concat(F.array(F.lit(2)), "ids", F.array(F.lit(3))) if add_special else F.col("ids")
    return found.select(id_col, ids.alias("ids"))


def _joined(rows: DataFrame, items: str, vocab: DataFrame, key: str, value: str, unknown: Column, id_col: str) -> DataFrame:
    """rows' id and values: the items looked up by a join, for vocabularies of any size; each row has a key of its own."""
    keyed = rows.withColumn("_row", F.monotonically_increasing_id()).select("_row", id_col, F.posexplode_outer(items).alias("_at", key))
    found = keyed.join(vocab.select(key, F.col(value).alias("_value")), key, "left")
    entry = F.when(F.col("_at").isNotNull(), F.struct("_at", F.coalesce("_value", unknown).alias("v")))
    listed = found.groupBy("_row", id_col).agg(F.array_sort(F.collect_list(entry)).alias("l"))
    return listed.select(id_col, F.transform("l", lambda x: x["v"]).alias("values"))


def decode(df: DataFrame, vocab: DataFrame, skip_special: bool = True, id_col: str = "doc_id") -> DataFrame:
    """df's id and text: tokens joined by spaces, ids 0 to 4 left out, unknown ids as <unk>; a row for each row of df."""
    ids = F.coalesce("ids", F.array().cast("array<int>"))
    rows = df.select(id_col, (F.filter(ids, lambda i: i > 4) if skip_special else ids).alias("ids"))
    table = _table(vocab, "id", "token")
    if table is not None:
        held = df.sparkSession.sparkContext.broadcast(table)

        @F.arrow_udf("string")
        def look_up(lists: pa.Array) -> pa.Array:
            return pc.binary_join(_looked_up(lists, held.value, pa.int64(), pa.string(), "<unk>"), " ")

        return rows.select(id_col, look_up("ids").alias("text"))
    return _joined(rows, "ids", vocab, "id", "token", F.lit("<unk>"), id_col).select(id_col, F.array_join("values", " ").alias("text"))


def encode_phonemes(phonemes: Column, add_special: bool = True) -> Column:
    """Ids in the fixed table; unknown phonemes are 3; within 1 and 2."""
    table = strings(PHONEMES)
    ids = F.transform(phonemes, lambda p: F.when(F.array_position(table, p) > 0, F.array_position(table, p).cast("int") - 1).otherwise(3))
    return F.concat(F.array(F.lit(1)), ids, F.array(F.lit(2))) if add_special else ids


def decode_phonemes(ids: Column, skip_special: bool = True) -> Column:
    table = strings(PHONEMES)
    kept = F.filter(ids, lambda i: i > 4) if skip_special else ids
    return F.transform(kept, lambda i: F.coalesce(F.get(table, i), F.lit("<unk>")))


def ctc_collapse(ids: Column, blank: int = 0) -> Column:
    """Without blanks and consecutive repeats; a repeat behind a blank stays."""
    return F.filter(ids, lambda x, i: (x != blank) & ((i == 0) | (x != F.get(ids, i - 1))))


def lexicon_lookup(words_df: DataFrame, lexicon: DataFrame) -> DataFrame:
    """Every word with its entry, in any case; nulls where there is none."""
    entries = lexicon.select(F.lower("word").alias("_key"), *(F.col(c) for c in lexicon.columns if c != "word"))
    return words_df.join(entries, F.lower(words_df["word"]) == F.col("_key"), "left").drop("_key")


def is_slang(words_df: DataFrame, lexicon: DataFrame) -> DataFrame:
    return words_df.join(lexicon.select(F.lower("word").alias("_key")), F.lower(words_df["word"]) == F.col("_key"), "left_semi")


def add_words(lexicon: DataFrame, new: DataFrame) -> DataFrame:
    """New entries replace old ones of the same word, in lower case; missing lists are empty."""
    both = lexicon.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)), allowMissingColumns=True).withColumn("word", F.lower("word"))
    for c, kind in lexicon.dtypes:
        if kind.startswith("array"):
            both = both.withColumn(c, F.coalesce(c, F.array().cast(kind)))
    order = Window.partitionBy("word").orderBy(F.desc("_new"))
    return both.withColumn("_n", F.row_number().over(order)).filter("_n = 1").drop("_n", "_new")


def pronunciations(words_df: DataFrame, lexicon: DataFrame) -> DataFrame:
    """(word, position, phonemes): the canonical form, then the variants."""
    found = words_df.select("word").distinct().join(lexicon.withColumn("_key", F.lower("word")).drop("word"), F.lower("word") == F.col("_key"))
    return found.select("word", F.posexplode(F.concat(F.array("canonical"), "variants")).alias("position", "phonemes"))


def _deletions(word: Column, k: int) -> Column:
    """The word with up to k characters left out."""
    out = F.array(word)
    for _ in range(k):
        cut = F.flatten(F.transform(out, lambda w: F.when(F.char_length(w) > 0, F.transform(F.sequence(F.lit(1), F.char_length(w)), lambda i: F.concat(F.substring(w, F.lit(1), i - 1), F.substring(w, i + 1, F.lit(1 << 20))))).otherwise(F.array().cast("array<string>"))))
        out = F.array_distinct(F.concat(out, cut))
    return out


def _piece(n: Column, i: int, k: int) -> tuple[Column, Column]:
    """(start, length) of the i-th of k + 1 pieces of n characters, as even as n allows, the longer ones last."""
    rest = n % (k + 1)
    base = ((n - rest) / (k + 1)).cast("int")
    return i * base + F.greatest(rest - (k + 1 - i), F.lit(0)), base + F.when(rest >= k + 1 - i, 1).otherwise(0)


def _at(n: Column, i: int, piece: Column) -> Column:
    return F.struct(n.alias("n"), F.lit(i).alias("i"), piece.alias("piece"))


def _entry_pieces(entry: Column, k: int) -> Column:
    """An entry's k + 1 pieces, each with the entry's length and the piece's number."""
    n = F.char_length(entry)
    cut = [_piece(n, i, k) for i in range(k + 1)]
    return F.array(*(_at(n, i, F.substring(entry, start + 1, size)) for i, (start, size) in enumerate(cut)))


def _word_pieces(word: Column, k: int, above: int) -> Column:
    """What a word has where an entry of more than `above` characters may have an unchanged piece; nulls where it has nothing.

    A piece that stands x characters further on in the word, which is d characters longer, leaves
    |x| + |d - x| edits at least, so the places number about k^2 for each piece, however long the word.
    """
    n, out = F.char_length(word), []
    for d in range(-k, k + 1):
        size = n - d
        for i in range(k + 1):
            start, length = _piece(size, i, k)
            for x in range(-k, k + 1):
                if abs(x) + abs(d - x) <= k:
                    fits = (size > above) & (start + x >= 0) & (start + x + length <= n)
                    out.append(F.when(fits, _at(size, i, F.substring(word, start + x + 1, length))))
    return F.array(*out)


def fuzzy_lookup(words_df: DataFrame, lexicon: DataFrame, max_distance: int = 2, short: int = 10) -> DataFrame:
    """(word, entry, distance): lexicon words within an edit distance, both in lower case; each pair once.

    Of an entry cut into max_distance + 1 pieces one is unchanged in any word that near, a little further on
    or back, so words meet longer entries by an equi-join on pieces, and the distance is then checked.
    Pieces of short entries would say little: up to `short` characters, entries and words meet on forms with up
    to max_distance characters left out, of which short words have few. Null words take no part.
    """
    k, short = max_distance, max(max_distance, short)
    w = words_df.select(F.lower("word").alias("word")).filter("word is not null").distinct()
    # words are small and their pieces many: as many tasks as there are partitions, however few bytes
    w = w.repartition(int(words_df.sparkSession.conf.get("spark.sql.shuffle.partitions")), F.xxhash64("word"))
    e = lexicon.select(F.lower("word").alias("entry")).filter("entry is not null").distinct()
    size = F.char_length
    # a projection of its own: what an explode holds isn't compiled
    cut = w.filter(size("word") > short - k).withColumn("at", _word_pieces(F.col("word"), k, short)).withColumn("at", F.explode("at")).filter("at is not null")
    met = cut.join(e.filter(size("entry") > short).withColumn("at", _entry_pieces(F.col("entry"), k)).withColumn("at", F.explode("at")), "at")
    few_words, few_entries = (d.filter(size(c) <= most).withColumn("at", F.explode(_deletions(F.col(c), k))) for d, c, most in ((w, "word", short + k), (e, "entry", short)))
    few = few_words.join(few_entries, "at")
    near = met.select("word", "entry").unionByName(few.select("word", "entry")).withColumn("distance", F.levenshtein("word", "entry", k))
    # pairs that meet on several pieces are dropped after the check, so that few are shuffled
    return near.filter(F.col("distance") >= 0).distinct()
