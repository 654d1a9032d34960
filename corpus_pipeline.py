"""The corpus pipeline: five stages from raw documents to token digests.

Each stage takes (spark, docs, sf_dir) and works on all that the one before it kept. All but the last
return the columns of documents. run() writes every stage's result as Parquet and reads it again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lyricspark.llm.common import keep, read, text_of
from lyricspark.llm.mixing import mix_sources
from lyricspark.llm.ngram_join import jaccard_components
from lyricspark.llm.pieces import encode_pieces
from lyricspark.llm.quality import fit_quality, score_quality
from lyricspark.llm.queries import vocabulary
from lyricspark.llm.secrets import redact, scan_secrets, text_key


def _packed(docs: DataFrame) -> DataFrame:
    """(doc_id, text, _row): a stage's own columns can't clash with what is packed in _row, all but the text."""
    return docs.select("doc_id", "text", F.struct(*(F.col(c) for c in docs.columns if c != "text")).alias("_row"))


def _given(c: str, text: str = "text"):
    """A column of the packed documents."""
    return F.col(text) if c == "text" else F.col("_row").getField(c)


def _unpacked(rows: DataFrame, columns: list[str]) -> DataFrame:
    return rows.select(*(_given(c).alias(c) for c in columns))


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go.

    Null and empty texts are scored like any other, very long ones over their whole length; repeated rows and
    rows with a null doc_id stay or go each by its text; without labels the untrained network decides; an
    empty table stays empty.
    """
    net = fit_quality(docs, read(spark, sf_dir, "labels"))
    return _unpacked(score_quality(_packed(docs), net).filter("predicted = 1"), docs.columns)


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five-word shingles, Jaccard similarity of 0.8) the smallest doc_id stays.

    A node is a pair of doc_id and text, by a 64-bit hash: rows that share a doc_id but not a text are
    judged apart, rows without doc_id are judged by their texts and give way to rows with one, and equal
    rows count as copies, of which one stays, chosen by a hash of all columns. Texts without words are
    copies of nothing. Very long texts are compared as a whole; an empty table stays empty.
    """
    rows = _packed(docs).withColumn("_key", F.xxhash64("doc_id", text_of()))
    groups = jaccard_components(rows.select(F.col("_key").alias("doc_id"), "text"), k=5, similarity=(4, 5)).select(F.col("doc_id").alias("_key"), "component_id").distinct()
    named = rows.select("_key", "doc_id").distinct().join(groups, "_key")
    first = named.groupBy("component_id").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "_key")).alias("f")).select(F.col("f._key").alias("_key"))
    equal = Window.partitionBy("_key").orderBy(F.xxhash64("_row"))
    kept = rows.join(first, "_key", "left_semi").withColumn("_n", F.row_number().over(equal)).filter("_n = 1")
    return _unpacked(kept, docs.columns)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets, and bare occurrences of live ones, are masked in the texts.

    All rows stay, repeated ones and those without doc_id too; n_chars, where there is one, follows the text
    where it changes; null texts stay null; very long texts are masked as a whole; an empty table stays empty.
    """
    found = scan_secrets(docs).filter(F.size("spans") > 0).select(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key"), F.col("spans").alias("_spans")).dropDuplicates(["_id", "_key"])
    rows = _packed(docs)
    joined = rows.join(found, rows["doc_id"].eqNullSafe(found["_id"]) & (text_key() == F.col("_key")), "left")
    clean = F.col("_spans").isNull()
    text = F.when(clean, F.col("text")).otherwise(redact(F.col("text"), F.col("_spans")))
    length = F.when(clean, _given("n_chars")).otherwise(F.char_length("_new").cast("long"))
    return joined.withColumn("_new", text).select(*((length if c == "n_chars" else _given(c, "_new")).alias(c) for c in docs.columns))


def mix_to_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents stand as often as the mix takes them, up to twice; texts without words cost nothing and follow their source's rate.

    Null sources are a source of their own; repeated rows are drawn each on its own; very long texts count by
    all their words; an empty table stays empty.
    """
    carried = {f"_c{i}": c for i, c in enumerate(docs.columns)}
    rows = docs.select("doc_id", "text", "source", *(F.col(c).alias(n) for n, c in carried.items()))
    mixed = mix_sources(rows, weights=(3, 1, 2), share=1.5, most=2, carry=tuple(carried))
    copies = mixed.withColumn("_copy", F.explode(F.array_repeat(F.lit(1), F.col("copies").cast("int"))))
    return copies.select(*(F.col(n).alias(c) for n, c in carried.items()))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """SentencePiece ids and decoded texts, as digests: one row for each row, nulls as empty texts, long ones as a whole; none of an empty table."""
    return encode_pieces(docs, vocabulary("piece_bpe_32k.model"))


STAGES = [
    ("quality classifier", keep_good),
    ("n-gram Jaccard join", keep_one_of_each),
    ("secret scans", redact_secrets),
    ("mixing sources", mix_to_weights),
    ("SentencePiece", encode),
]

#: A trained network decides in the first stage, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = keep(stage(spark, docs, sf_dir), name.replace(" ", "-").lower())
    return docs
