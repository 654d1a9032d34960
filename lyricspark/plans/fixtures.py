"""Inputs that Spark derives from the given tables, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, line_no, text, lang, source, key): every line of every document."""
    docs = read(spark, sf_dir, "documents")
    lines = docs.select("doc_id", "lang", "source", F.posexplode(F.split("text", "\n", -1)).alias("line_no", "text"))
    return lines.withColumn("key", F.concat_ws("-", "doc_id", "line_no"))


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """segments with reference and hypothesis: of each seven words one dropped, of five one reversed, of eleven one doubled."""
    w = F.filter(F.split("text", r"[ \t\r\x0B\f]+"), lambda x: x != "")
    kept = F.flatten(F.transform(w, lambda x, i: F.when(i % 7 == 6, F.array().cast("array<string>")).when(i % 5 == 4, F.array(F.reverse(x))).when(i % 11 == 10, F.array(x, x)).otherwise(F.array(x))))
    out = segments(spark, sf_dir).withColumn("reference", F.col("text")).withColumn("hypothesis", F.array_join(kept, " "))
    return out.withColumn("tags", F.array("lang", "source")).withColumn("model", F.col("doc_id") % 3)


#: Common table expressions of the two.
SEGMENTS_SQL = r"""
lines AS (SELECT doc_id, lang, source, string_split(text, chr(10)) AS ls FROM documents),
segments AS (
  SELECT doc_id, lang, source, CAST(i - 1 AS INTEGER) AS line_no, ls[i] AS text, doc_id || '-' || (i - 1) AS key
  FROM (SELECT doc_id, lang, source, ls, unnest(range(1, len(ls) + 1)) AS i FROM lines)
)"""
PAIRS_SQL = SEGMENTS_SQL + r""",
split AS (SELECT *, list_filter(string_split_regex(text, '[ \t\r\x0B\f]+'), lambda x: x <> '') AS w FROM segments),
pairs AS (
  SELECT doc_id, line_no, lang, source, key, doc_id % 3 AS model, text AS reference,
    array_to_string(flatten([CASE WHEN i % 7 = 6 THEN [] WHEN i % 5 = 4 THEN [reverse(w[i + 1])] WHEN i % 11 = 10 THEN [w[i + 1], w[i + 1]] ELSE [w[i + 1]] END FOR i IN range(len(w))]), ' ') AS hypothesis
  FROM split
)"""
NORMAL = r"trim(regexp_replace(regexp_replace(lower({0}), '[^\p{{L}}\p{{N}}_\s'']', '', 'g'), '\s+', ' ', 'g'))"
NORMAL_SPACE = r"trim(regexp_replace(regexp_replace(lower({0}), '[^\p{{L}}\p{{N}}_\s'']', ' ', 'g'), '\s+', ' ', 'g'))"
ASCII = r"trim(regexp_replace(regexp_replace(lower({0}), '[^a-z0-9\s]', '', 'g'), '\s+', ' ', 'g'))"


def words_sql(normal: str) -> str:
    return f"list_filter(string_split({normal}, ' '), lambda x: x <> '')"
