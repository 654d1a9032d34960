"""Secret scans with corpus-wide ownership frequency, in DataFrame operations only.

Patterns find candidate credentials in each text. The hashes of the candidates are aggregated over
the corpus by distinct repositories and owners: a value that many owners hold is a copied example;
one that a single owner holds, and that looks like a credential, is live. Every bare occurrence of a
live value is then marked as well, also where no pattern caught it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import keep, text_of

ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
#: Bare runs that may repeat a value found elsewhere.
BARE = r"[A-Za-z0-9+/_.=-]{16,}"
#: Kinds in the order of ties.
KINDS = ("assign", "access", "hex", "live")
_MAYBE = r"(?i:password|passwd|secret|token|api_?key)|AKIA[A-Z0-9]|[0-9a-f]{24}|[A-Za-z0-9+/_.=-]{16}"
_CUT, _INSTEAD = "￿", "�"


def matches(text: Column, pattern: str) -> Column:
    """All leftmost non-overlapping matches as array<struct<start, end, value>>, in code points, end exclusive.

    text must not hold U+FFFF: the matches are cut out at such marks, and their places are running
    sums of the lengths of the parts.
    """
    parts = F.split(F.regexp_replace(text, pattern, f"{_CUT}$0{_CUT}"), _CUT, -1)
    zero = F.struct(F.lit(0).alias("at"), F.lit(False).alias("hit"), F.array().cast("array<struct<start:int,end:int,value:string>>").alias("found"))

    def step(state: Column, part: Column) -> Column:
        end = (state["at"] + F.char_length(part)).cast("int")
        one = F.array(F.struct(state["at"].alias("start"), end.alias("end"), part.alias("value")))
        return F.struct(end.alias("at"), (~state["hit"]).alias("hit"), F.when(state["hit"], F.concat(state["found"], one)).otherwise(state["found"]).alias("found"))

    return F.aggregate(parts, zero, step, lambda s: s["found"])


def _listed(spans: Column) -> Column:
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", F.element_at(F.array(*(F.lit(k) for k in KINDS)), s["kind"] + 1), s["start"], s["end"])))


def text_key(column: str = "text") -> Column:
    """The hash that names a row's text in the result of scan_secrets."""
    return F.xxhash64(F.translate(text_of(column), _CUT, _INSTEAD))


def scan_secrets(docs: DataFrame, owner: str = "source", repository: str = "doc_id", examples_from: int = 3, copies_from: int = 50, least_length: int = 16, least_distinct: int = 8) -> DataFrame:
    """(doc_id, text_key, n_assign, n_access, n_hex, n_live, base, spans) for each row of docs(doc_id, text, owner).

    base is the array of struct<start, kind, end> of the pattern matches that hold (assign values of 6
    characters, access keys of 20, hex runs of 24 at least); spans has those and the live ones. A value
    is an example when `examples_from` owners or `copies_from` repositories hold it; it is live when a
    single owner holds it, in fewer repositories, a pattern caught it somewhere, and it has
    `least_length` characters and `least_distinct` different ones, letters and digits among them.
    n_copied counts the row's places that hold an example.

    Null texts count as empty; a null owner or repository is one of its own; equal rows each keep their
    result; other columns are ignored; an empty table gives an empty result. text_key is a hash of the text.
    """
    rows = docs.select(F.col("doc_id"), F.col(repository).cast("string").alias("repository"), F.col(owner).cast("string").alias("owner"), F.translate(text_of(), _CUT, _INSTEAD).alias("text"))
    none = F.array().cast("array<struct<start:int,end:int,value:string>>")
    rows = rows.withColumn("maybe", F.col("text").rlike(_MAYBE)).withColumn("text_key", text_key())

    def found(pattern: str, hint: str) -> Column:
        return F.when(F.col("maybe") & F.col("text").rlike(hint), matches(F.col("text"), pattern)).otherwise(none)

    scanned = rows.select(
        "doc_id", "repository", "owner", "text_key",
        F.filter(F.transform(found(ASSIGN, r"(?i:password|passwd|secret|token|api_?key)"), lambda m: F.struct(m["start"].alias("start"), m["end"].alias("end"), F.regexp_extract(m["value"], ASSIGN, 2).alias("value"))), lambda m: F.length(m["value"]) >= 6).alias("assign"),
        F.filter(found(ACCESS, "AKIA[A-Z0-9]"), lambda m: F.length(m["value"]) >= 20).alias("access"),
        found(r"[0-9a-f]{24,}", "[0-9a-f]{24}").alias("hex"),
        F.filter(found(BARE, r"[A-Za-z0-9+/_.=-]{16}"), lambda m: m["value"].rlike("[0-9]") & m["value"].rlike("[A-Za-z]")).alias("bare"),
    )

    def spans(kind: int) -> Column:
        return F.transform(KINDS[kind], lambda m: F.struct(m["start"].alias("start"), F.lit(kind).alias("kind"), m["end"].alias("end")))

    def values(kind: str, caught: bool) -> Column:
        # a value ends where its match ends
        return F.transform(kind, lambda m: F.struct(F.sha2(m["value"], 256).alias("hash"), m["value"].alias("value"), (m["end"] - F.length(m["value"])).cast("int").alias("start"), m["end"].alias("end"), F.lit(caught).alias("caught")))

    base = F.array_sort(F.concat(spans(0), spans(1), spans(2)))
    occurs = F.concat(values("assign", True), values("access", True), values("hex", True), values("bare", False))
    scanned = keep(scanned.select("doc_id", "repository", "owner", "text_key", base.alias("base"), *(F.size(k).cast("long").alias(f"n_{k}") for k in KINDS[:3]), occurs.alias("occurs")), "scanned")

    seen = scanned.select("doc_id", "repository", "owner", "text_key", F.explode("occurs").alias("o")).select("doc_id", "repository", "owner", "text_key", "o.*")
    looks = (F.length("value") >= least_length) & (F.size(F.array_distinct(F.split("value", ""))) >= least_distinct) & F.col("value").rlike("[0-9]") & F.col("value").rlike("[A-Za-z]")
    by_repository = seen.groupBy("hash", "owner", "repository").agg(F.max("caught").alias("caught"), F.max(looks).alias("looks"))
    by_owner = by_repository.groupBy("hash", "owner").agg(F.count("*").alias("repositories"), F.max("caught").alias("caught"), F.max("looks").alias("looks"))
    owned = by_owner.groupBy("hash").agg(F.count("*").alias("owners"), F.sum("repositories").alias("repositories"), F.max("caught").alias("caught"), F.max("looks").alias("looks"))
    live = owned.filter((F.col("owners") == 1) & (F.col("repositories") < copies_from) & F.col("caught") & F.col("looks")).select("hash", F.lit(True).alias("live"))
    copied = owned.filter((F.col("owners") >= examples_from) | (F.col("repositories") >= copies_from)).select("hash", F.lit(False).alias("live"))
    marked = (
        seen.select("doc_id", "text_key", "hash", "start", "end").distinct().join(live.union(copied), "hash")
        .groupBy("doc_id", "text_key").agg(
            F.collect_set(F.when(F.col("live"), F.struct(F.col("start"), F.lit(3).alias("kind"), F.col("end")))).alias("live"),
            F.count_if(~F.col("live")).alias("n_copied"),
        )
    )
    left, right = scanned.drop("occurs", "repository", "owner").alias("l"), marked.alias("r")
    out = left.join(right, F.col("l.doc_id").eqNullSafe(F.col("r.doc_id")) & (F.col("l.text_key") == F.col("r.text_key")), "left")
    extra = F.coalesce(F.col("r.live"), F.array().cast("array<struct<start:int,kind:int,end:int>>"))
    return out.select(
        "l.doc_id", "l.text_key", "n_assign", "n_access", "n_hex", F.size(extra).cast("long").alias("n_live"), F.coalesce("n_copied", F.lit(0)).alias("n_copied"),
        "base", F.array_sort(F.concat("base", extra)).alias("spans"),
    )


def digest(scanned: DataFrame) -> DataFrame:
    """The scan's result with spans written as kind:start:end, and the hash of the base ones."""
    return scanned.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2(_listed(F.col("base")), 256).alias("base_sha256"), _listed(F.col("spans")).alias("spans"), "n_live", "n_copied")


def redact(text: Column, spans: Column, mask: str = "[secret]") -> Column:
    """text with every span, and what overlapping spans cover together, replaced by the mask."""
    zero = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(state: Column, s: Column) -> Column:
        new = s["start"] >= state["at"]
        before = F.substring(text, state["at"] + 1, F.greatest(s["start"] - state["at"], F.lit(0)))
        return F.struct(F.greatest(state["at"], s["end"]).alias("at"), F.when(new, F.concat(state["out"], before, F.lit(mask))).otherwise(state["out"]).alias("out"))

    return F.aggregate(spans, zero, step, lambda s: F.concat(s["out"], F.substring(text, s["at"] + 1, F.char_length(text))))
