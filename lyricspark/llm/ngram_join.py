"""N-gram Jaccard join by token-combination prefixes.

Texts become sets of hashed word shingles. Shingles are ordered from rare to frequent, and a text's
prefix is as long as the prefix filter asks. Rare shingles of a prefix are indexed alone, frequent ones
as pairs and very frequent ones as triples, within groups that they are dealt into by hash. A group
holds k - 1 shingles that form no combination yet, so the prefix is extended by so many for each group
that it touches. Two sets that overlap enough then share a rare shingle or a combination.

Each entry also carries how far into the prefix it stands. A pair of sets that overlaps enough shares
an entry that stands, on both sides, no further than the sizes of both allow; any other is left out.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import IdFilter, drop_kept, id_filter, keep, small_batches
from .components import components
from .hashing import hashed_words, mix, shingles

#: Sets below this size are indexed by single shingles alone.
SMALL = 20
#: Shingles in a combination, by the least count that asks for so many.
COMBINED = ((64, 2), (4096, 3))
#: Frequency counts are kept for so many shingles at most; the others count as rare, which changes no result.
COUNTED = 1 << 19
#: Rounds in which members of long lists are linked to pivots, at most, before all pairs between components are checked.
STARS = 8
#: Lists of more members than this are long: they get rounds of their own, while these leave out a tenth of the pairs each.
WORTH = 32
#: Pivots of a long list in one round.
PIVOTS = 4
#: Members of a list that meet in one task; longer lists are dealt out in blocks.
MEET = 512
#: So many of the largest groups of equal sets are joined by broadcast, so that none lands in one task.
HOT = 1 << 15
_BLOCK = 2_000_000
_LANES = 8
#: Sets from this size on also have parities over many more buckets.
LONG, _WIDE = 1_500, 256


def _sets(texts: pa.Array, k: int):
    for first, words, at in hashed_words(texts):
        for i in range(len(at) - 1):
            yield first + i, np.unique(shingles(words[at[i] : at[i + 1]], k))


def _first_pass(k: int):
    """Each text's set size and fingerprint; the shingles that are frequent in a block of texts, with counts."""
    schema = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("fp", pa.binary()), ("token", pa.int64()), ("cnt", pa.int64())])

    def counted(block: list[np.ndarray]) -> pa.RecordBatch:
        tokens, count = np.unique(np.concatenate(block), return_counts=True)
        often = count >= 3
        m = int(often.sum())
        none = pa.nulls(m, pa.int64())
        return pa.record_batch([none, none, pa.nulls(m, pa.binary()), pa.array(tokens[often].view(np.int64)), pa.array(count[often])], schema=schema)

    def run(batches):
        block, held = [], 0
        for batch in batches:
            sizes, prints = [], []
            for _, s in _sets(batch.column("text"), k):
                sizes.append(len(s))
                prints.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
                if len(s):
                    block.append(s)
                    held += len(s)
                if held >= _BLOCK:
                    yield counted(block)
                    block, held = [], 0
            none = pa.nulls(len(sizes), pa.int64())
            yield pa.record_batch([batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(prints, pa.binary()), none, none], schema=schema)
        if block:
            yield counted(block)

    return run


def _entries(s: np.ndarray, tokens: np.ndarray, count: np.ndarray, num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
    """The signatures of one set, and for each the least prefix that holds it; num/den is the least Jaccard similarity."""
    n = len(s)
    base = n - (num * n + den - 1) // den + 1
    freq = np.zeros(n, dtype=np.int64)
    if len(tokens):
        at = np.minimum(np.searchsorted(tokens, s), len(tokens) - 1)
        freq = np.where(tokens[at] == s, count[at], 0)
    order = np.lexsort((s, np.where(freq > 0, np.log2(np.maximum(freq, 1)).astype(np.int64) + 1, 0)))
    s, freq = s[order], freq[order]
    size = np.ones(n, dtype=np.int64)
    for least, k in COMBINED:
        size[freq >= least] = k
    out: list[np.ndarray] = []
    ends: list[np.ndarray] = []
    largest = n * den // num
    if num * n // den < SMALL:
        out.append(mix(s[:base] + np.uint64(1)))
        ends.append(np.arange(1, base + 1))
    if n >= SMALL and (size[: base + 1] == 1).all():
        out.append(s[:base])
        ends.append(np.arange(1, base + 1))
    elif n >= SMALL:
        for band in {max(n, SMALL).bit_length(), largest.bit_length()}:
            nominal = (1 << (band - 1)) * (den - num) // den + 1
            held: dict[tuple[int, int], list] = {}
            gained = 0
            for i in range(n):
                if gained >= base:
                    break
                k = int(size[i])
                if k == 1:
                    gained += 1
                    made = s[i : i + 1]
                else:
                    group = held.setdefault((k, int(s[i] >> np.uint64(17)) % max(1, nominal // (2 * k))), [[]] + [np.empty(0, np.uint64) for _ in range(k - 1)])
                    # group[0]: its shingles; group[j]: hashes of all combinations of j of them
                    for j in range(k - 1, 0, -1):
                        before = group[j - 1] if j > 1 else np.full(1, band, dtype=np.uint64)
                        if j == k - 1:
                            made = mix(group[j] * np.uint64(2 * k + 1) ^ s[i])
                        group[j] = np.append(group[j], mix(before * np.uint64(2 * j + 1) ^ s[i]))
                    group[0].append(i)
                    gained += len(group[0]) >= k
                out.append(made)
                ends.append(np.full(len(made), gained))
    sigs, ends_ = np.concatenate(out), np.concatenate(ends)
    order = np.lexsort((ends_, sigs))
    sigs, ends_ = sigs[order], ends_[order]
    first = np.ones(len(sigs), dtype=bool)
    first[1:] = sigs[1:] != sigs[:-1]
    return sigs[first], ends_[first]


def _parities(s: np.ndarray, buckets: int) -> np.ndarray:
    """Whether each bucket holds an odd number of the set's hashes, as bits. Two sets differ in as many hashes as bits, at least."""
    odd = np.bincount((s >> np.uint64(65 - buckets.bit_length())).astype(np.int64), minlength=buckets) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def _second_pass(k: int, num: int, den: int, frequent):
    """Each text's signatures with their prefixes, and the parities of its shingles by bucket."""
    fields = [("doc_id", pa.int64()), ("n", pa.int32()), *((f"b{i}", pa.int64()) for i in range(_LANES)), ("sigs", pa.list_(pa.int64())), ("ends", pa.list_(pa.int32())), ("wide", pa.list_(pa.int64()))]
    schema = pa.schema(fields)

    def run(batches):
        tokens, count = frequent.value
        for batch in batches:
            ids = batch.column("doc_id").to_pylist()
            rows, sizes, bits, sigs, ends, wide = [], [], [], [], [], []
            for i, s in _sets(batch.column("text"), k):
                if not len(s) or ids[i] is None:
                    continue
                rows.append(ids[i])
                sizes.append(len(s))
                bits.append(_parities(s, 64 * _LANES))
                wide.append(_parities(s, 64 * _WIDE) if len(s) >= LONG else None)
                found, end = _entries(s, tokens, count, num, den)
                sigs.append(found.view(np.int64))
                ends.append(end.astype(np.int32))
            if rows:
                lanes = np.stack(bits)
                offsets = pa.array(np.concatenate([[0], np.cumsum([len(x) for x in sigs])]).astype(np.int32))
                lists = (pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(x))) for x in (sigs, ends))
                yield pa.record_batch([pa.array(rows, pa.int64()), pa.array(sizes, pa.int32()), *(pa.array(np.ascontiguousarray(lanes[:, i])) for i in range(_LANES)), *lists, pa.array(wide, pa.list_(pa.int64()))], schema=schema)

    return run


def _whole_sets(k: int, wanted: IdFilter):
    """The sets of the texts that the filter lets through."""
    schema = pa.schema([("doc_id", pa.int64()), ("tokens", pa.list_(pa.int64()))])

    def run(batches):
        for batch in batches:
            batch = batch.filter(pa.array(wanted.may_hold(batch.column("doc_id"))))
            found = [s.view(np.int64) for _, s in _sets(batch.column("text"), k)]
            yield pa.record_batch([batch.column("doc_id"), pa.array(found, pa.list_(pa.int64()))], schema=schema)

    return run


def _named(sized: DataFrame) -> DataFrame:
    """sized with rep, the smallest doc_id of the rows with an equal set; null for empty sets."""
    groups = sized.filter("fp is not null and doc_id is not null").groupBy("fp", "n").agg(F.min("doc_id").alias("rep"), F.count("*").alias("c"))
    groups = keep(groups, "groups")
    hot = groups.filter("c >= 64").orderBy(F.desc("c"), "fp", "n").limit(HOT).select("fp", "n", F.col("rep").alias("hot"))
    # HOT rows of a fingerprint and two numbers at most are broadcast; all other groups are joined by a shuffle
    marked = sized.join(F.broadcast(hot), ["fp", "n"], "left")
    met = marked.filter("hot is null and fp is not null").drop("hot").join(groups.select("fp", "n", "rep"), ["fp", "n"], "left")
    return met.select("doc_id", "n", "rep").union(marked.filter("hot is not null or fp is null").select("doc_id", "n", F.col("hot").alias("rep")))


def jaccard_components(docs: DataFrame, k: int = 3, similarity: tuple[int, int] = (9, 10)) -> DataFrame:
    """(doc_id, n_shingles, component_id) for each row of docs(doc_id, text).

    Two texts are linked when the Jaccard similarity of their sets of k-word shingles is at least
    num/den; component_id is the smallest doc_id reachable by links. The links that decide components
    are all found: the texts of a list, which share a signature, are first linked to its least edited member
    and, in long lists, to members of its largest component; then all pairs are checked that still lie in different components, so that large groups of copies
    never become all their pairs.

    Nulls and texts without words have an empty set, size 0, and link with nothing; a text with fewer
    than k words counts as one shingle. Rows with equal doc_id are one node. A null doc_id keeps its
    row, with a null component_id. Equal rows stay; very long texts are taken whole; other columns are
    ignored; an empty table gives an empty result.
    """
    num, den = similarity
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    first = keep(rows.mapInArrow(_first_pass(k), "doc_id long, n long, fp binary, token long, cnt long"), "sets")
    top = first.filter("token is not null").groupBy("token").agg(F.sum("cnt").alias("cnt")).orderBy(F.desc("cnt"), "token").limit(COUNTED).toPandas()
    tokens = top["token"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(tokens)
    frequent = spark.sparkContext.broadcast((tokens[order], top["cnt"].to_numpy(np.int64)[order]))
    named = keep(_named(first.filter("token is null").select("doc_id", "n", "fp")), "named")
    drop_kept(first)

    lanes = ", ".join(f"b{i} long" for i in range(_LANES))
    marked = rows.mapInArrow(_second_pass(k, num, den, frequent), f"doc_id long, n int, {lanes}, sigs array<long>, ends array<int>, wide array<long>")
    several_texts = keep(named.filter("doc_id is not null and rep is not null").groupBy("doc_id").agg(F.min("rep").alias("a"), F.max("rep").alias("b")).filter("a < b"), "several")
    copies = named.filter("rep <> doc_id").select("doc_id").distinct()
    # one text stands for all equal ones; a doc_id with several texts stays with all of them
    marked = keep(marked.join(copies.join(named.filter("rep = doc_id").select("doc_id").distinct(), "doc_id", "left_anti"), "doc_id", "left_anti"), "signatures")

    def least(na, nb):
        # an overlap o reaches the similarity when (num + den) * o >= num * (na + nb)
        return F.floor((num * (na + nb) + num + den - 1) / (num + den))

    # slack: the largest overlap that an entry's prefix still serves
    listed = marked.select("doc_id", "n", F.explode(F.arrays_zip("sigs", "ends")).alias("e")).select("doc_id", "n", F.col("e.sigs").alias("sig"), (F.col("n") + 1 - F.col("e.ends")).alias("slack"))
    mark = F.xxhash64("doc_id")
    shared = listed.groupBy("sig").agg(F.count("*").alias("c"), F.min("doc_id").alias("least"), F.bit_xor(mark).alias("mixed"), F.min("n").alias("low"), F.max("n").alias("high"), F.max("slack").alias("most")).filter((F.col("c") > 1) & (least(F.col("low"), F.col("low")) <= F.col("most")))
    # a pair at the least sizes of a list asks for the least overlap; entries that don't serve it go. Copies share many
    # signatures: lists with the same members become one, with each member's largest slack
    shared = shared.select("sig", "low", F.xxhash64("c", "least", "mixed").alias("list"))
    entries = listed.join(shared, "sig").filter(least(F.col("n"), F.greatest("low", F.ceil(F.col("n") * num / den))) <= F.col("slack"))
    entries = entries.groupBy("list", "doc_id").agg(F.max("n").alias("n"), F.max("slack").alias("slack"))
    entries = keep(entries.withColumnRenamed("list", "sig"), "entries")
    bits = marked.drop("sigs", "ends")

    def fits(a: str, b: str):
        """Whether two entries of a list can show a link of their sets."""
        na, nb = F.col(f"{a}.n"), F.col(f"{b}.n")
        need = least(na, nb)
        return (na * den >= nb * num) & (nb * den >= na * num) & (need <= F.col(f"{a}.slack")) & (need <= F.col(f"{b}.slack"))

    def apart_by(a: str, b: str):
        """Parities in which two sets differ."""
        return sum((F.bit_count(F.col(f"{a}.b{i}").bitwiseXOR(F.col(f"{b}.b{i}"))) for i in range(1, _LANES)), F.bit_count(F.col(f"{a}.b0").bitwiseXOR(F.col(f"{b}.b0"))))

    def near(a: str, b: str):
        far = apart_by(a, b)
        wide = F.aggregate(F.zip_with(f"{a}.wide", f"{b}.wide", lambda p, q: F.bit_count(p.bitwiseXOR(q))), F.lit(0), lambda s, v: s + v)
        most = F.col(f"{a}.n") + F.col(f"{b}.n") - 2 * least(F.col(f"{a}.n"), F.col(f"{b}.n"))
        return (far <= most) & F.coalesce(wide <= most, F.lit(True))

    def verified(pairs: DataFrame, one_each: bool = False) -> DataFrame:
        """The pairs (x, y) that are links: by parities first, then by their whole sets. one_each: of each x, the pair whose parities agree most, alone."""
        met = pairs.join(bits.alias("a"), F.col("x") == F.col("a.doc_id")).join(bits.alias("b"), F.col("y") == F.col("b.doc_id")).filter(near("a", "b"))
        if one_each:
            met = met.groupBy("x").agg(F.min_by("y", F.struct(apart_by("a", "b"), "y")).alias("y"))
        pairs = keep(met.select("x", "y"), "pairs")
        wanted = pairs.select(F.col("x").alias("doc_id")).union(pairs.select("y"))
        # what the filter lets through beyond the pairs goes in the joins
        sets = keep(rows.mapInArrow(_whole_sets(k, id_filter(wanted, "doc_id")), "doc_id long, tokens array<long>"), "whole")
        left, right = sets.select(F.col("doc_id").alias("x"), F.col("tokens").alias("s")), sets.select(F.col("doc_id").alias("y"), F.col("tokens").alias("t"))
        both = F.size(F.array_intersect("s", "t"))
        links = keep(pairs.join(left, "x").join(right, "y").filter(den * both >= num * (F.size("s") + F.size("t") - both)).select("x", "y"), "links")
        drop_kept(pairs)
        drop_kept(sets)
        return links

    def hung(links: DataFrame) -> DataFrame:
        """links, and each node's component, written in their place."""
        out = keep(components(links, "x", "y"), "components")
        drop_kept(links)
        return out

    def placed_in(begun: DataFrame, members: DataFrame) -> DataFrame:
        """Members of lists with their components."""
        return members.drop("component").join(begun.withColumnRenamed("node", "doc_id"), "doc_id", "left").withColumn("component", F.coalesce("component", "doc_id"))

    def unsettled(found: DataFrame) -> DataFrame:
        """The members of lists that lie in several components; a list in one component is settled."""
        open_ones = found.groupBy("sig").agg(F.min("component").alias("_low"), F.max("component").alias("_high"), F.count("*").alias("m")).filter("_low < _high").select("sig", "m")
        return keep(found.drop("m").join(open_ones, "sig").select("sig", "doc_id", "n", "slack", "component", "m"), "placed")

    def starred(members: DataFrame, pivots: DataFrame, begun: DataFrame) -> DataFrame:
        """The components once each member is linked to one pivot of its lists (sig, p), at most."""
        star = members.alias("e").join(pivots.select("sig", "p.*").alias("p"), (F.col("e.sig") == F.col("p.sig")) & (F.col("e.component") != F.col("p.component")) & fits("e", "p"))
        found = verified(star.select(F.col("e.doc_id").alias("x"), F.col("p.doc_id").alias("y")).distinct(), one_each=True)
        joined = hung(keep(found.union(begun.select("node", "component")), "links"))
        drop_kept(found)
        drop_kept(begun)
        return joined

    # rows with one doc_id and several texts hold their sets' groups together
    begun = spark.createDataFrame([], "node long, component long")
    if several_texts.limit(1).count():
        held = several_texts.select("doc_id").join(named, "doc_id").filter("rep is not null").select(F.col("doc_id").alias("x"), F.col("rep").alias("y"))
        begun = hung(keep(held.filter("x <> y").distinct(), "links"))
    member = F.struct("doc_id", "n", "slack", "component")
    # the member with the shortest prefix has the fewest rare shingles, so that the others are most like it
    placed = placed_in(begun, entries)
    begun = starred(placed, placed.groupBy("sig").agg(F.min_by(member, F.struct(-F.col("slack"), "doc_id")).alias("p")), begun)
    placed = unsettled(placed_in(begun, entries))
    # a long list is mostly one group of near copies, which grow together around its largest component: the members
    # outside of it meet some of those inside, other ones each time. What they miss is left to all pairs
    long = placed.filter(F.col("m") > WORTH)
    left = None
    for turn in range(STARS):
        homes = long.groupBy("sig", "component").agg(F.count("*").alias("c"), F.array_distinct(F.array(*(F.min_by(member, F.xxhash64("doc_id", F.lit(PIVOTS * turn + i))) for i in range(PIVOTS)))).alias("ps"))
        homes = keep(homes, "homes")
        # members meet those of other components
        before, left = left, homes.groupBy("sig").agg((F.sum("c") * F.sum("c") - F.sum(F.col("c") * F.col("c"))).alias("w")).agg(F.sum("w")).first()[0] or 0
        if not left or before is not None and left > 0.9 * before:
            drop_kept(homes)
            break
        pivots = homes.groupBy("sig").agg(F.max_by("ps", F.struct("c", "component")).alias("ps")).select("sig", F.explode("ps").alias("p"))
        begun = starred(long, pivots, begun)
        drop_kept(homes)
        later = unsettled(placed_in(begun, long))
        drop_kept(long)
        long = later
    now = placed_in(begun, placed.filter(F.col("m") <= WORTH)).unionByName(long)
    spread = now.withColumn("blocks", F.ceil(F.col("m") / MEET).cast("int")).withColumn("block", F.pmod(F.xxhash64("doc_id"), F.col("blocks")).cast("int"))
    every = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    ones, others = spread.withColumn("other", every), spread.withColumnRenamed("block", "other").withColumn("block", every)
    apart = ones.alias("a").join(others.alias("b"), (F.col("a.sig") == F.col("b.sig")) & (F.col("a.block") == F.col("b.block")) & (F.col("a.other") == F.col("b.other")) & (F.col("a.doc_id") < F.col("b.doc_id")) & (F.col("a.component") != F.col("b.component")) & fits("a", "b"))
    more = verified(apart.select(F.col("a.doc_id").alias("x"), F.col("b.doc_id").alias("y")).distinct())
    drop_kept(marked)
    drop_kept(entries)
    drop_kept(placed)
    drop_kept(long)
    joined = hung(keep(more.union(begun.select("node", "component")), "links"))
    drop_kept(more)
    out = named.join(joined.select(F.col("node").alias("rep"), "component"), "rep", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "rep", "doc_id")).alias("component_id"))
