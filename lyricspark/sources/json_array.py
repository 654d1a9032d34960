"""The elements of one JSON array, read by many tasks.

A file is read as text that ends at each closing brace, so that Spark divides it like any other text,
in every store that it reads. A block of a file doesn't know whether it begins inside a string, nor how
deep: a first pass sums up what each block does to either, and from these sums, one row a block, every
block's start is known. Blocks then give out their elements on their own; an element that reaches
over the end of a block is put together from its pieces.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator, Sequence
from itertools import groupby
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_ESCAPE = re.compile(r"\\.", re.S)
_TOKEN = re.compile(r'"[^"\\]*(?:\\.[^"\\]*)*"?|[{}\[\]]', re.S)
_REST = re.compile(r'[^"\\]*(?:\\.[^"\\]*)*"?', re.S)
_NAMED = re.compile(r"\s*:\s*(\[)?")
#: A key that an earlier block has named.
EARLIER = "\0"


class Start(NamedTuple):
    """What is known where a block, or what is left of it, begins."""

    level: int  # depth of the elements: 1 in a bare list, 2 below a key of an envelope
    depth: int
    in_string: bool
    key: str | None  # the key at hand, if its value is an array
    inside: bool  # within an element


def block_sums(text: str) -> tuple[bool, int, int]:
    """(whether the number of quotes is odd, change of depth if it begins outside a string, the same if inside)."""
    parts = _ESCAPE.sub("", text).split('"')
    outside, inside = ("".join(parts[i::2]) for i in (0, 1))
    change = lambda s: s.count("{") + s.count("[") - s.count("}") - s.count("]")
    return len(parts) % 2 == 0, change(outside), change(inside)


def scan(text: str, start: Start, keys: Sequence[str] | None, named: list[str]) -> tuple[list[tuple[bool, str]], str, Start]:
    """([(whether it began here, element)], what is left, its start); `named` gets the keys that open arrays.

    Only elements below one of `keys` are given out, or all where keys is None.
    """
    found, depth, key, begin, at_begin, from_ = [], start.depth, start.key, 0 if start.inside else None, start, 0
    if start.in_string:
        rest = _REST.match(text)
        if not rest.group().endswith('"'):
            return found, text, start
        from_ = rest.end()
    for m in _TOKEN.finditer(text, from_):
        token = m.group()
        if token[0] == '"':
            # a lone quote opens a string as well
            if len(token) == 1 or token[-1] != '"' or (len(token) - len(token[:-1].rstrip("\\")) - 1) % 2:
                if begin is not None:
                    return found, text[begin:], at_begin
                return found, text[m.start() :], Start(start.level, depth, False, key, False)
            if depth == 1 and start.level == 2 and (colon := _NAMED.match(text, m.end())):
                key = json.loads(token, strict=False) if colon.group(1) else None
                if key is not None:
                    named.append(key)
        elif token in "{[":
            if token == "{" and depth == start.level and begin is None and (keys is None or key in keys):
                begin, at_begin = m.start(), Start(start.level, depth, False, key, False)
            depth += 1
        else:
            depth -= 1
            if depth == start.level and begin is not None:
                found.append((not at_begin.inside, text[begin : m.end()]))
                begin = None
    if begin is not None:
        return found, text[begin:], at_begin
    return found, "", Start(start.level, depth, False, key, False)


def _pieces(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    raw = spark.read.option("lineSep", "}").text(path)
    return raw.select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[str, int], str]]:
    """((file, block), text) for stretches of a block's pieces, with the braces that ended them."""
    for batch in batches:
        rows = zip(batch.column("file").to_pylist(), batch.column("block").to_pylist(), batch.column("value").to_pylist())
        for at, some in groupby(rows, key=lambda r: r[:2]):
            yield at, "".join(r[2] + "}" for r in some)


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for at, texts in groupby(_blocks(batches), key=lambda b: b[0]):
        odd, plus, first = False, [0, 0], None
        for _, text in texts:
            flips, outside, inside = block_sums(text)
            changes = (inside, outside) if odd else (outside, inside)
            plus, odd = [p + c for p, c in zip(plus, changes)], odd ^ flips
            first = first or text.lstrip("\ufeff \t\r\n")[:1] or None
        yield pa.RecordBatch.from_pylist([{"file": at[0], "block": at[1], "odd": odd, "outside": plus[0], "inside": plus[1], "first": first}])


def _scanned(starts, keys_of, give_out: bool):
    """A function of Arrow batches: with give_out, elements and their pieces; else the keys that a block names."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for at, texts in groupby(_blocks(batches), key=lambda b: b[0]):
            start, keys, left, named, n, continued = starts.value[at], keys_of.value.get(at[0]), "", [], 0, starts.value[at].inside
            for _, text in texts:
                found, left, start = scan(left + text, start, keys, named)
                if give_out and found:
                    part = [None if whole else "end" for whole, _ in found]
                    yield pa.RecordBatch.from_pydict({"file": [at[0]] * len(found), "block": [at[1]] * len(found), "seq": list(range(n, n + len(found))), "part": pa.array(part, pa.string()), "element": [e for _, e in found]})
                    n += len(found)
                    continued = False
            if give_out and left and (start.inside or (keys is None or start.key in keys) and start.depth == start.level and left[0] == "{"):
                yield pa.RecordBatch.from_pydict({"file": [at[0]], "block": [at[1]], "seq": [n], "part": ["middle" if start.inside and continued else "begin"], "element": [left]})
            if not give_out:
                yield pa.RecordBatch.from_pydict({"file": [at[0]], "block": [at[1]], "named": pa.array([named], pa.list_(pa.string())), "last": pa.array([start.key], pa.string())})

    return run


def read_elements(spark: SparkSession, path: str | Sequence[str], keys: Sequence[str] = ("entries", "samples", "segments", "augmented_samples")) -> DataFrame:
    """(file, element): the objects of each file's array, as JSON texts.

    A file holds a bare list, or an object in which the first of `keys` that names an array is taken.
    Objects alone are elements; an empty file has none. Files are divided by
    spark.sql.files.maxPartitionBytes; one row for each block reaches the driver, twice at most.
    """
    pieces, context = _pieces(spark, path), spark.sparkContext
    sums = pieces.mapInArrow(_sums, "file string, block long, odd boolean, outside long, inside long, first string").toPandas().sort_values(["file", "block"])
    starts: dict[tuple[str, int], Start] = {}
    for file, blocks in sums.groupby("file", sort=False):
        opening = next((c for c in blocks["first"] if c), None)
        level, depth, in_string = {"[": 1, "{": 2}.get(opening, 0), 0, False
        for b in blocks.itertuples():
            starts[file, b.block] = Start(level, depth, in_string, EARLIER if level == 2 and depth else None, bool(level) and depth > level)
            depth += b.inside if in_string else b.outside
            in_string ^= b.odd
    # anything but a list or an object holds no elements: depth 0 is never below a key
    wanted: dict[str, tuple[str, ...] | None] = {file: () if s.level == 0 else None for (file, _), s in starts.items()}
    envelopes = {file for (file, _), s in starts.items() if s.level == 2}
    if envelopes:
        every = dict.fromkeys(envelopes, ())
        run = _scanned(context.broadcast({at: s._replace(inside=False) for at, s in starts.items()}), context.broadcast(every | {f: () for f in wanted}), False)
        seen = pieces.mapInArrow(run, "file string, block long, named array<string>, last string").toPandas().sort_values(["file", "block"])
        for file, blocks in seen[seen["file"].isin(envelopes)].groupby("file", sort=False):
            named = {k for some in blocks["named"] for k in some}
            wanted[file] = tuple(k for k in keys if k in named)[:1]
            key = None
            for b in blocks.itertuples():
                start = starts[file, b.block]
                starts[file, b.block] = start._replace(key=key, inside=start.inside and key in wanted[file])
                key = key if b.last == EARLIER else b.last
    out = pieces.mapInArrow(_scanned(context.broadcast(starts), context.broadcast(wanted), True), "file string, block long, seq long, part string, element string")
    whole = out.filter("part is null").select("file", "element")
    if len(starts) == len(wanted):
        return whole
    # two pieces a block at most
    order = Window.partitionBy("file").orderBy("block", "seq")
    cut = out.filter("part is not null").withColumn("n", F.count_if(F.col("part") == "begin").over(order))
    joined = cut.groupBy("file", "n").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "seq", "element"))), lambda p: p["element"]), "").alias("element"), F.count_if(F.col("part") == "end").alias("ends"))
    return whole.union(joined.filter("ends = 1 and n > 0").select("file", "element"))
