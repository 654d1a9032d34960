"""Token ids of documents as flat files of unsigned integers with 64-bit offsets.

A dataset is a folder. `part-NNNNN.ids` holds the ids of its documents one after another, little
endian, in two bytes each where the vocabulary has no more ids than that, else in four. `part-NNNNN.docs` holds pairs of 64-bit integers, the doc_id and the end of the document in
its part. `manifest` is a small table of parts with their numbers of documents and ids and the bytes of an id; the bases
of the parts are prefix sums over it. Parts follow one another in ascending doc_id order.
"""

from __future__ import annotations

import os
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import small_batches, text_of

#: Stands for a null doc_id in the files.
NO_ID = -(1 << 63)
MANIFEST = "part long, docs long, tokens long, width long"
#: So many distinct chunks are remembered by a Python worker; then it starts anew.
REMEMBERED = 400_000
#: White space before a space, as RE2 writes it.
_AFTER_SPACE = r"[\t\n\x0b\x0c\r \x1c-\x1f\x{85}\p{Z}] "
_TABLES: dict[str, ChunkIds] = {}


class ChunkIds:
    """Ids of texts by a byte-level BPE of the tokenizers library; each distinct chunk is encoded once.

    No pre-token reaches from a character that isn't white space over a following space, so a text
    falls into independent chunks before each such space. Texts with other white space before a
    space, or with a special token, are encoded whole.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        self.width = np.zeros(max(vocabulary.values()) + 1, dtype=np.int64)
        for token, i in vocabulary.items():
            self.width[i] = len(token)
        self.special = [str(t.content) for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.clear()

    def clear(self) -> None:
        # places in the tables below, of chunks behind a space and of chunks at the start of a text
        self.known: dict[str, int] = {}
        self.heads: dict[str, int] = {}
        self.n = self.end = 0
        self.ids = np.empty(1 << 16, dtype=np.uint32)
        self.start = np.zeros(1 << 16, dtype=np.int64)
        self.length = np.zeros(1 << 16, dtype=np.int64)

    def whole(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, dtype=np.uint32) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _add(self, known: dict[str, int], chunks: list[str], ids: np.ndarray, ends: np.ndarray) -> None:
        """Remembers chunks whose ids stand one after another, up to the given ends."""
        at, n = self.n, len(chunks)
        while at + n > len(self.start):
            self.start, self.length = (np.concatenate([a, np.zeros_like(a)]) for a in (self.start, self.length))
        while self.end + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.empty_like(self.ids)])
        self.ids[self.end : self.end + len(ids)] = ids
        self.length[at : at + n] = np.diff(ends, prepend=0)
        self.start[at : at + n] = self.end + ends - self.length[at : at + n]
        self.n, self.end = at + n, self.end + len(ids)
        known.update(zip(chunks, range(at, at + n)))

    def _add_each(self, known: dict[str, int], chunks: list[str], texts: list[str]) -> None:
        found = self.whole(texts)
        self._add(known, chunks, np.concatenate([*found, np.empty(0, np.uint32)]), np.cumsum([len(x) for x in found]))

    def learn(self, chunks: list[str]) -> None:
        """Encodes new chunks, many in one text, which the ids' widths in bytes take apart again."""
        known = self.known
        new = [c for c in chunks if c not in known]
        for i in range(0, len(new), 4096):
            some = new[i : i + 4096]
            ids = self.whole([" " + " ".join(some)])[0]
            ends = np.cumsum(np.fromiter(map(len, map(str.encode, some)), dtype=np.int64, count=len(some)) + 1)
            reached = np.cumsum(self.width[ids])
            cut = np.searchsorted(reached, ends) + 1
            if len(ids) and (reached[np.minimum(cut, len(ids)) - 1] == ends).all():
                self._add(known, some, ids, cut)
            else:
                self._add_each(known, some, [" " + c for c in some])

    def encode(self, texts: pa.Array) -> list[np.ndarray]:
        """The ids of each text; no nulls."""
        if self.n > REMEMBERED:
            self.clear()
        bound = pc.match_substring_regex(texts, _AFTER_SPACE)
        for s in self.special:
            bound = pc.or_(bound, pc.match_substring(texts, s))
        bound = bound.to_numpy(zero_copy_only=False)
        out: list[np.ndarray] = [None] * len(texts)
        for i, ids in zip(np.flatnonzero(bound).tolist(), self.whole(texts.filter(pa.array(bound)).to_pylist())):
            out[i] = ids
        free = np.flatnonzero(~bound)
        if not len(free):
            return out
        lists = pc.split_pattern(texts.filter(pa.array(~bound)), " ")
        first = lists.offsets.to_numpy()
        values = lists.values
        coded = values.dictionary_encode()
        words = coded.dictionary.to_pylist()
        self.learn(words)
        at = np.fromiter(map(self.known.__getitem__, words), dtype=np.int64, count=len(words))[coded.indices.to_numpy()]
        heads = values.take(pa.array(first[:-1])).to_pylist()
        if new := list({h for h in heads if h not in self.heads}):
            self._add_each(self.heads, new, new)
        at[first[:-1]] = np.fromiter(map(self.heads.__getitem__, heads), dtype=np.int64, count=len(heads))
        n = self.length[at]
        ends = np.cumsum(n)
        flat = self.ids[np.repeat(self.start[at] - ends + n, n) + np.arange(int(n.sum()))]
        for i, ids in zip(free.tolist(), np.split(flat, ends[first[1:-1] - 1])):
            out[i] = ids
        return out


def _table(path: str) -> ChunkIds:
    if path not in _TABLES:
        _TABLES[path] = ChunkIds(path)
    return _TABLES[path]


def write_token_files(docs: DataFrame, path: str, tokenizer: str, end_id: int = 0) -> DataFrame:
    """Writes docs(doc_id, text) to the folder path, a URI that driver and executors share; returns the manifest.

    Documents are dealt out by ranges of doc_id and sorted within them (then by text), encoded where
    they lie and written by the task that holds them. A task writes under a name of its own and
    renames at the end, so that a repeated task leaves the same files. Null texts count as empty;
    every document gets end_id at its end; very long texts are encoded whole. Null doc_ids come first. Repeated rows are written each;
    other columns are ignored; an empty table makes an empty manifest.
    """
    spark = docs.sparkSession
    small_batches(spark)
    schema = pa.schema([(c, pa.int64()) for c in ("part", "docs", "tokens", "width")])

    def write(batches):
        fs, root = pafs.FileSystem.from_uri(path)
        context = TaskContext.get()
        part, attempt = context.partitionId(), context.taskAttemptId()
        name = f"{root}/part-{part:05d}"
        ids_out, tokens, docs_ends, n = None, 0, None, 0
        table = _table(tokenizer)
        width = 2 if max(len(table.width), end_id + 1) <= 1 << 16 else 4
        for batch in batches:
            if ids_out is None:
                fs.create_dir(root, recursive=True)
                ids_out, docs_ends = (fs.open_output_stream(f"{name}.{kind}.{attempt}") for kind in ("ids", "docs"))
            texts, keys = batch.column("text"), batch.column("doc_id").fill_null(NO_ID).to_numpy()
            for i in range(0, len(texts), 1000):
                encoded = table.encode(texts.slice(i, 1000))
                pairs = np.empty((len(encoded), 2), dtype="<i8")
                pairs[:, 0] = keys[i : i + 1000]
                pairs[:, 1] = tokens + np.cumsum([len(x) + 1 for x in encoded])
                end = np.array([end_id], dtype=np.uint32)
                ids_out.write(np.concatenate([y for x in encoded for y in (x, end)]).astype(f"<u{width}").tobytes())
                docs_ends.write(pairs.tobytes())
                tokens, n = int(pairs[-1, 1]), n + len(encoded)
        if ids_out is not None:
            ids_out.close()
            docs_ends.close()
            for kind in ("ids", "docs"):
                fs.move(f"{name}.{kind}.{attempt}", f"{name}.{kind}")
            yield pa.record_batch([pa.array([part]), pa.array([n]), pa.array([tokens]), pa.array([width])], schema=schema)

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    dealt = rows.repartitionByRange(parts, F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")
    dealt.mapInArrow(write, MANIFEST).write.mode("overwrite").parquet(f"{path}/manifest")
    return spark.read.schema(MANIFEST).parquet(f"{path}/manifest")


def read_token_files(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32[, ids]) for each document of a folder of token files.

    start counts the ids of all documents before; ids_crc32 is that of 32-bit ids; the parts' bases come from prefix sums over the
    manifest. Each part is memory-mapped by one task.
    """
    manifest = spark.read.schema(MANIFEST).parquet(f"{path}/manifest")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    based = manifest.withColumn("base", F.coalesce(F.sum("tokens").over(before), F.lit(0)))
    fields = [("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())]
    schema = pa.schema(fields + [("ids", pa.list_(pa.int64()))] * with_ids)

    def mapped(batches):
        fs, root = pafs.FileSystem.from_uri(path)
        for batch in batches:
            for row in batch.to_pylist():
                name = f"{root}/part-{row['part']:05d}"
                width, local = row["width"], isinstance(fs, pafs.LocalFileSystem)
                pairs = np.memmap(f"{name}.docs", dtype="<i8", mode="r").reshape(-1, 2) if local else np.frombuffer(fs.open_input_file(f"{name}.docs").read(), dtype="<i8").reshape(-1, 2)
                # a store without memory maps is read by ranges
                held = np.memmap(f"{name}.ids", dtype=f"<u{width}", mode="r") if local else fs.open_input_file(f"{name}.ids")
                for i in range(0, len(pairs), 512):
                    some = np.array(pairs[i : i + 512])
                    ends = some[:, 1]
                    starts = np.concatenate([[pairs[i - 1, 1] if i else 0], ends[:-1]])
                    low, high = int(starts[0]), int(ends[-1])
                    ids = held[low:high] if local else np.frombuffer(held.read_at((high - low) * width, low * width), dtype=f"<u{width}")
                    within = list(zip((starts - low).tolist(), (ends - low).tolist()))
                    crc = [zlib.crc32(ids[a:b].astype("<u4").tobytes()) for a, b in within]
                    key = pa.array(some[:, 0], mask=some[:, 0] == NO_ID)
                    columns = [key, pa.array(starts + row["base"]), pa.array(ends - starts), pa.array(crc, pa.int64())]
                    if with_ids:
                        columns.append(pa.array([ids[a:b].astype(np.int64) for a, b in within], pa.list_(pa.int64())))
                    yield pa.record_batch(columns, schema=schema)

    spread = based.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")))
    return spread.mapInArrow(mapped, "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids)
