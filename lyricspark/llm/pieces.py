"""SentencePiece ids of documents by tables of distinct marked words.

Where no piece reaches from another character over a following white-space marker, the segmentation
of a text is that of its marked words, one after another. Each distinct marked word is segmented and
decoded once by a Python worker's table; a text's ids are looked up word by word, in order.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, text_of

#: So many distinct words are remembered by a Python worker; then it starts anew.
REMEMBERED = 200_000
_MARK = "▁"
_MARKED = re.compile(f"{_MARK}+[^{_MARK}]*")
_TABLES: dict[str, WordPieces] = {}


class WordPieces:
    def __init__(self, path: str) -> None:
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        kept = "".join(self.model.encode(" a  b ", out_type=str)) == f"{_MARK}{_MARK}a{_MARK}{_MARK}b{_MARK}"
        #: Whether words are independent of one another under this model.
        self.by_word = kept and not any(re.search(f"[^{_MARK}]{_MARK}", p) for p in pieces)
        self.mark = str(self.model.piece_to_id(_MARK))
        self.clear()

    def clear(self) -> None:
        #: Ids as decimal numbers with commas, by the text after a word's first marker.
        self.ids: dict[str, str] = {"": self.mark}
        #: The decoded text after the first marker, where it isn't the text itself.
        self.odd: dict[str, str] = {}

    def learn(self, words: set[str]) -> None:
        known = self.ids
        new = [w for w in words if w not in known]
        for i in range(0, len(new), 8192):
            some = new[i : i + 8192]
            found = self.model.encode(some, num_threads=1)
            for word, ids, text in zip(some, found, self.model.decode(found, num_threads=1)):
                self.ids[word] = ",".join(map(str, ids))
                if text != word:
                    self.odd[word] = text

    def encode(self, texts: list[str]) -> list[tuple[str, str]]:
        """(ids with commas, decoded text) of each text."""
        if not self.by_word:
            found = self.model.encode(texts, num_threads=1)
            return [(",".join(map(str, x)), y) for x, y in zip(found, self.model.decode(found, num_threads=1))]
        if len(self.ids) > REMEMBERED:
            self.clear()
        split = []
        for text in texts:
            if not text:
                split.append([])
            elif "  " in text or _MARK in text or text[0] == " " or text[-1] == " ":
                split.append([m[1:] for m in _MARKED.findall(_MARK + text.replace(" ", _MARK))])
            else:
                split.append(text.split(" "))
        words: set[str] = set()
        for parts in split:
            words.update(parts)
        self.learn(words)
        get, odd = self.ids.__getitem__, self.odd
        out = []
        for parts in split:
            back = parts if odd.keys().isdisjoint(parts) else [odd.get(p, p) for p in parts]
            out.append((",".join(map(get, parts)), " ".join(back)))
        return out


def _table(path: str) -> WordPieces:
    if path not in _TABLES:
        _TABLES[path] = WordPieces(path)
    return _TABLES[path]


def encode_pieces(docs: DataFrame, model: str, with_ids: bool = False) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256[, ids, decoded]) of each row of docs(doc_id, text).

    No begin or end ids, no sampling. Null texts count as empty, with no ids; a null doc_id stays
    null; equal rows stay; other columns are ignored; an empty table gives an empty result.
    """
    small_batches(docs.sparkSession)
    fields = [("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())]
    fields += [("ids", pa.list_(pa.int64())), ("decoded", pa.string())] * with_ids
    schema = pa.schema(fields)

    def run(batches):
        table = _table(model)
        for batch in batches:
            texts = batch.column("text")
            for i in range(0, len(texts), 128):
                found = table.encode(texts[i : i + 128].to_pylist())
                columns = [
                    batch.column("doc_id")[i : i + 128],
                    pa.array([x.count(",") + 1 if x else 0 for x, _ in found], pa.int64()),
                    pa.array([hashlib.sha256(x.encode()).hexdigest() for x, _ in found]),
                    pa.array([hashlib.sha256(y.encode()).hexdigest() for _, y in found]),
                ]
                if with_ids:
                    columns += [pa.array([[int(n) for n in x.split(",")] if x else [] for x, _ in found], pa.list_(pa.int64())), pa.array([y for _, y in found], pa.string())]
                yield pa.record_batch(columns, schema=schema)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<long>, decoded string" * with_ids)
