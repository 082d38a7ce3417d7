"""Encoding and decoding with a SentencePiece model, by a table of distinct chunks.

No piece of the model may run from a character into a following white-space marker. A text is then cut before every
run of markers, each distinct chunk is segmented by the library once, and the ids are joined back by position. The
table is kept per task and emptied beyond ``TABLE`` chunks, so it costs no shuffle and bounded memory. A model with
pieces across markers is encoded text by text instead. Ids and decoded text equal the library's own.

Nulls and empty texts: no ids, empty decoded text. Very long texts are encoded whole, repeated rows each give a row,
an empty table an empty result. Columns other than doc_id and text are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from starloom.llm.store import small_batches

MARK = "▁"
TABLE = 300_000  # chunks in a task's table


class Codec:
    def __init__(self, model: str):
        self.sp = sentencepiece.SentencePieceProcessor(model_file=model)
        self.by_chunk = not any(MARK in self.sp.id_to_piece(i).lstrip(MARK) for i in range(self.sp.get_piece_size())) and self.sp.encode("a  b", out_type=str)[:1] == [MARK + "a"] and self.sp.decode(self.sp.encode("  a  b  ")) == "  a  b  "
        self.lone = str(self.sp.piece_to_id(MARK))
        self.ids: dict[str, str] = {}
        self.texts: dict[str, str] = {}

    def chunks(self, text: str) -> list[str]:
        """The chunks without their first marker: joined by single spaces they are the text again."""
        if MARK in text:
            text = text.replace(MARK, " ")
        if "  " not in text and text[:1] != " " and text[-1:] != " ":
            return text.split(" ")
        return [x[1:] for x in re.findall(r" +[^ ]*", " " + text)]

    def learn(self, words: set[str]) -> None:
        if len(self.ids) > TABLE:
            self.ids.clear()
            self.texts.clear()
            new = list(words)
        else:
            new = [w for w in words if w not in self.ids]
        found = self.sp.encode(new, num_threads=1)
        for w, i, t in zip(new, found, self.sp.decode(found) if new else [], strict=True):
            self.ids[w], self.texts[w] = ",".join(map(str, i)), t
        self.ids[""], self.texts[""] = self.lone, ""  # a marker with nothing behind it

    def encode(self, texts: list[str]) -> list[tuple[str, str]]:
        """(decimal ids joined by commas, decoded text) of each text."""
        if not self.by_chunk:
            return [(",".join(map(str, i)), self.sp.decode(i)) for i in self.sp.encode(texts, num_threads=1)]
        out = []
        for k in range(0, len(texts), 64):
            cut = [self.chunks(t) for t in texts[k : k + 64]]
            self.learn(set().union(*cut))
            ids, back = self.ids.__getitem__, self.texts.__getitem__
            out += [(",".join(map(ids, c)), " ".join(map(back, c))) if c != [""] else ("", "") for c in cut]
        return out


def _mapped(model: str, columns: Callable[[str, str], tuple], schema: pa.Schema) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(model)
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                part = batch.slice(k, 256)
                rows = [columns(*x) for x in codec.encode(part.column("text").to_pylist())]
                cols = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *(pa.array(c, f.type) for c, f in zip(cols, schema, strict=True))], ["doc_id", *schema.names])

    return run


def _texts(docs: DataFrame) -> DataFrame:
    return small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))


def encode(docs: DataFrame, model: str) -> DataFrame:
    """doc_id, ids array<int> and decoded string of every document."""
    columns = lambda ids, text: ([int(x) for x in ids.split(",")] if ids else [], text)
    return _texts(docs).mapInArrow(_mapped(model, columns, pa.schema([("ids", pa.list_(pa.int32())), ("decoded", pa.string())])), "doc_id long, ids array<int>, decoded string")


def digest(docs: DataFrame, model: str) -> DataFrame:
    """The columns of the query op6_sp_codec."""
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    columns = lambda ids, text: (ids.count(",") + 1 if ids else 0, sha(ids), sha(text))
    schema = pa.schema([("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])
    return _texts(docs).mapInArrow(_mapped(model, columns, schema), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
