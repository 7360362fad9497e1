"""SentencePiece encoding and decoding over a distinct-chunk table.

Where no piece of the model has a whitespace marker after another character,
no merge crosses from a word to the marker of the next one.  A text is then cut
before each run of markers; each distinct chunk (markers and the word that
follows) is segmented once per task and its ids are joined back by position.
The table is emptied when it reaches ``TABLE_CHUNKS`` entries, which bounds the
memory and changes no result.  Models for which the condition does not hold,
or whose normaliser changes text, are encoded text by text.

Defined results: a null or empty text has no ids and decodes to ''.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ship

MARK = "▁"
TABLE_CHUNKS = 200_000  # entries of the table of one task
LONG_CHUNK = 64  # longer chunks are encoded but not kept
SLICE = 64  # texts handed on at once
_CHUNK = re.compile("[ ▁]+[^ ▁]*")
_models: dict[str, Codec] = {}


class Codec:
    """One model: encode by distinct chunks, decode by the library."""

    def __init__(self, model: str) -> None:
        self.sp = sentencepiece.SentencePieceProcessor(model_file=model)
        sp = self.sp
        pieces = [sp.id_to_piece(i) for i in range(sp.get_piece_size())]
        probe = "  Aé ﬁａ́\tb\n c  "
        plain = sp.normalize(probe) == MARK + probe.replace(" ", MARK)
        self.chunked = plain and MARK in pieces and not any(MARK in p.lstrip(MARK) for p in pieces)
        self.mark = np.array([sp.piece_to_id(MARK)], np.int32).tobytes()
        self.forget()

    def forget(self) -> None:
        """Empties the table of chunks."""
        self.table: dict[str, bytes] = {" ": self.mark}

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian int32."""
        if not self.chunked:
            return [np.array(x, np.int32).tobytes() for x in self.sp.encode(texts, num_threads=1)]
        if len(self.table) > TABLE_CHUNKS:
            self.forget()
        table = self.table
        cut = [_CHUNK.findall(" " + t.replace(MARK, " ")) if t else [] for t in texts]
        new = [c for c in {c for chunks in cut for c in chunks} if c not in table]
        # the library puts a marker in front of what it encodes: the chunk's own first one
        fresh = dict(zip(new, (np.array(x, np.int32).tobytes() for x in self.sp.encode([c[1:] for c in new], num_threads=1)), strict=True))
        if all(len(c) <= LONG_CHUNK for c in new):
            table.update(fresh)
            get = table.__getitem__
        else:
            table.update({c: x for c, x in fresh.items() if len(c) <= LONG_CHUNK})
            get = (table | {c: x for c, x in fresh.items() if len(c) > LONG_CHUNK}).__getitem__
        return [b"".join(map(get, chunks)) for chunks in cut]

    def decode(self, ids: list[list[int]]) -> list[str]:
        return [self.sp.decode(x) if x else "" for x in ids]


def codec(model: str) -> Codec:
    if model not in _models:
        _models[model] = Codec(model)
    return _models[model]


def _slices(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    for k in range(0, b.num_rows, SLICE):
        yield b.slice(k, SLICE)


def _list_array(parts: list[bytes]) -> pa.ListArray:
    sizes = np.fromiter((len(p) // 4 for p in parts), np.int64, len(parts))
    offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(parts), np.int32)))


def _encode(batches: Iterator[pa.RecordBatch], model: str, decode: bool) -> Iterator[pa.RecordBatch]:
    c = codec(model)
    try:
        for batch in batches:
            for b in _slices(batch):
                parts = c.encode([t or "" for t in b.column(b.num_columns - 1).to_pylist()])
                columns, names = b.columns[:-1] + [_list_array(parts)], [*b.schema.names[:-1], "ids"]
                if decode:
                    columns.append(pa.array(c.decode([np.frombuffer(p, np.int32).tolist() for p in parts]), pa.string()))
                    names.append("decoded")
                yield pa.RecordBatch.from_arrays(columns, names=names)
    finally:
        c.forget()  # the worker may go on to tasks of other kinds


def _decode(batches: Iterator[pa.RecordBatch], model: str) -> Iterator[pa.RecordBatch]:
    c = codec(model)
    for batch in batches:
        for b in _slices(batch):
            text = c.decode([x or [] for x in b.column(b.num_columns - 1).to_pylist()])
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(text, pa.string())], names=[*b.schema.names[:-1], "text"])


def _fields(df: DataFrame, columns: list[str]) -> str:
    return ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in columns)


def encode(df: DataFrame, model: str, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",), decode: bool = False) -> DataFrame:
    """Columns ``keep``, then ids array<int> (and with ``decode`` the text that the ids give back)."""
    ship(df.sparkSession)
    schema = f"{_fields(df, list(keep))}, ids array<int>" + ", decoded string" * decode
    return df.select(*keep, F.col(text_col)).mapInArrow(lambda it: _encode(it, model, decode), schema)


def decode(df: DataFrame, model: str, ids_col: str = "ids", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Columns ``keep``, then the text that ``ids_col`` gives back."""
    ship(df.sparkSession)
    return df.select(*keep, F.col(ids_col)).mapInArrow(lambda it: _decode(it, model), f"{_fields(df, list(keep))}, text string")


def digests(encoded: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """n_tokens, ids_sha256 and decoded_sha256 of what ``encode(..., decode=True)`` returns."""
    return encoded.select(*keep, F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"), F.sha2(F.col("decoded"), 256).alias("decoded_sha256"))
