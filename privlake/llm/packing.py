"""Bounded-space online packing of tokenised documents into fixed-length sequences."""

from __future__ import annotations

import functools
import os
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import tokens as tk
from .common import arrow_type, durable

#: Words whose ids a task remembers; it forgets all when there are more.
CACHE = 1_000_000
#: Partitions whose open windows are merged together.
MERGED = 4


#: Bytes of text that are tokenised in one step.
STEP = 8 << 20
_LETTER = np.zeros(256, dtype=bool)
_LETTER[65:91] = _LETTER[97:123] = True


class _Tokenizer:
    """Ids of whole texts by a tokenizer that lower-cases, whose tokens hold no white space and end where an ASCII letter meets another ASCII sign.

    So each distinct piece between such places is encoded once, in lower case. A step in which "<|" occurs may hold the strings of special
    tokens: there, only white space parts pieces, and case is kept.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.encode = Tokenizer.from_file(path).encode_batch_fast
        self.forget()

    def forget(self):
        self.known, self.slot = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.starts, self.ids = np.zeros(1, np.int64), np.zeros(0, np.uint32)

    def __call__(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts, and where each text's begin."""
        special = b"<|" in data.tobytes()
        data = data if special else tk.LOWER[data]
        starts, ends, first = tk.word_bounds(data, offsets, tk.SOLID)
        if not special and len(data) > 1:
            cut = np.flatnonzero(_LETTER[data[:-1]] & ~_LETTER[data[1:]] & (data[1:] < 128) & tk.SOLID[data[1:]]) + 1
            cut = cut[~np.isin(cut, offsets)]
            starts, ends = np.sort(np.concatenate([starts, cut])), np.sort(np.concatenate([ends, cut]))
            first = np.searchsorted(starts, offsets)
        unique, one, where = np.unique(tk.span_hashes(data, starts, ends), return_index=True, return_inverse=True)
        if special:
            unique = tk.mix(unique + tk.U64(1))
        if len(self.known) > CACHE:
            self.forget()
        at = np.searchsorted(self.known, unique)
        new = np.ones(len(unique), dtype=bool)
        inside = at < len(self.known)
        new[inside] = self.known[at[inside]] != unique[inside]
        if new.any():
            raw = data.tobytes()
            words = [raw[s:e].decode("utf-8", "replace") for s, e in zip(starts[one[new]].tolist(), ends[one[new]].tolist(), strict=True)]
            got = [e.ids for e in self.encode(words, add_special_tokens=False)]
            lengths = np.fromiter(map(len, got), np.int64, len(got))
            slots = np.arange(len(self.slot), len(self.slot) + len(got))
            self.ids = np.concatenate([self.ids, np.fromiter(chain.from_iterable(got), np.uint32, int(lengths.sum()))])
            self.starts = np.concatenate([self.starts, self.starts[-1] + np.cumsum(lengths)])
            known = np.concatenate([self.known, unique[new]])
            by = np.argsort(known)
            self.known, self.slot = known[by], np.concatenate([self.slot, slots])[by]
            at = np.searchsorted(self.known, unique)
        own = self.slot[at][where] if len(where) else np.zeros(0, np.int64)
        lengths = self.starts[own + 1] - self.starts[own]
        cuts = np.concatenate([[0], np.cumsum(lengths)])
        ids = self.ids[np.arange(cuts[-1]) - np.repeat(cuts[:-1] - self.starts[own], lengths)]
        return ids, cuts[first]


@functools.cache
def _tokenizer(path: str) -> _Tokenizer:
    """A worker keeps its tokenizer, and the words it knows, from task to task."""
    return _Tokenizer(path)


def _schema(id_type: pa.DataType) -> pa.Schema:
    return pa.schema([("_doc", id_type), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()), ("_part", pa.int64()), ("_at", pa.int64()), ("ids", pa.binary())])


class _Rows:
    def __init__(self, schema: pa.Schema, with_ids: bool):
        self.schema, self.with_ids, self.rows = schema, with_ids, []

    def piece(self, doc, start, ids, total, sequence, offset):
        raw = ids.astype("<u4").tobytes()
        self.rows.append((doc, start, len(ids), zlib.crc32(raw), total, sequence, offset, None, None, raw if self.with_ids else None))

    def sequence(self, pieces, sequence):
        offset = 0
        for doc, start, ids, total in pieces:
            self.piece(doc, start, ids, total, sequence, offset)
            offset += len(ids)

    def take(self) -> list[pa.Array]:
        columns = list(zip(*self.rows, strict=True)) or [[]] * len(self.schema)
        self.rows = []
        return [pa.array(c, f.type) for c, f in zip(columns, self.schema, strict=True)]


def _pack(path: str, size: int, windows: int, end_id: int, id_type: pa.DataType, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part, count = _tokenizer(path), TaskContext.get().partitionId(), 0
        rows = _Rows(_schema(id_type), with_ids)
        open_, free = [], np.zeros(0, np.int64)
        for whole in batches:
            for batch, data, offsets in tk.steps(whole, "_text", STEP):
                ids, cuts = encode(data, offsets)
                for d, doc in enumerate(batch.column("_doc").to_pylist()):
                    own, start = np.append(ids[cuts[d] : cuts[d + 1]], np.uint32(end_id)), 0
                    total = len(own)
                    while total - start >= size:
                        rows.piece(doc, start, own[start : start + size], total, part << 40 | count, 0)
                        start, count = start + size, count + 1
                    while start < total:
                        rest = total - start
                        fits = np.where(free >= rest, free, size + 1)
                        at = int(np.argmin(fits)) if len(free) else 0
                        if len(free) and fits[at] <= size:  # best fit
                            pass
                        elif len(free) < windows:
                            open_.append([])
                            free = np.append(free, size)
                            at = len(free) - 1
                        else:  # the fullest goes out; the document's next ids fill it to the brim
                            at, rest = int(np.argmin(free)), int(free.min())
                        open_[at].append((doc, start, own[start : start + rest], total))
                        free[at] -= rest
                        start += rest
                        if not free[at]:
                            rows.sequence(open_.pop(at), part << 40 | count)
                            free, count = np.delete(free, at), count + 1
                yield pa.RecordBatch.from_arrays(rows.take(), schema=rows.schema)
        left = [(doc, start, len(ids), None, total, None, None, part, i << 20 | k, ids.astype("<u4").tobytes()) for i, w in enumerate(open_) for k, (doc, start, ids, total) in enumerate(w)]
        rows.rows = left
        yield pa.RecordBatch.from_arrays(rows.take(), schema=rows.schema)

    return run


def _merge(size: int, id_type: pa.DataType, with_ids: bool):
    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        rows, count = _Rows(_schema(id_type), with_ids), 0
        table = table.take(pc.sort_indices(table, [("_part", "ascending"), ("_at", "ascending")]))
        todo = [(r["_doc"], r["start"], np.frombuffer(r["ids"], "<u4"), r["doc_tokens"]) for r in table.to_pylist()][::-1]
        rest = sum(len(x[2]) for x in todo)
        while todo:
            # full sequences as long as they last; then powers of two, which need no padding
            target = size if rest >= size else 1 << (rest.bit_length() - 1)
            pieces, room = [], target
            while room:
                doc, start, ids, total = todo.pop()
                if len(ids) > room:
                    todo.append((doc, start + room, ids[room:], total))
                pieces.append((doc, start, ids[:room], total))
                room -= len(pieces[-1][2])
            rows.sequence(pieces, 1 << 62 | key[0].as_py() << 20 | count)
            rest, count = rest - target, count + 1
        return pa.Table.from_arrays(rows.take(), schema=rows.schema)

    return run


def pack(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", size: int = 2048, windows: int = 64, end_id: int = 1, with_ids: bool = True) -> DataFrame:
    """Documents as pieces of sequences of at most `size` ids (a power of two).

    A document's ids are those of its whole text by the tokenizer file `tokenizer`, and then `end_id`; null text is empty. A partition's
    documents come one after another; whole sequences are cut off, and the rest goes to the open window with the least room that
    holds it. If none does, a new window is opened, while there are fewer than `windows`; else the fullest takes as many ids as it has room
    for and goes out. A task holds its open windows only. The windows that are open at the end of `MERGED` partitions are then merged into
    full sequences; what remains is cut at powers of two, so that no sequence is padded.

    Result, a row per piece: `id_col`, start, length, ids_crc32 (of little-endian unsigned 32-bit ids), doc_tokens, sequence_id, offset, and
    ids (binary, the same form) unless with_ids is false. Repeated rows and ids are packed each by itself. A null id stays null. Other columns are not looked at.
    An empty table gives no rows. The pieces are written once before the merge, so that a lost executor can't pack a document twice.
    """
    kind = dict(docs.dtypes)[id_col]
    id_type = arrow_type(docs, id_col)
    schema = f"_doc {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, _part long, _at long, ids binary"
    texts = docs.select(F.col(id_col).alias("_doc"), F.col(text_col).alias("_text"))
    placed = durable(texts.mapInArrow(_pack(tokenizer, size, windows, end_id, id_type, with_ids), schema))
    left = placed.where("sequence_id is null").withColumn("_group", F.floor(F.col("_part") / MERGED))
    merged = left.groupBy("_group").applyInArrow(_merge(size, id_type, with_ids), schema)
    out = placed.where("sequence_id is not null").unionByName(merged).withColumnRenamed("_doc", id_col).drop("_part", "_at")
    return out if with_ids else out.drop("ids")
