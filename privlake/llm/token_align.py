"""Alignment of the tokens that two tokenizers make of the same text."""

from __future__ import annotations

import functools
import hashlib
import os
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

#: Bytes of text in a chunk, whose links share one dictionary; a longer document is a chunk of its own.
CHUNK = 2 << 20
#: A task forgets the pieces of text that it knows when there are more, or when their groups have more signs.
PIECES, SIGNS = 600_000, 48 << 20
#: Pieces that the tokenizers are given at a time, and signs of groups that are put together at a time.
GIVEN, TOGETHER = 20_000, 4 << 20

# A space is a cut if an ASCII sign or one of U+00C0 to U+027F stands on either side of it: there, both tokenizers start a new token whatever follows.
_SIGN = np.zeros(256, dtype=bool)
_SIGN[0x21:0x7F] = True
_LEAD = np.zeros(256, dtype=bool)
_LEAD[0xC3:0xCA] = True


def _flat(lists: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    lengths = np.fromiter(map(len, lists), np.int64, len(lists))
    return np.fromiter(chain.from_iterable(lists), np.int64, int(lengths.sum())), lengths


def groups_of(a_end: np.ndarray, b_end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The last A token and the last B token of each group, from the ends of both tokens' byte ranges, which cover the same bytes without gaps.

    The ends of the B tokens are a static index of their intervals. Two bisections per A token stab it where the token begins and ends, and give the B tokens from
    `low` to `high` that it overlaps, so it spans the gaps between those. A gap that no A token spans ends a group.
    """
    a_start = np.concatenate([[0], a_end[:-1]]) if len(a_end) else a_end
    low, high = np.searchsorted(b_end, a_start, side="right"), np.searchsorted(b_end, a_end, side="left")
    spans = np.cumsum(np.bincount(low, minlength=len(b_end) + 1) - np.bincount(high, minlength=len(b_end) + 1))
    b_last = np.flatnonzero(spans[: len(b_end)] == 0)
    return np.searchsorted(a_end, b_end[b_last]), b_last


def _spread(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The places start, start + 1, ... of each run of a length, one run after the other."""
    ends = np.cumsum(lengths)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - lengths), lengths)


class _Bytes:
    """Byte strings by number."""

    def __init__(self, strings: list[bytes]):
        self.length = np.fromiter(map(len, strings), np.int64, len(strings))
        self.start = np.cumsum(self.length) - self.length
        self.data = np.frombuffer(b"".join(strings), np.uint8)

    def join(self, numbers: np.ndarray) -> np.ndarray:
        return self.data[_spread(self.start[numbers], self.length[numbers])]


class _Aligner:
    """Tokens, groups and links of texts, piece by piece: each distinct piece between cuts is encoded and aligned once."""

    def __init__(self, a_path: str, b_path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a, self.b = Tokenizer.from_file(a_path), sentencepiece.SentencePieceProcessor(model_file=b_path)
        self.a.encode_special_tokens = True
        # byte-level entries: printable bytes stand for themselves, the others, in order, are the signs from 256 on
        plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
        byte = {chr(x): x for x in plain} | {chr(256 + k): x for k, x in enumerate(x for x in range(256) if x not in plain)}
        entries = {i: bytes(map(byte.__getitem__, entry)) for entry, i in self.a.get_vocab(with_added_tokens=False).items()}
        self.a_bytes = _Bytes([entries.get(i, b"") for i in range(max(entries) + 2)])
        piece = self.b.id_to_piece
        self.b_bytes = _Bytes([bytes([int(piece(i)[3:5], 16)]) if self.b.is_byte(i) else piece(i).replace("▁", " ").encode() for i in range(self.b.get_piece_size())])
        self.decimal = _Bytes([b"%d," % i for i in range(max(len(self.a_bytes.length), len(self.b_bytes.length)))])
        self.forget()

    def forget(self):
        self.known, self.slot = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.sizes = np.zeros((0, 3), np.int64)  # of a piece: A tokens (-1: bytes differ), B tokens, groups, which are also its links
        self.starts, self.links = np.zeros(1, np.int64), np.zeros(0, np.int64)
        self.text_at, self.text = np.zeros(1, np.int64), np.zeros(0, np.uint8)  # each group with a sign after it

    def learn(self, raw: bytes, starts: np.ndarray, ends: np.ndarray):
        """Encodes and aligns the pieces from `starts` to `ends` of `raw`."""
        texts = [raw[s:e].decode() for s, e in zip(starts.tolist(), ends.tolist(), strict=True)]
        a_ids, n_a = _flat([e.ids for e in self.a.encode_batch_fast(texts, add_special_tokens=False)])
        b_ids, n_b = _flat(self.b.encode([x[1:] for x in texts], num_threads=1))  # it puts a space before the text
        piece, data, same = np.arange(len(texts)), np.frombuffer(raw, np.uint8), np.ones(len(texts), dtype=bool)
        for ids, n, table in ((a_ids, n_a, self.a_bytes), (b_ids, n_b, self.b_bytes)):
            of = np.repeat(piece, n)
            same &= np.bincount(of, table.length[ids], len(texts)).astype(np.int64) == ends - starts
            kept = np.flatnonzero(same)
            differ = np.flatnonzero(table.join(ids[same[of]]) != data[_spread(starts[kept], (ends - starts)[kept])])
            same[kept[np.searchsorted(np.cumsum((ends - starts)[kept]), differ, side="right")]] = False
        a_ids, b_ids = a_ids[np.repeat(same, n_a)], b_ids[np.repeat(same, n_b)]
        n_a, n_b = n_a * same, n_b * same
        a_last, b_last = groups_of(np.cumsum(self.a_bytes.length[a_ids]), np.cumsum(self.b_bytes.length[b_ids]))
        upto = np.searchsorted(b_last, np.cumsum(n_b))
        n_g = np.diff(upto, prepend=0)
        # a group's A ids and then its B ids, one group after the other
        a_group, b_group = np.searchsorted(a_last, np.arange(len(a_ids))), np.searchsorted(b_last, np.arange(len(b_ids)))
        a_place, b_place = np.arange(len(a_ids)) + np.concatenate([[0], b_last + 1])[a_group], np.arange(len(b_ids)) + (a_last + 1)[b_group]
        order = np.empty(len(a_ids) + len(b_ids), np.int64)
        order[a_place], order[b_place] = a_ids, b_ids
        text, after = self.decimal.join(order), np.cumsum(self.decimal.length[order]) - 1
        text[after[a_place[a_last]]], text[after[b_place[b_last]]] = ord("|"), ord(";")
        self.text_at = np.concatenate([self.text_at, self.text_at[-1] + np.concatenate([[0], after + 1])[np.cumsum(n_a + n_b)]])
        self.text = np.concatenate([self.text, text])
        self.sizes = np.concatenate([self.sizes, np.stack([np.where(same, n_a, -1), n_b, n_g], axis=1)])
        self.links = np.concatenate([self.links, a_ids[a_last] << 32 | b_ids[b_last]])
        self.starts = np.concatenate([self.starts, self.starts[-1] + np.cumsum(n_g)])

    def __call__(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, Iterator[bytes], np.ndarray, np.ndarray]:
        """For each text: sizes (A tokens, B tokens, groups), its groups as text, and where its links begin in all links, which come last."""
        data, offsets = np.insert(data, offsets[:-1], 32), offsets + np.arange(len(offsets))
        at = np.flatnonzero(data[1:-1] == 32) + 1
        at = at[(_SIGN[data[at - 1]] | (data[at - 1] >= 0x80) & (data[at - 1] < 0xC0) & _LEAD[data[np.maximum(at - 2, 0)]]) & (_SIGN | _LEAD)[data[at + 1]]]
        starts = np.unique(np.concatenate([at, offsets[:-1]]))
        ends = np.append(starts[1:], len(data))
        unique, one, where = np.unique(tk.span_hashes(data, starts, ends), return_index=True, return_inverse=True)
        if len(self.known) > PIECES or len(self.text) > SIGNS:
            self.forget()
        found = np.searchsorted(self.known, unique)
        new = np.ones(len(unique), dtype=bool)
        inside = found < len(self.known)
        new[inside] = self.known[found[inside]] != unique[inside]
        if new.any():
            raw, before, first = data.tobytes(), len(self.sizes), one[new]
            for k in range(0, len(first), GIVEN):
                self.learn(raw, starts[first[k : k + GIVEN]], ends[first[k : k + GIVEN]])
            known = np.concatenate([self.known, unique[new]])
            by = np.argsort(known)
            self.known, self.slot = known[by], np.concatenate([self.slot, np.arange(before, len(self.sizes))])[by]
            found = np.searchsorted(self.known, unique)
        own = self.slot[found][where]
        first = np.searchsorted(starts, offsets)
        wrong = np.concatenate([[0], np.cumsum(self.sizes[own, 0] < 0)])
        kept = np.repeat(wrong[first[1:]] == wrong[first[:-1]], np.diff(first))
        first = np.concatenate([[0], np.cumsum(kept)])[first]
        own = own[kept]
        sums = np.concatenate([np.zeros((1, 3), np.int64), np.cumsum(self.sizes[own], axis=0)])[first]
        return np.diff(sums, axis=0), self._texts(own, first), sums[:, 2], self.links[_spread(self.starts[own], self.sizes[own, 2])]

    def _texts(self, own: np.ndarray, first: np.ndarray) -> Iterator[bytes]:
        lengths = self.text_at[own + 1] - self.text_at[own]
        upto = np.concatenate([[0], np.cumsum(lengths)])[first]
        d, n = 0, len(first) - 1
        while d < n:
            to = max(d + 1, int(np.searchsorted(upto, upto[d] + TOGETHER, side="right")) - 1)
            pieces = slice(first[d], first[to])
            block = self.text[_spread(self.text_at[own[pieces]], lengths[pieces])].tobytes()
            for k in range(d, to):
                yield block[upto[k] - upto[d] : max(upto[k], upto[k + 1] - 1) - upto[d]]
            d = to


@functools.cache
def _aligner(a_path: str, b_path: str) -> _Aligner:
    """A worker keeps its tokenizers, and the pieces it knows, from task to task."""
    return _Aligner(a_path, b_path)


def _kind(pairs: int) -> np.dtype:
    """How a place in a dictionary of so many pairs is stored."""
    return np.dtype("<u2" if pairs <= 1 << 16 else "<u4")


def _align(a_path: str, b_path: str, id_type: pa.DataType, with_groups: bool):
    schema = pa.schema([("_chunk", pa.int64()), ("_doc", id_type), *((c, pa.int64()) for c in ("n_a", "n_b", "n_groups")), ("groups_sha256", pa.string()), ("groups", pa.string()), ("_links", pa.binary()), ("_pairs", pa.binary()), ("_counts", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        align, chunk = _aligner(a_path, b_path), TaskContext.get().partitionId() << 32
        for whole in batches:
            for batch, data, offsets in tk.steps(whole, "_text", CHUNK):
                sizes, texts, starts, links = align(data, offsets)
                pairs, places, counts = np.unique(links, return_inverse=True, return_counts=True)
                kind = _kind(len(pairs))
                raw, cut, n = places.astype(kind).tobytes(), (kind.itemsize * starts).tolist(), len(sizes)
                texts = list(texts) if with_groups else texts
                hashed = [hashlib.sha256(x).hexdigest() if x else "" for x in texts]
                columns = [pa.array([chunk] * n, pa.int64()), batch.column("_doc"), *(pa.array(sizes[:, k]) for k in range(3)), pa.array(hashed, pa.string()), pa.array([x.decode() for x in texts] if with_groups else [None] * n, pa.string()), pa.array([raw[s:e] for s, e in zip(cut, cut[1:], strict=False)], pa.binary()), pa.nulls(n, pa.binary()), pa.nulls(n, pa.binary())]
                yield pa.RecordBatch.from_arrays([c.cast(f.type) if c.type != f.type else c for c, f in zip(columns, schema, strict=True)], schema=schema)
                one = {"_chunk": chunk, "_pairs": pairs.astype("<i8").tobytes(), "_counts": counts.astype("<i8").tobytes()}
                yield pa.RecordBatch.from_arrays([pa.array([one.get(f.name)], f.type) for f in schema], schema=schema)
                chunk += 1

    return run


def _entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for chunk, pairs, counts in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
            pairs = np.frombuffer(pairs, "<i8")
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(pairs), chunk)), pa.array(np.arange(len(pairs))), pa.array(pairs >> 32), pa.array(pairs & 0xFFFFFFFF), pa.array(np.frombuffer(counts, "<i8"))], names=["_chunk", "_at", "a", "b", "n"])


def _look_up(docs: pa.Table, entries: pa.Table) -> pa.Table:
    entries = entries.take(pc.sort_indices(entries, [("_at", "ascending")]))
    counts, best = entries.column("links").to_numpy(), entries.column("best").to_numpy().astype(np.int64)
    links = [np.frombuffer(x, _kind(len(counts))) for x in docs.column("_links").to_pylist()]
    docs = docs.drop_columns(["_chunk", "_links"])
    return docs.append_column("n_best", pa.array([int(best[x].sum()) for x in links], pa.int64())).append_column("count_sum", pa.array([int(counts[x].sum()) for x in links], pa.int64()))


def align_tokens(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text", with_groups: bool = True) -> tuple[DataFrame, DataFrame]:
    """How the tokens of a byte-level BPE (A, a `tokenizers` file) and of a BPE of pieces with byte fallback (B, a `sentencepiece` file) cover the same bytes.

    A encodes a space and the text, B the text, before which it puts a space; strings of special tokens are plain text. Byte offsets at which an A token and a B token both
    end cut the tokens into groups; those two tokens are a link. Two results:

    * a row per document: `id_col`, n_a, n_b, n_groups, n_links, n_best (links whose pair is the most frequent of its B id, ties included), count_sum (over its links, how many
      links of the whole table have the same pair of ids), groups_sha256 and, unless with_groups is false, groups: `a1,a2|b1;a3|b2,b3`, ids in order;
    * a row per pair of ids that is linked anywhere: a, b, links, best.

    Null and empty texts, and those that A's or B's tokens don't give back byte by byte, have no tokens: zeros and empty strings. Repeated rows and ids count each; a null id
    stays null; other columns are not looked at; an empty table gives no rows.

    Both tokenizers start anew at a space between two signs, so each distinct piece between such spaces is encoded and aligned once while a task knows it; a text without any is one piece. Links
    are written as places in a dictionary of pairs that documents of one chunk of 2 MB share. Only dictionaries are exploded, counted and joined; a chunk's documents then meet its
    dictionary with the counts of all documents. So what is shuffled per link is its place, and no pair of ids is a key for more than one row per chunk.
    """
    kind, id_type = dict(docs.dtypes)[id_col], arrow_type(docs, id_col)
    sizes = "n_a long, n_b long, n_groups long, groups_sha256 string, groups string"
    texts = docs.select(F.col(id_col).alias("_doc"), F.col(text_col).alias("_text"))
    aligned = durable(texts.mapInArrow(_align(a_path, b_path, id_type, with_groups), f"_chunk long, _doc {kind}, {sizes}, _links binary, _pairs binary, _counts binary"))
    entries = durable(aligned.where("_pairs is not null").select("_chunk", "_pairs", "_counts").mapInArrow(_entries, "_chunk long, _at long, a long, b long, n long"))
    pairs = durable(entries.groupBy("a", "b").agg(F.sum("n").alias("links")))
    highest = pairs.groupBy("b").agg(F.max("links").alias("most"))  # at most B's vocabulary, so it may be broadcast
    pairs = durable(pairs.join(F.broadcast(highest), "b").select("a", "b", "links", (F.col("links") == F.col("most")).alias("best")))
    looked = entries.join(pairs, ["a", "b"]).select("_chunk", "_at", "links", "best")
    rows = aligned.where("_pairs is null").drop("_pairs", "_counts")
    out = rows.groupBy("_chunk").cogroup(looked.groupBy("_chunk")).applyInArrow(_look_up, f"_doc {kind}, {sizes}, n_best long, count_sum long")
    columns = [F.col("_doc").alias(id_col), "n_a", "n_b", "n_groups", F.col("n_groups").alias("n_links"), "n_best", "count_sum", "groups_sha256"]
    return out.select(*columns, *(["groups"] if with_groups else [])), pairs
