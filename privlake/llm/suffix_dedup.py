"""Removal of byte strings that occur again, by suffix arrays over what anchors leave."""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache, reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import tokens as tk
from .common import BROADCAST_ROWS, arrow_type, bitmap, durable, filter_power, small
from .suffix_array import suffix_array

#: Bytes of the grams among which anchors are chosen, and of the cells that are the suffix array's symbols.
GRAM = 40
CELL = 8
#: Filters hold at most so many hashes; beyond, tables are joined by shuffle instead.
FILTER_ROWS = 1 << 25
#: Over how many keys the rows of one text are dealt when spans meet texts.
SALTS = 64
#: Symbols that are gathered for one suffix array, unless one anchor has more.
SYMBOLS = 3000
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
#: Bits of a value that hold a position within a step; the rest is the gram's hash.
_PLACE = 28


@cache
def _all_powers(base: int, n: int) -> np.ndarray:
    a = np.full(n, base, dtype=np.uint64)
    a[:1] = 1
    return np.cumprod(a)


def _powers(base: int, n: int) -> np.ndarray:
    """The first powers of `base` modulo 2**64; those of a common step are kept."""
    return (_all_powers if n <= tk.STEP_BYTES else _all_powers.__wrapped__)(base, max(n, tk.STEP_BYTES))[:n]


def anchored(data: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, ...]:
    """First and last start of each run of `size`-byte windows with one anchor, the anchor's place, and a hash of its gram.

    A window's anchor is the leftmost of its grams with the smallest hash, which depends on the window's bytes alone: equal windows have
    equal anchors at equal distance. Windows lie within a document. A text of 2**28 bytes or more is cut into parts that share `size` - 1 bytes.
    """
    n, gram = len(data), min(GRAM, size)
    if n >> _PLACE:
        ends = [(a, min(b, a + (1 << (_PLACE - 1)) + size - 1)) for o, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True) for a in range(o, max(o + 1, b - size + 1), 1 << (_PLACE - 1))]
        parts = [(a, anchored(data[a:b], np.array([0, b - a]), size)) for a, b in ends]
        return *(np.concatenate([x[k] + a for a, x in parts]) for k in range(3)), np.concatenate([x[3] for _, x in parts])
    first, last = offsets[:-1], offsets[1:] - size
    first, last = first[last >= first], last[last >= first]
    if not len(first):
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),)
    sums = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum((data.astype(np.uint64) + tk.U64(1)) * _powers(_BASE, n), out=sums[1:])
    grams = tk.mix((sums[gram:] - sums[:-gram]) * _powers(_INVERSE, n)[: n - gram + 1])
    values = (grams >> tk.U64(_PLACE) << tk.U64(_PLACE)) | np.arange(len(grams), dtype=np.uint64)
    width = size - gram + 1
    blocks = np.full(-(-len(values) // width) * width, ~tk.U64(0))
    blocks[: len(values)] = values
    blocks = blocks.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    at = (np.minimum(behind[: n - size + 1], ahead[width - 1 : n - size + width]) & tk.U64((1 << _PLACE) - 1)).astype(np.int64)
    inside = np.zeros(n - size + 2, dtype=np.int32)
    inside[first] += 1
    np.subtract.at(inside, last + 1, 1)
    starts = np.flatnonzero(np.cumsum(inside)[:-1] > 0)
    opens = np.zeros(n + 1, dtype=bool)
    opens[first] = True
    new = np.flatnonzero(np.concatenate([[True], (at[starts][1:] != at[starts][:-1]) | opens[starts[1:]]]))
    places = at[starts[new]]
    # the smallest of many hashes begin with zeros: mixed once more, they fill a filter evenly
    return starts[new], starts[np.append(new[1:], len(starts)) - 1], places, tk.mix(grams[places])


def _unskipped(batch: pa.RecordBatch, skip: np.ndarray | None) -> pa.RecordBatch:
    return batch if skip is None else batch.filter(pa.array(~tk.in_bits(batch.column("_d0").to_numpy().view(np.uint64), skip)))


def _bits(shared) -> np.ndarray | None:
    return np.frombuffer(shared.value, dtype=np.uint8) if shared else None


def _apart(copies):
    """The rows whose digest may be among those of copies."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = _bits(copies)
        for batch in batches:
            yield batch.filter(pa.array(tk.in_bits(batch.column("_d0").to_numpy().view(np.uint64), bits)))

    return run


def _anchors(size: int, skip):
    """Rows (anchor, n): how often each anchor gram occurs in a step."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        skipped = _bits(skip)
        for whole in batches:
            for _, data, offsets in tk.steps(_unskipped(whole, skipped), "_text"):
                u, n = np.unique(anchored(data, offsets, size)[3], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(n)], ["anchor", "n"])

    return run


def _contexts(size: int, skip, chosen, hot, owners, with_bytes: bool = False):
    """Contexts (the bytes of a run of windows) of chosen anchors, of all without `chosen`. Hot anchors' are cut into single windows, which are their own anchors.

    A row (text, salt, start, number of windows, anchor, context) per occurrence; with_bytes: a row (context, place of the anchor, bytes) per
    occurrence that is among `owners`, or in a row's list _own of starts.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        skipped, wanted, split, own = _bits(skip), _bits(chosen), _bits(hot), _bits(owners)
        for whole in batches:
            for batch, data, offsets in tk.steps(_unskipped(whole, skipped), "_text"):
                first, last, place, gram = anchored(data, offsets, size)
                if wanted is not None:
                    keep = np.flatnonzero(tk.in_bits(gram, wanted))
                    first, last, place, gram = first[keep], last[keep], place[keep], gram[keep]
                if split is not None and len(first):
                    cut = tk.in_bits(gram, split)
                    many = np.where(cut, last - first + 1, 1)
                    shift = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
                    single = np.repeat(cut, many)
                    first, last, place, gram = (np.repeat(x, many) for x in (first, last, place, gram))
                    first = first + np.where(single, shift, 0)
                    last = np.where(single, first, last)
                else:
                    single = np.zeros(len(first), dtype=bool)
                raw = data.tobytes()
                doc = np.searchsorted(offsets, first, side="right") - 1
                keys = b"".join([xxhash.xxh3_128_digest(raw[a : b + size] + (p - a).to_bytes(8, "little")) for a, b, p in zip(first.tolist(), last.tolist(), place.tolist(), strict=True)])
                c0, c1 = np.frombuffer(keys, dtype="<u8").reshape(-1, 2).T
                gram = np.where(single, c0, gram)
                start, d0 = first - offsets[doc], batch.column("_d0").to_numpy().view(np.uint64)[doc]
                if not with_bytes:
                    at = pa.array(doc)
                    yield pa.RecordBatch.from_arrays([batch.column("_d0").take(at), batch.column("_d1").take(at), batch.column("_salt").take(at), pa.array(start.astype(np.int32)), pa.array((last - first + 1).astype(np.int32)), *(pa.array(np.ascontiguousarray(x).view(np.int64)) for x in (gram, c0, c1))], ["_d0", "_d1", "_salt", "start", "many", "anchor", "c0", "c1"])
                    continue
                if own is not None:
                    at = np.flatnonzero(tk.in_bits(_mark(d0, c0, start), own))
                else:
                    named = [set(x) for x in batch.column("_own").to_pylist()]
                    at = np.array([i for i, (d, p) in enumerate(zip(doc.tolist(), start.tolist(), strict=True)) if p in named[d]], dtype=np.int64)
                yield pa.RecordBatch.from_arrays([*(pa.array(np.ascontiguousarray(x[at]).view(np.int64)) for x in (c0, c1)), pa.array((place - first)[at]), pa.array([raw[first[i] : last[i] + size] for i in at], pa.binary())], ["c0", "c1", "left", "bytes"])

    return run


def _mark(d0: np.ndarray, c0: np.ndarray, start: np.ndarray) -> np.ndarray:
    """A name for one occurrence of a context; the same as _mark_column()."""
    return d0 ^ c0 ^ (start.astype(np.uint64) << tk.U64(36))


def _mark_column():
    return F.col("_d0").bitwiseXOR(F.col("c0")).bitwiseXOR(F.shiftleft(F.col("start").cast("long"), 36))


def repeated_starts(contexts: list[tuple[bytes, int, int]], size: int) -> list[np.ndarray]:
    """Which windows of each context (bytes, place of its anchor, number of occurrences) occur more than once among all of them.

    Contexts are laid out in cells with their anchors on a cell's border, so that equal windows have equal cells. The suffix array of the cells
    brings together all suffixes that share the whole cells of a window; the few bytes before and after them are compared directly.
    """
    text, begins, borders, keeps = bytearray(), [], [], []
    for k, (raw, left, _) in enumerate(contexts):
        pad = -left % CELL
        text += bytes(pad)
        begins.append(len(text))
        text += raw
        # the borders at or after each start
        low = len(text) - len(raw)
        firsts = np.arange(-(-low // CELL) * CELL, low + len(raw) - size + CELL, CELL)
        borders.append(firsts)
        keeps.append(np.full(len(firsts), k))
        text += bytes(-len(text) % CELL + CELL)  # the last cell becomes a separator
    cells = np.frombuffer(bytes(text), dtype="<u8")
    border, owner = np.concatenate(borders), np.concatenate(keeps)
    _, symbols = np.unique(cells, return_inverse=True)
    symbols = symbols + len(contexts) + 1
    stops = np.append(np.array(begins[1:], dtype=np.int64) // CELL - 1, len(cells) - 1)
    symbols[stops] = np.arange(len(contexts))[::-1]
    of = np.full(len(cells), -1)
    fits = border // CELL < len(cells)
    of[border[fits] // CELL] = owner[fits]
    order = np.asarray(suffix_array(symbols.tolist()))
    order = order[of[order] >= 0]
    raw, owners, core = bytes(text), of[order].tolist(), (size - CELL + 1) // CELL * CELL
    found = [np.zeros(len(c[0]) - size + 1, dtype=bool) for c in contexts]
    at, places = 0, (order * CELL).tolist()
    while at < len(places):
        to, head = at + 1, raw[places[at] : places[at] + core]
        while to < len(places) and raw[places[to] : places[to] + core] == head:
            to += 1
        if to - at > 1 or contexts[owners[at]][2] > 1:
            windows: dict[tuple[int, bytes], list[tuple[int, int]]] = {}
            for c, k in zip(places[at:to], owners[at:to], strict=True):
                base, many = begins[k], len(found[k])
                for back in range(CELL):
                    p = c - back - base
                    if 0 <= p < many:
                        windows.setdefault((back, raw[base + p : base + p + size]), []).append((k, p))
            for same in windows.values():
                if len(same) > 1 or contexts[same[0][0]][2] > 1:
                    for k, p in same:
                        found[k][p] = True
        at = to
    return found


def _resolve(size: int):
    """Rows (c0, c1, runs) of contexts that occur once and have repeated windows; the input comes in order of anchor and context."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        symbols, anchor, context = 0, None, None

        def flush() -> pa.RecordBatch:
            out = []
            for (key, *_, n), mask in zip(held, repeated_starts([(raw, left, n) for _, raw, left, n in held], size), strict=True):
                edges = np.flatnonzero(np.diff(np.concatenate([[False], mask, [False]]).astype(np.int8))) if n == 1 else ()
                if len(edges):
                    out.append((*key, [{"low": int(a), "high": int(b)} for a, b in zip(edges[::2], edges[1::2], strict=True)]))
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in out], pa.int64()), pa.array([r[1] for r in out], pa.int64()), pa.array([r[2] for r in out], pa.list_(pa.struct([("low", pa.int32()), ("high", pa.int32())])))], ["c0", "c1", "runs"])

        for batch in batches:
            for a, c0, c1, left, raw, n in zip(*(batch.column(c).to_pylist() for c in ("anchor", "c0", "c1", "left", "bytes", "n")), strict=True):
                if a != anchor and symbols > SYMBOLS:
                    yield flush()
                    held, symbols = [], 0
                if a != anchor or (c0, c1) != context:
                    held.append(((c0, c1), raw, left, n))
                    symbols += len(raw) // CELL
                anchor, context = a, (c0, c1)
        if held:
            yield flush()

    return run


def _apply(size: int, id_type: pa.DataType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch, data, offsets in tk.steps(whole, "_text"):
                rows: dict[str, list] = {k: [] for k in ("n_bytes", "n_removed", "removed", "kept")}
                for d, spans in enumerate(batch.column("_spans").to_pylist()):
                    own = data[offsets[d] : offsets[d + 1]]
                    stay, out = np.ones(len(own), dtype=bool), []
                    for s in sorted((x["low"], x["high"]) for x in spans or ()):
                        stay[s[0] : s[1] + size - 1] = False
                    edges = np.flatnonzero(np.diff(np.concatenate([[True], stay, [True]]).astype(np.int8)))
                    out = [{"start": int(a), "end": int(b)} for a, b in zip(edges[::2], edges[1::2], strict=True)]
                    rows["n_bytes"].append(len(own))
                    rows["n_removed"].append(len(own) - int(stay.sum()))
                    rows["removed"].append(out)
                    rows["kept"].append(own[stay].tobytes())
                span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
                yield pa.RecordBatch.from_arrays([batch.column("_doc").cast(id_type), pa.array(rows["n_bytes"]), pa.array(rows["n_removed"]), pa.array(rows["removed"], span), pa.array(rows["kept"], pa.binary())], ["_doc", "n_bytes", "n_removed", "removed", "kept"])

    return run


def drop_repeated_bytes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 200, hot_contexts: int = 20_000, filter_rows: int = FILTER_ROWS) -> DataFrame:
    """Documents without the bytes that any `size`-byte string covers which also starts anywhere else, in the same document or another.

    A text that several rows have is removed whole and takes part once. Every window of `size` bytes belongs to one anchor, a gram that its bytes
    choose. Anchors that occur once are left out: their windows do too. The windows of one anchor occurrence, with all their bytes, are a context;
    equal contexts are counted and all their windows repeat. An anchor that has contexts occurring once, beside others, has all its contexts
    gathered in one suffix array, built by linear grouping, which shows the windows they share. An anchor with more than `hot_contexts`
    different contexts has them cut into single windows, which meet by their own digests and need no array. Filters of at most `filter_rows` hashes, which are counted, only
    select before exact joins; where there are more, joins by shuffle select instead. Texts and contexts are told apart by 128-bit hashes, the windows in a suffix array by their bytes.

    Result, a row per input row: `id_col`, n_bytes, n_removed, removed (array of start, end: maximal removed runs, in bytes), kept (binary). Null text is empty.
    A row that is repeated is a text that starts elsewhere too. Other columns are not looked at. An empty table gives no rows.
    """
    spark = docs.sparkSession
    kind, id_type = dict(docs.dtypes)[id_col], arrow_type(docs, id_col)
    texts = docs.select(F.col(id_col).alias("_doc"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    digest = F.conv(F.substring(F.md5(F.encode("_text", "UTF-8")), 1, 16), 16, -10).cast("long")
    texts = texts.select("_doc", "_text", F.xxhash64("_text").alias("_d0"), digest.alias("_d1"), F.pmod(F.xxhash64("_doc"), F.lit(SALTS)).cast("int").alias("_salt"))
    windows = texts.where(F.octet_length("_text") >= size).select("_text", "_d0", "_d1", "_salt")

    def share(hashes: DataFrame, column: str, rows: int):
        return spark.sparkContext.broadcast(bitmap(hashes, column, filter_power(rows)))

    copies = durable(windows.groupBy("_d0", "_d1").agg(F.count("*").alias("n"), F.first(F.octet_length("_text")).alias("bytes")).where("n > 1"))
    number, skip, parts = copies.count(), None, []
    if number:
        # a few others pass the filter; they are told apart by their counts
        skip = share(copies, "_d0", number)
        once = windows.mapInArrow(_apart(skip), windows.schema).groupBy("_d0", "_d1").agg(F.first("_text").alias("_text"), F.when(F.count("*") > 1, -1).otherwise(F.first("_salt")).cast("int").alias("_salt"))
        parts.append((durable(once), None))
    parts.append((windows, skip))

    def each(function, schema: str, *args, **named) -> DataFrame:
        return reduce(DataFrame.unionByName, (table.mapInArrow(function(size, skipped, *args, **named), schema) for table, skipped in parts))

    twice = durable(each(_anchors, "anchor long, n long").groupBy("anchor").agg(F.sum("n").alias("n")).where("n > 1").select("anchor"))
    number = twice.count()
    chosen = share(twice, "anchor", number) if number <= filter_rows else None

    def found(bits, hot) -> tuple[DataFrame, DataFrame]:
        held = each(_contexts, "_d0 long, _d1 long, _salt int, start int, many int, anchor long, c0 long, c1 long", bits, hot, None)
        held = durable(held if bits else held.join(twice, "anchor", "left_semi"))
        return held, durable(held.groupBy("anchor", "c0", "c1").agg(F.count("*").alias("n"), F.min(_mark_column()).alias("mark")))

    held, kinds = found(chosen, None)
    crowded = durable(kinds.groupBy("anchor").count().where(F.col("count") > hot_contexts).select("anchor"))
    number, hot = crowded.count(), None
    if number:
        hot = share(crowded, "anchor", number)
        crowded = small(crowded)
        held, kinds = (whole.join(crowded, "anchor", "left_anti").unionByName(cut) for whole, cut in zip((held, kinds), found(hot, hot), strict=True))
        held, kinds = durable(held), durable(kinds)
    mixed = kinds.groupBy("anchor").agg(F.count("*").alias("all"), F.count_if(F.col("n") == 1).alias("lone")).where("all > 1 and lone > 0").select("anchor")
    if hot:
        # single windows that are equal have been counted as equal, so the others have nothing to share
        mixed = mixed.join(crowded, "anchor", "left_anti")
    known = durable(kinds.join(mixed, "anchor", "left_semi"))
    number = known.count()
    if number <= filter_rows:
        whole = each(_contexts, "c0 long, c1 long, left long, bytes binary", chosen, hot, share(known, "mark", number), with_bytes=True)
    else:
        owners = held.join(known.select("c0", "c1"), ["c0", "c1"], "left_semi").groupBy("c0", "c1").agg(F.min(F.struct("_d0", "_d1", "start")).alias("o"))
        owners = owners.groupBy("o._d0", "o._d1").agg(F.collect_set("o.start").alias("_own"))
        parts = [(table.join(owners, ["_d0", "_d1"]), skipped) for table, skipped in parts]
        whole = each(_contexts, "c0 long, c1 long, left long, bytes binary", chosen, hot, None, with_bytes=True)
    whole = whole.join(known.select("anchor", "c0", "c1", "n"), ["c0", "c1"]).repartition("anchor").sortWithinPartitions("anchor", "c0", "c1")
    runs = durable(whole.select("anchor", "c0", "c1", "left", "bytes", "n").mapInArrow(_resolve(size), "c0 long, c1 long, runs array<struct<low: int, high: int>>"))

    # contexts that occur most often are few, as all occurrences were counted: they are broadcast, and the others' joins have no hot keys
    limit = max(1000, held.count() // BROADCAST_ROWS + 1)
    own, span = held.where("_salt >= 0").select("_d0", "_d1", "_salt", "start", "many", "c0", "c1"), ("_d0", "_d1", "_salt")
    again = kinds.where("n > 1").select("c0", "c1", "n")
    all_of = lambda table: own.join(table.select("c0", "c1"), ["c0", "c1"]).select(*span, F.col("start").alias("low"), (F.col("start") + F.col("many")).alias("high"))
    spans = all_of(F.broadcast(again.where(F.col("n") >= limit))).union(all_of(again.where(F.col("n") < limit)))
    some = own.join(runs, ["c0", "c1"]).select(*span, "start", F.explode("runs").alias("r"))
    spans = spans.union(some.select(*span, (F.col("start") + F.col("r.low")).alias("low"), (F.col("start") + F.col("r.high")).alias("high")))
    copied = copies.select("_d0", "_d1", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_salt"), F.lit(0).alias("low"), (F.col("bytes") - size + 1).cast("int").alias("high"))
    spans = spans.union(copied).groupBy(*span).agg(F.collect_list(F.struct("low", "high")).alias("_spans"))
    out = texts.join(spans, list(span), "left").select("_doc", "_text", "_spans")
    return out.mapInArrow(_apply(size, id_type), f"_doc {kind}, n_bytes long, n_removed long, removed array<struct<start: int, end: int>>, kept binary").withColumnRenamed("_doc", id_col)
