"""Benchmark decontamination by a prefix-filtered set join."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import tokens as tk
from .common import bitmap, durable, filter_power, small

#: Words of the shingles that stand for a window in the join; a shorter window is one shingle.
SHINGLE = 3


def _text(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> str:
    return b" ".join(data[s:e].tobytes() for s, e in zip(starts, ends, strict=True)).decode("utf-8", "replace")


def _windows(window: int):
    """Rows (_item, _window, _n, _shingle, _at): every distinct shingle of each window of an item."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch, data, offsets in tk.steps(whole, "_text"):
                data = tk.LOWER[data]
                starts, ends, first = tk.word_bounds(data, offsets, tk.ALNUM)
                h = tk.span_hashes(data, starts, ends)
                out: dict[str, list] = {k: [] for k in ("_item", "_window", "_n", "_shingle", "_at")}
                for d, item in enumerate(batch.column("_item").to_pylist()):
                    size = min(window, int(first[d + 1] - first[d]))
                    width = min(SHINGLE, size)
                    for at in range(first[d], first[d + 1] - size + 1) if size else ():
                        text = _text(data, starts[at : at + size], ends[at : at + size])
                        s, _ = tk.shingles(h, np.array([at, at + size]), width)
                        for shingle, offset in dict(zip(s.view(np.int64).tolist()[::-1], range(len(s) - 1, -1, -1), strict=True)).items():
                            for k, v in zip(out, (item, text, size, shingle, offset), strict=True):
                                out[k].append(v)
                yield pa.RecordBatch.from_pydict(out, schema=pa.schema([("_item", pa.string()), ("_window", pa.string()), ("_n", pa.int32()), ("_shingle", pa.int64()), ("_at", pa.int32())]))

    return run


def _seen(bits, widths: tuple[int, ...]):
    """Rows (_shingle): each document's distinct shingles that pass the filter."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.frombuffer(bits.value, dtype=np.uint8)
        for whole in batches:
            for _, data, offsets in tk.steps(whole, "_text"):
                data = tk.LOWER[data]
                starts, ends, first = tk.word_bounds(data, offsets, tk.ALNUM)
                h = tk.span_hashes(data, starts, ends)
                for width in widths:
                    s, begin = tk.shingles(h, first, width)
                    at = np.flatnonzero(tk.in_bits(s, table))
                    doc = np.searchsorted(begin, at, side="right") - 1
                    once = np.unique(np.stack([doc.astype(np.uint64), s[at]], axis=1), axis=0)[:, 1] if len(at) else s[:0]
                    yield pa.RecordBatch.from_arrays([pa.array(once.view(np.int64) if len(at) else once.astype(np.int64))], ["_shingle"])

    return run


def _candidates(bits, widths: tuple[int, ...], window: int):
    """One row per document: its number of words and the places that may hold a prefix shingle, each with the words around it."""
    place = pa.struct([("shingle", pa.int64()), ("at", pa.int32()), ("low", pa.int32()), ("words", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.frombuffer(bits.value, dtype=np.uint8)
        for whole in batches:
            for batch, data, offsets in tk.steps(whole, "_text"):
                data = tk.LOWER[data]
                starts, ends, first = tk.word_bounds(data, offsets, tk.ALNUM)
                h = tk.span_hashes(data, starts, ends)
                places: list[list[dict]] = [[] for _ in range(batch.num_rows)]
                for width in widths:
                    s, begin = tk.shingles(h, first, width)
                    found = np.flatnonzero(tk.in_bits(s, table))
                    docs = np.searchsorted(begin, found, side="right") - 1
                    for shingle, d, at in zip(s[found].view(np.int64).tolist(), docs.tolist(), (found - begin[docs]).tolist(), strict=True):
                        # a window of one shingle needs no other words; others reach this far at most
                        reach = window if width == SHINGLE else width
                        low, high = max(0, at - reach + width), min(int(first[d + 1] - first[d]), at + reach)
                        places[d].append({"shingle": shingle, "at": at, "low": low, "words": _text(data, starts[first[d] + low : first[d] + high], ends[first[d] + low : first[d] + high])})
                yield pa.RecordBatch.from_arrays([batch.column("_doc"), batch.column("_key"), pa.array(np.diff(first)), pa.array(places, type=pa.list_(place))], ["_doc", "_key", "_words", "_places"])

    return run


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = 13, hit_share: tuple[int, int] = (1, 20)) -> DataFrame:
    """Documents with the benchmark windows that they contain.

    A window is `window` consecutive words of an item, or all words of a shorter one. Each window is the set of its 3-word shingles; since
    it must be contained whole, one prefix token decides: its rarest shingle by document count over all documents. Documents join
    windows on that token only; a pair survives if the window fits between the document's first and last word at the position that the
    shared token implies, and if the words there equal the window's.

    Result, a row per input row: `id_col`, _key (hash of the text), n_words, n_hit (words inside any occurrence), n_items, items (sorted
    strings), contaminated (n_hit > 0 and n_hit / n_words >= hit_share). Documents are told apart by id and text; equal rows get equal
    results. Null or wordless text: no words, not contaminated. Items without words never match; a null item id counts as ''. Other
    columns of either table are not looked at. Empty tables give no rows, or rows without hits.
    """
    spark = docs.sparkSession
    items = benchmark.select(F.coalesce(F.col(item_col).cast("string"), F.lit("")).alias("_item"), F.col(item_text_col).alias("_text"))
    shingles = durable(items.mapInArrow(_windows(window), "_item string, _window string, _n int, _shingle long, _at int"))
    widths = tuple(sorted({r[0] for r in shingles.select(F.least(F.col("_n"), F.lit(SHINGLE))).distinct().collect()}))
    texts = docs.select(F.col(id_col).alias("_doc"), F.xxhash64(F.col(text_col)).alias("_key"), F.col(text_col).alias("_text"))

    bits = spark.sparkContext.broadcast(bitmap(shingles, "_shingle", filter_power(shingles.count())))
    counts = texts.select("_text").mapInArrow(_seen(bits, widths), "_shingle long").groupBy("_shingle").agg(F.count("*").alias("_docs"))
    # a window with a shingle that no document has can't occur
    rarest = F.min(F.struct("_docs", "_shingle", "_at"))
    prefix = durable(shingles.select("_window", "_n", "_shingle", "_at").distinct().join(counts, "_shingle", "left").withColumn("_docs", F.coalesce("_docs", F.lit(0))).groupBy("_window", "_n").agg(rarest.alias("_r")).where("_r._docs > 0").select("_window", "_n", "_r._shingle", "_r._at"))
    holders = shingles.groupBy("_window").agg(F.sort_array(F.collect_set("_item")).alias("_items"))

    bits = spark.sparkContext.broadcast(bitmap(prefix, "_shingle", filter_power(prefix.count())))
    place = "struct<shingle: long, at: int, low: int, words: string>"
    found = texts.mapInArrow(_candidates(bits, widths, window), f"_doc {dict(texts.dtypes)['_doc']}, _key long, _words long, _places array<{place}>")
    found = durable(found)
    places = found.select("_doc", "_key", "_words", F.explode("_places").alias("_p"))
    start = F.col("_p.at") - F.col("_at")
    inside = (start >= 0) & (start + F.col("_n") <= F.col("_words"))
    there = F.array_join(F.slice(F.split("_p.words", " "), start - F.col("_p.low") + 1, F.col("_n")), " ")
    matched = places.join(small(prefix), F.col("_p.shingle") == F.col("_shingle")).where(inside & (there == F.col("_window")))
    matched = matched.select("_doc", "_key", "_words", F.lit(False).alias("_own"), F.struct(start.alias("s"), (start + F.col("_n")).alias("e")).alias("_span"), "_window")
    matched = matched.join(small(durable(holders)), "_window").drop("_window")
    # a row per document by itself, after the joins, so that documents without places are no key of theirs
    own = found.select("_doc", "_key", "_words", F.lit(True).alias("_own"), *(F.lit(None).cast(matched.schema[c].dataType).alias(c) for c in ("_span", "_items")))
    matched = matched.unionByName(own)
    spans = F.array_sort(F.collect_set("_span"))
    covered = F.aggregate(spans, F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("to")), lambda a, x: F.struct((a["n"] + F.greatest(F.lit(0), x["e"] - F.greatest(x["s"], a["to"]))).alias("n"), F.greatest(a["to"], x["e"]).alias("to")))["n"]
    out = matched.groupBy("_doc", "_key", "_words").agg(F.count_if("_own").cast("int").alias("_rows"), covered.alias("n_hit"), F.sort_array(F.array_distinct(F.flatten(F.collect_set("_items")))).alias("items"))
    share = (F.col("n_hit") > 0) & (F.col("n_hit") * hit_share[1] >= F.col("_words") * hit_share[0])
    return out.select(F.col("_doc").alias(id_col), "_key", F.col("_words").alias("n_words"), "n_hit", F.size("items").cast("long").alias("n_items"), "items", share.alias("contaminated"), F.explode(F.sequence(F.lit(1), F.col("_rows"))).alias("_copy")).drop("_copy")
