"""Substring dedup by hashing lines and the sentences within them."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import durable

_CUT = re.compile(r"[.!?]+[ \t]+|\n+")


def units(text: str, long_words: int = 5) -> Iterator[tuple[int, int, int, bytes, int]]:
    """(start, end, words, digest, line) of each unit of a text, in order; blank ones are left out.

    A line ends its unit. Within a line, a sentence of `long_words` words or more ends one too, together with the shorter sentences before it;
    so where units end depends on what is near, and a passage within a longer line is cut the same way wherever it stands. The digest is
    of the unit in lower case with single blanks.
    """
    start = done = line = 0
    words: list[str] = []
    for cut in [*((m.end(), text[m.start()] == "\n") for m in _CUT.finditer(text)), (len(text), True)]:
        sentence = text[done : cut[0]].lower().split()
        done = cut[0]
        words += sentence
        if cut[1] or len(sentence) >= long_words:
            if words:
                yield start, done, len(words), xxhash.xxh3_128_digest(" ".join(words).encode("utf-8", "replace")), line
            start, words = done, []
            line += cut[1]


def _all_units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows, spans = [], []
        for i, text in enumerate(batch.column("_text").to_pylist()):
            of_text = list(units(text)) if text else []
            in_line = Counter(unit[4] for unit in of_text)
            for k, unit in enumerate(of_text):
                rows.append(i)
                spans.append((k, *unit, in_line[unit[4]]))
            if len(rows) > 100_000:
                yield _batch(batch, rows, spans)
                rows, spans = [], []
        yield _batch(batch, rows, spans)


def _batch(batch: pa.RecordBatch, rows: list[int], spans: list[tuple]) -> pa.RecordBatch:
    at = pa.array(rows, pa.int64())
    columns = zip(*spans, strict=True) if spans else [()] * 7
    kinds = (pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.int32(), pa.int32())
    return pa.RecordBatch.from_arrays([batch.column("_doc").take(at), batch.column("_key").take(at), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], ["_doc", "_key", "_at", "_start", "_end", "_words", "_digest", "_line", "_in_line"])


def drop_repeated_units(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = 16, min_line_words: int = 5) -> DataFrame:
    """Documents without the lines of `min_line_words` words or more that stand earlier, in rank order, in any document, and without runs of such units (see units()) of `min_words` words or more in all.

    A line goes if all its units stand earlier. Sentences within a line that stays, and shorter lines, go only where they follow each other in a run, as passages within longer lines do.
    Rank is (id, position); the earliest occurrence stays, the others go, in the same document too. Occurrences are counted per digest before the
    shuffle, and the join of occurrences with the earliest leaves unique digests out, so that a digest of any frequency is spread by adaptive skew handling.

    Result, a row per input row: `id_col`, text (what stays; null if it was null), removed (array of start, end in the original, in characters),
    n_units, n_removed, removed_chars. Null and blank texts have no units. Documents are told apart by id and text; rows equal in both are one document. A null id ranks first. Other
    columns are not looked at. An empty table gives no rows. Digests have 128 bits.
    """
    kind = dict(docs.dtypes)[id_col]
    texts = docs.select(F.col(id_col).alias("_doc"), F.xxhash64(F.col(text_col)).alias("_key"), F.col(text_col).alias("_text"))
    found = durable(texts.mapInArrow(_all_units, f"_doc {kind}, _key long, _at int, _start int, _end int, _words int, _digest binary, _line int, _in_line int"))
    first = found.groupBy("_digest").agg(F.count("*").alias("_n"), F.min(F.struct("_doc", "_key", "_at")).alias("_first")).where("_n > 1")
    again = found.join(first.select("_digest", "_first"), "_digest").where(~F.struct("_doc", "_key", "_at").eqNullSafe(F.col("_first")))
    again = again.groupBy("_doc", "_key", "_at").agg(*(F.first(c).alias(c) for c in ("_start", "_end", "_words", "_line", "_in_line")))
    # units that follow each other differ from their numbers among the repeated ones by the same
    again = again.withColumn("_run", F.col("_at") - F.row_number().over(Window.partitionBy("_doc", "_key").orderBy("_at")))
    run, line = Window.partitionBy("_doc", "_key", "_run"), Window.partitionBy("_doc", "_key", "_line")
    again = again.withColumn("_all", F.sum("_words").over(run)).withColumn("_whole", (F.count("*").over(line) == F.col("_in_line")) & (F.sum("_words").over(line) >= min_line_words))
    again = again.where(F.col("_whole") | (F.col("_all") >= min_words))
    spans = again.groupBy("_doc", "_key").agg(F.sort_array(F.collect_list(F.struct(F.col("_start").alias("start"), F.col("_end").alias("end")))).alias("removed"))
    number = found.groupBy("_doc", "_key").agg(F.countDistinct("_at").alias("n_units"))
    facts = number.join(spans.select(F.col("_doc").alias("_d"), F.col("_key").alias("_k"), "removed"), F.col("_doc").eqNullSafe(F.col("_d")) & (F.col("_key") == F.col("_k")), "left").select(F.col("_doc").alias("_id"), F.col("_key").alias("_of"), "n_units", "removed")
    out = texts.join(facts, F.col("_doc").eqNullSafe(F.col("_id")) & (F.col("_key") == F.col("_of")), "left")
    none = F.array().cast("array<struct<start: int, end: int>>")
    removed = F.coalesce("removed", none)
    starts, ends = F.concat(F.array(F.lit(0)), removed["end"]), F.concat(removed["start"], F.array(F.length("_text")))
    rest = F.array_join(F.zip_with(starts, ends, lambda a, b: F.substring("_text", a + 1, b - a)), "")
    rest = F.when(F.size(removed) == 0, F.col("_text")).otherwise(rest)
    chars = F.aggregate(removed, F.lit(0).cast("long"), lambda a, x: a + x["end"] - x["start"])
    return out.select(F.col("_doc").alias(id_col), rest.alias("text"), removed.alias("removed"), F.coalesce("n_units", F.lit(0)).alias("n_units"), F.size(removed).cast("long").alias("n_removed"), chars.alias("removed_chars"))
