"""Line dedup by a log-template tree, in DataFrame functions only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import durable, small

_WS = r" \t\r\f\x0B"
_BLANKS = " \t\r\f\x0b"
VARIABLE = "<*>"
#: A position that lines of a leaf differ in, until templates are compared.
DIFFERS = "<?>"


def _tokens(line: Column) -> Column:
    """Tokens between white space; one that holds a digit is a variable. The look-behind keeps this linear in very long tokens."""
    general = F.when(line.rlike("[0-9]"), F.regexp_replace(line, rf"(?<![^{_WS}])[^{_WS}0-9]*+[0-9][^{_WS}]*+", VARIABLE)).otherwise(line)
    return F.split(F.btrim(general, F.lit(_BLANKS)), rf"[{_WS}]+")


def drop_recurring_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", columns: Sequence[str] = (), depth: int = 3, min_docs: int = 10, min_constant: float = 0.8, keep_first: bool = False, min_texts: int | None = None, min_chars: int = 100) -> DataFrame:
    """Documents without the lines whose template recurs in `min_docs` documents or more.

    The tree has a fixed depth: lines part by their number of tokens, then by their first `depth` tokens, where a token with a digit is a
    variable. Within a leaf, a token at a later position stays constant if lines of `min_docs` documents have it there; else that position
    is a variable too. A line's template is its leaf and the tokens so generalised; it counts only if at least `min_constant` of its tokens are
    constant or hold digits, and at least half are constant. Documents of equal text count once, so that copies alone make no line recur. Leaves with fewer documents than `min_docs` are left out
    before tokens are looked at; copies of a line are counted before any join. All occurrences of a recurring template go, or, with
    `keep_first`, all but that of the smallest (id, line).

    With `min_texts`, a line of `min_chars` characters or more, blanks at its ends left out, that stands verbatim in so many different texts goes too, whatever its template, but
    for its first occurrence, the smallest (id, line): that and the same line of documents with the very same text stay, so that copies stay copies.

    Result, a row per input row: `id_col`, text (the rest, joined by line feeds; null if it was null), n_lines, n_dropped, and `columns`. Blank lines stay.
    Null text has no lines; empty text has one, blank. Documents are told apart by id and text. Other columns are not looked at. An empty
    table gives no rows. Lines and leaves are compared by 64-bit hashes.
    """
    texts = docs.select(F.col(id_col).alias("_doc"), F.col(text_col).alias("_text"), F.xxhash64(F.col(text_col)).alias("_key"))
    lines = texts.where(F.col("_text").isNotNull()).select("_doc", "_key", F.posexplode(F.split("_text", "\n")).alias("_line", "_raw")).withColumn("_tokens", _tokens(F.col("_raw"))).where(F.col("_tokens")[0] != "")
    whole = F.btrim("_raw", F.lit(_BLANKS))
    same = [F.when(F.length(whole) >= min_chars, F.xxhash64(whole)).alias("_same")] if min_texts else []
    leaf = F.xxhash64(F.size("_tokens"), F.slice("_tokens", 1, depth))
    lines = lines.select("_doc", "_key", "_line", "_tokens", leaf.alias("_leaf"), F.xxhash64("_tokens").alias("_hash"), *same)

    marks = durable(lines.drop("_tokens"))
    once = marks.select("_leaf", "_hash", "_key").distinct()
    full = small(durable(once.groupBy("_leaf").count().where(F.col("count") >= min_docs).select("_leaf")))
    named = lines.select("_leaf", "_hash", "_tokens").join(full, "_leaf", "left_semi").dropDuplicates(["_leaf", "_hash"])
    number = once.groupBy("_leaf", "_hash").agg(F.count("*").alias("_docs"))
    named = durable(named.join(number, ["_leaf", "_hash"]))

    places = named.select("_leaf", "_hash", "_docs", F.posexplode("_tokens").alias("_at", "_token")).where((F.col("_at") >= depth) & (F.col("_token") != VARIABLE))
    constant = places.groupBy("_leaf", "_at", "_token").agg(F.sum("_docs").alias("_docs")).where(F.col("_docs") >= min_docs).drop("_docs")
    held = places.drop("_docs").join(constant, ["_leaf", "_at", "_token"]).groupBy("_leaf", "_hash").agg(F.collect_set("_at").alias("_held"))
    general = F.transform("_tokens", lambda t, i: F.when((i < depth) | (t == VARIABLE) | F.array_contains(F.coalesce("_held", F.array().cast("array<int>")), i), t).otherwise(DIFFERS))
    shaped = named.join(held, ["_leaf", "_hash"], "left").withColumn("_general", general)
    size = F.size("_general")
    alike, constant = F.size(F.filter("_general", lambda t: t != DIFFERS)), F.size(F.filter("_general", lambda t: ~t.isin(DIFFERS, VARIABLE)))
    template = F.xxhash64(F.transform("_general", lambda t: F.when(t == DIFFERS, VARIABLE).otherwise(t)))
    shaped = shaped.where((alike >= size * min_constant) & (constant * 2 >= size)).select("_leaf", "_hash", template.alias("_template"))
    # written, so that both sides of the joins below are shuffled by themselves and a very common line can be split
    shaped = small(durable(shaped))
    recurring = once.join(shaped, ["_leaf", "_hash"]).select("_template", "_key").distinct().groupBy("_template").count().where(F.col("count") >= min_docs).select("_template")
    gone = small(durable(shaped.join(recurring, "_template", "left_semi")))

    found = marks.join(gone, ["_leaf", "_hash"]).select("_doc", "_key", "_line", "_template")
    if keep_first:
        found = durable(found)
        first = found.groupBy("_template").agg(F.min(F.struct("_doc", "_line")).alias("_first"))
        found = found.join(first, "_template").where(~F.struct("_doc", "_line").eqNullSafe(F.col("_first")))
    found = found.select("_doc", "_key", "_line")
    if min_texts:
        long = marks.where(F.col("_same").isNotNull()).select("_same", "_doc", "_key", "_line")
        texts_of = long.groupBy("_same", "_key").agg(F.min(F.struct("_doc", "_line", "_key")).alias("_first"))
        again = texts_of.groupBy("_same").agg(F.count("*").alias("_texts"), F.min("_first").alias("_first")).where(F.col("_texts") >= min_texts)
        again = small(durable(again.select("_same", F.col("_first._key").alias("_of"), F.col("_first._line").alias("_at"))))
        found = found.union(long.join(again, "_same").where((F.col("_key") != F.col("_of")) | (F.col("_line") != F.col("_at"))).select("_doc", "_key", "_line"))
    dropped = found.groupBy(F.col("_doc").alias("_id"), F.col("_key").alias("_of")).agg(F.collect_set("_line").alias("_dropped"))
    whole = docs.select(F.struct(*columns).alias("_row") if columns else F.lit(None).alias("_row"), F.col(id_col).alias("_doc"), F.col(text_col).alias("_text"), F.xxhash64(F.col(text_col)).alias("_key"))
    out = whole.join(dropped, F.col("_doc").eqNullSafe(F.col("_id")) & (F.col("_key") == F.col("_of")), "left")
    parts = F.split("_text", "\n")
    rest = F.when(F.col("_dropped").isNull(), F.col("_text")).otherwise(F.array_join(F.filter(parts, lambda x, i: ~F.array_contains("_dropped", i)), "\n"))
    size = F.when(F.col("_text").isNull(), 0).otherwise(F.size(parts))
    return out.select(F.col("_doc").alias(id_col), rest.alias("text"), size.cast("long").alias("n_lines"), F.when(F.col("_dropped").isNull(), 0).otherwise(F.size("_dropped")).cast("long").alias("n_dropped"), *(F.col("_row")[c].alias(c) for c in columns))
