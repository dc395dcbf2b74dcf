"""Rows from a source that can't be trusted: messages of JSON are read permissively, rows are checked by type, clamped and capped, and what is dropped is told and counted."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Field:
    """A field that every row must have: a string of at most `most` characters, a number between `least` and `most`, or an array of at most `most` items."""

    name: str
    kind: str
    most: float
    least: float = 0.0


@dataclass(frozen=True)
class Relay:
    """What messages look like: `rows_in` holds the rows, at most `max_rows` of which count, in messages whose `sender_in` is `sender`."""

    fields: tuple[Field, ...]
    rows_in: str
    sender_in: str
    sender: str
    max_rows: int


#: What a page may report of its own requests, and how much of it is taken.
OBSERVATIONS = Relay((Field("url", "string", 512), Field("method", "string", 16), Field("bytes", "number", 2.0**53 - 1), Field("matches", "array", 32)), "observations", "source", "tripwire-report", 50)


def _kind(value: Column) -> Column:
    shape = F.schema_of_variant(value)
    return F.when(shape == "STRING", "string").when(shape.rlike(r"^(BIGINT|DOUBLE|FLOAT|DECIMAL)"), "number").when(F.startswith(shape, F.lit("ARRAY")), "array").otherwise("other")


def _part(row: Column, name: str, kind: str = "variant") -> Column:
    return F.try_variant_get(row, f"$.{name}", kind)


def _wrong(row: Column, field: Field) -> Column:
    """Whether a row has no such field of its kind; numbers must be finite."""
    right = _kind(_part(row, field.name)) == field.kind
    if field.kind == "number":
        number = _part(row, field.name, "double")
        right = right & ~F.isnan(number) & (F.abs(number) < F.lit(float("inf")))
    return ~F.coalesce(right, F.lit(False))


def _taken(row: Column, field: Field) -> tuple[Column, Column]:
    """A field's value within its bounds, and whether that is less than what was sent."""
    if field.kind == "string":
        value = _part(row, field.name, "string")
        return F.left(value, F.lit(int(field.most))), F.length(value) > int(field.most)
    if field.kind == "number":
        value = _part(row, field.name, "double")
        return F.greatest(F.lit(field.least), F.least(value, F.lit(field.most))), (value < field.least) | (value > field.most)
    value = _part(row, field.name, "array<variant>")
    return F.transform(F.slice(value, 1, int(field.most)), lambda x: x.cast("string")), F.size(value) > int(field.most)


def checked_rows(messages: DataFrame, id_col: str, body_col: str, relay: Relay = OBSERVATIONS) -> DataFrame:
    """All rows of all messages, good or not: `id_col`, ordinal, reason (null for good rows), the fields of `relay`, cut (names of fields that were clamped or cut) and raw (what was refused).

    A message that isn't JSON, is not from the sender, or has no rows is refused whole: one row with ordinal null. Rows after the first max_rows are refused as `beyond_limit`, others that lack a
    field of its kind as `no_` and that field's name, first field first. Narrow: nothing is shuffled, and a message is read once. Null bodies are `not_json`; repeated messages stay;
    an empty table gives no rows.
    """
    read = messages.select(F.col(f"`{id_col}`").alias("_id"), F.col(f"`{body_col}`").alias("_body")).withColumn("_v", F.try_parse_json("_body"))
    read = read.withColumn("_rows", _part(F.col("_v"), relay.rows_in, "array<variant>")).withColumn("_sender", _part(F.col("_v"), relay.sender_in))
    said = (_kind(F.col("_sender")) == "string") & (F.col("_sender").try_cast("string") == relay.sender)
    whole = F.when(F.col("_v").isNull(), "not_json").when(~F.coalesce(said, F.lit(False)), "wrong_source").when(F.coalesce(F.size("_rows"), F.lit(0)) < 1, "no_rows")
    nothing = F.lit(None).cast("variant")
    rows = read.withColumn("_whole", whole).select("_id", "_body", "_whole", F.posexplode_outer(F.when(F.col("_whole").isNull(), F.col("_rows")).otherwise(F.array(nothing))).alias("_at", "_o"))
    row = F.col("_o")
    reason = F.coalesce(F.col("_whole"), F.when(F.col("_at") >= relay.max_rows, "beyond_limit"), *(F.when(_wrong(row, f), f"no_{f.name}") for f in relay.fields))
    rows = rows.withColumn("reason", reason).withColumn("_good", F.col("reason").isNull())
    taken = {f.name: _taken(row, f) for f in relay.fields}
    cut = F.array_compact(F.array(*(F.when(over, name) for name, (_, over) in taken.items())))
    return rows.select(
        F.col("_id").alias(id_col), F.when(F.col("_whole").isNull(), F.col("_at")).alias("ordinal"), "reason", *(F.when(F.col("_good"), value).alias(name) for name, (value, _) in taken.items()),
        F.when(F.col("_good"), cut).otherwise(F.array().cast("array<string>")).alias("cut"), F.when(~F.col("_good"), F.when(F.col("_whole").isNotNull(), F.col("_body")).otherwise(F.coalesce(row.cast("string"), F.lit("null")))).alias("raw"),
    )


def good_rows(checked: DataFrame) -> DataFrame:
    return checked.where("reason is null").drop("reason", "raw")


def quarantined(checked: DataFrame) -> DataFrame:
    """What was refused, and why."""
    kept = [c for c in checked.columns if c not in {"cut", *(f.name for f in OBSERVATIONS.fields)}]
    return checked.where("reason is not null").select(*kept)


def tally(checked: DataFrame, relay: Relay = OBSERVATIONS) -> DataFrame:
    """Rows (what, n): good rows, rows refused for each reason, and rows in which each field was cut; one aggregate over one pass."""
    told = F.concat(F.array(F.coalesce(F.concat(F.lit("refused: "), "reason"), F.lit("good"))), F.transform("cut", lambda x: F.concat(F.lit("cut: "), x)))
    found = checked.select(F.explode(told).alias("what")).groupBy("what").agg(F.count("*").alias("n"))
    names = ["good", *(f"refused: {r}" for r in ("not_json", "wrong_source", "no_rows", "beyond_limit", *(f"no_{f.name}" for f in relay.fields))), *(f"cut: {f.name}" for f in relay.fields)]
    every = reduce(DataFrame.union, [found.sparkSession.range(1).select(F.lit(x).alias("what"), F.lit(0).cast("long").alias("n")) for x in names])
    return found.union(every).groupBy("what").agg(F.sum("n").alias("n"))
