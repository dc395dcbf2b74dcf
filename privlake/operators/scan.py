"""Checksum-gated scan of texts for personal data, all in column expressions: a row's text never leaves its task."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from privlake.functions import validators as v
from privlake.functions.text import B, bound, half_bounded


@dataclass(frozen=True)
class ScanRule:
    """A pattern with the check that its matches must pass; `hint` is a cheap pattern that every text with a match contains."""

    category: str
    pattern: str
    priority: int
    confidence: float
    hint: str
    check: Callable[[Column], Column] | None = None


def _bare(check: Callable[[Column], Column]) -> Callable[[Column], Column]:
    return lambda x: check(F.regexp_replace(x, r"[\s-]", ""))


#: Categories, patterns, confidences and precedence.
RULES = (
    ScanRule("financial", B + r"[0-9]{4}[\s-]?[0-9]{4}[\s-]?[0-9]{4}[\s-]?[0-9]{4}" + B, 100, 0.99, "[0-9]{4}", _bare(v.luhn_valid)),
    ScanRule("aadhaar", B + r"[0-9]{4}[\s-]?[0-9]{4}[\s-]?[0-9]{4}" + B, 90, 0.98, "[0-9]{4}", _bare(v.verhoeff_valid)),
    ScanRule("pan", B + r"[A-Z]{5}[0-9]{4}[A-Z]" + B, 80, 0.97, "[A-Z]{5}[0-9]{4}", v.pan_valid),
    ScanRule("ifsc", B + r"[A-Z]{4}0[A-Z0-9]{6}" + B, 75, 0.95, "[A-Z]{4}0", v.ifsc_valid),
    ScanRule("upi", B + r"[A-Za-z0-9._%+-]+@[A-Za-z0-9]+" + B, 70, 0.92, "@", v.upi_valid),
    ScanRule("phone", B + r"(?:\+?91[\s-]?)?[6-9][0-9]{9}" + B, 60, 0.9, "[6-9][0-9]{9}", lambda x: v.phone_valid(F.right(x, F.lit(10)))),
    ScanRule("email", B + r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}" + B, 50, 0.85, "@"),
)
_HIT = "array<struct<p: int, s: int, e: int, category: string, matched_text: string, validated: boolean, confidence: double>>"


def _hits(text: Column, rule: ScanRule) -> Column:
    """All matches of a rule that pass its check, with offsets: a match starts after all text between and all matches before it."""
    pattern, none = half_bounded(rule.pattern), F.array().cast(_HIT)

    def placed(found: Column, between: Column) -> Column:
        run = lambda a, n: F.aggregate(F.slice(a, F.lit(1), n), F.lit(0), lambda t, x: t + F.length(x))
        hit = lambda x, s: F.struct(F.lit(-rule.priority).alias("p"), s.alias("s"), (s + F.length(x)).alias("e"), F.lit(rule.category).alias("category"), x.alias("matched_text"), F.lit(rule.check is not None).alias("validated"), F.lit(rule.confidence).alias("confidence"))
        return F.transform(found, lambda x, i: bound(run(between, i + 1) + run(found, i), lambda s: hit(x, s)))

    # where texts have no match, none is placed
    hits = bound(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda found: F.when(F.size(found) > 0, bound(F.split(text, pattern, -1), lambda between: placed(found, between))).otherwise(none))
    if rule.check:
        hits = F.filter(hits, lambda h: rule.check(h["matched_text"]))
    return F.when(_hinted(text, rule.hint), hits).otherwise(none)


def _hinted(text: Column, hint: str) -> Column:
    return F.contains(text, F.lit(hint)) if len(hint) == 1 else text.rlike(hint)


def scan_spans(text: Column, unvalidated: bool = False) -> Column:
    """Matches in order of place: structs s, e (from 0, e exclusive), category, matched_text, validated, confidence.

    Overlapping matches collapse to the rule of higher priority, then to the earlier one. Rules without a check count with `unvalidated` only. Null
    text has no matches.
    """
    rules = [r for r in RULES if r.check or unvalidated]
    every = bound(F.coalesce(text, F.lit("")), lambda t: F.sort_array(F.concat(*(_hits(t, r) for r in rules))))
    kept = F.aggregate(every, F.array().cast(_HIT), lambda a, x: F.when(F.exists(a, lambda k: (x["s"] < k["e"]) & (k["s"] < x["e"])), a).otherwise(F.concat(a, F.array(x))))
    return F.sort_array(F.transform(kept, lambda k: F.struct(k["s"], k["e"], k["category"], k["matched_text"], k["validated"], k["confidence"])))


def scan_pii(df: DataFrame, id_col: str, text_col: str, unvalidated: bool = False) -> DataFrame:
    """One row per match: `id_col`, ordinal, category, matched_text, start, validated, confidence. Narrow: no shuffle."""
    rows = df.select(F.col(id_col), F.posexplode(scan_spans(F.col(text_col), unvalidated)).alias("ordinal", "m"))
    return rows.select(id_col, "ordinal", "m.category", "m.matched_text", F.col("m.s").alias("start"), "m.validated", "m.confidence")


def masked(text: Column, unvalidated: bool = False) -> Column:
    """The text with every match replaced by its category's tag."""
    def done(text: Column, spans: Column) -> Column:
        whole = F.aggregate(spans, F.struct(F.lit("").alias("out"), F.lit(0).alias("at")), lambda a, m: F.struct(F.concat(a["out"], F.substring(text, a["at"] + 1, m["s"] - a["at"]), F.lit("[REDACTED:"), m["category"], F.lit("]")).alias("out"), m["e"].alias("at")), lambda a: F.concat(a["out"], F.substring(text, a["at"] + 1, F.length(text))))
        return F.when(text.isNotNull() & (F.size(spans) > 0), whole).otherwise(text)

    return bound(text, lambda t: bound(scan_spans(t, unvalidated), lambda spans: done(t, spans)))


#: How severe each category is.
SEVERITY = {"password": "critical", "aadhaar": "critical", "pan": "critical", "phone": "high", "email": "high", "bank_account": "critical", "ifsc": "high", "upi": "high", "name": "medium", "address": "medium", "date_of_birth": "medium", "financial": "critical", "medical": "critical", "ip_address": "medium", "face": "critical"}


def severity(category: Column) -> Column:
    return F.element_at(F.create_map(*(F.lit(x) for pair in SEVERITY.items() for x in pair)), category)


def summarise(matches: DataFrame, *keys: str) -> DataFrame:
    """Totals per key: matches, counts by severity, distinct categories and mean confidence (rounded to six digits)."""
    level = severity(F.col("category"))
    return matches.groupBy(*keys).agg(F.count("*").alias("total"), *(F.count_if(level == s).alias(f"{s}_count") for s in ("critical", "high", "medium", "low")), F.count_distinct("category").alias("categories"), F.round(F.avg("confidence"), 6).alias("mean_confidence"))
