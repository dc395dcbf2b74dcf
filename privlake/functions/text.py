"""Small text functions as column expressions."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The ASCII word boundary: Java's own also takes other letters as word signs.
B = r"(?:(?<![A-Za-z0-9_])(?=[A-Za-z0-9_])|(?<=[A-Za-z0-9_])(?![A-Za-z0-9_]))"
#: A class of word signs alone, with how often it stands.
_WORD_SIGNS = r"\[(?:A-Z|a-z|0-9|6-9)+\](?:\{[0-9,]+\}|\+)?"


def half_bounded(pattern: str) -> str:
    """The same pattern with half of B beside a class of word signs, which is far cheaper to search for."""
    before = re.sub(re.escape(B) + f"(?={_WORD_SIGNS})", "(?<![A-Za-z0-9_])", pattern)
    return re.sub(f"({_WORD_SIGNS}){re.escape(B)}", r"\1(?![A-Za-z0-9_])", before)


def bound(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value), in which `value` is computed once a row, however often it stands there."""
    return F.transform(F.array(value), f)[0]


def mask_value(value: Column) -> Column:
    """The first and last two characters with at most twelve stars between; stars alone up to four characters."""
    n = F.length(value)
    return F.when(n <= 4, F.repeat(F.lit("*"), n)).otherwise(F.concat(F.left(value, F.lit(2)), F.repeat(F.lit("*"), F.least(n - 4, F.lit(12))), F.right(value, F.lit(2))))


def mask_sample(value: Column) -> Column:
    """As mask_value, with a star for every character between."""
    n = F.length(value)
    return F.when(n <= 4, F.repeat(F.lit("*"), n)).otherwise(F.concat(F.left(value, F.lit(2)), F.repeat(F.lit("*"), n - 4), F.right(value, F.lit(2))))


def scrub_known(text: Column, values: Column) -> Column:
    """Every occurrence of each of `values`, in their order, as ***; empty ones are left out."""
    return F.aggregate(F.filter(values, lambda v: v != ""), text, lambda t, v: F.replace(t, v, F.lit("***")))


def normal_key(key: Column) -> Column:
    """Lower case without anything but a-z and digits."""
    return F.regexp_replace(F.lower(key), "[^a-z0-9]", "")


def is_placeholder(option: Column) -> Column:
    """Blank, dashes, or an invitation to choose."""
    t = F.lower(F.trim(option))
    return (t == "") | t.rlike(r"^(--.*--|-+|select" + B + r".*|choose" + B + r".*|please\s+select.*|none)\z")


def is_artifact(value: Column) -> Column:
    """What sanitising leaves behind: tags of removed values and runs of stars."""
    return value.rlike(r"(?i)\[(?:PII|REDACTED):[^\]]*\]|<[A-Z_]+_[0-9]+>|^\*{2,}\z")


def basename(path: Column) -> Column:
    """The part after the last slash or backslash; the whole if that is empty."""
    parts = F.split(path, r"[\\/]")
    return F.coalesce(F.nullif(F.element_at(parts, -1), F.lit("")), path)


def headings(text: Column, most: int = 30) -> Column:
    """Trimmed lines of 3 to 79 characters, the first `most`."""
    lines = F.transform(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(" \t\r\f\x0b")))
    return F.slice(F.filter(lines, lambda x: (F.length(x) > 2) & (F.length(x) < 80)), 1, most)


def format_bytes(n: Column) -> Column:
    """Bytes in the largest unit of 1024 that leaves 1 or more, GB at most, with one digit after the point unless it is 0."""
    power = F.when(n < 1024, 0).when(n < 1024**2, 1).when(n < 1024**3, 2).otherwise(3)
    shown = F.floor(n / F.pow(F.lit(1024.0), power) * 10 + 0.5) / 10
    text = F.regexp_replace(F.format_string("%.1f", shown.cast("double")), r"\.0\z", "")
    return F.when(n == 0, F.lit("0 B")).otherwise(F.concat(text, F.lit(" "), F.element_at(F.array(*(F.lit(u) for u in ("B", "KB", "MB", "GB"))), power + 1)))
