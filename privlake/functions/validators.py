"""Validators of identifiers, as column expressions: null in, null out."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values. The eighth-power permutation behind the check digit, and UPI providers.
VERHOEFF_STEP = (1, 5, 7, 6, 2, 8, 3, 0, 9, 4)
UPI_PROVIDERS = ("paytm", "gpay", "googlepay", "phonepe", "upi", "bhim", "sbi", "hdfc", "icici", "axis", "kotak", "pnb", "bob", "cub", "idbi", "indus", "yesbank", "federal", "centralbank", "unionbank", "canara", "iob", "mahabank", "ujjain", "payzapp", "freecharge", "mobikwik", "airtel", "jio", "amazon", "slice", "fi")

_BLANKS = r"[ \t\n\r\f\x0B]"


def _times(a: int, b: int) -> int:
    """The product in the dihedral group of ten elements: rotations 0-4, reflections 5-9."""
    turned = (a - b if a >= 5 else a + b) % 5
    return turned if (a < 5) == (b < 5) else turned + 5


def _permuted(k: int, digit: int) -> int:
    for _ in range(k):
        digit = VERHOEFF_STEP[digit]
    return digit


#: The group's table and the permutations of eight positions, as strings of digits.
VERHOEFF_PRODUCT = "".join(str(_times(a, b)) for a in range(10) for b in range(10))
VERHOEFF_PLACES = "".join(str(_permuted(k, d)) for k in range(8) for d in range(10))


def _digit(text: Column, at: Column) -> Column:
    return F.substring(text, at + 1, F.lit(1)).cast("int")


def verhoeff_valid(value: Column) -> Column:
    """Twelve digits, blanks aside, whose Verhoeff sum is 0."""
    digits = F.regexp_replace(value, _BLANKS, "")
    step = lambda c, i: _digit(F.lit(VERHOEFF_PRODUCT), c * 10 + _digit(F.lit(VERHOEFF_PLACES), (i % 8) * 10 + _digit(digits, F.lit(11) - i)))
    return F.when(digits.rlike(r"^[0-9]{12}\z"), F.aggregate(F.sequence(F.lit(0), F.lit(11)), F.lit(0), step) == 0).otherwise(value.isNull() & F.lit(None).cast("boolean"))


def luhn_valid(value: Column) -> Column:
    """13 to 19 digits, blanks aside, that pass the Luhn sum."""
    digits = F.regexp_replace(value, _BLANKS, "")
    return digits.rlike(r"^[0-9]{13,19}\z") & F.call_function("luhn_check", digits)


def pan_valid(value: Column) -> Column:
    """Five letters, four digits, a letter; the fourth letter names a kind of holder."""
    return value.rlike(r"^[A-Z]{3}[PCHFATBLJGKE][A-Z][0-9]{4}[A-Z]\z")


def ifsc_valid(value: Column) -> Column:
    """Four letters, a zero, six letters or digits."""
    return value.rlike(r"^[A-Z]{4}0[A-Z0-9]{6}\z")


def upi_valid(value: Column) -> Column:
    """A name, @ and a known provider."""
    return value.rlike(r"^[A-Za-z0-9._%+-]+@[A-Za-z0-9]+\z") & F.lower(F.split(value, "@")[1]).isin(*UPI_PROVIDERS)


def phone_valid(value: Column) -> Column:
    """Ten digits from 6 on, or twelve that begin with 91, other signs aside."""
    return F.regexp_replace(value, "[^0-9]", "").rlike(r"^(91)?[6-9][0-9]{9}\z")
