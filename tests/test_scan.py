import re

import pytest
from pyspark.sql import functions as F

from privlake.functions import text as t
from privlake.functions import urls
from privlake.functions import validators as v
from privlake.operators import scan


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(f(F.col("x"))).first()[0]


def found(spark, text, unvalidated=False):
    return [(m["category"], m["matched_text"], m["s"]) for m in one(spark, text, lambda x: scan.scan_spans(x, unvalidated))]


def verhoeff(number):
    step = [1, 5, 7, 6, 2, 8, 3, 0, 9, 4]
    c = 0
    for i, d in enumerate(reversed([int(x) for x in number])):
        for _ in range(i % 8):
            d = step[d]
        same = (c < 5) == (d < 5)
        turned = (c - d if c >= 5 else c + d) % 5
        c = turned if same else turned + 5
    return c == 0


@pytest.mark.parametrize("value,ok", [("234123412346", True), ("2341 2341 2346", True), ("123456789012", False), ("23412341234", False), ("", False), (None, None)])
def test_verhoeff(spark, value, ok):
    assert one(spark, value, v.verhoeff_valid) is ok
    assert not ok or verhoeff(value.replace(" ", ""))


@pytest.mark.parametrize("value,ok", [("4539578763621486", True), ("1234567812345678", False), ("0", False), ("453957876362148x", False)])
def test_luhn(spark, value, ok):
    assert one(spark, value, v.luhn_valid) is ok


@pytest.mark.parametrize("value,ok", [("ABCPE1234F", True), ("ZZZPE1234F", True), ("ABCDE1234F", False), ("ABCPE1234F\n", False)])
def test_pan(spark, value, ok):
    assert one(spark, value, v.pan_valid) is ok


@pytest.mark.parametrize("value,ok", [("9876543210", True), ("+91 9876543210", True), ("987654321", False), ("1876543210", False)])
def test_phone(spark, value, ok):
    assert one(spark, value, v.phone_valid) is ok


def test_upi_needs_a_known_provider(spark):
    assert one(spark, "user@PayTM", v.upi_valid) is True
    assert one(spark, "hein.19@mail5", v.upi_valid) is False


def test_scan_finds_each_kind_once(spark):
    assert found(spark, "pay 4539578763621486 now") == [("financial", "4539578763621486", 4)]
    assert found(spark, "id 2341 2341 2346, ABCPE1234F") == [("aadhaar", "2341 2341 2346", 3), ("pan", "ABCPE1234F", 19)]
    assert found(spark, "call +91 9876543210") == [("phone", "91 9876543210", 6)]
    assert found(spark, "sku 1234567890") == []
    assert found(spark, "SBIN0001234 user@paytm.com") == [("ifsc", "SBIN0001234", 0), ("upi", "user@paytm", 12)]


def test_scan_word_boundary_is_ascii(spark):
    assert found(spark, "é9876543210") == [("phone", "9876543210", 1)]


def test_unvalidated_rules_are_opt_in(spark):
    assert found(spark, "user@example.com") == []
    assert found(spark, "user@example.com", True) == [("email", "user@example.com", 0)]
    assert len(found(spark, "a@b.com " * 300, True)) == 300


def test_empty_and_null(spark):
    assert found(spark, "") == [] and found(spark, None) == []
    assert one(spark, None, scan.masked) is None


def test_mask_leaves_nothing_and_is_idempotent(spark):
    text = "a 4539578763621486 b 9876543210 c ABCPE1234F"
    done = one(spark, text, scan.masked)
    assert done == "a [REDACTED:financial] b [REDACTED:phone] c [REDACTED:pan]"
    assert one(spark, done, scan.masked) == done and found(spark, done) == []


def test_mask_values(spark):
    assert [one(spark, x, t.mask_value) for x in ("", "abcd", "abcde", "a" * 30)] == ["", "****", "ab*de", "aa" + "*" * 12 + "aa"]
    assert one(spark, "a" * 30, t.mask_sample) == "aa" + "*" * 26 + "aa"


@pytest.mark.parametrize("value,ok", [("-- Select State --", True), ("", True), ("Select", True), ("Choose one", True), ("None", True), ("---", True), ("Delhi", False), ("Selected Works", False)])
def test_placeholders(spark, value, ok):
    assert one(spark, value, t.is_placeholder) is ok


@pytest.mark.parametrize("value,ok", [("[PII:address]", True), ("[REDACTED:phone]", True), ("<NAME_12>", True), ("***", True), ("**", True), ("Raj Porwal", False), ("SBIN0001234", False), ("12/05/1998", False), ("*", False), ("PII coordinator", False)])
def test_artifacts(spark, value, ok):
    assert one(spark, value, t.is_artifact) is ok


def test_urls(spark):
    assert one(spark, "https://x.com/a?token=secret#frag", urls.sanitize_url) == "https://x.com/a"
    assert one(spark, "https://X.com:443", urls.sanitize_url) == "https://x.com/"
    assert one(spark, "not a url?x#y", urls.sanitize_url) == "not a url"
    assert [one(spark, u, urls.is_outbound) for u in ("http://localhost:1/a", "http://10.1.1.1", "https://a.org", "nonsense")] == [False, False, True, False]


@pytest.mark.parametrize("n,shown", [(0, "0 B"), (1023, "1023 B"), (1024, "1 KB"), (1536, "1.5 KB"), (5 * 1024**3, "5 GB"), (5000 * 1024**3, "5000 GB")])
def test_format_bytes(spark, n, shown):
    assert one(spark, n, t.format_bytes, "long") == shown


def test_headings_and_basename(spark):
    assert one(spark, " ab \nTitle here\n" + "x" * 80, t.headings) == ["Title here"]
    assert one(spark, "C:\\tmp\\a.pdf", t.basename) == "a.pdf" and one(spark, "a/", t.basename) == "a/"


def test_scan_plan_has_no_shuffle_and_no_python(spark):
    plan = scan.scan_pii(spark.range(1).selectExpr("id", "'x' AS text"), "id", "text")._jdf.queryExecution().toString()
    assert not re.search("Exchange|Python", plan)
