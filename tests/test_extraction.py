import json

import pytest

from privlake.operators import answers, extraction
from privlake.operators.ledger import changes
from test_forms import field, frame

ELEMENTS = "page_id long, ord int, id string, name string, aria_label string, placeholder string, tag string, role string, text string, label string, type string, x double, y double, w double, h double"


def element(ord=0, tag="button", text="", label="", type="", id="", name="", aria="", placeholder="", role="", x=700.0, y=10.0):
    return (1, ord, id, name, aria, placeholder, tag, role, text, label, type, x, y, 40.0, 20.0)


def test_values_are_masked(spark):
    rows = frame(spark, field("Password", "pw", type="password", value="hunter2"), field("Reference", "ref", value="234123412346", ord=1), field("Aadhaar Number", "aadhaar", value="abcd", ord=2), field("Aadhaar Number", "aadhaar2", value="abcdefgh", ord=3), field("I agree", "ok", type="checkbox", checked=True, ord=4))
    extracted = extraction.extract_fields(rows)
    got = {r.ord: (r.value, r.pii_category, r.masked) for r in extracted.collect()}
    assert got == {0: ("(password withheld)", "password", True), 1: ("23********46", "aadhaar", True), 2: ("abcd", None, False), 3: ("ab****gh", "aadhaar", True), 4: ("checked", None, False)}
    text = extraction.as_json(extracted).first().json
    assert "hunter2" not in text and "234123412346" not in text and len(json.loads(text)) == 5
    assert tuple(extraction.summarise_extraction(extracted).first()) == (1, 1, 5, 5, 3)


def ask(spark, question, fields=(), elements=()):
    rows = answers.answer(spark.createDataFrame([(1, question)], "page_id long, question string"), frame(spark, *fields) if fields else frame(spark, field()).limit(0), spark.createDataFrame(list(elements), ELEMENTS))
    r = rows.first()
    return r.text, r.confidence, r.needs_vision


FILES = [field("Photo", "photo", type="file", value="C:\\fakepath\\me.jpg"), field("Signature", "sig", type="file", ord=1)]


@pytest.mark.parametrize(
    "question,fields,text,confidence",
    [
        ("Did I upload my photo?", FILES[:1], 'Yes — a file is attached to "Photo".', 0.97),
        ("Did I upload my photo?", FILES[1:], "No — nothing is attached yet. This field is still empty: Signature.", 0.95),
        ("Are the documents attached?", FILES, "Partly — 1 of 2 uploads are done. Still missing: Signature.", 0.95),
        ("any image?", [field("Name")], "There is no file-upload field on this page.", 0.8),
        ("what do i have to fill", [field("Name *", required=True), field("City", ord=1)], 'One required field: "Name".', 0.95),
        ("what do i have to fill", [field("Name", value="x")], "Nothing — every field on this page already has a value.", 0.9),
        ("is my City there", [field("City *", value="x")], 'Yes — "City *" has a value.', 0.9),
        ("is it complete", [field("A b", required=True), field("C d", required=True, value="x", ord=1)], "Not yet — 1 of 2 required fields are still empty.", 0.95),
        ("is it complete", [field("A b")], "This form has no required fields.", 0.9),
        ("anything private?", [field("Email address", type="email")], "Yes — 1 sensitive region detected and redacted before anything left the device.", 0.9),
        ("anything private?", [field("Colour")], "No sensitive fields were detected on this page.", 0.85),
        ("hello", [field("Name")], "", 0.0),
        (None, [], "", 0.0),
    ],
)
def test_answers(spark, question, fields, text, confidence):
    assert ask(spark, question, fields)[:2] == (text, confidence)


def test_where(spark):
    elements = [element(0, "a", "Help"), element(1, "button", "Submit Update Request", x=1200.0, y=800.0)]
    assert ask(spark, "where is the submit button", elements=elements)[0] == '"Submit Update Request" is near the bottom of the visible page, on the right.'
    assert ask(spark, "where is the basket", elements=[*elements, element(2, "a", "View", aria="Shopping basket")])[0].startswith('"View" is')
    assert ask(spark, "where is my photo", elements=elements) == ("I could not find anything on this page matching that.", 0.6, True)


@pytest.mark.parametrize("target,ord,rule", [("[1]", 1, 0), ("[9]", None, None), ("pan", 0, 1), ("panName", 0, 3), ("Search box", 2, 4), ("type here", 2, 5), ("submit request", 1, 7), ("submit", 1, 8), ("request submit", 1, 9), ("sumbit requst", 1, 10), ("zzz", None, None), ("", None, None)])
def test_lookup(spark, target, ord, rule):
    elements = spark.createDataFrame([element(0, "input", id="pan", name="panName"), element(1, "button", "Submit Request"), element(2, "input", aria="Search box", placeholder="type here")], ELEMENTS)
    got = answers.find_elements(spark.createDataFrame([(1, target)], "page_id long, target string"), elements).first()
    assert (got.ord, got.rule) == (ord, rule)


def test_changes(spark):
    rows = spark.createDataFrame([(1, 0, "ab"), (1, 1, "ab"), (1, 2, None)], "k long, t int, x string")
    assert [(r.changed, r.grown) for r in changes(rows, "k", "t", "x").orderBy("t").collect()] == [(None, None), (False, 0), (True, -2)]
