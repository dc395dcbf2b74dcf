"""Cases that the registered queries don't hold: bad patterns, separators alone, odd bodies, values found before, nulls."""

from pyspark.sql import functions as F

from privlake.operators import detector, forms, intents, reports
from privlake.sources import forms_html

FIELD = "page_id long, form_id string, ord int, name string, id string, type string, label string, value string, required boolean, max_length int, pattern string"


def test_a_pattern_that_is_none_is_left_out(spark):
    rows = [(1, "f", k, "x", "x", "text", "X", "value", False, 0, p) for k, p in enumerate(["[a-", "(?P<", "^v", "^w", "*", "", "a{99999999999}"])]
    got = {r.ord: r.rule for r in forms.validate_fields(spark.createDataFrame(rows, FIELD)).collect()}
    assert got == {0: "none", 1: "none", 2: "none", 3: "pattern", 4: "none", 5: "none", 6: "none"}


def test_separators_alone_are_a_clause(spark):
    rows = spark.createDataFrame([(";",), ("  ",), (None,), ("fill it; then submit",)], "task string")
    got = [r.c for r in rows.select(intents.decompose(F.col("task")).alias("c")).collect()]
    assert [[x.description for x in c] for c in got[:3]] == [[";"], [], []] and len(got[3]) == 2
    described = rows.select(intents.action_description(intents.decompose(F.col("task"))).alias("d"), intents.is_compound(intents.decompose(F.col("task"))).alias("many")).collect()
    assert described[3].many and ", then " in described[3].d


def test_detector_on_a_page(spark):
    fields = spark.createDataFrame([(1, "f", 0, "mail", "m", "email", "Email", "a@b.org", False, 0, ""), (1, "f", 1, "", "", "password", None, "pw", False, 0, "")], FIELD)
    elements = spark.createDataFrame([(1, 0, "m", "", "write to c@d.org", 1, 2, 3, 4), (1, 1, "m", "", None, 9, 9, 9, 9)], "page_id long, ord int, id string, label string, text string, x int, y int, w int, h int")
    texts = spark.createDataFrame([(1, "a@b.org c@d.org e@f.org e@f.org 9876543210"), (2, None)], "page_id long, text string")
    got = detector.detect_page(fields, elements, texts).orderBy("page_id", *detector._PLACE).collect()
    assert [r.region_id for r in got] == [f"pii-dom-{k + 1}" for k in range(len(got))]
    assert got[0].rect.x == 1 and got[0].confidence == 0.95 and got[0].method == 'Form field "Email" matched email pattern'
    later = [r.text_value for r in got if r.branch > 2]
    assert len(later) == len(set(later)) and "a@b.org" not in later and {"e@f.org", "9876543210"} <= set(later)
    vision = spark.createDataFrame([(1, "face", 0.4), (1, "face", 0.9)], "page_id long, category string, confidence double")
    assert detector.all_regions(detector.detect_page(fields, elements, texts), vision).count() == len(got) + 1
    assert {r.page_id: r.text for r in detector.sanitised_pages(texts, detector.detect_page(fields, elements, texts)).collect()}[1] == "*** *** *** *** ***"
    review = detector.review_fields(fields, detector.detect_page(fields, elements, texts)).collect()
    assert [(r.label, r.value) for r in review] == [("Email", "a@b.org")]
    assert detector.detect_page(fields.limit(0), elements.limit(0), texts.limit(0)).count() == 0


def test_bodies_that_are_no_text(spark):
    rows = spark.createDataFrame([("buffer", None, None, bytearray(b"\xff ok")), ("params", None, [("a b", "c&d", False)], None), ("text", None, None, None), ("stream", "x", None, None)], "kind string, text string, parts array<struct<key: string, value: string, is_file: boolean>>, data binary")
    got = [r.b for r in rows.select(reports.body_text(F.col("kind"), F.col("text"), F.col("parts"), F.col("data")).alias("b")).collect()]
    assert got == ["� ok", "a+b=c%26d", "", ""]


PAGE = """<html><head><title>t</title><script>var a="<input name=no>";</script></head><body>
<a href="/x" title="Home">go</a><a>no link</a><div tabindex=0>box <b>text</b></div><span role="switch" style="opacity: 0.05">off</span>
<form id="f1"><label for="n">Given name</label><input id="n" name="first" value="Ann" required maxlength="30" pattern="[a-z]+">
<label>State <select name="state"><option>-- Select --<option value="KL" selected>Kerala</select></label>
<span>Mobile</span><input type="tel" name="mobile"><input type=checkbox name=ok checked aria-label="I agree">
<textarea name="note">two
lines</textarea><input name="honeypot" style="position:absolute; left:-99999px"><input type=hidden name=token value=1></form>
<div style="display:none"><button disabled>Send</button></div><![if x]><form><input name="q" placeholder="Search" maxlength="9999999999999"></form></body>"""


def test_page_elements_and_fields(spark):
    pages = spark.createDataFrame([(1, PAGE), (2, None), (3, "<<form <input")], "page_id long, html string").withColumn("ord", F.lit("clash"))
    fields = {r.name: r for r in forms_html.page_fields(pages).where("page_id = 1").collect()}
    assert [(fields[n].label, fields[n].value, fields[n].filled) for n in ("first", "state", "mobile", "ok", "note")] == [("Given name", "Ann", True), ("State", "KL", True), ("Mobile", "", False), ("I agree", "", True), ("", "two\nlines", True)]
    assert fields["first"].required and fields["first"].max_length == 30 and fields["first"].pattern == "[a-z]+" and fields["first"].form_id == "f1"
    assert fields["state"].options == ["-- Select --", "Kerala"] and fields["ok"].checked and fields["first"].checked is None
    assert [n for n, r in fields.items() if r.trap] == ["honeypot"] and fields["q"].form_id == "form-1" and fields["q"].label == "Search" and "no" not in fields
    found = forms_html.page_elements(pages).where("page_id = 1").orderBy("ord").collect()
    assert [(r.tag, r.role, r.text, r.visible) for r in found[:3]] == [("a", "link", "Home", True), ("div", "generic", "box text", True), ("span", "switch", "off", False)]
    send = next(r for r in found if r.text == "Send")
    assert send.disabled and not send.visible and len(found) == 12
    assert forms.validate_fields(forms_html.page_fields(pages)).where("page_id = 1").count() == 8
