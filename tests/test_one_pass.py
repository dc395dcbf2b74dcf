"""What stands in an expression many times is computed once, and tables that lie by page aren't moved again."""

import pytest
from pyspark.sql import functions as F
from test_forms import field, frame

from privlake.functions.text import B, half_bounded
from privlake.operators import forms, planning, reports, scan
from privlake.operators.detector import CHECKED_PATTERNS, TEXT_PATTERNS
from privlake.plans.catalogue import QUERIES


def plan_of(rows):
    return rows._jdf.queryExecution().optimizedPlan().toString()


def test_a_fields_context_is_made_once(spark):
    assert plan_of(frame(spark, field("Email", ord=1)).select(forms.field_categories().alias("c"))).count("concat_ws") == 1


def test_a_masked_text_is_made_once(spark):
    rows = spark.range(1).select(F.concat_ws("-", F.col("id").cast("string"), F.uuid()).alias("t"))
    assert plan_of(spark.range(1).select(scan.masked(F.concat_ws("-", F.col("id").cast("string"), F.lit("x"))).alias("c"))).count("concat_ws") == 1
    assert rows.select(scan.masked(F.concat(F.lit("Aadhaar 2341 2341 2346, mail "), F.col("t").substr(1, 0)))).first()[0] == "Aadhaar [REDACTED:aadhaar], mail "


def test_words_are_found_as_their_patterns_are(spark):
    texts = ["", "pan", "pan card", "pancard x", "span", "pan\tnumber", "uid", "fluid", "uid_x", "x uid-1", "account  no", "accountnumber", "account name", "acc no", "bank\naccess", "a/c", "date of birth", "contact number", "cell", "cello", "pin  code", "ip address", "ip", "ipx", "ship", "my otp", "otps", "atm pin", "secret", "secrets", "cvv2", "tcvv", "é uidé"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    patterns = [p for _, p in forms.FIELD_RULES] + [forms.PASSWORD]
    got = rows.select("t", *(forms._says(F.col("t"), p).alias(f"a{i}") for i, p in enumerate(patterns)), *(F.col("t").rlike(forms._bounded(p)).alias(f"b{i}") for i, p in enumerate(patterns))).collect()
    assert all(r[f"a{i}"] == r[f"b{i}"] for r in got for i in range(len(patterns)))


def test_half_boundaries_find_the_same(spark):
    texts = ["2341 2341 2346", "x2341 2341 2346", "_234123412346", "234123412346_", "é234123412346é", "ABCPE1234F", "ABCPE1234FX", "SBIN0001234.", "..a@paytm", "a@upi_x a@upi", "9876543210@upi", "+919876543210", "19876543210", "01/02/1990-", "1.2.3.4.5", "a.b@example.org|", "4539 5787 6362 14861", ""]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    patterns = [r.pattern for r in scan.RULES] + [p.replace(r"\b", B) for p in [*CHECKED_PATTERNS.values(), *(p for _, p in TEXT_PATTERNS)]]
    every = lambda p: F.regexp_extract_all("t", F.lit(p), F.lit(0))
    for row in rows.select(*(F.struct(every(half_bounded(p)), every(p)) for p in patterns)).collect():
        assert all(a == b for a, b in row)


@pytest.mark.parametrize("name", ["page_detector", "sanitised_elements", "sanitised_fields", "review_fields", "written_fields", "fill_plans", "unmapped_fields", "extract_fields"])
def test_pages_lie_where_they_were_dealt(spark, name):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "20k")
    try:
        plan = QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "REPARTITION_BY_NUM" in plan and "ENSURE_REQUIREMENTS" not in plan


def test_targets_name_rows_by_selector_or_label(spark):
    review = spark.createDataFrame([(1, "f", 0, "#dob", "Born"), (1, "f", 1, '[name="pan"]', "PAN"), (1, "f", 2, "#x", None), (2, "f", 0, "#dob", "Born"), (None, "f", 0, "#dob", "Born"), (1, "f", 3, "#y", "Other"), (1, "f", 3, "#y", "Other")], "page_id long, form_id string, ord int, selector string, label string")
    targets = spark.createDataFrame([(1, "dob"), (1, None), (1, "pAn"), (2, "#no"), (None, "dob"), (1, "#y"), (1, "#y")], "page_id long, target string")
    assert sorted(tuple(r)[:3] for r in reports.written(review, targets).collect()) == [(1, "f", 0), (1, "f", 1), (1, "f", 3), (1, "f", 3)]


def test_saved_values_without_a_key_fill_nothing(spark):
    fields = frame(spark, field("Email", "email", "e", required=True), field("Mobile Number", "mobile", "m", required=True, ord=1), field("Email", "email", "e", required=True, page=None))
    saved = spark.createDataFrame([(1, "email", "b@c.de"), (1, "email", "a@c.de"), (1, None, "z"), (None, "email", "n"), (1, "phone", "")], "page_id long, key string, value string")
    assert [(r.page_id, r.step, r.ord, r.action, r.value) for r in planning.fill_plan(fields, saved).orderBy("step").collect()] == [(1, 0, 0, "click", None), (1, 1, 0, "type", "a@c.de")]
    assert sorted((str(r.page_id), r.ord) for r in planning.unmapped_fields(fields, saved).collect()) == [("1", 1), ("None", 0)]
