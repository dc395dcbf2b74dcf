import pytest
from pyspark.sql import functions as F

from privlake.operators import forms, intents

SCHEMA = "page_id long, form_id string, ord int, name string, id string, type string, label string, value string, required boolean, max_length int, pattern string, options array<string>, checked boolean"


def field(label="", name="", id="", type="text", value="", required=False, max_length=0, pattern="", options=(), checked=False, ord=0, page=1):
    return (page, "f", ord, name, id, type, label, value, required, max_length, pattern, list(options), checked)


def frame(spark, *rows):
    return spark.createDataFrame(list(rows), SCHEMA)


@pytest.mark.parametrize(
    "row,expected",
    [
        (field("IFSC Code (for Aadhaar-Bank linking)"), ["ifsc"]),
        (field("Aadhaar Number"), ["aadhaar"]),
        (field("PAN Number"), ["pan"]),
        (field("Full Name"), ["name"]),
        (field("Mobile Number"), ["phone"]),
        (field("PIN Code"), ["address"]),
        (field("OTP"), ["password"]),
        (field("Email", type="password"), ["password"]),
        (field("I agree to aadhaar", type="checkbox"), []),
        (field("aadhaar " * 10), []),
        (field("UIDAI consent"), []),
    ],
)
def test_categories(spark, row, expected):
    assert frame(spark, row).select(forms.field_categories()).first()[0] == expected


@pytest.mark.parametrize(
    "row,rule,valid,risk",
    [
        (field("Name", required=True, value="  "), "required", False, "high"),
        (field("Name"), "optional", True, "low"),
        (field("Name", value="abcdef", max_length=3), "maxLength", False, "high"),
        (field("Code", value="xy", pattern="^[0-9]+$"), "pattern", False, "medium"),
        (field("Aadhaar", value="123456789012"), "aadhaar", True, "low"),
        (field("Aadhaar", value="1234 5678 9012"), "aadhaar", False, "high"),
        (field("Email", value="a@b.c"), "email", True, "low"),
        (field("Date of birth", value="1998-05-12"), "date", False, "high"),
        (field("Hobby", value="chess"), "none", True, "low"),
    ],
)
def test_validation(spark, row, rule, valid, risk):
    got = forms.validate_fields(frame(spark, row)).first()
    assert (got.rule, got.valid, got.risk) == (rule, valid, risk)


def test_validation_summary(spark):
    rows = frame(spark, field("Name", required=True), field("Hobby", value="x", ord=1))
    got = forms.summarise_validation(forms.validate_fields(rows)).first()
    assert (got.all_valid, got.risk, got.issues) == (False, "high", 1)


def test_requirements(spark):
    rows = frame(spark, field("State", "state", type="select", value="-- Select State --", required=True, options=["-- Select State --", "Delhi"]), field("First Name", "fn", required=True, ord=1), field("City", "city", required=True, value="x", ord=2), field("ok", "ok", type="checkbox", required=True, ord=3))
    saved = spark.createDataFrame([(1, "first-name", "Raj"), (1, "state", "")], "page_id long, key string, value string")
    got = {r.label: (r.reason, r.choices) for r in forms.requirements(rows, saved).collect()}
    assert got == {"State": ("no_local_value", 1), "First Name": ("still_empty_after_run", 0)}


def test_first_and_last(spark):
    got = forms.first_and_last_category(frame(spark, field("otp to mobile", id="a"))).first()
    assert (got.first_category, got.last_category) == ("password", "phone")


def test_radios(spark):
    rows = [field(x, "idType", type="radio", checked=x == "Aadhaar Number", ord=k) for k, x in enumerate(("PAN", "Aadhaar Number"))]
    assert forms.collapse_radios(frame(spark, *rows)).first().selected == "Aadhaar Number"
    rows = [field(x, "idType", type="radio", ord=k) for k, x in enumerate(("PAN", "Aadhaar Number"))]
    assert forms.collapse_radios(frame(spark, *rows)).first().selected == "(none selected)"


def test_completion_of_no_fields_is_empty(spark):
    assert forms.completion(frame(spark, field()).limit(0)).count() == 0


@pytest.mark.parametrize(
    "task,question,extraction",
    [
        ("what do i have to fill here", True, False),
        ("check where is the submit button", True, False),
        ("do i have a photo", True, False),
        ("do this now", False, False),
        ("is it?", True, False),
        ("fill the form", False, False),
        ("extract the data", False, True),
        ("extract the data and fill the form", False, False),
        ("  ", False, False),
        (None, False, False),
    ],
)
def test_intents(spark, task, question, extraction):
    got = spark.createDataFrame([(task,)], "t string").select(intents.is_question(F.col("t")), intents.is_extraction(F.col("t"))).first()
    assert tuple(got) == (question, extraction)


@pytest.mark.parametrize(
    "task,clauses",
    [
        ("extract the data and fill the form", [("extract", "extract the data"), ("action", "fill the form")]),
        ("fill the name and address fields", [("action", "fill the name and address fields")]),
        ("extract the data then list all links", [("extract", "extract the data")]),
        ("Fill it; Submit it AND THEN click ok", [("action", "Fill it"), ("action", "Submit it"), ("action", "click ok")]),
        ("fill a and b and submit it and click ok", [("action", "fill a"), ("action", "b and submit it"), ("action", "click ok")]),
        ("", []),
        (None, []),
    ],
)
def test_decompose(spark, task, clauses):
    got = spark.createDataFrame([(task,)], "t string").select(intents.decompose(F.col("t"))).first()[0]
    assert [(c.kind, c.description) for c in got] == clauses


def test_data_source(spark):
    rows = spark.createDataFrame([("Given Name", "", ""), ("Field 1", "email", ""), ("nothing", "", "")], "l string, n string, i string")
    got = [r[0] for r in rows.select(intents.data_source(F.col("l"), F.col("n"), F.col("i"))).collect()]
    assert [(g.source, g.confidence) if g else None for g in got] == [("firstName", 0.95), ("email", 0.85), None]
    by_hint = rows.select(intents.data_source(F.col("l"), F.col("n"), F.col("i"), F.when(F.col("l") == "nothing", "your PIN code"))).collect()
    assert by_hint[2][0].source == "pincode" and by_hint[0][0].source == "firstName"


PATTERNS = [
    # pattern, values that it takes, values that it refuses; None: the pattern is left out
    (r"^(?<y>\d{4})$", ["2024"], ["abcd", "2024\n"]),
    (r"[a-z]+(\.[a-z]+)*@x$", ["a.b@x"], ["a.b@xy"]),
    (r"^(\d+-)*\d$", ["12-3-4"], ["12--4"]),
    (r"a{2", ["xa{2"], ["aa"]),
    (r"^[[]x]$", ["[x]"], ["x]"]),
    (r"^[^]$", ["\n"], [""]),
    (r"^\p{L}$", ["p{L}"], ["a"]),
    (r"^.$", ["\x85"], ["\u2028"]),
    (r"^\s\S$", ["\ufeffa"], ["ab"]),
    (r"\bcat\b", ["a cat!"], ["cats"]),
    (r"^(a)(?<b_1>b)\k<b_1>\1$", ["abba"], ["abab"]),
    (r"^[a-z&&[b]]$", ["&]", "[]"], ["b"]),
    (r"^\u0041\x42\cJ$", ["AB\n"], ["ABJ"]),
    ("^(a+)+$", None, None), ("(?i)a", None, None), ("a++", None, None), ("(", None, None), ("*a", None, None), ("[z-a]", None, None), ("\\", None, None), (r"(a)\2", None, None), ("^(?:(a*)+b)*$", None, None), ("^(a|a?)+$", ["aaa"], ["a" * 40 + "!"]), ("(?<n>a)(?<n>b)", None, None),
]


def test_patterns_of_pages(spark):
    rows, want = [], {}
    for k, (pattern, good, bad) in enumerate(PATTERNS):
        for n, (value, fits) in enumerate([(v, True) for v in good or ["a" * 40 + "!"]] + [(v, False) for v in bad or [] if v]):
            rows.append(field("Code", value=value, pattern=pattern, ord=n, page=k))
            want[k, n] = "none" if fits else "pattern"
    rows.append(field("Code", value="b" * 1001, pattern="^a$", page=99))
    got = {(r.page_id, r.ord): r.rule for r in forms.validate_fields(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got.pop((99, 0)) == "none"
    assert got == want


def test_messages(spark):
    rows = [field("PIN code", value="12", ord=0), field("Pan card", value="ABCPE1234F", ord=1), field("Code", value="abc", max_length=2, ord=2), field("Code", value="x", pattern="^[0-9]$", ord=3), field("Code", required=True, ord=4), field("", name="n", ord=5), field("x", value="v", ord=6)]
    frame = spark.createDataFrame(rows, SCHEMA)
    got = {r.ord: (r.valid, r.message, r.suggestion, r.issue) for r in forms.explain_fields(frame).collect()}
    assert got[0] == (False, "PIN code must be 6 digits", "Check your area PIN code", "PIN code: PIN code must be 6 digits")
    assert got[1] == (True, "Valid pan format", None, None) and got[6] == (True, "No validation rules for this field", None, None)
    assert got[2] == (False, "Maximum 2 characters (currently 3)", "Trim 1 characters", "Code: too long")
    assert got[3][2:] == ("^[0-9]$", "Code: format mismatch") and got[4][3] == "Code: required but empty" and got[5][:2] == (True, "Optional field, empty is OK")
    placed = frame.where("ord = 6").withColumn("placeholder", F.lit("your e-mail"))
    assert [r.rule for r in forms.validate_fields(placed).collect()] == ["email"] and forms.explain_fields(frame.limit(0)).count() == 0


def test_forms_are_dealt_over_tasks(spark):
    from privlake.sources.tables import form_fields, spread

    # one file with one group of rows: its forms were made, and searched, by one task
    counts = [r["count"] for r in form_fields(spark, "/root/testdata/sf0.001").groupBy(F.spark_partition_id()).count().collect()]
    assert len(counts) > 1 and sum(counts) == 16 * 150 and max(counts) < sum(counts) / 2
    assert spread(spark, "/root/testdata/sf0.001", "pages").groupBy(F.spark_partition_id()).count().count() > 1


def test_fields_without_a_pattern_do_not_meet(spark, monkeypatch):
    from privlake.operators import forms
    from privlake.sources.tables import form_fields

    fields = form_fields(spark, "/root/testdata/sf0.001")
    most = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        few = forms.validate_fields(fields)
        assert "SortMergeJoin" not in few._jdf.queryExecution().sparkPlan().toString()  # few patterns are counted and broadcast
        want = sorted(few.collect(), key=str)
        monkeypatch.setattr(forms, "FEW", 0)
        many = forms.validate_fields(fields)
        plan = many._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin [pattern" in plan and "_at#" in plan
        assert sorted(many.collect(), key=str) == want
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", most)
