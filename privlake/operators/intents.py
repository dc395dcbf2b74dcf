"""What a task in plain language asks for, in column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from privlake.functions.text import B

#: Openers and phrases of questions and of extraction, verbs, and separators of a sequence.
QUESTION_OPENERS = (
    r"^(what|which|where|when|why|who|whom|whose|how)" + B,
    r"^(is|are|do|does|did|has|have|was|were|can|could|will|would|should|am)\s+(i|you|we|they|he|she|there|my|any)" + B,
    r"^(check|tell me|find out|see|show me|know|look up|identify|locate)\s+(where|what|which|who|whom|whose|when|why|how|whether|if)" + B,
)
QUESTION_PHRASES = ("check whether", "check if", "tell me if", "tell me whether", "let me know if", "verify that", "verify whether", "confirm that", "confirm whether", "is there", "do i have", "did i", "have i", "am i", "what do i", "what should i", "what needs", "what is required")
EXTRACTION_PHRASES = ("extract", "scrape", "read this page", "read the page", "get the data", "get all data", "list all", "summarize this page", "what's on this page", "what is on this page", "show me the data", "pull the data", "copy the data")
EXTRACTION_VETO = B + r"(fill|submit|click|type into|complete the form)" + B
ACTION_VERBS = B + r"(fill|submit|click|type|select|scroll|navigate|go to|open|press|check|upload|choose|enter)" + B
READ_VERBS = B + r"(extract|scrape|read|list|summari[sz]e|show me|get the data|pull|copy)" + B
SEPARATORS = (" and then ", " then ", " after that ", " followed by ", ";", " & then ")


def _any(text: Column, phrases: tuple[str, ...]) -> Column:
    return reduce(lambda a, p: a | text.contains(p), phrases, F.lit(False))


def is_question(task: Column) -> Column:
    """Ends in a question mark, opens like a question, or holds one of the phrases."""
    t = F.lower(F.trim(F.coalesce(task, F.lit(""))))
    opened = reduce(lambda a, p: a | t.rlike(p), QUESTION_OPENERS, F.lit(False))
    return (t != "") & (t.endswith("?") | opened | _any(t, QUESTION_PHRASES))


def is_extraction(task: Column) -> Column:
    """Holds an extraction phrase and no verb that makes it an action."""
    t = F.lower(F.trim(F.coalesce(task, F.lit(""))))
    return (t != "") & ~t.rlike(EXTRACTION_VETO) & _any(t, EXTRACTION_PHRASES)


def _kind(clause: Column) -> Column:
    t = F.lower(clause)
    return F.when(is_extraction(clause) | (t.rlike(READ_VERBS) & ~t.rlike(ACTION_VERBS)), "extract").otherwise("action")


def _has_verb(clause: Column) -> Column:
    t = F.lower(clause)
    return t.rlike(ACTION_VERBS) | t.rlike(READ_VERBS)


def _cut_at_and(clause: Column) -> Column:
    """Cut at the first " and " whose left part and whole remaining right part both have a verb, again and again on the right."""
    pieces = F.split(clause, "(?i) and ")
    joined = lambda a, b: F.concat(a, F.lit(" and "), b)
    size = F.size(pieces)

    def step(acc: Column, i: Column) -> Column:
        piece = F.element_at(pieces, i + 1)
        rest = F.array_join(F.slice(pieces, i + 1, F.greatest(size - i, F.lit(0))), " and ")
        cut = _has_verb(acc["now"]) & _has_verb(rest)
        return F.when(cut, F.struct(F.concat(acc["done"], F.array(acc["now"])).alias("done"), piece.alias("now"))).otherwise(F.struct(acc["done"].alias("done"), joined(acc["now"], piece).alias("now")))

    start = F.struct(F.array().cast("array<string>").alias("done"), F.element_at(pieces, 1).alias("now"))
    return F.when(size == 1, F.array(clause)).otherwise(F.aggregate(F.sequence(F.lit(1), F.greatest(size - 1, F.lit(1))), start, step, lambda a: F.concat(a["done"], F.array(a["now"]))))


def decompose(task: Column) -> Column:
    """The task's clauses in order: structs kind (extract or action) and description; of extract clauses, the first only. Blank: none."""
    parts = F.array(F.trim(F.coalesce(task, F.lit(""))))
    for pattern in ("(?i)" + s.replace(" ", "[ ]") for s in SEPARATORS):
        parts = F.flatten(F.transform(parts, lambda p: F.split(p, pattern)))  # noqa: B023  used within the turn
        parts = F.filter(parts, lambda p: F.trim(p) != "")
    clauses = F.transform(F.flatten(F.transform(parts, _cut_at_and)), lambda c: F.trim(c))
    tasks = F.transform(F.filter(clauses, lambda c: c != ""), lambda c: F.struct(_kind(c).alias("kind"), c.alias("description")))
    # separators alone are a clause by themselves
    whole = F.trim(F.coalesce(task, F.lit("")))
    tasks = F.when((F.size(tasks) == 0) & (whole != ""), F.array(F.struct(_kind(whole).alias("kind"), whole.alias("description")))).otherwise(tasks)
    first = F.array_position(F.transform(tasks, lambda t: t["kind"]), F.lit("extract"))
    return F.filter(tasks, lambda t, i: (t["kind"] != "extract") | (i + 1 == first))


#: What a field's label says it wants, in order of precedence.
DATA_SOURCES = (
    ("firstName", (r"given\s*name", r"first\s*name", r"applicant.*name")),
    ("lastName", (r"family\s*name", r"last\s*name", r"surname")),
    ("fullName", (r"full\s*name", r"name\s*as.*passport")),
    ("fatherName", (r"father.*name",)),
    ("motherName", (r"mother.*name",)),
    ("spouseName", (r"husband.*name", r"spouse.*name")),
    ("email", (r"e?-?mail",)),
    ("phone", (r"mobile", r"phone", r"cell", r"contact.*number")),
    ("aadhaar", (r"aadhaar", r"aadhar", r"uid")),
    ("pan", (r"pan\s*card", r"pan\s*number")),
    ("dob", (r"date\s*of\s*birth", B + "dob" + B, r"birth.*date")),
    ("gender", (r"gender", B + "sex" + B)),
    ("address", (r"address", r"street", r"road", r"lane")),
    ("city", (r"city", r"town", r"district")),
    ("state", (r"state", r"province")),
    ("pincode", (r"pin\s*code", r"pincode", r"postal.*code", r"zip")),
    ("accountNumber", (r"account.*number", r"a/c")),
    ("ifsc", (r"ifsc",)),
    ("upiId", (r"upi", r"vpa")),
    ("education", (r"qualification", r"degree", r"education")),
    ("institution", (r"institution", r"college", r"university", r"school")),
    ("occupation", (r"occupation", r"profession", r"job", r"designation")),
    ("income", (r"income", r"salary", r"annual.*income")),
)


def data_source(label: Column, name: Column, id_: Column, placeholder: Column | None = None) -> Column:
    """Struct source, confidence of the saved value that a field wants, or null: the first pattern that finds it with 0.95, else the first with 0.85.

    A match has 0.85 if the first single word that fits the pattern is not part of the label, else 0.95.
    """
    label, name, id_, placeholder = (F.coalesce(x, F.lit("")) for x in (label, name, id_, F.lit("") if placeholder is None else placeholder))
    context = F.lower(F.concat_ws(" ", label, name, id_, placeholder))
    words = F.split(context, " ")
    sure, fair = [], []
    for source, patterns in DATA_SOURCES:
        for p in patterns:
            word = F.coalesce(F.get(F.filter(words, lambda w: w.rlike(p)), F.lit(0)), F.lit(""))  # noqa: B023  used within the turn
            strong = F.contains(F.lower(label), word)
            sure.append(F.when(context.rlike(p) & strong, F.struct(F.lit(source).alias("source"), F.lit(0.95).alias("confidence"))))
            fair.append(F.when(context.rlike(p), F.struct(F.lit(source).alias("source"), F.lit(0.85).alias("confidence"))))
    return F.coalesce(*sure, *fair)


def action_description(clauses: Column) -> Column:
    """The action clauses of decompose() in one description."""
    return F.array_join(F.transform(F.filter(clauses, lambda c: c["kind"] == "action"), lambda c: F.trim(c["description"])), ", then ")


def is_compound(clauses: Column) -> Column:
    return F.size(clauses) > 1
