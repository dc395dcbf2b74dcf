"""CSS selectors over rows of nodes, and the lookup of the element that a target means."""

from __future__ import annotations

import re
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from privlake.sources.nodes import clickable

_NAME = r"-?[_a-zA-Z\u0080-\U0010ffff][-\w\u0080-\U0010ffff]*"
_SIMPLE = re.compile(
    rf"(?P<tag>\*|{_NAME})|\#(?P<id>{_NAME})|\.(?P<class>{_NAME})"
    rf"""|\[\s*(?P<attr>{_NAME})\s*(?:(?P<op>[~|^$*]?=)\s*(?:"(?P<double>[^"\n\\]*)"|'(?P<single>[^'\n\\]*)'|(?P<bare>{_NAME}))\s*(?P<fold>[iIsS])?\s*)?\]"""
    r"|:(?P<pseudo>first-child|last-child|only-child)|:nth-child\(\s*(?P<nth>[^()]*?)\s*\)|:not\(\s*(?P<not>[^()]*?)\s*\)"
)
_LINK = re.compile(r"\s*([>+~,])\s*|\s+")
_NTH = re.compile(r"(?P<a>[-+]?\d*)n\s*(?:(?P<sign>[-+])\s*(?P<b>\d+))?|(?P<only>[-+]?\d+)")
_STEP_TYPE = "struct<alt: int, step: int, steps: int, link: string, tag: string, tests: array<struct<kind: string, name: string, op: string, value: string, fold: boolean, a: int, b: int, no: boolean>>>"
#: Rows of find_nodes() for a label that is for the target, and for a field within such a label.
LABEL, FIELD = 20, 21


def _nth(text: str) -> tuple[int, int]:
    text = {"odd": "2n+1", "even": "2n"}.get(text.lower(), text.lower())
    found = _NTH.fullmatch(text)
    if not found:
        raise ValueError(text)
    if found["only"]:
        return 0, int(found["only"])
    a = found["a"] + "1" if found["a"] in {"", "+", "-"} else found["a"]
    return int(a), int((found["sign"] or "+") + (found["b"] or "0"))


def _simple(found: re.Match, no: bool = False) -> dict:
    test = {"kind": "attr", "name": None, "op": None, "value": None, "fold": False, "a": None, "b": None, "no": no}
    if found["id"] or found["class"]:
        return test | {"name": "id" if found["id"] else "class", "op": "=" if found["id"] else "~=", "value": found["id"] or found["class"]}
    if found["attr"]:
        value = next((found[k] for k in ("double", "single", "bare") if found[k] is not None), None)
        return test | {"name": found["attr"].lower(), "op": found["op"], "value": value, "fold": (found["fold"] or "").lower() == "i"}
    if found["nth"] is not None:
        a, b = _nth(found["nth"])
        return test | {"kind": "nth", "a": a, "b": b}
    if found["tag"]:
        return test | {"kind": "tag", "value": found["tag"].lower()}
    return test | {"kind": found["pseudo"]}


def parse_selector(selector: str) -> list[dict] | None:
    """The steps of a selector list: for each alternative, its compounds from left to right with the sign that links each to the one before it. None if it can't be read.

    Read are tags, *, #id, .class, [attr] with =, ~=, |=, ^=, $=, *= and i, :first-child, :last-child, :only-child, :nth-child() and :not() of single such tests; blanks, >, + and ~ between compounds.
    """
    out, steps, link, tests, tag, at, text = [], [], "", [], None, 0, selector.strip()
    try:
        while True:
            found = _SIMPLE.match(text, at)
            if found and not (found["tag"] and (tests or tag)):
                at = found.end()
                if found["tag"]:
                    tag = found["tag"].lower()
                elif found["not"] is not None:
                    for part in found["not"].split(","):
                        inner = _SIMPLE.fullmatch(part.strip())
                        if not inner or inner["not"] is not None:
                            return None
                        tests.append(_simple(inner, no=True))
                else:
                    tests.append(_simple(found))
                continue
            if not tests and not tag:
                return None
            steps.append({"link": link, "tag": tag or "*", "tests": tests})
            tests, tag = [], None
            gap = _LINK.match(text, at)
            if at == len(text) or (gap and gap[1] == ","):
                out.append(steps)
                steps, link = [], ""
                if at == len(text):
                    break
            elif not gap:
                return None
            else:
                link = gap[1] or " "
            at = gap.end()
    except ValueError:
        return None
    return [s | {"alt": k, "step": n, "steps": len(steps)} for k, steps in enumerate(out) for n, s in enumerate(steps)]


def _passes(t: Column) -> Column:
    """Whether a node passes one test."""
    raw = F.element_at("attrs", t["name"])
    got, value = F.when(t["fold"], F.lower(raw)).otherwise(raw), F.when(t["fold"], F.lower(t["value"])).otherwise(t["value"])
    some = F.coalesce(value != "", F.lit(False))
    attr = (
        F.when(t["op"].isNull(), raw.isNotNull())
        .when(t["op"] == "=", got == value)
        .when(t["op"] == "~=", some & F.array_contains(F.split(got, r"[ \t\n\r\f]+"), F.coalesce(value, F.lit(""))))
        .when(t["op"] == "|=", (got == value) | F.startswith(got, F.concat(value, F.lit("-"))))
        .when(t["op"] == "^=", some & F.startswith(got, value))
        .when(t["op"] == "$=", some & F.endswith(got, value))
        .otherwise(some & F.contains(got, value))
    )
    far = F.col("place") - t["b"]
    nth = F.when(t["a"] == 0, far == 0).otherwise((far * F.signum(t["a"]) >= 0) & (far % t["a"] == 0))
    kinds = F.when(t["kind"] == "attr", attr).when(t["kind"] == "nth", nth).when(t["kind"] == "tag", (t["value"] == "*") | (t["value"] == F.col("tag"))).when(t["kind"] == "first-child", F.col("place") == 1).when(t["kind"] == "last-child", F.col("place") == F.col("siblings")).otherwise(F.col("siblings") == 1)
    return F.coalesce(kinds, F.lit(False)) != t["no"]


def compiled(targets: DataFrame, column: str) -> DataFrame:
    """Rows (column, _steps) for the distinct values of a column that can be read as selectors: each is parsed once."""


    @F.pandas_udf(f"array<{_STEP_TYPE}>")
    def steps(selectors: pd.Series) -> pd.Series:
        return selectors.map(parse_selector, na_action="ignore")

    return targets.select(column).where(F.col(column).isNotNull()).distinct().withColumn("_steps", steps(column)).where("_steps is not null")


def _candidates(steps: Column) -> Column:
    """The steps whose compound a node matches."""
    return F.filter(steps, lambda s: ((s["tag"] == "*") | (s["tag"] == F.col("tag"))) & F.forall(s["tests"], _passes))


def _links(parsed: DataFrame) -> list[tuple[int, str]]:
    """Which links occur at which step, over all selectors: a few rows, as steps and signs are few."""
    return sorted(parsed.select(F.explode("_steps").alias("s")).select("s.step", "s.link").where("step > 0").distinct().collect())


def _follow(rows: DataFrame, by: list[str], links: list[tuple[int, str]]) -> DataFrame:
    """Adds `hit` to rows (by, _s, node, last, parent, prev, place): whether all steps up to the row's own are met.

    Step after step from the left, windows over the candidates of one selector on one page tell whether the step before is met by an ancestor (the farthest last node of earlier
    ones reaches this node), the parent, the element before, or an earlier sibling. All windows share one partitioning.
    """
    group, s = [*by, F.col("_s.alt")], F.col("_s.step")
    rows = rows.withColumn("hit", s == 0)
    for step in sorted({k for k, _ in links}):
        before, ways = (s == step - 1) & F.col("hit"), []
        for sign in sorted(x for k, x in links if k == step):
            if sign == " ":
                earlier = Window.partitionBy(*group).orderBy("node").rangeBetween(Window.unboundedPreceding, -1)
                met = F.max(F.when(before, F.col("last"))).over(earlier) >= F.col("node")
            elif sign == "~":
                met = F.min(F.when(before, F.col("place"))).over(Window.partitionBy(*group, F.coalesce("parent", F.lit(-1)))) < F.col("place")
            else:
                key = F.when(before, F.col("node")).otherwise(F.col("parent" if sign == ">" else "prev"))
                # a row may be the one before and the one after: it then has two keys, so it is asked as the one before only where it is no later step
                met = F.max(F.when(before, F.lit(1))).over(Window.partitionBy(*group, F.when(s.isin(step - 1, step), key))) == 1
            ways.append((F.col("_s.link") == sign) & F.coalesce(met, F.lit(False)))
        rows = rows.withColumn("hit", F.when(s == step, reduce(Column.__or__, ways)).otherwise(F.col("hit")))
    return rows


def select_nodes(targets: DataFrame, nodes: DataFrame) -> DataFrame:
    """Rows (page_id, selector, node): the nodes of a page that match each selector of `targets` (page_id, selector); a selector that can't be read matches none.

    Each distinct selector is parsed once. Nodes meet their page's selectors, and only the (node, step) pairs whose compound matches are shuffled. Nulls match nothing, repeated targets count once.
    """
    targets = targets.select("page_id", "selector").distinct()
    parsed = compiled(targets, "selector")
    links = _links(parsed)
    rows = nodes.select("page_id", "node", "parent", "last", "prev", "place", "siblings", "tag", "attrs").join(targets.join(parsed, "selector"), "page_id")
    rows = rows.select("page_id", "selector", "node", "parent", "last", "prev", "place", F.explode(_candidates(F.col("_steps"))).alias("_s"))
    rows = _follow(rows, ["page_id", "selector"], links)
    return rows.where("hit and _s.step = _s.steps - 1").select("page_id", "selector", "node").distinct()


def find_nodes(targets: DataFrame, nodes: DataFrame) -> DataFrame:
    """Targets (page_id, target) with the node meant, and the number of the rule that found it; nulls if none does.

    Rules in order: 0: [n] is the n-th visible interactive element, and no other rule is tried; 1 id; 2 a CSS selector, if the target holds one of . [ > #; 3 name; 4 ARIA label; 5 placeholder; 6 the field in the label
    that is `for` the target, or else the element with that id, visible or not; 7 exact text of a button, link, tab or menu item, 8 text that contains the target, 9 text with all its words, 10 the nearest text within max(2, 30 %)
    edits; 11 title, or else alt text, that contains it. Rules 1 to 5 and 11 take the first node that matches, and fail if it is not visible; 7 to 10 take the first visible one.

    `nodes` are page_nodes(). Nodes that no rule could take are dropped before the shuffle. Repeated targets are looked up once and joined back; null and empty targets find nothing.
    """
    asked = targets.select("page_id", "target").where("target <> ''").distinct()
    parsed = compiled(asked.where(F.col("target").rlike(r"[.\[>#]")), "target")
    links = _links(parsed)
    a = lambda name: F.element_at("attrs", name)
    goal, text = F.col("target"), F.lower(F.col("text"))
    lower = F.lower(goal)
    index = F.regexp_extract(goal, r"^\[([0-9]+)\]\z", 1)
    named = {1: a("id") == goal, 3: a("name") == goal, 4: a("aria-label") == goal, 5: a("placeholder") == goal, 11: F.contains(a("title"), goal), 12: F.contains(a("alt"), goal)}
    usable = F.col("visible") & clickable()
    distance = F.levenshtein(lower, F.left(text, F.length(lower) + 5))
    near = (text != "") & (distance <= F.greatest(F.lit(2), F.floor(F.length(lower) * 3 / 10)))
    said = {7: text == lower, 8: F.contains(text, lower), 9: F.forall(F.split(lower, r"\s+"), lambda w: F.contains(text, w)), 10: near}
    field = F.col("tag").isin("input", "select", "textarea")
    rows = nodes.join(asked.join(parsed, "target", "left"), "page_id")
    # every rule that a node meets is a row: the explode also keeps each rule from being evaluated twice
    none = F.lit(None).cast(_STEP_TYPE)
    entry = lambda k, c, far=None: F.when(F.coalesce(c, F.lit(False)), F.struct(F.lit(k).alias("rule"), (F.lit(0) if far is None else far).alias("far"), none.alias("step")))
    met = [entry(0, (index != "") & (F.col("ord") == index.try_cast("int"))), *(entry(k, c) for k, c in named.items()), *(entry(k, usable & c, distance if k == 10 else None) for k, c in said.items())]
    met += [entry(LABEL, (F.col("tag") == "label") & (a("for") == goal)), entry(FIELD, field & (F.col("label_for") == goal))]
    steps = F.transform(F.coalesce(_candidates(F.col("_steps")), F.array().cast(f"array<{_STEP_TYPE}>")), lambda x: F.struct(F.lit(2).alias("rule"), F.lit(0).alias("far"), x.alias("step")))
    rows = rows.select("page_id", "target", "node", "parent", "last", "prev", "place", "visible", "label", F.explode(F.concat(F.array_compact(F.array(*met)), steps)).alias("_e"))
    rows = _follow(rows.withColumn("_s", F.col("_e.step")), ["page_id", "target"], links)
    rule = F.when(F.col("_e.rule") != 2, F.col("_e.rule")).when(F.col("hit") & (F.col("_s.step") == F.col("_s.steps") - 1), F.lit(2))
    first = lambda k: F.min(F.when(rule == k, F.struct("node", "visible", "label")))
    best = rows.groupBy("page_id", "target").agg(*(first(k).alias(f"r{k}") for k in (0, 2, *named, *said, LABEL, FIELD) if k != 10), F.min(F.when(rule == 10, F.struct("_e.far", "node"))).alias("r10"))
    shown = lambda k: F.when(F.col(f"r{k}.visible"), F.col(f"r{k}.node"))
    label, within = F.col(f"r{LABEL}.node"), F.col(f"r{FIELD}")
    labelled = F.when(label.isNotNull(), F.coalesce(F.when(within["label"] == label, within["node"]), F.col("r1.node")))
    order = {1: shown(1), 2: shown(2), 3: shown(3), 4: shown(4), 5: shown(5), 6: labelled, 7: F.col("r7.node"), 8: F.col("r8.node"), 9: F.col("r9.node"), 10: F.col("r10.node"), 11: F.coalesce(shown(11), shown(12))}
    by_index = F.regexp_extract("target", r"^\[([0-9]+)\]\z", 1) != ""
    pick = F.coalesce(*(F.when(c.isNotNull(), F.struct(c.cast("int").alias("node"), F.lit(k).alias("rule"))) for k, c in order.items()))
    best = best.select("page_id", "target", F.when(by_index, F.when(F.col("r0").isNotNull(), F.struct(F.col("r0.node").cast("int").alias("node"), F.lit(0).alias("rule")))).otherwise(pick).alias("b"))
    same = F.col("t.page_id").eqNullSafe(F.col("f.page_id")) & (F.col("t.target") == F.col("f.target"))
    return targets.alias("t").join(best.alias("f"), same, "left").select("t.page_id", "t.target", "f.b.node", "f.b.rule")

