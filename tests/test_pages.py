"""Nodes of pages, selectors against a plain walk over the tree, and every rule of the lookup."""

import pytest
from pyspark.sql import functions as F

from privlake.operators.selectors import find_nodes, parse_selector, select_nodes
from privlake.sources import forms_html, nodes

SF = "/root/testdata/sf0.001"

PAGE = """<!DOCTYPE html><html lang=en><head><title>T</title></head><body class="a  b">
<nav id=top><ul><li class=x>one<li class="x y">two <b>bold</b><li>three</ul></nav>
<form id=f><label for=n>Name</label><input id=n name=first placeholder="Given name"><label for="grp">Group <select id=s name=grp2><option>a<option selected>b</select></label>
<input name=hid type=hidden><button style="display:none" id=gone>Save</button><button title="Save it" class=btn>Save all</button></form>
<div hidden><a href=#>Save</a><p>in</div><p>a<p class=last>b <a role=tab aria-label="Next page">Next</a><img alt="A red house"><span title="red">s</span>
<table><tr><td>1<td data-k="x-y">2<tr><td>3</table></body></html>"""

SELECTORS = ["li", "ul > li", "nav li.x", "li.x + li", "li ~ li", "li:first-child", "li:last-child", "li:nth-child(2n+1)", "li:nth-child(-n+2)", "li:nth-child(even)", "li:not(.x)", "#top .y b, td", "*", "body > p", "form label input", "form label > select option", "[data-k|=x]", "[class~=b]",
             "[class^='x']", "[class$=y]", "[lang=EN i]", "[alt*=red]", "[alt*='']", "p + p > a", "nav ~ form button:not([id])", "td:only-child", "div p", "html body nav ul li b", "tr td:nth-child(1)", "body *:not(li):not(td) b", "p ~ table td + td", "li:nth-child( 3 )", "B"]
WRONG = ["", " ", ">a", "a >", "a,,b", "a[", "a[x=", "#", ".", "a:hover(", ":nth-child(x)", "a::before", ":not(:not(a))", "[t]..", "a > > b", "1a", "a)", ":not(a b)"]


def walk(rows, selector):
    """The nodes that match, looked for from the right, each step by all nodes before it."""
    by = {r.node: r for r in rows}

    def simple(r, t):
        a = dict(r.attrs or {})
        if t["kind"] == "attr":
            got, v = a.get(t["name"]), t["value"]
            if got is not None and t["fold"]:
                got, v = got.lower(), v.lower()
            ok = got is not None and {None: lambda: True, "=": lambda: got == v, "~=": lambda: bool(v) and v in got.split(), "|=": lambda: got == v or got.startswith(v + "-"), "^=": lambda: bool(v) and got.startswith(v), "$=": lambda: bool(v) and got.endswith(v), "*=": lambda: bool(v) and v in got}[t["op"]]()
        elif t["kind"] == "tag":
            ok = t["value"] in ("*", r.tag)
        else:
            beside = sorted(x.node for x in rows if x.parent == r.parent)
            at = beside.index(r.node) + 1
            ok = any(at == t["a"] * k + t["b"] for k in range(len(beside) + abs(t["b"]) + 1)) if t["kind"] == "nth" else {"first-child": at == 1, "last-child": at == len(beside), "only-child": len(beside) == 1}[t["kind"]]
        return ok != t["no"]

    def met(r, steps, k):
        s = steps[k]
        if s["tag"] not in ("*", r.tag) or not all(simple(r, t) for t in s["tests"]):
            return False
        if not k:
            return True
        beside = sorted(x.node for x in rows if x.parent == r.parent and x.node < r.node)
        up, above = r.parent, []
        while up is not None:
            above.append(up)
            up = by[up].parent
        near = {">": above[:1], " ": above, "+": beside[-1:], "~": beside}[s["link"]]
        return any(met(by[x], steps, k - 1) for x in near)

    steps = parse_selector(selector) or []
    alts = {s["alt"] for s in steps}
    return {r.node for r in rows if any(met(r, [s for s in steps if s["alt"] == a], len([s for s in steps if s["alt"] == a]) - 1) for a in alts)}


@pytest.fixture(scope="module")
def some(spark):
    return spark.createDataFrame([(1, PAGE), (2, None), (3, "<<p <a"), (4, "<div>" * 300 + "<b class=x>deep"), (5, ""), (6, "<p>a<p><svg><g/></svg>" + "</i>" * 99)], "page_id long, html string").withColumn("node", F.lit("clash")).withColumn("a.b", F.lit(1))


def test_nodes(spark, some):
    rows = {r.node: r for r in nodes.page_nodes(some).where("page_id = 1").collect()}
    assert [rows[k].tag for k in range(5)] == ["html", "head", "title", "body", "nav"] and sorted(rows) == list(range(len(rows)))
    li = [r for r in rows.values() if r.tag == "li"]
    assert [(r.place, r.siblings) for r in sorted(li, key=lambda r: r.node)] == [(1, 3), (2, 3), (3, 3)] and len({r.parent for r in li}) == 1
    assert all(r.parent is None or rows[r.parent].node < r.node <= r.last <= rows[r.parent].last for r in rows.values())
    assert next(r.text for r in rows.values() if r.tag == "a" and r.visible) == "Next" and [r.visible for r in rows.values() if dict(r.attrs).get("id") == "gone"] == [False]
    shown = [r.tag for r in sorted((r for r in rows.values() if r.ord is not None), key=lambda r: r.ord)]
    assert shown == ["input", "select", "button", "a"]
    assert nodes.page_nodes(some).where("page_id in (2, 5)").count() == 0
    assert nodes.page_nodes(some.limit(0)).count() == 0 and nodes.page_nodes(some).where("page_id = 4").count() == 301


def test_selectors_by_a_plain_walk(spark, some):
    all_ = nodes.page_nodes(some)
    targets = some.select("page_id").crossJoin(spark.createDataFrame([(s,) for s in SELECTORS + WRONG + [None, "li"]], "selector string"))
    got = {}
    for r in select_nodes(targets, all_).collect():
        got.setdefault((r.page_id, r.selector), set()).add(r.node)
    by = {}
    for r in all_.collect():
        by.setdefault(r.page_id, []).append(r)
    want = {(p, s): w for p, rows in by.items() for s in SELECTORS if (w := walk(rows, s))}
    assert got == want
    assert {s for p, s in want if p == 1} >= set(SELECTORS) - {"[alt*='']", "form label input", "B", "td:only-child"} - {"body *:not(li):not(td) b"}
    assert all(parse_selector(s) is None for s in WRONG)


def test_selectors_over_pages_by_a_plain_walk(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    chosen = ["nav > ul > li a", "article p b", "h1 ~ p:nth-child(2n)", "body>article>p:last-child, footer", "li + li > a[href*='t']", "div.ad + article p:not(:first-child)"]
    targets = pages.select("page_id", F.explode(F.array(*map(F.lit, chosen))).alias("selector"))
    all_ = nodes.page_nodes(pages)
    by, got = {}, {}
    for r in all_.collect():
        by.setdefault(r.page_id, []).append(r)
    for r in select_nodes(targets, all_).collect():
        got.setdefault((r.page_id, r.selector), set()).add(r.node)
    assert got == {(p, s): w for p, rows in by.items() for s in chosen if (w := walk(rows, s))}


def test_lookup_rules(spark, some):
    asked = {"[0]": 0, "[9]": None, "n": 1, "nav li.y": 2, ".btn": 2, "#gone": 8, "first": 3, "Next page": 4, "Given name": 5, "grp": 6, "save ALL": 7, "Save": 8, "all save": 9, "Nxt": 10, "red": 11, "A red": 11, "nothing like it": None, "": None, "li:nth-child(": None}
    targets = spark.createDataFrame([(1, t) for t in asked] + [(1, "n"), (1, None), (9, "n"), (2, "n")], "page_id long, target string")
    all_ = nodes.page_nodes(some)
    got = [(r.page_id, r.target, r.rule, r.node) for r in find_nodes(targets, all_).collect()]
    assert len(got) == targets.count() and sum(t == "n" and p == 1 for p, t, _, _ in got) == 2
    rule = {t: k for p, t, k, _ in got if p == 1}
    rows = {r.node: r for r in all_.where("page_id = 1").collect()}
    asked["#gone"] = None  # the first that matches is hidden, and no other rule takes it
    assert rule == asked | {None: None}
    node = {t: rows[n] for p, t, _, n in got if p == 1 and n is not None}
    assert node["grp"].tag == "select" and node["Save"].tag == "button" and node["n"].tag == "input" and node["red"].tag == "span" and node["A red"].tag == "img" and dict(node["nav li.y"].attrs)["class"] == "x y"
    assert all(k is None for p, _, k, _ in got if p != 1)
    assert find_nodes(targets.limit(0), all_).count() == 0


def test_states_and_fields_of_forms_elsewhere(spark):
    pages = spark.createDataFrame([(1, "https://x.org", "<p>Card number<form id=a></form><input name=q form=a value=v><input name=no><form><textarea name=cf-x>t</textarea></form><script>recaptcha</script><input type=file>"), (2, None, None)], "page_id long, url string, html string")
    fields = forms_html.page_fields(pages).collect()
    assert [(r.form_id, r.ord, r.name, r.value, r.trap) for r in sorted(fields, key=lambda r: r.ord)] == [("a", 0, "q", "v", False), ("form-1", 1, "cf-x", "t", True)]
    one, two = sorted(forms_html.page_states(pages).collect(), key=lambda r: r.page_id)
    assert (one.form_count, one.total_elements, one.interactive_elements, one.has_captcha, one.has_honeypot, one.is_secure, one.has_file_upload, one.has_payment_form) == (2, 8, 4, True, True, True, True, True)
    assert (two.text, two.form_count, two.total_elements, two.has_captcha, two.is_secure) == ("", 0, 0, False, False)


def test_pages_of_many_tags_take_time_in_proportion():
    import time

    def seconds(n):
        walker, now = nodes._Walker(), time.process_time()
        walker.feed("<p>x" + "</b>" * n + "<div>" * n + "</i>" * n + "<li>" * n)
        walker.finish()
        return time.process_time() - now

    assert seconds(80_000) < 4 * 8 * seconds(10_000) + 1


def test_texts_that_sql_reads_in_its_own_way(spark, tmp_path):
    import duckdb

    from privlake.plans.catalogue import ORACLES, QUERIES

    con = duckdb.connect()
    # a heading that was cut off within a reference, and links with a sharp s
    con.execute("CREATE VIEW given AS SELECT * REPLACE (replace(replace(html, '</h1>', ' &copy&amp</h1>'), '</a>', 'ßx</a>') AS html) FROM '/root/testdata/sf0.001/pages.parquet' ORDER BY page_id LIMIT 6")
    con.execute(f"COPY given TO '{tmp_path}/pages.parquet' (FORMAT parquet)")
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet'")
    for name in ("page_states", "pages_sanitised", "found_nodes"):
        got = QUERIES[name](spark, str(tmp_path))
        run = con.execute(ORACLES[name])
        names = [d[0] for d in run.description]
        want = sorted(run.fetchall(), key=str)
        assert sorted((tuple(r[c] for c in names) for r in got.collect()), key=str) == want and want, name
