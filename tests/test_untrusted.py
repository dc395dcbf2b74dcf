"""Rows from a source that can't be trusted."""

import json

from privlake.operators import untrusted as u

ROW = {"url": "https://a.example/x", "method": "GET", "bytes": 5, "matches": [{"category": "email"}, "m", None]}


def message(rows, **more):
    return json.dumps({"source": u.OBSERVATIONS.sender, "observations": rows} | more)


def test_rows_are_checked_clamped_and_capped(spark):
    long = ROW | {"url": "ü" * 600, "method": "M" * 17, "bytes": -1.5, "matches": list(range(33))}
    bodies = {
        1: message([ROW, long, ROW | {"bytes": 1e300}, ROW | {"bytes": 9007199254740993}]),
        2: message([{k: v for k, v in ROW.items() if k != "method"}, ROW | {"url": 5}, ROW | {"bytes": "5"}, ROW | {"bytes": None}, ROW | {"matches": {}}, None, 7, "x", [], ROW]),
        3: message([ROW] * 50 + [{}] + [ROW] * 9),
        4: None, 5: "", 6: "{", 7: "null", 8: "[1]", 9: message([], more=1), 10: message([ROW], source="else"), 11: message([ROW], source=None), 12: json.dumps({"observations": [ROW]}), 13: message(ROW), 14: message([ROW], source=["tripwire-report"]), 15: '{"source": "tripwire-report", "observations": [' + json.dumps(ROW)[:-1] + ', "bytes": 7}]}',
    }
    frame = spark.createDataFrame([*bodies.items(), (1, bodies[1]), (None, bodies[6])], "id long, body string").selectExpr("*", "'clash' AS reason", "1 AS `a.b`", "2 AS _rows")
    got = u.checked_rows(frame, "id", "body")
    rows = {}
    for r in got.collect():
        rows.setdefault(r.id, []).append(r)
    assert len(rows[1]) == 8 and all(r.reason is None for r in rows[1])
    first = sorted(rows[1], key=lambda r: r.ordinal)[::2]
    assert (first[0].url, first[0].method, first[0].bytes, first[0].matches, first[0].cut) == (ROW["url"], "GET", 5.0, ['{"category":"email"}', "m", None], [])
    assert (first[1].url, first[1].method, first[1].bytes, len(first[1].matches), first[1].cut) == ("ü" * 512, "M" * 16, 0.0, 32, ["url", "method", "bytes", "matches"])
    assert [(r.bytes, r.cut) for r in first[2:]] == [(2.0**53 - 1, ["bytes"])] * 2
    assert [r.reason for r in sorted(rows[2], key=lambda r: r.ordinal)] == ["no_method", "no_url", "no_bytes", "no_bytes", "no_matches", "no_url", "no_url", "no_url", "no_url", None]
    assert next(r for r in rows[2] if r.ordinal == 6).raw == "7"
    assert [r.reason for r in sorted(rows[3], key=lambda r: r.ordinal)] == [None] * 50 + ["beyond_limit"] * 10
    assert {k: [(r.ordinal, r.reason) for r in v] for k, v in rows.items() if k is None or 3 < k < 15} == {
        **{k: [(None, "not_json")] for k in (None, 4, 5, 6)}, **{k: [(None, "wrong_source")] for k in (7, 8, 10, 11, 12, 14)}, **{k: [(None, "no_rows")] for k in (9, 13)},
    }
    assert rows[6][0].raw == "{" and rows[4][0].raw is None
    assert rows[15][0].reason == "not_json"  # a name twice in one object
    counts = {r.what: r.n for r in u.tally(got).collect()}
    assert counts["good"] == 8 + 1 + 50 and counts["refused: beyond_limit"] == 10 and counts["cut: bytes"] == 6 and counts["refused: wrong_source"] == 6
    assert u.good_rows(got).count() == counts["good"] and u.quarantined(got).count() == sum(n for w, n in counts.items() if w.startswith("refused"))


def test_no_messages(spark):
    none = spark.createDataFrame([], "id long, body string")
    assert u.checked_rows(none, "id", "body").count() == 0
    assert {r.n for r in u.tally(u.checked_rows(none, "id", "body")).collect()} == {0}


def test_rows_of_another_kind(spark):
    relay = u.Relay((u.Field("name", "string", 3), u.Field("score", "number", 10.0, 1.0)), "items", "from", "me", 2)
    frame = spark.createDataFrame([("k", '{"from": "me", "items": [{"name": "abcd", "score": 0}, {"name": "x", "score": 3, "z": 1}, {"name": "y", "score": 3}]}')], "id string, body string")
    got = sorted(u.checked_rows(frame, "id", "body", relay).collect(), key=lambda r: r.ordinal)
    assert [(r.name, r.score, r.cut, r.reason) for r in got] == [("abc", 1.0, ["name", "score"], None), ("x", 3.0, [], None), (None, None, [], "beyond_limit")]
