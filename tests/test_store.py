"""The keyed store against a dictionary, and snapshots compared by plain loops."""

import random

from pyspark.sql import functions as F

from privlake.operators import snapshots, store

GOOD, BAD = "0123456789abcdef", "fedcba9876543210"


def replay(changes, upto):
    state = {}
    for s, k, op, v, _ in sorted((c for c in changes if c[4] <= upto), key=lambda c: c[4]):
        if op == "clear":
            state = {x: y for x, y in state.items() if x[0] != s}
        elif op == "put" and v is not None:
            state[s, k] = v
        elif op in {"put", "delete"}:
            state.pop((s, k), None)
    return state


def some_changes(n=400):
    r = random.Random(5)
    ops = ["put"] * 12 + ["delete"] * 3 + ["clear"]
    rows = [(r.choice(["tasks", "sites"]), f"k{r.randrange(9)}", r.choice(ops), r.choice(["é", "", '{"a": 1}', None, f"v{v}"]), v) for v in range(n)]
    return [(s, None if op == "clear" else k, op, v, n) for s, k, op, v, n in rows]


def values(state):
    return {(r.store, r.key): r.value for r in store.read_all(state, F.lit(GOOD)).collect()}


def test_state_after_any_prefix(spark, tmp_path):
    changes = some_changes()
    kept = store.KeyedStore(spark, f"file://{tmp_path}/store")
    assert kept.state().count() == 0 and kept.compact() is None
    schema = "store string, key string, op string, value string, version int"
    for first, to in ((0, 150), (150, 250), (250, 400)):
        part = spark.createDataFrame(changes[first:to], schema).withColumn("sealed", F.lit("clash"))
        kept.append(part, F.lit(GOOD))
        assert values(kept.state()) == replay(changes, to - 1)
        if to != 250:
            assert kept.compact() == to - 1 and kept.compact() == to - 1
            assert values(kept.state()) == replay(changes, to - 1)
    for upto in (0, 7, 149, 150, 180, 249, 333, 399, 10**9):
        assert values(kept.state(upto)) == replay(changes, upto)
    assert "v1" not in "".join(map(str, spark.read.parquet(f"file://{tmp_path}/store/log").collect()))


def test_rows_that_do_not_open_are_counted(spark):
    rows = spark.createDataFrame([("s", "a", "put", "1", 1), ("s", "b", "put", "2", 2), ("s", "c", "put", "3", 3), ("t", "a", "put", "4", 4), ("t", None, "clear", None, 5), ("s", "b", "put", "5", 6), (None, "a", "put", "6", 7), ("s", None, "put", "7", 8), ("s", "d", "drop", "8", 9), ("s", "e", "put", "9", None)], "store string, key string, op string, value string, version long")
    secret = F.when(F.col("key") == "c", F.lit(BAD)).otherwise(F.lit(GOOD))
    sealed = rows.withColumn("sealed", F.when(F.col("op") == "put", store.sealed(F.col("value"), secret)))
    broken = sealed.withColumn("sealed", F.when(F.col("key") == "a", F.expr("overlay(sealed PLACING X'00' FROM 20)")).otherwise(F.col("sealed")))
    state = store.live(broken)
    assert {(r.store, r.key, r.value) for r in store.read_all(state, F.lit(GOOD)).collect()} == {("s", "b", "5")}
    assert [tuple(r) for r in store.store_counts(state, F.lit(GOOD)).collect()] == [("s", 3, 1, 2)]
    assert store.live(broken.limit(0)).count() == 0
    same = spark.createDataFrame([("s", "a", "put", b"1", 1), ("s", "a", "delete", None, 1), ("s", None, "clear", None, 1), ("s", "a", "put", b"2", 1)], "store string, key string, op string, sealed binary, version long")
    assert [bytes(r.sealed) for r in store.live(same).collect()] == [b"2"]


def test_snapshots(spark):
    rows = [(1, 1, "a", "x"), (1, 1, "b", None), (1, 1, "c", "z"), (1, 5, "a", "y"), (1, 5, "b", None), (1, 5, None, "n"), (1, 9, None, "n"), (2, 1, "a", "x"), (None, 1, "q", "1"), (None, 2, "q", "1")]
    frame = spark.createDataFrame(rows, "page_id long, step long, key string, value string").withColumn("was", F.lit(1))
    got = {(r.page_id, r.step, r.key): (r.change, r.before, r.after) for r in snapshots.changes(frame.where("page_id is not null")).collect()}
    assert got == {(1, 5, "a"): ("changed", "x", "y"), (1, 5, "b"): ("kept", None, None), (1, 5, "c"): ("removed", "z", None), (1, 5, None): ("added", None, "n"), (1, 9, "a"): ("removed", "y", None), (1, 9, "b"): ("removed", None, None), (1, 9, None): ("kept", "n", "n")}
    assert snapshots.changes(frame.limit(0)).count() == 0
    one = {(r.page_id, r.key): r.change for r in snapshots.compare(frame.where("step = 1"), frame.where("step = 2"), ["page_id"]).collect()}
    assert one == {(1, "a"): "removed", (1, "b"): "removed", (1, "c"): "removed", (2, "a"): "removed", (None, "q"): "kept"}


def test_steps_are_verified(spark):
    states = spark.createDataFrame([(1, 0, 3, "t", "[]"), (1, 1, 3, "t", "[]"), (1, 2, 4, "t", "[]"), (1, 3, 4, None, "[]"), (1, 4, 4, None, None)], "page_id long, step long, n_elements int, text string, forms string")
    assert [(r.elements_changed, r.text_changed, r.forms_changed, r.changed) for r in snapshots.page_changes(states).orderBy("step").collect()] == [(False,) * 4, (False,) * 4, (True, False, False, True), (False, True, False, True), (False, False, True, True)]
    plan = spark.createDataFrame([(1, 0, "click", "x", None), (1, 1, "type", "n", "Ann"), (1, 2, "type", "n", "Bob"), (1, 3, "type", "none", "v"), (1, 4, "type", "n", ""), (2, 0, "type", "n", "v")], "page_id long, step long, action string, target string, value string")
    fields = spark.createDataFrame([(1, 1, 1, "n", "", "late"), (1, 1, 0, "x", "n", "Ann"), (1, 2, 0, "n", "n", None), (1, 4, 0, "n", "n", "v"), (2, 0, 0, "n", "n", "v")], "page_id long, step long, ord int, id string, name string, value string")
    got = sorted(tuple(r) for r in snapshots.verify_steps(plan, states, fields).collect())
    assert [(p, s, k, ok, c) for p, s, k, ok, c, _ in got] == [(1, 0, "page", True, 0.6), (1, 1, "field", True, 0.95), (1, 1, "page", True, 0.6), (1, 2, "field", False, 0.3), (1, 2, "page", True, 0.9), (1, 3, "page", True, 0.9), (1, 4, "page", True, 0.9), (2, 0, "page", True, 0.5)]
    assert got[3][5] == 'Field value mismatch: expected "Bob", got ""'
    assert snapshots.verify_steps(plan.limit(0), states, fields).count() == 0
