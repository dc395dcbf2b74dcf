import json
import time

from privlake.operators import ledger
from privlake.streaming import ledger as stream

ROWS = [(1, "own", "https://x.com/a?token=1#f", "call 9876543210"), (2, "own", "https://x.com/a", "hello"), (3, "page", "http://localhost/", "4539578763621486"), (4, "own", "bad url", None)]


def requests(spark, rows=ROWS):
    return spark.createDataFrame([(i, o, u, b) for i, o, u, b in rows], "request_id long, origin string, url string, body string").selectExpr("request_id", "timestamp'2024-01-01 00:00:00' AS ts", "origin", "url", "'POST' AS method", "body")


def test_decisions_never_hold_values(spark):
    got = {r.request_id: r for r in ledger.decide(requests(spark)).collect()}
    assert [got[k].decision for k in (1, 2, 3, 4)] == ["blocked", "allowed", "observed", "allowed"]
    assert got[1].url == "https://x.com/a" and got[1].samples == ["98******10"] and got[4].bytes == 0
    assert not any("9876543210" in json.dumps(r.asDict(), default=str) for r in got.values())


def test_big_bodies_are_counted_not_scanned(spark):
    got = ledger.decide(requests(spark, [(1, "own", "https://x.com", "9876543210 " * 30_000)])).first()
    assert (got.decision, got.bytes) == ("unscanned", 330_000)


def test_totals(spark):
    got = {r.origin: r for r in ledger.totals(ledger.decide(requests(spark)), "origin").collect()}
    assert (got["own"].total, got["own"].blocked, got["own"].clean, got["own"].blocked_categories) == (3, 1, 2, "phone")
    assert (got["page"].observed, got["page"].bytes_blocked) == (1, 0)


def test_verification(spark):
    rows = spark.createDataFrame([(1, "dom_diff", True, 0.9), (1, "url_change", False, 0.5), (2, "url_change", True, 1.0)], "k long, type string, passed boolean, confidence double")
    got = {r.k: (r.confidence, r.success) for r in ledger.verify(rows, "k").collect()}
    assert got == {1: (0.675, True), 2: (1.0, False)}


def test_stream_equals_batch(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    for i, o, u, b in ROWS:
        (folder / f"{i}.json").write_text(json.dumps({"request_id": i, "ts": "2024-01-01T00:00:00Z", "origin": o, "url": u, "method": "POST", "body": b}) + "\n" + ("garbage\n" if i == 1 else ""))
    source = stream.read_requests(spark, str(folder), files_per_batch=1)
    query = stream.running_totals(source).writeStream.outputMode("complete").format("memory").queryName("totals").start()
    last = stream.last_requests(source, 2).writeStream.outputMode("update").format("memory").queryName("last").start()
    clean, away = str(tmp_path / "clean"), str(tmp_path / "away")
    split = source.writeStream.foreachBatch(stream.split_sink(clean, away)).start()
    for q in (query, last, split):
        q.processAllAvailable()
        q.stop()
    batch = {(r.origin, r.total, r.blocked, r.observed, r.clean, r.bytes_inspected) for r in ledger.totals(ledger.decide(requests(spark)), "origin").collect()}
    assert {tuple(r) for r in spark.table("totals").collect()} == batch
    assert spark.read.parquet(clean).count() == 3 and [r.request_id for r in spark.read.parquet(away).collect()] == [1]
    assert spark.table("last").where("origin = 'own'").groupBy().max("place").first()[0] == 2


def test_windows_bound_their_state(spark):
    source = spark.readStream.format("rate").load().selectExpr("value AS request_id", "timestamp AS ts", "'own' AS origin", "'http://a.org' AS url", "'POST' AS method", "'x' AS body")
    query = stream.windowed_totals(source).writeStream.outputMode("append").format("noop").start()
    time.sleep(2)
    query.stop()
    assert query.exception() is None
