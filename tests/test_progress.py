"""Progress rows add up to a stream's input, after a restart too."""

import time

from pyspark.sql import functions as F

from privlake.streaming import progress as p

SF = "/root/testdata/sf0.001"


def wait(condition, seconds=90):
    until = time.monotonic() + seconds
    while not condition() and time.monotonic() < until:
        time.sleep(0.3)
    assert condition()


def test_progress_adds_up_after_a_restart(spark, tmp_path):
    source, table, state = (str(tmp_path / x) for x in ("in", "progress", "state"))
    turns = spark.read.parquet(f"{SF}/conversations.parquet").repartition(5).cache()
    turns.write.parquet(source)
    listener, heard = p.ProgressListener(), []
    stop = listener.subscribe(heard.append)
    listener.subscribe(lambda row: 1 / 0)
    listener.subscribe(p.keep_progress(spark, f"file://{table}"))
    spark.streams.addListener(listener)
    ended = lambda n: sum(r["event"] == "terminated" for r in heard) == n
    try:
        for n, more in ((1, False), (2, True), (3, False)):
            if more:
                turns.limit(20).coalesce(1).write.mode("append").parquet(source)
            stream = spark.readStream.schema(turns.schema).option("maxFilesPerTrigger", 2).parquet(source).groupBy("role").count()
            stream.writeStream.queryName("roles").outputMode("complete").format("noop").option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination(120)
            wait(lambda n=n: ended(n))
        rows = lambda: spark.read.schema(p.SCHEMA).parquet(table)
        wait(lambda: rows().where("event = 'terminated'").count() == 3)
        (total,) = p.totals(rows()).collect()
        assert (total["name"], total.runs, total.input_rows) == ("roles", 3, turns.count() + 20) and total.batches >= 4
        ran = p.batches(rows())
        assert ran.select("query", "batch_id").distinct().count() == ran.count() and ran.agg(F.max("state_rows")).first()[0] == turns.select("role").distinct().count()
        assert sum(r["input_rows"] or 0 for r in heard) == total.input_rows and {r["event"] for r in heard} >= {"started", "progress", "terminated"}
        stop()
        before = len(heard)
        spark.readStream.format("rate-micro-batch").option("rowsPerBatch", 3).load().writeStream.format("noop").trigger(once=True).start().awaitTermination(60)
        wait(lambda: rows().where("event = 'terminated'").count() == 4)
        assert len(heard) == before
    finally:
        spark.streams.removeListener(listener)
    # a batch that was told twice counts once
    again = rows().union(rows().where("event = 'progress'").withColumn("at", F.lit("9")))
    assert {r.input_rows for r in p.totals(again).where("name = 'roles'").collect()} == {total.input_rows}


def test_failures_are_told(spark):
    listener, heard = p.ProgressListener(), []
    listener.subscribe(heard.append)
    spark.streams.addListener(listener)
    try:
        bad = spark.readStream.format("rate-micro-batch").option("rowsPerBatch", 3).load().select(F.raise_error(F.lit("it broke")).alias("x"))
        query = bad.writeStream.format("noop").trigger(once=True).start()
        try:
            query.awaitTermination(60)
        except Exception:
            pass
        wait(lambda: any(r["event"] == "terminated" for r in heard))
        assert "it broke" in next(r["error"] for r in heard if r["event"] == "terminated")
    finally:
        spark.streams.removeListener(listener)
