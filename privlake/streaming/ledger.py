"""The ledger of outbound requests as a stream."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from privlake.operators import ledger

REQUEST_SCHEMA = "request_id long, ts timestamp, origin string, url string, method string, body string"


def read_requests(spark: SparkSession, folder: str, files_per_batch: int = 50) -> DataFrame:
    """Requests from JSON lines that arrive in a folder. A line that isn't valid has null columns and is left out."""
    return spark.readStream.schema(REQUEST_SCHEMA).option("maxFilesPerTrigger", files_per_batch).json(folder).where("request_id is not null")


def running_totals(requests: DataFrame) -> DataFrame:
    """Totals per origin over everything so far; state is one row per origin."""
    decided = ledger.decide(requests)
    is_ = lambda d: F.col("decision") == d
    return decided.groupBy("origin").agg(F.count("*").alias("total"), F.count_if(is_("blocked")).alias("blocked"), F.count_if(is_("observed")).alias("observed"), F.count_if(is_("allowed")).alias("clean"), F.sum("bytes").alias("bytes_inspected"))


def windowed_totals(requests: DataFrame, window: str = "10 minutes", late: str = "1 hour") -> DataFrame:
    """Totals per decision and event-time window, with a watermark that bounds the state: an extension, since requests have times."""
    decided = ledger.decide(requests.withWatermark("ts", late))
    return decided.groupBy(F.window("ts", window), "decision").agg(F.count("*").alias("total"), F.sum("bytes").alias("bytes")).select(F.col("window.start").alias("start"), "decision", "total", "bytes")


def _keep_last(n: int) -> Callable:
    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = list(zip(*state.get, strict=True)) if state.exists else []
        for pdf in batches:
            held += list(zip(pdf["ts"].astype("int64"), pdf["request_id"], pdf["decision"], strict=True))
            held = sorted(set(held))[-n:]
        state.update(tuple(map(list, zip(*held, strict=True))))
        yield pd.DataFrame({"origin": key[0], "request_id": [h[1] for h in held][::-1], "decision": [h[2] for h in held][::-1], "place": range(1, len(held) + 1)})

    return step


def last_requests(requests: DataFrame, n: int = 100) -> DataFrame:
    """The last n requests of each origin, newest first, sent anew whenever an origin has new ones; state holds n rows per origin."""
    decided = ledger.decide(requests).select("origin", "ts", "request_id", "decision")
    return decided.groupBy("origin").applyInPandasWithState(_keep_last(n), "origin string, request_id long, decision string, place int", "ts array<long>, ids array<long>, decisions array<string>", "update", GroupStateTimeout.NoTimeout)


def split_sink(clean: str, quarantine: str) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: blocked requests to one folder, others to another. A batch that is written again after a failure replaces its own rows."""

    def write(batch: DataFrame, batch_id: int) -> None:
        decided = ledger.decide(batch).persist()
        decided.where("decision <> 'blocked'").write.mode("overwrite").parquet(f"{clean}/batch={batch_id}")
        decided.where("decision = 'blocked'").write.mode("overwrite").parquet(f"{quarantine}/batch={batch_id}")
        decided.unpersist()

    return write
