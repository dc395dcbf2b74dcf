"""What several operators of this subpackage share: tables in the shared folder, fixed-size filters and connected components."""

from __future__ import annotations

import atexit
import contextlib
import contextvars
import functools
import shutil
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

#: A side is broadcast by hand only if its rows were counted and are at most this many.
BROADCAST_ROWS = 20_000
#: Edges that one task may join up by itself, if they were counted and are at most this many: a few MB. More go through rounds of shuffles.
LOCAL_EDGES = 200_000


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; a temporary one, removed at exit, only where that is unset and all runs in one process, as in tests."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return named or _own_folder()


@functools.cache
def _own_folder() -> str:
    folder = tempfile.mkdtemp(prefix="privlake-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    return "file://" + folder


#: Makes Spark delete the shuffle files of a query that has ended.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Folders that durable() wrote, in the innermost scratch() block of this thread; those outside of any go at the end of the process.
_tables: contextvars.ContextVar[list[str]] = contextvars.ContextVar("tables")
_until_exit: list[str] = []


def _delete(spark: SparkSession, folders: list[str]) -> None:
    while folders:
        path = spark._jvm.org.apache.hadoop.fs.Path(folders.pop())
        path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


@functools.cache
def _at_exit(spark: SparkSession) -> None:
    def clear():
        with contextlib.suppress(Exception):  # a JVM that has gone can't be asked any more
            _delete(spark, _until_exit)

    atexit.register(clear)


def release(spark: SparkSession) -> None:
    """Deletes the tables that operators wrote outside of scratch() blocks: what they returned can't be computed after that."""
    _delete(spark, _until_exit)


@contextlib.contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables that durable() writes in the block are deleted when it ends, however it ends; what operators return must be used or written inside. Blocks nest, and each thread has its own."""
    folders: list[str] = []
    token = _tables.set(folders)
    try:
        yield
    finally:
        _tables.reset(token)
        _delete(spark, folders)


def durable(df: DataFrame, outlive: bool = False) -> DataFrame:
    """`df` written to the shared folder and read again: what follows depends on no executor's memory or disk, and computes `df` once.

    The shuffle files of the write go once it has ended. The table goes with the scratch() block around the call, or at the end of the process; with `outlive`, with the latter.
    """
    spark = df.sparkSession
    path, before = f"{shared_folder(spark)}/privlake-{uuid.uuid4().hex}", spark.conf.get(_CLEANUP)
    _at_exit(spark)
    (_until_exit if outlive else _tables.get(_until_exit)).append(path)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """`df`, to be broadcast if its counted rows are few; else the join shuffles both sides. `df` should be durable: it is read twice."""
    return F.broadcast(df) if df.count() <= rows else df


def carried(docs: DataFrame, text_col: str) -> DataFrame:
    """Rows (_row, _text): all columns of `docs` as one struct, so that none can clash with an operator's own."""
    return docs.select(F.struct(*(docs[f"`{c}`"] for c in docs.columns)).alias("_row"), F.col(text_col).alias("_text"))


def arrow_type(docs: DataFrame, column: str) -> pa.DataType:
    """The Arrow type in which tasks see a column, of whatever kind."""
    return to_arrow_type(docs.select(column).schema[0].dataType)


def spread(docs: DataFrame, *new: str) -> list[Column]:
    """The columns that carried() put into _row, but for those whose names, in any case, are among `new`."""
    return [F.col(f"_row.`{c}`") for c in docs.columns if c.lower() not in new]


def filter_power(rows: int) -> int:
    """The size of a filter of so many hashes, as a power of two: eight bits for each, from 128 KB up to 32 MB."""
    return min(28, max(20, (8 * rows).bit_length()))


def bitmap(hashes: DataFrame, column: str, power: int) -> bytes:
    """2**power bits, of which those that the top `power` bits of the hashes in `column` name are set.

    Its size depends on `power` alone, so it may be broadcast whatever the table's size: a filter that lets a few others pass, and
    all that are in it. Built by partial aggregation; at most 2**power / 32768 rows of 4 KB come to the driver.
    """
    at = F.shiftrightunsigned(F.col(column), 64 - power) + 1  # from 1, as these functions count
    parts = hashes.select(F.bitmap_bucket_number(at).alias("b"), F.bitmap_bit_position(at).alias("p")).groupBy("b").agg(F.bitmap_construct_agg("p").alias("bits"))
    out = np.zeros(1 << max(power - 3, 12), dtype=np.uint8)
    for b, bits in parts.collect():
        out[(b - 1) * 4096 : b * 4096] = np.frombuffer(bytes(bits), dtype=np.uint8)
    return out.tobytes()


def _union_find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    parent: dict = {}

    def top(x):
        while parent.setdefault(x, x) != x:
            parent[x] = x = parent[parent[x]]
        return x

    kind = None
    for batch in batches:
        kind = batch.column(0).type
        for u, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            u, v = top(u), top(v)
            if u != v:
                parent[max(u, v)] = min(u, v)
    if kind is not None:
        nodes = list(parent)
        yield pa.RecordBatch.from_arrays([pa.array(nodes, kind), pa.array([top(x) for x in nodes], kind)], ["node", "root"])


def components(edges: DataFrame, rounds: int = 40, local_edges: int = LOCAL_EDGES) -> DataFrame:
    """Connected components of undirected edges (a, b): one row (node, root) per node, root being its component's smallest node.

    Up to `local_edges` distinct edges, which are counted first, are joined up in one task. Otherwise: large-star and small-star steps in turn. In each, a node's neighbours are tied to the smallest of them by a minimum per key, which
    is aggregated before the shuffle, and a join on that key, so a hub of any degree never becomes one array. Each round is cut off by a
    written table. Nulls are not allowed in edges; self-loops keep a lone node.
    """
    edges = durable(edges.select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).distinct())
    if edges.count() <= local_edges:
        kind = dict(edges.dtypes)["u"]
        return edges.coalesce(1).mapInArrow(_union_find, f"node {kind}, root {kind}")
    nodes = edges.select(F.col("u").alias("node")).union(edges.select(F.col("v").alias("node"))).distinct()
    edges = edges.where("u < v")
    for _ in range(rounds):
        both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("m").alias("u"), "v").where("u <> v").distinct()
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        low = down.groupBy("u").agg(F.min("v").alias("m"))
        nxt = down.join(low, "u").select(F.col("m").alias("p"), "v").where("p <> v").union(low.select("m", "u")).select(F.least("p", "v").alias("u"), F.greatest("p", "v").alias("v")).distinct()
        nxt = durable(nxt)
        same = nxt.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).collect()
        before = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).collect()
        edges = nxt
        if same == before:
            break
    else:
        raise RuntimeError(f"no fixed point within {rounds} rounds")
    return nodes.join(edges.select(F.col("v").alias("node"), F.col("u").alias("root")), "node", "left").select("node", F.coalesce("root", "node").alias("root"))
