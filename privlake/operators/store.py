"""A keyed store of sealed values: a log of puts, deletes and clears, the state after any version of it, and compaction."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_SEALED = "store string, key string, op string, sealed binary, version long"


def sealed(value: Column, secret: Column) -> Column:
    """A value under AES-GCM with an initial vector of its own, which stands before it: no two sealings are alike."""
    return F.aes_encrypt(value, secret, F.lit("GCM"))


def opened(value: Column, secret: Column) -> Column:
    """The text that was sealed; null if the secret is another or a byte has changed."""
    return F.try_aes_decrypt(value, secret, F.lit("GCM")).cast("string")


def live(changes: DataFrame, upto: int | None = None) -> DataFrame:
    """The state (store, key, sealed, version) that changes (store, key, op, sealed, version) leave, up to a version.

    op is put, delete or clear, which empties its store and has no key; others are ignored. Of each key the last change counts, if no later clear does. Changes of one version apply clears first, then deletes,
    then puts; of several puts of a key with one version the greatest sealed bytes stay. Rows without a store, version or (but for clears) key are ignored.

    Last changes are found by a maximum per key, aggregated before the shuffle, so that a key or store of any number of changes is no burden for a task.
    """
    rows = changes.where("store is not null and version is not null and op in ('put', 'delete', 'clear')")
    if upto is not None:
        rows = rows.where(F.col("version") <= upto)
    cleared = rows.where("op = 'clear'").groupBy("store").agg(F.max("version").alias("cleared"))
    last = rows.where("op <> 'clear' and key is not null").groupBy("store", "key").agg(F.max(F.struct("version", "op", "sealed")).alias("last"))  # "delete" < "put"
    kept = last.join(cleared, "store", "left").where("last.op = 'put' and (cleared is null or last.version >= cleared)")
    return kept.select("store", "key", "last.sealed", "last.version")


def read_all(state: DataFrame, secret: Column) -> DataFrame:
    """Keys with their values; rows that the secret doesn't open are left out."""
    return state.withColumn("value", opened(F.col("sealed"), secret)).where("value is not null").drop("sealed")


def store_counts(state: DataFrame, secret: Column) -> DataFrame:
    """Per store: keys, those that the secret opens, and those that it doesn't."""
    good = opened(F.col("sealed"), secret).isNotNull()
    return state.groupBy("store").agg(F.count("*").alias("keys"), F.count_if(good).alias("readable"), F.count_if(~good).alias("unreadable"))


@dataclass
class KeyedStore:
    """The log and its compacted states as tables under `path`, which driver and executors share.

    `log` holds changes as they were appended, `base` a state per compaction, in folders by version, and `commits` a row for each that was written whole. Readers take the last
    committed state and the changes after it, so an append or compaction that is lost half-way changes nothing that they see, and may be repeated. Values are sealed before they are written.
    """

    spark: SparkSession
    path: str

    def append(self, changes: DataFrame, secret: Column) -> None:
        """Adds changes (store, key, op, value, version), sealing values of puts. A null value can't be put: such rows are deletes."""
        op = F.when((F.col("op") == "put") & F.col("value").isNull(), "delete").otherwise(F.col("op"))
        value = F.when(F.col("op") == "put", sealed(F.col("value"), secret))
        changes.select("store", "key", op.alias("op"), value.alias("sealed"), F.col("version").cast("long").alias("version")).write.mode("append").parquet(f"{self.path}/log")

    def _table(self, name: str, schema: str) -> DataFrame:
        """A table of the store; without rows while it has none."""
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        if not folder.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()).exists(folder):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(f"{self.path}/{name}")

    def _committed(self, upto: int | None) -> int | None:
        done = self._table("commits", "upto long")
        return (done if upto is None else done.where(F.col("upto") <= upto)).agg(F.max("upto")).first()[0]

    def state(self, upto: int | None = None) -> DataFrame:
        """The live rows after version `upto`, or after all changes."""
        base, log = self._committed(upto), self._table("log", _SEALED)
        if base is None:
            return live(log, upto)
        kept = self._table("base", "store string, key string, sealed binary, version long, upto long").where(F.col("upto") == base)
        before = kept.select("store", "key", F.lit("put").alias("op"), "sealed", "version")
        return live(before.unionByName(log.where(F.col("version") > base)), upto)

    def compact(self) -> int | None:
        """Writes the state after all changes so far, for later reads to start from; gives its version. Changes that come late with an earlier version would be lost: versions must grow."""
        last = self._table("log", _SEALED).agg(F.max("version")).first()[0]
        if last is not None and last != self._committed(None):
            self.state(last).withColumn("upto", F.lit(last)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("upto").parquet(f"{self.path}/base")
            self.spark.range(1).select(F.lit(last).cast("long").alias("upto")).coalesce(1).write.mode("append").parquet(f"{self.path}/commits")
        return last
