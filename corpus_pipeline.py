"""From documents to packed training sequences: five stages, each by one operator of privlake.llm."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from privlake.llm.common import durable, scratch
from privlake.llm.decontaminate import decontaminate
from privlake.llm.langid import UNKNOWN, held_out, train_language_model
from privlake.llm.line_templates import drop_recurring_lines
from privlake.llm.ngram_join import ngram_components
from privlake.llm.packing import pack
from privlake.llm.queries import tokenizer_path

#: A document whose likeliest language is less probable than this is rejected.
LEAST_SCORE = 0.5


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents without letters, so null and empty texts too, and those whose language can't be told; learns from the documents themselves. Repeated rows stay or go together."""
    model = train_language_model(docs.where(~held_out("doc_id")))
    rows = docs.select(F.struct(*(docs[f"`{c}`"] for c in docs.columns)).alias("_row"), F.col("text").alias("_text"))
    return model.predict(rows, "_text").where((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= LEAST_SCORE)).select("_row.*")


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops lines whose template recurs in ten documents or more, and lines of 100 characters or more that stand verbatim in three different texts, but for the first of each; documents without any text left go.

    Null and blank texts lose no line and stay; n_chars follows the text.
    """
    row = docs.select("doc_id", "text", F.struct(*(docs[f"`{c}`"] for c in docs.columns if c != "text")).alias("_all"))
    out = drop_recurring_lines(row, columns=["_all"], keep_first=True, min_texts=3)
    out = out.where((F.col("n_dropped") == 0) | F.col("text").rlike(r"\S"))
    new = {"text": F.col("text"), "n_chars": F.when(F.col("n_dropped") > 0, F.length("text").cast(dict(docs.dtypes).get("n_chars", "long"))).otherwise(F.col("_all.n_chars")) if "n_chars" in docs.columns else None}
    return out.select(*((new[c] if c in new else F.col(f"_all.`{c}`")).alias(c) for c in docs.columns))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the smallest id of each class of documents linked by a Jaccard similarity of 0.8 or more over sets of 5 words.

    A document is an id and a text: rows that repeat both are one, different texts under one id are judged each by itself, and of those in one class the one with the
    smallest hash stays. Rows without an id stay.
    """
    rows, text = docs.select("doc_id", "text", F.struct(*(docs[f"`{c}`"] for c in docs.columns)).alias("_all")), F.xxhash64("text")
    known = rows.where("doc_id is not null")
    shared = known.groupBy("doc_id").agg(F.min(text).alias("low"), F.max(text).alias("high")).where("low <> high")
    name = F.col("doc_id")
    if shared.take(1):
        # names in the order of ids, then of hashes
        digits = lambda x: F.lpad((x.cast("decimal(20,0)") + F.lit(str(1 << 63)).cast("decimal(20,0)")).cast("decimal(20,0)").cast("string"), 20, "0")
        name = F.concat(name if dict(docs.dtypes)["doc_id"] == "string" else digits(name), F.lit("\0"), digits(text))
    known = known.withColumn("_name", name)
    kept = ngram_components(known, id_col="_name").where(F.col("component_id") == F.col("_name")).select("_name").distinct()
    once = known.join(kept, "_name", "left_semi").dropDuplicates(["_name"]).select("_all")
    return once.unionByName(rows.where("doc_id is null").select("_all")).select("_all.*")


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents a twentieth of whose words or more lie in benchmark windows; those without words, so null texts too, stay."""
    found = decontaminate(docs.select("doc_id", "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet")).where("contaminated")
    bad = found.select(F.col("doc_id").alias("_id"), "_key").distinct()
    return docs.join(bad, docs["doc_id"].eqNullSafe(bad["_id"]) & (F.xxhash64(docs["text"]) == bad["_key"]), "left_anti")


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of at most 2048 ids; a null text counts as empty, repeated rows are packed each."""
    return pack(docs.select("doc_id", "text"), tokenizer_path("word_bpe_49k.json"), with_ids=False)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("ngram_jaccard_join", near_duplicates),
    ("benchmark_decontamination", benchmark_decontamination),
    ("packing", packing),
]

#: Language ID and packing can't be expressed in SQL. The tests hold the near-duplicate and decontamination stages against brute force, stage by stage, and packing against the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies all stages to documents; each stage's rows are written to the shared folder and read by the next. What a stage wrote for itself goes once its rows are written."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        with scratch(spark):
            docs = durable(stage(spark, docs, sf_dir), outlive=True)
    return STAGES[-1][1](spark, docs, sf_dir)
