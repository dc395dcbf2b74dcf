"""Language ID: sparse multinomial logistic regression on TF-IDF character n-grams, trained by FTRL, calibrated by a temperature."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import carried, durable, small, spread

#: Lengths of the character n-grams and the number of hashed features, as a power of two.
ORDERS = (1, 2, 3)
POWER = 16
UNKNOWN = "und"
_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], dtype=np.uint64)


@dataclass(frozen=True)
class Settings:
    """max_rows bounds the labelled rows that the classifier is fitted on, about; all training documents count for the inverse document frequencies and the set of languages.

    Of a language with fewer in that sample, about min_rows are taken, or all that there are.
    """

    max_rows: int = 8000
    min_rows: int = 50
    shards: int = 4
    epochs: int = 3
    alpha: float = 1.0
    beta: float = 1.0
    l1: float = 1e-3
    l2: float = 1e-3
    seed: int = 7


def _grams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Hashed features of a whole text and how often each occurs."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "replace"), dtype="<u4").astype(np.uint64)
    parts = []
    for n in ORDERS:
        if len(codes) >= n:
            h = np.full(len(codes) - n + 1, n, dtype=np.uint64)
            for k in range(n):
                h = (h + codes[k : len(codes) - n + 1 + k]) * _MIX[k]
                h ^= h >> np.uint64(29)
            parts.append((h * _MIX[0] >> np.uint64(64 - POWER)).astype(np.int64))
    counts = np.bincount(np.concatenate(parts), minlength=1 << POWER) if parts else np.zeros(1 << POWER, np.int64)
    found = np.flatnonzero(counts)
    return found, counts[found]


def _weighed(text: str, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    found, counts = _grams(text)
    x = (1 + np.log(counts)) * idf[found]
    return found, x / max(np.sqrt(x @ x), 1e-12)


def _document_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (feature, documents) of a task; feature -1 counts all documents."""
    total, docs = np.zeros(1 << POWER, np.int64), 0
    for batch in batches:
        for text in batch.column(0).to_pylist():
            total[_grams(text)[0]] += 1
            docs += 1
    found = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(np.append(found, -1)), pa.array(np.append(total[found], docs))], ["feature", "docs"])


def _train(idf: np.ndarray, classes: list[str], s: Settings):
    """One shard's model by follow-the-regularised-leader with L1 and L2 penalties; feature 2**POWER is the bias."""

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        size, k = (1 << POWER) + 1, len(classes)
        z, g2 = np.zeros((k, size)), np.zeros((k, size))
        order = np.argsort(table["_order"].to_numpy(), kind="stable")
        texts, langs = table["_text"].to_pylist(), [classes.index(x) for x in table["_lang"].to_pylist()]

        def weights(at):
            shrunk = np.sign(z[:, at]) * np.maximum(np.abs(z[:, at]) - s.l1, 0)
            return -shrunk / ((s.beta + np.sqrt(g2[:, at])) / s.alpha + s.l2)

        rows = [_weighed(texts[i], idf) for i in order]
        for _ in range(s.epochs):
            for i, (at, x) in zip(order, rows, strict=True):
                at, x = np.append(at, size - 1), np.append(x, 1.0)
                w = weights(at)
                logit = w @ x
                p = np.exp(logit - logit.max())
                p /= p.sum()
                p[langs[i]] -= 1
                g = p[:, None] * x[None, :]
                step = (np.sqrt(g2[:, at] + g * g) - np.sqrt(g2[:, at])) / s.alpha
                z[:, at] += g - step * w
                g2[:, at] += g * g
        w = weights(np.arange(size))
        c, f = np.nonzero(w)
        return pa.table({"c": pa.array(c.astype(np.int64)), "f": pa.array(f.astype(np.int64)), "w": pa.array(w[c, f])})

    return run


@dataclass(frozen=True)
class LanguageModel:
    classes: tuple[str, ...]
    idf: np.ndarray
    weights: np.ndarray
    temperature: float = 1.0

    def logits(self, text: str) -> np.ndarray:
        at, x = _weighed(text, self.idf)
        return self.weights[:, at] @ x + self.weights[:, -1]

    def predict(self, docs: DataFrame, text_col: str = "text") -> DataFrame:
        """`docs` with lang_pred and score appended: the likeliest language and its calibrated probability.

        A text that is null, empty or has no letters is `und` with score 0, as is every text if nothing could be learned. Input columns named
        lang_pred or score, in any case, give way to the new ones; all others stay, whatever their names.
        """
        spark = docs.sparkSession
        model = spark.sparkContext.broadcast((self.classes, self.idf.astype(np.float32), self.weights.astype(np.float32), self.temperature))

        @F.pandas_udf("struct<lang_pred: string, score: double>")
        def predicted(texts):
            import pandas as pd

            m = LanguageModel(*model.value)
            out = []
            for text in texts:
                if text is None or not m.classes:
                    out.append((UNKNOWN, 0.0))
                    continue
                logit = m.logits(text) / m.temperature
                p = np.exp(logit - logit.max())
                out.append((m.classes[int(np.argmax(p))], float(p.max() / p.sum())))
            return pd.DataFrame(out, columns=["lang_pred", "score"])

        letters = F.when(F.col("_text").rlike(r"\p{L}"), F.col("_text"))
        return carried(docs, text_col).select("_row", predicted(letters).alias("_p")).select(*spread(docs, "lang_pred", "score"), "_p.lang_pred", "_p.score")


def held_out(id_col: str, mod: int = 5, rest: int = 0):
    """crc32 of the id as text leaves `rest`; a null id counts as held out."""
    return F.coalesce(F.crc32(F.encode(F.col(id_col).cast("string"), "UTF-8")) % mod == rest, F.lit(True))


def train_language_model(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", order_col: str = "doc_id", settings: Settings = Settings()) -> LanguageModel:
    """A model of the languages in `lang_col`. Rows with a null language, or whose text is null or has no letters, are not learned from.

    Inverse document frequencies and the languages come from all rows. The classifier is fitted on about settings.max_rows of them, chosen and ordered by
    a hash of `order_col` (which is no feature): with about settings.min_rows of each language at least, or all of a language that has fewer, and one at least that is fitted on: each of a fixed number of shards trains by itself and the weights are averaged. A fifth of the chosen
    rows only sets the temperature. An empty table gives a model without classes.
    """
    s = settings
    known = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).rlike(r"\p{L}")).select(F.col(text_col).alias("_text"), F.col(lang_col).alias("_lang"), F.xxhash64(F.col(order_col).cast("string"), F.lit(s.seed)).alias("_order"))
    counts = known.select("_text").mapInArrow(_document_counts, "feature long, docs long").groupBy("feature").agg(F.sum("docs").alias("docs")).toArrow()
    features, number = counts["feature"].to_numpy(), counts["docs"].to_numpy()
    total = int(number[features == -1].sum())
    if not total:
        return LanguageModel((), np.zeros(1 << POWER), np.zeros((0, (1 << POWER) + 1)))
    idf = np.full(1 << POWER, np.log(1 + total) + 1)
    idf[features[features >= 0]] = np.log((1 + total) / (1 + number[features >= 0])) + 1

    part = F.pmod(F.expr(f"_order div {max(1, total)}"), F.lit(5 * s.shards))
    known = known.withColumn("_part", part)
    # of each language the row that is chosen and fitted on in any case
    langs = durable(known.groupBy("_lang").agg(F.count("*").alias("_n"), F.min(F.struct(F.col("_part") < s.shards, "_order")).alias("_first")).select("_lang", F.greatest(F.lit(s.max_rows), F.ceil(s.min_rows * total / F.col("_n"))).alias("_below"), F.col("_first._order").alias("_first")))
    known = known.join(small(langs), "_lang").where((F.pmod(F.col("_order"), F.lit(total)) < F.col("_below")) | (F.col("_order") == F.col("_first")))
    lone = F.when((F.col("_order") == F.col("_first")) & (F.col("_part") < s.shards), s.shards + F.col("_part")).otherwise(F.col("_part"))
    chosen = durable(known.select("_text", "_lang", "_order", lone.alias("_part")))
    fit, check = chosen.where(F.col("_part") >= s.shards), chosen.where(F.col("_part") < s.shards)
    classes = sorted(r[0] for r in fit.select("_lang").distinct().collect())
    if not classes:
        fit, classes = chosen, sorted(r[0] for r in chosen.select("_lang").distinct().collect())
    shards = fit.withColumn("_shard", F.pmod("_part", F.lit(s.shards)))
    number = shards.select("_shard").distinct().count()
    table = shards.groupBy("_shard").applyInArrow(_train(idf, classes, s), "c long, f long, w double").groupBy("c", "f").agg((F.sum("w") / number).alias("w")).toArrow()
    weights = np.zeros((len(classes), (1 << POWER) + 1))
    weights[table["c"].to_numpy(), table["f"].to_numpy()] = table["w"].to_numpy()
    model = LanguageModel(tuple(classes), idf, weights)
    shared = docs.sparkSession.sparkContext.broadcast((model.classes, idf, weights))

    @F.pandas_udf("array<double>")
    def logits(texts):
        m = LanguageModel(*shared.value)
        return texts.map(lambda t: m.logits(t).tolist())

    rows = check.where(F.col("_lang").isin(classes)).select(logits("_text").alias("x"), "_lang").collect()
    if not rows:
        return model
    x, y = np.array([r[0] for r in rows]), np.array([classes.index(r[1]) for r in rows])

    def loss(t: float) -> float:
        a = x / t
        a = a - a.max(axis=1, keepdims=True)
        return float(np.mean(np.log(np.exp(a).sum(axis=1)) - a[np.arange(len(y)), y]))

    return LanguageModel(model.classes, idf, weights, float(min(np.geomspace(0.05, 20, 121), key=loss)))
