"""Toxicity: gradient-boosted trees over dense features, calibrated by isotonic regression."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression, IsotonicRegressionModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import carried, durable, small, spread

FEATURES = ("any_word", "word_density", "word_count", "top_weight", "stem_density", "stem_count", "near_second_person", "second_person", "capitals", "capital_words", "punctuation", "exclamations", "obfuscated", "obfuscated_hits", "repeated_letters", "log_words")
_WORD = re.compile(r"[^\W_][^\s]*")
#: Signs that stand for letters within a word.
_LEET = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i", "*": ""})
_INNER = re.compile(r"[^\W\d_][0-9@$!*]+[^\W\d_]")
_REPEATED = re.compile(r"([^\W\d_])\1\1")
_ENDS = ".,;:!?\"')]}"
#: Second-person pronouns of the four languages that documents are written in.
SECOND_PERSON = frozenset("you your yours yourself u ur tu te toi ton ta tes vous votre vos du dich dir dein deine deinen ihr euch euer sie ihnen tú ti tuyo usted ustedes vosotros vuestro".split())
#: Different tokens whose measures a task remembers, and characters of text that it measures at once; neither changes a result.
_REMEMBERED = 200_000
_STEP = 1 << 21


@dataclass(frozen=True)
class Settings:
    """max_rows bounds the labelled rows, about: all that is learned, lexicon, trees and calibration, comes from a sample of that size by a hash of the id."""

    max_rows: int = 20_000
    words: int = 400
    stems: int = 200
    stem: int = 4
    least: int = 3
    near: int = 5
    trees: int = 20
    depth: int = 4
    seed: int = 11


def _words(text: str) -> list[str]:
    return [w.rstrip(_ENDS) for w in _WORD.findall(unicodedata.normalize("NFKC", text).lower())]


def _plain(word: str) -> str:
    """The word with the letters that its signs stand for, and no letter more than twice in a row."""
    return _REPEATED.sub(r"\1", word.translate(_LEET)) if _INNER.search(word) or _REPEATED.search(word) else word


def _terms(stem: int):
    """Rows (term, half, toxic, docs): in how many documents of a task's step each word, and each longer word's stem, occurs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts: dict[tuple[str, int, int], int] = {}
            for text, half, toxic in zip(*(batch.column(c).to_pylist() for c in ("_text", "_half", "_toxic")), strict=True):
                own = {_plain(w) for token in set((text or "").split()) for w in _words(token)}
                for term in own | {f"{w[:stem]}~" for w in own if len(w) > stem}:
                    counts[term, half, toxic] = counts.get((term, half, toxic), 0) + 1
            yield pa.RecordBatch.from_pydict({"term": [t for t, _, _ in counts], "half": pa.array([h for _, h, _ in counts], pa.int32()), "toxic": pa.array([x for _, _, x in counts], pa.int32()), "docs": pa.array(list(counts.values()), pa.int64())})

    return run


def _token(token: str, lexicon: dict[str, float], s: Settings) -> tuple[float, ...]:
    """What one token (text between spaces) adds: words, hit, weight, stem, second person, disguised, hidden, repeated, letters, capitals, capital word, marks, exclamations."""
    core = token.rstrip(_ENDS)
    plain = core.isalpha()
    words = [core.lower()] if plain and core.isascii() else _words(token)
    weight, stems, disguised, hidden = 0.0, 0, 0, 0
    for w in words:
        p = _plain(w)
        own = lexicon.get(p, 0.0)
        by_stem = lexicon.get(p[: s.stem] + "~", 0.0) if len(p) > s.stem else 0.0
        if own or by_stem:
            weight, stems, hidden = max(weight, own, by_stem), stems + (by_stem > 0), hidden + (p != w)
        disguised += p != w
    many = len(token)
    letters, marks = (len(core), many - len(core)) if plain else (sum(map(str.isalpha, token)), many - sum(map(str.isalnum, token)))
    capitals = 0 if token.islower() else sum(map(str.isupper, token))
    return (len(words), weight > 0, weight, stems, any(w in SECOND_PERSON for w in words), disguised, hidden, len(_REPEATED.findall(token)) if disguised else 0, letters, capitals, capitals > 0 and many > 1 and token.isupper(), marks, token.count("!") if marks else 0)


class _Tokens(dict):
    """Tokens by number; the measures of each are taken when it is first met."""

    def __init__(self, lexicon: dict[str, float], s: Settings):
        self.lexicon, self.s, self.rows = lexicon, s, []

    def __missing__(self, token: str) -> int:
        self[token] = at = len(self)
        self.rows.append(_token(token, self.lexicon, self.s))
        return at


class _Measures:
    """Features of texts, each different token being measured once."""

    def __init__(self, lexicon: dict[str, float], s: Settings):
        self.lexicon, self.s = lexicon, s
        self._forget()

    def _forget(self) -> None:
        self.ids, self.known = _Tokens(self.lexicon, self.s), np.zeros((0, 13))

    def _table(self, tokens: list[str]) -> tuple[np.ndarray, np.ndarray]:
        if len(self.ids) > _REMEMBERED:
            self._forget()
        at = np.fromiter(map(self.ids.__getitem__, tokens), np.int64, len(tokens))
        if self.ids.rows:
            self.known = np.concatenate([self.known, np.array(self.ids.rows, dtype=np.float64)])
            self.ids.rows = []
        return self.known, at

    def __call__(self, texts: list[str]) -> np.ndarray:
        split = [t.split() for t in texts]
        sizes = np.array([len(x) for x in split])
        out = np.zeros((len(texts), len(FEATURES)))
        full, starts = np.flatnonzero(sizes), np.concatenate([[0], np.cumsum(sizes)])
        if not len(full):
            return out
        table, at = self._table([t for x in split for t in x])
        words, hits, _, stems, people, disguised, hidden, repeated, letters, capitals, shouted, marks, calls = (np.add.reduceat(column[at], starts[full]) for column in table.T)
        top = np.maximum.reduceat(table[at, 2], starts[full])
        n, size, raw = np.maximum(words, 1), np.array([max(1, len(texts[d])) for d in full]), sizes[full]
        # hits with a second person at most `near` tokens away in the same text: texts are set apart by more than that
        of = np.repeat(np.arange(len(texts)), sizes)
        spread = np.arange(len(at)) + of * (self.s.near + 1)
        hit, person = np.flatnonzero(table[at, 1]), spread[np.flatnonzero(table[at, 4])]
        person = np.concatenate([[-(1 << 60)], person, [1 << 60]])
        right = np.searchsorted(person, spread[hit])
        close = np.minimum(person[right] - spread[hit], spread[hit] - person[right - 1]) <= self.s.near
        near = np.bincount(of[hit[close]], minlength=len(texts))[full]
        out[full] = np.stack([hits > 0, hits / n, np.minimum(hits, 50), top, stems / n, np.minimum(stems, 50), near / n, people / n, capitals / np.maximum(letters, 1), shouted / raw, marks / size, calls / size, disguised / n, np.minimum(hidden, 50), repeated / n, np.log1p(words)], axis=1)
        return out


def _feature_lists(texts: list[str | None], measure: _Measures) -> list[np.ndarray]:
    out: list[np.ndarray] = []
    first, size = 0, 0
    for k, text in enumerate(texts):
        size += len(text or "") + 1
        if size >= _STEP or k == len(texts) - 1:
            out.extend(measure([t or "" for t in texts[first : k + 1]]))
            first, size = k + 1, 0
    return out


@dataclass(frozen=True)
class ToxicityModel:
    lexicon: dict[str, float]
    trees: GBTClassificationModel | None
    calibration: IsotonicRegressionModel | None
    prior: float
    settings: Settings

    def featurise(self, docs: DataFrame, text_col: str) -> DataFrame:
        lexicon, s = docs.sparkSession.sparkContext.broadcast(self.lexicon), self.settings

        @F.pandas_udf("array<double>")
        def features(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
            measure = _Measures(lexicon.value, s)
            for texts in parts:
                yield pd.Series(_feature_lists(texts.tolist(), measure))

        return docs.withColumn("_features", array_to_vector(features(F.col(text_col))))

    def predict(self, docs: DataFrame, text_col: str = "text", threshold: float = 0.3) -> DataFrame:
        """`docs` with score (0 to 1, calibrated, ties of the calibration broken by the raw score) and predicted appended. Null text scores as empty text.

        Input columns named score or predicted, in any case, give way to the new ones; all others stay, whatever their names.
        """
        rows = carried(docs, text_col)
        if self.trees is None:
            out = rows.withColumn("score", F.lit(self.prior))
        else:
            out = self.calibration.transform(_raw(self.trees, self.featurise(rows, "_text")))
            out = out.withColumn("score", F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("_calibrated") * 0.999 + F.col("_raw") * 0.001)))
        return out.select(*spread(docs, "score", "predicted"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def _raw(trees: GBTClassificationModel, featured: DataFrame) -> DataFrame:
    return trees.transform(featured).withColumn("_raw", vector_to_array("_probability")[1]).drop("_probability", "_margin", "_class")


def _sample(docs: DataFrame, labels: DataFrame, text_col: str, label_col: str, id_col: str, s: Settings) -> DataFrame:
    """Different rows (_text, _toxic, _order) of about s.max_rows ids; the ids are chosen before any text is read, so no other text moves."""
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("_id")).agg(F.max(label_col).cast("int").alias("_toxic"))
    known = known.withColumn("_order", F.xxhash64(F.col("_id").cast("string"), F.lit(s.seed)))
    total = known.count()
    ids = durable(known.where(F.pmod("_order", F.lit(max(1, total))) < s.max_rows))
    rows = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text")).join(small(ids, 2 * s.max_rows), "_id")
    # an id may have many rows: repeated ones count once, and different ones are thinned by a hash of both
    rows = durable(rows.groupBy("_id", "_text").agg(F.first("_toxic").alias("_toxic"), F.first("_order").alias("_order")))
    many = rows.count()
    if many > 2 * s.max_rows:
        rows = rows.where(F.pmod(F.xxhash64("_id", "_text", F.lit(s.seed)), F.lit(many)) < s.max_rows)
    return rows.select("_text", "_toxic", F.xxhash64("_order", "_text").alias("_order"))


def train_toxicity_model(docs: DataFrame, labels: DataFrame, text_col: str = "text", label_col: str = "toxic", id_col: str = "doc_id", settings: Settings = Settings()) -> ToxicityModel:
    """A model of `label_col` (0 or 1) in `labels` for the texts of `docs`, which share `id_col`; null labels and ids are left out, and of several labels of one id the highest counts.

    Everything is learned from about settings.max_rows labelled rows, chosen by a hash of `id_col` (no feature). The lexicon holds the words, and the stems of
    words, that occur far more often in toxic than in other documents among them; trees and calibration see features by a lexicon of the other half of
    the sample. Trees are fitted on four fifths; the others fit the calibration. Null text counts as empty, repeated rows count once. Without rows of both labels, every score is their mean, 0 without any.
    """
    s = settings
    rows = durable(_sample(docs, labels, text_col, label_col, id_col, s).withColumn("_half", (F.pmod("_order", F.lit(10)) < 5).cast("int")))
    sizes = {(h, x): n for h, x, n in rows.groupBy("_half", "_toxic").count().collect()}
    total, toxic = sum(sizes.values()), sum(n for (_, x), n in sizes.items() if x)
    if not toxic or toxic == total:
        return ToxicityModel({}, None, None, float(toxic / total) if total else 0.0, s)
    terms = durable(rows.select("_text", "_half", "_toxic").mapInArrow(_terms(s.stem), "term string, half int, toxic int, docs long").groupBy("term", "half").agg(F.sum(F.col("docs") * F.col("toxic")).alias("t"), F.sum(F.col("docs") * (1 - F.col("toxic"))).alias("c")))

    def model(*halves: int) -> ToxicityModel:
        """Its lexicon comes from these halves."""
        bad, good = (max(1, sum(sizes.get((h, x), 0) for h in halves)) for x in (1, 0))
        found = terms.where(F.col("half").isin(*halves)).groupBy("term").agg(F.sum("t").alias("t"), F.sum("c").alias("c")).where(F.col("t") >= s.least)
        found = found.withColumn("odds", F.log((F.col("t") + 0.5) / bad) - F.log((F.col("c") + 0.5) / good)).where("odds > 1.5").withColumn("worth", F.col("odds") * F.log1p("t"))
        stem = F.col("term").endswith("~")
        best = found.where(~stem).orderBy(F.desc("worth"), "term").limit(s.words).union(found.where(stem).orderBy(F.desc("worth"), "term").limit(s.stems))
        return ToxicityModel({r["term"]: r["odds"] for r in best.collect()}, None, None, float(toxic / total), s)

    # a row's features must not come from a lexicon that its own label went into
    featured = durable(model(0).featurise(rows.where("_half = 1"), "_text").unionByName(model(1).featurise(rows.where("_half = 0"), "_text")).drop("_text"))
    check = F.pmod("_order", F.lit(5)) == 0
    fit = featured.where(~check).coalesce(4).cache()  # bounded by max_rows
    if fit.select("_toxic").distinct().count() < 2:
        fit = featured
    trees = GBTClassifier(featuresCol="_features", labelCol="_toxic", maxIter=s.trees, maxDepth=s.depth, maxBins=64, seed=s.seed, predictionCol="_class").setProbabilityCol("_probability").setRawPredictionCol("_margin").fit(fit)
    fit.unpersist()
    held = featured.where(check)
    scored = _raw(trees, held if held.take(1) else featured)
    calibration = IsotonicRegression(featuresCol="_raw", labelCol="_toxic", predictionCol="_calibrated").fit(scored)
    return ToxicityModel(model(0, 1).lexicon, trees, calibration, float(toxic / total), s)
