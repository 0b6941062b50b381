"""Language identification: multinomial logistic regression on TF-IDF character n-grams.

Trained by follow-the-regularised-leader with elastic-net penalties, which leaves most weights at zero; a temperature fitted on
rows that were not trained on turns its outputs into probabilities. Counts of n-grams are hashed into a fixed number
of features. The model is fitted on a bounded sample of labelled rows; every text is scored whole.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import regex
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larder.llm.common import share, spare, unit_hash

#: Features (a power of two), longest n-gram, labelled rows per language that are trained on.
FEATURE_BITS, LONGEST, ROWS_PER_LANGUAGE = 15, 3, 300
UNDETERMINED = "und"
_OTHER = re.compile(r"[\W\d_]+")
_LETTER = regex.compile(r"\p{L}")
_ODD = np.uint64(0x9E3779B97F4A7C15)


def features(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Hashed n-grams of the letters of a text, in lower case, other characters as one blank: feature numbers and counts."""
    letters = f" {_OTHER.sub(' ', text.lower()).strip()} "
    codes = np.frombuffer(letters.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    shift, counts = np.uint64(64 - FEATURE_BITS), np.zeros(1 << FEATURE_BITS, np.int64)
    grams = codes
    for n in range(LONGEST):
        if n:
            grams = grams[:-1] * _ODD + codes[n:]
        counts += np.bincount(((grams + np.uint64(n)) * _ODD >> shift).astype(np.int64), minlength=len(counts))
    present = np.flatnonzero(counts)
    return present, counts[present].astype(float)


@dataclass
class Model:
    languages: list[str]
    idf: np.ndarray
    weights: np.ndarray
    temperature: float = 1.0

    def vector(self, present: np.ndarray, counts: np.ndarray) -> np.ndarray:
        weighed = counts * self.idf[present]
        return weighed / (np.linalg.norm(weighed) or 1.0)

    def outputs(self, present, counts) -> np.ndarray:
        return self.vector(present, counts) @ self.weights[present]

    def predict(self, text: str | None) -> tuple[str, float]:
        if not self.languages or text is None or not _LETTER.search(text):
            return UNDETERMINED, 0.0
        chances = _softmax(self.outputs(*features(text)) / self.temperature)
        best = int(chances.argmax())
        return self.languages[best], float(chances[best])


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max())
    return e / e.sum()


def fit(rows: list[tuple[np.ndarray, np.ndarray, str]], rounds: int = 4, alpha: float = 1.0, beta: float = 1.0,
        l1: float = 0.01, l2: float = 0.01, held_back: int = 5) -> Model:
    """rows: feature numbers, counts, language. Every held_back-th row only calibrates the temperature."""
    languages = sorted({r[2] for r in rows})
    seen = np.zeros(1 << FEATURE_BITS)
    for present, _, _ in rows:
        seen[present] += 1
    model = Model(languages, np.log((1 + len(rows)) / (1 + seen)) + 1, np.zeros((len(seen), len(languages))))
    truth = np.array([languages.index(r[2]) for r in rows], int)
    order = np.random.default_rng(5).permutation(len(rows))
    training, calibration = order[np.arange(len(order)) % held_back > 0], order[::held_back]
    # per coordinate: z collects gradients less what the weights already hold, n their squares
    z, n = np.zeros_like(model.weights), np.zeros_like(model.weights)

    def weights(z, n):
        held = np.sign(z) * l1 - z
        return np.where(np.abs(z) <= l1, 0.0, held / ((beta + np.sqrt(n)) / alpha + l2))

    for _ in range(rounds):
        for i in training:
            present, counts, _ = rows[i]
            x, w = model.vector(present, counts), weights(z[present], n[present])
            wrong = _softmax(x @ w)
            wrong[truth[i]] -= 1
            gradient = x[:, None] * wrong
            rate = (np.sqrt(n[present] + gradient**2) - np.sqrt(n[present])) / alpha
            z[present] += gradient - rate * w
            n[present] += gradient**2
    model.weights = weights(z, n)
    if len(languages) > 1:
        outputs = np.stack([model.outputs(*rows[i][:2]) for i in calibration])

        def loss(t):
            scaled = outputs / t - (outputs / t).max(1, keepdims=True)
            return np.mean(np.log(np.exp(scaled).sum(1)) - scaled[np.arange(len(scaled)), truth[calibration]])

        candidates = np.geomspace(0.05, 20, 61)
        model.temperature = float(candidates[np.argmin([loss(t) for t in candidates])])
    return model


def train(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
          rows_per_language: int = ROWS_PER_LANGUAGE) -> Model:
    """Fits on about rows_per_language rows of each language, chosen by a hash of the id. Null texts and languages teach nothing.

    The languages of the table, some hundred at most, and the hashed counts of the sample come to the driver.
    """
    known = labelled.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang")).where("text IS NOT NULL AND lang IS NOT NULL")
    chance = F.lit(0.0)
    for row in known.groupBy("lang").count().collect():
        chance = F.when(F.col("lang") == row["lang"], F.lit(min(1.0, rows_per_language / row["count"]))).otherwise(chance)

    def run(frames):
        for f in frames:
            found = [features(t) for t in f["text"]]
            yield pd.DataFrame({"lang": f["lang"], "present": [p.astype(np.int32).tobytes() for p, _ in found], "counts": [c.astype(np.float32).tobytes() for _, c in found]})

    sample = known.where(unit_hash("id") < chance).select("text", "lang").mapInPandas(run, "lang string, present binary, counts binary").toPandas()
    sample = sample.sort_values(["lang", "present"], kind="stable")
    return fit([(np.frombuffer(p, np.int32), np.frombuffer(c, np.float32).astype(float), lang) for lang, p, c in sample.itertuples(index=False)])


def predicted(spark, model: Model, text: Column) -> Column:
    """Struct of lang_pred and score for a text column."""
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, score double")
    def run(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([shared.value.predict(t) for t in texts], columns=["lang_pred", "score"])

    return run(text)


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """One row per row of docs: id, held_out (crc32 of the id modulo 3 is 1), lang_pred, score.

    Rows that are held out, and rows without an id, are not trained on. Null texts, texts without a letter, and any text if there is
    nothing to learn from, are und with score 0. Of equally likely languages the first by name is given. Repeated rows
    give repeated rows, an empty table an empty result, other columns are left out.
    """
    held_out = share(F.col(id_col), 3, 1)
    model = train(docs.where(F.col(id_col).isNotNull() & ~held_out), id_col, text_col, lang_col)
    scored = docs.select(F.col(id_col).alias("id"), held_out.alias("held_out"), predicted(docs.sparkSession, model, F.col(text_col)).alias("p"))
    return scored.select(F.col("id").alias(id_col), "held_out", "p.lang_pred", "p.score")


def keep_identified(docs: DataFrame, least: float = 0.5, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """docs without the rows whose language is undetermined or less likely than least; columns as they are."""
    model = train(docs.where(F.col(id_col).isNotNull() & ~share(F.col(id_col), 3, 1)), id_col, text_col, lang_col)
    (own,) = spare(docs, "_language")
    marked = docs.withColumn(own, predicted(docs.sparkSession, model, F.col(text_col)))
    return marked.where((F.col(own)["lang_pred"] != UNDETERMINED) & (F.col(own)["score"] >= least)).drop(own)
