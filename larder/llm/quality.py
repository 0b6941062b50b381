"""Quality scores: ridge regression on random Fourier features of document statistics, with isotonic calibration.

Random Fourier features approximate a Gaussian kernel: the inner product of cos(Wx + b) for normal W tends to it. The
normal equations of the ridge are sums over rows; every partition adds up its own and the driver adds the partitions. Rows that were
set aside fit the isotonic step from raw outputs to probabilities. Fitted on a bounded sample of labelled rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larder.llm.common import durable, share, small_or_shuffled, unit_hash

#: Labelled rows that are fitted on, random features, penalty, partitions whose sums come to the driver.
TRAIN_ROWS, RANDOM_FEATURES, PENALTY, SUMS = 8000, 256, 1e-2, 8
PREDICTED_FROM = 0.3
_PUNCTUATION = b"!\"#$%&'()*+,-./:;<=>?@[]_{|}~"


def statistics(text: str | None) -> np.ndarray:
    """Shape of a whole text: sizes, kinds of characters, words and their repetition, lines and their repetition."""
    raw = np.frombuffer((text or "").encode("utf-8", "replace"), np.uint8)
    counts, n = np.bincount(raw, minlength=256), max(1, len(raw))
    of = lambda a, b: counts[a:b].sum() / n
    words = (text or "").split()
    hashed = np.fromiter(map(hash, words), np.int64, len(words))
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    lines = [x for x in (text or "").split("\n") if x.strip()]
    w = max(1, len(words))
    times = np.unique(hashed, return_counts=True)[1] if len(words) else np.zeros(1, np.int64)
    return np.array([
        np.log1p(len(raw)), np.log1p(len(words)), np.log1p(len(lines)),
        of(65, 91), of(97, 123), of(48, 58), of(128, 256), of(32, 33), of(0, 9) + of(11, 32),
        *(counts[list(_PUNCTUATION)] / n), counts[list(_PUNCTUATION)].sum() / n,
        lengths.mean() if len(words) else 0.0, lengths.std() if len(words) else 0.0, (lengths <= 3).sum() / w,
        len(times) / w, times.max() / w, (hashed[1:] == hashed[:-1]).sum() / w,
        len(set(lines)) / max(1, len(lines)), len(words) / max(1, len(lines)),
    ])


@dataclass
class Model:
    mean: np.ndarray
    spread: np.ndarray
    directions: np.ndarray
    offsets: np.ndarray
    weights: np.ndarray | None = None
    raw: np.ndarray | None = None
    chance: np.ndarray | None = None

    def lift(self, stats: np.ndarray) -> np.ndarray:
        x = np.clip((stats - self.mean) / self.spread, -5, 5)
        return np.c_[np.ones(len(x)), np.sqrt(2 / len(self.offsets)) * np.cos(x @ self.directions + self.offsets)]

    def outputs(self, stats: np.ndarray) -> np.ndarray:
        return self.lift(stats) @ self.weights

    def scores(self, stats: np.ndarray) -> np.ndarray:
        """Calibrated; within a flat step the raw output still orders texts, by at most a thousandth."""
        if self.weights is None:
            return np.full(len(stats), 0.5)
        out = self.outputs(stats)
        return np.clip(0.999 * np.interp(out, self.raw, self.chance) + 0.001 / (1 + np.exp(-np.clip(out, -30, 30))), 0, 1)


def isotonic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pools equal outputs, then neighbours until the means rise: the middle and the mean of every step."""
    steps: list[list[float]] = []
    values, place = np.unique(x, return_inverse=True)
    counts = np.bincount(place)
    for a, n, total in zip(values.tolist(), counts.tolist(), np.bincount(place, y).tolist(), strict=True):
        steps.append([total / n, n, a, a])
        while len(steps) > 1 and steps[-2][0] >= steps[-1][0]:
            mean, n, _, high = steps.pop()
            below = steps[-1]
            steps[-1] = [(below[0] * below[1] + mean * n) / (below[1] + n), below[1] + n, below[2], high]
    return np.array([(s[2] + s[3]) / 2 for s in steps]), np.array([s[0] for s in steps])


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
          train_rows: int = TRAIN_ROWS, random_features: int = RANDOM_FEATURES, penalty: float = PENALTY) -> Model:
    """labels: ids and labels to learn from; an id with several labels counts with their mean, null labels do not count."""
    known = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.avg(label_col).alias("label"))
    n = known.count()
    chosen = small_or_shuffled(known.where(unit_hash("id") < train_rows / max(1, n)))

    def measure(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield pd.DataFrame({"label": f["label"], "aside": f["aside"], "stats": [statistics(t) for t in f["text"]]})

    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(chosen, "id")
    aside = unit_hash("id", F.lit("calibration")) < 0.25
    measured = durable(texts.select("label", aside.alias("aside"), "text").mapInPandas(measure, "label double, aside boolean, stats array<double>").repartition(SUMS))
    size, rng = len(statistics("")), np.random.default_rng(11)
    sums = measured.select(*[f(F.col("stats")[i]).alias(f"{f.__name__}{i}") for i in range(size) for f in (F.avg, F.stddev_pop)]).first()
    if not n or sums[0] is None:
        return Model(np.zeros(size), np.ones(size), np.zeros((size, 1)), np.zeros(1))
    spread = np.array(sums[1::2], float)
    model = Model(np.array(sums[0::2], float), np.where(spread > 1e-9, spread, 1.0),
                  rng.normal(0, 0.7 / np.sqrt(size), (size, random_features)), rng.uniform(0, 2 * np.pi, random_features))

    def add_up(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        gram, right = np.zeros((random_features + 1,) * 2), np.zeros(random_features + 1)
        for f in frames:
            lifted = model.lift(np.array(f["stats"].tolist()).reshape(len(f), -1))
            gram += lifted.T @ lifted
            right += lifted.T @ f["label"].to_numpy()
        yield pd.DataFrame({"gram": [gram.tobytes()], "right": [right.tobytes()]})

    parts = measured.where("NOT aside").mapInPandas(add_up, "gram binary, right binary").collect()
    gram = sum(np.frombuffer(p["gram"]).reshape(random_features + 1, -1) for p in parts)
    right = sum(np.frombuffer(p["right"]) for p in parts)
    rows = max(1.0, gram[0, 0])
    model.weights = np.linalg.solve(gram / rows + penalty / random_features * np.eye(len(gram)), right / rows)
    held = measured.where("aside").select("stats", "label").toPandas()
    held = held if len(held) else measured.select("stats", "label").toPandas()
    model.raw, model.chance = isotonic(model.outputs(np.array(held["stats"].tolist())), held["label"].to_numpy())
    return model


def score(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """One row per row of docs: id, held_out (crc32 of the id modulo 5 is 0), score, predicted.

    Labels of ids that are held out teach nothing. Null texts are scored as empty ones; without labels every score is one half.
    Repeated rows give repeated rows, a null id stays, an empty table gives an empty result, other columns are left out.
    """
    model = train(docs, labels.where(~share(F.col(id_col), 5, 0)), id_col, text_col, label_col)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            stats = np.array([statistics(t) for t in batch.column(2).to_pylist()]).reshape(batch.num_rows, -1)
            scores = shared.value.scores(stats) if batch.num_rows else np.zeros(0)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(scores)], names=["id", "held_out", "score"])

    narrow = docs.select(F.col(id_col).alias("id"), share(F.col(id_col), 5, 0).alias("held_out"), F.col(text_col).alias("text"))
    kind = narrow.schema["id"].dataType.simpleString()
    scored = narrow.mapInArrow(run, f"id {kind}, held_out boolean, score double")
    return scored.select(F.col("id").alias(id_col), "held_out", "score", (F.col("score") >= PREDICTED_FROM).cast("int").alias("predicted"))
