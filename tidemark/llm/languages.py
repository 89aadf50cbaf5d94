"""Language identification by a blended-spectrum string kernel.

k(x, y) is the number of distinct n-grams of letters, n from 1 to 3, that both texts hold, over the geometric mean of
their own numbers. Nyström features are the kernel with landmark texts, times the inverse square root of the landmarks'
own kernel; a one-versus-rest kernel ridge regression is fitted on them. Scoring is two matrix products a batch: n-gram
presences by landmark presences, and kernel rows by weights.

Fitting takes a bounded sample: about `sample` labelled texts of each language, picked by a hash of the key. The sample
is turned into presences on the executors; what reaches the driver is bounded by sample x languages x n-grams of a text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import batches, bounded_batches, extended

#: Symbols of the n-gram alphabet: a blank for all that is no letter, a to z, and hash classes of other letters.
SYMBOLS = 64
GRAMS = SYMBOLS**3 + SYMBOLS**2 + SYMBOLS


@lru_cache(maxsize=1)
def _alphabet() -> np.ndarray:
    """The symbol of each code point: 0 for no letter."""
    out = np.zeros(0x110000, np.uint8)
    for cp in range(0x110000):
        c = chr(cp)
        if c.isalpha():
            low = ord(c.lower()[0])
            out[cp] = low - 96 if 97 <= low <= 122 else 27 + low * 2654435761 % 2**32 % (SYMBOLS - 27)
    return out


def grams(text: str) -> np.ndarray:
    """The distinct n-grams of a whole text as sorted numbers; none if it has no letters."""
    s = _alphabet()[np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)].astype(np.int32)
    if not s.any():
        return np.zeros(0, np.int64)
    s = np.concatenate([[0], s, [0]])
    seen = np.zeros(GRAMS, bool)
    pairs = s[:-1] * SYMBOLS + s[1:]
    seen[pairs[:-1] * SYMBOLS + s[2:]] = True
    seen[SYMBOLS**3 + pairs] = True
    seen[SYMBOLS**3 + SYMBOLS**2 + s] = True
    return np.flatnonzero(seen)


@dataclass
class Model:
    languages: list[str]
    columns: np.ndarray  # of each n-gram, its column among those of the landmarks, or -1
    presence: np.ndarray  # landmark n-grams x landmarks, divided by the root of the landmark's number
    weights: np.ndarray  # landmarks x languages
    bias: np.ndarray

    def kernel(self, sets: list[np.ndarray]) -> np.ndarray:
        """Kernel values of texts (rows) with the landmarks."""
        rows = np.zeros((len(sets), len(self.presence)), np.float32)
        for i, g in enumerate(sets):
            c = self.columns[g]
            rows[i, c[c >= 0]] = 1.0
        return rows @ self.presence / np.sqrt(np.maximum([[len(g)] for g in sets], 1)).astype(np.float32)

    def scores(self, sets: list[np.ndarray]) -> np.ndarray:
        return self.kernel(sets) @ self.weights + self.bias


def fit_model(sets: list[np.ndarray], labels: list[str], landmarks: int = 96, ridge: float = 1e-2) -> Model | None:
    """None without any labelled text that has letters."""
    use = [i for i, g in enumerate(sets) if len(g)]
    if not use:
        return None
    sets, labels = [sets[i] for i in use], [labels[i] for i in use]
    languages = sorted({*labels})
    own = [[i for i, x in enumerate(labels) if x == name] for name in languages]
    marks = sorted(i for group in own for i in group[: max(1, landmarks // len(languages))])
    vocabulary = np.unique(np.concatenate([sets[i] for i in marks]))
    columns = np.full(GRAMS, -1, np.int32)
    columns[vocabulary] = np.arange(len(vocabulary))
    presence = np.zeros((len(vocabulary), len(marks)), np.float32)
    for k, i in enumerate(marks):
        presence[columns[sets[i]], k] = 1 / np.sqrt(len(sets[i]))
    model = Model(languages, columns, presence, np.zeros((len(marks), len(languages)), np.float32), np.zeros(len(languages), np.float32))
    rows = np.concatenate([model.kernel(sets[a : a + 256]) for a in range(0, len(sets), 256)]).astype(np.float64)
    values, vectors = np.linalg.eigh(rows[marks] + 1e-6 * np.eye(len(marks)))
    root = vectors / np.sqrt(np.maximum(values, 1e-6)) @ vectors.T
    features = rows @ root
    y = np.array([[1.0 if x == name else -1.0 for name in languages] for x in labels])
    balance = np.array([len(labels) / len(languages) / labels.count(x) for x in labels])[:, None]  # each language weighs alike
    mean = (features * balance).sum(0) / balance.sum()
    middle = (y * balance).sum(0) / balance.sum()
    centred = features - mean
    w = np.linalg.solve(centred.T @ (centred * balance) + ridge * len(labels) * np.eye(len(marks)) / len(marks), centred.T @ ((y - middle) * balance))
    model.weights, model.bias = (root @ w).astype(np.float32), (middle - mean @ w).astype(np.float32)
    return model


def fit(df: DataFrame, text: str = "text", label: str = "lang", key: str = "doc_id", sample: int = 200, **options) -> Model | None:
    """A model of the labelled rows of df (null labels and texts are left out).

    `sample` bounds the expected number of texts of a language; which ones is a hash of the key. The number of languages
    is taken to be small (thousands at most).
    """
    bounded_batches(df.sparkSession)
    rows = df.select(F.col(key).cast("string").alias("k"), F.col(label).alias("y"), F.col(text).alias("x")).filter("y is not null and x is not null")
    counts = {r["y"]: r["n"] for r in rows.groupBy("y").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return None
    share = F.create_map(*[F.lit(v) for name, n in sorted(counts.items()) for v in (name, min(1.0, sample / n))])
    picked = rows.filter(F.pmod(F.xxhash64("k"), F.lit(1 << 30)) < share[F.col("y")] * F.lit(1 << 30))

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches(frames):
            yield pa.RecordBatch.from_arrays([x.column(0), x.column(1), pa.array([grams(t).astype(np.int32).tobytes() for t in x.column(2).to_pylist()], pa.binary())], ["k", "y", "g"])

    got = sorted(picked.mapInArrow(run, "k string, y string, g binary").collect(), key=lambda r: (r["k"], r["y"], r["g"]))
    return fit_model([np.frombuffer(r["g"], np.int32) for r in got], [r["y"] for r in got], **options)


def predict(df: DataFrame, model: Model | None, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns `keep`, lang_pred and score of every whole text.

    A null text, one without letters, and any text without a model, is `und` with score 0. The score is the softmax of
    the languages' ridge values at the predicted one. Rows stay where they are: no shuffle.
    """
    bounded_batches(df.sparkSession)
    schema = extended(df.select(*keep).schema, "lang_pred string, score double")
    shared = df.sparkSession.sparkContext.broadcast(model)  # its size is set by landmarks, languages and GRAMS

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for x in batches(frames):
            sets = [grams(t) if t else np.zeros(0, np.int64) for t in x.column(len(keep)).to_pylist()]
            names, scores = ["und"] * len(sets), np.zeros(len(sets))
            use = [i for i, g in enumerate(sets) if len(g)] if m else []
            for a in range(0, len(use), 256):
                part = use[a : a + 256]
                values = m.scores([sets[i] for i in part])
                best = values.argmax(axis=1)
                odds = np.exp(3.0 * (values - values.max(axis=1, keepdims=True)))
                for i, b, p in zip(part, best.tolist(), (1 / odds.sum(axis=1)).tolist()):
                    names[i], scores[i] = m.languages[b], p
            yield pa.RecordBatch.from_arrays([*x.columns[: len(keep)], pa.array(names, pa.string()), pa.array(scores, pa.float64())], schema.names)

    return df.select(*keep, F.col(text).alias("_text")).mapInArrow(run, schema)
