"""Quality classifier: hashed word n-gram logistic regression, trained by
follow-the-regularised-leader updates and scored as a sparse dot product."""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skiff.llm.common import fold_of, table
from skiff.llm.sample import with_scores
from skiff.session import ship_package

BITS = 18
#: Bounds of the labelled sample that the fit sees: documents, and characters of them.
MAX_TRAIN_ROWS, MAX_TRAIN_CHARS = 6000, 32_000_000
EPOCHS = 3

_TOKEN = re.compile(r"\w+|[^\w\s]+")
_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)


def features(text: str, bits: int = BITS) -> np.ndarray:
    """Slots of the text's words, word pairs and word triples seen before in the text.

    A word is a run of word characters or of other visible characters, case kept.  A pair
    of equal words has one slot for all words, and so has a triple that came before: these
    n-grams say that the text repeats itself, whatever it repeats.
    """
    words = _TOKEN.findall(text)
    if not words:
        return np.empty(0, np.int64)
    crc = zlib.crc32
    h = np.fromiter((crc(w.encode("utf-8", "replace")) for w in words), np.uint64, len(words))
    shift = np.uint64(64 - bits)
    one = (h * _A) >> shift
    pair = np.where(h[1:] == h[:-1], _B >> shift, ((h[1:] * _B) ^ (h[:-1] * _C)) * _A >> shift)
    triple = (h[2:] * _C) ^ (h[1:-1] * _B) ^ (h[:-2] * _A)
    again = np.full(len(triple) - len(np.unique(triple)), _C >> shift, np.uint64)
    return np.concatenate([one, pair, again]).astype(np.int64)


@dataclass
class QualityModel:
    weights: np.ndarray
    bias: float
    bits: int = BITS

    def logit(self, text: str | None) -> float:
        x = features(text or "", self.bits)
        return self.bias + (float(self.weights[x].sum()) / len(x) ** 0.5 if len(x) else 0.0)

    def score(self, text: str | None) -> float:
        return 1.0 / (1.0 + np.exp(-max(-60.0, min(60.0, self.logit(text)))))


def fit_ftrl(
    rows: list[tuple[str, int]], bits: int = BITS, epochs: int = EPOCHS, alpha: float = 0.2, beta: float = 1.0, l1: float = 0.02, l2: float = 0.1
) -> QualityModel:
    """Per-coordinate follow-the-regularised-leader over ``rows`` in the given order; the
    last coordinate is the bias.  A slot's value is its count over the root of all counts."""
    size = 1 << bits
    z, n = np.zeros(size + 1), np.zeros(size + 1)

    def weights(at: np.ndarray) -> np.ndarray:
        zz = z[at]
        return np.where(np.abs(zz) <= l1, 0.0, -(zz - np.sign(zz) * l1) / ((beta + np.sqrt(n[at])) / alpha + l2))

    data = []
    for text, label in rows:
        slots, counts = np.unique(features(text or "", bits), return_counts=True)
        x = counts / max(1, counts.sum()) ** 0.5
        data.append((np.append(slots, size), np.append(x, 1.0), float(label)))
    for _ in range(epochs):
        for at, x, y in data:
            w = weights(at)
            p = 1.0 / (1.0 + np.exp(-np.clip(w @ x, -60, 60)))
            g = (p - y) * x
            sigma = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / alpha
            z[at] += g - sigma * w
            n[at] += g * g
    w = weights(np.arange(size + 1))
    return QualityModel(w[:-1].astype(np.float32), float(w[-1]), bits)


def labelled_sample(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_TRAIN_ROWS, max_chars: int = MAX_TRAIN_CHARS) -> list[tuple[str, int]]:
    """(text, label) of at most ``max_rows`` labelled documents and ``max_chars`` characters,
    chosen by a hash of the id; where the characters are the bound, of those rows the first in
    the table's order.

    Null ids, labels and texts are left out; a document labelled both ways counts as bad; of rows
    that share an id the first ones within the bounds serve.
    """
    marked = labels.select(F.col("doc_id").alias("id"), F.col("quality").alias("label")).where("id is not null and label is not null")
    chosen = marked.groupBy("id").agg(F.min("label").alias("label")).orderBy(F.xxhash64("id"), "id").limit(max_rows)
    texts = docs.select(F.col("doc_id").alias("id"), "text").where("text is not null")
    picked = texts.join(F.broadcast(chosen), "id").select("id", "label", "text")  # at most max_rows ids
    out, used = [], 0
    for r in picked.limit(max_rows).select("id", "label", F.substring("text", 1, max_chars).alias("text")).toLocalIterator():
        used += len(r.text)
        if used > max_chars:
            break
        out.append((r.id, r.text, r.label))
    out.sort(key=lambda r: (zlib.crc32(str(r[0]).encode()), r[0], r[1]))
    return [(t, int(y)) for _, t, y in out]


def score_quality(docs: DataFrame, model: QualityModel, text_col: str = "text", score_col: str = "quality_score") -> DataFrame:
    """``docs`` plus the score; a null text counts as empty, whose score is the bias alone."""
    ship_package(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def scores(texts: pa.Array) -> list[pa.Array]:
        m = shared.value
        return [pa.array([m.score(t) for t in texts.to_pylist()], pa.float64())]

    return with_scores(docs, text_col, scores, [T.StructField(score_col, T.DoubleType())])


def op8_quality_classifier(spark, sf_dir):
    """Contract query: fit on the fold's labelled rows, score every document."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held = fold_of("doc_id", 5) == 0
    model = fit_ftrl(labelled_sample(docs.where(~held), labels.where(~held)))
    scored = score_quality(docs.select("doc_id", "text", held.alias("held_out")), model, score_col="score")
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
