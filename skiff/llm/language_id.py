"""Language ID: averaged hashed subword embeddings with a linear softmax, trained by
stochastic gradient descent in numpy, with calibrated rejection."""

from __future__ import annotations

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

UNKNOWN = "und"
BITS, WIDTH = 16, 16
#: Bounds of the labelled sample that the fit sees: documents, and characters of them.
MAX_TRAIN_ROWS, MAX_TRAIN_CHARS = 4000, 24_000_000
#: Passes over the sample, more if they would be fewer steps than STEPS.
EPOCHS, STEPS, RATE = 4, 8000, 0.5
#: Share of rightly named calibration documents that rejection may cost, and the most the
#: threshold may be.
FALSE_REJECTIONS, MAX_THRESHOLD = 0.001, 0.5

# ASCII other than letters separates words; bytes of other letters stay.
_SPACED = bytes(c if c >= 0x80 or chr(c).isalpha() else 0x20 for c in range(256))
_MIX = np.uint32(0x9E3779B1)


def has_letters(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


def has_letters_column(text_col: str):
    """The same as a Spark condition (false for null)."""
    return F.coalesce(F.col(text_col).rlike(r"\p{L}"), F.lit(False))


def subwords(text: str, bits: int = BITS) -> np.ndarray:
    """Slots of the 3- and 4-byte stretches of the lower-cased words, each word with one
    space at either side (a stretch has no space inside)."""
    raw = b" " + text.lower().encode("utf-8", "replace").translate(_SPACED) + b" "
    b = np.frombuffer(raw, np.uint8)
    c = b.astype(np.uint32)
    three = c[:-2] | (c[1:-1] << np.uint32(8)) | (c[2:] << np.uint32(16))
    inner = b[1:-1] != 32
    four = three[:-1] | (c[3:] << np.uint32(24))
    shift = np.uint32(32 - bits)
    a = (three[inner] * _MIX) >> shift
    d = ((four[inner[:-1] & inner[1:]] ^ np.uint32(0x5BD1E995)) * _MIX) >> shift
    return np.concatenate([a, d])


@dataclass
class LanguageModel:
    langs: list[str]
    table: np.ndarray  # slot -> its embedding times the output layer, one number a language
    bias: np.ndarray
    temperature: float
    threshold: float

    def probabilities(self, text: str) -> np.ndarray:
        slots = subwords(text)
        z = self.bias + (self.table[slots].mean(axis=0) if len(slots) else 0.0)
        z = z.astype(np.float64) / self.temperature
        e = np.exp(z - z.max())
        return e / e.sum()

    def predict(self, text: str | None) -> tuple[str, float]:
        if not self.langs or not has_letters(text):
            return UNKNOWN, 0.0
        p = self.probabilities(text)
        k = int(p.argmax())
        return self.langs[k], float(p[k])


def fit_language_model(rows: list[tuple[str, str]], bits: int = BITS, width: int = WIDTH, epochs: int = EPOCHS, rate: float = RATE) -> LanguageModel:
    """Train on four fifths of ``rows`` (text, language) in the given order; the last fifth
    sets the temperature and the rejection threshold.  No rows: a model that knows nothing."""
    langs = sorted({y for _, y in rows})
    if not langs:
        return LanguageModel([], np.zeros((1 << bits, 1), np.float32), np.zeros(1), 1.0, 0.0)
    code = {y: k for k, y in enumerate(langs)}
    data = [(subwords(t, bits), code[y]) for t, y in rows]
    tune = data[::5] if len(data) >= 50 else data
    train = [d for k, d in enumerate(data) if k % 5 or len(data) < 50]
    rnd = np.random.default_rng(17)
    emb = rnd.normal(0, 0.1, (1 << bits, width)).astype(np.float32)
    out = np.zeros((width, len(langs)), np.float32)
    bias = np.zeros(len(langs), np.float32)
    epochs = max(epochs, -(-STEPS // len(train)))
    steps, done = epochs * len(train), 0
    for _ in range(epochs):
        for slots, y in train:
            r = np.float32(rate * (1 - done / steps))
            done += 1
            if not len(slots):
                continue
            at, counts = np.unique(slots, return_counts=True)
            share = (counts / len(slots)).astype(np.float32)
            mean = share @ emb[at]
            z = mean @ out + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[y] -= 1
            back = out @ p
            out -= r * np.outer(mean, p)
            bias -= r * 0.1 * p
            # rare slots would hardly move by their share alone: the root evens them out
            emb[at] -= r * np.outer(np.sqrt(share), back)
    model = LanguageModel(langs, (emb @ out).astype(np.float32), bias, 1.0, 0.0)
    zs = np.array([model.bias + (model.table[s].mean(axis=0) if len(s) else 0.0) for s, _ in tune], np.float64)
    ys = np.array([y for _, y in tune])

    def probs(t: float) -> np.ndarray:
        e = np.exp((zs - zs.max(axis=1, keepdims=True)) / t)
        return e / e.sum(axis=1, keepdims=True)

    grid = np.geomspace(0.05, 20, 60)
    loss = [-np.log(np.maximum(probs(t)[np.arange(len(ys)), ys], 1e-12)).mean() for t in grid]
    model.temperature = float(grid[int(np.argmin(loss))])
    p = probs(model.temperature)
    right = np.sort(p.max(axis=1)[p.argmax(axis=1) == ys])
    if len(right):
        # too few documents to know so small a quantile leave the threshold nearer to chance
        chance = 1 / len(langs)
        known = min(1.0, len(right) * FALSE_REJECTIONS)
        model.threshold = min(MAX_THRESHOLD, chance + (float(right[int(len(right) * FALSE_REJECTIONS)]) - chance) * known)
    return model


def labelled_sample(docs: DataFrame, max_rows: int = MAX_TRAIN_ROWS, max_chars: int = MAX_TRAIN_CHARS) -> list[tuple[str, str]]:
    """(text, language) of at most ``max_rows`` documents and ``max_chars`` characters,
    chosen by a hash of the id (a first pass over ids alone finds the largest hash to take);
    where the characters are the bound, of those rows the first in the table's order.
    Rows without a text or language are left out."""
    key = F.xxhash64("doc_id")
    known = docs.where("text is not null and lang is not null")
    top = known.select(key.alias("h")).orderBy("h").limit(max_rows).agg(F.max("h")).first()[0]
    if top is None:
        return []
    picked = known.where(key <= top).limit(max_rows)
    out, used = [], 0
    for r in picked.select("doc_id", "lang", F.substring("text", 1, max_chars).alias("text")).toLocalIterator():
        used += len(r.text)
        if used > max_chars:
            break
        if has_letters(r.text):
            out.append((zlib.crc32(str(r.doc_id).encode()), r.text, r.lang))
    return [(t, y) for _, t, y in sorted(out)]


def identify_language(docs: DataFrame, model: LanguageModel, text_col: str = "text") -> DataFrame:
    """``docs`` plus lang_pred, lang_score (its calibrated probability) and lang_accepted.

    A null text or one without letters is ``und`` with score 0 and is not accepted; other
    texts always get a learned language, and are accepted from the model's threshold on.  Of
    equally probable languages the alphabetically first is taken.
    """
    ship_package(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make(texts: pa.Array) -> list[pa.Array]:
        m = shared.value
        named = [m.predict(t) for t in texts.to_pylist()]
        return [
            pa.array([y for y, _ in named], pa.string()),
            pa.array([p for _, p in named], pa.float64()),
            pa.array([y != UNKNOWN and p >= m.threshold for y, p in named], pa.bool_()),
        ]

    fields = [T.StructField("lang_pred", T.StringType()), T.StructField("lang_score", T.DoubleType()), T.StructField("lang_accepted", T.BooleanType())]
    return with_scores(docs, text_col, make, fields)


def op4_language_id(spark, sf_dir):
    """Contract query: fit on the fold's rows, name every document's language."""
    docs = table(spark, sf_dir, "documents")
    held = fold_of("doc_id", 4) == 2
    model = fit_language_model(labelled_sample(docs.where(~held)))
    named = identify_language(docs.select("doc_id", "text", held.alias("held_out")), model)
    return named.select("doc_id", "held_out", "lang_pred", F.col("lang_score").alias("score"))
