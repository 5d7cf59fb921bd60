"""Substring dedup by sliding sentence spans.

Every run of several consecutive sentences is hashed; runs are joined globally by hash, and
a sentence is removed if any repeated run that covers it is not the first of its kind.  Runs
that overlap or touch are one repeated span; spans of a few words, such as short phrases met
by chance, stay.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skiff.llm.sample import with_scores
from skiff.session import materialize, ship_package

#: Sentences of a run, and the fewest words that make it worth comparing.
RUN, MIN_WORDS = 3, 10
#: A longer sentence counts as several: it is cut after the word with the smallest hash of
#: every so many neighbours, so copies are cut alike wherever their sentence begins.  At most
#: so many words are lost at either end of a copy, and what is left of 51 has three pieces.
SENTENCE_WORDS = 12
#: The fewest words of a repeated span that is removed.
SPAN_WORDS = 25
#: Hashes that hold more than this share of all runs are joined where their rows are; there
#: are at most its reciprocal of them, so their broadcast is bounded at any input size.
HOT_SHARE = 1 / 20_000

# Scripts written without spaces (Thai to Lao, Burmese, Khmer, kana, Han); each
# of their letters counts as a word.
_LONE = "\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u9fff\uf900-\ufaff\U00020000-\U0003ffff"
_HAS_LONE = re.compile(f"[{_LONE}]")
_END = re.compile(r"[.!?…]+[\"'”’»)]*\s+|[。！？]+[」』”’）\"')]*\s*|\s*\n\s*")
_WORD = re.compile(f"[{_LONE}]\\s*|[^\\s{_LONE}]+\\s*")
_P = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: str) -> list[str]:
    """The words between white space, and single letters of scripts written without it."""
    if text.isascii() or not _HAS_LONE.search(text):
        return text.split()
    return [w.rstrip() for w in _WORD.findall(text)]


def sentences(text: str) -> list[tuple[int, int]]:
    """[start, end) of the sentences, which cover the whole text: one ends after closing
    punctuation and white space, at a line end, or within a long one as ``_cuts`` says."""
    out = []
    start = 0
    ends = [m.end() for m in _END.finditer(text)]
    if not ends or ends[-1] < len(text):
        ends.append(len(text))
    for end in ends:
        words = words_of(text[start:end])
        if len(words) > SENTENCE_WORDS:
            ends_ = [m.end() for m in _WORD.finditer(text, start, end)]
            for k in _cuts(words):
                out.append((start, ends_[k]))
                start = ends_[k]
        if end > start:
            out.append((start, end))
            start = end
    return out


def _cuts(words: list[str]) -> list[int]:
    """Words behind which a sentence is cut: the last one with the smallest hash of each
    ``SENTENCE_WORDS`` neighbours, but not the sentence's last word."""
    h = [zlib.crc32(w.encode("utf-8", "replace")) * 0x9E3779B1 & 0xFFFFFFFF for w in words]
    out, at = [], -1
    for end in range(SENTENCE_WORDS, len(h) + 1):
        first = end - SENTENCE_WORDS
        if at < first:
            part = h[first:end][::-1]
            at = end - 1 - part.index(min(part))
        elif h[end - 1] <= h[at]:
            at = end - 1
        if (not out or at != out[-1]) and at < len(h) - 1:
            out.append(at)
    return out


def run_hashes(text: str | None, run: int = RUN, min_words: int = MIN_WORDS) -> list[int | None]:
    """A hash for each run by its first sentence.  A run of too few words is compared together
    with the sentences behind it that it takes to have enough; None where the text ends before.
    Words are compared as they are, white space between them is not."""
    import xxhash

    parts = [words_of(text[a:b]) for a, b in sentences(text or "")]
    if len(parts) < run:
        return []
    h = np.fromiter((xxhash.xxh64_intdigest(" ".join(p).encode("utf-8", "replace")) for p in parts), np.uint64, len(parts))
    n = np.fromiter(map(len, parts), np.int64, len(parts))
    size = len(parts) - run + 1
    mixed, words = np.zeros(size, np.uint64), np.zeros(size, np.int64)
    for k in range(run):
        mixed = (mixed ^ h[k : k + size]) * _P
        mixed ^= mixed >> np.uint64(31)
        words += n[k : k + size]
    short, k = np.flatnonzero(words < min_words), run
    while len(short := short[short + k < len(parts)]):
        mixed[short] = (mixed[short] ^ h[short + k]) * _P
        mixed[short] ^= mixed[short] >> np.uint64(31)
        words[short] += n[short + k]
        short, k = short[words[short] < min_words], k + 1
    return [v if w >= min_words else None for v, w in zip(mixed.view(np.int64).tolist(), words.tolist())]


def _covered(n: list[int], starts: list[int], run: int, min_words: int, span_words: int) -> set[int]:
    """Sentences of the spans that the runs at ``starts`` make up, each run with the sentences
    it was lengthened by; spans of fewer than ``span_words`` words are left out.  ``n``: the
    words of every sentence."""
    gone: set[int] = set()
    low = high = words = 0  # the span [low, high) so far
    for s in sorted(starts):
        end = s + run
        size = sum(n[s:end])
        while size < min_words and end < len(n):
            size, end = size + n[end], end + 1
        if s > high:
            if words >= span_words:
                gone.update(range(low, high))
            low = high = s
            words = 0
        if end > high:
            words += sum(n[high:end])
            high = end
    if words >= span_words:
        gone.update(range(low, high))
    return gone


def _cover(text: str | None, starts: list[int] | None, run: int, min_words: int, span_words: int) -> tuple[str | None, int, int, int]:
    """Remaining text, sentences, removed sentences, removed words."""
    spans = sentences(text or "")
    if not starts:
        return text, len(spans), 0, 0
    n = [len(words_of(text[a:b])) for a, b in spans]
    gone = _covered(n, starts, run, min_words, span_words)
    kept = "".join(text[a:b] for k, (a, b) in enumerate(spans) if k not in gone)
    return kept, len(spans), len(gone), sum(n[k] for k in gone)


def remove_repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", run: int = RUN, min_words: int = MIN_WORDS, span_words: int = SPAN_WORDS) -> DataFrame:
    """``docs`` with the text less its repeated sentences, plus n_sentences, n_removed (of
    them) and n_removed_words.

    First is the run with the smallest id (nulls last), then text hash, then place; later
    runs of the same document count as repeats too.  Rows equal in id and text count as one
    document and get the same result.  A null text stays null; an empty table stays empty.
    """
    ship_package(docs.sparkSession)
    key = ["id", "text_key"]
    d = docs.select(F.col(f"`{id_col}`").alias("id"), F.xxhash64(F.col(f"`{text_col}`")).alias("text_key"), F.col(f"`{text_col}`").alias("text"))

    def make(texts: pa.Array) -> list[pa.Array]:
        return [pa.array([run_hashes(t, run, min_words) for t in texts.to_pylist()], pa.list_(pa.int64()))]

    hashed = with_scores(d, "text", make, [T.StructField("runs", T.ArrayType(T.LongType()))])
    hashed = materialize(hashed.where("size(runs) > 0").select(*key, "runs"), "runs")
    runs = hashed.select(*key, F.posexplode("runs").alias("at", "h")).where("h is not null")
    place = F.struct(F.col("id").isNull().alias("no_id"), "id", "text_key", "at")
    firsts = materialize(runs.groupBy("h").agg(F.count(F.lit(1)).alias("n"), F.min(place).alias("first")).where("n > 1"), "firsts")
    # at most 1 / HOT_SHARE hashes can each hold that share of the runs counted here
    total = firsts.agg(F.sum("n")).first()[0] or 0
    hot = firsts.where(F.col("n") > total * HOT_SHARE)
    others = firsts.where(F.col("n") <= total * HOT_SHARE).select("h", "first")
    marked = runs.join(F.broadcast(hot.select("h", F.col("first").alias("hot_first"))), "h", "left")
    among_hot = marked.where("hot_first is not null").withColumnRenamed("hot_first", "first")
    among_others = marked.where("hot_first is null").drop("hot_first").join(others, "h")
    later = among_hot.select(*key, "at", "h", "first").unionByName(among_others.select(*key, "at", "h", "first")).where(~place.eqNullSafe(F.col("first")))
    starts = materialize(later.groupBy(*key).agg(F.collect_set("at").alias("starts")), "repeats")
    names = ("n_sentences", "n_removed", "n_removed_words")
    rest = [F.col(f"`{c}`") for c in docs.columns if c not in names]
    left = docs.select(F.struct(*rest).alias("doc")).withColumn("id", F.col("doc")[id_col]).withColumn("text_key", F.xxhash64(F.col("doc")[text_col]))
    joined = left.join(
        starts.select(F.col("id").alias("id2"), F.col("text_key").alias("key2"), "starts"), (F.col("text_key") == F.col("key2")) & F.col("id").eqNullSafe(F.col("id2")), "left"
    ).select("doc", "starts")
    out = T.StructType(
        [joined.schema["doc"], T.StructField("text", T.StringType()), *[T.StructField(c, T.LongType()) for c in names]]
    )
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(out)

    def rebuild(batches):
        for b in batches:
            for at in range(0, b.num_rows, 512):
                part = b.slice(at, 512)
                doc = part.column(0).cast(arrow.field(0).type)
                texts = pa.compute.struct_field(doc, text_col).to_pylist()
                made = [_cover(t, s, run, min_words, span_words) for t, s in zip(texts, part.column(1).to_pylist())]
                cols = [pa.array(c, f.type) for c, f in zip(zip(*made), list(arrow)[1:])]
                yield pa.RecordBatch.from_arrays([doc, *cols], schema=arrow)

    import pyarrow.compute  # noqa: F401

    done = joined.mapInArrow(rebuild, out)
    cols = [F.col("text").alias(c) if c == text_col else F.col("doc")[c].alias(c) for c in docs.columns if c not in names]
    return done.select(*cols, *names)


def op6_span_dedup(spark, sf_dir):
    """Query: the text that remains of every document, and what was removed."""
    from skiff.llm.common import table

    return remove_repeated_spans(table(spark, sf_dir, "documents").select("doc_id", "text"))
