"""Periodic run detection by maximal-pair enumeration over the words of each text.

A run with period q is a pair of equal stretches at distance q that can be extended neither
to the left nor to the right: a maximal pair.  The suffixes of a text's words are sorted and
their LCP-interval tree is walked bottom-up.  Suffixes from different children of an interval
of depth d share exactly d words, so their pairs end where they must; the suffixes of a node
are kept in lists by the word on their left, and pairs within a list are left out, so the
pairs begin where they must, too.  Of these maximal pairs the ones whose distance p satisfies
the length constraints are exactly the runs (a multiple of the smallest period gives the same
stretch, which keeps its smallest).  Nothing is extended afterwards.

Only texts in which a stretch of the least depth repeats are sorted; the sort doubles its
reach each round, for many texts at once.  One pass over the documents, no shuffle.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, bisect_right, insort
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skiff.session import ship_package

#: A run has at least so many words, and so many times its period.
MIN_LENGTH, MIN_EXPONENT = 6, 4
#: Text handled at a time (one longer text goes alone).
SLICE_BYTES = 2 << 20

_RUN = T.StructType([T.StructField(n, T.LongType(), False) for n in ("start", "length", "period")])
_MIX = np.uint64(0x9E3779B97F4A7C15)


def least_depth(min_length: int, min_exponent: int) -> int:
    """Fewest words that the two stretches of any run's pair share."""
    return min(max(min_length - p, (min_exponent - 1) * p) for p in range(1, min_length + 1))


def repeating(codes: np.ndarray, doc: np.ndarray, depth: int) -> np.ndarray:
    """Numbers of the texts in which some stretch of ``depth`` words occurs twice, and
    perhaps (where hashes meet) some others."""
    n = len(codes) - depth + 1
    if n < 2:
        return np.zeros(0, np.int64)
    h = doc[:n].astype(np.uint64)
    for k in range(depth):
        h = (h ^ (h >> np.uint64(29))) * _MIX + codes[k : k + n].astype(np.uint64)
    at = np.flatnonzero(doc[:n] == doc[depth - 1 :])
    h = h[at]
    order = np.argsort(h)
    s = h[order]
    again = s[1:] == s[:-1]
    twice = doc[at[order]]
    return np.unique(twice[1:][again & (twice[1:] == twice[:-1])])


def suffix_order(symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes in order, and how many symbols each shares with the next one (0 last)."""
    n = len(symbols)
    _, rank = np.unique(symbols, return_inverse=True)
    levels, reach = [rank.astype(np.int32)], 1
    while reach < n:
        behind = np.zeros(n, np.int64)
        behind[:-reach] = levels[-1][reach:] + 1
        kinds, rank = np.unique(levels[-1].astype(np.int64) * (n + 1) + behind, return_inverse=True)
        levels.append(rank.astype(np.int32))
        reach *= 2
        if len(kinds) == n:
            break
    order = np.argsort(levels[-1])
    i, j = order[:-1], order[1:]
    shared = np.zeros(n - 1, np.int64)
    for k in range(len(levels) - 1, -1, -1):
        a, b = i + shared, j + shared
        inside = np.maximum(a, b) < n
        same = inside & (levels[k][np.minimum(a, n - 1)] == levels[k][np.minimum(b, n - 1)])
        shared += same.astype(np.int64) << k
    return order, np.append(shared, 0)


class _Node:
    """Suffixes below a node, in order of their place, and on demand by the word before."""

    __slots__ = ("places", "classes")

    def __init__(self, place: int):
        self.places = [place]
        self.classes: dict[int, list[int]] | None = None

    def by_left(self, left: list[int]) -> dict[int, list[int]]:
        if self.classes is None:
            self.classes = {}
            for i in self.places:
                self.classes.setdefault(left[i], []).append(i)
        return self.classes

    def add(self, other: _Node, left: list[int]) -> None:
        for i in other.places:
            insort(self.places, i)
            if self.classes is not None:
                insort(self.classes.setdefault(left[i], []), i)


def _meet(small: _Node, large: _Node, far: int, left: list[int]):
    """Pairs of one place from either node, at most ``far`` apart, with different words before.

    Occurrences of one stretch that lie so close follow each other by its period, and all but
    the first of such a row have the same word before them: few pairs are left, and a long
    row is passed by its classes."""
    places = large.places
    for i in small.places:
        lo, hi = bisect_left(places, i - far), bisect_right(places, i + far)
        if lo == hi:
            continue
        before = left[i]
        if hi - lo <= 8 or hi - lo <= len(large.by_left(left)):
            for j in places[lo:hi]:
                if left[j] != before:
                    yield i, j
        else:
            for word, row in large.by_left(left).items():
                if word != before:
                    for j in row[bisect_left(row, i - far) : bisect_right(row, i + far)]:
                        yield i, j


def maximal_runs(order: list[int], shared: list[int], left: list[int], min_length: int, min_exponent: int) -> dict[tuple[int, int], int]:
    """(start, length) of every run and its smallest period.  ``left``: the word before each
    place, a number of its own where there is none."""
    least = least_depth(min_length, min_exponent)
    runs: dict[tuple[int, int], int] = {}
    stack: list[tuple[int, _Node]] = []

    def join(node: _Node, depth: int, child: _Node) -> _Node:
        small, large = (child, node) if len(child.places) <= len(node.places) else (node, child)
        for i, j in _meet(small, large, depth // (min_exponent - 1), left):
            p = abs(i - j)
            if depth + p >= min_length:
                key = (min(i, j), depth + p)
                if p < runs.get(key, p + 1):
                    runs[key] = p
        large.add(small, left)
        return large

    last = 0
    for place, depth in zip(order, shared):
        if depth < least and last < least:
            last = depth
            continue  # a suffix that shares too little with either neighbour
        node, last = _Node(place), depth
        while stack and stack[-1][0] > depth:
            d, below = stack.pop()
            node = join(below, d, node)
        if stack and stack[-1][0] == depth:
            stack[-1] = (depth, join(stack[-1][1], depth, node))
        elif depth >= least:
            stack.append((depth, node))
    return runs


def _words(texts: pa.Array) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """Word numbers of all texts in a row, the words by number, and each text's first place
    (one more at the end)."""
    lists = pc.ascii_split_whitespace(texts.fill_null(""))
    flat = lists.flatten()
    kept = np.array(pc.not_equal(flat, ""), bool)
    ends = np.append(0, np.cumsum(kept))[np.array(lists.offsets, np.int64) - lists.offsets[0].as_py()]
    coded = flat.filter(pa.array(kept)).dictionary_encode()
    return np.array(coded.indices, np.int64), coded.dictionary, ends


def runs_of(texts: pa.Array, keys: list[str], wrap, min_length: int, min_exponent: int) -> tuple[list[list[tuple[int, int, int]]], pa.Array]:
    """Per text its runs (start, length, period; by start, then period) and the text without
    what they repeat."""
    codes, words, starts = _words(texts)
    if wrap is not None:
        for key, a, b in zip(keys, starts[:-1].tolist(), starts[1:].tolist()):
            place = wrap(key, b - a)
            if place is not None:
                first, period = place
                tail = np.arange(b - a - first)
                codes[a + first : b] = codes[a + first + tail % period]
    doc = np.repeat(np.arange(len(texts)), np.diff(starts))
    out: list[list[tuple[int, int, int]]] = [[] for _ in range(len(texts))]
    change = np.zeros(len(codes) + 1, np.int64)
    some = repeating(codes, doc, least_depth(min_length, min_exponent))
    if len(some):
        at = np.flatnonzero(np.isin(doc, some))
        # a word is a symbol of its text, so no two texts share any
        symbols = doc[at] * (len(words) + 1) + codes[at]
        left = np.append(-1, symbols[:-1])
        left[np.append(True, doc[at][1:] != doc[at][:-1])] = -1
        order, shared = suffix_order(symbols)
        runs = maximal_runs(order.tolist(), shared.tolist(), left.tolist(), min_length, min_exponent)
        for (start, length), period in sorted(runs.items(), key=lambda r: (r[0][0], r[1])):
            place = int(at[start])
            d = int(doc[place])
            out[d].append((place - int(starts[d]), length, period))
            change[place + period] += 1
            change[place + length] -= 1
    kept = np.cumsum(change[:-1]) == 0
    ends = np.append(0, np.cumsum(kept))[starts].astype(np.int32)
    rest = pa.ListArray.from_arrays(pa.array(ends), words.take(pa.array(codes[kept])))
    return out, pc.binary_join(rest, " ")


def _slices(sizes: list[int]):
    start = held = 0
    for i, n in enumerate(sizes):
        if i > start and held + n > SLICE_BYTES:
            yield start, i
            start, held = i, 0
        held += n
    if start < len(sizes):
        yield start, len(sizes)


def find_runs(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    min_length: int = MIN_LENGTH,
    min_exponent: int = MIN_EXPONENT,
    wrap: Callable[[str, int], tuple[int, int] | None] | None = None,
) -> DataFrame:
    """The id column, ``runs`` (array of start, length, period, in words; by start, then
    period) and ``collapsed`` per row: the words that no run repeats, joined by one space.

    Words are stretches without space and 0x09-0x0D.  A run has at least ``min_length`` words
    and ``min_exponent`` (2 or more) periods.  ``wrap`` may name, by a text's id in decimal
    (a null id: the empty text) and its word count, a word from which on the words are
    replaced by a repetition of the first so many of them.  A null, empty or blank text has no
    runs and collapses to the empty text; repeated rows and null ids are rows like any other;
    an empty table gives no rows; other columns are ignored.  A text's words take about 150
    bytes each while it is sorted.
    """
    ship_package(docs.sparkSession)
    d = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("key"), F.col(text_col).cast("string").alias("text"))
    out = T.StructType(
        [
            T.StructField(id_col, d.schema["id"].dataType),
            T.StructField("runs", T.ArrayType(_RUN, False)),
            T.StructField("collapsed", T.StringType()),
        ]
    )

    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_schema

        schema = to_arrow_schema(out)
        for b in batches:
            sizes = pc.binary_length(b.column(2)).fill_null(0).to_pylist()
            for start, stop in _slices(sizes):
                part = b.slice(start, stop - start)
                runs, rest = runs_of(part.column(2), part.column(1).to_pylist(), wrap, min_length, min_exponent)
                ends = np.append(0, np.cumsum([len(r) for r in runs])).astype(np.int32)
                flat = np.array([x for r in runs for x in r], np.int64).reshape(-1, 3)
                fields = list(schema.field("runs").type.value_type)
                structs = pa.StructArray.from_arrays([pa.array(flat[:, k]) for k in range(3)], fields=fields)
                lists = pa.ListArray.from_arrays(pa.array(ends), structs, type=schema.field("runs").type)
                yield pa.RecordBatch.from_arrays([part.column(0), lists, rest.cast(pa.string())], schema=schema)

    return d.mapInArrow(run, out)


def wrap_tenth(key: str, n: int) -> tuple[int, int] | None:
    """The contract's repetition: of a tenth of the texts, by the crc32 of their id."""
    h = zlib.crc32(key.encode())
    if h % 10 or not n:
        return None
    g = h // 10
    first = g % n
    return first, 1 + (n - first) // (3 + g % 8)


def op13_periodic_runs(spark, sf_dir):
    """Contract query: counts, the longest run, and digests of runs and remaining words."""
    from skiff.llm.common import table

    r = find_runs(table(spark, sf_dir, "documents"), wrap=wrap_tenth)
    # the greatest of (length, -start, -period)
    best = F.array_max(F.transform("runs", lambda x: F.struct(x["length"].alias("l"), (-x["start"]).alias("s"), (-x["period"]).alias("p"))))
    line = F.transform("runs", lambda x: F.concat(x["start"].cast("string"), F.lit(","), x["length"].cast("string"), F.lit(","), x["period"].cast("string"), F.lit("\n")))
    r = r.withColumn("b", best)
    return r.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        (-F.col("b.s")).alias("start"),
        F.col("b.l").alias("length"),
        (-F.col("b.p")).alias("period"),
        F.expr("(1000 * b.l) div (-b.p)").alias("exponent_milli"),
        F.sha2(F.array_join(line, ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
