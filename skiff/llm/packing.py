"""Packing by minimum bin slack.

Every document becomes token ids plus an end id.  Stretches of a whole capacity are
sequences of their own; the remaining lengths are packed window by window: a subset-sum
dynamic program over a bitset (one bit per reachable fill) finds the multiset of remaining
lengths that fills the window closest to capacity, and its counts are backtracked.

Each input partition is packed on its own, in blocks, so nothing is shuffled and a task
holds one block of short remainders.  Only the windows that close a partition may need a
cut: a remainder is cut to fill the slack, and the very last tokens go to sequences whose
lengths are powers of two, which need no padding.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skiff.session import ship_package

CAPACITY = 4096
END_ID = 2
TOKENIZER = "word_bpe_49k.json"
#: Remainders held by a task before it packs; down to LOW_WATER only exact fills are closed.
BLOCK, LOW_WATER = 8192, 1024
#: Words whose ids a Python worker remembers; the memory starts anew beyond that.
CACHED_WORDS = 500_000

# Letters that the tokenizer's normaliser maps by case only and that never join with neighbours.
_LETTERS = "A-Za-zÀ-ÖØ-öø-ÿ"
_WORD = re.compile(f"([{_LETTERS}]+)([!-/:-@\\[-`{{-~]*)")


def _byte_letters() -> dict[int, str]:
    """Byte-level spelling of the letters above 0x7F: each UTF-8 byte as one printable
    character; bytes without a printable form follow from U+0100 in order."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = [b for b in range(256) if b not in shown]
    spell = {b: chr(b) if b in shown else chr(0x100 + hidden.index(b)) for b in range(256)}
    return {c: "".join(spell[b] for b in chr(c).encode()) for c in range(0xC0, 0x100)}


class WordEncoder:
    """Ids of whole texts, with a memory of the ids of words.

    The tokenizer drops white space and no token spans it, so a text's ids are those of its
    stretches between spaces and line ends.  A stretch of letters and closing punctuation
    is in turn the letters' ids and the punctuation's.  Everything else is encoded as it is.
    """

    def __init__(self, tokenizer_json: str):
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_str(tokenizer_json)
        self.tok.encode_special_tokens = True  # special strings inside a text are plain text
        self.spelling = _byte_letters()
        self.known: dict[bytes, bytes] = {b"": b""}

    def _direct(self, s: str) -> bytes:
        return b"".join(i.to_bytes(4, "little") for i in self.tok.encode(s, add_special_tokens=False).ids)

    def _learn(self, word: bytes) -> bytes:
        s = word.decode()
        m = _WORD.fullmatch(s)
        if not m:
            ids = self._direct(s)
        else:
            letters, marks = m.groups()
            key = letters.encode()
            ids = self.known.get(key)
            if ids is None:
                spelled = letters.lower().translate(self.spelling)
                ids = self.known[key] = b"".join(t.id.to_bytes(4, "little") for t in self.tok.model.tokenize(spelled))
            if marks:
                tail = self.known.get(end := marks.encode())
                if tail is None:
                    tail = self.known[end] = self._direct(marks)
                ids = ids + tail
        self.known[word] = ids
        return ids

    def encode(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit integers."""
        words = text.encode("utf-8", "replace").lower().replace(b"\n", b" ").split(b" ")
        known = self.known
        try:
            return b"".join(map(known.__getitem__, words))
        except KeyError:
            pass
        if len(known) > CACHED_WORDS:
            known.clear()
            known[b""] = b""
        get, learn = known.get, self._learn
        return b"".join([learn(w) if (x := get(w)) is None else x for w in words])


def best_fill(lengths: list[int], counts: dict[int, int], capacity: int) -> dict[int, int]:
    """Counts of a multiset of remaining lengths, the largest included, whose sum comes
    closest to ``capacity``.  ``lengths``: the distinct ones, ascending."""
    first = lengths[-1]
    room = capacity - first
    used = {first: 1}
    reach, mask, steps = 1, (1 << (room + 1)) - 1, []
    for k in range(bisect_right(lengths, room) - 1, -1, -1):
        n = lengths[k]
        left = min(counts[n] - (n == first), room // n)
        times = 1
        while left > 0:
            m = min(times, left)
            steps.append((n, m, reach))
            reach |= (reach << (m * n)) & mask
            left -= m
            times *= 2
        if reach >> room & 1:
            break
    fill = reach.bit_length() - 1
    for n, m, before in reversed(steps):
        if not before >> fill & 1:
            used[n] = used.get(n, 0) + m
            fill -= m * n
    return used


class WindowPacker:
    """Holds remainders (document, start, ids) and yields sequences as lists of them."""

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.pool: dict[int, list] = {}
        self.lengths: list[int] = []
        self.size = 0

    def add(self, piece: tuple) -> None:
        n = len(piece[2]) // 4
        if n not in self.pool:
            self.pool[n] = []
            insort(self.lengths, n)
        self.pool[n].append(piece)
        self.size += 1

    def _take(self, n: int):
        same = self.pool[n]
        piece = same.pop()
        if not same:
            del self.pool[n]
            del self.lengths[bisect_left(self.lengths, n)]
        self.size -= 1
        return piece

    def windows(self, last: bool) -> Iterator[list]:
        while self.size > (0 if last else LOW_WATER):
            counts = {n: len(p) for n, p in self.pool.items()}
            while self.lengths:
                used = best_fill(self.lengths, counts, self.capacity)
                total = sum(n * m for n, m in used.items())
                if total < self.capacity and not last:
                    return
                window = [self._take(n) for n, m in used.items() for _ in range(m)]
                for n, m in used.items():
                    counts[n] -= m
                    if not counts[n]:
                        del counts[n]
                if total == self.capacity:
                    yield window
                    if not last and self.size <= LOW_WATER:
                        return
                    continue
                if self.lengths:  # cut the largest remainder to fill the slack
                    doc, start, ids = self._take(self.lengths[-1])
                    cut = 4 * (self.capacity - total)
                    window.append((doc, start, ids[:cut]))
                    self.add((doc, start + cut // 4, ids[cut:]))
                    yield window
                    break  # the counts changed
                yield from self._powers(window, total)

    @staticmethod
    def _powers(window: list, total: int) -> Iterator[list]:
        """The last tokens in sequences of falling powers of two."""
        room, out = 1 << (total.bit_length() - 1), []
        for doc, start, ids in window:
            while ids:
                head = ids[: 4 * room]
                out.append((doc, start, head))
                start, ids, room = start + len(head) // 4, ids[len(head) :], room - len(head) // 4
                total -= len(head) // 4
                if not room:
                    yield out
                    room, out = (1 << (total.bit_length() - 1)) if total else 0, []


_ENCODERS: dict[int, WordEncoder] = {}


def _encoder(tokenizer_json: str) -> WordEncoder:
    """One per Python worker and tokenizer: its memory of words outlives a task."""
    key = hash(tokenizer_json)
    if key not in _ENCODERS:
        _ENCODERS[key] = WordEncoder(tokenizer_json)
    return _ENCODERS[key]


def _pack_partition(batches, tokenizer, end_id: int, capacity: int, schema: pa.Schema):
    from pyspark import TaskContext

    enc = _encoder(tokenizer.value)
    end = end_id.to_bytes(4, "little")
    packer = WindowPacker(capacity)
    next_id = TaskContext.get().partitionId() << 40
    rows: list[tuple] = []
    held = 0

    def emit(window: list) -> None:
        nonlocal next_id, held
        at = 0
        for (doc, n_doc), start, ids in window:
            rows.append((doc, start, len(ids) // 4, ids, n_doc, next_id, at))
            at += len(ids) // 4
            held += len(ids)
        next_id += 1

    def batch() -> pa.RecordBatch:
        nonlocal held
        cols = zip(*rows) if rows else [[] for _ in schema]
        out = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema)], schema=schema)
        rows.clear()
        held = 0
        return out

    step = 4 * capacity
    for b in batches:
        for at in range(0, b.num_rows, 256):
            part = b.slice(at, 256)
            for doc, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                ids = enc.encode(text or "") + end
                key, whole = (doc, len(ids) // 4), len(ids) - len(ids) % step
                for k in range(0, whole, step):
                    emit([(key, k // 4, ids[k : k + step])])
                if whole < len(ids):
                    packer.add((key, whole // 4, ids[whole:]))
            if packer.size >= BLOCK:
                for w in packer.windows(last=False):
                    emit(w)
            if held > 8 << 20:
                yield batch()
    for w in packer.windows(last=True):
        emit(w)
        if held > 8 << 20:
            yield batch()
    yield batch()


def pack_documents(
    docs: DataFrame,
    tokenizer_path: str | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    end_id: int = END_ID,
    capacity: int = CAPACITY,
) -> DataFrame:
    """One row per piece: the id column, start, length, ids (binary, little-endian unsigned
    32-bit), doc_tokens, sequence_id, offset.

    A null or empty text is one piece with the end id alone.  Repeated rows and null ids
    are packed like any other row; other columns of ``docs`` are ignored.  An empty table
    gives no rows.  ``sequence_id`` is the partition number and a count inside it.
    """
    if tokenizer_path is None:
        import public_tokenizers

        tokenizer_path = public_tokenizers.path(TOKENIZER)
    spark = docs.sparkSession
    ship_package(spark)
    with open(tokenizer_path, encoding="utf-8") as f:
        tokenizer = spark.sparkContext.broadcast(f.read())  # a vocabulary of fixed size
    d = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    out = T.StructType(
        [
            T.StructField(id_col, d.schema["id"].dataType),
            T.StructField("start", T.LongType()),
            T.StructField("length", T.LongType()),
            T.StructField("ids", T.BinaryType()),
            T.StructField("doc_tokens", T.LongType()),
            T.StructField("sequence_id", T.LongType()),
            T.StructField("offset", T.LongType()),
        ]
    )
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(out)

    def run(batches):
        return _pack_partition(batches, tokenizer, end_id, capacity, arrow)

    return d.mapInArrow(run, out)


def op2_packing(spark, sf_dir):
    """Contract query: every piece of every document, with the checksum of its ids."""
    from skiff.llm.common import table

    p = pack_documents(table(spark, sf_dir, "documents"))
    return p.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
