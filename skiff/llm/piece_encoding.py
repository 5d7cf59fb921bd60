"""SentencePiece encoding and decoding for merge-type (BPE) vocabularies.

A text's symbols are merged in the order of an agenda of adjacent symbol pairs, best piece
score first, leftmost first among equals.  What no piece covers is spelt in byte pieces.
No piece of the vocabulary joins a character to a space behind it (checked when the model is
loaded), so the agenda of a text is that of its words, each with the spaces before it, and a
worker remembers the ids of the words it has met.  The agenda of a long word is a heap; short
words met for the first time are merged together, one row of pair places a word, of which the
first is taken again and again.

Encoding and decoding run in Arrow batches, one pass and no shuffle, and every batch is
checked against the sentencepiece library, which is asked once for each word a worker meets:
``agrees`` says whether it gives the same ids and the same text back.
"""

from __future__ import annotations

import re
from array import array
from heapq import heapify, heappop, heappush
from operator import add

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skiff.session import ship_package

MODEL = "piece_bpe_32k.model"
#: Words of a generation (a worker remembers two), and the longest that is remembered.
CACHED_WORDS, CACHED_CHARS = 300_000, 40
#: Characters handled at a time (one longer text goes alone).
CHUNK_CHARS = 1 << 20

#: Short words merged together at a time.
ROWS = 8192

_SPACE = "▁"  # a space inside pieces
_WORD = re.compile(" +[^ ]*")
_LEFT = (1 << 32) - 1
_NONE = np.iinfo(np.int64).max


class PieceCodec:
    """Ids of texts and texts of ids, by the pieces, scores and kinds of a model.

    Models with a normaliser other than identity (with a space put in front), with unused
    pieces, without byte pieces or with pieces that go on behind an inner space are refused.
    """

    def __init__(self, model: bytes):
        from sentencepiece import SentencePieceProcessor

        self.library = lib = SentencePieceProcessor(model_proto=model)
        if lib.normalize(" a  ﬁ\t") != f"{_SPACE}{_SPACE}a{_SPACE}{_SPACE}ﬁ\t":
            raise ValueError("only models with the identity normaliser and a leading space")
        self.ids: dict[str, int] = {}
        score: dict[str, float] = {}
        self.byte_ids = [0] * 256
        self.surface: list[str | int] = []  # of an id: its text, or its byte
        self.end = lib.eos_id()
        for i in range(lib.get_piece_size()):
            piece = lib.id_to_piece(i)
            if lib.is_byte(i):
                self.byte_ids[int(piece[1:-1], 16)] = i
                self.surface.append(int(piece[1:-1], 16))
            elif lib.is_control(i):
                self.surface.append("")
            elif lib.is_unknown(i):
                self.surface.append(" ⁇ ")
            elif lib.is_unused(i) or re.search(f"[^{_SPACE}]{_SPACE}", piece):
                raise ValueError(f"piece {piece!r}: unused, or with a space behind a character")
            else:
                piece = piece.replace(_SPACE, " ")
                score[piece], self.ids[piece] = lib.get_score(i), i
                self.surface.append(piece)
        if not all(self.byte_ids):
            raise ValueError("only models with byte pieces")
        # equal scores have one place, so that the leftmost pair is first
        places = {x: k << 32 for k, x in enumerate(sorted(set(score.values()), reverse=True), 1)}
        self.place = {piece: places[x] for piece, x in score.items()}
        self._tabulate(len(self.surface))
        # ids and text of the words met: the present and the former generation
        self._words: dict[str, tuple[bytes, str]] = {}
        self._older: dict[str, tuple[bytes, str]] = {}
        self.differ: set[str] = set()

    def _tabulate(self, n: int) -> None:
        """Symbol numbers of characters (a piece's id; above the ids if it is no piece itself;
        -1 if it is beyond ASCII and in no piece), and the pairs of symbols that make a piece."""
        symbols = dict(self.ids)
        self._ends = np.arange(2 * n + 1024)  # the id of a symbol that is left, -1 for several bytes
        self._ends[n:] = -1
        for c in [*map(chr, range(128)), *sorted({c for piece in self.ids for c in piece})]:
            if c not in symbols:
                symbols[c] = k = n + len(symbols)
                if c < "\x80":
                    self._ends[k] = self.byte_ids[ord(c)]
        self._letters = np.full(0x110000, -1, np.int64)
        for s, k in symbols.items():
            if len(s) == 1:
                self._letters[ord(s)] = k
        pairs = sorted(
            ((symbols[piece[:i]] << 32) + symbols[piece[i:]], self.place[piece], self.ids[piece])
            for piece in self.ids
            for i in range(1, len(piece))
            if piece[:i] in symbols and piece[i:] in symbols
        )
        self._keys, self._places, self._made = (np.array(c, np.int64) for c in zip(*pairs))

    def _look(self, left, right):
        """Place and piece of pairs of symbols; ``_NONE`` where they make none."""
        key = (left << 32) + right
        at = np.minimum(np.searchsorted(self._keys, key), len(self._keys) - 1)
        hit = (self._keys[at] == key) & (left >= 0) & (right >= 0)
        return np.where(hit, self._places[at], _NONE), self._made[at]

    def merge_many(self, words: list[str]) -> list[list[int] | bytes]:
        """Ids of many short stretches of text, merged together; what has symbols that are no
        pieces goes through ``merge``."""
        out: list = [None] * len(words)
        order = sorted(range(len(words)), key=lambda i: len(words[i]))
        for start in range(0, len(order), ROWS):
            rows = np.array(order[start : start + ROWS])
            width = max(2, len(words[rows[-1]]))
            text = "".join([words[i].ljust(width) for i in rows])
            sym = self._letters[np.frombuffer(text.encode("utf-32-le"), "<u4")].reshape(len(rows), width)
            size = np.array([len(words[i]) for i in rows])
            sym[np.arange(width) >= size[:, None]] = -2
            place, made = self._look(sym[:, :-1], sym[:, 1:])
            while len(rows):
                every = np.arange(len(rows))
                best = place.argmin(axis=1)
                done = place[every, best] == _NONE
                if done.any():
                    self._finish(words, rows[done], sym[done], out)
                    go = ~done
                    rows, sym, place, made, best = rows[go], sym[go], place[go], made[go], best[go]
                    every = every[: len(rows)]
                if not len(rows):
                    break
                # the pair becomes one symbol, what is behind moves up
                sym[every, best] = made[every, best]
                col = np.arange(sym.shape[1])
                at = np.minimum(col + (col > best[:, None]), col[-1])
                sym, place, made = (np.take_along_axis(x, at[:, : x.shape[1]].clip(max=x.shape[1] - 1), 1) for x in (sym, place, made))
                sym[:, -1] = -2
                place[:, -1] = _NONE
                for side in (best - 1, best):
                    k = np.flatnonzero((side >= 0) & (side < place.shape[1]))
                    c = side[k]
                    place[k, c], made[k, c] = self._look(sym[k, c], sym[k, c + 1])
        return out

    def _finish(self, words, rows, sym, out) -> None:
        held = sym >= 0
        sym = np.where(held, self._ends[sym], sym)
        odd = (sym == -1).any(axis=1)
        held &= sym >= 0
        ends = (4 * held.sum(axis=1).cumsum()).tolist()
        ids = sym[held].astype("<i4").tobytes()
        start = 0
        for i, end, strange in zip(rows.tolist(), ends, odd.tolist()):
            out[i] = self.merge(words[i]) if strange else ids[start:end]
            start = end

    def merge(self, word: str) -> list[int]:
        """Ids of one stretch of text (spaces as such), by the agenda.

        An entry is a pair's place by score and its left symbol in one number.  It is stale,
        and dropped, if the symbols there no longer make a pair of that place.
        """
        symbols = list(word)
        n = len(symbols)
        place = self.place.get
        before, behind = list(range(-1, n - 1)), list(range(1, n + 1))
        agenda = [r | i for i, pair in enumerate(map(add, word, word[1:])) if (r := place(pair))]
        heapify(agenda)
        while agenda:
            entry = heappop(agenda)
            left = entry & _LEFT
            right = behind[left]
            if right == n:
                continue
            piece = symbols[left] + symbols[right]
            if not symbols[left] or place(piece) != entry - left:
                continue
            symbols[left], symbols[right] = piece, ""
            after = behind[left] = behind[right]
            if after < n:
                before[after] = left
                if r := place(piece + symbols[after]):
                    heappush(agenda, r | left)
            first = before[left]
            if first >= 0 and (r := place(symbols[first] + piece)):
                heappush(agenda, r | first)
        out: list[int] = []
        for s in symbols:
            if s:
                known = self.ids.get(s)
                if known is None:
                    out.extend(self.byte_ids[b] for b in s.replace(" ", _SPACE).encode())
                else:
                    out.append(known)
        return out

    def spell(self, ids: list[int]) -> str:
        """Text of ids with the leading space left on; a byte that is part of no UTF-8
        character becomes U+FFFD."""
        try:
            return "".join(map(self.surface.__getitem__, ids))
        except TypeError:  # there are bytes
            pass
        out, run = [], bytearray()
        for i in [*ids, None]:
            s = "" if i is None else self.surface[i]
            if isinstance(s, int):
                run.append(s)
                continue
            while run:
                try:
                    out.append(run.decode())
                    run.clear()
                except UnicodeDecodeError as e:
                    out.append(run[: e.start].decode() + "�")
                    del run[: e.start + 1]
            out.append(s)
        return "".join(out).replace(_SPACE, " ")

    def decode(self, ids: list[int]) -> str:
        text = self.spell(ids)
        first = next((self.surface[i] for i in ids if self.surface[i] != ""), "")
        return text[1:] if isinstance(first, str) and first.startswith(" ") and first not in ("", " ⁇ ") else text

    def _entry(self, ids) -> tuple[bytes, str]:
        """``ids`` as a list or as bytes."""
        if isinstance(ids, list):
            return array("i", ids).tobytes(), self.spell(ids)
        return ids, self.spell(array("i", ids))

    def encode_texts(self, texts: list[str], check: bool = False) -> list[tuple[bytes, str]]:
        """Little-endian 32-bit ids of whole texts, and the texts they decode to.

        A word goes by its letters and all but the first of the spaces before it."""
        split = []
        for t in texts:
            words = t.replace(_SPACE, " ").split(" ") if t else []
            if "" in words:
                words = [w[1:] for w in _WORD.findall(" " + t.replace(_SPACE, " "))]
            split.append(words)
        known, older = self._words, self._older
        fresh, long = {}, {}
        for words in split:
            for w in words:
                if w not in known and w not in fresh and w not in long:
                    if w in older:
                        known[w] = older[w]
                    elif len(w) < CACHED_CHARS:
                        fresh[w] = None
                    else:
                        long[w] = self._entry(self.merge(" " + w))
        fresh = dict(zip(fresh, map(self._entry, self.merge_many([" " + w for w in fresh]))))
        if check:
            self._check_words({**fresh, **long})
        known.update(fresh)
        if long:
            known = {**known, **long}
        get = known.__getitem__
        out = []
        for words in split:
            got = list(map(get, words))
            out.append((b"".join([g[0] for g in got]), "".join([g[1] for g in got])[1:]))
        if len(self._words) >= CACHED_WORDS:
            self._older, self._words = self._words, {}
        return out

    def _check_words(self, entries: dict[str, tuple[bytes, str]]) -> None:
        """Ask the library for words met for the first time; those on which it differs stay
        in ``differ``."""
        entries.pop("", None)  # a space alone: no text is just that

        def same(words: list[str]) -> bool:
            theirs = self.library.encode(" ".join(words), num_threads=1)
            if array("i", theirs).tobytes() != b"".join([entries[w][0] for w in words]):
                return False
            return self.library.decode(theirs) == "".join([entries[w][1] for w in words])[1:]

        words = list(entries)
        if words and not same(words):
            self.differ.update(w for w in words if not same([w]))

    def agrees(self, texts: list[str], ids: list[bytes], decoded: list[str]) -> list[bool]:
        """Whether the library gives the same ids (with an end id) and the same text back.

        A text's ids are those of its words, so the library was asked once for each word the
        worker met, and is asked for whole texts if it ever differed on one.
        """
        if not self.differ:
            return [True] * len(texts)
        theirs = self.library.encode(texts, add_eos=True, num_threads=1)
        back = self.library.decode(theirs, num_threads=1)
        return [array("i", t).tobytes() == i and b == d for t, b, i, d in zip(theirs, back, ids, decoded)]


_CODECS: dict[int, PieceCodec] = {}


def _codec(model: bytes) -> PieceCodec:
    """One per Python worker and model: its memory of words outlives a task."""
    key = hash(model)
    if key not in _CODECS:
        _CODECS[key] = PieceCodec(model)
    return _CODECS[key]


def _chunks(texts: list[str]):
    """Stretches of the list of about ``CHUNK_CHARS`` characters."""
    start = size = 0
    for i, t in enumerate(texts):
        if i > start and size + len(t) > CHUNK_CHARS:
            yield start, i
            start, size = i, 0
        size += len(t)
    if start < len(texts):
        yield start, len(texts)


def encode_documents(docs: DataFrame, model_path: str | None = None, id_col: str = "doc_id", text_col: str = "text", check: bool = True) -> DataFrame:
    """The id column, ``ids`` (array<int>, an end id last), ``decoded`` and ``agrees`` per row.

    A null or empty text has the end id alone and decodes to the empty text.  Repeated rows
    and null ids are rows like any other; other columns of ``docs`` are ignored; an empty
    table gives no rows.  Without ``check`` the library is not asked and ``agrees`` is null.
    """
    if model_path is None:
        import public_tokenizers

        model_path = public_tokenizers.path(MODEL)
    spark = docs.sparkSession
    ship_package(spark)
    with open(model_path, "rb") as f:
        model = spark.sparkContext.broadcast(f.read())  # a vocabulary of fixed size
    d = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    out = T.StructType(
        [
            T.StructField(id_col, d.schema["id"].dataType),
            T.StructField("ids", T.ArrayType(T.IntegerType(), False)),
            T.StructField("decoded", T.StringType()),
            T.StructField("agrees", T.BooleanType()),
        ]
    )

    def run(batches):
        codec = _codec(model.value)
        end = np.array([codec.end], "<i4").tobytes()
        for b in batches:
            texts = [t or "" for t in b.column(1).to_pylist()]
            for start, stop in _chunks(texts):
                part = texts[start:stop]
                got = codec.encode_texts(part, check)
                ids, decoded = [i + end for i, _ in got], [s for _, s in got]
                offsets = np.zeros(len(part) + 1, np.int32)
                np.cumsum([len(i) // 4 for i in ids], out=offsets[1:])
                values = pa.Array.from_buffers(pa.int32(), int(offsets[-1]), [None, pa.py_buffer(b"".join(ids))])
                lists = pa.ListArray.from_arrays(pa.array(offsets), values, type=pa.list_(pa.field("element", pa.int32(), False)))
                agrees = codec.agrees(part, ids, decoded) if check else [None] * len(part)
                cols = [b.column(0).slice(start, stop - start), lists, pa.array(decoded, pa.string()), pa.array(agrees, pa.bool_())]
                yield pa.RecordBatch.from_arrays(cols, names=out.names)

    return d.mapInArrow(run, out)


def op11_piece_encoding(spark, sf_dir):
    """Contract query: counts and digests of every document's ids and decoded text."""
    from skiff.llm.common import table

    e = encode_documents(table(spark, sf_dir, "documents"))
    return e.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
        "agrees",
    )
