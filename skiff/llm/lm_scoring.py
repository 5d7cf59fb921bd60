"""LM scoring by logistic context mixing.

The model predicts a token's bytes bit by bit.  For each of several orders a hashed context
(the bytes before, back to the token's start) has counts of zeros and ones over all training
tokens.  The predictors' stretched probabilities are combined by weights that gates choose,
learnt online with every token's own count taken out of what it is predicted from, and the
mix is refined by an adaptive table.  That mix depends on the token alone, so it is computed
once per distinct token and joined to the documents.

The word before a token is a context of its own: the token's probability behind it is the
discounted share of its occurrences there among all training texts, and what the discounts
leave is shared out by the mix (absolute discounting, the discount from the pairs seen once
and twice).  Of the log probability of a text, one part depends on each token alone, the
other on those pairs that occur in training texts, so both are joined to the documents.

A document's tokens are its words (A-Z lower-cased, split at ASCII white space) and one end.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter, defaultdict
from contextlib import contextmanager
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skiff import files
from skiff.llm.common import fold_of, table
from skiff.session import materialize, ship_package

#: (bytes of context, log2 of the table's slots) of each predictor; 0 bytes: the whole token
#: so far.  These sizes serve ``ROOM`` distinct training tokens; ``sized`` has those for more.
ORDERS = ((1, 14), (2, 17), (3, 18), (4, 20), (6, 21), (0, 18))
ROOM = 1 << 18
#: A table grows with this power of the distinct tokens, which is what its contexts do
#: (measured from 0.12 to 0.46 M tokens: 0.64 for six bytes, less for fewer), up to
#: 2^MOST_BITS slots (128 MB); from there on contexts share slots more and more.
GROWTH, MOST_BITS = 0.64, 24
#: The whole token's context of at most so many bytes is counted in the table that all tasks
#: hold; a longer one where the tokens with the same class and so many first bytes are.
SHORT = 4
STARTS = np.cumsum([0, *(1 << bits for _, bits in ORDERS)])
SLOTS = int(STARTS[-1])
SEGMENT = 1 << 14
#: About so many distinct tokens meet in a task of the online pass, as their whole contexts'
#: table is held beside the one for all.
TASK_TOKENS = 1 << 17
#: Commonest tokens whose costs every task holds; all others are joined.
COMMON_TOKENS = 300_000
#: Commonest pairs of neighbours whose gains every task holds; all others are joined.
COMMON_PAIRS = 1_000_000
#: Distinct pairs a counting task holds before it passes them on.
HELD_PAIRS = 1 << 20
#: Tokens of the documents whose questions to the model a scoring task packs at one time.
HELD_SCORED = 1 << 19
#: Names of words a task remembers.
HELD_NAMES = 1 << 17
#: Least buckets that pairs and uncommon tokens are dealt to; there is one for every
#: million training tokens.
BUCKETS = 32
#: Bits of a common token's number; other names have the top bit set.
_NUMBER, _TOP = np.uint64(20), 1 << 63
_RARE = np.uint64(_TOP)
#: First byte of a pair's key, which no token holds; a token's is its class.
PAIR = b"\xff"
#: The end of a document; no word holds a line end.
END = b"\n"
#: Distinct tokens a counting task holds before it passes them on.
HELD_TOKENS = 400_000
#: A document's class is its commonest UTF-8 continuation byte, 0 if it has none: a coarse
#: sign of language and script that needs no training.  It is a token's first context byte.
CLASSES = 65
#: Occurrences that the shorter context's estimate counts for.
PRIOR = 0.4

# Bytes as bits: 31 bytes that are common in the tokens of Latin-script text have codes of
# five bits, in this order; the 32nd code is followed by seven bits for the first 31 of the
# other 225 bytes and by eight for the rest.  No code is left unused, so the bits of a byte
# share out all probability.
_COMMON = b" \netaoinshrdlucmfwypvbgkjqxz,.\xc3"
_LENGTH, _CODE = np.empty(256, np.int64), np.empty(256, np.int64)
for _k, _byte in enumerate(_COMMON):
    _LENGTH[_byte], _CODE[_byte] = 5, _k
for _k, _byte in enumerate(sorted({*range(256)} - {*_COMMON})):
    _LENGTH[_byte], _CODE[_byte] = (12, (31 << 7) | _k) if _k < 31 else (13, (31 << 8) | (_k + 31))
_PLACES, _BITS = 8, 13

_BUCKETS = 24
_RATE = 0.05
_MUL = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: str | None) -> tuple[int, list[bytes]]:
    """The text's class and its words."""
    raw = (text or "").encode("utf-8", "replace")
    count = np.bincount(np.frombuffer(raw, np.uint8), minlength=0xC0)[0x80:0xC0]
    return (int(count.argmax()) + 1 if count.any() else 0), raw.lower().split()


def sized(distinct: int) -> tuple[tuple[int, int], ...]:
    """``ORDERS`` with tables that grow with the distinct training tokens, each to what all
    contexts of its bytes can fill or to ``MOST_BITS``."""
    more = math.ceil(max(0.0, GROWTH * math.log2(max(distinct, 1) / ROOM)))
    return tuple((n, min(bits + more, MOST_BITS, 8 * (n or SHORT) + 8)) for n, bits in ORDERS)


def _slots_of(sizes) -> int:
    return sum(1 << bits for _, bits in sizes)


def _first_met(raw: np.ndarray, width: np.ndarray, place: np.ndarray) -> np.ndarray:
    """For every byte the first of those bytes that stand behind the same beginning, as far as
    each token shares it with the one before; of sorted tokens that finds all of them."""
    first = np.cumsum(width) - width
    owner = np.repeat(np.arange(len(width)), width)
    there = np.minimum(np.r_[0, first[:-1]][owner] + place, len(raw) - 1)
    alike = (owner > 0) & (place < np.r_[0, width[:-1]][owner]) & (raw[there] == raw)
    differs = np.minimum.reduceat(np.where(alike, len(raw), place), first)
    # place by place, a shared byte follows the one of the token before
    order = np.argsort(place.astype(np.uint16) if width.max() < 1 << 16 else place, kind="stable")
    met = np.empty(len(raw), np.int64)
    met[order] = order[np.maximum.accumulate(np.where((place < differs[owner])[order], 0, np.arange(len(raw))))]
    return met


def _events(tokens: list[bytes], sizes=ORDERS, near_bits: int = 0, shared: bool = False, orders=None) -> tuple[np.ndarray, ...]:
    """For every bit of every token's bytes and terminator: token number, bit, slot of each
    order (into one table for all) and gate (byte position and bit position).  A token is
    its class byte and its bytes; the class is given, not predicted.  With ``near_bits`` the
    whole token's contexts of more than ``SHORT`` bytes have slots of a table of that size,
    numbered from the end of the table for all.

    ``shared``: the bits of a beginning that neighbouring tokens share come once.  Then the
    first array has numbers of bytes, and two more have the token and that number of every
    byte of every token.  The slots of no others than ``orders`` are filled in, if given."""
    ended = [t if t.endswith(END) else t + b" " for t in tokens]
    raw = np.frombuffer(b"".join(ended), np.uint8)
    width = np.fromiter(map(len, ended), np.int64, len(tokens))
    place = np.arange(len(raw)) - np.repeat(np.cumsum(width) - width, width)
    mixed = raw.astype(np.uint64) + np.uint64(1)
    live = place > 0
    if shared:
        met = _first_met(raw, width, place)
        every, live = live, live & (met == np.arange(len(raw)))
    seat = np.flatnonzero(live)
    deep = place[seat]
    history, acc = {}, np.zeros(len(seat), np.uint64)
    for back in range(1, max(n for n, _ in sizes) + 1):
        before = mixed[seat - np.minimum(back, deep)]
        before[deep < back] = 0  # before the class byte
        acc = (acc ^ before) * _MUL
        acc ^= acc >> np.uint64(29)
        history[back] = acc
    # the whole token so far: differences of running sums of bytes times a factor of their place
    factor = (np.arange(1, int(width.max()) + 2, dtype=np.uint64) * _MUL) | np.uint64(1)
    factor ^= factor >> np.uint64(31)
    run = np.cumsum(mixed * mixed * factor[place] * _MUL, dtype=np.uint64)
    run -= mixed * mixed * factor[place] * _MUL
    first = np.cumsum(width) - width
    of = np.repeat(np.arange(len(tokens)), width)
    history[0] = (run[seat] - run[first][of[seat]]) * _MUL
    byte = raw[seat]
    length, code = _LENGTH[byte], _CODE[byte]
    at = np.repeat(np.arange(len(byte)), length)
    j = np.arange(len(at)) - np.repeat(np.cumsum(length) - length, length)
    left = length[at] - j
    code = code[at]
    bit = (code >> (left - 1)) & 1
    node = ((np.int64(1) << j) | (code >> left)).astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
    owner = at if shared else of[seat][at]
    slots = np.empty((len(sizes), len(at)), np.int32)
    start = 0
    for k, (n, size) in enumerate(sizes):
        if orders is not None and k not in orders:
            start += 1 << size
            continue
        h = history[n][at]
        h += node
        h *= _MUL
        h ^= h >> np.uint64(31)
        h *= _MUL
        slots[k] = h >> np.uint64(64 - size)
        slots[k] += start
        start += 1 << size
        if n == 0 and near_bits:
            far = deep[at] > SHORT
            slots[k][far] = (h[far] >> np.uint64(64 - near_bits)).astype(np.int32) + _slots_of(sizes)
    gate = np.minimum(deep - 1, _PLACES - 1)[at] * _BITS + j
    if shared:
        return owner, bit, slots, gate, of[every], (np.cumsum(live) - 1)[met[every]]
    return owner, bit, slots, gate


def count_bits(tokens: list[bytes], counts: np.ndarray, table: np.ndarray, orders: range | list[int], sizes=ORDERS, near_bits: int = 0, start: int = 0) -> None:
    """Add the tokens' bits, weighted by count, to ``table`` (slot x zeros and ones), which
    begins with slot ``start``; with ``near_bits`` without the slots of the other table."""
    owner, bit, slots, _, of, byte = _events(tokens, sizes, near_bits, shared=True, orders=orders)
    weight = np.bincount(byte, counts[of])[owner].astype(table.dtype)
    flat = table.reshape(-1)
    for k in orders:
        at, add = (slots[k].astype(np.int64) - start) * 2 + bit, weight
        if near_bits and k == len(sizes) - 1:
            here = at < len(flat)
            at, add = at[here], weight[here]
        np.add.at(flat, at, add)


def count_whole(pieces, sizes) -> tuple[np.ndarray, int]:
    """Table of the whole tokens' contexts of more than ``SHORT`` bytes, and its log2 slots,
    from all (tokens, counts) that share their first bytes; its size follows theirs."""
    room = sum(max(len(t) - SHORT, 0) for tokens, _ in pieces for t in tokens)
    bits = max(10, math.ceil(math.log2(room * 8 + 1)))
    near = np.zeros((1 << bits, 2), np.uint32)
    for tokens, counts in pieces:
        owner, bit, slots, _, of, byte = _events(tokens, (sizes[-1],), bits, shared=True)
        at = slots[0].astype(np.int64) - (1 << sizes[-1][1])
        deep = at >= 0
        np.add.at(near.reshape(-1), at[deep] * 2 + bit[deep], np.bincount(byte, counts[of])[owner[deep]].astype(np.uint32))
    floats = near.view(np.float32)  # in the same memory
    for at in range(0, len(near), SEGMENT):
        floats[at : at + SEGMENT] = near[at : at + SEGMENT]
    return floats, bits


@dataclass
class Mixer:
    """Weights by gate and the refining table (gate x bucket x ones and all)."""

    weights: list[np.ndarray]
    refine: np.ndarray

    @classmethod
    def new(cls) -> Mixer:
        # at first the longest context but one speaks, helped by the whole token
        start = np.zeros(len(ORDERS) + 1, np.float32)
        start[len(ORDERS) - 1] = 0.5
        # the table starts as the identity with a little weight
        centre = 1 / (1 + np.exp(-(np.arange(_BUCKETS) - (_BUCKETS - 1) / 2)))
        refine = np.stack([np.tile(centre * 8, (_PLACES * _BITS, 1)), np.full((_PLACES * _BITS, _BUCKETS), 8.0)], axis=2)
        return cls([np.tile(start, (n, 1)) for n in (16 * 8, _PLACES * _BITS)], refine)

    def mix(self, n0: np.ndarray, n1: np.ndarray, gate: np.ndarray):
        """(inputs, gates, stretched mix) of events from their orders' counts."""
        x = np.empty((len(n0) + 1, n0.shape[1]), np.float32)
        # each order's estimate leans on the shorter context's, the more the less it has seen
        p = np.full(n0.shape[1], 0.5, np.float32)
        for k in range(len(n0)):
            p = (n1[k] + np.float32(PRIOR) * p) / (n0[k] + n1[k] + np.float32(PRIOR))
            x[k] = p
        np.clip(x[:-1], 1e-6, 1 - 1e-6, out=x[:-1])
        np.log(x[:-1] / (1 - x[:-1]), out=x[:-1])
        x[-1] = 0.3
        seen, whole = n0[-2] + n1[-2], n0[-1] + n1[-1]
        level = np.minimum(np.log2(seen + 1), 15).astype(np.int64) * 8 + np.minimum(np.log2(whole + 1), 7).astype(np.int64)
        gates = [level, gate]
        z = np.zeros(n0.shape[1], np.float32)
        for k in range(len(x)):
            z += x[k] * (self.weights[0][:, k].astype(np.float32)[level] + self.weights[1][:, k].astype(np.float32)[gate])
        return x, gates, np.clip(z, -13, 13)

    def _buckets(self, z: np.ndarray):
        at = np.clip(z + (_BUCKETS - 1) / 2, 0, _BUCKETS - 1.001)
        low = at.astype(np.int64)
        return low, at - low

    def probability(self, z: np.ndarray, gate: np.ndarray) -> np.ndarray:
        """The mix refined: its mean with the interpolated table."""
        low, part = self._buckets(z)
        ratio = self.refine[:, :, 0] / self.refine[:, :, 1]
        refined = ratio[gate, low] * (1 - part) + ratio[gate, low + 1] * part
        p = 0.7 / (1 + np.exp(-z.astype(np.float64))) + 0.3 * refined
        return np.clip(p, 1e-6, 1 - 1e-6)

    def learn(self, x, gates, z, bit, weight) -> None:
        """One step on a batch of events, each weighted."""
        p = 1 / (1 + np.exp(-z))
        err = (bit - p) * weight
        for w, g in zip(self.weights, gates):
            total = np.bincount(g, weight, len(w)) + 1e-9
            step = np.stack([np.bincount(g, err * row, len(w)) for row in x], axis=1) / total[:, None]
            w += (_RATE * step * np.minimum(1.0, total / 20)[:, None]).astype(w.dtype)
        low, part = self._buckets(z)
        flat = gates[1] * _BUCKETS + low
        size = self.refine.shape[0] * _BUCKETS
        for side, share in ((0, 1 - part), (1, part)):
            self.refine[:, :, 0] += np.bincount(flat + side, share * weight * bit, size)[:size].reshape(-1, _BUCKETS)
            self.refine[:, :, 1] += np.bincount(flat + side, share * weight, size)[:size].reshape(-1, _BUCKETS)


class Counts:
    """The table of counts in two bytes a count; the few larger ones stand apart."""

    MOST = (1 << 16) - 1

    def __init__(self, slots: int):
        self.small = np.zeros((slots, 2), np.uint16)
        self.at, self.large = np.empty(0, np.int64), np.empty(0, np.float32)

    def __len__(self) -> int:
        return len(self.small)

    def put(self, start: int, counts: np.ndarray) -> None:
        """The counts of the slots from ``start`` on; later calls have later slots."""
        self.small[start : start + len(counts)] = np.minimum(counts, self.MOST)
        at = np.flatnonzero(counts.reshape(-1) >= self.MOST)
        self.at = np.r_[self.at, start * 2 + at]
        self.large = np.r_[self.large, counts.reshape(-1)[at].astype(np.float32)]

    def take(self, slots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        # a slot's two counts are fetched as one number
        both = np.take(self.small.view("<u4")[:, 0], slots)
        out = (both & self.MOST).astype(np.float32), (both >> 16).astype(np.float32)
        for side, n in enumerate(out):
            far = n == self.MOST
            n[far] = self.large[np.searchsorted(self.at, slots[far].astype(np.int64) * 2 + side)]
        return out


def _gather(table: np.ndarray | Counts, slots: np.ndarray, near: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    def take(some):
        if isinstance(table, Counts):
            return table.take(some)
        both = np.take(table.view(np.complex64)[:, 0], some)
        return np.ascontiguousarray(both.real), np.ascontiguousarray(both.imag)

    if near is None:
        return take(slots)
    deep = slots[-1] >= len(table)
    n0, n1 = take(np.where(deep & (np.arange(len(slots)) == len(slots) - 1)[:, None], 0, slots))
    both = near.view(np.complex64)[:, 0][slots[-1][deep] - len(table)]
    n0[-1, deep], n1[-1, deep] = both.real, both.imag
    return n0, n1


def train_mixer(table: np.ndarray, tokens: list[bytes], counts: np.ndarray, mixer: Mixer, whole_from: int, batch: int = 512, sizes=ORDERS, near=(None, 0)) -> None:
    """Online over the tokens: one occurrence of a token is taken out of the counts it is
    predicted from, and the step is weighted by a power of its count.  The whole-token
    table holds tokens of at least ``whole_from`` occurrences.  ``near`` is what
    ``count_whole`` made of them."""
    for at in range(0, len(tokens), batch):
        some, n = tokens[at : at + batch], counts[at : at + batch]
        # a step is a sum over its tokens, so their order is free and equal bits are one event
        # of their weights' sum, unless the whole tokens' counts differ in what is taken out
        alike = n.min() >= whole_from or n.max() < whole_from
        if alike:
            order = sorted(range(len(some)), key=some.__getitem__)
            some, n = [some[k] for k in order], n[order]
        owner, bit, slots, gate, *of = _events(some, sizes, near[1], shared=alike)
        n0, n1 = _gather(table, slots, near[0])
        out0, out1 = (bit == 0).astype(np.float32), (bit == 1).astype(np.float32)
        whole = np.float32(n[0] >= whole_from) if alike else (n[owner] >= whole_from).astype(np.float32)
        n0[:-1] -= out0
        n1[:-1] -= out1
        n0[-1] -= whole * out0
        n1[-1] -= whole * out1
        np.maximum(n0, 0, out=n0)
        np.maximum(n1, 0, out=n1)
        x, gates, z = mixer.mix(n0, n1, gate)
        weight = n.astype(np.float64) ** 0.8
        mixer.learn(x, gates, z, bit, np.bincount(of[1], weight[of[0]])[owner] if alike else weight[owner])


def token_costs(table: np.ndarray, mixer: Mixer, tokens: list[bytes], sizes=ORDERS, near=(None, 0)) -> np.ndarray:
    """log10 probability of each token, its class given."""
    owner, bit, slots, gate, of, byte = _events(tokens, sizes, near[1], shared=True)
    _, gates, z = mixer.mix(*_gather(table, slots, near[0]), gate)
    p = mixer.probability(z, gates[1])
    return np.bincount(of, np.bincount(owner, np.log10(np.where(bit == 1, p, 1 - p)))[byte], len(tokens))


# --- the Spark side -----------------------------------------------------------------------


def _count_tokens(batches):
    """Classed tokens (class byte, then the token) and their counts in training texts."""
    schema = pa.schema([("token", pa.binary()), ("n_train", pa.int64())])

    every, train = defaultdict(set), defaultdict(Counter)

    def taken():
        """All held tokens, marked by their class; the memory starts anew."""
        kinds = {**every, **train}
        for kind in kinds:
            mark = bytes([kind])
            counts = train.get(kind, {})
            words = every.get(kind, set()) | counts.keys()
            yield pa.RecordBatch.from_arrays(
                [pa.array([mark + w for w in words], pa.binary()), pa.array([counts.get(w, 0) for w in words], pa.int64())], schema=schema
            )
        every.clear()
        train.clear()

    for b in batches:
        for at in range(0, b.num_rows, 256):
            part = b.slice(at, 256)
            for held, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                kind, words = words_of(text)
                words.append(END)
                (every if held else train)[kind].update(words)
            if sum(map(len, every.values())) + sum(map(len, train.values())) > HELD_TOKENS:
                yield from taken()
    yield from taken()


class _Names(dict):
    """Names of a class's words: common tokens have numbers, the others the 64-bit hash that
    Spark's ``xxhash64`` has of the classed token, with the top bit set."""

    def __init__(self, kind: int, numbers: dict[bytes, int]):
        self.mark, self.numbers = bytes([kind]), numbers

    def __missing__(self, word: bytes) -> int:
        import xxhash

        name = self.numbers.get(word)
        if name is None:
            name = xxhash.xxh64_intdigest(self.mark + word, 42) | _TOP
        self[word] = name
        return name


def _names_of(kind: int, words: list[bytes], numbers: dict[int, dict[bytes, int]], held: dict[int, _Names]) -> np.ndarray:
    """Names of the class alone, as what stands before the first token, and of the tokens."""
    if sum(map(len, held.values())) > HELD_NAMES:
        held.clear()
    if kind not in held:
        held[kind] = _Names(kind, numbers.get(kind, {}))
    return np.fromiter(map(held[kind].__getitem__, [b"", *words]), np.uint64, len(words) + 1)


def _pair_keys(p: np.ndarray, w: np.ndarray) -> np.ndarray:
    """One key of two names: both numbers, or a hash with the top bit set."""
    key = (p * _MUL) ^ ((w << np.uint64(17)) | (w >> np.uint64(47)))
    key ^= key >> np.uint64(29)
    key *= _MUL
    key ^= key >> np.uint64(31)
    return np.where((p | w) < _RARE, (p << _NUMBER) | w, key | _RARE)


def _bucket_of(keys: np.ndarray, buckets: int) -> np.ndarray:
    return ((keys * _MUL) >> np.uint64(40)) % np.uint64(buckets)


def _by_bucket(bucket: np.ndarray):
    """Each bucket met and the places of its rows, in their order."""
    order = np.argsort(bucket.astype(np.uint16) if len(bucket) and bucket.max() < 1 << 16 else bucket, kind="stable")
    dealt = bucket[order]
    for a, b in zip(first := np.flatnonzero(np.r_[True, dealt[1:] != dealt[:-1]][: len(dealt)]), [*first[1:], len(dealt)]):
        yield int(dealt[a]), order[a:b]


def _pack(values: np.ndarray) -> bytes:
    """Whole numbers of at least 0, compressed byte by byte of the numbers."""
    width = max(1, (int(values.max()).bit_length() + 7) // 8) if len(values) else 1
    planes = np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T)
    return len(values).to_bytes(8, "little") + bytes([width]) + pa.compress(planes.tobytes(), "zstd", asbytes=True)


def _unpack(packed: bytes) -> np.ndarray:
    n, width = int.from_bytes(packed[:8], "little"), packed[8]
    rows = np.zeros((n, 8), np.uint8)
    rows[:, :width] = np.frombuffer(pa.decompress(packed[9:], n * width, "zstd", asbytes=True), np.uint8).reshape(width, n).T
    return rows.reshape(-1).view("<u8").astype(np.uint64)


def _pack_sorted(values: np.ndarray) -> bytes:
    return _pack(np.diff(values, prepend=np.uint64(0)))


def _unpack_sorted(packed: bytes) -> np.ndarray:
    return np.cumsum(_unpack(packed), dtype=np.uint64)


def _sums(keys: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, ...]:
    """The distinct of sorted ``keys``, the sums of the values of each, and where each begins."""
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]][: len(keys)])
    return keys[first], *(np.add.reduceat(v, first) if len(keys) else v for v in values), first


_COUNTED = "bucket int, keys binary, n binary, p binary, w binary, m binary"


def _counted_row(bucket: int, keys: np.ndarray, n: np.ndarray, p: np.ndarray, w: np.ndarray, m: np.ndarray) -> list:
    """Pairs of one bucket: of two numbers the sorted keys, else both names, and their counts."""
    return [bucket, _pack_sorted(keys), _pack(n), _pack(p), _pack(w), _pack(m)]


def _counted_batch(rows: list) -> pa.RecordBatch:
    kinds = [pa.int32(), *[pa.binary()] * 5]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=["bucket", "keys", "n", "p", "w", "m"])


def _pair_counter(names, buckets: int):
    """Neighbours in training texts, packed by bucket: names of both and their count."""

    def run(batches):
        _TABLES.clear()  # a worker may still hold the table of the bits
        numbers, held, kept, size = _numbered(names.value), {}, [], 0

        def out():
            p, w = np.concatenate([h[:-1] for h in kept]), np.concatenate([h[1:] for h in kept])
            kept.clear()
            keys = _pair_keys(p, w)
            order = np.argsort(keys)
            keys, n, first = _sums(keys[order], np.ones(len(keys), np.int64))
            p, w = p[order[first]], w[order[first]]
            for bucket, at in _by_bucket(_bucket_of(keys, buckets)):
                near, far = np.split(at, [np.searchsorted(keys[at], _RARE)])
                yield _counted_batch([_counted_row(bucket, keys[near], n[near], p[far], w[far], n[far])])

        for b in batches:
            for at in range(0, b.num_rows, 256):
                for text in b.column(0).slice(at, 256).to_pylist():
                    kind, words = words_of(text)
                    words.append(END)
                    kept.append(_names_of(kind, words, numbers, held))
                    size += len(words)
                if size > HELD_PAIRS:
                    yield from out()
                    size = 0
        if kept:
            yield from out()

    return run


def _numbers_of(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return keys >> _NUMBER, keys & np.uint64((1 << int(_NUMBER)) - 1)


def _sum_pairs(batches):
    """Each bucket's pairs and their counts; rows come sorted by bucket, so one is held."""
    current, rows = None, []

    def out():
        many = [x[2:] for x in rows]
        keys = np.concatenate([_unpack_sorted(x[0]) for x in rows])
        n = np.concatenate([_unpack(x[1]) for x in rows])
        rows.clear()
        order = np.argsort(keys)
        keys, n, _ = _sums(keys[order], n[order])
        p, w, m = (np.concatenate([_unpack(x[k]) for x in many]) for k in range(3))
        far = _pair_keys(p, w)
        order = np.argsort(far)
        _, m, first = _sums(far[order], m[order])
        return _counted_batch([_counted_row(current, keys, n, p[order[first]], w[order[first]], m)])

    for b in batches:
        for bucket, *row in zip(*(c.to_pylist() for c in b.columns)):
            if bucket != current and rows:
                yield out()
            current = bucket
            rows.append(row)
    if rows:
        yield out()


def _count_behind(batches):
    """For each name and bucket: the distinct tokens behind it and their occurrences."""
    for b in batches:
        for _, k, m, rare_p, _, rare_n in zip(*(c.to_pylist() for c in b.columns)):
            p, n = np.concatenate([_numbers_of(_unpack_sorted(k))[0], _unpack(rare_p)]), np.concatenate([_unpack(m), _unpack(rare_n)]).astype(np.int64)
            order = np.argsort(p, kind="stable")
            p, t, n, _ = _sums(p[order], np.ones(len(p), np.int64), n[order])
            for at in range(0, len(p), 100_000):
                part = slice(at, at + 100_000)
                yield pa.RecordBatch.from_arrays([pa.array(p[part].view(np.int64)), pa.array(t[part]), pa.array(n[part])], names=["p", "t", "n_p"])


def _rare_pairs(batches):
    """The pairs that are not of two numbers."""
    for b in batches:
        for p, w, n in zip(*(c.to_pylist() for c in b.columns)):
            p, w, n = _unpack(p).view(np.int64), _unpack(w).view(np.int64), _unpack(n).astype(np.int64)
            for at in range(0, len(p), 100_000):
                part = slice(at, at + 100_000)
                yield pa.RecordBatch.from_arrays([pa.array(p[part]), pa.array(w[part]), pa.array(n[part])], names=["p", "w", "n"])


#: Rows of a bucket: what the model has (``chunk`` -1), then what each chunk of documents asks.
_PACKED = "bucket int, side int, chunk long, a binary, b binary, c binary"
_NUMBERED, _HASHED, _TOKENS, _PAIRS, _WORDS, _OWN = range(6)


def _packed_batch(rows: list) -> pa.RecordBatch:
    kinds = [pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=["bucket", "side", "chunk", "a", "b", "c"])


def _floats(values: np.ndarray) -> bytes:
    return _pack(values.astype("<f8").view("<u8"))


def _unfloats(packed: bytes) -> np.ndarray:
    return _unpack(packed).view(np.float64)


def _pack_gains(buckets: int):
    """(p, w, n, gain) of pairs packed by bucket."""

    def out(kept):
        p, w, n, gain = (np.concatenate(c) for c in zip(*kept))
        keys = _pair_keys(p, w)
        order = np.argsort(keys)
        keys, n, gain = keys[order], n[order], gain[order]
        for bucket, at in _by_bucket(_bucket_of(keys, buckets)):
            yield _packed_batch([[bucket, _HASHED, -1, _pack_sorted(keys[at]), _pack(n[at]), _floats(gain[at])]])

    def run(batches):
        kept, size = [], 0
        for b in batches:
            p, w, n, gain = (c.to_numpy(zero_copy_only=False) for c in b.columns)
            kept.append((p.view(np.uint64), w.view(np.uint64), n, gain))
            size += len(p)
            if size > HELD_PAIRS // 2:
                yield from out(kept)
                kept, size = [], 0
        if size:
            yield from out(kept)

    return run


def _gains_of(side: int, a: bytes, b: bytes, c: bytes | None, behind: np.ndarray, cost: np.ndarray, discount: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys, counts and gains of a packed row of the model."""
    keys, n = _unpack_sorted(a), _unpack(b).astype(np.int64)
    if side == _HASHED:
        return keys, n, _unfloats(c)
    p, w = _numbers_of(keys)
    return keys, n, np.log10(1 + (n - discount) / (discount * behind[p] * 10.0 ** cost[w]))


def _pair_tokens(keys: np.ndarray) -> pa.Array:
    """Keys as binary values that no token has."""
    rows = np.empty((len(keys), 9), np.uint8)
    rows[:, 0] = PAIR[0]
    rows[:, 1:] = keys.astype("<u8").view(np.uint8).reshape(-1, 8)
    return pa.FixedSizeBinaryArray.from_buffers(pa.binary(9), len(keys), [None, pa.py_buffer(rows.tobytes())]).cast(pa.binary())


def _pieces(batch: pa.RecordBatch, size: int):
    """(tokens, counts) of at most ``size`` rows of a batch of (token, count)."""
    for at in range(0, batch.num_rows, size):
        part = batch.slice(at, size)
        yield part.column(0).to_pylist(), np.asarray(part.column(1).to_numpy(zero_copy_only=False), np.int64)


def _sorted_pieces(pieces, size: int) -> list[tuple[list[bytes], np.ndarray]]:
    """The same (tokens, counts) in the order of the tokens, at most ``size`` at a time."""
    tokens = [t for some, _ in pieces for t in some]
    counts = np.concatenate([np.empty(0, np.int64), *(n for _, n in pieces)])
    order = sorted(range(len(tokens)), key=tokens.__getitem__)
    return [([tokens[k] for k in order[at : at + size]], counts[order[at : at + size]]) for at in range(0, len(order), size)]


def _slot_counter(sizes):
    starts = np.cumsum([0, *(1 << bits for _, bits in sizes)])
    # orders that are counted at one time, in tables of not many more slots than the largest may have
    groups = [[0]]
    for k in range(1, len(sizes)):
        if starts[k + 1] - starts[groups[-1][0]] > 1 << MOST_BITS:
            groups.append([])
        groups[-1].append(k)

    def run(batches):
        schema = pa.schema([("start", pa.int64()), ("counts", pa.binary())])
        pieces = _sorted_pieces([x for b in batches for x in _pieces(b, 16384)], 1 << 14)
        for group in groups if pieces else ():
            start, end = int(starts[group[0]]), int(starts[group[-1] + 1])
            table_ = np.zeros((end - start, 2), np.uint32)
            for tokens, counts in pieces:
                count_bits(tokens, counts, table_, group, sizes, 1, start)
            for at in range(0, len(table_), SEGMENT):
                part = table_[at : at + SEGMENT]
                if part.any():
                    yield pa.RecordBatch.from_arrays([pa.array([start + at], pa.int64()), pa.array([_pack(part.reshape(-1))], pa.binary())], schema=schema)

    return run


def _sum_segments(batches):
    """Sums of the counts of a segment's slots; rows come sorted, so one is held at a time."""
    schema = pa.schema([("start", pa.int64()), ("counts", pa.binary())])
    total, current = None, None

    def out():
        return pa.RecordBatch.from_arrays([pa.array([current], pa.int64()), pa.array([_pack(total)], pa.binary())], schema=schema)

    for b in batches:
        for start, counts in zip(*(c.to_pylist() for c in b.columns)):
            part = _unpack(counts)
            if start == current:
                total += part
                continue
            if current is not None:
                yield out()
            current, total = start, part
    if current is not None:
        yield out()


def _count_few(batches):
    """Pairs seen once and twice."""
    for b in batches:
        for row in zip(*(c.to_pylist() for c in b.columns)):
            n = np.concatenate([_unpack(x) for x in row])
            yield pa.RecordBatch.from_arrays([pa.array([int(np.sum(n == k))], pa.int64()) for k in (1, 2)], names=["once", "twice"])


def _step(n: np.ndarray) -> np.ndarray:
    """Sixteenths of a doubling."""
    return np.floor(np.log2(n) * 16).astype(np.int32)


class _Made:
    """Derived tables of one fit.  Shuffle files go as soon as the table that needs them is
    written, and a table when nothing needs it any more."""

    _CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, {}

    @contextmanager
    def clean(self):
        before = self.spark.conf.get(self._CLEAN, "false")
        self.spark.conf.set(self._CLEAN, "true")
        try:
            yield
        finally:
            self.spark.conf.set(self._CLEAN, before)

    def keep(self, df: DataFrame, label: str) -> DataFrame:
        with self.clean():
            return materialize(df, label)

    def write(self, df: DataFrame, label: str) -> DataFrame:
        out = self.keep(df, label)
        self.paths[label] = out.inputFiles()
        return out

    def drop(self, *labels: str) -> None:
        for label in labels:
            for path in {f.rsplit("/", 1)[0] for f in self.paths.pop(label)}:
                files.delete(self.spark, path)


@dataclass
class LanguageModel:
    vocabulary: DataFrame  # classed token, number of a common one, n_train (of the token in any class), cost (log10), spelled (of a common one, the mix alone)
    train_tokens: int
    train_distinct: int
    packs: DataFrame  # pairs in training texts by bucket
    buckets: int
    discount: float
    names: Broadcast  # the common tokens by number, the classes before them
    common: dict[str, np.ndarray]  # their n_train, cost and spelled
    behind: np.ndarray  # distinct tokens behind them
    class_cost: list[float]  # log10 probability of a document's class, and what discounts leave behind it
    table: Counts
    mixer: Mixer

    def base(self, n):
        """log10 of the add-one unigram probability of a token with count ``n``."""
        return np.log10((n + 1) / float(self.train_tokens + self.train_distinct + 1))

    def opened(self, make, schema: str) -> DataFrame:
        """``make`` of the keys, counts and gains of every packed row."""
        held = self.packs.sparkSession.sparkContext.broadcast((self.behind, self.common["spelled"]))
        discount = self.discount

        def run(batches):
            for batch in batches:
                for _, side, _, a, b, c in zip(*(x.to_pylist() for x in batch.columns)):
                    yield from make(*_gains_of(side, a, b, c, *held.value, discount))

        return self.packs.mapInArrow(run, schema)

    @property
    def pairs(self) -> DataFrame:
        """Key of a token behind another in training texts, n_train, cost (log10, a gain)."""

        def rows(keys, n, gain):
            yield pa.RecordBatch.from_arrays([_pair_tokens(keys), pa.array(n), pa.array(gain)], names=["token", "n_train", "cost"])

        return self.opened(rows, "token binary, n_train long, cost double")

    def common_pairs(self, at_most: int) -> tuple[np.ndarray, np.ndarray]:
        """Sorted keys and gains from the smallest count on that at most ``at_most`` pairs reach."""

        def counted(keys, n, gain):
            step, times = np.unique(_step(n), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(step, pa.int32()), pa.array(times, pa.int64())], names=["step", "count"])

        seen = self.opened(counted, "step int, count long").groupBy("step").agg(F.sum("count").alias("count")).orderBy(F.desc("step")).collect()
        least = _least(seen, at_most)
        if least is None:
            return np.empty(0, np.uint64), np.empty(0)

        def some(keys, n, gain):
            at = _step(n) >= least
            yield pa.RecordBatch.from_arrays([pa.array(keys[at].view(np.int64)), pa.array(gain[at])], names=["key", "gain"])

        found = self.opened(some, "key long, gain double").toArrow()
        keys = found["key"].to_numpy().view(np.uint64)
        order = np.argsort(keys)
        return keys[order], found["gain"].to_numpy()[order]


def fit_language_model(docs: DataFrame, text_col: str = "text", held_col: str = "held_out") -> LanguageModel:
    """Learn from all whole texts whose ``held_col`` is false.

    Token counts, the bit counts of all contexts and the online pass cover every training
    token.  The driver gets the table, which grows with the distinct tokens up to a bound,
    and one set of weights: the tasks' sets averaged by the tokens seen.  The whole tokens'
    contexts are in no table for all: tokens that share them are dealt to one task.
    """
    spark = docs.sparkSession
    ship_package(spark)
    made = _Made(spark)
    counted = docs.select(F.col(held_col).alias("held"), F.col(text_col).cast("string").alias("text")).mapInArrow(_count_tokens, "token binary, n_train long")
    classed = made.write(counted.groupBy("token").agg(F.sum("n_train").alias("n")), "tokens")
    train = classed.where("n > 0")
    plain = made.write(train.groupBy(F.expr("substring(token, 2)").alias("word")).agg(F.sum("n").alias("n_train")), "words")
    total = plain.agg(F.coalesce(F.sum("n_train"), F.lit(0)).alias("n"), F.count(F.lit(1)).alias("v")).first()
    ends = {r.token[0]: r.n for r in train.where(F.expr("substring(token, 2)") == F.lit(END)).collect()}  # one a class
    docs_seen = sum(ends.values())
    class_cost = [math.log10((ends.get(k, 0) + 1) / (docs_seen + CLASSES)) for k in range(CLASSES)]
    distinct = train.count()
    sizes = sized(distinct)
    slots = _slots_of(sizes)
    parts = train.mapInArrow(_slot_counter(sizes), "start long, counts binary")
    dense = parts.repartition("start").sortWithinPartitions("start").mapInArrow(_sum_segments, "start long, counts binary")
    table_ = Counts(slots)
    # at most slots pairs
    with made.clean():
        dense = dense.collect()
    for r in sorted(dense, key=lambda r: r.start):
        table_.put(r.start, _unpack(r.counts).reshape(-1, 2))
    # compressed, as every machine keeps the broadcast on its disk
    blocks = range(0, slots, 1 << 20)
    shared = spark.sparkContext.broadcast([slots, table_.at, table_.large, *(zlib.compress(table_.small[at : at + (1 << 20)], 1) for at in blocks)])

    together = [F.expr(f"substring(token, 1, {SHORT + 1})")]
    if (tasks := distinct // TASK_TOKENS) > 1:
        together.insert(0, tasks)

    def online(batches):
        mixer, seen = Mixer.new(), 0
        pieces = [x for b in batches for x in _pieces(b, 8192)]
        near = count_whole(_sorted_pieces(pieces, 8192), sizes)
        for tokens, counts in pieces:
            train_mixer(_unpacked(shared.value), tokens, counts, mixer, 1, sizes=sizes, near=near)
            seen += len(tokens)
        # weights and what the table saw, each times the tokens seen, and the tokens seen
        flat = np.concatenate([w.ravel() * seen for w in mixer.weights] + [(mixer.refine - Mixer.new().refine).ravel(), [seen]])
        schema = pa.schema([("at", pa.int32()), ("value", pa.float64())])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat), dtype=np.int32)), pa.array(flat.astype(np.float64))], schema=schema)

    mixer = Mixer.new()
    total_state = train.repartition(*together).mapInArrow(online, "at int, value double").groupBy("at").agg(F.sum("value").alias("value")).orderBy("at").collect()
    flat = np.array([r.value for r in total_state])  # as many numbers as one task's weights
    if len(flat) and flat[-1]:
        at = 0
        for k, w in enumerate(mixer.weights):
            mixer.weights[k] = (flat[at : at + w.size] / flat[-1]).reshape(w.shape).astype(np.float32)
            at += w.size
        mixer.refine += flat[at:-1].reshape(mixer.refine.shape)
    state = spark.sparkContext.broadcast(mixer)

    names = _common(train, "n", COMMON_TOKENS).toArrow()
    rank = np.argsort(-names["n"].to_numpy(), kind="stable")
    tokens = names["token"].to_pylist()
    names = spark.sparkContext.broadcast([bytes([k]) for k in range(CLASSES)] + [tokens[k] for k in rank])

    def cost(batches):
        schema = pa.schema([("token", pa.binary()), ("number", pa.int64()), ("cost", pa.float64())])
        numbers = _numbered(names.value)
        pieces = _sorted_pieces([x for b in batches for x in _pieces(b, 8192)], 4096)
        near = count_whole(pieces, sizes)
        for tokens, _ in pieces:
            costs = token_costs(_unpacked(shared.value), state.value, tokens, sizes, near)
            number = [numbers.get(t[0], {}).get(t[1:]) for t in tokens]
            yield pa.RecordBatch.from_arrays([pa.array(tokens, pa.binary()), pa.array(number, pa.int64()), pa.array(costs, pa.float64())], schema=schema)

    scored = classed.repartition(*together).mapInArrow(cost, "token binary, number long, cost double")
    name = F.coalesce("number", F.xxhash64("token").bitwiseOR(F.lit(_signed(_TOP))))
    scored = made.write(scored.select("token", name.alias("name"), "cost"), "spelled")
    made.drop("tokens")
    for b in (shared, state):  # every machine has a copy on its disk
        b.destroy()

    # what stands behind each name: t distinct tokens of n_p occurrences
    buckets = max(BUCKETS, int(total.n) >> 20)
    texts = docs.where(~F.col(held_col)).select(F.col(text_col).cast("string").alias("text"))
    dealt = texts.mapInArrow(_pair_counter(names, buckets), _COUNTED).repartition("bucket").sortWithinPartitions("bucket")
    pairs = made.write(dealt.mapInArrow(_sum_pairs, _COUNTED), "pairs")
    once, twice = pairs.select("n", "m").mapInArrow(_count_few, "once long, twice long").agg(F.sum("once"), F.sum("twice")).first()
    discount = min(max(once / (once + 2 * twice), 0.1), 0.95) if once else 0.5
    behind = made.write(pairs.mapInArrow(_count_behind, "p long, t long, n_p long").groupBy("p").agg(F.sum("t").alias("t"), F.sum("n_p").alias("n_p")), "behind")
    numbers = len(names.value)
    few = behind.where("p >= 0").toArrow()  # of the numbered tokens
    after = np.zeros(numbers)
    after[few["p"].to_numpy()] = few["t"].to_numpy()
    for p, t, n_p in zip(*(few[c].to_pylist() for c in ("p", "t", "n_p"))):
        if p < CLASSES:
            class_cost[p] += math.log10(discount * t / n_p)
    gain = F.log10(1 + (F.col("n") - discount) / (F.lit(discount) * F.col("t") * F.pow(F.lit(10.0), F.col("cost"))))
    rare = pairs.select("p", "w", "m").mapInArrow(_rare_pairs, "p long, w long, n long")
    gains = rare.join(scored.select(F.col("name").alias("w"), "cost"), "w").join(behind.select("p", "t"), "p").select("p", "w", "n", gain.alias("gain"))
    none = F.lit(None).cast("binary").alias("c")
    numbered = pairs.select("bucket", F.lit(_NUMBERED).alias("side"), F.lit(-1).cast("long").alias("chunk"), F.col("keys").alias("a"), F.col("n").alias("b"), none)
    packs = made.keep(numbered.union(gains.mapInArrow(_pack_gains(buckets), _PACKED)), "gains")
    made.drop("pairs")

    left_over = F.log10(F.lit(discount) * F.col("t") / F.col("n_p"))
    whole = F.col("cost") + F.coalesce(left_over, F.lit(0.0))  # every token but the end has another behind it
    number = F.when(F.col("name") >= 0, F.col("name"))
    vocabulary = (
        scored.join(plain, F.expr("substring(token, 2)") == F.col("word"), "left")
        .join(behind, F.col("name") == F.col("p"), "left")
        .select("token", number.alias("number"), F.coalesce("n_train", F.lit(0)).alias("n_train"), whole.alias("cost"), F.when(number.isNotNull(), F.col("cost")).alias("spelled"))
    )
    vocabulary = made.keep(vocabulary, "vocabulary")
    made.drop("words", "spelled", "behind")
    few = vocabulary.where("number is not null").toArrow()
    common = {c: np.zeros(numbers) for c in ("n_train", "cost", "spelled")}
    for c, values in common.items():
        values[few["number"].to_numpy()] = few[c].to_numpy()
    return LanguageModel(vocabulary, int(total.n), int(total.v), packs, buckets, discount, names, common, after, class_cost, table_, mixer)


def _signed(h: int) -> int:
    return h - (1 << 64) if h >> 63 else h


def _least(steps, at_most: int) -> int | None:
    """The smallest step that at most ``at_most`` reach, of (step, count) from the highest on."""
    total, least = 0, None
    for r in steps:
        total += r["count"]
        if total > at_most:
            break
        least = r["step"]
    return least


def _common(tokens: DataFrame, count_col: str, at_most: int) -> DataFrame:
    """The tokens from the smallest count on that at most ``at_most`` tokens reach."""
    step = F.floor(F.log2(F.col(count_col)) * 16).cast("int")
    some = tokens.where(F.col(count_col) > 0)
    least = _least(some.groupBy(step.alias("step")).count().orderBy(F.desc("step")).collect(), at_most)  # 16 rows a doubling
    return some.where(step >= least) if least is not None else some.limit(0)


def _pack_words(side: int, chunk: int, bucket: np.ndarray, words: list[bytes], *more) -> pa.RecordBatch | None:
    """Words by bucket, each bucket's sorted, with arrays beside them and how to pack those."""
    order = np.array(sorted(range(len(words)), key=words.__getitem__), np.int64)
    rows = []
    for k, at in _by_bucket(bucket[order]):
        at = order[at]
        text = PAIR.join([words[i] for i in at])  # no word holds this byte
        packed = [pack(x[at]) if x is not None else pack for pack, x in more]
        rows.append([k, side, chunk, len(text).to_bytes(8, "little") + pa.compress(text, "zstd", asbytes=True), *packed])
    return _packed_batch(rows) if rows else None


def _words_in(packed: bytes) -> list[bytes]:
    return pa.decompress(packed[8:], int.from_bytes(packed[:8], "little"), "zstd", asbytes=True).split(PAIR)


def score_documents(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text", common: int = COMMON_TOKENS, common_pairs: int = COMMON_PAIRS) -> DataFrame:
    """One row per document: the id, n_tokens, n_known, n_bytes (of words, with one after
    each, and the end), base_score and score (log10), bits_per_byte.

    The costs of at most ``common`` tokens and the gains of at most ``common_pairs`` pairs go
    to every task.  The documents' other tokens and pairs meet the model's by bucket, packed
    a chunk of documents at a time, and each chunk's sums meet its documents.  A null text
    counts as empty and has the end alone.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    spark = docs.sparkSession
    ship_package(spark)
    names, buckets, class_cost, unknown = model.names, model.buckets, np.array(model.class_cost), float(model.base(0))
    limit = CLASSES + common
    held = spark.sparkContext.broadcast((model.base(model.common["n_train"]), model.common["cost"], *model.common_pairs(common_pairs)))
    gains = spark.sparkContext.broadcast((model.behind, model.common["spelled"], model.discount))
    d = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    own = T.StructType([T.StructField("place", T.IntegerType()), T.StructField("id", d.schema["id"].dataType)])
    for f, t in (("n_tokens", T.LongType()), ("n_known", T.LongType()), ("n_bytes", T.LongType()), ("base", T.DoubleType()), ("score", T.DoubleType())):
        own = own.add(f, t)
    asked = T.StructType([*T.StructType.fromDDL(_PACKED), *own])
    arrow = to_arrow_schema(asked)

    def batch(schema, n: int, cols: dict):
        return pa.RecordBatch.from_arrays([cols[f.name] if f.name in cols else pa.nulls(n, f.type) for f in schema], schema=schema)

    def split(batches):
        from pyspark import TaskContext

        _TABLES.clear()
        numbers = _numbered(names.value)
        base, cost, pair_at, pair_gain = held.value
        chunk = TaskContext.get().partitionId() << 32
        ids, kinds, sizes, kept, rare, rare_docs, known_names = [], [], [], [], [], [], {}

        def asks():
            """What the held documents ask each bucket, and their own rows; starts anew."""
            n = len(ids)
            many = [len(h) for h in kept]
            h, doc = np.concatenate(kept), np.repeat(np.arange(n), many)
            inner = np.ones(len(h), bool)
            inner[np.cumsum([0, *many[:-1]])] = False
            p, w, doc = h[:-1][inner[1:]], h[1:][inner[1:]], doc[1:][inner[1:]]
            near = w < np.uint64(limit)
            number, at = w[near].astype(np.int64), doc[near]
            score = class_cost[np.array(kinds)] + np.bincount(at, cost[number], n)
            keys = _pair_keys(p, w)
            order = np.argsort(keys)
            keys, doc = keys[order], doc[order]
            if len(pair_at):
                place = np.minimum(np.searchsorted(pair_at, keys), len(pair_at) - 1)
                hit = pair_at[place] == keys
                score += np.bincount(doc[hit], pair_gain[place[hit]], n)
                keys, doc = keys[~hit], doc[~hit]
            size = n.to_bytes(8, "little")
            rows = [[k, _PAIRS, chunk, _pack_sorted(keys[x]), _pack(doc[x]), size] for k, x in _by_bucket(_bucket_of(keys, buckets))]
            for packed in (
                _packed_batch(rows) if rows else None,
                _pack_words(_WORDS, chunk, np.fromiter(map(zlib.crc32, rare), np.int64, len(rare)) % buckets, rare, (_pack, np.array(rare_docs, np.int64)), (size, None)),
            ):
                if packed is not None:
                    yield batch(arrow, packed.num_rows, dict(zip(packed.schema.names, packed.columns)))
            place = np.arange(n, dtype=np.int32)
            cols = {
                "bucket": place % buckets, "side": np.full(n, _OWN, np.int32), "chunk": np.full(n, chunk), "place": place,
                "n_tokens": np.array(many) - 1, "n_known": np.bincount(at, minlength=n), "n_bytes": np.array(sizes), "base": np.bincount(at, base[number], n), "score": score,
            }
            yield batch(arrow, n, {k: pa.array(v, arrow.field(k).type) for k, v in cols.items()} | {"id": pa.array(ids, arrow.field("id").type)})
            for x in (ids, kinds, sizes, kept, rare, rare_docs):
                x.clear()

        total = 0
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                for doc, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    kind, words = words_of(text)
                    sizes.append(sum(map(len, words)) + len(words) + 1)
                    words.append(END)
                    h = _names_of(kind, words, numbers, known_names)
                    far, mark = np.flatnonzero(h[1:] >= np.uint64(limit)).tolist(), bytes([kind])
                    rare.extend([mark + words[i] for i in far])
                    rare_docs.extend([len(ids)] * len(far))
                    ids.append(doc)
                    kinds.append(kind)
                    kept.append(h)
                    total += len(words)
                if total > HELD_SCORED:
                    yield from asks()
                    total, chunk = 0, chunk + 1
        if ids:
            yield from asks()

    def vocabulary(batches):
        for b in batches:
            bucket, tokens, n, cost = b.columns
            packed = _pack_words(_TOKENS, -1, bucket.to_numpy().astype(np.int64), tokens.to_pylist(), (_pack, n.to_numpy()), (_floats, cost.to_numpy()))
            if packed is not None:
                yield packed

    far = model.vocabulary.where(F.col("number").isNull() | (F.col("number") >= limit))
    far = far.select(F.pmod(F.crc32("token"), F.lit(buckets)).cast("int").alias("bucket"), "token", "n_train", "cost").mapInArrow(vocabulary, _PACKED)
    known = model.packs.unionByName(far)
    met = T.StructType([*T.StructType.fromDDL("chunk long, known binary, far_base binary, far_score binary"), *own])
    met_arrow = to_arrow_schema(met)

    def matched(batches):
        """The sums of what the documents of a chunk asked one bucket; documents pass."""
        current, keys, gain, tokens, n_train, cost, waiting = None, [], [], [], [], [], None

        def learnt():
            nonlocal keys, gain, tokens, n_train, cost
            k, g = np.concatenate([np.empty(0, np.uint64), *keys]), np.concatenate([np.empty(0), *gain])
            order = np.argsort(k)
            keys, gain = k[order], g[order]
            tokens = {t: i for i, t in enumerate(tokens)}
            n_train, cost = np.concatenate([np.empty(0, np.int64), *n_train]), np.concatenate([np.empty(0), *cost])

        def sums():
            chunk, found, base, score = waiting
            cols = {"chunk": [chunk], "place": [-1], "known": [_pack(found)], "far_base": [_floats(base)], "far_score": [_floats(score)]}
            return batch(met_arrow, 1, {c: pa.array(v, met_arrow.field(c).type) for c, v in cols.items()})

        for b in batches:
            side = b.column("side").to_numpy()
            documents = b.filter(pa.array(side == _OWN))
            if documents.num_rows:
                yield batch(met_arrow, documents.num_rows, {c: documents.column(c) for c in ("chunk", *own.names)})
            cols = [b.column(c) for c in ("bucket", "side", "chunk", "a", "b", "c")]
            for row in np.flatnonzero(side != _OWN).tolist():  # one at a time, as they are large
                bucket, kind, chunk, one, two, three = (c[row].as_py() for c in cols)
                if waiting is not None and (bucket, chunk) != (current, waiting[0]):
                    yield sums()
                    waiting = None
                if bucket != current:
                    current, keys, gain, tokens, n_train, cost = bucket, [], [], [], [], []
                if kind in (_NUMBERED, _HASHED):
                    k, _, g = _gains_of(kind, one, two, three, *gains.value)
                    keys.append(k)
                    gain.append(g)
                    continue
                if kind == _TOKENS:
                    tokens.extend(_words_in(one))
                    n_train.append(_unpack(two).astype(np.int64))
                    cost.append(_unfloats(three))
                    continue
                if isinstance(keys, list):
                    learnt()
                n = int.from_bytes(three, "little")
                if waiting is None:
                    waiting = chunk, np.zeros(n, np.int64), np.zeros(n), np.zeros(n)
                doc = _unpack(two).astype(np.int64)
                if kind == _PAIRS:
                    if len(keys):
                        ask = _unpack_sorted(one)
                        place = np.minimum(np.searchsorted(keys, ask), len(keys) - 1)
                        hit = keys[place] == ask
                        waiting[3][:] += np.bincount(doc[hit], gain[place[hit]], n)
                    continue
                at = np.fromiter((tokens.get(x, -1) for x in _words_in(one)), np.int64, len(doc))
                hit = at >= 0
                waiting[1][:] += np.bincount(doc[hit], n_train[at[hit]] > 0, n).astype(np.int64)
                waiting[2][:] += np.bincount(doc, np.where(hit, model_base(np.r_[n_train, 0][at]), unknown), n)
                waiting[3][:] += np.bincount(doc[hit], cost[at[hit]], n)
        if waiting is not None:
            yield sums()

    everything = float(model.train_tokens + model.train_distinct + 1)

    def model_base(n):
        return np.log10((n + 1) / everything)

    out = T.StructType([f for f in own if f.name != "place"])
    out_arrow = to_arrow_schema(out)

    def summed(batches):
        """Documents and what the buckets add; a chunk's sums come before its documents."""
        current, adds = None, []
        for b in batches:
            chunk, place = b.column("chunk").to_numpy(), b.column("place").to_numpy()
            cut = np.flatnonzero(np.r_[True, (chunk[1:] != chunk[:-1]) | (place[1:] < 0) | (place[:-1] < 0)][: len(chunk)])
            for at, end in zip(cut, [*cut[1:], len(chunk)]):
                if chunk[at] != current:
                    current, adds = chunk[at], None
                if place[at] < 0:
                    new = [_unpack(b.column("known")[at].as_py()).astype(np.int64), *(_unfloats(b.column(c)[at].as_py()) for c in ("far_base", "far_score"))]
                    adds = new if adds is None else [x + y for x, y in zip(adds, new)]
                    continue
                part = b.slice(at, end - at)
                cols = {c: part.column(c) for c in out.names}
                if adds is not None:
                    for c, x in zip(("n_known", "base", "score"), adds):
                        cols[c] = pa.array(part.column(c).to_numpy() + x[place[at:end]])
                yield batch(out_arrow, end - at, cols)

    rows = d.mapInArrow(split, asked).unionByName(known, allowMissingColumns=True)
    rows = rows.repartition("bucket").sortWithinPartitions("bucket", "chunk", "side").select(*asked.names)
    sums = rows.mapInArrow(matched, met).repartition("chunk").sortWithinPartitions("chunk", "place").mapInArrow(summed, out)
    bits = -F.col("score") * math.log2(10) / F.col("n_bytes")
    return sums.select(F.col("id").alias(id_col), "n_tokens", "n_known", "n_bytes", F.col("base").alias("base_score"), "score", bits.alias("bits_per_byte"))


_TABLES: dict[int, tuple[list, Counts]] = {}


def _unpacked(packed: list) -> Counts:
    """The table of counts from its blocks; made once per worker and broadcast value."""
    held = _TABLES.get(id(packed))
    if held is None or held[0] is not packed:
        _TABLES.clear()
        slots, at, large, *blocks = packed
        table_, start = Counts(slots), 0
        table_.at, table_.large = at, large
        for block in blocks:
            part = np.frombuffer(zlib.decompress(block), np.uint16).reshape(-1, 2)
            table_.small[start : start + len(part)] = part
            start += len(part)
        _TABLES[id(packed)] = held = (packed, table_)
    return held[1]


_NUMBERS: dict[int, tuple[list, dict]] = {}


def _numbered(tokens: list[bytes]) -> dict[int, dict[bytes, int]]:
    """Place of each token by class and word; made once per worker and broadcast list."""
    held = _NUMBERS.get(id(tokens))
    if held is None or held[0] is not tokens:
        number: dict[int, dict[bytes, int]] = {}
        for k, t in enumerate(tokens):
            number.setdefault(t[0], {})[t[1:]] = k
        _NUMBERS.clear()
        _NUMBERS[id(tokens)] = held = (tokens, number)
    return held[1]


def op7_lm_scoring(spark, sf_dir):
    """Contract query: learn from the fold's documents, score every document."""
    docs = table(spark, sf_dir, "documents")
    model = fit_language_model(docs.select("text", (fold_of("doc_id", 7) == 2).alias("held_out")))
    out = score_documents(docs, model)
    return out.select(
        "doc_id",
        (fold_of("doc_id", 7) == 2).alias("held_out"),
        "n_tokens",
        "n_known",
        F.lit(model.train_tokens).cast("long").alias("train_tokens"),
        "base_score",
        "score",
        "bits_per_byte",
    )
