"""N-gram Jaccard join: MinHash banding, then exact verification on full n-gram sets.

Documents with one n-gram set are one class from the start.  Band and row counts follow
from the similarity and a target recall.  Band hashes are shuffled without texts; buckets
with the same members are looked at once, and a large bucket is split into blocks of bounded
bytes, so a task holds two blocks at most.  A text is copied once per block of its bucket:
``MOST_BLOCKS`` times, however many members there are, until the bytes of a block ask for
more.  Inside a pair of blocks every candidate pair is verified and counted, tile by tile,
but only links per class and a spanning forest leave the task.
"""

from __future__ import annotations

import math
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skiff.llm.components import connected_components
from skiff.session import materialize, ship_package

WORDS, SIMILARITY, RECALL = 5, 0.8, 0.9995
MAX_HASHES = 128
#: Members of a tile, whose pairs are verified at once; a bucket of no more is one block.
BLOCK = 512
#: A larger bucket has as many blocks as tiles, up to so many, or as its bytes need: a block
#: weighs at most about ``BLOCK_BYTES``, each member its text and ``MEMBER_BYTES`` besides.
MOST_BLOCKS, BLOCK_BYTES, MEMBER_BYTES = 9, 32 << 20, 1000
#: The keys of candidate classes are broadcast up to this many (16 bytes each).
BROADCAST_KEYS = 1_000_000

_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_BASE = np.uint64(0x9E3779B97F4A7C15)


def banding(similarity: float = SIMILARITY, recall: float = RECALL, max_hashes: int = MAX_HASHES) -> tuple[int, int]:
    """(bands, rows): the most rows a band whose bands, as many as the recall needs at the
    similarity, stay within ``max_hashes``."""
    best = (max_hashes, 1)
    for rows in range(1, max_hashes + 1):
        hit = similarity**rows
        bands = max(1, math.ceil(math.log(1 - recall) / math.log1p(-hit))) if hit < 1 else 1
        if bands * rows <= max_hashes:
            best = (bands, rows)
    return best


def ngrams(text: str | None, words: int = WORDS) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct runs of ``words`` words (all words if fewer);
    a word is a run of digits, letters a-z in either case, or characters above 0x7F."""
    import xxhash

    found = (text or "").encode("utf-8", "replace").translate(_TABLE).split()
    if not found:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh64_intdigest, found), np.uint64, len(found))
    n = min(words, len(h))
    g = np.zeros(len(h) - n + 1, np.uint64)
    for k in range(n):
        g = g * _BASE + h[k : len(h) - n + 1 + k]
    g ^= g >> np.uint64(29)
    g *= np.uint64(0xBF58476D1CE4E5B9)
    g ^= g >> np.uint64(32)
    return np.unique(g)


def _functions(count: int) -> tuple[np.ndarray, np.ndarray]:
    rnd = np.random.default_rng(20)
    return rnd.integers(0, 1 << 32, count, np.uint32) | np.uint32(1), rnd.integers(0, 1 << 32, count, np.uint32)


def band_hashes(grams: np.ndarray, bands: int, rows: int) -> list[int]:
    """One 64-bit hash a band of the set's MinHash signature."""
    import xxhash

    a, b = _functions(bands * rows)
    x = grams.astype(np.uint32)  # the low half of mixed 64-bit hashes
    least = np.full(bands * rows, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(x), 2048):  # bounded memory for very long texts
        part = x[at : at + 2048]
        np.minimum(least, ((part[None, :] ^ b[:, None]) * a[:, None]).min(axis=1), out=least)
    return [xxhash.xxh64_intdigest(least[k * rows : (k + 1) * rows].tobytes(), seed=k) - (1 << 63) for k in range(bands)]


def blocks_of(members: Column, weight: Column, block: int = BLOCK, most_blocks: int = MOST_BLOCKS, block_bytes: int = BLOCK_BYTES) -> Column:
    """Blocks of a bucket of so many members, which weigh so many bytes."""
    return F.greatest(F.least(F.ceil(members / block), F.lit(most_blocks)), F.ceil(weight / block_bytes)).cast("int")


def signatures(docs: DataFrame, words: int, bands: int, rows: int) -> DataFrame:
    """id, text_key, size (bytes), set_key (null without words), bands for every row of (id, text)."""
    import xxhash

    schema = T.StructType(
        [docs.schema["id"], T.StructField("text_key", T.LongType()), T.StructField("size", T.LongType()), T.StructField("set_key", T.BinaryType()), T.StructField("bands", T.ArrayType(T.LongType()))]
    )
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(schema)

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                keys, found = [], []
                for text in part.column(3).to_pylist():
                    g = ngrams(text, words)
                    keys.append(xxhash.xxh128_digest(g.tobytes()) if len(g) else None)
                    found.append(band_hashes(g, bands, rows) if len(g) else None)
                cols = [part.column(0).cast(arrow.field(0).type), part.column(1), part.column(2), pa.array(keys, pa.binary()), pa.array(found, arrow.field(4).type)]
                yield pa.RecordBatch.from_arrays(cols, schema=arrow)

    return docs.select("id", F.xxhash64("text").alias("text_key"), F.octet_length("text").cast("long").alias("size"), "text").mapInArrow(run, schema)


def _overlaps(a: list[np.ndarray], b: list[np.ndarray], wanted: np.ndarray) -> np.ndarray:
    """Sizes of the wanted intersections of sets from ``a`` and ``b`` (others: 0)."""
    out = np.zeros(wanted.shape, np.float32)
    pairs = np.argwhere(wanted)
    both = a if a is b else [*a, *b]
    grams = np.concatenate(both)
    if len(pairs) * (len(grams) / len(both)) * 3 < len(grams) * 40:
        for i, j in pairs:
            x, y = a[i], b[j]
            at = np.minimum(np.searchsorted(y, x), len(y) - 1)
            out[i, j] = np.count_nonzero(y[at] == x)
        return out
    owner = np.repeat(np.arange(len(both)), [len(g) for g in both])
    values, ids, counts = np.unique(grams, return_inverse=True, return_counts=True)
    shared = counts > 1
    column = np.cumsum(shared) - 1
    live = shared[ids]
    owner, col = owner[live], column[ids[live]]
    order = np.argsort(col, kind="stable")
    owner, col = owner[order], col[order]
    width, total = 4096, int(shared.sum())
    for low in range(0, total, width):  # incidence matrices of bounded width
        s, e = np.searchsorted(col, (low, low + width))
        m = np.zeros((len(both), min(width, total - low)), np.float32)
        m[owner[s:e], col[s:e] - low] = 1
        out += m[: len(a)] @ (m if a is b else m[len(a) :]).T
    return out


def _verify(group: list[list], words: int, similarity: float, block: int = BLOCK) -> tuple[dict, list]:
    """Links per class and a spanning forest of one pair of blocks.

    A row: [side, set_key, copies, bands, band, text].  Sides 0 and 1 are paired; a group
    with side 0 alone is paired with itself.  A pair counts in its first common band only.
    Pairs are looked at in tiles of ``block`` members a side, so memory is that of the two
    blocks; a text met there for the first time is replaced by its n-grams.
    """
    left = [r for r in group if r[0] == 0]
    right = [r for r in group if r[0] == 1] or left
    band = group[0][4]
    links: dict[bytes, int] = {}
    parent: dict[bytes, bytes] = {}
    forest: list[tuple[bytes, bytes]] = []

    def root(x):
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    def grams(rows: list[list]) -> list[np.ndarray]:
        for r in rows:
            if not isinstance(r[5], np.ndarray):
                r[5] = ngrams(r[5], words)
        return [r[5] for r in rows]

    def tile(a: list[list], b: list[list]) -> None:
        ba, bb = (np.stack([r[3] for r in rows]) for rows in (a, b))
        wanted = ba[:, None, band] == bb[None, :, band]
        for k in range(band):
            wanted &= ba[:, None, k] != bb[None, :, k]
        if b is a:
            wanted &= np.tri(len(a), k=-1, dtype=bool)
        if not wanted.any():
            return
        ga = grams(a)
        gb = ga if b is a else grams(b)
        na, nb = (np.array([len(g) for g in x], np.float64) for x in (ga, gb))
        wanted &= np.minimum(na[:, None], nb[None, :]) >= similarity * np.maximum(na[:, None], nb[None, :]) - 1e-9
        if not wanted.any():
            return
        common = _overlaps(ga, gb, wanted)
        linked = wanted & (common >= similarity * (na[:, None] + nb[None, :] - common) - 1e-6)
        ca, cb = (np.array([r[2] for r in rows], np.int64) for rows in (a, b))
        for rows, counts in ((a, linked @ cb), (b, linked.T @ ca)):
            for r, n in zip(rows, counts):
                if n:
                    links[r[1]] = links.get(r[1], 0) + int(n)
        for i, j in np.argwhere(linked):
            x, y = root(a[i][1]), root(b[j][1])
            if x != y:
                parent[max(x, y)] = min(x, y)
                forest.append((a[i][1], b[j][1]))

    lefts = [left[at : at + block] for at in range(0, len(left), block)]
    rights = lefts if right is left else [right[at : at + block] for at in range(0, len(right), block)]
    for i, a in enumerate(lefts):
        for b in rights[: i + 1] if rights is lefts else rights:
            tile(a, b)
    return links, forest


def _verify_partition(batches, words: int, similarity: float, block: int):
    schema = pa.schema([("set_key", pa.binary()), ("links", pa.int64()), ("other", pa.binary())])

    def rows():
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                # band, h, pair, side, set_key, copies, bands, at, text
                for r in zip(*(c.to_pylist() for c in part.columns)):
                    yield [*r[:6], np.array(r[6], np.int64), *r[7:]]

    out: list[tuple] = []
    for _, members in groupby(rows(), key=lambda r: r[:3]):
        links, forest = _verify([r[3:] for r in members], words, similarity, block)
        out += [(k, n, None) for k, n in links.items()]
        out += [(x, 0, y) for x, y in forest]
        if len(out) > 20_000:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)
            out = []
    cols = list(zip(*out)) if out else [[], [], []]
    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema)], schema=schema)


def jaccard_classes(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    words: int = WORDS,
    similarity: float = SIMILARITY,
    recall: float = RECALL,
    max_hashes: int = MAX_HASHES,
    block: int = BLOCK,
    most_blocks: int = MOST_BLOCKS,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """One row per document: the id, text_key (a hash of the text), class_key (the same for
    documents joined by a chain of links), class_id (the smallest id in it), n_links (other
    documents of at least the similarity, copies included) and n_copies (those of them with
    the same n-gram set).

    A text without words, or null, has no n-grams and no links: its class_key is null, its
    class_id its own id.  Repeated rows are copies of each other.  Null ids are never a
    class_id unless the class has no other.  An empty table gives no rows.
    """
    spark = docs.sparkSession
    ship_package(spark)
    bands, rows = banding(similarity, recall, max_hashes)
    d = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    sigs = materialize(signatures(d, words, bands, rows), "signatures")
    sets = materialize(
        sigs.where("set_key is not null")
        .groupBy("set_key")
        .agg(F.count(F.lit(1)).alias("copies"), F.min("text_key").alias("text_key"), F.min("id").alias("least_id"), F.any_value("bands").alias("bands"), F.max("size").alias("size")),
        "sets",
    )
    # buckets: who shares a band hash; equal member lists are looked at in one band only
    member = sets.select("set_key", "size", F.posexplode("bands").alias("band", "h"))
    mark = F.xxhash64("set_key")
    buckets = member.groupBy("band", "h").agg(
        F.count(F.lit(1)).alias("n"), F.sum(mark.bitwiseAND(F.lit((1 << 40) - 1))).alias("s"), F.bit_xor(mark).alias("x"), F.min("set_key").alias("first"),
        F.sum(F.col("size") + MEMBER_BYTES).alias("weight"),
    )
    kept = buckets.where("n > 1").groupBy("n", "s", "x", "first").agg(F.min(F.struct("band", "h")).alias("b"), F.max("weight").alias("weight"))
    kept = kept.select("b.*", blocks_of(F.col("n"), F.col("weight"), block, most_blocks, block_bytes).alias("blocks"))
    kept = materialize(kept, "buckets")
    in_kept = member.drop("size").join(kept, ["band", "h"])
    blocks = F.col("blocks")
    # blocks deal members by their hash; block b of m meets b..m-1 as side 0 and 0..b-1 as side 1
    own = F.pmod(F.xxhash64("set_key", F.lit(7)), blocks).cast("int")
    meets = F.transform(F.sequence(F.lit(0), blocks - 1), lambda o: F.struct(F.least(own, o).alias("lo"), F.greatest(own, o).alias("hi"), (own > o).cast("int").alias("side")))
    placed = materialize(in_kept.select("set_key", "band", "h", F.explode(meets).alias("p")).select("set_key", "band", "h", "p.*"), "members")
    needed = placed.select("set_key").distinct().join(sets, "set_key").select("set_key", "text_key", "copies", "bands")
    needed = materialize(needed, "needed")
    keys = needed.select("text_key", "set_key")
    keys = F.broadcast(keys) if needed.count() <= BROADCAST_KEYS else keys
    # copies of a text are equal: any one of them stands for its class
    texts = d.withColumn("text_key", F.xxhash64("text")).join(keys, "text_key").groupBy("set_key").agg(F.any_value("text").alias("text"))
    texts = materialize(texts.join(needed.select("set_key", "copies", "bands"), "set_key"), "candidates")
    full = placed.join(texts, "set_key").select("band", "h", F.struct("lo", "hi").alias("pair"), "side", "set_key", "copies", "bands", F.col("band").alias("at"), "text")
    spread = full.repartition("band", "h", "pair").sortWithinPartitions("band", "h", "pair")

    def run(batches):
        return _verify_partition(batches, words, similarity, block)

    found = materialize(spread.mapInArrow(run, "set_key binary, links long, other binary"), "verified")
    links = found.groupBy("set_key").agg(F.sum("links").alias("links"))
    edges = found.where("other is not null").select(F.col("set_key").alias("a"), F.col("other").alias("b")).distinct()
    labels = connected_components(edges)
    labelled = sets.join(labels.withColumnRenamed("node", "set_key"), "set_key", "left").join(links, "set_key", "left")
    labelled = labelled.select(
        "set_key", "copies", "least_id", F.coalesce("label", "set_key").alias("class_key"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links")
    )
    labelled = materialize(labelled, "labelled")
    least = labelled.groupBy("class_key").agg(F.min("least_id").alias("class_id"))
    classes = materialize(labelled.join(least, "class_key").select("set_key", "copies", "class_key", "class_id", "n_links"), "classes")
    out = sigs.select("id", "text_key", "set_key").join(classes, "set_key", "left")
    return out.select(
        F.col("id").alias(id_col),
        "text_key",
        F.hex("class_key").alias("class_key"),
        F.when(F.col("class_key").isNull(), F.col("id")).otherwise(F.col("class_id")).alias("class_id"),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce(F.col("copies") - 1, F.lit(0)).cast("long").alias("n_copies"),
    )


def op10_jaccard_join(spark, sf_dir):
    """Query: the class, links and copies of every document."""
    from skiff.llm.common import table

    return jaccard_classes(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "n_links", "n_copies")
