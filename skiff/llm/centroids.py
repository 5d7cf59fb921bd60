"""Centroid clustering with heap-ordered bounds (exact Lloyd rounds over integer vectors).

Vectors lie in blocks, and a block keeps one heap per cluster.  A vector's key is the gap
between its second nearest and its nearest centroid, plus the drift its cluster has gathered
by then; a cluster's drift grows each round by how far its centroid moved and by the farthest
move of any other.  As long as a key is above its cluster's drift the vector cannot change
its cluster, so a round pops only the keys at or below it, compares those vectors with all
centroids exactly, in integers, and pushes them with new gaps.

A round is one pass over the blocks: nothing is shuffled but one row of sums per block.
Blocks and heaps are tables in the shared folder, replaced round by round; the driver sees the
centroids and their sums alone.  Components are kept in as few bytes as they need.
"""

from __future__ import annotations

import hashlib
import math
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skiff import files
from skiff.session import run_dir, ship_package

#: Vectors of a block: what a task holds at a time.
BLOCK = 8192
#: Integer components reach to 2^27, so that squared distances of 64 of them fit a long.
LARGEST = 1 << 27
#: Taken off a key against rounding, as a share of the numbers that it is made of.
SLACK = 1e-9

_STATE = T.StructType(
    [
        T.StructField("ids", T.BinaryType()),
        T.StructField("vectors", T.BinaryType()),
        T.StructField("width", T.IntegerType()),
        T.StructField("cluster", T.BinaryType()),  # int16 per vector
        T.StructField("heap_keys", T.BinaryType()),  # float64, heap by heap
        T.StructField("heap_items", T.BinaryType()),  # int32, the same order
        # change of each cluster: count, components; behind the clusters: vectors compared with all centroids
        T.StructField("sums", T.ArrayType(T.ArrayType(T.LongType()))),
    ]
)


def integer_vectors(df: DataFrame, dims: int = 64, scale: int = 64, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``id`` and ``v`` (array<bigint>): floor(scale * component) of the rows whose vector has
    exactly ``dims`` components, none of them null or not finite; other rows are left out."""
    v = F.col(vector_col).cast("array<double>")
    ok = (F.size(v) == dims) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    d = df.where(F.coalesce(ok, F.lit(False))).select(F.col(id_col).cast("bigint").alias("id"), v.alias("v"))
    return d.select("id", F.transform("v", lambda x: F.floor(x * F.lit(float(scale)))).cast("array<bigint>").alias("v"))


def first_centroids(vectors: DataFrame, k: int, seed: int) -> list[list[int]]:
    """The k vectors with the smallest hashes of ``seed:id``; equal hashes (repeated ids) by
    their components; vectors without an id are never among them."""
    h = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256)
    top = vectors.where("id is not null").select(h.alias("h"), "v").orderBy("h", "v").limit(k)
    return [list(r.v) for r in top.collect()]


def _drifts(before: list[list[int]], after: list[list[int]]) -> np.ndarray:
    """By how much a gap may shrink in each cluster: its centroid's move and the farthest
    move of any other."""
    moved = np.array([math.sqrt(sum((a - b) ** 2 for a, b in zip(x, y))) for x, y in zip(before, after)])
    top = np.sort(moved)[::-1]
    others = np.where(moved == top[0], top[1] if len(top) > 1 and (moved == top[0]).sum() == 1 else top[0], top[0])
    return moved + (others if len(moved) > 1 else 0.0)


def _narrow(v: np.ndarray) -> np.ndarray:
    reach = int(np.abs(v).max(initial=0))
    return v.astype("<i1" if reach < 1 << 7 else "<i2" if reach < 1 << 15 else "<i4")


def _nearest(v: np.ndarray, centroids: np.ndarray):
    """Nearest centroid of each vector (the smaller number of equals), and by how much the
    second nearest is farther, a little less than it is."""
    d = np.empty((len(v), len(centroids)), np.int64)
    wide = v.astype(np.int64)
    for k, c in enumerate(centroids):
        diff = wide - c
        d[:, k] = np.einsum("ij,ij->i", diff, diff)
    best = d.argmin(axis=1)
    if len(centroids) == 1:
        return best, np.full(len(v), np.inf)
    near, second = np.sqrt(np.partition(d, 1, axis=1)[:, :2].astype(np.float64)).T
    return best, second - near - SLACK * (1.0 + near + second)


def _state_row(ids, v, cluster, heaps, sums, compared: int) -> pa.RecordBatch:
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = to_arrow_schema(_STATE)
    keys = np.array([k for h in heaps for k, _ in h], "<f8")
    items = np.array([i for h in heaps for _, i in h], "<i4")
    small = _narrow(v)
    sums = [*sums.tolist(), [compared] + [0] * v.shape[1]]
    row = [ids, small.tobytes(), small.itemsize, cluster.astype("<i2").tobytes(), keys.tobytes(), items.tobytes(), sums]
    return pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(row, schema)], schema=schema)


def _fold(v, cluster, sign: int, sums: np.ndarray) -> None:
    """Add (or take off) vectors to the counts and component sums of their clusters."""
    for c in np.unique(cluster):
        rows = v[cluster == c].astype(np.int64)
        sums[c, 0] += sign * len(rows)
        sums[c, 1:] += sign * rows.sum(axis=0)


def _first_round(batches, centroids: np.ndarray):
    """Vectors into blocks; all are compared with all centroids and put on the heaps."""
    k, dims = centroids.shape

    def block(ids: list, parts: list) -> pa.RecordBatch:
        # ids travel as one Arrow array, which keeps nulls
        sink = pa.BufferOutputStream()
        batch = pa.RecordBatch.from_arrays([pa.concat_arrays(ids)], names=["id"])
        with pa.ipc.new_stream(sink, batch.schema) as w:
            w.write_batch(batch)
        v = np.concatenate(parts)
        cluster, gap = _nearest(v, centroids)
        heaps = [list(zip(gap[cluster == c].tolist(), np.flatnonzero(cluster == c).tolist())) for c in range(k)]
        for h in heaps:
            heapify(h)
        sums = np.zeros((k, dims + 1), np.int64)
        _fold(v, cluster, 1, sums)
        return _state_row(sink.getvalue().to_pybytes(), v, cluster, heaps, sums, len(v))

    ids, parts, held = [], [], 0
    for b in batches:
        for at in range(0, b.num_rows, BLOCK):
            part = b.slice(at, BLOCK)
            v = np.array(part.column(1).flatten(), np.int64).reshape(part.num_rows, dims)
            if np.abs(v).max(initial=0) > LARGEST:
                raise OverflowError(f"a scaled component is beyond {LARGEST}")
            ids.append(part.column(0))
            parts.append(v)
            held += part.num_rows
            if held >= BLOCK:
                yield block(ids, parts)
                ids, parts, held = [], [], 0
    if held:
        yield block(ids, parts)


def _load(row: dict, dims: int):
    v = np.frombuffer(row["vectors"], f"<i{row['width']}").reshape(-1, dims)
    return v, np.frombuffer(row["cluster"], "<i2").astype(np.int64)


def _later_round(batches, centroids: np.ndarray, drift: np.ndarray):
    """Pop what has expired by the drift that each cluster has gathered, compare it exactly,
    push it back."""
    k, dims = centroids.shape
    for b in batches:
        for row in b.to_pylist():
            v, cluster = _load(row, dims)
            pairs = list(zip(np.frombuffer(row["heap_keys"], "<f8").tolist(), np.frombuffer(row["heap_items"], "<i4").tolist()))
            ends = np.bincount(cluster, minlength=k).cumsum().tolist()
            heaps = [pairs[a:b] for a, b in zip([0, *ends], ends)]
            expired = []
            for heap, limit in zip(heaps, (drift * (1.0 + SLACK)).tolist()):
                while heap and heap[0][0] <= limit:
                    expired.append(heappop(heap)[1])
            sums = np.zeros((k, dims + 1), np.int64)
            if expired:
                items = np.array(expired)
                part, old = v[items], cluster[items]
                new, gap = _nearest(part, centroids)
                for c, key, i in zip(new.tolist(), (gap + drift[new] * (1.0 - SLACK)).tolist(), expired):
                    heappush(heaps[c], (key, i))
                moved = old != new
                _fold(part[moved], old[moved], -1, sums)
                _fold(part[moved], new[moved], 1, sums)
                cluster[items] = new
            yield _state_row(row["ids"], v, cluster, heaps, sums, len(expired))


def _distances(batches, centroids: np.ndarray):
    for b in batches:
        for row in b.to_pylist():
            v, cluster = _load(row, centroids.shape[1])
            diff = v.astype(np.int64) - centroids[cluster]
            ids = pa.ipc.open_stream(row["ids"]).read_all().column(0).combine_chunks()
            near = pa.array(np.einsum("ij,ij->i", diff, diff))
            yield pa.RecordBatch.from_arrays([ids, pa.array(cluster.astype(np.int32)), near], names=["id", "cluster", "distance"])


def _sums(state: DataFrame, k: int, dims: int) -> list[list[int]]:
    """Exact totals over the blocks: counts and component sums of k clusters, then what was
    compared."""
    rows = state.select(F.posexplode("sums").alias("c", "s")).where("exists(s, x -> x <> 0)")
    exact = [F.sum(F.col("s")[i].cast("decimal(20,0)")).alias(f"s{i}") for i in range(dims + 1)]
    out = [[0] * (dims + 1) for _ in range(k + 1)]
    for r in rows.groupBy("c").agg(*exact).collect():
        out[r.c] = [int(x) for x in r[1:]]
    return out


def cluster_vectors(
    df: DataFrame, k: int = 16, rounds: int = 3, seed: int = 1, dims: int = 64, scale: int = 64, id_col: str = "vec_id", vector_col: str = "embedding"
) -> tuple[DataFrame, list[list[int]], list[int]]:
    """Rows (``id``, ``cluster``, ``distance``), the final centroids, and how many vectors each
    assignment compared with all centroids.

    ``rounds`` times every vector goes to its nearest centroid (ties: smaller number) and
    centroids become the floor of their means (empty ones stay); then vectors are assigned
    once more.  Null, empty, short, long or non-finite vectors are left out; repeated rows
    count each; a null id is never a first centroid but is clustered; with fewer vectors than
    ``k`` there are as many centroids as vectors (with an id).  No vectors, or none with an
    id: no rows.  A scaled component beyond ``LARGEST`` is an error (its distances would not
    fit a long).  Other columns are ignored.  The rows' table stays in the shared folder
    until the caller's ``scratch`` block ends.
    """
    from skiff.session import materialize

    spark = df.sparkSession
    ship_package(spark)
    vectors = integer_vectors(df, dims, scale, id_col, vector_col)
    centroids = first_centroids(vectors, k, seed)
    k = len(centroids)
    if not k:
        return spark.createDataFrame([], "id bigint, cluster int, distance bigint"), [], []

    def stored(frame: DataFrame) -> tuple[DataFrame, str]:
        path = run_dir(spark, "heaps")
        frame.write.parquet(path)
        return spark.read.schema(_STATE).parquet(path), path

    start = np.array(centroids, np.int64)
    state, path = stored(vectors.mapInArrow(lambda it: _first_round(it, start), _STATE))
    drift = np.zeros(k)
    compared = []
    totals = [[0] * (dims + 1) for _ in range(k)]
    for _ in range(rounds):
        *change, (n, *_rest) = _sums(state, k, dims)
        compared.append(n)
        totals = [[a + b for a, b in zip(x, y)] for x, y in zip(totals, change)]
        after = [[s // t[0] for s in t[1:]] if t[0] else c for t, c in zip(totals, centroids)]
        drift = drift + _drifts(centroids, after)
        centroids = after
        now, gathered = np.array(after, np.int64), drift
        before = path
        state, path = stored(state.mapInArrow(lambda it, now=now, gathered=gathered: _later_round(it, now, gathered), _STATE))
        files.delete(spark, before)
    compared.append(_sums(state, k, dims)[k][0])
    final = np.array(centroids, np.int64)
    rows = state.select("ids", "vectors", "width", "cluster").mapInArrow(lambda it: _distances(it, final), "id bigint, cluster int, distance bigint")
    rows = materialize(rows, "clustered")
    files.delete(spark, path)
    return rows, centroids, compared


def op12_centroid_clustering(spark, sf_dir):
    """Contract query: 16 centroids, 3 rounds, the inertia of clusters and of the whole."""
    from skiff.llm.common import table

    rows, centroids, _ = cluster_vectors(table(spark, sf_dir, "embeddings"))
    exact = F.sum(F.col("distance").cast("decimal(20,0)"))
    per = {r.cluster: int(r.d) for r in rows.groupBy("cluster").agg(exact.alias("d")).collect()}  # a row per centroid
    whole = sum(per.values())
    facts = [(c, d, whole, hashlib.sha256(",".join(map(str, centroids[c])).encode()).hexdigest()) for c, d in per.items()]
    known = spark.createDataFrame(facts, "cluster int, cluster_inertia bigint, inertia bigint, centroid_sha256 string")
    return rows.join(F.broadcast(known), "cluster").select(
        F.col("id").alias("vec_id"), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"
    )


def _op12_sql(rounds: int = 3) -> str:
    square = "list_sum(list_transform(range(1, 65), lambda i: (k.v[i] - c.v[i]) * (k.v[i] - c.v[i])))"
    ctes = [
        """kept AS (SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: isfinite(x))) = 64)""",
        """c0 AS (SELECT row_number() OVER (ORDER BY sha256('1:' || vec_id), v) - 1 AS c, v FROM kept WHERE vec_id IS NOT NULL
QUALIFY row_number() OVER (ORDER BY sha256('1:' || vec_id), v) <= 16)""",
    ]
    for r in range(rounds + 1):
        ctes.append(
            f"""a{r} AS (SELECT rid, any_value(vec_id) AS vec_id, any_value(v) AS v, min(dc).d AS d, min(dc).c AS c
FROM (SELECT k.rid, k.vec_id, k.v, {{'d': {square}, 'c': c.c}} AS dc FROM kept k CROSS JOIN c{r} c) GROUP BY rid)"""
        )
        if r < rounds:
            ctes.append(
                f"""m{r} AS (SELECT c, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY i) AS v
FROM (SELECT c, i, sum(v[i]) AS s, count(*) AS n FROM a{r} CROSS JOIN range(1, 65) t(i) GROUP BY c, i) GROUP BY c)"""
            )
            ctes.append(f"c{r + 1} AS (SELECT c.c, coalesce(m.v, c.v) AS v FROM c{r} c LEFT JOIN m{r} m USING (c))")
    return (
        "WITH " + ",\n".join(ctes) + f"""
SELECT a.vec_id, CAST(a.c AS INTEGER) AS cluster, CAST(a.d AS BIGINT) AS distance, CAST(sum(a.d) OVER (PARTITION BY a.c) AS BIGINT) AS cluster_inertia,
CAST(sum(a.d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(CAST(c.v AS VARCHAR[]), ',')) AS centroid_sha256
FROM a{rounds} a JOIN c{rounds} c USING (c)"""
    )


OP12_SQL = _op12_sql()
