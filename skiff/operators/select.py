"""Select: selected paths -> patterns -> de-duplicated file set, plus validation and gate.

IDs: SRC-3, SCL-3..7, JON-1, AGG-1, AGG-2, AGG-9, RUN-7.

The reference turns each selected path into two globs, cuts each glob back to a plain
listing prefix and lists every prefix; an object under two prefixes is found twice and
removed by a distinct.  Here the listing is one DataFrame and matching is an equality
join:

* ``boundary="path"`` (default): an object matches prefix ``q`` when ``q`` is the root,
  the key itself, or a folder above it.  Each key is exploded into its ancestor paths
  (``depth + 1`` short rows, generated and consumed inside one stage) and semi-joined on
  ``(bucket, depth, ancestor) = (bucket, depth(q), q)``.
* ``boundary="prefix"`` lists as storage does (``startswith``, so ``Jan/1`` also takes
  ``Jan/10``): keys are exploded into their leading parts of the lengths that occur among
  the prefixes (a handful; an object name has at most 1,024 bytes) and joined on
  ``(bucket, leading part)``.

The depth is in the key because with empty segments (``/a``) one folder text occurs at
two depths.

Before matching, prefixes covered by another selected prefix are dropped (same equality
trick on the small pattern side), so each object meets at most one prefix and the
result needs no distinct: no shuffle of the listing at all when the pattern side is
broadcast.  The pattern side is broadcast only behind a check of its bytes; above the bound
the join is left to the planner (sort-merge, AQE skew splitting).
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import columns as C
from ..session import materialize

#: Text of the pattern side that may be broadcast.
BROADCAST_BYTES_MAX = 16 << 20
#: Distinct extensions up to which objects are filtered by them before the join.
EXTENSIONS_MAX = 32


# SRC-3 -----------------------------------------------------------------------------------
def selection(spark: SparkSession, bucket: str, paths: list[str]) -> DataFrame:
    """In-memory selection (the request body): one row per selected path."""
    return spark.createDataFrame([(bucket, p) for p in paths], "bucket string, path string")


# SCL-7 -----------------------------------------------------------------------------------
def build_patterns(sel: DataFrame, ext: str = C.DEFAULT_EXTENSION) -> DataFrame:
    """Two globs per selected path: ``gs://b/p/*.bz2`` and ``gs://b/p/**/*.bz2``."""
    return sel.select(
        "bucket",
        "path",
        F.posexplode(C.pattern_pair(F.col("bucket"), F.col("path"), ext)).alias("glob_no", "pattern"),
    )


# SCL-3, SCL-4, SCL-6 ---------------------------------------------------------------------
def parse_patterns(patterns: DataFrame) -> DataFrame:
    """Adds ``scheme_ok``, ``well_formed``, ``p_bucket``, ``prefix``, ``ext``."""
    p = F.col("pattern")
    return patterns.select(
        "*",
        C.has_scheme(p).alias("scheme_ok"),
        C.is_valid_pattern(p).alias("well_formed"),
        C.uri_bucket(p).alias("p_bucket"),
        C.list_prefix(C.uri_key(p)).alias("prefix"),
        C.pattern_extension(p).alias("ext"),
    )


def prefixes_of(patterns: DataFrame) -> DataFrame:
    """Distinct ``(bucket, prefix)`` listed by a pattern set (``gs://`` patterns only)."""
    pp = parse_patterns(patterns).where("scheme_ok")
    return pp.select(F.col("p_bucket").alias("bucket"), "prefix").distinct()


# key explosion ---------------------------------------------------------------------------
def _head(key: Column, j: Column) -> Column:
    """The first ``j`` segments of ``key`` (``substring_index`` with a column count)."""
    return F.call_function("substring_index", key, F.lit("/"), j)


def _ancestors(key: Column) -> Column:
    """(depth j, first j segments) for j = 0 .. number of segments: '', ..., the key itself.

    The depth is part of the join key: with empty segments (``/a``, ``a//b``) the same
    text can occur at two depths.
    """
    n = F.size(F.split(key, "/", -1))
    return F.transform(
        F.sequence(F.lit(0), n), lambda j: F.struct(j.alias("depth"), _head(key, j).alias("anc"))
    )


def _path_depth(prefix: Column) -> Column:
    """Number of segments of a prefix ('' has none)."""
    return F.when(prefix == "", F.lit(0)).otherwise(F.size(F.split(prefix, "/", -1)))


def _leading_parts(key: Column, lengths: list[int]) -> Column:
    """The first ``n`` characters of the key for every ``n`` of ``lengths`` that it reaches."""
    fit = F.filter(F.array(*[F.lit(n) for n in lengths]), lambda n: n <= F.length(key))
    return F.transform(fit, lambda n: F.substring(key, F.lit(1), n))


def _lengths(prefixes: DataFrame) -> list[int]:
    """Distinct prefix lengths (no more than an object name is long)."""
    return sorted(r[0] for r in prefixes.select(F.length("prefix")).distinct().collect())


def reduce_prefixes(prefixes: DataFrame, boundary: str = "path") -> DataFrame:
    """Drop every prefix that another prefix of the set already covers."""
    q = F.col("prefix")
    if boundary == "path":
        proper = F.transform(
            F.slice(_ancestors(q), 1, F.greatest(F.size(F.split(q, "/", -1)), F.lit(1))), lambda a: a["anc"]
        )
        proper = F.when(q == "", F.array().cast("array<string>")).otherwise(proper)
    elif boundary == "prefix":
        proper = F.transform(F.sequence(F.lit(0), F.length(q) - 1), lambda k: F.substring(q, 1, k))
        proper = F.when(q == "", F.array().cast("array<string>")).otherwise(proper)
    else:
        raise ValueError(f"boundary must be 'path' or 'prefix', not {boundary!r}")
    covered = (
        prefixes.select("bucket", "prefix", F.explode(proper).alias("anc"))
        .join(
            prefixes.select("bucket", F.col("prefix").alias("anc")),
            ["bucket", "anc"],
            "left_semi",
        )
        .select("bucket", "prefix")
    )
    return prefixes.join(covered, ["bucket", "prefix"], "left_anti")


#: Bits of a prefix side's sieve: eight a prefix, within these bounds (1 MB at most).
SIEVE_BITS_MIN, SIEVE_BITS_MAX = 12, 23


def _sieve(side: DataFrame, columns: list[str]):
    """A Bloom filter of a side's keys: a function of the key columns that is true for every
    key of the side and for about one in twenty others.  None where the side has too many
    keys for it to hold anything back."""
    n = side.count()
    bits = max(SIEVE_BITS_MIN, (8 * n).bit_length())
    if bits > SIEVE_BITS_MAX:
        return None

    def slots(key: list[Column]) -> list[Column]:
        h = F.xxhash64(*key)
        return [F.shiftrightunsigned(h, k).bitwiseAND(F.lit((1 << bits) - 1)) for k in (0, 32)]

    places = F.explode(F.array(*slots([F.col(c) for c in columns]))).alias("p")
    set_ = side.select(places).select(F.shiftright("p", 6).cast("int").alias("slot"), F.col("p").bitwiseAND(F.lit(63)).cast("int").alias("bit"))
    rows = set_.distinct().groupBy("slot").agg(F.bit_or(F.expr("shiftleft(1L, bit)")).alias("bits")).collect()  # at most 2 ** bits / 64
    found = {r.slot: r.bits for r in rows}
    words = F.split(F.lit(",".join(str(found.get(k, 0)) for k in range(1 << (bits - 6)))), ",").cast("array<bigint>")

    def may_hold(*key: Column) -> Column:
        tests = [F.getbit(F.get(words, F.shiftright(p, 6).cast("int")), p.bitwiseAND(F.lit(63)).cast("int")) == 1 for p in slots(list(key))]
        return tests[0] & tests[1]

    return may_hold


def _side(df: DataFrame, limit: int, columns: list[str]) -> tuple[DataFrame, Callable[..., Column]]:
    """The prefix side of a join, and a test that its keys pass.

    Broadcast only behind a check of the side's bytes.  Above the limit the planner picks the
    join (sort-merge with AQE skew splitting), and the exploded keys pass a sieve of the side
    before they are shuffled.  The side is written once, as a table in the shared folder, so
    the check, the sieve and the join share one computation."""
    df = materialize(df, "side")
    texts = [F.octet_length(c) for c, t in df.dtypes if t == "string"]
    size = df.agg(F.coalesce(F.sum(sum(texts, F.lit(16))), F.lit(0))).first()[0]
    if size <= limit:
        return F.broadcast(df), lambda *key: F.lit(True)
    return df, _sieve(df, columns) or (lambda *key: F.lit(True))


# JON-1 + AGG-1 + AGG-2 -------------------------------------------------------------------
def match_prefixes(
    objects: DataFrame,
    prefixes: DataFrame,
    boundary: str = "path",
    broadcast_limit: int = BROADCAST_BYTES_MAX,
    reduced: bool = False,
) -> DataFrame:
    """Objects (all columns) under any of ``prefixes(bucket, prefix)``; each object once."""
    red = prefixes if reduced else reduce_prefixes(prefixes, boundary)
    bucket = F.col("bucket")
    if boundary == "path":
        side, may_hold = _side(
            red.select("bucket", _path_depth(F.col("prefix")).alias("_depth"), F.col("prefix").alias("_anc")),
            broadcast_limit,
            ["bucket", "_depth", "_anc"],
        )
        ancestors = F.filter(_ancestors(F.col("key")), lambda a: may_hold(bucket, a["depth"], a["anc"]))
        exploded = objects.select("*", F.explode(ancestors).alias("_a"))
        exploded = exploded.select("*", F.col("_a.depth").alias("_depth"), F.col("_a.anc").alias("_anc")).drop("_a")
        hit = exploded.join(side, ["bucket", "_depth", "_anc"], "left_semi")
        return hit.drop("_depth", "_anc")
    side, may_hold = _side(red.select("bucket", "prefix"), broadcast_limit, ["bucket", "prefix"])
    lengths = _lengths(side)
    if not lengths:
        return objects.limit(0)
    parts = F.filter(_leading_parts(F.col("key"), lengths), lambda p: may_hold(bucket, p))
    exploded = objects.select("*", F.explode(parts).alias("_part"))
    return exploded.join(side.withColumnRenamed("prefix", "_part"), ["bucket", "_part"], "left_semi").select(*objects.columns)


def select_objects(
    objects: DataFrame,
    patterns: DataFrame,
    boundary: str = "path",
    exts: tuple[str, ...] = (C.DEFAULT_EXTENSION,),
    broadcast_limit: int = BROADCAST_BYTES_MAX,
) -> DataFrame:
    """The de-duplicated file set of a pattern set (list + distinct)."""
    files = objects.where(C.has_any_suffix("key", exts))
    return match_prefixes(files, prefixes_of(patterns), boundary, broadcast_limit)


# AGG-9 ------------------------------------------------------------------------------------
def validate_patterns(
    objects: DataFrame,
    patterns: DataFrame,
    broadcast_limit: int = BROADCAST_BYTES_MAX,
    boundary: str = "prefix",
    exts: tuple[str, ...] = (),
) -> DataFrame:
    """Per distinct pattern: files under its listing prefix with its extension, exact.

    Patterns are grouped by (bucket, prefix, extension) first, counted once per group by an
    equality join and mapped back.  ``boundary="path"`` counts what the read of a job with
    that boundary takes.  ``exts``: a source's own extensions, longest match first; without
    them a pattern's extension is read from the pattern.  ``truncated`` is always false: no
    count stops early.  ``entries`` is how many times the pattern occurs in the list (totals
    are summed over entries).
    """
    pp = parse_patterns(patterns)
    ext = F.col("ext")
    for e in sorted(exts, key=len):  # the longest suffix is tested last and wins
        ext = F.when(F.col("pattern").endswith(e), F.lit(e)).otherwise(ext)
    per = pp.groupBy("pattern").agg(
        F.count(F.lit(1)).alias("entries"),
        F.first("scheme_ok").alias("scheme_ok"),
        F.first("p_bucket").alias("p_bucket"),
        F.first("prefix").alias("prefix"),
        F.first(ext).alias("ext"),
    )
    groups = per.where("scheme_ok").select(F.col("p_bucket").alias("bucket"), "prefix", "ext").distinct()
    bucket = F.col("bucket")
    by = ["bucket", "depth", "prefix"] if boundary == "path" else ["bucket", "prefix"]
    side, may_hold = _side(groups.withColumn("depth", _path_depth(F.col("prefix"))), broadcast_limit, by)
    # objects of no extension that occurs are left out before their keys are exploded
    kinds = [r.ext for r in side.select("ext").distinct().limit(EXTENSIONS_MAX + 1).collect()]
    if len(kinds) <= EXTENSIONS_MAX:
        objects = objects.where(functools.reduce(Column.__or__, [F.col("key").endswith(k) for k in kinds if k is not None], F.lit(False)))
    if boundary == "path":
        ancestors = F.filter(_ancestors(F.col("key")), lambda a: may_hold(bucket, a["depth"], a["anc"]))
        rows = objects.select("bucket", "key", F.explode(ancestors).alias("_a"))
        rows = rows.select("bucket", "key", F.col("_a.depth").alias("depth"), F.col("_a.anc").alias("prefix"))
        hits = rows.join(side, ["bucket", "depth", "prefix"])
    else:
        lengths = _lengths(side) or [0]
        parts = F.filter(_leading_parts(F.col("key"), lengths), lambda p: may_hold(bucket, p))
        rows = objects.select("bucket", "key", F.explode(parts).alias("prefix"))
        hits = rows.join(side, ["bucket", "prefix"])
    counts = hits.where(F.col("key").endswith(F.col("ext"))).groupBy("bucket", "prefix", "ext").agg(F.count(F.lit(1)).alias("_n"))
    out = per.join(counts.withColumnRenamed("bucket", "p_bucket"), ["p_bucket", "prefix", "ext"], "left")
    n = F.coalesce(F.col("_n"), F.lit(0)).cast("long")
    return out.select(
        "pattern",
        F.col("entries").cast("long").alias("entries"),
        F.when(F.col("scheme_ok"), n).otherwise(F.lit(0).cast("long")).alias("file_count"),
        (F.col("scheme_ok") & (n > 0)).alias("valid"),
        F.lit(False).alias("truncated"),
        F.when(~F.col("scheme_ok"), F.lit("Pattern must start with gs://")).alias("error"),
    )


def validation_summary(per_pattern: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """One row: totals summed over pattern entries, ``all_valid``, ``submit_ok``.

    With ``files`` (the de-duplicated file set) it also reports ``distinct_files``; both
    inputs go through one union + global aggregate, no join.
    """
    parts = per_pattern.select(
        (F.col("file_count") * F.col("entries")).alias("_t"),
        F.col("entries").alias("_e"),
        F.col("valid").alias("_v"),
        F.lit(0).cast("long").alias("_d"),
    )
    if files is not None:
        parts = parts.unionByName(
            files.select(
                F.lit(0).cast("long").alias("_t"),
                F.lit(0).cast("long").alias("_e"),
                F.lit(None).cast("boolean").alias("_v"),
                F.lit(1).cast("long").alias("_d"),
            )
        )
    agg = parts.agg(
        F.coalesce(F.sum("_t"), F.lit(0)).cast("long").alias("total_files"),
        F.coalesce(F.sum("_e"), F.lit(0)).cast("long").alias("n_patterns"),
        F.coalesce(F.bool_and("_v"), F.lit(False)).alias("all_valid"),
        F.coalesce(F.sum("_d"), F.lit(0)).cast("long").alias("distinct_files"),
    )
    agg = agg.select("*", (F.col("all_valid") & (F.col("total_files") > 0)).alias("submit_ok"))
    return agg if files is not None else agg.drop("distinct_files")


def selection_summary(sel: DataFrame, files: DataFrame) -> DataFrame:
    """AGG-11: selected paths, de-duplicated files and their bytes (one union + aggregate)."""
    parts = sel.select(F.lit(1).cast("long").alias("_p"), F.lit(0).cast("long").alias("_f"),
                       F.lit(0).cast("long").alias("_b")).unionByName(
        files.select(F.lit(0).cast("long").alias("_p"), F.lit(1).cast("long").alias("_f"),
                     F.col("size_bytes").cast("long").alias("_b")))
    return parts.agg(
        F.coalesce(F.sum("_p"), F.lit(0)).cast("long").alias("selected_paths"),
        F.coalesce(F.sum("_f"), F.lit(0)).cast("long").alias("files"),
        F.coalesce(F.sum("_b"), F.lit(0)).cast("long").alias("size_bytes"),
    )


# RUN-7 ------------------------------------------------------------------------------------
class ValidationError(ValueError):
    pass


def gate(summary: DataFrame) -> dict:
    """Raise unless every pattern matched something and the total is positive."""
    row = summary.first().asDict()
    if not row["submit_ok"]:
        raise ValidationError(f"the selection does not validate ({row['total_files']} files, {row['n_patterns']} patterns)")
    return row
