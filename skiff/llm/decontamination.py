"""Benchmark decontamination by a prefix-filtered set join, in built-in functions only.

A benchmark item's windows are its runs of ten words (all its words if it has fewer).  A
document holds a window only if it holds every word of it, so the window's rarest word in
the corpus is the one necessary prefix token: documents send only occurrences of such words
into the join.  Position and length bounds drop occurrences too near a text's ends, and the
words around the occurrence must equal the window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skiff.llm.common import lower_ascii, table
from skiff.session import materialize

WINDOW = 10
#: Bits of the sieve that words pass before the join: 2,048 longs at any benchmark size.
SIEVE_BITS = 17
#: The window table is broadcast up to these bounds; beyond them the join shuffles.
BROADCAST_ROWS, BROADCAST_BYTES = 50_000, 16_000_000


def words_of(text: Column) -> Column:
    """Lower-cased (A-Z) words: runs of digits, a-z and everything above 0x7F."""
    t = lower_ascii(F.coalesce(text, F.lit("")))
    return F.array_remove(F.split(t, r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"), "")


def _sieve(words: DataFrame) -> Column:
    """An array literal of bits, set at the hashes of ``words``' single column."""
    h = F.xxhash64(words.columns[0])
    slot = h.bitwiseAND(F.lit((1 << SIEVE_BITS) - 1))
    rows = (
        words.select(F.shiftright(slot, 6).cast("int").alias("slot"), slot.bitwiseAND(F.lit(63)).cast("int").alias("bit"))
        .distinct()
        .groupBy("slot")
        .agg(F.bit_or(F.expr("shiftleft(1L, bit)")).alias("bits"))
        .collect()
    )  # at most 2 ** SIEVE_BITS / 64 rows
    found = {r.slot: r.bits for r in rows}
    text = ",".join(str(found.get(k, 0)) for k in range((1 << SIEVE_BITS) // 64))
    return F.split(F.lit(text), ",").cast("array<bigint>")


def _may_hold(sieve: Column, h: Column) -> Column:
    slot = h.bitwiseAND(F.lit((1 << SIEVE_BITS) - 1))
    return F.getbit(F.get(sieve, F.shiftright(slot, 6).cast("int")), slot.bitwiseAND(F.lit(63)).cast("int")) == 1


def _at(sieve: Column, hashes: str) -> Column:
    """Positions in an array of hashes that pass the sieve."""
    return F.array_compact(F.transform(hashes, lambda h, i: F.when(_may_hold(sieve, h), i)))


def benchmark_windows(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """Distinct windows: win (its words), size, items (ids that have it; a null id is left out)."""
    w = benchmark.select(F.col(id_col).alias("item"), words_of(F.col(text_col)).alias("w")).where(F.size("w") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - (WINDOW - 1), F.lit(1)))
    runs = w.select("item", F.explode(F.transform(starts, lambda i: F.slice(F.col("w"), i, WINDOW))).alias("win"))
    return runs.groupBy("win").agg(F.collect_set("item").alias("items")).withColumn("size", F.size("win"))


def prefix_windows(docs: DataFrame, windows: DataFrame, text_col: str = "text") -> DataFrame:
    """``windows`` plus token (its word that is rarest in the documents) and shift (its place)."""
    vocabulary = windows.select(F.explode("win").alias("word")).distinct()
    sieve = _sieve(vocabulary)
    hashed = docs.select(words_of(F.col(text_col)).alias("w")).select("w", F.transform("w", lambda x: F.xxhash64(x)).alias("h"))
    seen = hashed.select("w", _at(sieve, "h").alias("at")).select(F.explode(F.transform("at", lambda i: F.get("w", i))).alias("word"))
    counts = seen.groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    words = windows.select("win", F.posexplode("win").alias("shift", "word")).join(counts, "word", "left")
    rarest = words.groupBy("win").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "word", "shift")).alias("r"))
    return windows.join(rarest, "win").select(F.col("r.word").alias("token"), F.col("r.shift").alias("shift"), "size", "win", "items")


def find_contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: the id, text_key (a hash of the text), n_words, hit_words
    (sorted positions of the words inside an occurrence of a window), items (sorted distinct
    ids whose windows occur).

    A null text has no words; repeated rows each get their row; an empty table gives none
    and an empty benchmark marks nothing.  Other columns are ignored.
    """
    d = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    windows = materialize(benchmark_windows(benchmark), "windows")
    prefix = materialize(prefix_windows(d, windows), "prefix")
    size = prefix.agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length(F.concat_ws(" ", "win")) + 8 * F.size("items") + 64).alias("b")).first()
    sieve = _sieve(prefix.select("token"))
    # the key tells apart rows by content: it stays the same when a lost task is run again
    key = F.struct("id", F.xxhash64("text").alias("text_key"), F.hash("text", F.lit(1)).alias("more")).alias("key")
    hashed = d.select(key, words_of(F.col("text")).alias("w")).select("key", "w", F.transform("w", lambda x: F.xxhash64(x)).alias("h"))
    placed = hashed.select("key", F.size("w").cast("long").alias("n_words"), "w", _at(sieve, "h").alias("at"))
    first = F.struct(
        F.lit(-1).alias("p"),
        # no word holds a space: a document's own row matches no window, and such rows spread
        F.concat(F.lit(" "), F.col("key.text_key").cast("string"), F.col("key.id").cast("string")).alias("word"),
        F.array().cast("array<string>").alias("near"),
    )
    found = F.transform(
        "at",
        lambda p: F.struct(p.alias("p"), F.get("w", p).alias("word"), F.slice("w", F.greatest(p - (WINDOW - 1), F.lit(0)) + 1, 2 * WINDOW - 1).alias("near")),
    )
    rows = placed.select("key", "n_words", F.explode(F.concat(F.array(first), found)).alias("o")).select("key", "n_words", "o.*")
    low = F.greatest(F.col("p") - (WINDOW - 1), F.lit(0))
    begin = F.col("p") - F.col("shift")
    fits = (begin >= 0) & (begin + F.col("size") <= F.col("n_words"))
    same = F.slice("near", F.greatest(begin - low, F.lit(0)) + 1, F.col("size")) == F.col("win")
    small = size.n <= BROADCAST_ROWS and (size.b or 0) <= BROADCAST_BYTES
    side = F.broadcast(prefix) if small else prefix
    hits = rows.join(side, (F.col("word") == F.col("token")) & fits & same, "left").where("p = -1 or token is not null")
    per_doc = hits.groupBy("key", "n_words").agg(
        F.count(F.when(F.col("p") == -1, 1)).alias("copies"),
        F.collect_set(F.when(F.col("token").isNotNull(), F.struct(begin.alias("a"), (begin + F.col("size")).alias("b")))).alias("found"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"),
    )
    words = F.array_sort(F.array_distinct(F.flatten(F.transform("found", lambda x: F.sequence(x["a"], x["b"] - 1)))))
    out = per_doc.select(F.explode(F.array_repeat("key", F.col("copies").cast("int"))).alias("key"), "n_words", words.alias("hit_words"), "items")
    return out.select(F.col("key.id").alias(id_col), F.col("key.text_key").alias("text_key"), "n_words", "hit_words", "items")


def op3_decontamination(spark, sf_dir):
    """Contract query: hit words and items of every document."""
    c = find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    n_hit = F.size("hit_words").cast("long")
    listed = F.concat_ws(",", F.array_sort(F.transform("items", lambda x: x.cast("string"))))
    return c.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(listed, 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )


_WORDS_SQL = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

OP3_SQL = rf"""
WITH b AS (
  SELECT item_id, w FROM (SELECT item_id, {_WORDS_SQL} AS w FROM benchmark) WHERE len(w) > 0
), win AS (
  SELECT DISTINCT item_id, w[i:i + 9] AS g
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 8, 2))) AS i FROM b)
), d AS (
  SELECT row_number() OVER () AS rid, doc_id, {_WORDS_SQL} AS w FROM documents
), sizes AS (
  SELECT DISTINCT len(g) AS n FROM win
), occ AS (
  SELECT rid, i, n, w[i:i + n - 1] AS g
  FROM (SELECT rid, n, w, unnest(range(1, greatest(len(w) - n + 2, 1))) AS i FROM d, sizes)
), hit AS (
  SELECT DISTINCT occ.rid, occ.i, occ.n, win.item_id FROM occ JOIN win ON occ.g = win.g
), marked AS (
  SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(range(i, i + n)) AS p FROM hit) GROUP BY rid
), it AS (
  SELECT rid, count(*) AS n_items, string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids
  FROM (SELECT DISTINCT rid, item_id FROM hit WHERE item_id IS NOT NULL) GROUP BY rid
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN marked USING (rid) LEFT JOIN it USING (rid)
"""
