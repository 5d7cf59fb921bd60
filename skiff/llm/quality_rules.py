"""Quality rules: a threshold table compiled into one Spark projection.

Statistics of a text are built from built-in functions in a few projections over the same
row (no shuffle, no user function); ``RULES`` then becomes one boolean expression per rule.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skiff.llm.common import SPACE_CLASS, spaced_words

#: Frequent function words of the four languages, as they stand and capitalised.
STOP_WORDS = tuple(
    "the of and to in a is that it for was on are as with be at by this from or an re "
    "de la le les et des en du que un une est pour qui dans par sur pas au avec "
    "el los las se del por con para su no lo como más "
    "der die und das den von zu mit ist im für auf nicht ein eine dem".split()
)
_STOPS = tuple(dict.fromkeys([*STOP_WORDS, *(w.capitalize() for w in STOP_WORDS)]))

SYMBOLS = r"[#*$%&|<>]"
#: Letters that none of the four languages writes with: other Latin letters, other alphabets,
#: syllables and ideographs (ranges of code points).
OTHER_LETTERS = r"[\x{100}-\x{151}\x{154}-\x{24F}\x{370}-\x{1DBF}\x{1EA0}-\x{1FFF}\x{3040}-\x{30FF}\x{3400}-\x{9FFF}\x{AC00}-\x{D7A3}]"
WINDOW = 5

#: (rule, numerator, denominator or None, least, most); a missing bound is None.
#: A text passes a rule if least <= numerator / denominator <= most.  No text is too long.  The
#: stop words are those of four languages: text in letters of others is not asked for them.
RULES: tuple[tuple[str, str, str | None, float | None, float | None], ...] = (
    ("length", "n_words", None, 10, None),
    ("word_length", "word_chars", "n_words", 1.5, 20.0),
    ("symbols", "n_symbols", "n_words", None, 0.1),
    ("exclamations", "n_exclaims", "n_words", None, 0.5),
    ("stop_words", "n_stop_words + n_other_letters", "n_words", 0.01, None),
    ("repeated_lines", "n_dup_lines", "n_lines", None, 0.4),
    ("line_length", "n_words", "n_lines", 2.0, None),
)


def _sorted_windows(gram: Column) -> Column:
    return F.array_sort(F.transform(gram, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))


def text_stats(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` without its text, plus long columns: n_words, word_chars, n_symbols,
    n_exclaims, n_other_letters, n_stop_words, n_lines (lines with a word), n_dup_lines,
    n_repeat_words.

    Windows of five words are compared by a 64-bit hash.  A null text counts as empty.
    Columns of ``docs`` with one of these names are replaced.
    """
    names = ("n_words", "word_chars", "n_symbols", "n_exclaims", "n_other_letters", "n_stop_words", "n_lines", "n_dup_lines", "n_repeat_words")
    keep = [c for c in docs.columns if c != text and c not in names]
    t = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    first = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in keep]).alias("_row") if keep else F.struct(F.lit(1)).alias("_row"),
        spaced_words(F.col(f"`{text}`")).alias("_w"),
        F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("_l"),
        F.regexp_count(t, F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        F.regexp_count(t, F.lit("!")).cast("long").alias("n_exclaims"),
        # (a text in ASCII alone has none)
        F.when(F.octet_length(t) > F.length(t), F.regexp_count(t, F.lit(OTHER_LETTERS))).otherwise(0).cast("long").alias("n_other_letters"),
    )
    counted = first.select(
        "_row",
        "n_symbols",
        "n_exclaims",
        "n_other_letters",
        F.size("_w").cast("long").alias("n_words"),
        F.length(F.array_join("_w", "")).cast("long").alias("word_chars"),
        F.size(F.filter("_w", lambda w: w.isin(*_STOPS))).cast("long").alias("n_stop_words"),
        F.size("_l").cast("long").alias("n_lines"),
        (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"),
        F.transform("_w", lambda w: F.xxhash64(w)).alias("_h"),
    )
    base = ["_row", "n_symbols", "n_exclaims", "n_other_letters", "n_words", "word_chars", "n_stop_words", "n_lines", "n_dup_lines"]
    h = F.col("_h")
    grams = counted.select(
        *base,
        F.when(
            F.size(h) >= WINDOW,
            F.transform(
                F.sequence(F.lit(0), F.greatest(F.size(h) - WINDOW, F.lit(0))),
                lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(WINDOW)]),
            ),
        ).otherwise(F.array().cast("array<bigint>")).alias("_g"),
    )
    # most texts repeat no window: only the others are sorted
    g = F.col("_g")
    empty = F.array().cast("array<struct<h:bigint,i:int>>")
    ordered = grams.select(*base, F.when(F.size(F.array_distinct(g)) < F.size(g), _sorted_windows(g)).otherwise(empty).alias("_s"))
    s = F.col("_s")
    rest = F.greatest(F.size(s) - 1, F.lit(0))
    no = F.array(F.lit(None).cast("struct<h:bigint,i:int>"))
    paired = ordered.select(
        *base,
        F.zip_with(s, F.concat(F.slice(s, 2, rest), no), lambda a, b: F.struct(a.alias("a"), (a["h"] == b["h"]).alias("n"))).alias("_n"),
        F.concat(F.array(F.lit(None).cast("bigint")), F.transform(F.slice(s, 1, rest), lambda a: a["h"])).alias("_p"),
    )
    marked = paired.select(
        *base,
        F.array_sort(
            F.array_compact(
                F.zip_with(
                    "_n",
                    F.slice("_p", 1, F.size("_n")),
                    lambda x, p: F.when(F.coalesce(x["n"], F.lit(False)) | (x["a"]["h"] == p), x["a"]["i"]),
                )
            )
        ).alias("_at"),
    )
    at = F.col("_at")
    more = F.greatest(F.size(at) - 1, F.lit(0))
    gaps = F.zip_with(F.slice(at, 1, more), F.slice(at, 2, more), lambda a, b: F.least(b - a, F.lit(WINDOW)))
    covered = F.when(F.size(at) > 0, F.aggregate(gaps, F.lit(WINDOW), lambda acc, x: acc + x)).otherwise(0)
    out = marked.select(*base, covered.cast("long").alias("n_repeat_words"))
    return out.select(*[F.col("_row")[c].alias(c) for c in keep], *names)


def _passes(rule: tuple[str, str, str | None, float | None, float | None]) -> Column:
    _name, num, den, least, most = rule
    scale = F.col(den).cast("double") if den else F.lit(1.0)
    value = F.expr(num).cast("double")
    checks = [value >= F.lit(float(least)) * scale] if least is not None else []
    checks += [value <= F.lit(float(most)) * scale] if most is not None else []
    return reduce(lambda a, b: a & b, checks, F.lit(True))


def quality_rules(docs: DataFrame, text: str = "text", rules=RULES) -> DataFrame:
    """``text_stats`` plus ``failed_rules`` (names in the table's order) and ``passes``.

    An empty or null text fails the length rule.
    """
    stats = text_stats(docs, text)
    failed = F.array_compact(F.array(*[F.when(~_passes(r), F.lit(r[0])) for r in rules]))
    out = stats.withColumn("failed_rules", failed)
    return out.withColumn("passes", F.size("failed_rules") == 0)


def op9_quality_rules(spark, sf_dir):
    """Contract query: counts, the base rule and the verdict for every document."""
    from skiff.llm.common import table

    q = quality_rules(table(spark, sf_dir, "documents").select("doc_id", "text"))
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return q.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), (~failed & F.col("passes")).alias("kept")
    )


def _sql_rule(rule) -> str:
    _name, num, den, least, most = rule
    scale = f"CAST({den} AS DOUBLE)" if den else "1.0"
    parts = [f"{num} >= {float(least)!r}::DOUBLE * {scale}"] if least is not None else []
    parts += [f"{num} <= {float(most)!r}::DOUBLE * {scale}"] if most is not None else []
    return "(" + " AND ".join(parts) + ")"


_STOP_SQL = ", ".join("'" + w + "'" for w in _STOPS)

OP9_SQL = rf"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents
), w AS (
  SELECT rid, doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w,
         list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l
  FROM d
), p AS (
  SELECT rid, i, w[i:i + 4] AS g FROM (SELECT rid, w, unnest(range(1, greatest(len(w) - 3, 1))) AS i FROM w)
), r AS (
  SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS n FROM p) WHERE n > 1
), c AS (
  SELECT rid, sum(least(5, coalesce(nxt - i, 5)))::BIGINT AS n
  FROM (SELECT rid, i, lead(i) OVER (PARTITION BY rid ORDER BY i) AS nxt FROM r) GROUP BY rid
), s AS (
  SELECT doc_id, len(w)::BIGINT AS n_words, length(list_aggregate(list_concat(w, ['']), 'string_agg', ''))::BIGINT AS word_chars,
         (length(t) - length(regexp_replace(t, '{SYMBOLS}', '', 'g')))::BIGINT AS n_symbols,
         (length(t) - length(replace(t, '!', '')))::BIGINT AS n_exclaims,
         (length(t) - length(regexp_replace(t, '{OTHER_LETTERS}', '', 'g')))::BIGINT AS n_other_letters,
         len(list_filter(w, lambda x: x IN ({_STOP_SQL})))::BIGINT AS n_stop_words,
         len(l)::BIGINT AS n_lines, (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines,
         coalesce(c.n, 0)::BIGINT AS n_repeat_words
  FROM w LEFT JOIN c USING (rid)
), f AS (
  SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
         {" AND ".join(_sql_rule(r) for r in RULES)} AS passes
  FROM s
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND passes AS kept
FROM f
"""
