"""NDJSON: strict validation and JSON-array documents (SCL-13, SNK-5, SRC-6, SRC-7).

Validation stays JVM-side and needs no session setting.  A line is valid when

* ``[`` line ``]`` is an array of exactly one element (``json_array_length``), and
* ``{"v":`` line ``}`` is read by ``from_json`` without a corrupt record,

which together accept exactly one JSON value with optional surrounding whitespace.  Neither
keeps what it reads, so repeated keys are valid at any depth, as they are to Python's ``json``
module.  The first form forgives single quotes and control characters, the second forgives
what follows its closing brace, so a line has to pass both.  ``NaN`` and ``Infinity`` are
not JSON here; numbers of more than 1,000 digits and values nested deeper than 1,000 levels
are beyond Spark's JSON reader and count as invalid.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_DUPLICATE_KEYS = "spark.sql.variant.allowDuplicateKeys"
_STRICT = {
    "mode": "PERMISSIVE",
    "columnNameOfCorruptRecord": "_bad",
    "allowSingleQuotes": "false",
    "allowUnescapedControlChars": "false",
    "allowNonNumericNumbers": "false",
}


def is_valid_json(line) -> Column:
    v = F.col(line) if isinstance(line, str) else line
    one = F.json_array_length(F.concat(F.lit("["), v, F.lit("]"))) == 1
    member = F.from_json(F.concat(F.lit('{"v":'), v, F.lit("}")), "_bad string", _STRICT)
    return F.coalesce(one & member.isNotNull() & member["_bad"].isNull(), F.lit(False))


def session_beside(spark: SparkSession) -> SparkSession:
    """A session beside the caller's, on the same cluster and with its SQL settings, in which
    a VARIANT may be parsed from an object with repeated keys (the last value counts)."""
    other = spark.newSession()
    for key, value in spark.conf.getAll.items():
        if key.startswith("spark.sql.") and spark.conf.isModifiable(key):
            other.conf.set(key, value)
    other.conf.set(_DUPLICATE_KEYS, "true")
    return other


def validate(lines: DataFrame, col: str = "value") -> DataFrame:
    """Adds a boolean ``valid`` column (see module doc)."""
    return lines.withColumn("valid", is_valid_json(col))


def write_split(lines: DataFrame, out: str, col: str = "value") -> None:
    """SNK-5: valid and rejected lines in ``valid=true`` and ``valid=false``, by one pass."""
    v = validate(lines, col).select(F.col(col).alias("value"), "valid")
    v.write.option("lineSep", "\n").partitionBy("valid").text(out)


def read_split(spark, out: str) -> DataFrame:
    """``value``, ``valid`` of a ``write_split`` output."""
    return spark.read.schema("value string, valid boolean").option("lineSep", "\n").text(out).select("value", "valid")


def parse_lines(lines: DataFrame, schema: str, col: str = "value") -> DataFrame:
    """SNK-6 input: typed columns from valid NDJSON lines (``from_json`` with a fixed schema)."""
    return lines.select("*", F.from_json(F.col(col), schema).alias("_j")).select("*", "_j.*").drop("_j")


def explode_json_array(docs: DataFrame, col: str = "value") -> DataFrame:
    """SRC-7: each element of a whole-file JSON array becomes one compact JSON line.

    A document that is not a JSON array gives one row with a null ``value``; a failed parse
    never fails the job.
    """
    parsed = docs.select("*", F.try_parse_json(F.col(col)).alias("_doc")).drop(col)
    items = parsed.select(
        *[c for c in parsed.columns if c != "_doc"],
        F.posexplode_outer(F.try_variant_get("_doc", "$", "array<variant>")).alias("item_no", "_item"),
    )
    return items.select(
        *[c for c in items.columns if c not in ("_item",)],
        F.when(F.col("_item").isNotNull(), F.to_json("_item")).alias("value"),
    )
