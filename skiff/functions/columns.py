"""Scalar Column expressions (SCL-*).  All JVM-side; no Python UDFs.

Every function takes and returns ``pyspark.sql.Column`` so it composes inside one
whole-stage-codegen span with the scans and filters around it.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values that must equal the reference's -------------------------------------
# Whitespace: Python's ``str.strip()``/``str.isspace()`` set.  Java's Unicode ``\s``
# (White_Space) plus the four information separators U+001C..U+001F gives the same set
# on every code point.
WS_CLASS = r"[\s\x1c-\x1f]"
# Byte units, 1024 steps.
BYTE_UNITS = ["B", "KB", "MB", "GB", "TB"]
# Service job state -> run status; anything else -> "running".
STATE_MAP = {
    "JOB_STATE_RUNNING": "running",
    "JOB_STATE_DONE": "completed",
    "JOB_STATE_FAILED": "failed",
    "JOB_STATE_CANCELLED": "cancelled",
    "JOB_STATE_PENDING": "submitted",
    "JOB_STATE_QUEUED": "submitted",
}
# Process type -> short label; anything else -> itself.
PROCESS_LABELS = {
    "decompress_only": "Decomp",
    "decompress_and_concatenate": "Concat",
    "decompress_concatenate_parse": "Parse",
    "direct_to_bigquery": "BigQuery",
}
# Statuses that are refreshed from the service; the others are final.
ACTIVE_STATUSES = ["submitted", "running"]
TERMINAL_STATUSES = ["completed", "failed", "cancelled"]
# Pattern suffix -> file extension; default ".bz2".
PATTERN_EXTENSIONS = [("*.bz2", ".bz2"), ("*.json", ".json"), ("*.gz", ".gz")]
DEFAULT_EXTENSION = ".bz2"
URI_SCHEME = "gs://"
DATE_RE = r"([0-9]{4}-[0-9]{2}-[0-9]{2})"
# ---------------------------------------------------------------------------------------

_STRIP_RE = rf"(?U)\A{WS_CLASS}+|{WS_CLASS}+\z"
_BLANK_RE = rf"(?U)\A{WS_CLASS}*\z"


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


# SCL-1 ---------------------------------------------------------------------------------
def strip_ws(text) -> Column:
    """Python ``str.strip()`` on the whole value."""
    return F.regexp_replace(_c(text), _STRIP_RE, "")


def is_blank(line) -> Column:
    """True when the line is empty after ``str.strip()``."""
    return _c(line).rlike(_BLANK_RE)


def split_lines(text) -> Column:
    """Strip the whole document, split on ``\\n`` only (``\\r`` survives)."""
    return F.split(strip_ws(text), "\n", -1)


# SCL-2 / SCL-8 ---------------------------------------------------------------------------
def has_suffix(key, ext: str) -> Column:
    return _c(key).endswith(ext)


def has_any_suffix(key, exts) -> Column:
    cond = F.lit(False)
    for e in exts:
        cond = cond | _c(key).endswith(e)
    return cond


def is_folder_placeholder(key) -> Column:
    return _c(key).endswith("/")


# SCL-3 -----------------------------------------------------------------------------------
def pattern_extension(pattern) -> Column:
    expr = F.lit(DEFAULT_EXTENSION)
    for suffix, ext in reversed(PATTERN_EXTENSIONS):
        expr = F.when(_c(pattern).endswith(suffix), F.lit(ext)).otherwise(expr)
    return expr


# SCL-4 -----------------------------------------------------------------------------------
def uri_bucket(uri) -> Column:
    """Text between the scheme and the first ``/``."""
    return F.regexp_extract(_c(uri), r"^[a-z0-9]+://([^/]*)", 1)


def uri_key(uri) -> Column:
    """Everything after ``scheme://bucket/``."""
    return F.regexp_extract(_c(uri), r"^[a-z0-9]+://[^/]*/?(.*)$", 1)


def rstrip_slash(x) -> Column:
    return F.regexp_replace(_c(x), "/+$", "")


def list_prefix(pattern_key) -> Column:
    """Listing prefix of a glob: text before the first ``*`` with trailing ``/`` removed.

    (Cutting at the first ``**`` and then at the first ``*`` is the same as cutting at
    the first ``*``.)
    """
    return rstrip_slash(F.substring_index(_c(pattern_key), "*", 1))


# SCL-5 -----------------------------------------------------------------------------------
def normalize_path(path) -> Column:
    """Strip leading and trailing ``/`` (Python ``str.strip('/')``)."""
    return F.regexp_replace(_c(path), "^/+|/+$", "")


# SCL-6 -----------------------------------------------------------------------------------
def has_scheme(pattern) -> Column:
    return _c(pattern).startswith(URI_SCHEME)


def is_valid_pattern(pattern) -> Column:
    """Starts with ``gs://`` and has no other ``//``."""
    rest = F.substring(_c(pattern), len(URI_SCHEME) + 1, 1 << 30)
    return has_scheme(pattern) & ~rest.contains("//")


# SCL-7 -----------------------------------------------------------------------------------
def pattern_pair(bucket, path, ext: str = DEFAULT_EXTENSION) -> Column:
    """The two globs of a selected path: ``p/*ext`` and ``p/**/*ext`` (bucket root if empty)."""
    clean = normalize_path(path)
    base = F.when(clean == "", F.concat(F.lit(URI_SCHEME), _c(bucket))).otherwise(
        F.concat(F.lit(URI_SCHEME), _c(bucket), F.lit("/"), clean)
    )
    return F.array(F.concat(base, F.lit(f"/*{ext}")), F.concat(base, F.lit(f"/**/*{ext}")))


# SCL-9 -----------------------------------------------------------------------------------
def last_segment(key) -> Column:
    return F.element_at(F.split(_c(key), "/", -1), -1)


def parent_path(key) -> Column:
    """Key without its last segment ('' at the root)."""
    return F.regexp_extract(_c(key), r"^(.*)/[^/]*$", 1)


def first_segment(key) -> Column:
    return F.substring_index(_c(key), "/", 1)


# SCL-10 ----------------------------------------------------------------------------------
def extract_date(key) -> Column:
    """First ``YYYY-MM-DD`` anywhere in the key; '' when there is none."""
    return F.regexp_extract(_c(key), DATE_RE, 1)


# SCL-11 ----------------------------------------------------------------------------------
def _unit_parts(b: Column) -> tuple[Column, Column]:
    """(value scaled into its unit, unit name) as one CASE ladder, largest unit first."""
    scaled, unit = b.cast("double"), F.lit(BYTE_UNITS[0])
    for i in range(1, len(BYTE_UNITS)):
        cond = b >= F.lit(1024**i)
        scaled = F.when(cond, b.cast("double") / F.lit(float(1024**i))).otherwise(scaled)
        unit = F.when(cond, F.lit(BYTE_UNITS[i])).otherwise(unit)
    return scaled, unit


def format_bytes(b) -> Column:
    """``0 B``; else scale by 1024 through B..TB and print two decimals, ties to even.

    Scaled values are dyadic, so ``bround`` on them rounds exactly like C/Python
    ``%.2f``; the decimal cast prints the two digits (Java's ``%.2f`` would round half up).
    """
    b = _c(b)
    scaled, unit = _unit_parts(b)
    num = F.bround(scaled, 2).cast("decimal(38,2)").cast("string")
    return F.when(b == 0, F.lit("0 B")).otherwise(F.concat(num, F.lit(" "), unit))


# SCL-12 ----------------------------------------------------------------------------------
def format_bytes_short(b) -> Column:
    """History-report variant: null/0 -> ``-``; two decimals rounded half up, trailing zeros cut."""
    b = _c(b)
    scaled, unit = _unit_parts(b)
    # scaled < 1024, so the shortest double text never uses an exponent
    num = F.regexp_replace(F.round(scaled, 2).cast("string"), r"\.0$", "")
    return F.when(b.isNull() | (b == 0), F.lit("-")).otherwise(F.concat(num, F.lit(" "), unit))


# SCL-14 ----------------------------------------------------------------------------------
def format_duration(seconds) -> Column:
    """``Ns`` / ``Nm Ns`` / ``Nh Nm``; null or 0 -> ``-``."""
    s = _c(seconds).cast("long")
    m = F.floor(s / 60)
    h = F.floor(m / 60)
    return (
        F.when(s.isNull() | (s == 0), F.lit("-"))
        .when(s < 60, F.format_string("%ds", s))
        .when(m < 60, F.format_string("%dm %ds", m, s % 60))
        .otherwise(F.format_string("%dh %dm", h, m % 60))
    )


# SCL-15 ----------------------------------------------------------------------------------
def map_state(state) -> Column:
    m = F.create_map(*[F.lit(x) for kv in STATE_MAP.items() for x in kv])
    return F.coalesce(F.try_element_at(m, _c(state)), F.lit("running"))


# SCL-16 ----------------------------------------------------------------------------------
def process_label(process_type) -> Column:
    m = F.create_map(*[F.lit(x) for kv in PROCESS_LABELS.items() for x in kv])
    return F.coalesce(F.try_element_at(m, _c(process_type)), _c(process_type))


# SCL-17 ----------------------------------------------------------------------------------
def iso_utc(ts) -> Column:
    """ISO-8601 text with ``Z``; microseconds only when non-zero (Python ``isoformat``).

    An instant is shown in UTC whatever the session's zone; a timestamp without zone is
    taken to be UTC as it stands.
    """
    ts = _c(ts)
    instant = F.typeof(ts) == "timestamp"
    ts = F.when(instant, F.to_utc_timestamp(ts.cast("timestamp"), F.current_timezone())).otherwise(ts.cast("timestamp"))
    whole = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")
    frac = F.date_format(ts, "SSSSSS")
    return F.when(ts.isNull(), F.lit(None)).otherwise(
        F.when(frac == "000000", F.concat(whole, F.lit("Z"))).otherwise(
            F.concat(whole, F.lit("."), frac, F.lit("Z"))
        )
    )
