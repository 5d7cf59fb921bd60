"""Registered queries: one per operator family of the inventory, each over the given tables.

``QUERIES[name] = (spark_fn(spark, sf_dir) -> DataFrame, oracle_sql or None)``.
Every Spark result aliases its columns to the oracle's names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import files
from ..functions import columns as C
from ..operators import catalog, ndjson, runs, select, transport
from ..session import materialize, run_dir
from ..sources import bz2_reader, registry
from ..sources.objects import list_objects
from .job import JobConfig, read_manifest, run_transport
from .views import event_line, oracle_with, table, v_dated, v_objects, v_runs, v_selection

QUERIES: dict[str, tuple] = {}


def _patterns(spark: SparkSession, sf: str, spec=None) -> DataFrame:
    """The selection's patterns, derived from the tables once and written as a small table,
    so the plans below scan it instead of re-deriving it from ``documents`` per use."""
    sel = v_selection(spark, sf)
    pats = spec.build_patterns(sel) if spec is not None else select.build_patterns(sel)
    return materialize(pats, "patterns")


def query(name: str, sql: str | None):
    def deco(fn):
        QUERIES[name] = (fn, sql)
        return fn

    return deco


# ---------------------------------------------------------------------------------------------
# catalogue / select over table-derived listings
# ---------------------------------------------------------------------------------------------
@query(
    "list_objects",
    oracle_with("v_objects")
    + """SELECT bucket, "key", size_bytes FROM v_objects
         WHERE ends_with("key", '.bz2') AND NOT ends_with("key", '/')""",
)
def q_list_objects(spark, sf):
    o = v_objects(spark, sf)
    return o.where(C.has_suffix("key", ".bz2") & ~C.is_folder_placeholder("key")).select("bucket", "key", "size_bytes")


@query("build_patterns", oracle_with("v_patterns") + "SELECT bucket, path, CAST(glob_no AS INTEGER) AS glob_no, pattern FROM v_patterns")
def q_build_patterns(spark, sf):
    return select.build_patterns(v_selection(spark, sf))


@query(
    "parse_uri",
    oracle_with("v_patterns")
    + """SELECT pattern, starts_with(pattern, 'gs://') AS scheme_ok,
                starts_with(pattern, 'gs://') AND position('//' IN substr(pattern, 6)) = 0 AS well_formed,
                regexp_extract(pattern, '^[a-z0-9]+://([^/]*)', 1) AS p_bucket,
                regexp_replace(split_part(regexp_extract(pattern, '^[a-z0-9]+://[^/]*/?(.*)$', 1), '*', 1), '/+$', '') AS prefix,
                CASE WHEN ends_with(pattern, '*.bz2') THEN '.bz2' WHEN ends_with(pattern, '*.json') THEN '.json'
                     WHEN ends_with(pattern, '*.gz') THEN '.gz' ELSE '.bz2' END AS ext
         FROM v_patterns""",
)
def q_parse_uri(spark, sf):
    pp = select.parse_patterns(select.build_patterns(v_selection(spark, sf)))
    return pp.select("pattern", "scheme_ok", "well_formed", "p_bucket", "prefix", "ext")


_SELECT_PATH_SQL = (
    oracle_with("v_objects", "v_prefixes")
    + """SELECT DISTINCT o.bucket, o."key", o.size_bytes FROM v_objects o JOIN v_prefixes p
           ON o.bucket = p.bucket AND (p.prefix = '' OR o."key" = p.prefix OR starts_with(o."key", p.prefix || '/'))
         WHERE ends_with(o."key", '.bz2')"""
)


@query("select_distinct_paths", _SELECT_PATH_SQL)
def q_select_distinct_paths(spark, sf):
    pats = _patterns(spark, sf)
    return select.select_objects(v_objects(spark, sf), pats, boundary="path").select("bucket", "key", "size_bytes")


@query(
    "select_prefix_mode",
    oracle_with("v_objects", "v_prefixes")
    + """SELECT DISTINCT o.bucket, o."key", o.size_bytes FROM v_objects o JOIN v_prefixes p
           ON o.bucket = p.bucket AND starts_with(o."key", p.prefix)
         WHERE ends_with(o."key", '.bz2')""",
)
def q_select_prefix_mode(spark, sf):
    pats = _patterns(spark, sf)
    return select.select_objects(v_objects(spark, sf), pats, boundary="prefix").select("bucket", "key", "size_bytes")


_VALIDATE_CTE = (
    oracle_with("v_objects", "v_patterns")
    + """, pp AS (
           SELECT pattern, count(*) AS entries,
                  regexp_extract(pattern, '^[a-z0-9]+://([^/]*)', 1) AS b,
                  regexp_replace(split_part(regexp_extract(pattern, '^[a-z0-9]+://[^/]*/?(.*)$', 1), '*', 1), '/+$', '') AS prefix,
                  CASE WHEN ends_with(pattern, '*.json') THEN '.json' WHEN ends_with(pattern, '*.gz') THEN '.gz' ELSE '.bz2' END AS ext
           FROM v_patterns GROUP BY pattern),
         per AS (
           SELECT pp.pattern, CAST(pp.entries AS BIGINT) AS entries, CAST(count(o."key") AS BIGINT) AS file_count
           FROM pp LEFT JOIN v_objects o
             ON o.bucket = pp.b AND starts_with(o."key", pp.prefix) AND ends_with(o."key", pp.ext)
           GROUP BY pp.pattern, pp.entries)
"""
)


@query(
    "validate_patterns",
    _VALIDATE_CTE
    + """SELECT pattern, entries, file_count, file_count > 0 AS valid, false AS truncated,
                CAST(NULL AS VARCHAR) AS error FROM per
         UNION ALL
         SELECT 's3' || substr(pattern, 3), entries, CAST(0 AS BIGINT), false, false, 'Pattern must start with gs://'
         FROM per WHERE length(pattern) % 5 = 0""",
)
def q_validate_patterns(spark, sf):
    pats = _patterns(spark, sf)
    other = pats.where(F.length("pattern") % 5 == 0).withColumn("pattern", F.concat(F.lit("s3"), F.substring("pattern", 3, 1 << 20)))
    return select.validate_patterns(v_objects(spark, sf), pats.unionByName(other))


@query(
    "validate_summary",
    _VALIDATE_CTE
    + """, s AS (SELECT CAST(sum(file_count * entries) AS BIGINT) AS total_files,
                       CAST(sum(entries) AS BIGINT) AS n_patterns, bool_and(file_count > 0) AS all_valid FROM per),
         d AS (SELECT CAST(count(*) AS BIGINT) AS distinct_files FROM (
                 SELECT DISTINCT o.bucket, o."key" FROM v_objects o JOIN pp
                   ON o.bucket = pp.b AND starts_with(o."key", pp.prefix) AND ends_with(o."key", '.bz2')))
         SELECT total_files, n_patterns, all_valid, distinct_files, all_valid AND total_files > 0 AS submit_ok
         FROM s, d""",
)
def q_validate_summary(spark, sf):
    objs = v_objects(spark, sf)
    pats = _patterns(spark, sf)
    per = select.validate_patterns(objs, pats)
    files = select.select_objects(objs, pats, boundary="prefix")
    return select.validation_summary(per, files)


@query(
    "dates_rollup",
    oracle_with("v_dated")
    + """, d AS (SELECT bucket, split_part("key", '/', 1) AS dataset,
                       regexp_extract("key", '([0-9]{4}-[0-9]{2}-[0-9]{2})', 1) AS date, size_bytes
                FROM v_dated WHERE ends_with("key", '.bz2'))
         SELECT bucket, dataset, date, CAST(count(*) AS BIGINT) AS files, CAST(sum(size_bytes) AS BIGINT) AS size_bytes,
                printf('%.2f %s', CAST(sum(size_bytes) AS DOUBLE) / pow(1024, CASE WHEN sum(size_bytes) >= 1099511627776 THEN 4
                      WHEN sum(size_bytes) >= 1073741824 THEN 3 WHEN sum(size_bytes) >= 1048576 THEN 2
                      WHEN sum(size_bytes) >= 1024 THEN 1 ELSE 0 END),
                      CASE WHEN sum(size_bytes) >= 1099511627776 THEN 'TB' WHEN sum(size_bytes) >= 1073741824 THEN 'GB'
                      WHEN sum(size_bytes) >= 1048576 THEN 'MB' WHEN sum(size_bytes) >= 1024 THEN 'KB' ELSE 'B' END) AS size
         FROM d WHERE date <> '' GROUP BY bucket, dataset, date""",
)
def q_dates_rollup(spark, sf):
    return catalog.dates_rollup(v_dated(spark, sf))


@query(
    "dataset_stats",
    oracle_with("v_dated")
    + """SELECT bucket, split_part("key", '/', 1) AS dataset, CAST(count(*) AS BIGINT) AS files,
                CAST(sum(size_bytes) AS BIGINT) AS size_bytes,
                coalesce(min(nullif(regexp_extract("key", '([0-9]{4}-[0-9]{2}-[0-9]{2})', 1), '')), '') AS date_start,
                coalesce(max(nullif(regexp_extract("key", '([0-9]{4}-[0-9]{2}-[0-9]{2})', 1), '')), '') AS date_end
         FROM v_dated WHERE ends_with("key", '.bz2') GROUP BY 1, 2""",
)
def q_dataset_stats(spark, sf):
    return catalog.dataset_stats(v_dated(spark, sf))


def _fmt_bytes_sql(x: str) -> str:
    """DuckDB form of SCL-11 (``printf`` rounds ties to even on the exact value)."""
    idx = (
        f"CASE WHEN {x} >= 1099511627776 THEN 4 WHEN {x} >= 1073741824 THEN 3 "
        f"WHEN {x} >= 1048576 THEN 2 WHEN {x} >= 1024 THEN 1 ELSE 0 END"
    )
    unit = f"['B','KB','MB','GB','TB'][({idx}) + 1]"
    return f"CASE WHEN {x} = 0 THEN '0 B' ELSE printf('%.2f %s', CAST({x} AS DOUBLE) / pow(1024, {idx}), {unit}) END"


def _fmt_bytes_short_sql(x: str) -> str:
    idx = (
        f"CASE WHEN {x} >= 1099511627776 THEN 4 WHEN {x} >= 1073741824 THEN 3 "
        f"WHEN {x} >= 1048576 THEN 2 WHEN {x} >= 1024 THEN 1 ELSE 0 END"
    )
    unit = f"['B','KB','MB','GB','TB'][({idx}) + 1]"
    num = f"regexp_replace(printf('%.2f', round(CAST({x} AS DOUBLE) / pow(1024, {idx}), 2)), '\\.?0+$', '')"
    return f"CASE WHEN {x} IS NULL OR {x} = 0 THEN '-' ELSE {num} || ' ' || {unit} END"


_BROWSE_SQL = (
    oracle_with("v_objects")
    + """, segs AS (
           SELECT bucket, "key", size_bytes, string_split("key", '/') AS s, len(string_split("key", '/')) AS n FROM v_objects),
         lv AS (
           SELECT bucket, "key", size_bytes, s, n, j FROM segs, range(1, n) AS r(j)),
         folders AS (
           SELECT bucket, CASE WHEN j = 1 THEN '' ELSE array_to_string(s[1:j-1], '/') || '/' END AS parent,
                  s[j] AS name, array_to_string(s[1:j], '/') AS path,
                  CAST(count(*) FILTER (WHERE j = n - 1 AND NOT ends_with("key", '/')) AS BIGINT) AS file_count,
                  CAST(coalesce(sum(size_bytes) FILTER (WHERE j = n - 1 AND NOT ends_with("key", '/')), 0) AS BIGINT) AS size_bytes,
                  bool_or(j < n - 1) AS has_children
           FROM lv GROUP BY 1, 2, 3, 4)
"""
)


@query(
    "browse_level",
    _BROWSE_SQL
    + f"""SELECT bucket, parent, 'folder' AS kind, name, path, file_count, size_bytes, has_children,
                 {_fmt_bytes_sql('size_bytes')} AS size FROM folders
          UNION ALL
          SELECT bucket, CASE WHEN n = 1 THEN '' ELSE array_to_string(s[1:n-1], '/') || '/' END, 'file', s[n], "key",
                 CAST(NULL AS BIGINT), size_bytes,
                 CAST(NULL AS BOOLEAN), {_fmt_bytes_sql('size_bytes')} FROM segs WHERE NOT ends_with("key", '/')""",
)
def q_browse_level(spark, sf):
    return catalog.browse_all(v_objects(spark, sf))


@query(
    "browse_totals",
    _BROWSE_SQL
    + """, files AS (SELECT bucket, CASE WHEN n = 1 THEN '' ELSE array_to_string(s[1:n-1], '/') || '/' END AS parent
                    FROM segs WHERE NOT ends_with("key", '/'))
          SELECT bucket, parent, CAST(sum(fo) AS BIGINT) AS total_folders, CAST(sum(fi) AS BIGINT) AS total_files FROM (
            SELECT bucket, parent, 1 AS fo, 0 AS fi FROM folders
            UNION ALL SELECT bucket, parent, 0, 1 FROM files) GROUP BY bucket, parent""",
)
def q_browse_totals(spark, sf):
    return catalog.browse_totals(catalog.browse_all(v_objects(spark, sf)))


@query(
    "list_datasets",
    _BROWSE_SQL
    + f"""SELECT bucket, path AS dataset, file_count, size_bytes, {_fmt_bytes_sql('size_bytes')} AS size, has_children
          FROM folders WHERE parent = ''""",
)
def q_list_datasets(spark, sf):
    return catalog.list_datasets(v_objects(spark, sf))


@query(
    "bucket_sizes",
    oracle_with("v_objects")
    + f"""SELECT bucket, objects, size_bytes, {_fmt_bytes_sql('size_bytes')} AS size FROM (
            SELECT bucket, CAST(count(*) AS BIGINT) AS objects, CAST(sum(size_bytes) AS BIGINT) AS size_bytes
            FROM v_objects GROUP BY bucket)""",
)
def q_bucket_sizes(spark, sf):
    return catalog.bucket_sizes(v_objects(spark, sf))


@query(
    "format_bytes",
    f"""WITH b AS (SELECT l_orderkey, l_linenumber,
                          (l_linenumber - 1) * l_orderkey * l_partkey * l_suppkey AS b FROM lineitem)
        SELECT l_orderkey, l_linenumber, b, {_fmt_bytes_sql('b')} AS size, {_fmt_bytes_short_sql('b')} AS size_short FROM b""",
)
def q_format_bytes(spark, sf):
    li = table(spark, sf, "lineitem")
    b = (F.col("l_linenumber") - 1).cast("long") * F.col("l_orderkey") * F.col("l_partkey") * F.col("l_suppkey")
    return li.select("l_orderkey", "l_linenumber", b.alias("b")).select(
        "l_orderkey", "l_linenumber", "b", C.format_bytes("b").alias("size"), C.format_bytes_short("b").alias("size_short")
    )


@query(
    "normalize_lines",
    """SELECT doc_id, CAST(line_no AS INTEGER) AS line_no, value FROM (
         SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_no,
                unnest(string_split(text, chr(10))) AS value FROM documents)
       WHERE NOT regexp_matches(value, '^\\s*$')""",
)
def q_normalize_lines(spark, sf):
    return transport.normalize_lines(table(spark, sf, "documents"), "text", keep=["doc_id"])


@query(
    "multi_extension_select",
    oracle_with("v_objects", "v_prefixes")
    + """SELECT DISTINCT o.bucket, o."key", o.size_bytes FROM v_objects o JOIN v_prefixes p
           ON o.bucket = p.bucket AND (p.prefix = '' OR o."key" = p.prefix OR starts_with(o."key", p.prefix || '/'))
         WHERE ends_with(o."key", '.bz2') OR ends_with(o."key", '.json')""",
)
def q_multi_extension_select(spark, sf):
    spec = registry.SourceSpec(
        id="bz2_and_json", name="bz2 and JSON", extensions=[".bz2", ".json"], compression="mixed",
        content_type="ndjson", enabled=True, description="several extensions per selected path",
    )
    pats = _patterns(spark, sf, spec)
    return select.select_objects(v_objects(spark, sf), pats, exts=tuple(spec.extensions)).select("bucket", "key", "size_bytes")


# ---------------------------------------------------------------------------------------------
# transport: real files written from the tables, then listed, selected, read and written
# ---------------------------------------------------------------------------------------------
_FIXTURES: dict[tuple, str] = {}
SALT = 4  # files per fixture folder


def _fixture(spark: SparkSession, sf: str, name: str, write) -> str:
    """Input files derived from a table, written once per application and reused."""
    key = (spark.sparkContext.applicationId, sf, name)
    if key not in _FIXTURES:
        root = run_dir(spark, name)
        write(root)
        _FIXTURES[key] = root
    return _FIXTURES[key]


def _write_bz2(spark: SparkSession, rows: DataFrame, folders: list[str], order: str, root: str) -> None:
    """``value`` as one bz2 text file per folder, lines in ``order``."""
    spread = rows.repartition(4 * spark.sparkContext.defaultParallelism, *folders).sortWithinPartitions(*folders, order)
    spread.select("value", *folders).write.partitionBy(*folders).option("compression", "bzip2").option("lineSep", "\n").text(root)


def _events_bz2(spark: SparkSession, sf: str) -> tuple[str, DataFrame]:
    """``events`` as bz2 NDJSON files, one per ``event_type=<t>/date=<d>/part=<s>`` folder."""
    e = table(spark, sf, "events")
    # salted: a folder holding a third of all events is still written by several tasks
    rows = e.select(event_line(e).alias("value"), "event_type", F.date_format("ts", "yyyy-MM-dd").alias("date"),
                    (F.col("event_id") % SALT).alias("part"), "event_id")
    return _fixture(spark, sf, "events-bz2", lambda root: _write_bz2(spark, rows, ["event_type", "date", "part"], "event_id", root)), e


def _event_selection(e: DataFrame) -> DataFrame:
    return e.select(F.lit("events").alias("bucket"), F.concat(F.lit("event_type="), "event_type").alias("path")).distinct()


def _run_events_job(spark, sf, process_type="decompress_and_concatenate") -> dict:
    root, e = _events_bz2(spark, sf)
    cfg = JobConfig(
        source_root=root, source_bucket="events", selection=_event_selection(e),
        output=run_dir(spark, "out"), process_type=process_type, output_shards=10,
    )
    return run_transport(spark, cfg)


@query(
    "list_files",
    """SELECT event_type, strftime(ts, '%Y-%m-%d') AS day, CAST(count(DISTINCT event_id % 4) AS BIGINT) AS files, true AS sized
       FROM events GROUP BY ALL""",
)
def q_list_files(spark, sf):
    """SRC-1 over real files: the listing of the written events, counted by folder."""
    root, _ = _events_bz2(spark, sf)
    o = list_objects(spark, root, bucket="events").where(F.col("key").endswith(".bz2"))
    folder = r"^event_type=([^/]*)/date=([^/]*)/part=[^/]*/[^/]*$"
    return o.groupBy(F.regexp_extract("key", folder, 1).alias("event_type"), F.regexp_extract("key", folder, 2).alias("day")).agg(
        F.count(F.lit(1)).alias("files"), (F.min("size_bytes") > 0).alias("sized")
    )


@query(
    "ingest_bz2_roundtrip",
    """SELECT event_type, CAST(count(*) AS BIGINT) AS lines,
              CAST(sum(length('{"event_id":' || event_id || ',"user_id":' || user_id || ',"event_type":"' || event_type ||
                   '","day":"' || strftime(ts, '%Y-%m-%d') || '","props":' || props || '}')) AS BIGINT) AS chars,
              min(event_id) AS min_event_id, max(event_id) AS max_event_id
       FROM events GROUP BY event_type""",
)
def q_ingest_bz2_roundtrip(spark, sf):
    res = _run_events_job(spark, sf)
    back = transport.read_shards(spark, res["output"])
    return back.groupBy(F.get_json_object("value", "$.event_type").alias("event_type")).agg(
        F.count(F.lit(1)).alias("lines"),
        F.sum(F.length("value")).cast("long").alias("chars"),
        F.min(F.get_json_object("value", "$.event_id").cast("long")).alias("min_event_id"),
        F.max(F.get_json_object("value", "$.event_id").cast("long")).alias("max_event_id"),
    )


@query(
    "ingest_counters",
    """SELECT CAST(count(DISTINCT event_type || '/' || strftime(ts, '%Y-%m-%d') || '/' || CAST(event_id % 4 AS VARCHAR))
                   AS BIGINT) AS files_processed,
              CAST(0 AS BIGINT) AS files_failed, CAST(count(*) AS BIGINT) AS lines_yielded, true AS bytes_as_listed FROM events""",
)
def q_ingest_counters(spark, sf):
    """AGG-10 from the per-file manifest the job wrote beside its shards, its bytes against the
    listing's (which the run recorded as ``bytes_total``)."""
    res = _run_events_job(spark, sf)
    run = runs.read_events(spark, res["runs_table"]).where((F.col("job_id") == res["job_id"]) & (F.col("kind") == "create"))
    listed = run.select(F.col("config")["bytes_total"].cast("bigint")).first()[0]
    c = bz2_reader.counters_of(read_manifest(spark, res["manifest"].removesuffix("/_manifest")))
    return c.select("files_processed", "files_failed", "lines_yielded", (F.col("bytes_read") == F.lit(listed)).alias("bytes_as_listed"))


def _failing_bz2(batches):
    """Files whose group number says what is wrong with them: (key, bytes) per input row."""
    import bz2

    import pyarrow as pa

    for b in batches:
        keys, data = [], []
        for n, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            raw = text.encode()
            half = len(raw) // 2
            packed = {
                0: bz2.compress(raw),
                1: bz2.compress(raw)[:-7],  # cut short
                2: b"not bz2 " + raw,
                3: bz2.compress(raw + b"\n\xff\xfe\n"),  # not UTF-8
                4: bz2.compress(raw[:half]) + bz2.compress(raw[half:]),  # two streams, one line across both
                5: bz2.compress(raw) + b"garbage",
                6: bz2.compress(b"\n  " + raw.replace(b"\n", b"\r\n \n") + b" \n\n"),
                7: b"",
            }[n % 8]
            keys.append(f"g{n % 3}/d{n % 5}//f{n}.bz2" if n % 2 else f"g{n % 3}/f{n}.bz2")
            data.append(packed)
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(data, pa.binary())], names=["key", "data"])


def _write_objects(batches, root: str):
    import pyarrow as pa
    import pyarrow.fs as pafs

    fs, base = pafs.FileSystem.from_uri(root)
    for b in batches:
        for key, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            name = f"{base}/{key}"
            fs.create_dir(name.rsplit("/", 1)[0], recursive=True)
            with fs.open_output_stream(name, compression=None) as f:
                f.write(data)
        yield pa.RecordBatch.from_arrays([b.column(0)], names=["key"])


@query(
    "ingest_failures",
    """WITH g AS (SELECT event_id // 20 AS n, count(*) AS lines FROM events GROUP BY 1)
       SELECT CAST(n % 8 AS BIGINT) AS kind, CAST(count(*) AS BIGINT) AS files,
              CAST(count(*) FILTER (WHERE n % 8 IN (1, 2, 3)) AS BIGINT) AS files_failed,
              CAST(sum(CASE WHEN n % 8 IN (0, 4, 5, 6) THEN lines ELSE 0 END) AS BIGINT) AS lines,
              CAST(sum(CASE WHEN n % 8 IN (0, 4, 5, 6) THEN lines ELSE 0 END) AS BIGINT) AS manifest_lines,
              true AS bytes_as_listed,
              CAST(sum(CASE n % 8 WHEN 6 THEN lines - 1 ELSE 0 END) AS BIGINT) AS carriage_returns
       FROM g GROUP BY n % 8""",
)
def q_ingest_failures(spark, sf):
    """SRC-2 and AGG-10 with failing files: whole, cut short, no bz2, bad UTF-8, two streams,
    trailing garbage, outer and blank lines, zero bytes -- mixed key depths, empty segments."""
    e = table(spark, sf, "events")
    group = F.floor(F.col("event_id") / 20)
    texts = e.groupBy(group.alias("n")).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("event_id", event_line(e).alias("v")))), lambda x: x["v"]), "\n").alias("text"))

    def write(root):
        uri = files.arrow_uri(files.qualified(spark, root))
        made = texts.select("n", "text").mapInArrow(_failing_bz2, "key string, data binary")
        made.mapInArrow(lambda it: _write_objects(it, uri), "key string").write.format("noop").mode("overwrite").save()

    root = _fixture(spark, sf, "failing-bz2", write)
    listing = materialize(list_objects(spark, root, bucket="b"), "listing")
    raw = bz2_reader.read_files(listing)
    kind = (F.regexp_extract("path", r"/f(\d+)\.bz2$", 1).cast("long") % 8).alias("kind")
    lines = bz2_reader.lines_of(raw).groupBy(kind).agg(
        F.count(F.lit(1)).alias("lines"), F.count_if(F.col("value").endswith("\r")).alias("carriage_returns")
    )
    per_file = bz2_reader.manifest_of(raw).join(listing.select("path", "size_bytes"), "path")
    per_kind = per_file.groupBy(kind).agg(
        F.count(F.lit(1)).alias("files"), F.count_if(F.col("error").isNotNull()).alias("files_failed"),
        F.sum("lines").cast("long").alias("manifest_lines"), F.bool_and(F.col("bytes") == F.col("size_bytes")).alias("bytes_as_listed"),
    )
    zero = F.lit(0).cast("long")
    return per_kind.join(lines, "kind", "left").select(
        "kind", "files", "files_failed", F.coalesce("lines", zero).alias("lines"), "manifest_lines", "bytes_as_listed",
        F.coalesce("carriage_returns", zero).alias("carriage_returns"),
    )


def _conversation_roundtrip(spark, sf, compression):
    c = table(spark, sf, "conversations")
    lines = c.select(F.to_json(F.struct("conv_id", "turn", "role", "text")).alias("value"))
    out = run_dir(spark, f"conv-{compression}") + "/out"
    transport.write_shards(lines, out, num_shards=10, compression=compression)
    back = transport.read_shards(spark, out)
    j = F.from_json("value", "conv_id bigint, turn bigint, role string, text string")
    return back.select(j.alias("j")).groupBy(F.col("j.role").alias("role")).agg(
        F.count(F.lit(1)).alias("lines"),
        F.count_distinct("j.conv_id").alias("convs"),
        F.sum("j.turn").cast("long").alias("turns"),
        F.sum(F.length("j.text")).cast("long").alias("chars"),
    )


_CONV_SQL = """SELECT role, CAST(count(*) AS BIGINT) AS lines, CAST(count(DISTINCT conv_id) AS BIGINT) AS convs,
                      CAST(sum(turn) AS BIGINT) AS turns, CAST(sum(length(text)) AS BIGINT) AS chars
               FROM conversations GROUP BY role"""


@query("write_gzip_roundtrip", _CONV_SQL)
def q_write_gzip_roundtrip(spark, sf):
    return _conversation_roundtrip(spark, sf, "gzip")


@query("write_snappy_roundtrip", _CONV_SQL)
def q_write_snappy_roundtrip(spark, sf):
    return _conversation_roundtrip(spark, sf, "snappy")


def _docs_bz2(spark: SparkSession, sf: str) -> tuple[str, DataFrame]:
    """``documents`` as bz2 text files, one per ``source=<s>/lang=<l>/part=<p>`` folder."""
    d = table(spark, sf, "documents")
    rows = d.select(F.col("text").alias("value"), "source", "lang", (F.col("doc_id") % SALT).alias("part"), "doc_id")
    return _fixture(spark, sf, "docs-bz2", lambda root: _write_bz2(spark, rows, ["source", "lang", "part"], "doc_id", root)), d


def build_fixtures(spark: SparkSession, sf: str) -> None:
    """Write (once per application) the bz2 inputs the transport queries read."""
    _events_bz2(spark, sf)
    _docs_bz2(spark, sf)


@query(
    "decompress_only_layout",
    r"""SELECT source, lang, CAST(part AS BIGINT) AS part, md5(string_agg(l, chr(10) ORDER BY doc_id, i) || chr(10)) AS content FROM (
         SELECT source, lang, doc_id, doc_id % 4 AS part, unnest(string_split(text, chr(10))) AS l,
                generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents)
       WHERE NOT regexp_matches(l, '^\s*$') GROUP BY source, lang, part""",
)
def q_decompress_only_layout(spark, sf):
    """SNK-3: one output per input, folders kept, lines in order: each output's whole content."""
    root, d = _docs_bz2(spark, sf)
    sel = d.select(F.lit("docs").alias("bucket"), F.concat(F.lit("source="), "source").alias("path")).distinct()
    cfg = JobConfig(source_root=root, source_bucket="docs", selection=sel, output=run_dir(spark, "per-input"),
                    process_type="decompress_only")
    res = run_transport(spark, cfg)
    back = transport.read_inputs(spark, res["output"])
    folder = r"^source=([^/]*)/lang=([^/]*)/part=([^/]*)/"
    return back.select(
        F.regexp_extract("rel_path", folder, 1).alias("source"), F.regexp_extract("rel_path", folder, 2).alias("lang"),
        F.regexp_extract("rel_path", folder, 3).cast("long").alias("part"), F.md5("value").alias("content"),
    )


def _ndjson_values(e: DataFrame) -> F.Column:
    k = F.col("event_id") % 10
    p = F.col("props")
    return (
        F.when(k == 3, F.concat(p, F.lit(" x")))
        .when(k == 5, F.concat(F.lit("  "), p, F.lit("\r")))
        .when(k == 7, F.concat(p, F.lit(","), p))
        .when(k == 9, F.lit("{bad"))
        .when(k == 1, F.concat(p, F.lit("]")))
        .otherwise(p)
    )


@query(
    "ndjson_validate",
    """SELECT value, json_valid(value) AS valid FROM (
         SELECT CASE event_id % 10 WHEN 3 THEN props || ' x' WHEN 5 THEN '  ' || props || chr(13)
                     WHEN 7 THEN props || ',' || props WHEN 9 THEN '{bad' WHEN 1 THEN props || ']'
                     ELSE props END AS value FROM events)""",
)
def q_ndjson_validate(spark, sf):
    e = table(spark, sf, "events")
    out = run_dir(spark, "ndjson")
    # SNK-5: valid and rejected lines go to separate folders by one pass; read both back.
    # (lines with "\r" keep it: lineSep is "\n" on both sides)
    ndjson.write_split(e.select(_ndjson_values(e).alias("value")), out)
    return ndjson.read_split(spark, out)


@query(
    "table_sink_by_date",
    """SELECT strftime(ts, '%Y-%m-%d') AS date, CAST(count(*) AS BIGINT) AS events,
              CAST(count(DISTINCT user_id) AS BIGINT) AS users, CAST(sum(event_id) AS BIGINT) AS id_sum
       FROM events GROUP BY 1""",
)
def q_table_sink_by_date(spark, sf):
    e = table(spark, sf, "events")
    lines = e.select(event_line(e).alias("value"))
    typed = ndjson.parse_lines(lines, "event_id bigint, user_id bigint, event_type string, day string").select(
        "event_id", "user_id", "event_type", F.col("day").alias("date")
    )
    out = run_dir(spark, "table") + "/events"
    transport.write_table(typed, out, partition_by=["date"])
    back = spark.read.schema("event_id bigint, user_id bigint, event_type string, date string").parquet(out)
    return back.groupBy("date").agg(
        F.count(F.lit(1)).alias("events"),
        F.count_distinct("user_id").alias("users"),
        F.sum("event_id").cast("long").alias("id_sum"),
    )


@query("json_array_explode", "SELECT event_id, user_id, event_type FROM events")
def q_json_array_explode(spark, sf):
    e = table(spark, sf, "events")
    item = F.to_json(F.struct("event_id", "user_id", "event_type"))
    chunk = F.floor(F.col("event_id") / 1000)  # at most 1,000 events per document
    docs = (
        e.select(chunk.alias("chunk"), F.struct("event_id", item.alias("j")).alias("it"))
        .groupBy("chunk")
        .agg(F.sort_array(F.collect_list("it")).alias("items"))
        .select(
            "chunk",
            F.concat(F.lit("[\n  "), F.array_join(F.transform("items", lambda x: x["j"]), ",\n  "), F.lit("\n]")).alias("value"),
        )
    )
    root = run_dir(spark, "json-array")
    docs.repartition("chunk").write.partitionBy("chunk").option("lineSep", "\n").text(root)
    whole = spark.read.option("recursiveFileLookup", "true").text(root, wholetext=True)
    items = ndjson.explode_json_array(whole)
    v = F.try_parse_json("value")
    return items.where(F.col("value").isNotNull()).select(
        F.variant_get(v, "$.event_id", "bigint").alias("event_id"),
        F.variant_get(v, "$.user_id", "bigint").alias("user_id"),
        F.variant_get(v, "$.event_type", "string").alias("event_type"),
    )


@query("json_gz_documents", "SELECT event_id, user_id, event_type FROM events")
def q_json_gz_documents(spark, sf):
    """SRC-5, SRC-6, SRC-8: a JSON source as a job: gzip documents (one array per file) listed,
    selected by the source's extensions, read whole on executors, exploded (SRC-7)."""
    e = table(spark, sf, "events")
    item = F.to_json(F.struct("event_id", "user_id", "event_type"))
    chunk = F.floor(F.col("event_id") / 1000)  # at most 1,000 events per document

    def write(root):
        (
            e.select(chunk.alias("chunk"), F.struct("event_id", item.alias("j")).alias("it"))
            .groupBy("chunk")
            .agg(F.sort_array(F.collect_list("it")).alias("items"))
            .select("chunk", F.concat(F.lit("["), F.array_join(F.transform("items", lambda x: x["j"]), ","),
                                      F.lit("]")).alias("value"))
            .repartition("chunk")
            .write.partitionBy("chunk")
            .option("compression", "gzip")
            .text(root)
        )

    root = _fixture(spark, sf, "json-gz", write)
    registry.register_source(registry.SourceSpec(
        id="json_gz", name="gzip JSON documents", extensions=[".txt.gz"], compression="gzip",
        content_type="json", reader=registry.get_source("racing_api").reader,
    ))
    cfg = JobConfig(source_root=root, source_bucket="docs", selected_paths=[""], source_type="json_gz", output=run_dir(spark, "json-out"))
    items = transport.read_shards(spark, run_transport(spark, cfg)["output"])
    v = F.try_parse_json("value")
    return items.select(
        F.variant_get(v, "$.event_id", "bigint").alias("event_id"),
        F.variant_get(v, "$.user_id", "bigint").alias("user_id"),
        F.variant_get(v, "$.event_type", "string").alias("event_type"),
    )


# ---------------------------------------------------------------------------------------------
# run history
# ---------------------------------------------------------------------------------------------
_RUNS_CTE = oracle_with("v_runs") + """, m AS (
       SELECT *, CASE state WHEN 'JOB_STATE_RUNNING' THEN 'running' WHEN 'JOB_STATE_DONE' THEN 'completed'
                 WHEN 'JOB_STATE_FAILED' THEN 'failed' WHEN 'JOB_STATE_CANCELLED' THEN 'cancelled'
                 WHEN 'JOB_STATE_PENDING' THEN 'submitted' WHEN 'JOB_STATE_QUEUED' THEN 'submitted'
                 ELSE 'running' END AS mapped,
              CASE WHEN kind = 'cancel' THEN 'cancelled' WHEN kind IN ('create', 'update') THEN status END AS sets
       FROM v_runs),
     l AS (SELECT *, coalesce(max(CASE WHEN sets IS NOT NULL THEN rn END) OVER (PARTITION BY job_id), 0) AS at_set FROM (
             SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY ts, seq) AS rn FROM m)),
     c AS (SELECT *, coalesce(min(CASE WHEN kind = 'refresh' AND state IS NOT NULL AND rn > at_set
                                        AND mapped IN ('completed', 'failed', 'cancelled') THEN rn END) OVER (PARTITION BY job_id),
                              max(CASE WHEN kind = 'refresh' AND state IS NOT NULL AND rn > at_set THEN rn END) OVER (PARTITION BY job_id)) AS at_poll
           FROM l),
     f AS (
       SELECT job_id,
              CASE WHEN coalesce(max(CASE WHEN rn = at_set THEN sets END), 'submitted') IN ('submitted', 'running')
                   THEN coalesce(max(CASE WHEN rn = at_poll THEN mapped END), max(CASE WHEN rn = at_set THEN sets END), 'submitted')
                   ELSE max(CASE WHEN rn = at_set THEN sets END) END AS status,
              min(ts) AS created_at, max(ts) AS updated_at, CAST(count(*) AS BIGINT) AS n_events,
              arg_max(state, (ts, seq)) FILTER (WHERE state IS NOT NULL) AS last_state, arg_max(process_type, (ts, seq)) AS process_type
       FROM c GROUP BY job_id)
"""


def _iso_sql(x: str) -> str:
    return (
        f"CASE WHEN strftime({x}, '%f') = '000000' THEN strftime({x}, '%Y-%m-%dT%H:%M:%S') || 'Z' "
        f"ELSE strftime({x}, '%Y-%m-%dT%H:%M:%S.%f') || 'Z' END"
    )


@query(
    "runs_latest",
    _RUNS_CTE
    + f"""SELECT job_id, status, {_iso_sql('created_at')} AS created, {_iso_sql('updated_at')} AS updated,
                 n_events, last_state FROM f""",
)
def q_runs_latest(spark, sf):
    r = runs.fold_runs(v_runs(spark, sf))
    return r.select(
        "job_id", "status", C.iso_utc("created_at").alias("created"), C.iso_utc("updated_at").alias("updated"),
        "n_events", "last_state",
    )


def _duration_sql(s: str) -> str:
    return (
        f"CASE WHEN {s} IS NULL OR {s} = 0 THEN '-' WHEN {s} < 60 THEN CAST({s} AS VARCHAR) || 's' "
        f"WHEN {s} // 60 < 60 THEN CAST({s} // 60 AS VARCHAR) || 'm ' || CAST({s} % 60 AS VARCHAR) || 's' "
        f"ELSE CAST({s} // 3600 AS VARCHAR) || 'h ' || CAST(({s} // 60) % 60 AS VARCHAR) || 'm' END"
    )


@query(
    "runs_recent",
    _RUNS_CTE
    + f""", t AS (SELECT *, CAST(date_diff('second', created_at, updated_at) AS BIGINT) AS duration_s FROM f
                 ORDER BY created_at DESC, job_id LIMIT 20)
          SELECT job_id, status, {_iso_sql('created_at')} AS created, duration_s, {_duration_sql('duration_s')} AS duration,
                 process_type,
                 CASE process_type WHEN 'decompress_only' THEN 'Decomp' WHEN 'decompress_and_concatenate' THEN 'Concat'
                      WHEN 'decompress_concatenate_parse' THEN 'Parse' WHEN 'direct_to_bigquery' THEN 'BigQuery'
                      ELSE process_type END AS process
          FROM t""",
)
def q_runs_recent(spark, sf):
    return runs.recent_runs(runs.fold_runs(v_runs(spark, sf)), 20)


@query(
    "run_log_tail",
    oracle_with("v_runs")
    + """, l AS (SELECT job_id, '[' || strftime(ts, '%Y-%m-%dT%H:%M:%S') || 'Z] ' || coalesce(state, kind) AS log, ts, seq FROM v_runs),
         fl AS (SELECT job_id, log, min((ts, seq)) AS first FROM l GROUP BY job_id, log),
         rk AS (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY first DESC) AS rn,
                       count(*) OVER (PARTITION BY job_id) AS n FROM fl)
         SELECT job_id, CAST(max(n) AS BIGINT) AS n_logs, string_agg(log, chr(10) ORDER BY first) AS tail
         FROM rk WHERE rn <= 50 GROUP BY job_id""",
)
def q_run_log_tail(spark, sf):
    t = runs.log_tail(v_runs(spark, sf), 50)
    return t.select("job_id", "n_logs", F.array_join("tail", "\n").alias("tail"))


@query(
    "run_metrics",
    oracle_with("v_runs")
    + f""", r AS (SELECT job_id, CAST(count(*) AS BIGINT) AS records,
                        CAST(date_diff('second', min(ts), max(ts)) AS BIGINT) AS elapsed_s FROM v_runs GROUP BY job_id)
          SELECT job_id, records, elapsed_s,
                 CASE WHEN elapsed_s > 0 THEN CAST(records AS DOUBLE) / elapsed_s END AS records_per_s,
                 {_duration_sql('elapsed_s')} AS duration FROM r""",
)
def q_run_metrics(spark, sf):
    return runs.run_metrics(v_runs(spark, sf))
