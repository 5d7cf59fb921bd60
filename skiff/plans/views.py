"""Views derived from the given tables, identical in Spark and in the DuckDB oracle.

They stand in for storage listings, selections and run histories so that every query
reads the tables and grows with them.  ``ORACLE_VIEWS`` holds the SQL form of each.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def v_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A listing: 1/10 folder placeholders, 1/10 ``.json``, the rest ``.bz2``; 3 buckets; keys
    of two, three and four segments, the latter with an empty one."""
    d = table(spark, sf_dir, "documents")
    suffix = (
        F.when(F.col("doc_id") % 10 == 9, F.lit("/"))
        .when(F.col("doc_id") % 10 == 8, F.lit(".json"))
        .otherwise(F.lit(".bz2"))
    )
    return d.select(
        F.concat(F.lit("bucket"), (F.col("doc_id") % 3).cast("string")).alias("bucket"),
        F.concat(
            F.col("source"),
            F.when(F.col("doc_id") % 13 == 0, F.lit("/")).when(F.col("doc_id") % 17 == 0, F.concat(F.lit("//"), "lang", F.lit("/")))
            .otherwise(F.concat(F.lit("/"), "lang", F.lit("/"))),
            F.col("doc_id").cast("string"),
            suffix,
        ).alias("key"),
        F.col("n_chars").alias("size_bytes"),
    )


def v_dated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A listing with an ISO date folder in the key; 1/20 undated."""
    e = table(spark, sf_dir, "events")
    day = F.when(F.col("event_id") % 20 == 0, F.lit("undated")).otherwise(F.date_format("ts", "yyyy-MM-dd"))
    return e.select(
        F.lit("events").alias("bucket"),
        F.concat_ws("/", "event_type", day, F.concat(F.col("event_id").cast("string"), F.lit(".bz2"))).alias("key"),
        (F.lit(1000) + F.col("event_id") * 7).alias("size_bytes"),
    )


def v_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Selected paths in three forms, all derived from the tables.

    * every one-digit source folder, in every bucket (``src1`` is also a string prefix of
      ``src10``..``src19``: the two boundaries differ there);
    * ``/source/lang/`` with outer slashes, for each document labelled toxic;
    * the file key of each document labelled high quality (some keys do not exist,
      because that document's object is a placeholder, ``.json`` or in another folder);
    * the root of one bucket.
    """
    d = table(spark, sf_dir, "documents")
    lab = table(spark, sf_dir, "labels")
    bucket = F.concat(F.lit("bucket"), (F.col("d.doc_id") % 3).cast("string"))
    dl = d.alias("d").join(lab.alias("l"), F.col("d.doc_id") == F.col("l.doc_id"))
    top = d.alias("d").where(F.length("d.source") == 4).select(bucket.alias("bucket"), F.col("d.source").alias("path"))
    folders = dl.where(F.col("l.toxic") == 1).select(
        bucket.alias("bucket"), F.concat(F.lit("/"), F.col("d.source"), F.lit("/"), F.col("d.lang"), F.lit("/")).alias("path")
    )
    files = dl.where(F.col("l.quality") == 1).select(
        bucket.alias("bucket"),
        F.concat_ws("/", F.col("d.source"), F.col("d.lang"), F.concat(F.col("d.doc_id").cast("string"), F.lit(".bz2"))).alias("path"),
    )
    root = d.where(F.col("doc_id") % 3 == 2).select(F.lit("bucket2").alias("bucket"), F.lit("").alias("path")).limit(1)
    return top.unionByName(folders).unionByName(files).unionByName(root).distinct()


def _process_by_priority() -> F.Column:
    p = F.substring("o_orderpriority", 1, 1)
    return (
        F.when(p == "1", F.lit("decompress_only"))
        .when(p == "2", F.lit("decompress_and_concatenate"))
        .when(p == "3", F.lit("decompress_concatenate_parse"))
        .when(p == "4", F.lit("direct_to_bigquery"))
        .otherwise(F.lit("load_to_table"))
    )


def v_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Run events: each order is an event of its customer's job -- of 16, one creates, three
    update (one without a status), one cancels, one logs, one polls in vain; the others poll
    the order's state."""
    o = table(spark, sf_dir, "orders")
    state = (
        F.when(F.col("o_orderstatus") == "O", F.lit("JOB_STATE_RUNNING"))
        .when(F.col("o_orderstatus") == "F", F.lit("JOB_STATE_DONE"))
        .otherwise(F.lit("JOB_STATE_UNKNOWN_X"))
    )
    k = F.col("o_orderkey") % 16
    kind = (
        F.when(k == 0, F.lit("create")).when(k.isin(1, 2, 3), F.lit("update")).when(k == 4, F.lit("cancel")).when(k == 5, F.lit("log"))
        .otherwise(F.lit("refresh"))
    )
    status = F.when(k == 0, F.lit("submitted")).when(k == 1, F.lit("running")).when(k == 2, F.lit("completed"))
    polled = F.when(k > 6, state)
    return o.select(
        F.concat(F.lit("job-"), F.col("o_custkey").cast("string")).alias("job_id"),
        F.col("o_orderkey").alias("seq"),
        F.col("o_orderdate").alias("ts"),
        kind.alias("kind"),
        status.alias("status"),
        polled.alias("state"),
        F.concat(F.lit("["), F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("Z] "), F.coalesce(polled, kind)).alias("log"),
        _process_by_priority().alias("process_type"),
    )


def event_line(e: DataFrame) -> F.Column:
    """One NDJSON line per event, built from integers and strings only."""
    return F.concat(
        F.lit('{"event_id":'), F.col("event_id").cast("string"),
        F.lit(',"user_id":'), F.col("user_id").cast("string"),
        F.lit(',"event_type":"'), F.col("event_type"),
        F.lit('","day":"'), F.date_format("ts", "yyyy-MM-dd"),
        F.lit('","props":'), F.col("props"), F.lit("}"),
    )


# The same views for DuckDB (the oracle).  ``{t}`` names are the pre-registered tables.
ORACLE_VIEWS = {
    "v_objects": """
        SELECT 'bucket' || CAST(doc_id % 3 AS VARCHAR) AS bucket,
               source || CASE WHEN doc_id % 13 = 0 THEN '/' WHEN doc_id % 17 = 0 THEN '//' || lang || '/' ELSE '/' || lang || '/' END ||
               CAST(doc_id AS VARCHAR) ||
               CASE WHEN doc_id % 10 = 9 THEN '/' WHEN doc_id % 10 = 8 THEN '.json' ELSE '.bz2' END AS "key",
               n_chars AS size_bytes
        FROM documents""",
    "v_dated": """
        SELECT 'events' AS bucket,
               event_type || '/' ||
               CASE WHEN event_id % 20 = 0 THEN 'undated' ELSE strftime(ts, '%Y-%m-%d') END ||
               '/' || CAST(event_id AS VARCHAR) || '.bz2' AS "key",
               1000 + event_id * 7 AS size_bytes
        FROM events""",
    "v_selection": """
        SELECT DISTINCT bucket, path FROM (
          SELECT 'bucket' || CAST(doc_id % 3 AS VARCHAR) AS bucket, source AS path
          FROM documents WHERE length(source) = 4
          UNION ALL
          SELECT 'bucket' || CAST(d.doc_id % 3 AS VARCHAR), '/' || d.source || '/' || d.lang || '/'
          FROM documents d JOIN labels l ON d.doc_id = l.doc_id WHERE l.toxic = 1
          UNION ALL
          SELECT 'bucket' || CAST(d.doc_id % 3 AS VARCHAR),
                 d.source || '/' || d.lang || '/' || CAST(d.doc_id AS VARCHAR) || '.bz2'
          FROM documents d JOIN labels l ON d.doc_id = l.doc_id WHERE l.quality = 1
          UNION ALL
          SELECT 'bucket2', '' FROM documents WHERE doc_id % 3 = 2)""",
    "v_patterns": """
        SELECT bucket, path, g.glob_no,
               'gs://' || bucket || CASE WHEN trim(path, '/') = '' THEN '' ELSE '/' || trim(path, '/') END ||
               CASE g.glob_no WHEN 0 THEN '/*.bz2' ELSE '/**/*.bz2' END AS pattern
        FROM v_selection, (SELECT 0 AS glob_no UNION ALL SELECT 1) g""",
    "v_prefixes": """
        SELECT DISTINCT bucket, rtrim(trim(path, '/'), '/') AS prefix FROM v_selection""",
    "v_runs": """
        SELECT 'job-' || CAST(o_custkey AS VARCHAR) AS job_id, o_orderkey AS seq, o_orderdate AS ts,
               CASE WHEN o_orderkey % 16 = 0 THEN 'create' WHEN o_orderkey % 16 IN (1, 2, 3) THEN 'update'
                    WHEN o_orderkey % 16 = 4 THEN 'cancel' WHEN o_orderkey % 16 = 5 THEN 'log' ELSE 'refresh' END AS kind,
               CASE o_orderkey % 16 WHEN 0 THEN 'submitted' WHEN 1 THEN 'running' WHEN 2 THEN 'completed' END AS status,
               CASE WHEN o_orderkey % 16 > 6 THEN CASE o_orderstatus WHEN 'O' THEN 'JOB_STATE_RUNNING' WHEN 'F' THEN 'JOB_STATE_DONE'
                    ELSE 'JOB_STATE_UNKNOWN_X' END END AS state,
               CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'decompress_only'
                    WHEN '2' THEN 'decompress_and_concatenate' WHEN '3' THEN 'decompress_concatenate_parse'
                    WHEN '4' THEN 'direct_to_bigquery' ELSE 'load_to_table' END AS process_type
        FROM orders""",
}


def oracle_with(*names: str) -> str:
    """``WITH`` clause defining the named views (in dependency order)."""
    order = ["v_objects", "v_dated", "v_selection", "v_patterns", "v_prefixes", "v_runs"]
    need = set(names)
    if "v_patterns" in need or "v_prefixes" in need:
        need.add("v_selection")
    parts = [f"{n} AS ({ORACLE_VIEWS[n]})" for n in order if n in need]
    return "WITH " + ",\n".join(parts) + "\n"
