"""Views that present the given tables as files, requests, scan logs, archive entries and chunks, for both engines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .. import lookups

# {sha} and {seq} differ between the engines, and so do table names
VIEWS = {
    "v_files": """SELECT doc_id AS file_id,
  CASE WHEN doc_id % 23 = 0 THEN '.hidden' WHEN doc_id % 19 = 0 THEN concat('noext', CAST(doc_id AS STRING))
    ELSE concat('file_', CAST(doc_id AS STRING), '.', CASE doc_id % 10 WHEN 0 THEN 'txt' WHEN 1 THEN 'csv' WHEN 2 THEN 'SVG' WHEN 3 THEN 'zip'
      WHEN 4 THEN 'pdf' WHEN 5 THEN 'png' WHEN 6 THEN 'mp3' WHEN 7 THEN 'mp4' WHEN 8 THEN 'db' ELSE 'xyz' END) END AS filename,
  CASE doc_id % 9 WHEN 0 THEN 'text/plain' WHEN 1 THEN 'text/xml' WHEN 2 THEN 'application/pdf' WHEN 3 THEN 'image/png' WHEN 4 THEN 'image/svg+xml'
    WHEN 5 THEN 'audio/mpeg' WHEN 6 THEN 'video/mp4' WHEN 7 THEN 'application/octet-stream' ELSE 'application/x-none' END AS mime,
  CASE WHEN doc_id % 29 = 0 THEN '' ELSE text END AS content FROM {documents}""",
    "v_requests": """SELECT doc_id AS request_id, concat('/q/in/', CASE WHEN doc_id % 31 = 0 THEN '../' ELSE '' END, 'f', CAST(doc_id AS STRING)) AS file_path,
  CASE WHEN doc_id % 37 = 0 THEN NULL ELSE doc_id % 50 END AS user_id, CASE WHEN doc_id % 17 = 0 THEN 1 ELSE 2 END AS version, 1048576 AS chunk_size,
  n_chars * 1000 AS plaintext_size, CAST(ceil(n_chars * 1000 / 1048576.0) AS BIGINT) + doc_id % 4 AS chunks,
  CASE WHEN doc_id % 13 = 0 THEN upper(sha256_hex) ELSE sha256_hex END AS plaintext_sha256, concat('n', CAST(doc_id AS STRING), '.txt') AS original_filename
FROM (SELECT doc_id, n_chars, {sha} AS sha256_hex FROM {documents}) d""",
    "v_scan_log": """SELECT event_id, ts AS started_at, user_id, CAST(round(value * 2000) AS BIGINT) AS duration_ms,
  CASE event_type WHEN 'click' THEN 'sanitized' WHEN 'purchase' THEN 'rejected' WHEN 'error' THEN 'error' ELSE 'clean' END AS verdict,
  CASE WHEN event_type = 'purchase' THEN CASE event_id % 4 WHEN 0 THEN 'virus_detected' WHEN 1 THEN 'disallowed_mime_type' WHEN 2 THEN 'yara_match' ELSE 'archive_policy:archive_path_traversal' END
    WHEN event_type = 'error' THEN CASE event_id % 12 {early} WHEN 9 THEN 'scanner_busy' WHEN 10 THEN 'scanner_busy' ELSE 'unsupported_image_format' END ELSE '' END AS reason,
  (event_id * 7919 % 5120) * 1048576 AS plaintext_size, event_id % 41 = 0 AS av_unavailable, event_id % 43 = 0 AS yara_unavailable FROM {events}""",
    "v_entries": """SELECT l_orderkey AS archive_id,
  row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate) - 1 AS entry_idx,
  CASE l_partkey % 97 WHEN 0 THEN '../up.txt' WHEN 1 THEN '/abs.txt' WHEN 2 THEN 'a/b/c/d/e/f/g/h/i/j.txt' WHEN 3 THEN 'in/x.ZIP' WHEN 4 THEN 'ok/..'
    ELSE concat('d', CAST(l_suppkey AS STRING), '/f', CAST(l_partkey AS STRING), '.txt') END AS path,
  CASE WHEN l_partkey % 53 = 0 THEN 'x' ELSE '0' END AS typeflag, CAST(round(l_extendedprice * 40) AS BIGINT) AS uncomp_size,
  CAST(round(l_extendedprice * 40) AS BIGINT) + CASE WHEN l_partkey % 89 = 5 THEN 1 ELSE 0 END AS actual_size, 50000 AS archive_size FROM {lineitem}""",
    "v_image_chunks": """SELECT l_orderkey AS file_id,
  row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate) - 1 AS chunk_idx,
  CASE l_partkey % 5 WHEN 0 THEN 'acTL' WHEN 1 THEN 'IDAT' WHEN 2 THEN 'IEND' WHEN 3 THEN 'tEXt' ELSE 'fcTL' END AS chunk_type,
  CASE WHEN l_partkey % 5 = 0 AND l_suppkey % 2 = 0 THEN 8 ELSE 13 END AS length, l_suppkey % 3 AS frames FROM {lineitem}""",
    "v_attempts": """SELECT conv_id AS file_id, CASE conv_id % 3 WHEN 0 THEN 'audio' WHEN 1 THEN 'video' ELSE 'pdf' END AS category, turn AS attempt_idx,
  length(text) % 5 = 0 AS ok, length(text) % 7 = 0 AS timed_out, length(text) % 400 AS seconds FROM {conversations}""",
    "v_chunks": """SELECT file_id, idx AS chunk_idx, substring(content, CAST(idx * 1000 + 1 AS INT), 1000) AS chunk
FROM (SELECT file_id, content, {seq} AS idx FROM ({v_files}) f) t""",
}
_SEQ = "greatest(CAST(ceil(length(content) / 1000.0) AS BIGINT), {one})"
SPARK = {"sha": "sha2(text, 256)", "seq": f"explode(sequence(0L, {_SEQ.format(one='1L')} - 1))"}
DUCK = {"sha": "sha256(text)", "seq": f"unnest(range(0, {_SEQ.format(one='1')}))"}
TABLES = ["documents", "pages", "conversations", "events", "lineitem", "labels", "benchmark", "orders"]


VIEWS["v_scan_log"] = VIEWS["v_scan_log"].replace("{early}", " ".join(f"WHEN {i} THEN '{r}'" for i, r in enumerate(lookups.EARLY_REASONS)))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A base table or a view of one."""
    if name in TABLES:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    text = VIEWS[name].replace("{v_files}", VIEWS["v_files"]).replace("{sha}", SPARK["sha"]).replace("{seq}", SPARK["seq"])
    used = {t: table(spark, sf_dir, t) for t in TABLES if f"{{{t}}}" in text}
    return spark.sql(text, **used)


def duck(name: str) -> str:
    """The view in DuckDB's SQL."""
    text = VIEWS[name].replace("{v_files}", VIEWS["v_files"]).replace("{sha}", DUCK["sha"]).replace("{seq}", DUCK["seq"])
    for t in TABLES:
        text = text.replace(f"{{{t}}}", t)
    return text


def duck_values(name: str, columns: list[str], rows: list[tuple]) -> str:
    """A lookup as a common table expression."""

    def put(v) -> str:
        if v is None:
            return "NULL"
        if isinstance(v, bool):
            return str(v).lower()
        if isinstance(v, list):
            return "[" + ", ".join(put(x) for x in v) + "]::VARCHAR[]"
        return str(v) if isinstance(v, int | float) else "'" + v.replace("'", "''") + "'"

    return f"{name}({', '.join(columns)}) AS (VALUES " + ", ".join("(" + ", ".join(put(v) for v in r) + ")" for r in rows) + ")"


def registry(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(lookups.REGISTRY, "ext string, type string, mime string, scan array<string>, zip_based boolean")


def aliases(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(lookups.ALIASES, "mime string, alias string")


def rules(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(lookups.RULES, "ordinal int, rule_id string, kind string, pattern string")
