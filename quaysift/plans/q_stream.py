"""Queries that replay given tables as streams, drained once, and return what the stream wrote."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import lookups
from ..functions import checks as C
from ..operators import admission as A
from ..operators import audit as U
from ..streaming import streams as S
from .q_admission import ADMIT, CATEGORY
from .q_log import COUNTERS, LOG
from .base import query
from .views import VIEWS, aliases, registry, table

_own: list[str] = []


def folder(spark: SparkSession) -> str:
    """A new folder below the shared one (``spark.checkpoint.dir``), or a temporary one in local mode."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not _own:
        master = spark.conf.get("spark.master", "local")
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a shared folder")
        _own.append(tempfile.mkdtemp(prefix="spark-"))
    return f"{(named or _own[0]).rstrip('/')}/stream-{uuid.uuid4().hex}"


def streamed(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A base table, one file or a folder of files, as a stream of its files."""
    return spark.readStream.schema(table(spark, sf_dir, name).schema).parquet(f"{sf_dir}/{name}.parquet*")


def drained(spark: SparkSession, df: DataFrame) -> DataFrame:
    at = folder(spark)
    S.write_stream(df, f"{at}/out", f"{at}/checkpoint").awaitTermination()
    return spark.read.schema(df.schema).parquet(f"{at}/out")


@query("str_1_scan_stream", f"{ADMIT} SELECT file_id, CASE WHEN content = '' THEN 'clean' WHEN reason IS NOT NULL THEN 'rejected' ELSE 'clean' END AS verdict, CASE WHEN content = '' THEN 'empty_file' ELSE reason END AS reason, {CATEGORY} AS category FROM ver")
def str_1(spark, sf_dir):
    files = spark.sql(VIEWS["v_files"], documents=streamed(spark, sf_dir, "documents")).withColumn("ext", C.extension(F.col("filename")))
    reg = registry(spark)
    return drained(spark, S.scan_stream(files, A.mime_to_exts(reg, aliases(spark)), A.prefix_to_exts(reg), A.scan_class_exts(reg)))


@query("str_2_metrics_stream", f"{LOG}, d AS (SELECT strftime(started_at, '%Y-%m-%d') AS day, * FROM s) SELECT day, {COUNTERS} FROM d WHERE day < (SELECT max(day) FROM d) GROUP BY day")
def str_2(spark, sf_dir):
    """Days that are over when the stream ends."""
    log = spark.sql(VIEWS["v_scan_log"], events=streamed(spark, sf_dir, "events"))
    out = drained(spark, S.metrics_stream(log))
    return out.withColumn("day", F.date_format("day", "yyyy-MM-dd"))


RULED = "contains(content, ' und ') OR contains(content, ' que ') OR regexp_matches(content, 'the [a-z]+ the') OR contains(content, ' pour ') OR contains(content, ' the ')"


@query("str_5_scan_audit", f"""{ADMIT}, w AS (SELECT file_id, {CATEGORY} AS category, CASE WHEN content = '' THEN 'empty_file' WHEN reason IS NOT NULL THEN reason WHEN {RULED} THEN 'yara_match' END AS why, content = '' AS none FROM ver)
SELECT file_id, CASE WHEN none OR why IS NULL THEN 'clean' ELSE 'rejected' END AS verdict, why AS reason, category, CASE WHEN none OR why IS NULL THEN 'clean' ELSE 'rejected' END AS audited, true AS chain_ok FROM w""")
def str_5(spark, sf_dir):
    """Verdicts with all rules, written as results and as a signed log in one stream, and read back together."""
    files = spark.sql(VIEWS["v_files"], documents=streamed(spark, sf_dir, "documents")).withColumn("ext", C.extension(F.col("filename")))
    i = F.col("file_id")
    files = files.withColumns({
        "started_at": F.timestamp_seconds(1_700_000_000 + i * 600), "user_id": i % 50, "duration_ms": F.length("content").cast("long"), "plaintext_sha256": F.sha2(i.cast("string"), 256),
    })
    reg = registry(spark)
    scans = S.scan_stream(files, A.mime_to_exts(reg, aliases(spark)), A.prefix_to_exts(reg), A.scan_class_exts(reg), lookups.RULES, keep=("started_at", "user_id", "duration_ms", "plaintext_sha256"))
    at, key = folder(spark), b"0123456789abcdef"
    S.write_scans(scans, f"{at}/out", f"{at}/checkpoint", key).awaitTermination()
    sink = S.ScanSink(f"{at}/out", key)
    chain = U.verify_chain(sink.written(spark, "audit"), key).select("plaintext_sha256", F.col("verdict").alias("audited"), F.col("ok").alias("chain_ok"))
    results = sink.written(spark, "results").withColumn("plaintext_sha256", F.sha2(i.cast("string"), 256))
    return results.join(chain, "plaintext_sha256").select("file_id", "verdict", "reason", "category", "audited", "chain_ok")


@query("str_6_running_metrics", f"{LOG} SELECT {COUNTERS} FROM s")
def str_6(spark, sf_dir):
    """The counters since the start, as the last of the stream's updates has them."""
    events = streamed(spark, sf_dir, "events")
    at = folder(spark)

    def put(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{at}/batch_id={batch_id}")  # one row

    running = S.running_metrics(spark.sql(VIEWS["v_scan_log"], events=events))
    running.writeStream.outputMode("complete").foreachBatch(put).option("checkpointLocation", f"{at}-checkpoint").trigger(availableNow=True).start().awaitTermination()
    rows = spark.read.schema(running.schema.add("batch_id", "integer")).parquet(at)
    return rows.orderBy(F.desc("batch_id")).limit(1).drop("batch_id")
