"""Queries on verdicts, the audit log, counters and load."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import lookups
from ..operators import audit as U
from ..operators import matching as M
from . import q_inspect  # noqa: F401
from .q_admission import ADMIT, CATEGORY, admitted
from .q_content import HMAC, KEY
from .base import QUERIES, SQL, query
from .views import duck, table

LOG = f"WITH s AS ({duck('v_scan_log')})"
AUDIT = f"""{LOG}, a AS (SELECT coalesce(duration_ms, 0) AS duration_ms, strftime(started_at, '%Y-%m-%d') AS log_date, sha256(CAST(event_id AS VARCHAR)) AS plaintext_sha256, reason,
  row_number() OVER (PARTITION BY strftime(started_at, '%Y-%m-%d') ORDER BY started_at, event_id) - 1 AS seq, strftime(started_at, '%Y-%m-%dT%H:%M:%S+00:00') AS ts, coalesce(user_id, 0) AS user_id, verdict FROM s WHERE reason <> 'scanner_busy')"""
CANON = """'{{"duration_ms":' || {a}duration_ms || ',"log_date":"' || {a}log_date || '","plaintext_sha256":"' || {a}plaintext_sha256 || '","prev":"' || {p} || '","reason":"' || {a}reason || '","seq":' || {a}seq || ',"ts":"' || {a}ts || '","user_id":' || {a}user_id || ',"verdict":"' || {a}verdict || '"}}'"""
ZEROS = "repeat('0', 64)"


def log(spark, sf_dir):
    return table(spark, sf_dir, "v_scan_log")


@query("ver_1_compose_verdict", f"{ADMIT} SELECT file_id, CASE WHEN file_id % 37 = 0 THEN 'error' WHEN content = '' THEN 'clean' WHEN reason IS NOT NULL THEN 'rejected' WHEN contains(content, ' und ') THEN 'rejected' ELSE 'clean' END AS verdict, CASE WHEN file_id % 37 = 0 THEN 'invalid_request' WHEN content = '' THEN 'empty_file' WHEN reason IS NOT NULL THEN reason WHEN contains(content, ' und ') THEN 'yara_match' END AS reason, {CATEGORY} AS category FROM ver")
def ver_1(spark, sf_dir):
    """Requests, then empty files, admission and rules."""
    x = admitted(spark, sf_dir).withColumn("rule_id", M.first_rule(F.col("content"), [r for r in lookups.RULES if r[1] == "has_und"]))
    invalid = {"invalid_request": U.stage(F.col("file_id") % 37 == 0, "error", "invalid_request")}
    return x.select("file_id", U.scan_verdict(invalid | inspected()).alias("v"), "category").select("file_id", "v.*", "category")


def inspected():
    """The stages that admission and rules decide."""
    refused = F.col("reason")
    return {
        "empty": U.stage(F.octet_length("content") == 0, "clean", "empty_file"),
        "disallowed": U.stage(refused == "disallowed_mime_type", "rejected", refused),
        "mismatch": U.stage(refused == "mime_extension_mismatch", "rejected", refused),
        "rules": U.stage(F.col("rule_id").isNotNull(), "rejected", "yara_match"),
    }


SCAN = f"""{ADMIT}, i AS (SELECT v.*, {CATEGORY} AS category, rule_id, a.verdict AS av, a.reason AS ar, g.verdict AS gv, g.reason AS gr, file_id % 61 * 10000 AS ms FROM ver v LEFT JOIN ({SQL['mat_2_first_match']}) m USING (file_id)
  LEFT JOIN ({SQL['arc_11_archive_verdict']}) a ON archive_id = file_id LEFT JOIN ({SQL['img_7_image_policy']}) g USING (file_id)),
j AS (SELECT *, CASE WHEN content = '' THEN ['clean', 'empty_file'] WHEN file_id % 67 = 0 THEN ['error', 'mime_detection_failed'] WHEN reason IS NOT NULL THEN ['rejected', reason] WHEN file_id % 71 = 0 THEN ['rejected', 'av_too_large']
  WHEN rule_id IS NOT NULL THEN ['rejected', 'yara_match'] WHEN category = 'ARCHIVE' THEN [coalesce(av, 'clean'), ar] WHEN category = 'RASTER' THEN [coalesce(gv, 'clean'), CASE WHEN gv <> 'clean' THEN gr END]
  WHEN category = 'TEXT' AND file_id % 3 = 1 THEN ['sanitized', NULL] WHEN category = 'TEXT' AND file_id % 3 = 2 THEN ['rejected', 'sanitizer_rejected'] ELSE ['clean', NULL] END AS v FROM i),
k AS (SELECT *, CASE WHEN file_id % 37 = 0 THEN ['error', 'invalid_request'] WHEN file_id % 41 = 0 THEN ['error', 'unseal_failed'] WHEN file_id % 43 = 0 THEN ['error', 'metadata_mac_invalid'] WHEN file_id % 47 = 0 THEN ['error', 'scanner_busy']
  WHEN file_id % 53 = 0 THEN ['error', 'decryption_failed'] WHEN file_id % 59 = 0 THEN ['rejected', 'virus_detected'] WHEN ms - 20000 > 540000 THEN ['error', 'scan_deadline_exceeded'] WHEN ms > 540000 AND v[1] <> 'rejected' THEN ['error', 'scan_deadline_exceeded']
  WHEN v[1] = 'sanitized' AND file_id % 5 = 0 THEN ['error', 'reencryption_failed'] ELSE v END AS w FROM j)
SELECT file_id, w[1] AS verdict, w[2] AS reason, category FROM k"""


@query("ver_5_scan_verdict", SCAN)
def ver_5(spark, sf_dir):
    """The whole order: all rules, archives and images of the same number, and requests, scanner and clock by number."""
    i, ms = F.col("file_id"), F.col("file_id") % 61 * 10_000
    archives = QUERIES["arc_11_archive_verdict"](spark, sf_dir).select(F.col("archive_id").alias("file_id"), F.struct("verdict", "reason").alias("archive"))
    images = QUERIES["img_7_image_policy"](spark, sf_dir).select("file_id", F.struct("verdict", "reason").alias("image"))
    # rules are looked for where the content is; what is joined has but its length's mark
    x = admitted(spark, sf_dir).withColumn("rule_id", M.first_rule(F.col("content"), lookups.RULES)).withColumn("content", F.when(F.octet_length("content") == 0, "").otherwise("full"))
    x = x.select("file_id", "category", "reason", "rule_id", "content").join(archives, "file_id", "left").join(images, "file_id", "left")
    code = F.when(F.col("image.verdict") == "rejected", 2).when(F.col("image.verdict") == "sanitized", 1).when(F.col("image.verdict") == "error", 3).otherwise(0)
    raster, text = F.col("category") == "RASTER", F.col("category") == "TEXT"
    stages = inspected() | {
        "invalid_request": U.stage(i % 37 == 0, "error", "invalid_request"), "unseal": U.stage(i % 41 == 0, "error", "unseal_failed"), "metadata_mac": U.stage(i % 43 == 0, "error", "metadata_mac_invalid"),
        "busy": U.stage(i % 47 == 0, "error", "scanner_busy"), "decryption": U.stage(i % 53 == 0, "error", "decryption_failed"), "stream_virus": U.stage(i % 59 == 0, "rejected", "virus_detected"),
        "deadline": U.stage(U.past_deadline(F.lit(None).cast("string"), ms - 20_000), "error", "scan_deadline_exceeded"), "mime_detection": U.stage(i % 67 == 0, "error", "mime_detection_failed"), "av": U.stage(i % 71 == 0, "rejected", "av_too_large"),
        "archive": F.when(F.col("category") == "ARCHIVE", F.coalesce("archive", U.compose_verdict([]))),
        "category": F.when(raster, U.outcome_to_verdict(code, F.col("image.reason"))).when(text, U.outcome_to_verdict(i % 3, F.lit(None).cast("string"))),
    }
    output = F.when((F.col("category") == "TEXT") & (i % 3 == 1) & (i % 5 == 0), "reencryption_failed")
    return x.select("file_id", U.scan_verdict(stages, ms, output).alias("v"), "category").select("file_id", "v.*", "category")


@query("ver_2_outcome", f"{LOG} SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'clean' WHEN 1 THEN 'sanitized' WHEN 2 THEN 'rejected' ELSE 'error' END AS verdict, CASE event_id % 4 WHEN 0 THEN NULL WHEN 1 THEN nullif(reason, '') WHEN 2 THEN coalesce(nullif(reason, ''), 'sanitizer_rejected') ELSE coalesce(nullif(reason, ''), 'sanitizer_error') END AS reason FROM s")
def ver_2(spark, sf_dir):
    return log(spark, sf_dir).select("event_id", U.outcome_to_verdict(F.col("event_id") % 4, F.col("reason")).alias("v")).select("event_id", "v.*")


@query("ver_3_past_deadline", f"{LOG} SELECT event_id, duration_ms * 100 > 540000 AND verdict <> 'rejected' AS past FROM s")
def ver_3(spark, sf_dir):
    return log(spark, sf_dir).select("event_id", U.past_deadline(F.col("verdict"), F.col("duration_ms") * 100).alias("past"))


@query("ver_4_busy_reply", f"""{LOG} SELECT event_id, '{{"verdict":"error","reason":"scanner_busy","busy":true,"retry_after_ms":2000}}' AS reply FROM s WHERE reason = 'scanner_busy'""")
def ver_4(spark, sf_dir):
    return log(spark, sf_dir).filter("reason = 'scanner_busy'").select("event_id", U.busy_json().alias("reply"))


@query("aud_1_canonical", f"{AUDIT} SELECT log_date, seq, {CANON.format(a='', p=ZEROS)} AS canonical FROM a")
def aud_1(spark, sf_dir):
    return U.audit_rows(log(spark, sf_dir)).withColumn("prev", F.lit(U.GENESIS)).select("log_date", "seq", U.audit_canonical().alias("canonical"))


CHAIN = AUDIT.replace("WITH s AS", "WITH RECURSIVE s AS") + f""", chain AS (
  SELECT a.log_date, a.seq, {ZEROS} AS prev, {HMAC.format(m=CANON.format(a='a.', p=ZEROS))} AS sig FROM a WHERE seq = 0
  UNION ALL SELECT a.log_date, a.seq, c.sig, {HMAC.format(m=CANON.format(a='a.', p='c.sig'))} FROM chain c JOIN a ON a.log_date = c.log_date AND a.seq = c.seq + 1)"""


@query("aud_2_build_chain", f"{CHAIN} SELECT log_date, seq, prev, sig FROM chain")
def aud_2(spark, sf_dir):
    return U.build_chain(U.audit_rows(log(spark, sf_dir)), KEY).select("log_date", "seq", "prev", "sig")


@query("aud_3_verify_chain", f"{AUDIT} SELECT log_date, count(*) AS records, CASE WHEN right(log_date, 1) = '5' AND count(*) > 2 THEN 2::BIGINT END AS first_break FROM a GROUP BY log_date")
def aud_3(spark, sf_dir):
    """A chain whose third record was changed on some days."""
    chain = U.build_chain(U.audit_rows(log(spark, sf_dir)), KEY)
    changed = F.col("log_date").endswith("5") & (F.col("seq") == 2)
    return U.first_breaks(chain.withColumn("user_id", F.when(changed, F.col("user_id") + 1).otherwise(F.col("user_id"))), KEY)


@query("aud_4_chain_tail", f"{AUDIT}, z AS (SELECT log_date, count(*) AS n FROM a GROUP BY log_date) SELECT log_date, CASE WHEN right(log_date, 1) = '7' THEN 0 WHEN right(log_date, 1) = '3' THEN n - 1 ELSE n END AS seq, CASE WHEN right(log_date, 1) = '7' OR (right(log_date, 1) = '3' AND n = 1) THEN {ZEROS} WHEN right(log_date, 1) = '3' THEN sha256('' || (n - 2)) ELSE sha256('' || (n - 1)) END AS sig FROM z")
def aud_4(spark, sf_dir):
    """Logs of which some end in a torn line and some in one that doesn't parse."""
    a = U.audit_rows(log(spark, sf_dir)).withColumn("sig", F.sha2(F.col("seq").cast("string"), 256))
    from pyspark.sql import Window as W

    last = F.max("seq").over(W.partitionBy("log_date")) == F.col("seq")
    line = F.when(last & F.col("log_date").endswith("7"), "{broken").otherwise(F.to_json(F.struct("seq", "sig")))
    return U.chain_tail(a.select("log_date", F.col("seq").alias("line_no"), line.alias("line"), (~(last & F.col("log_date").endswith("3"))).alias("complete")))


@query("aud_5_failure_rows", f"{LOG} SELECT event_id, 'error' AS verdict, reason, duration_ms AS elapsed_ms, CASE WHEN reason <> 'invalid_request' THEN user_id END AS user_id FROM s WHERE verdict = 'error' AND reason <> 'scanner_busy'")
def aud_5(spark, sf_dir):
    return U.failure_rows(log(spark, sf_dir))


EARLY = "(verdict = 'error' AND reason IN ('scanner_busy', " + ", ".join(f"'{r}'" for r in lookups.EARLY_REASONS) + "))"
COUNTERS = f"""count(*) FILTER (NOT {EARLY}) AS completed, count(*) FILTER (verdict = 'clean') AS clean, count(*) FILTER (verdict = 'sanitized') AS sanitized, count(*) FILTER (verdict = 'rejected') AS rejected,
  count(*) FILTER (verdict = 'error' AND NOT {EARLY}) AS errored, count(*) FILTER (verdict = 'rejected' AND reason LIKE 'virus_detected%') AS virus_hits, count(*) FILTER (av_unavailable) AS av_unavailable,
  count(*) FILTER (yara_unavailable) AS rules_unavailable, coalesce(sum(duration_ms) FILTER (NOT {EARLY}), 0)::BIGINT AS total_ms, count(*) FILTER (reason = 'scanner_busy') AS busy"""


@query("met_1_scan_metrics", f"{LOG} SELECT {COUNTERS} FROM s")
def met_1(spark, sf_dir):
    return U.scan_metrics(log(spark, sf_dir))


@query("met_2_health_snapshot", f"{LOG}, x AS (SELECT min(started_at) AS lo, max(started_at) AS hi FROM s), y AS (SELECT floor(epoch(started_at)) + duration_ms / 1000.0 <= floor(epoch(hi)) AS over, reason, floor(epoch(hi)) - floor(epoch(lo)) AS up FROM s, x) SELECT max(up)::BIGINT AS uptime_s, count(*) FILTER (over) AS completed, count(*) FILTER (NOT over) AS inflight, count(*) FILTER (reason IN ('sanitized_path_too_long', 'reencryption_failed')) AS write_failures FROM y")
def met_2(spark, sf_dir):
    return U.health_snapshot(log(spark, sf_dir))


@query("met_3_verdict_breakdown", f"{LOG} SELECT strftime(started_at, '%Y-%m-%d') AS day, reason, {COUNTERS} FROM s GROUP BY ROLLUP (1, 2)")
def met_3(spark, sf_dir):
    return U.verdict_breakdown(log(spark, sf_dir), [F.date_format("started_at", "yyyy-MM-dd").alias("day"), "reason"], rollup=True)


LOAD = f"""{LOG}, b AS (SELECT event_id, epoch_us(started_at) // 1000 AS st, epoch_us(started_at) // 1000 + duration_ms AS en, plaintext_size * 3 AS w FROM s),
ch AS (SELECT event_id, st AS at_ms, 1 AS change, w AS bytes FROM b UNION ALL SELECT event_id, en, -1, -w FROM b),
tl AS (SELECT event_id, at_ms, at_ms // 86400000 AS day, change, sum(change) OVER o AS running, sum(bytes) OVER o AS reserved FROM ch WINDOW o AS (ORDER BY at_ms, change, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))"""


@query("load_1_inflight_timeline", f"{LOAD} SELECT event_id, at_ms, day, change, running::BIGINT AS running, reserved::BIGINT AS reserved FROM tl")
def load_1(spark, sf_dir):
    return U.inflight_timeline(log(spark, sf_dir))


@query("load_1_peak_load", f"{LOAD} SELECT day, max(running)::BIGINT AS peak_running, max(reserved)::BIGINT AS peak_bytes, max(reserved) > 17179869184 AS over_budget FROM tl GROUP BY day")
def load_1_peak(spark, sf_dir):
    return U.peak_load(U.inflight_timeline(log(spark, sf_dir)))


def load_requests(spark, sf_dir):
    """The scan log as requests to some hosts, which take a thousand times as long."""
    start = (F.unix_timestamp("started_at") * 1000).cast("long")
    x = log(spark, sf_dir).withColumn("start_ms", start)
    return x.select(F.concat(F.lit("h"), (F.col("user_id") % 8).cast("string")).alias("host"), F.col("event_id").alias("request_id"), "start_ms", (F.col("start_ms") + F.col("duration_ms") * 1000).alias("end_ms"), (F.col("plaintext_size") * 3).alias("bytes"))


_LEFT = "list_filter(r.held, lambda x: x.e > q.s)"
_FITS = f"coalesce(list_sum(list_transform({_LEFT}, lambda x: x.b)), 0) + q.b <= {lookups.LOAD_BUDGET}"
REPLAY = f"""WITH RECURSIVE q AS MATERIALIZED (
  SELECT *, row_number() OVER (PARTITION BY host ORDER BY s, request_id) AS i FROM (
    SELECT 'h' || (user_id % 8) AS host, event_id AS request_id, epoch(date_trunc('second', started_at))::BIGINT * 1000 AS s,
      epoch(date_trunc('second', started_at))::BIGINT * 1000 + duration_ms * 1000 AS e, plaintext_size * 3 AS b FROM ({duck('v_scan_log')}) l)),
r AS (
  SELECT host, i, request_id, b <= {lookups.LOAD_BUDGET} AS admitted, CASE WHEN b <= {lookups.LOAD_BUDGET} THEN [{{'e': e, 'b': b}}] ELSE [] END AS held FROM q WHERE i = 1
  UNION ALL
  SELECT q.host, q.i, q.request_id, {_FITS}, CASE WHEN {_FITS} THEN list_append({_LEFT}, {{'e': q.e, 'b': q.b}}) ELSE {_LEFT} END FROM r JOIN q ON q.host IS NOT DISTINCT FROM r.host AND q.i = r.i + 1)
SELECT host, request_id, admitted FROM r"""


@query("load_2_budget_replay", REPLAY)
def load_2(spark, sf_dir):
    return U.budget_replay(load_requests(spark, sf_dir))


@query("cor_1_corpus_report", f"{ADMIT} SELECT file_id, CASE WHEN file_id % 11 = 0 THEN NULL WHEN reason IS NULL THEN 'clean' ELSE 'rejected' END AS verdict, CASE WHEN file_id % 11 <> 0 THEN mime END AS mime, CASE WHEN file_id % 11 <> 0 THEN reason END AS reason, file_id % 11 <> 0 AND reason IS NULL AS ok, file_id % 11 = 0 AS missing FROM ver")
def cor_1(spark, sf_dir):
    """Admission as the result of a corpus run from which every eleventh file is missing."""
    x = admitted(spark, sf_dir)
    results = x.filter("file_id % 11 <> 0").select("file_id", F.coalesce("verdict", F.lit("clean")).alias("verdict"), "mime", "reason")
    return U.corpus_report(x, results)
