"""Verdicts, the hash-chained audit log, counters and load over time."""

from __future__ import annotations

import heapq
import hmac
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import lookups
from ..functions.checks import hmac_sha256
from ..sources.chunks import read_chunks

GENESIS = "0" * 64
CANONICAL = ["duration_ms", "log_date", "plaintext_sha256", "prev", "reason", "seq", "ts", "user_id", "verdict"]


def compose_verdict(stages: list[Column]) -> Column:
    """The first of the nullable ``struct(verdict, reason)`` columns, or clean."""
    return F.coalesce(*stages, F.struct(F.lit("clean").alias("verdict"), F.lit(None).cast("string").alias("reason")))


#: Stages of a scan in order: those before the content is inspected end it at once, an infected stream goes on as a rejection.
BEFORE = ("invalid_request", "unseal", "metadata_mac", "busy", "decryption", "stream_virus", "deadline")
INSIDE = ("empty", "mime_detection", "disallowed", "mismatch", "av", "rules", "archive", "category")


def stage(when: Column, verdict: str, reason: str | Column | None) -> Column:
    """A nullable ``struct(verdict, reason)``."""
    return F.when(when, F.struct(F.lit(verdict).alias("verdict"), (reason if isinstance(reason, Column) else F.lit(reason)).cast("string").alias("reason")))


def scan_verdict(stages: dict[str, Column], elapsed_ms: Column | None = None, output: Column | None = None) -> Column:
    """``struct(verdict, reason)`` of a whole scan, of nullable columns by the names in ``BEFORE`` and ``INSIDE``; a stage that isn't there passes.

    An archive's stage must be set, as clean, where the archive passes, for archives have no other category outcome. After
    inspection a scan past its deadline (``elapsed_ms``) is an error unless it is rejected, whatever came before; then ``output`` is
    the nullable reason why a sanitized result couldn't be written.
    """
    if unknown := set(stages) - {*BEFORE, *INSIDE}:
        raise ValueError(f"unknown stages: {sorted(unknown)}")
    first = [stages[n] for n in BEFORE if n in stages]
    v = compose_verdict([stages[n] for n in INSIDE if n in stages])
    late = [] if elapsed_ms is None else [stage(past_deadline(v["verdict"], elapsed_ms), "error", "scan_deadline_exceeded")]
    unwritten = [] if output is None else [stage(output.isNotNull() & (v["verdict"] == "sanitized"), "error", output)]
    return F.coalesce(*first, *late, *unwritten, v)


def outcome_to_verdict(code: Column, reason: Column) -> Column:
    """``struct(verdict, reason)`` of a category's outcome code; a clean one drops its reason."""
    own = F.nullif(reason, F.lit(""))
    verdict = F.when(code == 0, "clean").when(code == 1, "sanitized").when(code == 2, "rejected").otherwise("error")
    text = F.when(code == 0, F.lit(None)).when(code == 1, own).when(code == 2, F.coalesce(own, F.lit("sanitizer_rejected"))).otherwise(F.coalesce(own, F.lit("sanitizer_error")))
    return F.struct(verdict.alias("verdict"), text.alias("reason"))


def past_deadline(verdict: Column, elapsed_ms: Column) -> Column:
    return F.coalesce(elapsed_ms > lookups.WALL_MS, F.lit(False)) & (F.coalesce(verdict, F.lit("")) != "rejected")


def busy_json() -> Column:
    """The fixed reply to a request that isn't taken."""
    return F.to_json(F.struct(F.lit("error").alias("verdict"), F.lit("scanner_busy").alias("reason"), F.lit(True).alias("busy"), F.lit(lookups.RETRY_MS).alias("retry_after_ms")))


def audit_rows(log: DataFrame) -> DataFrame:
    """A scan log as audit fields, with ``seq`` from 0 within each day. Busy replies aren't audited."""
    kept = log.filter("reason IS NULL OR reason <> 'scanner_busy'").withColumn("log_date", F.date_format("started_at", "yyyy-MM-dd"))
    seq = F.row_number().over(W.partitionBy("log_date").orderBy("started_at", "event_id")) - 1
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    return kept.select(
        F.coalesce("duration_ms", F.lit(0)).cast("long").alias("duration_ms"), "log_date", F.sha2(F.col("event_id").cast("string"), 256).alias("plaintext_sha256"), text("reason").alias("reason"),
        seq.cast("long").alias("seq"), F.date_format("started_at", "yyyy-MM-dd'T'HH:mm:ss'+00:00'").alias("ts"), F.coalesce("user_id", F.lit(0)).cast("long").alias("user_id"), text("verdict").alias("verdict"),
    )


def audit_canonical() -> Column:
    """The record's signed text: its keys in alphabetical order, without spaces."""
    return F.to_json(F.struct(*CANONICAL))


def canonical_text(r: dict) -> str:
    """The row form of ``audit_canonical``."""
    import json

    return json.dumps({k: r[k] for k in CANONICAL}, separators=(",", ":"), ensure_ascii=False)


def build_chain(rows: DataFrame, key: bytes, tails: dict[str, tuple[int, str]] | None = None) -> DataFrame:
    """Adds ``prev`` and ``sig``: each record signs the one before it in its day, the first 64 zeros (or the stored tail).

    A chain is sequential within a day and parallel over days. Rows stream through the task in order, which keeps
    one signature a day, so a day of any size needs no more memory.
    """
    tails = tails or {}
    columns = [c for c in CANONICAL if c != "prev"]

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        day, sig, first = None, GENESIS, 0
        for b in batches:
            out = []
            for r in b.to_pylist():
                if r["log_date"] != day:
                    day = r["log_date"]
                    first, sig = tails.get(day, (0, GENESIS))
                r["seq"] += first
                r["prev"] = sig
                r["sig"] = sig = hmac.digest(key, canonical_text(r).encode(), "sha256").hex()
                out.append(r)
            yield pa.RecordBatch.from_pylist(out, schema=schema)

    schema = pa.schema([(c, pa.int64() if c in ("duration_ms", "seq", "user_id") else pa.string()) for c in [*CANONICAL, "sig"]])
    ddl = ", ".join(f"{c} {'long' if c in ('duration_ms', 'seq', 'user_id') else 'string'}" for c in [*CANONICAL, "sig"])
    return rows.select(*columns).repartition("log_date").sortWithinPartitions("log_date", "seq").mapInArrow(sign, ddl)


def verify_chain(log: DataFrame, key: bytes) -> DataFrame:
    """Adds ``ok``: the signature fits the record, ``prev`` is the signature of the record with the number before, and the number is
    the record's alone. Records meet by day and number, so a day is no task of its own."""
    prior = log.groupBy("log_date", (F.col("seq") + 1).alias("seq")).agg(F.min("sig").alias("_before"))
    alone = F.count(F.lit(1)).over(W.partitionBy("log_date", "seq")) == 1
    before = F.coalesce("_before", F.when(F.col("seq") == 0, GENESIS))
    ok = (hmac_sha256(audit_canonical(), key) == F.col("sig")) & F.coalesce(F.col("prev") == before, F.lit(False)) & alone
    return log.join(prior, ["log_date", "seq"], "left").withColumn("ok", ok).select(*log.columns, "ok")


def first_breaks(log: DataFrame, key: bytes) -> DataFrame:
    """``log_date, records, first_break``: the first record of each day that doesn't verify, or null."""
    return verify_chain(log, key).groupBy("log_date").agg(F.count(F.lit(1)).alias("records"), F.min(F.when(~F.col("ok"), F.col("seq"))).alias("first_break"))


def chain_tail(lines: DataFrame) -> DataFrame:
    """``log_date, seq, sig`` to go on from, of ``lines(log_date, line_no, line, complete)``.

    The last complete line counts; where it doesn't parse or has no valid number and signature, the day begins anew.
    """
    last = lines.filter("complete").groupBy("log_date").agg(F.max_by("line", "line_no").alias("line"))
    r = F.from_json("line", "seq long, sig string", {"mode": "PERMISSIVE"})
    x = lines.select("log_date").distinct().join(last, "log_date", "left").withColumn("r", r)
    good = F.coalesce(F.col("r.seq").isNotNull() & (F.length("r.sig") == 64), F.lit(False))
    return x.select("log_date", F.when(good, F.greatest(F.col("r.seq") + 1, F.lit(0))).otherwise(0).alias("seq"), F.when(good, F.col("r.sig")).otherwise(GENESIS).alias("sig"))


#: Bytes at the end of a log file that are read to find its last line; a line is far shorter.
TAIL_BYTES = 1 << 16


def log_tails(spark: SparkSession, path: str, tail: int = TAIL_BYTES) -> DataFrame:
    """``log_date, seq, sig`` to go on from, of a log that ``write_audit`` wrote: ``chain_tail`` from the end of each day's files.

    Files' lengths are listed, and of each only the last ``tail`` to twice as many bytes are read, however long a day is. Of a day's files the one with the highest
    number in its last line counts. A line that isn't ended yet doesn't count, and a file without a whole line in its tail has none.
    """
    ends = read_chunks(spark, path, chunk=tail, range_bytes=tail, max_bytes=1 << 62, glob="*.json", last=2)
    text = ends.groupBy("path").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chunk_idx", "chunk"))), lambda r: F.decode(r["chunk"], "ISO-8859-1")), "").alias("text"), F.min("offset").alias("from"))
    lines = F.slice(F.split("text", "\n"), F.when(F.col("from") > 0, 2).otherwise(1), F.lit(1 << 30))  # the first may be cut
    whole = F.slice(lines, F.lit(1), F.greatest(F.size(lines) - 1, F.lit(0)))  # behind the last end of line stands nothing, or what isn't ended
    last = text.select(F.regexp_extract("path", "log_date=([^/]*)", 1).alias("log_date"), "path", F.get(whole, F.size(whole) - 1).alias("line"))
    number = F.coalesce(F.get_json_object("line", "$.seq").cast("long"), F.lit(-1))
    # in the order of their numbers, so that the last line of the day is the last of all
    rows = last.select("log_date", number.alias("line_no"), F.decode(F.encode("line", "ISO-8859-1"), "UTF-8").alias("line"), F.col("line").isNotNull().alias("complete"))
    return chain_tail(rows)


def failure_rows(log: DataFrame) -> DataFrame:
    """Early failures as audit fields: those of requests that weren't parsed have neither digest nor user."""
    early = log.filter("verdict = 'error' AND reason <> 'scanner_busy'")
    parsed = ~F.col("reason").isin("invalid_request", "invalid_message", "missing_op", "unknown_op")
    return early.select("event_id", F.lit("error").alias("verdict"), "reason", F.col("duration_ms").alias("elapsed_ms"), F.when(parsed, F.col("user_id")).alias("user_id"))


def _counters() -> list[Column]:
    v, r = F.col("verdict"), F.col("reason")
    early = (v == "error") & F.coalesce(r.isin("scanner_busy", *lookups.EARLY_REASONS), F.lit(False))
    done = ~early
    count = lambda c, n: F.count_if(c).alias(n)
    return [
        count(done, "completed"), count(v == "clean", "clean"), count(v == "sanitized", "sanitized"), count(v == "rejected", "rejected"), count(done & (v == "error"), "errored"),
        count((v == "rejected") & r.startswith("virus_detected"), "virus_hits"), count("av_unavailable", "av_unavailable"), count("yara_unavailable", "rules_unavailable"),
        F.sum(F.when(done, F.col("duration_ms")).otherwise(0)).alias("total_ms"), count(r == "scanner_busy", "busy"),
    ]


def scan_metrics(log: DataFrame) -> DataFrame:
    """The counters over a log, one row. Failures before the scan count in neither completed nor errored."""
    return log.agg(*_counters())


def verdict_breakdown(log: DataFrame, dims: list[str | Column], rollup: bool = False) -> DataFrame:
    """The counters by dimensions, with subtotals if asked."""
    return (log.rollup(*dims) if rollup else log.groupBy(*dims)).agg(*_counters())


def health_snapshot(log: DataFrame) -> DataFrame:
    """``uptime_s, completed, inflight, write_failures`` at the log's last start."""
    x = log.agg(F.min("started_at").alias("lo"), F.max("started_at").alias("hi"))
    ends = F.unix_timestamp("started_at") + F.col("duration_ms") / 1000
    y = log.join(F.broadcast(x)).agg(  # one row
        (F.max(F.unix_timestamp("hi")) - F.max(F.unix_timestamp("lo"))).alias("uptime_s"),
        F.count_if(ends <= F.unix_timestamp("hi")).alias("completed"),
        F.count_if(ends > F.unix_timestamp("hi")).alias("inflight"),
        F.count_if(F.col("reason").isin("sanitized_path_too_long", "reencryption_failed")).alias("write_failures"),
    )
    return y


def inflight_timeline(log: DataFrame) -> DataFrame:
    """``at_ms, day, change, running, reserved``: scans under way and bytes they hold at each start and end (ends first on ties).

    Three levels: totals of days are summed over the few days, those of minutes within their day, and rows within
    their minute, so a busy day is spread over its minutes.
    """
    at = (F.unix_timestamp("started_at") * 1000 + F.date_format("started_at", "SSS").cast("long")).cast("long")
    base = log.select("event_id", at.alias("s"), (at + F.col("duration_ms")).alias("e"), (F.col("plaintext_size") * lookups.RESERVED_TIMES).alias("w"))
    starts = base.select("event_id", F.col("s").alias("at_ms"), F.lit(1).alias("change"), F.col("w").alias("bytes"))
    both = starts.unionByName(base.select("event_id", F.col("e").alias("at_ms"), F.lit(-1).alias("change"), (-F.col("w")).alias("bytes")))
    both = both.withColumns({"day": F.floor(F.col("at_ms") / 86_400_000), "minute": F.floor(F.col("at_ms") / 60_000)})
    sums = lambda rows, *by: rows.groupBy(*by).agg(F.sum("change").alias("change"), F.sum("bytes").alias("bytes"))
    before = lambda c, w: F.coalesce(F.sum(c).over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    minutes = sums(both, "day", "minute")
    w = W.orderBy("day")
    days = sums(minutes, "day").select("day", before("change", w).alias("n0"), before("bytes", w).alias("b0"))
    w = W.partitionBy("day").orderBy("minute")
    minutes = minutes.select("day", "minute", before("change", w).alias("n1"), before("bytes", w).alias("b1"))
    w = W.partitionBy("day", "minute").orderBy("at_ms", "change", "event_id").rowsBetween(W.unboundedPreceding, W.currentRow)
    x = both.withColumns({"rn": F.sum("change").over(w), "rb": F.sum("bytes").over(w)}).join(minutes, ["day", "minute"]).join(days, "day")
    total = lambda *c: sum((F.col(k) for k in c[1:]), F.col(c[0]))
    return x.select("event_id", "at_ms", "day", "change", total("rn", "n1", "n0").alias("running"), total("rb", "b1", "b0").alias("reserved"))


def peak_load(timeline: DataFrame, budget: int = lookups.LOAD_BUDGET) -> DataFrame:
    """``day, peak_running, peak_bytes, over_budget``."""
    return timeline.groupBy("day").agg(F.max("running").alias("peak_running"), F.max("reserved").alias("peak_bytes"), (F.max("reserved") > budget).alias("over_budget"))


def budget_replay(requests: DataFrame, budget: int = lookups.LOAD_BUDGET) -> DataFrame:
    """``host, request_id, admitted``: what a budget per host would have shed, of ``requests(host, request_id, start_ms, end_ms, bytes)``.

    A request that is shed holds nothing. Rows stream in order of start; a host keeps a heap of what is under way.
    """
    key = requests.schema["request_id"].dataType.simpleString()

    def replay(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        host, held, ends = None, 0, []
        for b in batches:
            out = []
            for h, start, end, size in zip(*(b.column(c).to_pylist() for c in ("host", "start_ms", "end_ms", "bytes")), strict=True):
                if h != host:
                    host, held, ends = h, 0, []
                while ends and ends[0][0] <= start:
                    held -= heapq.heappop(ends)[1]
                fits = held + size <= budget
                if fits:
                    held += size
                    heapq.heappush(ends, (end, size))
                out.append(fits)
            yield pa.RecordBatch.from_arrays([b.column("host"), b.column("request_id"), pa.array(out, pa.bool_())], ["host", "request_id", "admitted"])

    rows = requests.select("host", "request_id", "start_ms", "end_ms", "bytes").repartition("host").sortWithinPartitions("host", "start_ms", "request_id")
    return rows.mapInArrow(replay, f"host string, request_id {key}, admitted boolean")


def corpus_report(expected: DataFrame, results: DataFrame) -> DataFrame:
    """A row a fixture: ``file_id, verdict, mime, reason, ok, missing``; fixtures without a result are missing."""
    x = expected.select("file_id").join(results, "file_id", "left")
    return x.select("file_id", "verdict", "mime", "reason", F.coalesce(F.col("verdict").isin("clean", "sanitized"), F.lit(False)).alias("ok"), F.col("verdict").isNull().alias("missing"))
