"""Structured Streaming twins of the batch operators: verdicts, counters, the audit chain and the load budget."""

from __future__ import annotations

import heapq
import hmac
import pickle
import tempfile
from collections.abc import Iterator
from datetime import datetime, timedelta, timezone
from itertools import islice
from operator import itemgetter

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.query import StreamingQuery

from .. import lookups
from ..operators import admission as A
from ..operators import audit as U
from ..operators import matching as M


def scan_stream(files: DataFrame, exact: DataFrame, prefix: DataFrame, classes: DataFrame, rules: list[M.Rule] | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """``file_id, verdict, reason, category`` of a stream of ``files(file_id, ext, mime, content)``: stateless, with broadcast lookups and, if given, rules. Columns to ``keep`` come along."""
    x = A.categorize(A.admit(files, exact, prefix, classes), classes)
    refused = A.admission_verdict()[1]
    stages = {
        "empty": U.stage(F.octet_length("content") == 0, "clean", "empty_file"),
        "disallowed": U.stage(refused == "disallowed_mime_type", "rejected", refused),
        "mismatch": U.stage(refused == "mime_extension_mismatch", "rejected", refused),
        "rules": U.stage(M.first_rule(F.col("content"), rules or []).isNotNull(), "rejected", "yara_match"),
    }
    return x.select("file_id", U.scan_verdict(stages).alias("v"), "category", *keep).select("file_id", "v.*", "category", *keep)


def write_stream(df: DataFrame, path: str, checkpoint: str, mode: str = "append", once: bool = True) -> StreamingQuery:
    """Starts writing a stream as Parquet; ``once`` drains what there is and stops. Both folders must be shared."""
    writer = df.writeStream.outputMode(mode).format("parquet").option("path", path).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


class ScanSink:
    """Writes each micro-batch of verdicts twice, as results and as a signed audit log, and each of them once.

    A batch has a folder of its own by its number in either output, which a replay replaces. Last come the tails of the days' chains after the batch: they are
    what the next batch goes on from, and the mark that the batch is whole. A batch that failed in between is written again from the tails before it, with
    the same signatures. Rows are ``file_id, verdict, reason, category, started_at, user_id, duration_ms, plaintext_sha256``.
    """

    def __init__(self, path: str, key: bytes) -> None:
        self.path, self.key = path.rstrip("/"), key

    def folder(self, what: str, batch_id: int) -> str:
        return f"{self.path}/{what}/batch_id={batch_id}"

    def tails(self, spark: SparkSession, batch_id: int) -> dict[str, tuple[int, str]]:
        """Number and signature that each day goes on with: a row a day."""
        if batch_id < 0:
            return {}
        rows = spark.read.schema("log_date string, seq long, sig string").parquet(self.folder("tails", batch_id))
        return {r["log_date"]: (r["seq"], r["sig"]) for r in rows.collect()}

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        batch = batch.persist()
        try:
            batch.select("file_id", "verdict", "reason", "category").write.mode("overwrite").parquet(self.folder("results", batch_id))
            before = self.tails(spark, batch_id - 1)
            U.build_chain(_audited(batch), self.key, before).write.mode("overwrite").parquet(self.folder("audit", batch_id))
            now = spark.read.parquet(self.folder("audit", batch_id)).groupBy("log_date").agg((F.max("seq") + 1).alias("seq"), F.max_by("sig", "seq").alias("sig"))
            after = before | {r["log_date"]: (r["seq"], r["sig"]) for r in now.collect()}
            spark.createDataFrame([(d, *x) for d, x in after.items()], "log_date string, seq long, sig string").coalesce(1).write.mode("overwrite").parquet(self.folder("tails", batch_id))
        finally:
            batch.unpersist()

    def written(self, spark: SparkSession, what: str) -> DataFrame:
        """``results`` or ``audit`` rows of the batches that are whole."""
        whole = spark.read.parquet(f"{self.path}/tails").select("batch_id").distinct()
        return spark.read.parquet(f"{self.path}/{what}").join(F.broadcast(whole), "batch_id", "left_semi")


def _audited(scans: DataFrame) -> DataFrame:
    """Scans as audit fields, numbered from 0 within each day of the batch."""
    day = scans.withColumn("log_date", F.date_format("started_at", "yyyy-MM-dd"))
    seq = F.row_number().over(Window.partitionBy("log_date").orderBy("started_at", "plaintext_sha256", "file_id")) - 1
    return day.select(
        F.coalesce("duration_ms", F.lit(0)).cast("long").alias("duration_ms"), "log_date", F.coalesce("plaintext_sha256", F.lit("")).alias("plaintext_sha256"), F.coalesce("reason", F.lit("")).alias("reason"),
        seq.cast("long").alias("seq"), F.date_format("started_at", "yyyy-MM-dd'T'HH:mm:ss'+00:00'").alias("ts"), F.coalesce("user_id", F.lit(0)).cast("long").alias("user_id"), "verdict",
    )


def write_scans(scans: DataFrame, path: str, checkpoint: str, key: bytes, once: bool = True) -> StreamingQuery:
    """Starts writing a stream of verdicts as results and audit (see ``ScanSink``). All folders must be shared."""
    writer = scans.writeStream.foreachBatch(ScanSink(path, key)).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def metrics_stream(log: DataFrame, late: str = "1 hour") -> DataFrame:
    """The counters by day of ``started_at``, final once the watermark passes; rows later than ``late`` are dropped."""
    timed = log.withColumn("started_at", F.col("started_at").cast("timestamp")).withWatermark("started_at", late)
    days = timed.groupBy(F.window("started_at", "1 day").alias("w")).agg(*U._counters())
    return days.select(F.col("w.start").alias("day"), *(c for c in days.columns if c != "w"))


def running_metrics(log: DataFrame) -> DataFrame:
    """The counters since the start, for the update or complete mode."""
    return U.scan_metrics(log)


#: Rows of a key that are sorted in memory, rows of an output chunk, and sorted runs that are merged into one.
RUN, OUT, FAN = 100_000, 10_000, 16


def in_order(rows: Iterator[pd.DataFrame], by: list[str], run: int = RUN, fan: int = FAN) -> Iterator[dict]:
    """All rows of a key's chunks in the order of ``by``, whatever the chunks' size: sorted runs in a file each, merged.

    As soon as ``fan`` runs of a level are there they become one of the next, so that few files are open at any number of rows.
    """

    def kept(records: Iterator[dict]):
        at = tempfile.TemporaryFile()
        while part := list(islice(records, 1000)):
            pickle.dump(part, at)
        at.seek(0)
        return at

    def read(at) -> Iterator[dict]:
        with at:
            while True:
                try:
                    part = pickle.load(at)
                except EOFError:
                    return
                yield from part

    order = itemgetter(*by)
    levels: list[list] = []

    def put(file, level: int) -> None:
        if level == len(levels):
            levels.append([])
        levels[level].append(file)
        if len(levels[level]) == fan:
            runs, levels[level] = levels[level], []
            put(kept(heapq.merge(*map(read, runs), key=order)), level + 1)

    held, n = [], 0
    for pdf in rows:
        held.append(pdf)
        n += len(pdf)
        if n >= run:
            put(kept(iter(pd.concat(held).sort_values(by).to_dict("records"))), 0)
            held, n = [], 0
    last = pd.concat(held).sort_values(by).to_dict("records") if held else []
    yield from heapq.merge(*(read(at) for level in levels for at in level), last, key=order)


AUDIT_OUT = "duration_ms long, log_date string, plaintext_sha256 string, prev string, reason string, seq long, ts string, user_id long, verdict string, sig string"


class AuditProcessor(StatefulProcessor):
    """Goes on with each day's chain over micro-batches; rows that come late join the chain of their own day.

    With event time a day's tail goes once the watermark has passed its end, when no row of it can come any more.
    """

    def __init__(self, key: bytes, ends: bool = False) -> None:
        self.key, self.ends = key, ends

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.tail = handle.getValueState("tail", "seq long, sig string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        seq, sig = self.tail.get() if self.tail.exists() else (0, U.GENESIS)
        ordered = in_order(rows, ["ts", "plaintext_sha256"])
        while part := list(islice(ordered, OUT)):
            out = []
            for r in part:
                r = {c: r[c] for c in U.CANONICAL if c not in ("prev", "seq")} | {"log_date": key[0], "seq": int(seq), "prev": sig}
                r["duration_ms"], r["user_id"] = int(r["duration_ms"]), int(r["user_id"])
                r["sig"] = sig = hmac.digest(self.key, U.canonical_text(r).encode(), "sha256").hex()
                seq += 1
                out.append(r)
            yield pd.DataFrame(out, columns=[*U.CANONICAL, "sig"])
        self.tail.update((int(seq), sig))
        self.close_after(key[0])

    def close_after(self, day: str) -> None:
        if self.ends and not any(True for _ in self.handle.listTimers()):
            end = datetime.fromisoformat(day).replace(tzinfo=timezone.utc) + timedelta(days=1)
            self.handle.registerTimer(int(end.timestamp() * 1000))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.tail.clear()
        return iter([])

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        self.tail.update((int(initialState["seq"].iloc[0]), str(initialState["sig"].iloc[0])))
        self.close_after(key[0])

    def close(self) -> None:
        pass


def audit_stream(rows: DataFrame, key: bytes, tails: DataFrame | None = None, late: str | None = None) -> DataFrame:
    """The chain of a stream of audit fields; ``tails(log_date, seq, sig)`` seed it, as ``chain_tail`` finds them in a log. Needs the RocksDB state store.

    With ``late``, rows that are later than that behind the latest ``ts`` are dropped, and a day's state goes when its end is as far behind; without it, no row
    is too late and every day's tail (a row) stays.
    """
    if late:
        rows = rows.withColumn("_at", F.to_timestamp("ts")).withWatermark("_at", late)
    return rows.groupBy("log_date").transformWithStateInPandas(
        statefulProcessor=AuditProcessor(key, bool(late)), outputStructType=AUDIT_OUT, outputMode="Append", timeMode="EventTime" if late else "None", initialState=tails.groupBy("log_date") if tails is not None else None
    )


class BudgetProcessor(StatefulProcessor):
    """Holds what a host has under way and admits what still fits."""

    def __init__(self, budget: int) -> None:
        self.budget = budget

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.ends = handle.getValueState("ends", "ends array<long>, sizes array<long>")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        ends, sizes = self.ends.get() if self.ends.exists() else ([], [])
        heap = [(int(e), int(s)) for e, s in zip(ends, sizes, strict=True)]
        heapq.heapify(heap)
        held = sum(s for _, s in heap)
        ordered = in_order(rows, ["start_ms", "request_id"])
        while part := list(islice(ordered, OUT)):
            out = []
            for r in part:
                while heap and heap[0][0] <= r["start_ms"]:
                    held -= heapq.heappop(heap)[1]
                fits = held + r["bytes"] <= self.budget
                if fits:
                    held += int(r["bytes"])
                    heapq.heappush(heap, (int(r["end_ms"]), int(r["bytes"])))
                out.append((key[0], r["request_id"], fits))
            yield pd.DataFrame(out, columns=["host", "request_id", "admitted"])
        self.ends.update(([e for e, _ in heap], [s for _, s in heap]))

    def close(self) -> None:
        pass


def budget_stream(requests: DataFrame, budget: int = lookups.LOAD_BUDGET) -> DataFrame:
    """``host, request_id, admitted`` of a stream of requests in the order of their starts. Needs the RocksDB state store."""
    return requests.groupBy("host").transformWithStateInPandas(
        statefulProcessor=BudgetProcessor(budget), outputStructType="host string, request_id long, admitted boolean", outputMode="Append", timeMode="None"
    )


ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
