"""Two outputs once each, days that end, digest lists of any size, and tails from the ends of logs."""

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from quaysift import lookups
from quaysift.operators import audit as U
from quaysift.operators import matching as M
from quaysift.plans.q_content import KEY
from quaysift.sources import files as Q
from quaysift.streaming import streams as S

SCANS = "file_id long, verdict string, reason string, category string, started_at timestamp, user_id long, duration_ms long, plaintext_sha256 string"


def scans(spark, ids):
    rows = spark.createDataFrame([(i,) for i in ids], "file_id long")
    i = F.col("file_id")
    return rows.select(
        "file_id", F.when(i % 3 == 0, "rejected").otherwise("clean").alias("verdict"), F.when(i % 3 == 0, "yara_match").alias("reason"), F.lit("TEXT").alias("category"), F.timestamp_seconds(1_700_000_000 + i * 20_000).alias("started_at"),
        (i % 5).alias("user_id"), i.alias("duration_ms"), F.sha2(i.cast("string"), 256).alias("plaintext_sha256"),
    )


def run(spark, tmp_path):
    stream = spark.readStream.schema(SCANS).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    S.write_scans(stream, f"{tmp_path}/out", f"{tmp_path}/cp", KEY).awaitTermination()


@pytest.mark.parametrize("broken", ["build_chain", "tails", "none"])
def test_replayed_batch(spark, tmp_path, monkeypatch, broken):
    """A batch that fails between its writes is written once when it is replayed, and the chain goes on over all batches."""
    for part in (range(0, 10), range(10, 25), range(25, 30)):
        scans(spark, part).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    if broken != "none":
        calls, keep, keep_build = [], S.ScanSink.tails, U.build_chain

        def fails(*a, **k):
            calls.append(1)
            if len(calls) == 2:
                raise RuntimeError("lost")
            return (keep_build if broken == "build_chain" else keep)(*a, **k)

        if broken == "build_chain":
            monkeypatch.setattr(U, "build_chain", fails)
        else:
            monkeypatch.setattr(S.ScanSink, "tails", fails)
        with pytest.raises(Exception, match="lost"):
            run(spark, tmp_path)
        sink = S.ScanSink(f"{tmp_path}/out", KEY)
        assert sink.written(spark, "results").count() == sink.written(spark, "audit").count() in (5, 10, 15)
    run(spark, tmp_path)
    sink = S.ScanSink(f"{tmp_path}/out", KEY)
    got, audit = sink.written(spark, "results"), sink.written(spark, "audit")
    assert sorted(tuple(r) for r in got.select("file_id", "verdict", "reason").collect()) == sorted(tuple(r) for r in scans(spark, range(30)).select("file_id", "verdict", "reason").collect())
    assert audit.count() == 30 and audit.select("log_date", "seq").distinct().count() == 30
    assert U.first_breaks(audit.drop("batch_id"), KEY).filter("first_break IS NOT NULL").count() == 0


def audit_fields(spark, days):
    rows = [(1, d, hashlib.sha256(f"{d}{k}".encode()).hexdigest(), "", f"{d}T{h:02d}:00:00+00:00", 1, "clean") for d, hours in days for k, h in enumerate(hours)]
    return spark.createDataFrame(rows, "duration_ms long, log_date string, plaintext_sha256 string, reason string, ts string, user_id long, verdict string")


def test_days_end(spark, tmp_path):
    """State of days behind the watermark goes, rows within the bound join their day's chain, and later ones are dropped."""
    rows = audit_fields(spark, [])
    parts = [[("2024-01-01", [1, 2]), ("2024-01-02", [20])], [("2024-01-02", [3]), ("2024-01-04", [1])], [("2024-01-01", [5]), ("2024-01-04", [2])], [("2024-01-09", [0])]]
    left = []
    for k, days in enumerate(parts):
        audit_fields(spark, days).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        live = S.audit_stream(spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in"), KEY, late="1 day")
        S.write_stream(live, f"{tmp_path}/out", f"{tmp_path}/cp").awaitTermination()
        state = spark.read.format("statestore").option("path", f"{tmp_path}/cp").option("stateVarName", "tail").load()
        left.append({r[0] for r in state.select("key.log_date").collect()})
    out = spark.read.parquet(f"{tmp_path}/out")
    count = {r["log_date"]: r["n"] for r in out.groupBy("log_date").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert count == {"2024-01-01": 2, "2024-01-02": 2, "2024-01-04": 2, "2024-01-09": 1}
    assert U.first_breaks(out, KEY).filter("first_break IS NOT NULL").count() == 0
    assert "2024-01-02" in left[0] and "2024-01-01" not in left[2] and left[3] == {"2024-01-09"}


def test_seeded_from_a_written_log(spark, tmp_path):
    """A stream goes on with the chain of a log on disk, whose tails come from the ends of its files."""
    first = audit_fields(spark, [("2024-01-01", [1, 2, 3]), ("2024-01-02", [4])]).withColumn("seq", F.expr("row_number() OVER (PARTITION BY log_date ORDER BY ts) - 1").cast("long"))
    Q.write_audit(U.build_chain(first, KEY), f"{tmp_path}/log")
    audit_fields(spark, [("2024-01-02", [5, 6]), ("2024-01-03", [7])]).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(first.drop("seq").schema).parquet(f"{tmp_path}/in")
    live = S.audit_stream(stream, KEY, U.log_tails(spark, f"{tmp_path}/log"))
    S.write_stream(live, f"{tmp_path}/out", f"{tmp_path}/cp").awaitTermination()
    both = spark.read.schema(S.AUDIT_OUT).json(f"{tmp_path}/log").withColumn("log_date", F.col("log_date").cast("string")).unionByName(spark.read.parquet(f"{tmp_path}/out"))
    assert both.count() == 7 and U.first_breaks(both, KEY).filter("first_break IS NOT NULL").count() == 0


def test_log_tails(spark, tmp_path):
    """Of a day in two files, of torn and broken last lines, of a long day of which the end alone is read."""
    line = lambda n: json.dumps({"seq": n, "note": "é" * 20, "sig": hashlib.sha256(str(n).encode()).hexdigest()}, ensure_ascii=False)
    days = {
        "2024-01-01": ["".join(line(n) + "\n" for n in range(3000))], "2024-01-02": ["".join(line(n) + "\n" for n in range(4, 9)), "".join(line(n) + "\n" for n in range(4))], "2024-01-03": [line(0) + "\n" + line(1)],
        "2024-01-04": [line(0) + "\n{broken\n"], "2024-01-05": [""], "2024-01-06": ["torn"],
    }
    for day, parts in days.items():
        at = tmp_path / f"log_date={day}"
        at.mkdir()
        for k, text in enumerate(parts):
            (at / f"part-{k}.json").write_text(text, encoding="utf-8")
    sig = lambda n: hashlib.sha256(str(n).encode()).hexdigest()
    want = {"2024-01-01": (3000, sig(2999)), "2024-01-02": (9, sig(8)), "2024-01-03": (1, sig(0)), "2024-01-04": (0, U.GENESIS), "2024-01-05": (0, U.GENESIS), "2024-01-06": (0, U.GENESIS)}
    assert {r["log_date"]: (r["seq"], r["sig"]) for r in U.log_tails(spark, str(tmp_path), tail=400).collect()} == want
    from quaysift.sources.chunks import planned

    assert sum((p.last - p.first) * 400 for part in planned([("a", 10**12)], 400, 400, 1 << 62, last=2) for p in part) == 800


def test_runs_merge_in_levels(monkeypatch):
    import random

    import pandas as pd

    r, opened, most = random.Random(3), [], [0]
    keep = S.tempfile.TemporaryFile

    def watched(*a, **k):
        f = keep(*a, **k)
        opened.append(f)
        most[0] = max(most[0], sum(not x.closed for x in opened))
        return f

    monkeypatch.setattr(S.tempfile, "TemporaryFile", watched)
    rows = [{"a": r.randrange(50), "b": i} for i in range(3000)]
    got = list(S.in_order(iter([pd.DataFrame(rows[i : i + 7]) for i in range(0, 3000, 7)]), ["a", "b"], run=10, fan=4))
    assert got == sorted(rows, key=lambda x: (x["a"], x["b"])) and len(opened) > 200 and most[0] < 25


@pytest.mark.parametrize("few", [0, 10_000])
def test_digest_hits(spark, few):
    """The same rows through the filter and by broadcast; no row that can't match is shuffled, and no content at all."""
    files = spark.range(0, 4000, 1, 4).select(F.col("id").alias("file_id"), F.when(F.col("id") % 50 == 7, None).otherwise((F.col("id") % 3000).cast("string")).alias("content"), F.lit(1).alias("digest"))
    listed = spark.range(0, 6000, 5).select(F.upper(F.sha2(F.col("id").cast("string"), 256)).alias("digest"), F.concat(F.lit("s"), F.col("id").cast("string")).alias("signature"))
    listed = listed.union(listed.limit(5)).union(spark.createDataFrame([(None, "none")], listed.schema))
    df = M.digest_hits(files, listed, few=few)
    got = {r["file_id"]: r["signature"] for r in df.collect()}
    assert len(got) == 4000 and got == {i: f"s{i % 3000}" if i % 50 != 7 and i % 3000 % 5 == 0 else None for i in range(4000)}
    assert M.digest_hits(files, listed.limit(0), few=few).filter("signature IS NOT NULL").count() == 0 and M.digest_hits(files.limit(0), listed, few=few).count() == 0
    if not few:
        bits = 1 << (1200 * M.BITS_EACH - 1).bit_length()
        assert M.digest_filter(listed.filter("digest IS NOT NULL").select(F.lower("digest").alias("digest")), bits).count() <= bits // M._BUCKET + 1
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        joined = [x for x in plan.splitlines() if "Join" in x]
        assert any("strategy=broadcast" in x for x in joined) and any("shuffle_hash" in x for x in joined)


def test_lookups_name_all_rules():
    assert len({r[0] for r in lookups.RULES}) == len(lookups.RULES)
