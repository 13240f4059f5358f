"""Audit chains, deadlines, budgets and streams."""

import random

from pyspark.sql import functions as F

from quaysift.functions import checks as C
from quaysift.operators import audit as U
from quaysift.plans import q_log
from quaysift.plans.q_content import KEY
from quaysift.plans.views import table
from quaysift.streaming import streams as S


def test_deadline(spark):
    cases = [(None, 539_999, False), (None, 540_000, False), (None, 540_001, True), ("rejected", 540_001, False), ("clean", 540_001, True), ("sanitized", 540_001, True), ("error", 540_001, True)]
    df = spark.createDataFrame([(v, ms) for v, ms, _ in cases], "v string, ms long")
    assert [r[0] for r in df.select(U.past_deadline(F.col("v"), F.col("ms"))).collect()] == [p for _, _, p in cases]


def test_whole_order(spark):
    """Every stage alone and with all later ones, late or not, written or not."""
    names = [*U.BEFORE, *U.INSIDE]
    rejects = {"stream_virus", "disallowed", "mismatch", "av", "rules"}
    verdict = {n: "rejected" if n in rejects else "clean" if n in ("empty", "archive") else "sanitized" if n == "category" else "error" for n in names}
    rows = [(k, more, ms, out) for k in range(len(names) + 1) for more in (False, True) for ms in (540_000, 540_001) for out in (None, "reencryption_failed")]

    def want(k, more, ms, out):
        set_ = [n for j, n in enumerate(names) if j == k or (more and j > k)]
        first = set_[0] if set_ else None
        if first in U.BEFORE:
            return verdict[first], first
        v = (verdict[first], first) if first else ("clean", None)
        if v[0] != "rejected" and ms > 540_000:
            return "error", "scan_deadline_exceeded"
        return ("error", out) if out and v[0] == "sanitized" else v

    df = spark.createDataFrame(rows, "k int, more boolean, ms long, out string")
    stages = {n: U.stage((F.col("k") == j) | (F.col("more") & (F.col("k") < j)), verdict[n], n) for j, n in enumerate(names)}
    got = df.select("*", U.scan_verdict(dict(reversed(stages.items())), F.col("ms"), F.col("out")).alias("v")).collect()
    assert [tuple(r["v"]) for r in got] == [want(*r[:4]) for r in got]


def test_stream_rules(spark, sf):
    """With rules, the stream's verdicts know each of them."""
    from quaysift import lookups
    from quaysift.operators import admission as A
    from quaysift.operators import matching as M
    from quaysift.plans.q_admission import detected
    from quaysift.plans.views import aliases, registry

    reg, files = registry(spark), detected(spark, sf)
    got = S.scan_stream(files, A.mime_to_exts(reg, aliases(spark)), A.prefix_to_exts(reg), A.scan_class_exts(reg), lookups.RULES)
    bare = S.scan_stream(files, A.mime_to_exts(reg, aliases(spark)), A.prefix_to_exts(reg), A.scan_class_exts(reg))
    hit = M.first_match(M.match_rules(files, lookups.RULES))
    want = bare.filter("verdict = 'clean' AND reason IS NULL").join(hit, "file_id").count()
    assert want > 0 and got.filter("verdict = 'rejected' AND reason = 'yara_match'").count() == want


def test_chain_tampering(spark, sf):
    chain = U.build_chain(U.audit_rows(table(spark, sf, "v_scan_log")), KEY)
    assert U.first_breaks(chain, KEY).filter("first_break IS NOT NULL").count() == 0
    gone = chain.filter("seq <> 1")
    assert U.first_breaks(gone, KEY).filter("first_break = 2").count() > 0
    assert U.first_breaks(chain, b"another key").filter("first_break = 0").count() > 0


def test_budget(spark):
    random.seed(3)
    rows = [("h0", i, i * 4, i * 4 + random.randint(1, 200), 5 << 30) for i in range(200)] + [("h1", i, i, i + 1, 8 << 20) for i in range(500)]
    got = {(r["host"], r["request_id"]): r["admitted"] for r in U.budget_replay(spark.createDataFrame(rows, "host string, request_id long, start_ms long, end_ms long, bytes long")).collect()}
    assert all(v for (h, _), v in got.items() if h == "h1") and not all(v for (h, _), v in got.items() if h == "h0")
    held = [(s, e, b) for h, i, s, e, b in rows if got[h, i] and h == "h0"]
    assert max(sum(b for s, e, b in held if s <= t < e) for t, _, _ in held) <= 16 << 30


def test_budget_stream(spark, sf, tmp_path):
    req = q_log.load_requests(spark, sf)
    req.coalesce(1).write.parquet(f"{tmp_path}/in")
    live = S.budget_stream(spark.readStream.schema(req.schema).parquet(f"{tmp_path}/in"))
    S.write_stream(live, f"{tmp_path}/out", f"{tmp_path}/cp").awaitTermination()
    want = {tuple(r) for r in U.budget_replay(req).collect()}
    assert {tuple(r) for r in spark.read.parquet(f"{tmp_path}/out").collect()} == want


def test_audit_stream(spark, sf, tmp_path):
    """Two micro-batches go on with each other's chains."""
    rows = U.audit_rows(table(spark, sf, "v_scan_log")).drop("seq")
    half = F.expr("substring(ts, 12, 2) < '12'")
    for k, part in enumerate((half, ~half)):
        rows.filter(part).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        live = S.audit_stream(spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in"), KEY)
        S.write_stream(live, f"{tmp_path}/out", f"{tmp_path}/cp").awaitTermination()
    out = spark.read.parquet(f"{tmp_path}/out")
    assert out.count() == rows.count()
    assert U.first_breaks(out, KEY).filter("first_break IS NOT NULL").count() == 0


def test_streams_in_small_chunks(spark, sf, tmp_path):
    """Chunks of a key that are smaller than its rows don't change the order."""
    setting = "spark.sql.execution.arrow.maxRecordsPerBatch"
    req, rows = q_log.load_requests(spark, sf), U.audit_rows(table(spark, sf, "v_scan_log")).drop("seq")
    req.coalesce(1).sortWithinPartitions(F.desc("start_ms")).write.parquet(f"{tmp_path}/req")
    rows.coalesce(1).sortWithinPartitions(F.desc("ts")).write.parquet(f"{tmp_path}/rows")
    before = spark.conf.get(setting)
    spark.conf.set(setting, "3")
    try:
        S.write_stream(S.budget_stream(spark.readStream.schema(req.schema).parquet(f"{tmp_path}/req")), f"{tmp_path}/b", f"{tmp_path}/cb").awaitTermination()
        S.write_stream(S.audit_stream(spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/rows"), KEY), f"{tmp_path}/a", f"{tmp_path}/ca").awaitTermination()
    finally:
        spark.conf.set(setting, before)
    assert {tuple(r) for r in spark.read.parquet(f"{tmp_path}/b").collect()} == {tuple(r) for r in U.budget_replay(req).collect()}
    numbered = rows.withColumn("seq", F.expr("row_number() OVER (PARTITION BY log_date ORDER BY ts, plaintext_sha256) - 1").cast("long"))
    columns = ["log_date", "seq", "prev", "sig"]
    want = {tuple(r) for r in U.build_chain(numbered, KEY).select(columns).collect()}
    assert {tuple(r) for r in spark.read.parquet(f"{tmp_path}/a").select(columns).collect()} == want


def test_sorted_runs():
    import pandas as pd

    r = random.Random(5)
    rows = [{"a": r.randrange(9), "b": i} for i in range(2500)]
    r.shuffle(rows)
    chunks = [pd.DataFrame(rows[i : i + 70]) for i in range(0, len(rows), 70)]
    for run in (1, 500, 10_000):
        assert list(S.in_order(iter(chunks), ["a", "b"], run)) == sorted(rows, key=lambda x: (x["a"], x["b"]))
    assert list(S.in_order(iter([]), ["a", "b"])) == []


def test_hmac(spark):
    import hashlib
    import hmac

    for key in (b"k", b"0123456789abcdef", bytes(64), b"x" * 100):
        want = hmac.new(key, b"message", hashlib.sha256).hexdigest()
        assert spark.range(1).select(C.hmac_sha256(F.lit("message"), key)).first()[0] == want
        if len(key) <= 64:
            assert spark.range(1).select(C.hmac_by_row(F.lit("message"), F.lit(key))).first()[0] == want


def test_sources(spark, tmp_path):
    from quaysift.sources import files as Q

    (tmp_path / "f").mkdir()
    (tmp_path / "f/a.bin").write_bytes(b"abc")
    (tmp_path / "f/b.bin").write_bytes(b"abcdef")
    got = {r["path"].rsplit("/", 1)[1]: (r["content"], r["reason"]) for r in Q.read_files(spark, str(tmp_path / "f"), max_bytes=4).collect()}
    assert got == {"a.bin": (b"abc", None), "b.bin": (None, "content_too_large_for_row")}
    (tmp_path / "req.json").write_text('{"op":"scan","user_id":3}\nbroken{\n')
    rows = Q.read_requests(spark, str(tmp_path / "req.json")).collect()
    assert [r["user_id"] for r in rows] == [3, None] and rows[1]["_corrupt_record"] == "broken{"
    (tmp_path / "reg.json").write_text('{"extensions": {"txt": {"type": "text", "mime": "text/plain"}, "zip": {"type": "archive", "mime": "application/zip", "scan": ["archive"], "zipBased": true}}}')
    assert {r["ext"]: (r["scan"], r["zip_based"]) for r in Q.read_type_registry(spark, str(tmp_path / "reg.json")).collect()} == {"txt": ([], False), "zip": (["archive"], True)}
    (tmp_path / "rules").mkdir()
    (tmp_path / "rules/a.YAR").write_text("literal\tone\tabc\nregex\tbad\t([\n")
    (tmp_path / "rules/.hidden.yar").write_text("literal\tno\tx\n")
    assert Q.read_rules(spark, str(tmp_path / "rules")) == ([(0, "one", "literal", "abc")], 1)
    Q.write_results(spark.createDataFrame([("clean", None), ("error", "x")], "verdict string, reason string"), str(tmp_path / "res"))
    assert sorted(r[0] for r in spark.read.text(str(tmp_path / "res")).collect()) == ['{"verdict":"clean"}', '{"verdict":"error","reason":"x"}']
    Q.write_audit(spark.createDataFrame([("2024-01-01", 1), ("2024-01-01", 0)], "log_date string, seq long"), str(tmp_path / "audit"))
    assert [r["seq"] for r in spark.read.json(str(tmp_path / "audit")).orderBy("seq").collect()] == [0, 1]


def test_early_failures_count_nowhere(spark):
    """Every reason for which a scan ends without a result: neither completed nor errored, and its time isn't summed."""
    from quaysift import lookups

    reasons = [*lookups.EARLY_REASONS, "scanner_busy", "unsupported_image_format", None]
    log = spark.createDataFrame([("error", r, 5) for r in reasons], "verdict string, reason string, duration_ms long")
    log = log.withColumns({"av_unavailable": F.lit(False), "yara_unavailable": F.lit(False)})
    got = U.scan_metrics(log).first()
    assert (got["completed"], got["errored"], got["total_ms"], got["busy"]) == (2, 2, 10, 1)
