"""Files as chunk rows: the byte-range source, digests in constant memory, and walks that take a file chunk by chunk."""

import hashlib
import io
import random
import struct
import tarfile

import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from test_walkers import gif, png, webp

from quaysift.operators import integrity as I
from quaysift.operators import walkers as X
from quaysift.plans import q_bytes
from quaysift.sources import chunks as K


def tarred(*entries):
    out = io.BytesIO()
    with tarfile.open(fileobj=out, mode="w", format=tarfile.USTAR_FORMAT) as t:
        for name, data in entries:
            info = tarfile.TarInfo(name)
            info.size = len(data)
            t.addfile(info, io.BytesIO(data))
    return out.getvalue()


control = lambda n: ("acTL", struct.pack(">II", n, 0))
BODIES = {
    "tar": [tarred(("a", b"x" * 700), ("b/" + "c" * 90, b""), ("d", b"y" * 512))[:4096], tarred(("a", b"z" * 300))[:900], b"", b"short"],
    "png": [png(control(4), ("IDAT", b"x" * 9), tail=b"more"), png(control(1), ("IDAT", b""))[:-3], b"\x89PNG\r\n\x1a\n", b"no"],
    "webp": [webp(("ANIM", b"123456"), ("ANMF", b"1"), ("ANMF", b"22"), tail=b"j"), webp(("VP8 ", b"x"))[:-1], b"RIFF1234WEBP"],
    "gif": [gif(3, tail=b";x"), gif(2)[:-4], gif(1, loop=False), q_bytes._gif(2, bytes(range(256)) * 2), b"GIF89a" + b"\0\0\0\0\xf7\0\0" + b"\1" * 768 + b";", b"GIF89a" + b"\0\0\0\0\xf7\0\0" + b"\1" * 700],
}


@pytest.mark.parametrize("kind", sorted(BODIES))
def test_walks_at_every_cut(kind):
    """The same rows wherever a file is cut in two, and at chunks of 1, 7 and 100 bytes."""
    walk = X._WALKS[kind][0]
    for body in BODIES[kind]:
        want = list(X.walked(walk, [body]))
        for cut in range(len(body) + 1):
            assert list(X.walked(walk, [body[:cut], body[cut:]])) == want
        for size in (1, 7, 100):
            assert list(X.walked(walk, [b"", *(body[i : i + size] for i in range(0, len(body), size))])) == want


def test_walks_hold_a_chunk_only():
    """A picture of 256 MB in chunks of 64 KB: the feed never holds more than a chunk."""
    size, most = 1 << 28, 0
    feed = X.Feed()
    rows = X.png_walk(feed)
    head = b"\x89PNG\r\n\x1a\n" + struct.pack(">I", size) + b"IDAT"
    got = []
    for chunk in [head, *([bytes(1 << 16)] * (size >> 16)), bytes(4) + struct.pack(">I", 0) + b"IEND" + bytes(4)]:
        feed.put(chunk)
        for row in rows:
            if row is None:
                break
            got.append(row)
        most = max(most, len(feed.view))
    assert [(r[1], r[2]) for r in got] == [("IDAT", size), ("IEND", 0)] and most <= 1 << 16


@pytest.mark.parametrize("kind", sorted(BODIES))
@pytest.mark.parametrize("batch", [3, 10_000])
def test_walk_chunks(spark, kind, batch):
    """Rows of many files in small batches, dealt at random, equal those of whole contents."""
    r = random.Random(batch)
    files = [(i, bytearray(b)) for i, b in enumerate(BODIES[kind] * 3)]
    chunks = [(i, k, bytearray(b[k * 20 : k * 20 + 20])) for i, b in files for k in range(max(1, -(-len(b) // 20)))] + [(99, 0, None)]
    r.shuffle(chunks)
    whole = spark.createDataFrame(files, "file_id long, content binary")
    want = X.tar_entries(whole) if kind == "tar" else X.image_chunks(whole, kind)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        got = X.walk_chunks(spark.createDataFrame(chunks, "file_id long, chunk_idx int, chunk binary").repartition(3), kind)
        assert got.columns == want.columns
        assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert X.walk_chunks(spark.createDataFrame([], "file_id long, chunk_idx int, chunk binary"), kind).count() == 0


def test_content_in_small_batches(spark, sf):
    """What a walk is handed is bounded in bytes and rows however many files there are, and what it yields goes out by the thousand."""
    files = q_bytes.wrapped(spark, sf, lambda i, body: bytes(200_000))

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_pydict({"rows": [b.num_rows], "bytes": [b.nbytes]})

    got = X.small_batches(files).mapInArrow(sizes, "rows long, bytes long").collect()
    assert sum(r["rows"] for r in got) == files.count() >= 100
    assert max(r["bytes"] for r in got) <= X.BATCH_BYTES + 300_000 and max(r["rows"] for r in got) <= X.BATCH_ROWS
    many = X.explode_bytes(files.limit(3), lambda body: ((k,) for k in range(2_500)), "k int")
    assert max(r["rows"] for r in many.mapInArrow(sizes, "rows long, bytes long").collect()) <= X.OUT_ROWS and many.distinct().count() == 7_500


def test_digests_across_batches(spark):
    """A file of more chunks than a batch; gaps, repeats, a null chunk, a wrong order, an empty file, a count and a digest that don't fit."""
    body = random.Random(1).randbytes(25_000)
    cut = lambda b, n=2: [(k, b[k * n : k * n + n]) for k in range(max(1, -(-len(b) // n)))]
    files = {"long": cut(body), "gap": cut(b"abcdef")[::2], "from_one": cut(b"abcdef")[1:], "twice": [*cut(b"abcd"), (1, b"cd")], "null": [(0, b"ab"), (1, None)], "turned": cut(b"abcdef")[::-1], "empty": [(0, b"")], "few": cut(b"abcd"), "wrong": cut(b"abcd")}
    rows = [(f, k, None if c is None else bytearray(c), 1) for f, cs in files.items() for k, c in cs]
    chunks = spark.createDataFrame(rows, "file_id string, chunk_idx int, chunk binary, size int").repartition(5)
    said = {"long": (len(cut(body)), body), "twice": (3, b"abcdcd"), "turned": (3, b"abcdef"), "empty": (1, b""), "few": (3, b"abcd"), "gap": (2, b"abef"), "from_one": (2, b"cdef"), "null": (2, b"ab"), "wrong": (2, b"abcx"), "absent": (1, b"")}
    declared = spark.createDataFrame([(f, n, hashlib.sha256(b).hexdigest()) for f, (n, b) in said.items()], "file_id string, chunks long, sha256 string")
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 1000)
    try:
        got = {r["file_id"]: r for r in I.chunk_digests(chunks).collect()}
        reasons = {r["file_id"]: r["reason"] for r in I.verify_chunks(chunks, declared).collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    good = {"long", "turned", "empty"}
    assert {f for f, r in got.items() if r["whole"]} == good | {"few", "wrong"} and {f for f, r in reasons.items() if r is None} == good and set(reasons) == set(said)
    assert got["long"]["sha256"] == hashlib.sha256(body).hexdigest() and got["long"]["size"] == 25_000 and got["gap"]["sha256"] is None
    framed = b"".join(struct.pack(">I", len(c)) + c for _, c in files["long"])
    assert got["long"]["frame_sha256"] == hashlib.sha256(framed).hexdigest()
    assert {(r["file_id"], bytes(r["content"])) for r in I.reassemble(chunks, declared).filter("reason IS NULL").collect()} == {("long", body), ("turned", b"abcdef"), ("empty", b"")}
    assert {r["file_id"] for r in I.verified_chunks(chunks, declared).collect()} == good


def test_files_by_many_tasks(spark, tmp_path):
    """A file a key, with lines in order, that several tasks wrote; also where one task copies all of a file's parts."""
    from quaysift.sources import files as Q

    lines = [("a:b" if i % 50 == 0 else "one", i, "" if i % 7 == 0 else f"line {i} ä") for i in range(4000)]
    df = spark.createDataFrame(lines, "k string, i long, value string").repartition(5)
    Q.write_keyed(df, f"{tmp_path}/f", "k", "i")
    want = {k: "".join(v + "\n" for x, _, v in lines if x == k).encode() for k in ("one", "a:b")}
    got = {p.parent.name: p.read_bytes() for p in (tmp_path / "f").glob("*/all.txt")}
    assert got == {"k=one": want["one"], "k=a%3Ab": want["a:b"]}
    parts = sorted((tmp_path / "f-parts" / "k=one").glob("part-*"))
    assert len(parts) >= 3 and max(p.stat().st_size for p in parts) < len(want["one"]) / 2
    job = Q._copied(str(tmp_path), [(f"{tmp_path}/g/all.txt", 0, [str(p) for p in parts])])
    assert sum(b.num_rows for b in job(iter([pa.RecordBatch.from_pydict({"id": [0]})]))) == 1
    assert (tmp_path / "g" / "all.txt").read_bytes() == want["one"]
    Q.write_keyed(df.limit(0), f"{tmp_path}/none", "k", "i")
    assert Q.read_files(spark, f"{tmp_path}/none", glob="*.txt").filter("length > 0").count() == 0


def test_plans_of_ranges():
    """Ranges cover all chunks once; large files are cut, small ones share; caps, empty files and bounds on numbers hold."""
    files = [("b", 105), ("a", 1000), ("c", 0), ("d", 20), ("e", 5000)]
    for low, high in ((0, None), (0, 1), (3, 7), (50, None)):
        parts = K.planned(files, 10, 200, 2000, low, high)
        seen = sorted((p.path, k) for part in parts for p in part for k in range(p.first, p.last))
        assert seen == sorted((f, k) for f, n in files if n <= 2000 for k in range(max(1, -(-n // 10))) if low <= k and (high is None or k < high))
        assert all(sum((p.last - p.first) * 10 for p in part) <= 200 for part in parts)
        assert [p.reason for part in parts for p in part if p.path == "e"] == ["file_too_large"]
    assert sum(any(p.path == "a" for p in part) for part in K.planned(files, 10, 200, 2000)) == 5


def test_whole_files_in_order(spark, tmp_path):
    """Digests of files far longer than a range, without a shuffle of their bytes; small files share a task."""
    bodies = {f"{i}.bin": random.Random(i).randbytes(n) for i, n in enumerate((200_003, 0, 5, 90_000, 1, 40_000))}
    for name, body in bodies.items():
        (tmp_path / name).write_bytes(body)
    rows = K.read_chunks(spark, str(tmp_path), chunk=7, range_bytes=50_000, whole=True)
    files = rows.select(F.regexp_extract("path", "[^/]*$", 0).alias("file_id"), "chunk_idx", "chunk")
    out = I.chunk_digests(files, in_order=True)
    got = {r["file_id"]: (r["sha256"], r["size"], r["whole"]) for r in out.collect()}
    assert got == {k: (hashlib.sha256(b).hexdigest(), len(b), True) for k, b in bodies.items()}
    assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()
    assert 3 <= rows.rdd.getNumPartitions() <= 4
    assert sorted(map(str, out.collect())) == sorted(map(str, I.chunk_digests(files).collect()))


def test_ranges_grow_with_the_input():
    """A hundred times the bytes in short ranges are not a hundred times the tasks, and no range grows beyond the usual length."""
    for length in (10**7, 10**9, 10**11):
        parts = K.planned([("a", length), ("b", length // 10)], 1000, 20_000, 1 << 40)
        sizes = [sum((p.last - p.first) * 1000 for p in part) for part in parts]
        assert sum(sizes) == length + length // 10 and max(sizes) <= max(20_000, K.RANGE)
        assert len(parts) <= max(K.MOST_RANGES, sum(sizes) // K.RANGE) + 2


def test_source(spark, tmp_path):
    bodies = {"a.bin": random.Random(2).randbytes(10_007), "b.bin": b"", "sub/c.bin": b"abc", "large.bin": bytes(30_000), ".hidden.bin": b"x", "_SUCCESS": b"", "other.txt": b"t"}
    for name, body in bodies.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(body)
    for root in (str(tmp_path), f"file:{tmp_path}", f"file://{tmp_path}"):
        df = K.read_chunks(spark, root, chunk=100, range_bytes=1000, max_bytes=20_000, glob="*.bin")
        rows = sorted(df.collect(), key=lambda r: (r["path"], r["chunk_idx"]))
        of = lambda name: [r for r in rows if r["path"].endswith("/" + name)]
        assert b"".join(r["chunk"] for r in of("a.bin")) == bodies["a.bin"] and [r["chunk_idx"] for r in of("a.bin")] == list(range(101)) and {r["file_length"] for r in of("a.bin")} == {10_007}
        assert [(r["offset"], r["chunk"]) for r in of("b.bin")] == [(0, b"")] and [r["chunk"] for r in of("c.bin")] == [b"abc"]
        assert [(r["chunk"], r["reason"], r["file_length"]) for r in of("large.bin")] == [(None, "file_too_large", 30_000)] and len(rows) == 104
        assert all(r["offset"] == 100 * r["chunk_idx"] for r in rows)
    assert df.rdd.getNumPartitions() > 10
    assert df.select("path", F.spark_partition_id().alias("p")).distinct().filter("path LIKE '%/a.bin'").count() == 11
    assert df.filter("chunk_idx = 3").count() == 1 and df.filter("chunk_idx >= 99 AND path LIKE '%a.bin'").count() == 2
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        few = K.read_chunks(spark, str(tmp_path), chunk=100, range_bytes=1000).filter("chunk_idx = 3")
        assert few.count() == 2 and few.rdd.getNumPartitions() == 1
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")
    bare = K.read_chunks(spark, str(tmp_path), chunk=100, content=False)
    assert "chunk" not in bare.columns and bare.count() > 300
    one = K.read_chunks(spark, str(tmp_path / "sub" / "c.bin"))
    assert [bytes(r["chunk"]) for r in one.collect()] == [b"abc"]
    with pytest.raises(Exception, match="none"):
        K.read_chunks(spark, str(tmp_path / "none")).count()


def test_source_takes_filters(tmp_path):
    """With pushdown on, only ranges that a filter leaves are planned."""
    from pyspark.sql.datasource import EqualTo, GreaterThan, LessThanOrEqual
    from pyspark.sql.types import StructType

    (tmp_path / "a").write_bytes(bytes(1000))
    (tmp_path / "b").write_bytes(bytes(1000))
    schema = StructType().add("path", "string").add("chunk_idx", "long")

    def pieces(*filters):
        reader = K.FilteringReader(schema, {"path": str(tmp_path), "chunkbytes": "10", "rangebytes": "100"})
        assert list(reader.pushFilters(list(filters))) == list(filters)
        return [(p.path.rsplit("/", 1)[1], p.first, p.last) for r in reader.partitions() for p in r.value]

    assert pieces(EqualTo(("chunk_idx",), 5)) == [("a", 5, 6), ("b", 5, 6)]
    assert pieces(GreaterThan(("chunk_idx",), 94), EqualTo(("path",), str(tmp_path / "b"))) == [("b", 95, 100)]
    assert pieces(LessThanOrEqual(("chunk_idx",), 4), EqualTo(("path",), str(tmp_path / "a"))) == [("a", 0, 5)]
