"""Byte walkers: binary content becomes rows of entries, headers, segments and chunks. Policies over them are relational.

Each is a generator from bytes to rows inside ``mapInArrow``; those that need no jumps take a file chunk by chunk. Walks are bounded, so that no file can hang a task, and
stop at the first structure that can't be read, which is a row with a status instead of a failure.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Callable, Generator, Iterable, Iterator
from itertools import chain, count

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import lookups

MOST_CHUNKS, MOST_BLOCKS = 4096, 1_000_000
#: Rows of content that a task takes at a time, bytes of content that it holds, and rows that it gives at a time.
BATCH_ROWS, BATCH_BYTES, OUT_ROWS = 256, 4 << 20, 1_000


def small_batches(df: DataFrame) -> DataFrame:
    """``df``, in whose session Arrow batches have ``BATCH_ROWS`` rows and some ``BATCH_BYTES`` at most: the JVM and the Python worker hold a batch at a time, and content is long."""
    conf, rows = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(conf.get(rows)) <= BATCH_ROWS:
        conf.set(rows, str(BATCH_ROWS))
    conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return df


def explode_bytes(files: DataFrame, walk: Callable[[bytes], Iterator[tuple]], schema: str, key: str = "file_id", content: str = "content") -> DataFrame:
    """``key`` and a row for each tuple that ``walk`` yields of a row's content. Null content counts as empty. One content is held as bytes at a time, and rows go out by the thousand."""
    kind = files.schema[key].dataType.simpleString()
    types = {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "boolean": pa.bool_(), "binary": pa.binary()}
    fields = [x.split() for x in schema.split(", ")]

    def job(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys: list = []
            rows: list[tuple] = []

            def made(kind: pa.DataType) -> pa.RecordBatch:
                columns = list(zip(*rows, strict=True)) if rows else [()] * len(fields)
                out = pa.RecordBatch.from_arrays([pa.array(keys, kind), *(pa.array(list(c), types[t]) for c, (_, t) in zip(columns, fields, strict=True))], [key, *(n for n, _ in fields)])  # noqa: B023
                keys.clear()  # noqa: B023
                rows.clear()  # noqa: B023
                return out

            for k, body in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                for row in walk(body.as_py() or b""):
                    keys.append(k)
                    rows.append(row)
                    if len(rows) >= OUT_ROWS:
                        yield made(b.column(0).type)
            yield made(b.column(0).type)

    return small_batches(files).select(key, F.col(content).cast("binary")).mapInArrow(job, f"{key} {kind}, {schema}")


ZIP = "entry_idx int, path string, flags int, method int, comp_size long, uncomp_size long, offset long, actual_size long, status string, declared int, listed int, cd_end long, eocd boolean, size long"


def zip_walk(body: bytes) -> Iterator[tuple]:
    """A row an entry of the central directory, up to the declared count, or one row without a path for an archive that has none."""
    at = body.rfind(b"PK\x05\x06", max(0, len(body) - 65_557)) if len(body) >= 22 else -1
    if at < 0 or at + 22 > len(body):
        yield (0, None, None, None, None, None, None, None, None, 0, 0, 0, False, len(body))
        return
    declared, cd_size, cd_at = struct.unpack("<HII", body[at + 10 : at + 20])
    entries, p = [], cd_at
    most = min(declared, lookups.MAX_ENTRIES + 1)
    while cd_at + cd_size <= len(body) and len(entries) < most and p + 46 <= cd_at + cd_size and body[p : p + 4] == b"PK\x01\x02":
        flags, method = struct.unpack("<HH", body[p + 8 : p + 12])
        comp, size, name, extra, note = struct.unpack("<IIHHH", body[p + 20 : p + 34])
        offset = struct.unpack("<I", body[p + 42 : p + 46])[0]
        if p + 46 + name > cd_at + cd_size:
            break
        path = body[p + 46 : p + 46 + min(name, 511)].decode("utf-8", "replace")
        entries.append((path, flags, method, comp, size, offset))
        p += 46 + name + extra + note
    whole = (declared, len(entries), cd_at + cd_size, True, len(body))
    for i, (path, flags, method, comp, size, offset) in enumerate(entries):
        actual, status = _inflate(body, flags, method, comp, size, offset)
        yield (i, path, flags, method, comp, size, offset, actual, status, *whole)
    if not entries:
        yield (0, None, None, None, None, None, None, None, None, *whole)


def _inflate(body: bytes, flags: int, method: int, comp: int, size: int, offset: int) -> tuple[int | None, str]:
    """(bytes that come out, status) of an entry's data; output beyond the declared size isn't made."""
    if flags & 1 or method not in (0, 8) or 0xFFFFFFFF in (comp, size):
        return None, "skipped"
    if offset + 30 > len(body) or body[offset : offset + 4] != b"PK\x03\x04":
        return None, "bad_header"
    name, extra = struct.unpack("<HH", body[offset + 26 : offset + 30])
    start = offset + 30 + name + extra
    if start + comp > len(body):
        return None, "truncated"
    if method == 0 or comp == size == 0:
        return comp, "ok"
    inflater, done, rest = zlib.decompressobj(-15), 0, body[start : start + comp]
    try:
        while done <= size and not inflater.eof:
            out = inflater.decompress(rest, 32_768)
            rest = inflater.unconsumed_tail
            done += len(out)
            if not out and not rest:
                break
    except zlib.error:
        return done, "corrupt"
    return done, "ok" if inflater.eof or done > size else "corrupt"


class Feed:
    """A file's bytes as they arrive in chunks. What is read or skipped is let go, so no more than a chunk and a header is held.

    Walks are generators over a feed: they yield rows, and None where they wait for the next chunk.
    """

    def __init__(self) -> None:
        self.view, self.place, self.ended = memoryview(b""), 0, False

    def put(self, chunk: bytes) -> None:
        self.view = memoryview(chunk)

    def read(self, n: int) -> Generator[None, None, bytes]:
        """The next ``n`` bytes, or what is left of the file."""
        parts = []
        while n:
            some = bytes(self.view[:n])
            self.view, self.place, n = self.view[len(some) :], self.place + len(some), n - len(some)
            parts.append(some)
            if n:
                if self.ended:
                    break
                yield
        return b"".join(parts)

    def skip(self, n: int) -> Generator[None, None, bool]:
        """Passes ``n`` bytes over; False where the file ends before."""
        while n > len(self.view):
            n, self.place, self.view = n - len(self.view), self.place + len(self.view), memoryview(b"")
            if self.ended:
                return False
            yield
        self.view, self.place = self.view[n:], self.place + n
        return True


Walk = Callable[[Feed], Iterator[tuple | None]]


def walked(walk: Walk, chunks: Iterable[bytes]) -> Iterator[tuple]:
    """The rows of a walk over a file's chunks in order, each as soon as its bytes have come."""
    feed = Feed()
    rows = walk(feed)
    for chunk in chunks:
        feed.put(chunk)
        for row in rows:
            if row is None:
                break
            yield row
        else:
            return
    feed.ended = True
    yield from rows


def whole(walk: Walk) -> Callable[[bytes], Iterator[tuple]]:
    """A walk over whole content, with its length behind each row."""
    return lambda body: ((*row, len(body)) for row in walked(walk, [body]))


TAR = "entry_idx int, path string, uncomp_size long, typeflag string, checksum_ok boolean, helper boolean, head binary"


def _octal(field: bytes) -> int | None:
    """The octal digits after leading spaces, whatever follows them; None without one."""
    digits = re.match(rb" *([0-7]*)", field)[1]
    return int(digits, 8) if digits else None


def tar_walk(feed: Feed) -> Iterator[tuple | None]:
    """A row a header up to the first empty block, or to the first real entry beyond the limit; a wrong checksum ends the walk with its row.

    A binary size beyond a long is the largest long. ``head`` holds the first bytes of an entry's data.
    """
    real = 0
    for i in count():
        h = yield from feed.read(512)
        if len(h) < 512 or not any(h) or real > lookups.MAX_ENTRIES:
            return
        sum_field = h[:148] + b" " * 8 + h[156:]
        signed = sum(x - 256 if x > 127 else x for x in sum_field)
        size = min(int.from_bytes(h[125:136], "big"), (1 << 63) - 1) if h[124] & 0x80 else _octal(h[124:135]) or 0
        name, prefix = h[:100].split(b"\0")[0], h[345:500].split(b"\0")[0]
        path = (prefix + b"/" + name if prefix and len(prefix) + len(name) < 255 else name).decode("utf-8", "replace")
        kind = chr(h[156]) if h[156] else "0"
        ok = _octal(h[148:156]) in (sum(sum_field), signed)
        head = yield from feed.read(min(size, 262))
        yield (i, path, size, kind, ok, kind in "xgLK", head)
        if not ok:
            return
        real += kind not in "xgLK"
        yield from feed.skip(-(-size // 512) * 512 - len(head))


CHUNK = "chunk_idx int, chunk_type string, length long, offset long, end long, frames int"


def png_walk(feed: Feed) -> Iterator[tuple | None]:
    """A row a chunk; ``frames`` is an animation control chunk's frame count."""
    if (yield from feed.read(8)) != b"\x89PNG\r\n\x1a\n":
        return
    for i in range(MOST_CHUNKS):
        at = feed.place
        h = yield from feed.read(8)
        if len(h) < 8:
            return
        length, kind = struct.unpack(">I", h[:4])[0], h[4:].decode("latin-1")
        said = (yield from feed.read(4)) if kind == "acTL" and length == 8 else b""
        if not (yield from feed.skip(length + 4 - len(said))):
            return
        yield (i, kind, length, at, feed.place, min(int.from_bytes(said, "big"), 1 << 30))
        if kind == "IEND":
            return


def webp_walk(feed: Feed) -> Iterator[tuple | None]:
    """A row a RIFF chunk; one of type ``RIFF`` first, whose end is where the header says the file ends."""
    h = yield from feed.read(12)
    if len(h) < 12 or h[:4] != b"RIFF" or h[8:] != b"WEBP":
        return
    said = struct.unpack("<I", h[4:8])[0]
    yield (0, "RIFF", said, 0, said + 8, 0)
    for i in range(1, MOST_CHUNKS):
        at = feed.place
        h = yield from feed.read(8)
        if len(h) < 8:
            return
        length = struct.unpack("<I", h[4:])[0]
        if not (yield from feed.skip(length + (length & 1))):
            return
        yield (i, h[:4].decode("latin-1"), length, at, feed.place, 0)


def gif_walk(feed: Feed) -> Iterator[tuple | None]:
    """A row a block: ``image``, ``extension`` and at last ``trailer``."""
    h = yield from feed.read(13)
    if len(h) < 13 or h[:6] not in (b"GIF87a", b"GIF89a"):
        return
    table = lambda flags: 3 * 2 ** ((flags & 7) + 1) if flags & 0x80 else 0
    yield from feed.skip(table(h[10]))
    for i in range(MOST_BLOCKS):
        at = feed.place
        first = yield from feed.read(1)
        if first == b";":
            yield (i, "trailer", 1, at, at + 1, 0)
            return
        if first == b"!":
            kind, before = "extension", 1
        elif first == b"," and len(head := (yield from feed.read(9))) == 9:
            kind, before = "image", table(head[8]) + 1
        else:
            return
        if not (yield from feed.skip(before)):
            return
        while (n := (yield from feed.read(1))) not in (b"", b"\0"):
            if not (yield from feed.skip(n[0])):
                return
        if not n:
            return
        yield (i, kind, feed.place - at, at, feed.place, 0)


SEGMENT = "seg_idx int, marker int, length int, width int, height int, status string"


def jpeg_walk(body: bytes) -> Iterator[tuple]:
    """A row a marker segment up to the first frame header, which has the size; or a last row of status ``malformed`` where there is none.

    Fill bytes, and markers that stand alone (start, end, restarts), are passed over.
    """
    i, p = 0, 2 if len(body) >= 4 and body[:2] == b"\xff\xd8" else len(body)
    while p + 4 < len(body) and body[p] == 0xFF:
        marker = body[p + 1]
        if marker == 0xFF or 0xD0 <= marker <= 0xD9:
            p += 1 if marker == 0xFF else 2
            continue
        length = struct.unpack(">H", body[p + 2 : p + 4])[0]
        frame = 0xC0 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC)
        if length < (7 if frame else 2) or p + 2 + length > len(body):
            break
        h, w = struct.unpack(">HH", body[p + 5 : p + 9]) if frame else (None, None)
        yield (i, marker, length, w, h, "frame" if frame else "segment")
        if frame:
            return
        i, p = i + 1, p + 2 + length
    yield (i, None, None, None, None, "malformed")


def zip_entries(files: DataFrame, **how) -> DataFrame:
    return explode_bytes(files, zip_walk, ZIP, **how)


def tar_entries(files: DataFrame, **how) -> DataFrame:
    return explode_bytes(files, whole(tar_walk), f"{TAR}, size long", **how)


def jpeg_dimensions(files: DataFrame, key: str = "file_id", content: str = "content") -> DataFrame:
    """``key, ok, width, height``, a row a file: without a frame header it isn't ok and has no size."""
    last = explode_bytes(files, jpeg_walk, SEGMENT, key=key, content=content).filter("status <> 'segment'")  # one a file
    return last.select(key, (F.col("status") == "frame").alias("ok"), "width", "height")


_IMAGES = {"png": png_walk, "webp": webp_walk, "gif": gif_walk}


def _image_walk(body: bytes) -> Iterator[tuple]:
    """Whichever of the walks knows the first bytes."""
    return chain.from_iterable(whole(walk)(body) for walk in _IMAGES.values())


def image_chunks(files: DataFrame, kind: str | None = None, **how) -> DataFrame:
    """Chunks or blocks of PNG, WebP or GIF files: of the named kind, else of the kind that a file's first bytes tell."""
    return explode_bytes(files, whole(_IMAGES[kind]) if kind else _image_walk, f"{CHUNK}, file_length long", **how)


_WALKS = {"tar": (tar_walk, TAR, "size"), **{k: (w, CHUNK, "file_length") for k, w in _IMAGES.items()}}


def walk_chunks(chunks: DataFrame, kind: str, key: str = "file_id", chunk: str = "chunk") -> DataFrame:
    """What ``tar_entries`` or ``image_chunks`` of a ``kind`` give, for files of any size in rows ``key, chunk_idx, chunk``.

    A file's chunks meet in one task in order, and its walk takes them one by one: a task holds a batch of chunks, never a file. Numbers of chunks
    may have gaps, and null and empty chunks hold nothing; ``integrity.chunk_digests`` tells whether a file is whole.
    """
    walk, schema, size = _WALKS[kind]
    rows = in_file_order(chunks.select(key, "chunk_idx", F.col(chunk).cast("binary").alias("chunk"), F.sum(F.coalesce(F.octet_length(chunk), F.lit(0))).over(W.partitionBy(key)).alias("_size")), key)
    return by_file(rows, lambda file: ((*row, file.size) for row in walked(walk, file)), f"{schema}, {size} long", key)


class OneFile:
    """The chunks of one file of a task's sorted rows, as they come."""

    def __init__(self, key, size: int | None, rows: Iterator[tuple]) -> None:
        self.key, self.size, self.rows, self.next = key, size, rows, None

    def __iter__(self) -> Iterator[bytes]:
        return (chunk or b"" for _, chunk in self.numbered())

    def numbered(self) -> Iterator[tuple[int, bytes | None]]:
        """Numbers and chunks; goes on where an earlier call was left."""
        for row in self.rows if self.next is None else ():
            if row[0] != self.key:
                self.next = row
                return
            yield row[1], row[2]


def in_file_order(chunks: DataFrame, key: str) -> DataFrame:
    """A file's chunks in one task, by number. Files are dealt by their key: large files cost one task each, as what is read in order must."""
    return chunks.repartition(key).sortWithinPartitions(key, "chunk_idx")


def by_file(rows: DataFrame, walk: Callable[[OneFile], Iterator[tuple]], schema: str, key: str = "file_id") -> DataFrame:
    """``key`` and a row for each tuple that ``walk`` yields of a file. ``rows(key, chunk_idx, chunk, ..)`` are sorted by file and number; batches are held one at a time."""
    kind = rows.schema[key].dataType.simpleString()
    types = {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "boolean": pa.bool_(), "binary": pa.binary()}
    fields = [x.split() for x in schema.split(", ")]

    def job(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made: list[tuple] = []
        batches = iter(batches)
        first = next((b for b in batches if b.num_rows), None)
        if first is None:
            return
        key_type = first.column(0).type

        def flushed() -> pa.RecordBatch:
            columns = list(zip(*made, strict=True))
            made.clear()
            return pa.RecordBatch.from_arrays([pa.array(list(columns[0]), key_type), *(pa.array(list(c), types[t]) for c, (_, t) in zip(columns[1:], fields, strict=True))], [key, *(n for n, _ in fields)])

        def each() -> Iterator[tuple]:
            for b in chain([first], batches):
                keys, at, chunks = b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)
                size = b.column(3).to_pylist() if b.num_columns > 3 else [None] * b.num_rows
                for i, k in enumerate(keys):
                    yield k, at[i], chunks[i].as_py(), size[i]

        rows = each()
        row = next(rows)
        while row is not None:
            file = OneFile(row[0], row[3], chain([row], rows))
            for out in walk(file):
                made.append((file.key, *out))
                if len(made) >= 1000:
                    yield flushed()
            for _ in file.numbered():  # what the walk left
                pass
            row = file.next
        if made:
            yield flushed()

    return small_batches(rows).mapInArrow(job, f"{key} {kind}, {schema}")
