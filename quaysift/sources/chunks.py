"""Files of any size as chunk rows: a data source whose partitions are byte ranges, so that one file is read by many tasks.

Lengths alone plan a read: large files are cut into ranges of whole chunks, and small files share a partition up to the same size. Short ranges grow
with the input, so that a read has no more than some ``MOST_RANGES`` of them until they are as long as ``RANGE``.
A task seeks to its range and yields a chunk a row; no row, and no task, holds a whole file. Where the schema that is asked for has no ``chunk``,
no bytes are read at all, and where the session allows it, filters on ``chunk_idx`` and ``path`` are taken before ranges are planned.
"""

from __future__ import annotations

import fnmatch
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual
from pyspark.sql.types import StructType

from .. import lookups

SCHEMA = "path string, chunk_idx long, offset long, file_length long, chunk binary, reason string"
#: Bytes of a partition, and of an Arrow batch.
RANGE, BATCH = 128 << 20, 8 << 20
#: Partitions of a read whose ranges are shorter than ``RANGE``: each costs a task, whatever its length.
MOST_RANGES = 500
_TYPES = {"path": pa.string(), "chunk_idx": pa.int64(), "offset": pa.int64(), "file_length": pa.int64(), "chunk": pa.binary(), "reason": pa.string()}


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """The store and the path within it of a local path or a URI."""
    if path.startswith("file:"):
        path = "/" + path[len("file:") :].lstrip("/")
    return (fs.LocalFileSystem(), path) if path.startswith("/") else fs.FileSystem.from_uri(path)


@dataclass
class Piece:
    """Chunks ``first`` to ``last`` (exclusive) of a file; a file over the cap has none and a reason."""

    path: str
    length: int
    first: int
    last: int
    reason: str | None = None


class Ranges(InputPartition):
    def __init__(self, pieces: list[Piece]) -> None:
        super().__init__(pieces)


def planned(files: list[tuple[str, int]], chunk: int, size: int, most: int, low: int = 0, high: int | None = None, last: int | None = None, cut: bool = True) -> list[list[Piece]]:
    """Partitions of about ``size`` bytes in the order of the paths, or of up to ``RANGE`` where there would be more than ``MOST_RANGES``; chunks before ``low`` and
    from ``high`` on, or before the ``last`` few, are left out. An empty file has one empty chunk. Unless files are ``cut``, each is in one partition."""
    bounds = []
    for path, length in sorted(files):
        n = max(1, -(-length // chunk))
        bounds.append((path, length, max(low, 0 if last is None else n - last), n if high is None else min(n, high)))
    total = sum(max(0, end - start) * chunk for _, length, start, end in bounds if length <= most)
    size = max(size, min(RANGE, -(-total // MOST_RANGES)))
    out: list[list[Piece]] = []
    held, room = [], size
    step = max(1, size // chunk)

    for path, length, start, end in bounds:
        step = step if cut else max(1, end - start)
        wanted = [Piece(path, length, a, min(a + step, end)) for a in range(start, end, step)] if length <= most else [Piece(path, length, 0, 0, "file_too_large")]
        for piece in wanted:
            weight = (piece.last - piece.first) * chunk
            if held and weight > room:
                out.append(held)
                held, room = [], size
            held.append(piece)
            room -= weight
    return [*out, held] if held else out


class ChunkReader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict[str, str]) -> None:
        self.columns = [f.name for f in schema.fields]
        if unknown := set(self.columns) - set(_TYPES):
            raise ValueError(f"no columns {sorted(unknown)}; there are {SCHEMA}")
        self.root, self.glob = options["path"], options.get("pathglobfilter", "*")
        self.chunk, self.range = int(options.get("chunkbytes", lookups.CHUNK)), int(options.get("rangebytes", RANGE))
        self.most = int(options.get("maxbytes", lookups.MAX_FILE))
        self.low, self.high, self.only = 0, None, None
        self.last = int(options["lastchunks"]) if "lastchunks" in options else None
        self.cut = options.get("wholefiles", "false").lower() != "true"

    def partitions(self) -> list[Ranges]:
        store, path = opened(self.root)
        info = store.get_file_info(path)
        if info.type == fs.FileType.NotFound:
            raise FileNotFoundError(self.root)
        found = [info] if info.type == fs.FileType.File else store.get_file_info(fs.FileSelector(path, recursive=True))
        head = self.root[: -len(path)] if self.root.endswith(path) and not self.root.startswith("/") else ""
        files = [(head + x.path, x.size) for x in found if x.type == fs.FileType.File and fnmatch.fnmatch(x.base_name, self.glob) and not x.base_name.startswith((".", "_"))]
        return [Ranges(p) for p in planned([x for x in files if self.only in (None, x[0])], self.chunk, self.range, self.most, self.low, self.high, self.last, self.cut)]

    def read(self, partition: Ranges) -> Iterator[pa.RecordBatch]:
        for p in partition.value:
            if p.reason:
                yield self._batch(p, [0], [None])
                continue
            numbers = range(p.first, p.last)
            together = max(1, BATCH // self.chunk)
            if "chunk" not in self.columns:
                for a in range(0, len(numbers), 10_000):
                    yield self._batch(p, numbers[a : a + 10_000], None)
                continue
            store, path = opened(p.path)
            with store.open_input_file(path) as file:
                for a in range(0, len(numbers), together):
                    some = numbers[a : a + together]
                    data = file.read_at(min(len(some) * self.chunk, p.length - some[0] * self.chunk), some[0] * self.chunk)
                    yield self._batch(p, some, [data[i * self.chunk : (i + 1) * self.chunk] for i in range(len(some))])

    def _batch(self, p: Piece, numbers, chunks: list | None) -> pa.RecordBatch:
        n = len(numbers)
        made = {"path": [p.path] * n, "chunk_idx": list(numbers), "offset": [k * self.chunk for k in numbers], "file_length": [p.length] * n, "chunk": chunks, "reason": [p.reason] * n}
        return pa.RecordBatch.from_arrays([pa.array(made[c], _TYPES[c]) for c in self.columns], self.columns)


class FilteringReader(ChunkReader):
    """The reader for sessions that hand filters to Python sources (``spark.sql.python.filterPushdown.enabled``); others refuse one that asks for them."""

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Takes bounds on ``chunk_idx`` and an equal ``path``; rows of files over the cap have number 0."""
        for f in filters:
            at, v = getattr(f, "attribute", None), getattr(f, "value", None)
            if at == ("chunk_idx",) and isinstance(f, EqualTo | LessThan | LessThanOrEqual):
                top = v if isinstance(f, LessThan) else v + 1
                self.high = top if self.high is None else min(self.high, top)
            if at == ("chunk_idx",) and isinstance(f, EqualTo | GreaterThan | GreaterThanOrEqual):
                self.low = max(self.low, v + 1 if isinstance(f, GreaterThan) else v)
            if at == ("path",) and isinstance(f, EqualTo):
                self.only = v
            yield f  # Spark applies it again, which costs next to nothing


class ChunkSource(DataSource):
    """``spark.read.format("file_chunks")`` with options path, chunkBytes, rangeBytes, maxBytes, pathGlobFilter, lastChunks, wholeFiles and takeFilters."""

    @classmethod
    def name(cls) -> str:
        return "file_chunks"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> ChunkReader:
        options = {k.lower(): v for k, v in self.options.items()}
        return (FilteringReader if options.get("takefilters") == "true" else ChunkReader)(schema, options)


def read_chunks(spark: SparkSession, path: str, chunk: int = lookups.CHUNK, range_bytes: int = RANGE, max_bytes: int = lookups.MAX_FILE, glob: str = "*", content: bool = True, last: int | None = None, whole: bool = False) -> DataFrame:
    """``path, chunk_idx, offset, file_length, chunk, reason``: the bytes of all files below ``path``, a row a chunk.

    An empty file is one empty chunk. Files over ``max_bytes`` are one row without bytes and with the reason ``file_too_large``. Without ``content``
    nothing is read but lengths, and with ``last`` only so many chunks at each file's end. Files whose names begin with a dot or an underscore are passed over. Stores are those that Arrow opens (local,
    and by URI such as hdfs, s3 or gs); on a cluster all executors must reach them. ``whole`` files aren't cut into ranges: a task yields all chunks of each of its files
    in order, for what must take them so (``integrity.chunk_digests`` with ``in_order``), and nothing is shuffled or sorted.
    """
    spark.dataSource.register(ChunkSource)
    takes = str(spark.conf.get("spark.sql.python.filterPushdown.enabled", "false")).lower()
    reader = spark.read.format("file_chunks").options(chunkBytes=chunk, rangeBytes=range_bytes, maxBytes=max_bytes, pathGlobFilter=glob, takeFilters=takes)
    if last is not None:
        reader = reader.option("lastChunks", last)
    if whole:
        reader = reader.option("wholeFiles", "true")
    if not content:
        reader = reader.schema(SCHEMA.replace("chunk binary, ", ""))
    return reader.load(path)
