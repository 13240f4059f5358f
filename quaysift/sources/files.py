"""Sources and sinks: files, requests, type registries and rules in; results and audit logs out."""

from __future__ import annotations

import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import lookups
from .chunks import opened

REQUEST = """op string, file_path string, user_id long, tee_sealed_key string, original_filename string,
encryption_meta struct<version: long, nonce: string, chunk_size: long, chunks: long, plaintext_sha256: string, plaintext_size: long, metadata_mac: string>,
_corrupt_record string"""


def read_files(spark: SparkSession, path: str, max_bytes: int = lookups.MAX_FILE, glob: str = "*") -> DataFrame:
    """``path, length, content, reason``: whole files; those over the cap come without content and with a reason.

    The cap is pushed into the source, so content of larger files isn't read.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path)
    small = files.filter(F.col("length") <= max_bytes).select("path", "length", "content", F.lit(None).cast("string").alias("reason"))
    large = files.filter(F.col("length") > max_bytes).select("path", "length", F.lit(None).cast("binary").alias("content"), F.lit("content_too_large_for_row").alias("reason"))
    return small.unionByName(large)


def read_requests(spark: SparkSession, path: str, stream: bool = False) -> DataFrame:
    """Requests in the fixed schema, a JSON object a line; lines that don't parse keep their text in ``_corrupt_record``."""
    reader = (spark.readStream if stream else spark.read).schema(REQUEST).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt_record")
    return reader.json(path)


def read_type_registry(spark: SparkSession, path: str) -> DataFrame:
    """``ext, type, mime, scan, zip_based`` from a JSON object ``{"extensions": {ext: {type, mime, scan, zipBased}}}``."""
    schema = "extensions map<string, struct<type: string, mime: string, scan: array<string>, zipBased: boolean>>"
    rows = spark.read.schema(schema).option("multiLine", "true").json(path).select(F.explode("extensions").alias("ext", "x"))
    return rows.select("ext", "x.type", "x.mime", F.coalesce("x.scan", F.array().cast("array<string>")).alias("scan"), F.coalesce("x.zipBased", F.lit(False)).alias("zip_based"))


def _compiled(patterns: list[str]) -> set[str]:
    """The regular expressions that the engine compiles. All are tried at once, and halves of them where that fails."""
    if not patterns:
        return set()
    try:
        SparkSession.builder.getOrCreate().range(1).select(*(F.lit("").rlike(p) for p in patterns)).collect()
        return set(patterns)
    except PySparkException:
        half = len(patterns) // 2
        return _compiled(patterns[:half]) | _compiled(patterns[half:]) if half else set()


def valid_rules(rules: list[tuple[int, str, str, str]]) -> tuple[list[tuple[int, str, str, str]], int]:
    """(rules that compile, how many don't). Rules are few and come from an operator's own configuration."""
    good = []
    regexes = _compiled(sorted({r[3] for r in rules if r[2] == "regex"}))
    for r in rules:
        ok = bool(r[3]) and (r[2] == "literal" or (r[2] == "regex" and r[3] in regexes))
        if r[2] == "hex" and r[3]:
            try:
                ok = bool(bytes.fromhex(r[3]))
            except ValueError:
                ok = False
        if ok:
            good.append(r)
    return good, len(rules) - len(good)


def read_rules(spark: SparkSession, path: str, most: int = 10_000) -> tuple[list[tuple[int, str, str, str]], int]:
    """(rules, skipped) from files ``*.yar`` (any case, no dot files), a rule ``kind<tab>name<tab>pattern`` a line.

    Rules are ordered by file and line. More than ``most`` lines are an error; no good rule means that none match.
    """
    texts = spark.read.text(path, wholetext=True, pathGlobFilter="*.[yY][aA][rR]").select("value", F.col("_metadata.file_path").alias("file"))
    lines = texts.select("file", F.posexplode(F.split("value", "\r?\n")).alias("line", "value"))
    lines = lines.filter(~F.element_at(F.split("file", "/"), -1).startswith(".") & (F.trim("value") != "") & ~F.col("value").startswith("#"))
    rows = lines.orderBy("file", "line").limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} rules")
    parts = [r["value"].split("\t", 2) for r in rows]
    whole = [(i, p[1], p[0], p[2]) for i, p in enumerate(parts) if len(p) == 3]
    good, bad = valid_rules(whole)
    return good, bad + len(parts) - len(whole)


def result_json(*columns: str) -> Column:
    """A result as one JSON object; absent fields are left out."""
    return F.to_json(F.struct(*columns), {"ignoreNullFields": "true"})


def write_results(df: DataFrame, path: str, mode: str = "append") -> None:
    df.select(result_json(*df.columns).alias("value")).write.mode(mode).text(path)


def _copied(targets: str, units: list[tuple[str, int, list[str]]]):
    """A task's job: its units' sources, each a file, one behind the other into a file from a byte on."""
    local = opened(targets)[1] if targets.startswith(("/", "file:")) else None

    def job(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for target, offset, sources in (units[i] for i in b.column(0).to_pylist()):
                if local is None:
                    store, path = opened(target)
                    out = store.open_output_stream(path)
                else:  # a task that is run again writes the same bytes to the same place
                    path = opened(target)[1]
                    os.makedirs(os.path.dirname(path), exist_ok=True)
                    out = os.fdopen(os.open(path, os.O_WRONLY | os.O_CREAT, 0o644), "wb")
                    out.seek(offset)
                with out:
                    for source in sources:
                        store, path = opened(source)
                        with store.open_input_stream(path) as file:
                            while data := file.read(4 << 20):
                                out.write(data)
            yield b

    return job


def write_keyed(df: DataFrame, path: str, key: str, order: str, value: str = "value") -> None:
    """A file ``key=../all.txt`` for each key, with its rows' ``value`` as lines in the order of ``order``, by as many tasks as the input has, whatever the keys' sizes.

    Tasks write lines of a range of keys and numbers each, to files below ``path`` + ``-parts``. Their lengths tell where these belong, and they are copied there side by
    side where the store is a (shared) file system; stores whose files are written from the start on have a task a file, which holds a few MB of it.
    """
    spark, parts = df.sparkSession, f"{path}-parts"
    n = max(df.rdd.getNumPartitions(), int(spark.conf.get("spark.sql.shuffle.partitions")))
    df.repartitionByRange(n, key, order).sortWithinPartitions(key, order).select(key, value).write.partitionBy(key).text(parts)
    found = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").option("recursiveFileLookup", "true").load(parts).select("path", "length").collect()  # a few a task
    units: list[tuple[str, int, list[str]]] = []
    side_by_side = path.startswith(("/", "file:"))
    place: dict[str, int] = {}
    number = lambda r: (os.path.dirname(r["path"]), int(os.path.basename(r["path"]).split("-")[1]), r["path"])
    for r in sorted(found, key=number):
        target = f"{path}/{os.path.basename(os.path.dirname(r['path']))}/all.txt"
        if side_by_side or target not in place:
            units.append((target, place.get(target, 0), []))
        units[-1][2].append(r["path"])
        place[target] = place.get(target, 0) + r["length"]
    if units:
        spark.range(0, len(units), 1, len(units)).mapInArrow(_copied(path, units), "id long").count()
    else:
        df.select(value).limit(0).write.text(path)


def write_audit(df: DataFrame, path: str, mode: str = "append") -> None:
    """JSON lines, a folder a UTC day, in the order of ``seq`` within a day."""
    df.repartition("log_date").sortWithinPartitions("log_date", "seq").write.partitionBy("log_date").mode(mode).json(path)
