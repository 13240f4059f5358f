"""What the corpus operators have in common: shared storage, checked broadcasts, skew-safe attachment."""

from __future__ import annotations

import tempfile
import uuid

from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Most rows of a key-value side that is broadcast; beyond it the join shuffles.
BROADCAST_ROWS = 100_000
#: Most groups that are called heavy, and so the most rows of the heavy side's broadcast.
HEAVY_GROUPS = 20_000

#: Most rows of an Arrow batch: texts may be long, and the JVM and the Python worker hold a batch at a time.
BATCH_ROWS = 1_000
_own_dir: list[str] = []


def bounded(df: DataFrame) -> DataFrame:
    """``df``, in whose session Arrow batches have ``BATCH_ROWS`` rows at most."""
    name, conf = "spark.sql.execution.arrow.maxRecordsPerBatch", df.sparkSession.conf
    if not 0 < int(conf.get(name)) <= BATCH_ROWS:
        conf.set(name, str(BATCH_ROWS))
    return df


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, as the cluster names it in ``spark.checkpoint.dir``.

    Where that is unset, a temporary folder serves in local mode only; a cluster without it is an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    master = spark.conf.get("spark.master", "local")
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not _own_dir:
        _own_dir.append(tempfile.mkdtemp(prefix="spark-"))
    return _own_dir[0]


def written(df: DataFrame, name: str, *done: Broadcast) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage and survives lost executors.

    Broadcasts that only ``df`` needed are ``done`` with then, and leave the executors.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    for x in done:
        x.destroy()
    return spark.read.schema(df.schema).parquet(path)


def attach(members: DataFrame, groups: DataFrame, key: str, size: str, total: int) -> DataFrame:
    """Inner join of ``members`` with ``groups`` (one row a key, ``size`` members each) that hot keys don't bend.

    Groups of at least ``total / HEAVY_GROUPS`` members number ``HEAVY_GROUPS`` at most, so these are
    broadcast; the members of all other groups meet in a shuffled join whose keys are all light.
    ``groups`` should be a written table, since it is read twice. Null keys match nothing.
    """
    heavy_from = max(64, -(-total // HEAVY_GROUPS))
    heavy = groups.filter(F.col(size) >= heavy_from)
    light = groups.filter(F.col(size) < heavy_from)
    hot = members.join(F.broadcast(heavy), key)
    rest = members.join(F.broadcast(heavy.select(key)), key, "left_anti").join(light, key)
    return hot.unionByName(rest)


def without(rows: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose keys aren't in ``gone``: by broadcast while these are few, else by a shuffle. Null keys stay."""
    gone = written(gone.select(*keys).distinct(), "gone")
    few = gone.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    return rows.join(F.broadcast(gone) if few else gone, keys, "left_anti")
