import os
import sys
import tempfile
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = os.pathsep.join(x for x in (str(ROOT), os.environ.get("PYTHONPATH")) if x)
SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.default.parallelism", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "4g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
        .config("spark.sql.warehouse.dir", tempfile.mkdtemp(prefix="spark-"))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf():
    return SF


def rows_of(frame):
    """Rows as sorted text tuples, columns by name: the way both engines' results are compared."""
    import pandas as pd

    def text(v):
        if v is None or v is pd.NA or v is pd.NaT or (isinstance(v, float) and v != v):
            return "null"
        if isinstance(v, bool) or type(v).__name__ == "bool_":
            return str(bool(v))
        if hasattr(v, "__float__") and not isinstance(v, str):
            return f"{float(v):.6f}"
        return str(v)

    frame = frame[sorted(frame.columns)]
    return sorted(tuple(text(v) for v in r) for r in frame.astype(object).itertuples(index=False))


def duck(sql, sf):
    import duckdb

    c = duckdb.connect()
    for path in Path(sf).glob("*.parquet"):
        source = f"{path}/*.parquet" if path.is_dir() else str(path)
        c.sql(f"CREATE VIEW {path.stem} AS SELECT * FROM '{source}'")
    return c.sql(sql).df()
