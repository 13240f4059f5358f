"""Every registered query of the library against DuckDB on the same tables."""

import pytest
from conftest import duck, rows_of

from quaysift.plans.registry import QUERIES, SQL


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows(spark, sf, name):
    got, want = QUERIES[name](spark, sf).toPandas(), duck(SQL[name], sf)
    assert sorted(got.columns) == sorted(want.columns)
    assert rows_of(got) == rows_of(want)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, sf, name):
    assert QUERIES[name](spark, sf).count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_empty_tables(spark, sf, tmp_path):
    """Queries on tables without rows give no rows, or the one row of a total."""
    from quaysift.plans import views

    for t in views.TABLES:
        spark.read.parquet(f"{sf}/{t}.parquet").limit(0).write.parquet(f"{tmp_path}/{t}.parquet")
    for name in ("val_2_ranges", "typ_admission_report", "mat_2_first_match", "mrk_3_attribute_policy", "int_4_reassemble", "arc_11_archive_verdict", "aud_2_build_chain", "load_1_peak_load", "met_1_scan_metrics"):
        assert QUERIES[name](spark, str(tmp_path)).count() <= 6, name
