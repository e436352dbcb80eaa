"""Queries against their SQL, and their independence from partitions."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
#: One or two of each family; the driver compares all.
SOME = ["catalog_list", "catalog_inspect", "hardlink_resolve", "extract_entry", "estimate_resources_by_profile", "solid_groups_next_fit", "restore_map", "codec_round_trip", "verify_report", "structural_chunks", "chunk_ids_global", "collision_groups", "microfile_packs", "microfile_front_coding", "entry_table_violations", "path_safety", "job_idempotency", "job_state_machine", "rate_limiter", "lane_round_robin"]


def _plain(x):
    if x is None or x != x:
        return None
    if isinstance(x, bool):
        return x
    return float(x) if hasattr(x, "__float__") and not isinstance(x, str) else x


def _rows(frame):
    cols = sorted(frame.columns)
    return cols, sorted([tuple(_plain(v) for v in r) for r in frame[cols].astype(object).itertuples(index=False)], key=repr)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from read_parquet('{f}')")
    return con


@pytest.mark.parametrize("name", SOME)
def test_query_equals_sql(spark, duck, name):
    assert _rows(entry.queries()[name](spark, SF).toPandas()) == _rows(duck.sql(entry.oracle_sql()[name]).df())


def test_every_oracle_has_its_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).count() == 200


@pytest.mark.parametrize("name", ["microfile_packs", "solid_groups_next_fit"])
def test_partitions_change_nothing(spark, name):
    seen = []
    for n in ("1", "7"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        seen.append(_rows(entry.queries()[name](spark, SF).toPandas()))
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert seen[0] == seen[1]
