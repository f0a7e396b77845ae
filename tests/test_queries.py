"""Every registered query against its SQL, and the driver's entry point."""

import glob
import os

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

import __spark_entry__ as entry_point
from workload import derived

SF = "/root/testdata/sf0.001"
QUERIES = {name: fn for name, fn in entry_point.queries().items() if name in entry_point.QUERIES}
SQL = entry_point.ORACLE


@pytest.fixture(scope="module")
def database():
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def plain(value):
    return round(value, 9) if isinstance(value, float) else value


def test_every_query_has_sql():
    assert set(SQL) == set(QUERIES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_same_as_sql(spark, database, name):
    df = QUERIES[name](spark, SF)
    result = database.execute(SQL[name])
    names = [d[0] for d in result.description]
    columns = sorted(df.columns)
    assert columns == sorted(names)
    expected = sorted(([plain(r[names.index(c)]) for c in columns] for r in result.fetchall()), key=repr)
    assert sorted(([plain(r[c]) for c in columns] for r in df.collect()), key=repr) == expected


def test_entry(spark):
    assert entry_point.entry(spark).count() > 0


def test_a_file_of_many_row_groups_is_read_without_a_shuffle(spark, tmp_path):
    rows = pa.table({"n": list(range(400))})
    pq.write_table(rows, tmp_path / "many groups.parquet", row_group_size=10)
    pq.write_table(rows, tmp_path / "one.parquet")
    plans = {name: derived.table(spark, str(tmp_path), name) for name in ("many groups", "one")}
    moved = {name: "Exchange" in df._jdf.queryExecution().executedPlan().toString() for name, df in plans.items()}
    assert moved == {"many groups": False, "one": True}
    assert all(sorted(r.n for r in df.collect()) == list(range(400)) for df in plans.values())
