"""All registered queries of the library against DuckDB: on the smallest tables within a rounding, on the next ones by the value."""

import glob
import os

import duckdb
import pytest

from pluviant.plans import catalog

DATA = ["/root/testdata/sf0.001", "/root/testdata/sf0.01"]
pytestmark = pytest.mark.skipif(not all(map(os.path.isdir, DATA)), reason="the tables are not here")


def tables(folder):
    con = duckdb.connect()
    for path in glob.glob(f"{folder}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(path).removesuffix('.parquet')} AS SELECT * FROM '{path}'")
    return con


@pytest.fixture(scope="module")
def oracles():
    return {folder: tables(folder) for folder in DATA}


@pytest.mark.parametrize("folder", DATA)
@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, oracles, tmp_path, name, folder):
    out, oracle = str(tmp_path / "out"), oracles[folder]
    catalog.QUERIES[name](spark, folder).write.parquet(out)
    want = oracle.sql(catalog.ORACLE_SQL[name])
    columns = ", ".join(f'"{c}"' for c in sorted(want.columns))
    got = oracle.sql(f"SELECT * FROM '{out}/*.parquet'")
    assert sorted(got.columns) == sorted(want.columns)
    rows = lambda sql: sorted(oracle.sql(f"SELECT {columns} FROM {sql}").fetchall(), key=repr)
    got, want = rows(f"'{out}/*.parquet'"), rows(f"({catalog.ORACLE_SQL[name]})")
    assert len(got) == len(want)
    if folder != DATA[0]:
        assert got == want
    for a, b in zip(got, want, strict=True):
        # Engines add in different orders, so a value half-way between two roundings may go either way.
        unit = 1.01 * 10.0 ** -catalog.PLACES[name]
        assert all(x == y or isinstance(x, float) and abs(x - y) <= unit for x, y in zip(a, b, strict=True)), (a, b)
