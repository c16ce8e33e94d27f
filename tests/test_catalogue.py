"""Every driver query of the search engine against its brute-force SQL, on the smallest tables."""

import glob
import os

import pytest

from strandline import catalogue

SF = "/root/testdata/sf0.001"
ORACLES = catalogue.oracle_sql()


def test_every_query_has_sql():
    assert set(catalogue.queries()) == set(ORACLES)


@pytest.mark.skipif(not glob.glob(f"{SF}/*.parquet"), reason="no test tables here")
@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"create view {os.path.basename(path)[:-8]} as select * from read_parquet('{path}')")
    df = catalogue.queries()[name](spark, SF)
    columns = sorted(df.columns)
    table = con.sql(ORACLES[name])
    assert sorted(table.columns) == columns
    theirs = [dict(zip(table.columns, row, strict=True)) for row in table.fetchall()]
    shown = lambda r: tuple(str(round(v, 9) if isinstance(v, float) else v) for v in (r[c] for c in columns))
    assert sorted(map(shown, (r.asDict() for r in df.collect()))) == sorted(map(shown, theirs))
