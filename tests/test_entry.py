import glob
import os
import sys

import duckdb
import pytest

SF = "/root/testdata/sf0.001"

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
from siltbed.plans import catalogue  # noqa: E402


def compare(spark, name, run, sql, sf_dir=SF):
    """The query's rows are the SQL's, whatever their order."""
    ours = run(spark, sf_dir).toPandas()
    con = duckdb.connect()
    for p in glob.glob(f"{sf_dir}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    theirs = con.sql(sql).df()
    cols = sorted(ours.columns)
    assert cols == sorted(theirs.columns)
    a, b = (d[cols].astype(str).sort_values(cols).reset_index(drop=True) for d in (ours, theirs))
    assert a.equals(b), name


@pytest.mark.skipif(not os.path.isdir(SF), reason="the test tables aren't here")
@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_query_against_sql(spark, name):
    compare(spark, name, catalogue.queries()[name], catalogue.oracle_sql()[name])


def test_entry_and_keys(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    if os.path.isdir(SF):
        assert e.entry(spark).count() > 0
