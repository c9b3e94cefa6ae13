"""Every core query against its SQL, over whole tables of the smallest and the next size."""

from pathlib import Path

import pytest

import __spark_entry__
from folioweave.plans import catalog

duckdb = pytest.importorskip("duckdb")
FOLDER = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not FOLDER.exists(), reason="no test tables")


def rows(columns, found):
    at = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(str(r[i]) for i in at) for r in found)


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_gives_what_the_sql_gives(spark, name):
    con = duckdb.connect()
    for f in FOLDER.glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    want = con.execute(catalog.oracle_sql()[name])
    columns = [c[0] for c in want.description]
    df = catalog.queries()[name](spark, str(FOLDER))
    assert sorted(df.columns) == sorted(columns)
    assert rows(df.columns, df.collect()) == rows(columns, want.fetchall())


def test_every_query_has_sql_or_a_test_of_its_own():
    assert set(catalog.queries()) - set(catalog.oracle_sql()) <= {"segment_documents", "heading_sections", "entity_resolution", "communities"}


def test_entry_has_all_core_queries():
    assert set(catalog.queries()) <= set(__spark_entry__.queries())
