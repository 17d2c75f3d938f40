import sys

import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
NAMES = [n for n in entry.oracle_sql() if not n.startswith("op") and n != "pipeline"]


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_its_sql(spark, name):
    import duckdb
    import os

    con = duckdb.connect()
    for f in os.listdir(SF):
        con.sql(f"create view {f[:-8]} as select * from '{SF}/{f}'")
    got, want = entry.queries()[name](spark, SF).toPandas(), con.sql(entry.oracle_sql()[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    key = lambda df: sorted(map(str, df[columns].astype(object).where(df[columns].notna(), None).itertuples(index=False, name=None)))
    assert key(got) == key(want)


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_import_without_corpus_operators():
    """The rest works when the folders of the corpus operators are gone."""
    import subprocess

    block = "import sys\nfor m in ('corpus_pipeline', 'cairn.llm'): sys.modules[m] = None\nimport __spark_entry__ as e\nassert len(e.queries()) > 50 and not any(n.startswith('op') for n in e.queries()), list(e.queries())"
    subprocess.run([sys.executable, "-c", block], check=True, cwd=entry.__file__.rsplit("/", 1)[0])
