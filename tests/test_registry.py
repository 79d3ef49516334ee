import os
import subprocess
import sys

import duckdb
import pytest

from docugauge.plans import registry

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def test_names_agree_and_need_no_session():
    assert set(registry.ORACLE_SQL) <= set(registry.QUERIES) and len(registry.QUERIES) > 75
    code = "import __spark_entry__ as e; q, s = e.queries(), e.oracle_sql(); assert set(s) <= set(q); print(len(q))"
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    assert int(subprocess.run([sys.executable, "-c", code], cwd=root, capture_output=True, text=True, check=True).stdout) >= len(registry.QUERIES)


def shown(value):
    if value is None or value != value:
        return "NULL"
    return repr(float(value)) if isinstance(value, float) else str(value)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the driver's tables")
@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_like_duckdb(spark, name):
    df = registry.QUERIES[name](spark, DATA)
    rows = [tuple(r[c] for c in sorted(df.columns)) for r in df.collect()]
    if name not in registry.ORACLE_SQL:
        assert rows
        return
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    want = con.sql(registry.ORACLE_SQL[name])
    at = [want.columns.index(c) for c in sorted(df.columns)]
    assert sorted(want.columns) == sorted(df.columns)
    held = [tuple(r[i] for i in at) for r in want.fetchall()]
    assert sorted(tuple(map(shown, r)) for r in rows) == sorted(tuple(map(shown, r)) for r in held)
