"""Queries of the corpus operators against their SQL, on the smallest tables."""

import os

import pytest

from survista.llm import registry

SF = "/root/testdata/sf0.001"
TABLES = "documents embeddings conversations".split()


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")
@pytest.mark.parametrize("name", [*registry.ORACLE])
def test_against_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = registry.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    show = lambda rows: sorted(tuple(f"{v:.9g}" if isinstance(v, float) else str(v) for v in r) for r in rows)
    listed = ", ".join(f'"{c}"' for c in cols)
    assert show(df.select(*cols).collect()) == show(con.sql(f"SELECT {listed} FROM ({registry.ORACLE[name]})").fetchall())
