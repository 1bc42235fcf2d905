import os

import pytest

import __spark_entry__ as entry
from survista.plans import queries_more

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
needs_data = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@needs_data
def test_entry(spark):
    assert entry.entry(spark).count() > 0


@needs_data
@pytest.mark.parametrize("name", ["aev_gompertz_lives", "aev_table_lookup", "aev_overlapping_breakdown", "simulate_hash_uniform", "fit_disjoint_groups", "chart_status", *queries_more.ORACLE])
def test_against_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = entry.queries()[name](spark, SF)
    cols = sorted(df.columns)
    show = lambda rows: sorted(tuple(f"{v:.9g}" if isinstance(v, float) else str(v) for v in r) for r in rows)
    want = con.sql(entry.oracle_sql()[name])
    assert sorted(want.columns) == cols
    listed = ", ".join(f'"{c}"' for c in cols)
    assert show(df.select(*[f"`{c}`" for c in cols]).collect()) == show(con.sql(f"SELECT {listed} FROM ({entry.oracle_sql()[name]})").fetchall())
