"""Lives for tests, from years."""

from survista import as_times, exp_data
from survista.functions.clicks import instant


def lives(spark, columns: dict, start, end, **how):
    """columns: birth, E2R_start, E2R_end in years, the rest as they are."""
    times = [c for c in ("birth", "E2R_start", "E2R_end", "entry") if c in columns]
    cols = {k: [instant(v).clicks for v in vs] if k in times else vs for k, vs in columns.items()}
    rows = list(zip(*cols.values(), strict=True))
    kinds = {bool: "boolean", float: "double", int: "bigint", str: "string"}
    schema = ", ".join(f"{k} {'bigint' if k in times else kinds[type(vs[0])]}" for k, vs in cols.items())
    return exp_data(as_times(spark.createDataFrame(rows, schema), times), start, end, **how)


def records(a):
    return [(r["A"], r["E"], r["V"]) for r in a.df.orderBy("ord").collect()]


FIVE = {
    "birth": [1945, 1950, 1955, 1940, 1948],
    "E2R_start": [2015] * 5,
    "E2R_end": [2020, 2020, 2018, 2020, 2019],
    "E2R_died": [False, False, True, False, True],
    "pension": [5000.0, 12000.0, 30000.0, 8000.0, 15000.0],
    "male": [True, False, True, False, True],
}
