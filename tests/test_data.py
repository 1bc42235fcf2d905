import pytest
from helpers import FIVE, lives

import survista as S
from survista.sources.data import DataError, stats


def spans(d):
    return sorted((r["birth"] // S.functions.clicks.CLICKS, r["E2R_start"] / 534360, r["E2R_end"] / 534360, r["E2R_died"]) for r in d.df.collect())


def test_trimming(spark):
    d = lives(spark, {"birth": [1950] * 6, "E2R_start": [2000, 2000, 2005, 2009, 2010, 2001], "E2R_end": [2015, 2010, 2010, 2012, 2011, 2004], "E2R_died": [True] * 6, "count": [1.0, 1.0, 1.0, 1.0, 1.0, 0.0]}, 2003, 2010)
    assert [s[1:] for s in spans(d)] == [(2003, 2010, False), (2003, 2010, True), (2005, 2010, True), (2009, 2010, False)]


@pytest.mark.parametrize("change, say", [({"E2R_start": [2021] * 5}, "after"), ({"Uid": [1.0] * 5}, "written"), ({"e2r": [1.0] * 5}, "e2r"), ({"a.b": [1.0] * 5}, "full stop"), ({"count": [-1.0] * 5}, "count")])
def test_refusals(spark, change, say):
    columns = FIVE | change
    with pytest.raises(DataError, match=say):
        if "a.b" in change:
            S.exp_data(spark.createDataFrame([(1,)], "`a.b` int"), 2000, 2001)
        if "Birth" in change:
            S.exp_data(spark.createDataFrame([(1,)], "Birth int"), 2000, 2001)
        lives(spark, columns, 2015, 2020)


def test_missing_values(spark):
    df = S.as_times(spark.createDataFrame([(1000 * 534360, 2000 * 534360, 2001 * 534360, False, None, "a"), (1950 * 534360, 2000 * 534360, 2001 * 534360, False, 2.0, None)], "birth bigint, E2R_start bigint, E2R_end bigint, E2R_died boolean, u double, name string"), ["birth", "E2R_start", "E2R_end"])
    with pytest.raises(DataError, match="name"):
        S.exp_data(df, 2000, 2001)
    d = S.exp_data(df.drop("name"), 2000, 2001)
    assert sorted(str(r["u"]) for r in d.df.collect()) == ["2.0", "nan"]
    s = stats(d)
    assert s["u"]["has_missing"] and s["u"]["min"] == 2.0 and s["birth"]["has_values"]


def test_snapshot(spark):
    years = {"birth": [1950] * 4, "E2R_start": [2000, 2004, 2000, 2000], "E2R_end": [2004, 2008, 2008, 2004], "E2R_died": [True, False, False, False], "tag": ["died", "starts", "over", "ends"]}
    d = lives(spark, years, 2000, 2008)
    assert sorted(r["tag"] for r in S.val_from_exp_data(d, 2004).df.collect()) == ["ends", "over", "starts"]
    v = S.val_from_exp_data(d)
    assert sorted(r["tag"] for r in v.df.collect()) == ["over", "starts"] and S.as_at(v).years == 2008
    assert S.is_val_data(v) and S.is_exp_data(d) and "E2R_end" not in v.df.columns


def test_new_columns(spark):
    from pyspark.sql import functions as F

    d = lives(spark, FIVE, 2015, 2020).with_column("big", F.col("pension") > 10000)
    assert d.kinds["big"] == "bool" and d.df.where("big").count() == 3
