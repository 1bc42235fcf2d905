import math
import warnings

import numpy as np
import pytest
from helpers import FIVE, lives, records
from hypothesis import given, settings
from hypothesis import strategies as st

import survista as S
from survista.functions.linalg import Dependent, cholesky, solve
from survista.operators import chart
from survista.operators.batch import FitFailure
from survista.operators.fit import NotDisjoint, Table, newton
from survista.operators.simulate import hash_uniform
from survista.plans.expr import i, t, x


@pytest.fixture(scope="module")
def many(spark):
    """Simulated lives whose hazard depends on age and sex."""
    rng = np.random.default_rng(11)
    n = 2000
    rows = [(k, int((2015 - 60 - 25 * u) * 534360), bool(s), float(p)) for k, (u, s, p) in enumerate(zip(rng.random(n), rng.random(n) < 0.5, np.exp(9 + 0.7 * rng.standard_normal(n)), strict=True))]
    df = S.as_times(spark.createDataFrame(rows, "uid bigint, birth bigint, male boolean, pension double"), ["birth"])
    truth = S.mortality(-2.6 + 0.1 * (x - 75) + 0.4 * (i.male * 1.0))
    d = S.simulate(truth, df, 2015, 2020, seed=4)
    return S.ExpData(d.df.cache(), d.kinds, d.exp_start, d.exp_end)


G = S.gompertz_mortality(-3.0, 0.09, 75, 0.0, 2015)


def test_intercept_is_log_a_over_e(many):
    (a, e, _), = records(S.aev(many, G, overdispersion=1))
    f = S.fit(many, S.model(G, S.covariates(one=1.0)), test_mortality=G, overdispersion=2, tolerance=1e-14)
    assert f.converged and f.coef()["one"] == pytest.approx(math.log(a / e)) and f.vcov()[0, 0] == pytest.approx(2 / a)
    assert f.penalty == pytest.approx(1) and f.Z == 1 and f.deaths == a
    (a2, e2, _), = records(S.aev(many, f.mortality, overdispersion=1))
    assert e2 == pytest.approx(a2)


def test_groups_and_truth(many):
    f = S.fit(many, S.model(G, S.disjoint(m=i.male, f=~i.male)), test_mortality=G, overdispersion=1, tolerance=1e-14)
    for n, (a, e, _) in zip(("m", "f"), records(S.aev(many, G, breakdown=S.includes(S.include(i.male), S.include(~i.male)), overdispersion=1)), strict=True):
        assert f.coef()[n] == pytest.approx(math.log(a / e))
    assert f.vcov()[0, 1] == pytest.approx(0, abs=1e-12)
    g = S.fit(many, S.model(S.mortality_const(log_mu=0.0), S.covariates(one=1.0, age=x - 75, male=i.male)), test_mortality=G, overdispersion=1)
    for name, want in (("one", -2.6), ("age", 0.1), ("male", 0.4)):
        se = g.summary()[g.names.index(name)]["stddev"]
        assert abs(g.coef()[name] - want) < 4 * se


def test_walks_on_the_driver_and_apart_agree(many, monkeypatch):
    """Slots collected, or listed anew by each walk; models that share a table, kept on the driver or not."""
    models = [S.model(G, S.covariates(one=1.0), "a"), S.model(G, S.covariates(one=1.0, male=i.male), "b"), S.model(G, S.covariates(one=1.0, age=x - 75), "c")]
    run = lambda: S.compare_models(many, models, weight=i.pension / 1000, test_mortality=G, overdispersion=1.5)
    near = run()
    monkeypatch.setattr("survista.operators.fit.CELLS", 0)
    monkeypatch.setattr("survista.operators.fit.DRIVER", 0)
    for f, g in zip(near.fits, run().fits, strict=True):
        assert f.name == g.name and f.iterations == g.iterations > 1 and f.penalised == pytest.approx(g.penalised, rel=1e-9)
        assert f.coefficients == pytest.approx(g.coefficients, rel=1e-8) and f.vcov() == pytest.approx(g.vcov(), rel=1e-7)


def test_simulation_solved_and_walked_agree(spark):
    """The slot of death by the geometric series, and slot by slot, over all steps and slopes."""
    df = S.as_times(spark.range(400).selectExpr("id AS uid", "cast((1920 + id % 60) * 534360 AS bigint) AS birth", "cast((2010 + (id % 7) / 7) * 534360 AS bigint) AS E2R_start"), ["birth", "E2R_start"])
    for slope, step in ((0.1, 1), (-0.2, 1 / 4), (0.0, 1 / 12), (1e-14, 1 / 60)):
        solved = S.gompertz_mortality(-1.5, slope, 75, 0.0, 2015)
        walked = S.mortality(solved.as_node() + 0.0 * t * t)
        show = lambda m, step=step: sorted(map(tuple, S.simulate(m, df, 2010, 2016, seed=3, time_scale=step).df.select("uid", "E2R_end", "E2R_died").collect()))
        got = show(solved)
        assert got == show(walked) and 20 < sum(r[2] for r in got) < 400


def test_batch_is_checked_before_it_runs(many, monkeypatch):
    monkeypatch.setattr("survista.operators.fit.table_of", lambda *a: pytest.fail("it ran"))
    good = S.element("fit", S.model(G, S.covariates(one=1.0)))
    for bad in (S.element("fit", "no model"), S.element("aev", "x +"), S.element("fit", S.model(G, S.covariates(one=1.0)), Z=1.0, overdispersion=-1)):
        with pytest.raises(ValueError):
            S.batch(many, {"a": good, "b": bad}, test_mortality=G, overdispersion=1)


def test_time_varying_and_static_agree(many):
    """The same model once by the closed form, once by slots."""
    a = S.fit(many, S.model(G, S.covariates(one=1.0, male=i.male)), weight=i.pension / 1000, test_mortality=G, overdispersion=1)
    b = S.fit(many, S.model(S.mortality(G.as_node() + 0.0 * t * t), S.covariates(one=1.0, male=i.male)), weight=i.pension / 1000, test_mortality=G, overdispersion=1)
    assert a.coefficients == pytest.approx(b.coefficients, rel=1e-9) and a.Z == pytest.approx(b.Z) and a.Z != 1
    assert a.vcov() == pytest.approx(b.vcov(), rel=1e-8)


def test_driver_and_cluster_walks_agree(spark):
    rng = np.random.default_rng(2)
    rows = np.column_stack([rng.normal(size=(50, 2)), rng.random((50, 2)), rng.integers(0, 3, 50), rng.normal(size=50)])
    rows[:, 5] *= rows[:, 4] > 0
    df = spark.createDataFrame([tuple(map(float, r)) for r in rows], "x0 double, x1 double, m1 double, m2 double, d double, dl double")
    beta = np.array([0.3, -0.2])
    p, q = Table(2, rows=rows).walk(beta), Table(2, df=df).walk(beta)
    for k in ("a", "e", "sa", "se", "information", "squared"):
        assert np.allclose(getattr(p, k), getattr(q, k))


def test_failures(many):
    m = S.model(G, S.covariates(a=i.male, b=i.male * 2.0, one=1.0))
    assert S.fit(many, m, test_mortality=G, overdispersion=1).status == "not_identifiable"
    with pytest.raises(NotDisjoint):
        S.fit(many, S.model(G, S.disjoint(a=i.male, b=i.pension > 0)), test_mortality=G, overdispersion=1)
    for bad in ({}, {"test_mortality": G, "Z": 1.0}, {"Z": -1.0}):
        with pytest.raises(ValueError):
            S.fit(many, m, overdispersion=1, **bad)
    got = S.batch(many, {"a": S.element("aev", G), "f": S.element("fit", S.model(G, S.disjoint(a=i.male, b=i.pension > 0)))}, test_mortality=G, overdispersion=1)
    assert isinstance(got["f"], FitFailure) and records(got["a"]) == records(S.aev(many, G, overdispersion=1))
    with pytest.raises(ValueError):
        S.element("simulate")


def test_comparison_and_diagnosis(many):
    models = [S.model(G, S.covariates(one=1.0), "level"), S.model(G, S.covariates(one=1.0, male=i.male), "sex"), S.model(G, S.covariates(a=i.male, b=i.male), "bad")]
    with warnings.catch_warnings(record=True) as w:
        warnings.simplefilter("always")
        c = S.compare_models(many, models, test_mortality=G, overdispersion=1)
    assert [f.name for f in c.fits] == ["sex", "level", "bad"] and "1 of 3" in str(w[-1].message) and S.best_fit(c).name == "sex"
    assert c.summary()[2]["L_P"] is None
    d = S.diagnose(many, c, {"sex": S.includes(S.include(i.male).named("m"), S.include(~i.male).named("f"))})
    rows = records(d.of("sex", "sex"))
    assert all(a == pytest.approx(e, rel=1e-4) for a, e, _ in rows) and d.df.count() == 4
    alone = S.aev(many, c.fits[0].mortality, breakdown=S.includes(S.include(i.male), S.include(~i.male)), overdispersion=1)
    assert np.allclose(rows, records(alone))


def test_overdispersion_scales_with_copies(many, spark):
    from pyspark.sql import functions as F

    cells = S.ages(60, 90, by=5)
    one = S.measure_overdispersion(many, G, cells)
    thrice = S.ExpData(many.df.withColumn("copy", F.explode(F.array(*map(F.lit, (1, 2, 3))))), many.kinds, many.exp_start, many.exp_end)
    three = S.measure_overdispersion(thrice, G, cells)
    assert three.estimate == pytest.approx(3 * one.estimate) and one.low_95pc < one.estimate < one.high_95pc
    with pytest.raises(ValueError):
        S.measure_overdispersion(many, G, cells, parameter_count=99)


def test_simulated_deaths(spark):
    from pyspark.sql import functions as F

    rows = [(1, 1950 * 534360, 0.0), (2, 1950 * 534360, 0.0)]
    df = S.as_times(spark.createDataFrame(rows, "uid bigint, birth bigint, pension double"), ["birth"])
    u = F.when(F.col("uid") == 1, F.lit(math.exp(-0.25))).otherwise(F.lit(math.exp(-9.0)))
    d = S.simulate(S.mortality_const(mu=0.1), df, 2015, 2020, uniform=u)
    got = {r["uid"]: (r["E2R_end"] / 534360, r["E2R_died"]) for r in d.df.collect()}
    assert got == {1: (2017.5, True), 2: (2020.0, False)}
    with pytest.raises(ValueError):
        S.simulate(G, df.withColumn("E2R_died", F.lit(True)), 2015, 2020)
    v = [r[0] for r in spark.range(2000).select(hash_uniform(1, F.col("id"))).collect()]
    assert 0 < min(v) and max(v) < 1 and abs(np.mean(v) - 0.5) < 0.03


@settings(max_examples=50)
@given(st.integers(1, 6), st.integers(0, 10**6))
def test_cholesky(n, seed):
    m = np.random.default_rng(seed).normal(size=(n + 3, n))
    a = m.T @ m
    low = cholesky(a)
    if not isinstance(low, Dependent):
        assert np.allclose(low @ low.T, a) and np.allclose(a @ solve(low, np.ones(n)), 1)


def test_dependent_column():
    a = np.array([[1.0, 2, 0], [2, 4, 0], [0, 0, 1]])
    got = cholesky(a)
    assert isinstance(got, Dependent) and got.at == 1 and got.of == pytest.approx([2])


def test_covariate_algebra():
    a, b = S.covariates(p=i.u, q=i.v), S.disjoint(m=i.male)
    assert (a * b).names == ["p.m", "q.m"] and (a * b).disjoint and not (b + a).disjoint and (a * i.w).names == ["p", "q"]
    assert S.is_disjoint(b) and S.is_covariates(a) and len(S.covariates(a, S.categories(i.s, "F", "O"))) == 4
    with pytest.raises(ValueError):
        S.disjoint(x)
    with pytest.raises(ValueError):
        S.model(G, [])


def test_tables_of_q():
    q = -np.expm1(-np.exp(np.fromfunction(lambda a, p: -4 + 0.13 * a - 0.01 * p + 0.001 * np.sin(a * p), (4, 5))))
    m = -np.log1p(-q)
    got = np.exp(S.operators.mortality.log_mu_from_q(q))
    assert got[1, 2] == pytest.approx(m[1, 2] - (m[2, 3] - 2 * m[1, 2] + m[0, 1]) / 24)
    assert got[2, 0] == pytest.approx(m[2, 0] - (m[3, 0] - 2 * m[2, 0] + m[1, 0]) / 24)
    assert got[0, 3] == m[0, 3] and got[3, 1] == m[3, 1]
    table = S.mortality_table(60, 2010, q=q)
    assert S.end_age(table).years == 64.5
    for bad in ({}, {"q": q, "mu": q}, {"mu": -q}, {"log_mu": q[0]}):
        with pytest.raises(ValueError):
            S.mortality_table(60, 2010, **bad)
    with pytest.raises(ValueError):
        S.mortality_const(q=0.1, mu=0.1)


def test_chart(spark):
    a = S.create_aev(spark, [10.0, 0.0, 500.0, float("nan"), 1.0], [10.0, 0.0, 10.0, 1.0, 9.0], [10.0, 0.0, 10.0, 1.0, 0.01], groups=["a", "a", "b", "a", "a"])
    rows = chart.plot_frame(a).orderBy("ord").collect()
    assert [r["status"] for r in rows] == ["ok", "empty", "off_scale", "missing", "off_scale"]
    assert [r["chevron"] for r in rows] == [None, None, "up", None, "down"] and [r["group_run"] for r in rows] == [1, 1, 2, 3, 3]
    assert chart.breaks() == pytest.approx([k / 10 for k in range(-5, 6)])
    with pytest.raises(ValueError, match="would do"):
        chart.check_scale((-0.5, 0.5), 0.2)


def test_stream(spark, tmp_path):
    from survista.streaming.accumulate import stream_aev

    d = lives(spark, FIVE, 2015, 2020)
    d.df.write.parquet(str(tmp_path / "in"))
    src = spark.readStream.schema(d.df.schema).parquet(str(tmp_path / "in"))
    live = S.ExpData(src, d.kinds, d.exp_start, d.exp_end)
    stream_aev(live, G, str(tmp_path / "out"), str(tmp_path / "cp"), breakdown=S.includes(S.include(i.male), S.include(~i.male)), overdispersion=2).awaitTermination()
    got = {r["ord"]: (r["A"], r["E"], r["V"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    want = records(S.aev(d, G, breakdown=S.includes(S.include(i.male), S.include(~i.male)), overdispersion=2))
    assert [got[1], got[2]] == [pytest.approx(w) for w in want]


SIZES = [3.0**k for k in range(0, 20)]


def given_tables(monkeypatch, table: Table) -> None:
    """Fits take this table in place of one made of lives."""
    for where in ("fit", "compare"):
        monkeypatch.setattr(f"survista.operators.{where}.clipped", lambda *a: None)
        monkeypatch.setattr(f"survista.operators.{where}.table_of", lambda *a: table)
        monkeypatch.setattr(f"survista.operators.{where}.scale_of", lambda *a: (1.0, 1.0, 1.0))


LEVEL = S.model(G, S.covariates(one=1.0), "level")


def grouped(size: float, groups: int, seed: int, squared: float = 1.0) -> tuple[Table, np.ndarray]:
    """The table of disjoint groups that cover, and their log A / E."""
    rng = np.random.default_rng(seed)
    e = size * rng.uniform(50, 200, groups)
    a = np.ceil(e * np.exp(rng.uniform(-0.3, 0.8, groups)))
    return Table(groups, rows=np.column_stack([np.eye(groups), e, squared * e, a, -2.1 * a])), np.log(a / e)


def test_one_step_more_when_its_gain_drowns_in_rounding():
    for seed, size in enumerate(SIZES * 4):
        table, want = grouped(size, 1, seed)
        got = newton(table.walk, 1, 1.0, 1.0, tolerance=1e-14)
        assert got["status"] == "converged" and got["beta"] == pytest.approx(want, abs=1e-7)


def test_batch_of_many_lives(many, monkeypatch):
    for seed, size in enumerate(SIZES):
        table, want = grouped(size, 1, seed)
        given_tables(monkeypatch, table)
        f = S.batch(many, {"level": S.element("fit", LEVEL)}, test_mortality=G, overdispersion=1.5, tolerance=1e-14)["level"]
        assert f.converged and f.coefficients == pytest.approx(want, abs=1e-7) and f.variance[0, 0] == pytest.approx(1.5 / table.rows[0, 3])


def compared(size: float, seed: int, k: int) -> tuple[Table, np.ndarray, list]:
    """The table that a level and k groups share, their log A / E, and the models."""
    table, want = grouped(size, k, seed)
    marks = [S.covariates(**{f"g{n}": i.pension > n}) for n in range(k)]
    models = [LEVEL, S.model(G, sum(marks[1:], marks[0]), "groups")]
    return Table(k + 1, rows=np.column_stack([np.ones(k), table.rows])), want, models


def test_best_of_models_of_many_lives(many, monkeypatch):
    for seed, size in enumerate(SIZES):
        table, want, models = compared(size, seed, 2)
        given_tables(monkeypatch, table)
        c = S.compare_models(many, models, test_mortality=G, overdispersion=1, tolerance=1e-14)
        f = S.best_fit(c)
        assert all(f.converged for f in c.fits) and (f.name == "level" or f.coefficients == pytest.approx(want, abs=1e-7))


def test_disjoint_groups_of_many_lives():
    for seed, size in enumerate(SIZES):
        table, want = grouped(size, 5, seed)
        got = newton(table.walk, 5, 1.0, 1.0, tolerance=1e-14)
        assert got["status"] == "converged" and got["beta"] == pytest.approx(want, abs=1e-7)
        assert np.diag(got["variance"]) == pytest.approx(1 / table.rows[:, 7])


def test_weighted_groups_of_many_lives():
    for seed, size in enumerate(SIZES):
        table, want = grouped(size, 5, seed, squared=150.0)
        got = newton(table.walk, 5, 1.5, 160.0, tolerance=1e-14)
        assert got["status"] == "converged" and got["beta"] == pytest.approx(want, abs=1e-6) and got["penalty"] == pytest.approx(5 * 150 / 160)


def test_intercept_of_many_lives(many, monkeypatch):
    for seed, size in enumerate(SIZES):
        table, want = grouped(size, 1, seed + 200)
        given_tables(monkeypatch, table)
        f = S.fit(many, LEVEL, test_mortality=G, overdispersion=1.5, tolerance=1e-14)
        assert f.converged and f.coefficients == pytest.approx(want, abs=1e-7) and f.variance[0, 0] == pytest.approx(1.5 / table.rows[0, 3])


def test_diagnosis_of_many_lives(many, monkeypatch):
    for seed, size in enumerate(SIZES):
        with monkeypatch.context() as m:
            given_tables(m, grouped(size, 1, seed + 100)[0])
            f = S.fit(many, LEVEL, test_mortality=G, overdispersion=1, tolerance=1e-14)
        assert f.converged
    assert len(records(S.diagnose(many, f, {"all": S.includes(S.include(i.pension > 0))}).of("level", "all"))) == 1


def test_ranks_of_many_lives(many, monkeypatch):
    for seed, size in enumerate(SIZES):
        table, _, models = compared(size, seed, 5)
        given_tables(monkeypatch, table)
        ranked = S.compare_models(many, models, test_mortality=G, overdispersion=1, tolerance=1e-14).summary()
        assert [(r["rank"], r["status"]) for r in ranked] == [(1, "converged"), (2, "converged")] and ranked[0]["L_P"] >= ranked[1]["L_P"]
