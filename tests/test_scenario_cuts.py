"""Scenarios as cuts of one table of weeks give the models that copies of the episodes give."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from recurra import config as c
from recurra.config import Emigration
from recurra.operators import design, gee, scenarios
from recurra.plans import derive, registry
from recurra.session import materialize, tune
from recurra.sources import starschema as star

SF = "/root/testdata/sf0.001"
# Nobody leaves, some do, nearly all do at once.
ROWS = [Emigration("none", 0.0, 1), Emigration("some", 0.3, 7), Emigration("most", 40.0, 9)]


@pytest.fixture(scope="module")
def episodes(spark):
    return materialize(registry._episodes(tune(spark), SF), "episodes")


@pytest.fixture(scope="module")
def copies(episodes):
    weeks = derive.person_time(derive.scenario_episodes(episodes, ROWS, star.YEARS), registry.DEAD)
    return materialize(weeks, "copies")


@pytest.fixture(scope="module")
def cut(episodes):
    weeks = scenarios.cuttable_weeks(episodes, registry.DEAD, star.YEARS)
    return materialize(gee.nest_weeks(weeks, scenarios.cut_days(ROWS)), "cut")


# Few knots, so that the smallest tables have an event everywhere and the fits a single answer.
SPECS = [
    c.PERIOD_ONLY,
    c.EMIGRATION_MI.but(name="plain_waves", age_knots=(3.0,), time_knots=(1.0,)),
    c.EMIGRATION_SWEEP.but(name="part", age_knots=(3.0,), time_knots=(1.0,), max_age=12.0, max_time=6.0),
    c.PIECEWISE.but(name="bands", age_knots=(3.0,), bands=(-1.0, 0.0, 1.0, 10.0)),
]


@pytest.mark.parametrize("spec", SPECS, ids=lambda s: s.name)
def test_models_of_cuts_equal_models_of_copies(copies, cut, spec):
    by_copy = {r.model_id: r for r in gee.fit_gee(copies, spec).nested().collect()}
    fits = gee.fit_nested(cut, spec, cuts=[s.scenario_id for s in ROWS])
    by_cut = {r.model_id: r for r in fits.nested().collect()}
    assert set(by_cut) == set(by_copy) and len(by_cut) == 3
    for name, row in by_copy.items():
        np.testing.assert_allclose(by_cut[name].beta, row.beta, rtol=1e-5, atol=1e-6)
        np.testing.assert_allclose(np.array(by_cut[name].vcov), np.array(row.vcov), rtol=1e-4, atol=1e-7)


def test_one_scenario_alone(cut):
    options = {"cuts": [s.scenario_id for s in ROWS]}
    both = gee.fit_nested(cut, c.PERIOD_ONLY, **options)
    one = gee.fit_nested(cut, c.PERIOD_ONLY, only=["some"], **options)
    assert [r.model_id for r in one.stats.collect()] == ["period_only:some"]
    key = lambda s: sorted((r.term, round(r.beta, 9)) for r in s.coef.collect() if r.model_id == "period_only:some")
    assert key(one) == key(both)


def test_cuts_and_calendar_years_exclude_each_other(cut):
    with pytest.raises(ValueError):
        gee.fit_nested(cut, c.CALENDAR, cuts=[s.scenario_id for s in ROWS])


def test_design_in_the_scan_equals_design_in_columns(spark):
    times = [-1.0, 0.0, 0.01, c.WASHOUT_YEARS, 1 / 12, 0.4, 2.0, 9.9, 10.0, 11.0]
    rows = [(0.3 + k * 0.9, t, sex, 2000 + k) for k, t in enumerate(times) for sex in ("male", "female")]
    df = spark.createDataFrame(rows, "age_at_infection double, time_after_index double, sex string, calendar_year int")
    for spec in [*c.MODEL_SPECS.values(), c.BANDS_ONLY, c.PERIOD_ONLY]:
        wanted = {tuple(r)[:4]: r.x for r in design.with_design(df, spec).collect()}
        age, time, male, year = (np.array(v, float) for v in zip(*((a, t, s == "male", y) for a, t, s, y in rows)))
        got = design.matrix(spec, age, time, male, year)
        for row, x in zip(rows, got):
            if wanted[row] is None:
                assert np.isnan(x).any()
            else:
                np.testing.assert_allclose(x, wanted[row], rtol=1e-9, atol=1e-9)


def test_missing_covariates_count_by_what_a_model_uses(spark):
    schema = "patid bigint, age_at_infection double, time_after_index double, offset_time double, status bigint, period string, sex string, infection_type string, hospitalization int, district string, week int, n_days bigint, calendar_year int"
    rows = [(p, 1.0 + k / 52, -1.0 if k < 5 else k / 52, -4.0, int((p + k) % 3 == 0), "before" if k < 5 else "after", None if p == 1 else "male", "x", 1, "d", k, 7, None) for p in range(6) for k in range(12)]
    df = spark.createDataFrame(rows, schema)
    plain = gee.fit_gee(df, c.PERIOD_ONLY).stats.first()
    spec = c.PERIOD_ONLY.but(sex_effect=True)
    sexed = gee.fit_gee(df, spec).stats.first()
    assert (plain.n_rows, plain.n_subjects) == (72, 6) and (sexed.n_rows, sexed.n_subjects) == (60, 5)
    assert gee.nest_subjects(df, spec).count() == 5
    with pytest.raises(gee.FitError):
        gee.fit_gee(df, c.PERIOD_ONLY.but(calendar=True))


def test_nesting_moves_weeks_once(spark):
    plan = gee.nest_weeks(registry._weeks(tune(spark), SF))._jdf.queryExecution().executedPlan().toString()
    alone = registry._weeks(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == alone.count("Exchange hashpartitioning") > 0
