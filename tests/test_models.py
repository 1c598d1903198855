import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from recurra import config as c
from recurra.functions.spline import natural_spline, ns_basis
from recurra.functions.stats import chi2_sf
from recurra.operators import contrasts, design, gee
from recurra.operators.persontime import crude_irr

SPEC = c.ModelSpec("small", age_knots=(1.0, 2.0), time_effect="step")
WEEK_SCHEMA = (
    "patid bigint, age_at_infection double, time_after_index double, offset_time double, status bigint, "
    "period string, sex string, infection_type string, hospitalization int, district string, week int, "
    "n_days bigint, calendar_year int")


def make_weeks(seed=5, subjects=80):
    rng = np.random.default_rng(seed)
    rows = []
    for patid in range(subjects):
        sex = "male" if patid % 2 else "female"
        frailty = rng.gamma(2.0, 0.5)
        for k in range(int(rng.integers(6, 30))):
            after = k >= 4
            days = int(rng.integers(1, 8))
            rate = 8 * frailty * (1.8 if after else 1.0)
            status = int(rng.poisson(rate * days / 365))
            age = 0.5 + k * 7 / 365 + patid / 40
            rows.append((
                patid, age, (k + 1) * 7 / 365 if after else -1.0, math.log(days / 365), status,
                "after" if after else "before", sex, "x", 1, "d", k, days, 2006))
    return rows


@pytest.fixture(scope="module")
def weeks(spark):
    return spark.createDataFrame(make_weeks(), WEEK_SCHEMA).cache()


@pytest.fixture(scope="module")
def store(weeks):
    return gee.fit_gee(weeks, SPEC)


def dense_fit(weeks, spec):
    """The same model with explicit inverse correlation matrices, subject by subject."""
    nested = gee.nest_subjects(weeks, spec).collect()
    p = len(design.terms(spec))
    data = [(np.array(r.wave), np.array(r.y), np.array(r.offset), np.array(r.x).reshape(-1, p)) for r in nested]
    beta, alpha = np.zeros(p), 0.0
    beta[0] = math.log(sum(y.sum() for _, y, _, _ in data) / sum(np.exp(o).sum() for _, _, o, _ in data))
    for _ in range(40):
        info, score, meat = np.zeros((p, p)), np.zeros(p), np.zeros((p, p))
        squares = products = pairs = n = 0
        for wave, y, offset, x in data:
            mu = np.exp(x @ beta + offset)
            root = np.sqrt(mu)
            corr = alpha ** np.abs(wave[:, None] - wave[None, :]) if alpha else np.eye(len(y))
            inv = np.linalg.inv(corr)
            e, xs = (y - mu) / root, x * root[:, None]
            info += xs.T @ inv @ xs
            u = xs.T @ inv @ e
            score += u
            meat += np.outer(u, u)
            near = np.diff(wave) == 1
            squares, n = squares + e @ e, n + len(y)
            products, pairs = products + (e[1:] * e[:-1])[near].sum(), pairs + near.sum()
        inverse = np.linalg.inv(info)
        step = inverse @ score
        beta = beta + step
        if spec.correlation == "ar1":
            alpha = products / pairs / (squares / (n - p))
        if np.abs(step).max() < 1e-12:
            break
    return beta, inverse @ meat @ inverse, alpha


def test_fit_equals_dense_matrices(weeks, store):
    beta, vcov, alpha = dense_fit(weeks, SPEC)
    got = store.nested().first()
    assert got.terms == design.terms(SPEC)
    np.testing.assert_allclose(got.beta, beta, rtol=1e-6, atol=1e-8)
    np.testing.assert_allclose(np.array(got.vcov), vcov, rtol=1e-5, atol=1e-9)
    stats = store.stats.first()
    assert stats.converged and abs(stats.alpha - alpha) < 1e-6 and abs(alpha) > 1e-3


def test_strong_negative_and_positive_correlation_weights():
    import pyarrow as pa

    rng = np.random.default_rng(1)
    for alpha in (0.7, -0.4):
        waves = [np.array([1, 2, 4, 5]), np.array([3]), np.array([2, 6, 7])]
        x = rng.normal(size=(8, 2))
        y = rng.poisson(1.0, 8).astype(float)
        batch = pa.RecordBatch.from_pydict({
            "scenario_id": ["all"] * 3, "wave": [w.tolist() for w in waves],
            "y": [y[:4].tolist(), y[4:5].tolist(), y[5:].tolist()],
            "offset": [[0.0] * 4, [0.0], [0.0] * 3],
            "x": [x[:4].ravel().tolist(), x[4:5].ravel().tolist(), x[5:].ravel().tolist()]})
        beta = np.array([0.2, -0.1])
        fit = gee._Fit("m", "all", [0, 1], beta, alpha)
        (_, sums), = gee._batch_sums(batch, [fit], 2, True)
        info, score = np.zeros((2, 2)), np.zeros(2)
        for wave, part in zip(waves, (slice(0, 4), slice(4, 5), slice(5, 8))):
            mu = np.exp(x[part] @ beta)
            corr = np.array([[float(alpha) ** abs(a - b) for b in wave] for a in wave])
            inv, xs = np.linalg.inv(corr), x[part] * np.sqrt(mu)[:, None]
            info += xs.T @ inv @ xs
            score += xs.T @ inv @ ((y[part] - mu) / np.sqrt(mu))
        np.testing.assert_allclose(sums[:4].reshape(2, 2), info)
        np.testing.assert_allclose(sums[4:6], score)


def test_period_model_equals_crude_rate_ratio(weeks):
    fit = contrasts.coef_table(gee.fit_gee(weeks, c.PERIOD_ONLY)).first()
    crude = crude_irr(weeks).first()
    assert abs(fit.estimate - crude.estimate) < 1e-9 and abs(fit.std_err - crude.std_err) < 1e-8


def test_aliased_terms_are_null_and_count_as_zero(weeks):
    store = gee.fit_gee(weeks.where("sex = 'female'"), SPEC)
    values = {r.term: r.beta for r in store.coef.collect()}
    assert values["sexmale"] is None and values["after"] is not None
    row = contrasts.contrast_subset(store, ["^sexmale$"]).first()
    assert row.estimate == 0.0 and row.std_err == 0.0 and row.z is None


def test_scenarios_are_fitted_together_as_they_are_alone(weeks, store):
    both = weeks.withColumn("scenario_id", F.explode(F.array(F.lit("a"), F.lit("b"))))
    both = both.where("scenario_id = 'a' or patid >= 20")
    fits = gee.fit_gee(both, SPEC)
    alone = gee.fit_gee(weeks.where("patid >= 20"), SPEC)
    by_model = {r.model_id: r.beta for r in fits.nested().collect()}
    np.testing.assert_allclose(by_model["small:a"], store.nested().first().beta, rtol=1e-8)
    np.testing.assert_allclose(by_model["small:b"], alone.nested().first().beta, rtol=1e-8)


def test_sequence_tests_each_block_in_the_model_that_adds_it(weeks, store):
    fits, blocks = gee.fit_sequence(weeks, SPEC)
    tested = {r.block: r for r in gee.wald_test(fits, blocks, per_model=True).collect()}
    assert set(tested) == {"sex", "age", "after", "overall"}
    own = contrasts.coef_table(store).where("term = 'after'").first()
    assert abs(tested["after"].chi2 - own.z**2) < 1e-4
    assert tested["overall"].df == sum(tested[b].df for b in blocks)
    assert abs(tested["overall"].chi2 - sum(tested[b].chi2 for b in blocks)) < 1e-9


def test_store_round_trip(spark, store, tmp_path):
    gee.write_model(store, str(tmp_path))
    again = gee.read_model(spark, str(tmp_path))
    assert sorted(again.coef.collect()) == sorted(store.coef.collect())
    assert again.vcov.count() == store.vcov.count()


def test_pairwise_and_pattern_contrasts(store):
    nested = store.nested().first()
    beta, vcov = np.array(nested.beta), np.array(nested.vcov)
    rows = contrasts.pairwise_diffs(store).collect()
    assert len(rows) == len(beta) * (len(beta) - 1) // 2
    i, j = nested.terms.index("sexmale"), nested.terms.index("after")
    row = next(r for r in rows if r.contrast == "sexmale vs. after")
    assert abs(row.estimate - (beta[i] - beta[j])) < 1e-12
    assert abs(row.std_err - math.sqrt(vcov[i, i] + vcov[j, j] - 2 * vcov[i, j])) < 1e-12
    any_of = contrasts.contrast_subset(store, subset=["^after$", "sex"]).collect()
    all_of = contrasts.contrast_subset(store, subint=["ns_age", "2$"]).collect()
    assert {r.term for r in any_of} == {"after", "sexmale"} and {r.term for r in all_of} == {"ns_age2"}
    p = 2 * 0.5 * math.erfc(abs(any_of[0].z) / math.sqrt(2))
    assert abs(any_of[0].p_value - p) < 1e-12


def test_rate_difference_gradient(store):
    nested = store.nested().first()
    beta, vcov = np.array(nested.beta), np.array(nested.vcov)
    grid = contrasts.rate_grid(store, [("t", 1.0)], max_age=0.5, step=0.25)
    x1 = design.with_design(grid, SPEC, "x1", year=F.lit(0))
    x1 = design.with_design(x1, SPEC, "x0", time=F.lit(-1.0), year=F.lit(0))
    key = ["age_at_infection", "sex"]
    rows = contrasts.rate_difference(x1, SPEC).select(*key, "x1", "x0", "estimate", "std_err").collect()
    assert len(rows) == 6

    def value(b, r):
        return math.exp(np.dot(r.x1, b)) - math.exp(np.dot(r.x0, b))

    for r in rows:
        step = 1e-6
        gradient = np.array([
            (value(beta + step * e, r) - value(beta - step * e, r)) / (2 * step) for e in np.eye(len(beta))])
        assert abs(r.estimate - value(beta, r)) < 1e-9
        assert abs(r.std_err - math.sqrt(gradient @ vcov @ gradient)) < 1e-5


def test_draws_follow_the_contrast_distribution(store):
    rows = contrasts.unit_contrasts(store, "^(after|sexmale)$")
    drawn = contrasts.contrast_draws(rows, 4000)
    wide = drawn.groupBy("draw").pivot("term", ["after", "sexmale"]).agg(F.first("value"))
    got = wide.agg(F.avg("after"), F.stddev("after"), F.corr("after", "sexmale")).first()
    nested = store.nested().first()
    i, j = nested.terms.index("after"), nested.terms.index("sexmale")
    vcov = np.array(nested.vcov)
    se = math.sqrt(vcov[i, i])
    assert abs(got[0] - nested.beta[i]) < 4 * se / math.sqrt(4000)
    assert abs(got[1] / se - 1) < 0.06
    assert abs(got[2] - vcov[i, j] / math.sqrt(vcov[i, i] * vcov[j, j])) < 0.06
    again = contrasts.contrast_draws(rows, 4000).agg(F.sum("value")).first()[0]
    assert abs(again - drawn.agg(F.sum("value")).first()[0]) < 1e-9


def test_rubin(spark):
    coef = [("a", 0, "x", 1.0), ("a", 1, "y", 2.0), ("b", 0, "x", 2.0), ("b", 1, "y", 5.0)]
    vcov = [(m, i, j, v) for m, s in (("a", 1.0), ("b", 3.0)) for i, j, v in
            [(0, 0, s), (0, 1, 0.1 * s), (1, 0, 0.1 * s), (1, 1, 2 * s)]]
    stats = [("a", 0.1, 1.0, 5, 2, 3, True), ("b", 0.1, 1.0, 5, 2, 3, True)]
    store = gee.ModelStore(
        spark.createDataFrame(coef, "model_id string, term_idx int, term string, beta double"),
        spark.createDataFrame(vcov, "model_id string, i int, j int, v double"),
        spark.createDataFrame(stats, "model_id string, alpha double, phi double, n_rows bigint, "
                                     "n_subjects bigint, iterations int, converged boolean"))
    got = contrasts.pool_rubin(store).nested().first()
    assert got.beta == [1.5, 3.5]
    np.testing.assert_allclose(got.vcov, [[2 + 1.5 * 0.5, 0.2 + 1.5 * 1.5], [0.2 + 1.5 * 1.5, 4 + 1.5 * 4.5]])


def test_zero_crossing_interpolates(spark):
    rows = [("m", 0.0, 2.0), ("m", 1.0, 1.0), ("m", 2.0, -3.0), ("m", 3.0, 1.0), ("n", 0.0, 1.0), ("n", 1.0, 2.0)]
    curve = spark.createDataFrame(rows, "model_id string, time_after_index double, estimate double")
    got = {r.model_id: r.time_at_zero for r in contrasts.zero_crossing(curve, 0, 5).collect()}
    assert got == {"m": 1.25, "n": None}


def test_spline_is_natural_and_zero_at_the_lower_boundary(spark):
    basis = natural_spline(c.AGE_KNOTS, 0.0, c.AGE_BOUNDARY)
    assert basis.size == 8
    np.testing.assert_allclose(basis.values(np.array([0.0])), 0.0, atol=1e-12)
    beyond = basis.values(np.array([7.5, 8.5, 9.5, 10.5]))
    np.testing.assert_allclose(np.diff(beyond, 2, axis=0), 0.0, atol=1e-6)
    near = basis.values(np.array([0.0, 1e-3, 2e-3]))
    assert np.abs(np.diff(near, 2, axis=0)).max() / 1e-6 < 1.0
    points = np.linspace(0, 12, 40)
    df = spark.createDataFrame([(float(x),) for x in points], "x double")
    got = [r.b for r in df.orderBy("x").select(ns_basis("x", c.AGE_KNOTS, (0.0, c.AGE_BOUNDARY)).alias("b")).collect()]
    np.testing.assert_allclose(got, basis.values(points), atol=1e-7)


def test_number_of_terms():
    sizes = {name: len(design.terms(spec)) for name, spec in c.MODEL_SPECS.items()}
    assert sizes["main"] == 19 and sizes["interaction"] == 39 and sizes["calendar"] == 20
    assert sizes["under4"] == 17 and sizes["piecewise"] == 21
    assert sizes["knots_age6"] == sizes["knots_time6"] == 18


def test_interaction_design_rows(spark):
    df = spark.createDataFrame([(2.0, 1.0, "male", 2006), (3.0, -1.0, "female", 2006)],
                               "age_at_infection double, time_after_index double, sex string, calendar_year int")
    names = design.terms(c.INTERACTION)
    male, female = (dict(zip(names, r.x)) for r in design.with_design(df, c.INTERACTION).collect())
    age1, time1 = design.interaction_splines(c.INTERACTION)
    a, t = age1.values([2.0])[0], time1.values([1.0 - c.WASHOUT_YEARS])[0]
    assert abs(male["ns_age2:ns_time1"] - a[1] * t[0]) < 1e-9
    assert male["sexmale:ns_age3"] == male["ns_age3"] and male["sexmale:ns_time5"] == male["ns_time5"]
    assert female["after"] == 0 and all(v == 0 for n, v in female.items() if "sexmale" in n or "time" in n)


@pytest.mark.parametrize("x, df", [(0.1, 2), (9.5, 4), (30.0, 38), (120.0, 8), (80.0, 38)])
def test_chi2_tail_with_even_degrees(x, df):
    closed = math.exp(-x / 2) * sum((x / 2) ** k / math.factorial(k) for k in range(df // 2))
    assert abs(chi2_sf(x, df) / closed - 1) < 1e-9


def test_chi2_tail_with_one_degree():
    assert abs(chi2_sf(2.5, 1) - math.erfc(math.sqrt(1.25))) < 1e-12
