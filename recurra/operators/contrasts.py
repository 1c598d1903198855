"""Estimates derived from fitted models: contrasts, curves, predictions, pooling.

Grids are exploded from the model store, which has one row per model, so one
plan serves any number of models. Weights and covariances stay array columns.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recurra.config import BANDS, TABLE_TIMES, ModelSpec
from recurra.functions.columns import uniform
from recurra.functions.stats import normal_two_sided_p, z_value
from recurra.operators.design import INTERCEPT, with_design
from recurra.operators.gee import ModelStore

BEFORE_TIME = -1.0


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda u, v: u * v), F.lit(0.0), lambda s, v: s + v)


def _variance(weights: Column, vcov: Column) -> Column:
    """w' V w, row by row of V."""
    return F.aggregate(
        F.zip_with(weights, vcov, lambda w, row: w * _dot(weights, row)),
        F.lit(0.0), lambda s, v: s + v)


def with_interval(rows: DataFrame, alpha: float = 0.05, exp: bool = False) -> DataFrame:
    """From `estimate` and `std_err`: z, two-sided p and limits; exp adds the exponentials."""
    z = F.lit(z_value(alpha))
    out = (
        rows.withColumn("z", F.try_divide("estimate", "std_err"))
        .withColumn("p_value", normal_two_sided_p(F.col("z")))
        .withColumn("lower", F.col("estimate") - z * F.col("std_err"))
        .withColumn("upper", F.col("estimate") + z * F.col("std_err"))
    )
    if exp:
        for name in ("estimate", "lower", "upper"):
            out = out.withColumn(f"exp_{name}", F.exp(name))
    return out


def contrast(rows: DataFrame, alpha: float = 0.05, exp: bool = False) -> DataFrame:
    """Linear contrast per row from columns `weights`, `beta` and `vcov`."""
    weights = F.col("weights")
    out = rows.withColumn("estimate", _dot(weights, F.col("beta"))).withColumn(
        "std_err", F.sqrt(F.greatest(_variance(weights, F.col("vcov")), F.lit(0.0))))
    return with_interval(out, alpha, exp).drop("weights", "beta", "vcov", "terms")


def _unit(position: Column) -> Column:
    size = F.size("beta")
    return F.transform(
        F.sequence(F.lit(0), size - 1), lambda k: F.when(k == position, 1.0).otherwise(0.0))


def contrast_subset(
    store: ModelStore, subset: Sequence[str] | None = None, subint: Sequence[str] | None = None,
    alpha: float = 0.05, exp: bool = False,
) -> DataFrame:
    """Single coefficients whose name matches any pattern of `subset`, or all of `subint`."""
    rows = store.nested().select("*", F.posexplode("terms").alias("term_idx", "term"))
    if subset is not None:
        any_of = F.lit(False)
        for pattern in subset:
            any_of = any_of | F.col("term").rlike(pattern)
        rows = rows.where(any_of)
    if subint is not None:
        for pattern in subint:
            rows = rows.where(F.col("term").rlike(pattern))
    return contrast(rows.withColumn("weights", _unit(F.col("term_idx"))), alpha, exp)


def coef_table(store: ModelStore, alpha: float = 0.05) -> DataFrame:
    """Estimate, robust error, rate ratio with limits and p of every term but the intercept."""
    return contrast_subset(store, alpha=alpha, exp=True).where(F.col("term") != INTERCEPT)


def pairwise_diffs(store: ModelStore, pattern: str | None = None, alpha: float = 0.05) -> DataFrame:
    """Differences of all pairs of a model's coefficients, optionally of those matching a pattern.

    The pairs are the output asked for; their number is set by the terms of the
    specification and does not depend on the data.
    """
    entries = F.transform(
        "terms", lambda t, k: F.struct(k.alias("k"), t.alias("term")))
    if pattern is not None:
        entries = F.filter(entries, lambda e: e["term"].rlike(pattern))
    rows = store.nested().withColumn("_e", entries)
    rows = rows.select("*", F.posexplode("_e").alias("_pos", "_a"))
    rows = rows.select("*", F.explode(F.slice("_e", F.col("_pos") + 2, F.size("_e"))).alias("_b"))
    a, b = F.col("_a.k"), F.col("_b.k")
    element = lambda i, j: F.element_at(F.element_at("vcov", i + 1), j + 1)
    variance = element(a, a) + element(b, b) - 2 * element(a, b)
    return with_interval(
        rows.select(
            "model_id", F.col("_a.term").alias("term_a"), F.col("_b.term").alias("term_b"),
            F.concat_ws(" vs. ", "_a.term", "_b.term").alias("contrast"),
            (F.element_at("beta", a + 1) - F.element_at("beta", b + 1)).alias("estimate"),
            F.sqrt(F.greatest(variance, F.lit(0.0))).alias("std_err")),
        alpha)


def _grid(start: float, stop: float, step: float) -> Column:
    """start, start + step, ... up to stop, as an array."""
    count = int(math.floor((stop - start) / step + 1e-9))
    return F.transform(
        F.sequence(F.lit(0), F.lit(count)), lambda k: F.lit(float(start)) + k * F.lit(float(step)))


def _irr_weights(rows: DataFrame, spec: ModelSpec, age: Column, sex: Column) -> DataFrame:
    """After minus before at the same age and sex: the base terms cancel."""
    year = F.lit(spec.calendar_center)
    rows = with_design(rows, spec, "_x1", age, F.col("time_after_index"), sex, year)
    rows = with_design(rows, spec, "_x0", age, F.lit(BEFORE_TIME), sex, year)
    return rows.withColumn("weights", F.zip_with("_x1", "_x0", lambda u, v: u - v)).drop("_x1", "_x0")


def irr_curve(
    store: ModelStore, spec: ModelSpec, start: float = 2 / 52, stop: float = 10.0, step: float = 0.01,
    age: float = 0.0, sex: str = "female", alpha: float = 0.05, exp: bool = False,
) -> DataFrame:
    """Log rate ratio after versus before by time since the index event, for each model.

    Age and sex matter only in models with interactions.
    """
    rows = store.nested().withColumn("time_after_index", F.explode(_grid(start, stop, step)))
    return contrast(_irr_weights(rows, spec, F.lit(age), F.lit(sex)), alpha, exp)


def irr_table(
    store: ModelStore, spec: ModelSpec, times: Sequence[tuple[str, float]] = TABLE_TIMES,
    age: float = 0.0, sex: str = "female",
) -> DataFrame:
    """Rate ratios with limits at named times, as numbers and as text."""
    points = F.array(*(
        F.struct(F.lit(i).alias("position"), F.lit(label).alias("label"), F.lit(t).alias("time_after_index"))
        for i, (label, t) in enumerate(times, 1)))
    rows = store.nested().withColumn("_p", F.explode(points)).select("*", "_p.*").drop("_p")
    out = contrast(_irr_weights(rows, spec, F.lit(age), F.lit(sex)), exp=True)
    rounded = [F.bround(F.col(f"exp_{n}"), 2) for n in ("estimate", "lower", "upper")]
    text = F.concat(rounded[0], F.lit(" 95% CI("), rounded[1], F.lit(", "), rounded[2], F.lit(")"))
    return out.withColumn("irr", text)


# The times at which the fitted rates are drawn.
RATE_TIMES = [("pre-MeV", BEFORE_TIME), ("2 weeks after MeV", 2 / 52), ("1 month post-MeV", 30 / 365),
              ("2 years post-MeV", 2.0), ("4 years post-MeV", 4.0), ("6 years post-MeV", 6.0)]


def rate_grid(
    store: ModelStore, times: Sequence[tuple[str, float]] = RATE_TIMES,
    max_age: float = 10.0, step: float = 0.01,
) -> DataFrame:
    """Each model at all ages, sexes and times; after the index event the age moves on with time."""
    points = F.array(*(
        F.struct(F.lit(i).alias("position"), F.lit(label).alias("time_label"),
                 F.lit(t).alias("time_after_index"))
        for i, (label, t) in enumerate(times, 1)))
    rows = (
        store.nested().withColumn("_p", F.explode(points))
        .withColumn("sex", F.explode(F.array(F.lit("male"), F.lit("female"))))
        .withColumn("_age", F.explode(_grid(0.0, max_age, step)))
        .select("*", "_p.*")
    )
    shift = F.greatest("time_after_index", F.lit(0.0))
    return rows.withColumn("age_at_infection", F.col("_age") + shift).drop("_p", "_age")


def predict_rate(grid: DataFrame, spec: ModelSpec, alpha: float = 0.05) -> DataFrame:
    """Log rate per person-year with limits."""
    rows = with_design(grid, spec, "weights", year=F.lit(spec.calendar_center))
    return contrast(rows, alpha)


def rate_difference(grid: DataFrame, spec: ModelSpec, alpha: float = 0.05) -> DataFrame:
    """Rate after minus rate before at the same age and sex, with delta-method limits."""
    year = F.lit(spec.calendar_center)
    rows = with_design(grid, spec, "_x1", year=year)
    rows = with_design(rows, spec, "_x0", time=F.lit(BEFORE_TIME), year=year)
    rows = rows.withColumn("_r1", F.exp(_dot(F.col("_x1"), F.col("beta")))).withColumn(
        "_r0", F.exp(_dot(F.col("_x0"), F.col("beta"))))
    gradient = F.zip_with("_x1", "_x0", lambda u, v: u * F.col("_r1") - v * F.col("_r0"))
    rows = rows.withColumn("_g", gradient).withColumn("estimate", F.col("_r1") - F.col("_r0"))
    rows = rows.withColumn("std_err", F.sqrt(F.greatest(_variance(F.col("_g"), F.col("vcov")), F.lit(0.0))))
    return with_interval(rows, alpha).drop("_x1", "_x0", "_r1", "_r0", "_g", "beta", "vcov", "terms")


def zero_crossing(curve: DataFrame, lo: float, hi: float) -> DataFrame:
    """First time in [lo, hi] at which each model's log rate ratio changes sign; NULL if none."""
    window = Window.partitionBy("model_id").orderBy("time_after_index")
    inside = curve.where(F.col("time_after_index").between(lo, hi)).select(
        "model_id", "time_after_index", "estimate")
    pairs = inside.withColumn("_t0", F.lag("time_after_index").over(window)).withColumn(
        "_e0", F.lag("estimate").over(window))
    t, e = F.col("time_after_index"), F.col("estimate")
    crossing = F.when(e == 0, t).when(
        F.signum("_e0") * F.signum(e) < 0, F.col("_t0") + (t - F.col("_t0")) * F.col("_e0") / (F.col("_e0") - e))
    return pairs.withColumn("_c", crossing).groupBy("model_id").agg(F.min("_c").alias("time_at_zero"))


def band_table(store: ModelStore, bands: Sequence[float] = BANDS, alpha: float = 0.05) -> DataFrame:
    """Piecewise-constant model: each band's limits, midpoint and log rate ratio.

    A band without rows has NULL for its estimate, error and limits.
    """
    number = F.regexp_extract("term", r"^band(\d+)$", 1).cast("int")
    rows = contrast_subset(store, [r"^band\d+$"], alpha=alpha).withColumn("band", number)
    known = F.col("std_err") > 0
    rows = rows.withColumns({n: F.when(known, F.col(n)) for n in ("estimate", "lower", "upper", "std_err")})
    limits = F.array(*(F.lit(float(b)) for b in bands))
    return (
        rows.withColumn("start", F.element_at(limits, F.col("band")))
        .withColumn("stop", F.element_at(limits, F.col("band") + 1))
        .withColumn("midpoint", (F.col("start") + F.col("stop")) / 2)
        .select("model_id", "band", "start", "stop", "midpoint", "estimate", "std_err", "lower", "upper")
    )


def contrast_draws(rows: DataFrame, draws: int, seed: int = 1234) -> DataFrame:
    """Draws of the contrasts' joint normal distribution, reproducible from the seed.

    One draw of a model is one coefficient vector, drawn once and shared by all its
    contrasts, so they vary together.
    """
    def root(matrices: pd.Series) -> pd.Series:
        out = []
        for matrix in matrices:
            values, vectors = np.linalg.eigh(np.vstack(matrix))
            out.append((vectors * np.sqrt(np.clip(values, 0.0, None))).tolist())
        return pd.Series(out)

    size = F.size("beta")
    models = rows.groupBy("model_id").agg(F.first("beta").alias("beta"), F.first("vcov").alias("vcov"))
    spread = models.withColumn("_root", F.pandas_udf(root, "array<array<double>>")("vcov")).withColumn(
        "draw", F.explode(F.sequence(F.lit(1), F.lit(draws))))

    def normal(k: Column) -> Column:
        parts = (F.col("model_id"), F.lit(seed), F.col("draw"), k)
        radius = F.sqrt(-2.0 * F.ln(uniform(*parts, F.lit("r"))))
        return radius * F.cos(2.0 * math.pi * uniform(*parts, F.lit("a")))

    spread = spread.withColumn("_z", F.transform(F.sequence(F.lit(0), size - 1), normal))
    drawn = F.zip_with("beta", "_root", lambda b, row: b + _dot(row, F.col("_z")))
    vectors = spread.select("model_id", "draw", drawn.alias("_drawn"))
    return rows.drop("beta", "vcov", "terms").join(vectors, "model_id").withColumn(
        "value", _dot(F.col("weights"), F.col("_drawn"))).drop("weights", "_drawn")


def unit_contrasts(store: ModelStore, pattern: str = ".*") -> DataFrame:
    """One row of weights per coefficient, as input to contrast and contrast_draws."""
    rows = store.nested().select("*", F.posexplode("terms").alias("term_idx", "term"))
    return rows.where(F.col("term").rlike(pattern)).withColumn("weights", _unit(F.col("term_idx")))


def pool_rubin(store: ModelStore, model_id: str = "pooled") -> ModelStore:
    """Combine models of simulated datasets: mean within plus (1 + 1/m) between covariance."""
    coef = store.coef.withColumn("beta", F.coalesce("beta", F.lit(0.0)))
    mean = coef.groupBy("term_idx", "term").agg(F.avg("beta").alias("beta"))
    bi = coef.select("model_id", F.col("term_idx").alias("i"), F.col("beta").alias("_bi"))
    bj = coef.select("model_id", F.col("term_idx").alias("j"), F.col("beta").alias("_bj"))
    pairs = store.vcov.join(bi, ["model_id", "i"]).join(bj, ["model_id", "j"])
    m = F.count(F.lit(1))
    between = F.coalesce(F.covar_samp("_bi", "_bj"), F.lit(0.0))
    vcov = pairs.groupBy("i", "j").agg((F.avg("v") + (1 + 1 / m) * between).alias("v"))
    stats = store.stats.agg(
        F.avg("alpha").alias("alpha"), F.avg("phi").alias("phi"), F.max("n_rows").alias("n_rows"),
        F.max("n_subjects").alias("n_subjects"), F.max("iterations").alias("iterations"),
        F.min("converged").alias("converged"))
    name = F.lit(model_id).alias("model_id")
    return ModelStore(
        mean.select(name, "term_idx", "term", "beta"),
        vcov.select(name, "i", "j", "v"),
        stats.select(name, "*"))


def scenario_curves(store: ModelStore, spec: ModelSpec, **grid) -> DataFrame:
    """Rate-ratio curves of all scenario models, stacked, with the scenario's name."""
    curves = irr_curve(store, spec, **{"stop": 6.0, **grid})
    return curves.withColumn("scenario_id", F.regexp_extract("model_id", r"^[^:]*:(.*)$", 1))
