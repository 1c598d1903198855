"""Design rows of the rate models as array columns, with named terms."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recurra.config import WASHOUT_YEARS, ModelSpec
from recurra.functions.columns import cut
from recurra.functions.spline import NaturalSpline, natural_spline

INTERCEPT = "(Intercept)"


def age_spline(spec: ModelSpec) -> NaturalSpline:
    return natural_spline(spec.age_knots, 0.0, spec.age_boundary)


def time_spline(spec: ModelSpec) -> NaturalSpline:
    """Of the time since the end of the washout."""
    inner = tuple(k - WASHOUT_YEARS for k in spec.time_knots)
    return natural_spline(inner, 0.0, spec.time_boundary - WASHOUT_YEARS)


def interaction_splines(spec: ModelSpec) -> tuple[NaturalSpline, NaturalSpline]:
    inner = tuple(k - WASHOUT_YEARS for k in spec.interaction_time_knots)
    return (
        natural_spline(spec.interaction_age_knots, 0.0, spec.age_boundary),
        natural_spline(inner, 0.0, spec.time_boundary - WASHOUT_YEARS),
    )


def term_blocks(spec: ModelSpec) -> dict[str, list[str]]:
    """Term names by block, in the order of the design array."""
    blocks = {"intercept": [INTERCEPT]}
    if spec.sex_effect:
        blocks["sex"] = ["sexmale"]
    if spec.age_effect:
        blocks["age"] = [f"ns_age{i}" for i in range(1, age_spline(spec).size + 1)]
    if spec.time_effect == "bands":
        blocks["bands"] = [f"band{i}" for i in range(2, len(spec.bands))]
    if spec.time_effect in ("step", "spline"):
        blocks["after"] = ["after"]
    if spec.time_effect == "spline":
        blocks["time"] = [f"ns_time{i}" for i in range(1, time_spline(spec).size + 1)]
    if spec.interactions:
        age1, time1 = interaction_splines(spec)
        blocks["age_time"] = [
            f"ns_age{i}:ns_time{j}" for i in range(1, age1.size + 1) for j in range(1, time1.size + 1)]
        blocks["sex_age"] = [f"sexmale:{t}" for t in blocks["age"]]
        blocks["sex_time"] = [f"sexmale:{t}" for t in blocks["time"]]
    if spec.calendar:
        blocks["calendar"] = ["calendar_year"]
    return blocks


def terms(spec: ModelSpec) -> list[str]:
    return [term for block in term_blocks(spec).values() for term in block]


def with_design(
    rows: DataFrame, spec: ModelSpec, into: str = "x",
    age: str | Column = "age_at_infection", time: str | Column = "time_after_index",
    sex: str | Column = "sex", year: str | Column = "calendar_year",
) -> DataFrame:
    """Add the design array; NULL where the time lies outside the bands of a banded model."""
    as_col = lambda value: F.col(value) if isinstance(value, str) else value
    age, time, sex, year = as_col(age), as_col(time), as_col(sex), as_col(year)
    since = F.greatest(time - F.lit(WASHOUT_YEARS), F.lit(0.0))
    male = (sex == "male").cast("double")
    # Bases first, products of them in a second projection: each is computed once per row.
    bases = {"_male": male}
    if spec.age_effect:
        bases["_age"] = F.array(*age_spline(spec).columns(age))
    if spec.time_effect == "spline":
        bases["_time"] = F.array(*time_spline(spec).columns(since))
    if spec.time_effect == "bands":
        bases["_band"] = cut(time, spec.bands, include_lowest=True)
    if spec.time_effect in ("step", "spline"):
        bases["_after"] = (time >= F.lit(WASHOUT_YEARS)).cast("double")
    if spec.interactions:
        age1, time1 = interaction_splines(spec)
        bases["_age1"] = F.array(*age1.columns(age))
        bases["_time1"] = F.array(*time1.columns(since))
    if spec.calendar:
        bases["_year"] = (year - F.lit(spec.calendar_center)).cast("double")

    def scaled(factor: Column, basis: str) -> Column:
        return F.transform(basis, lambda v: v * factor)

    parts = [F.array(F.lit(1.0))]
    if spec.sex_effect:
        parts.append(F.array("_male"))
    if spec.age_effect:
        parts.append(F.col("_age"))
    if spec.time_effect == "bands":
        parts.append(F.array(*(
            (F.col("_band") == i).cast("double") for i in range(2, len(spec.bands)))))
    if "_after" in bases:
        parts.append(F.array("_after"))
    if spec.time_effect == "spline":
        parts.append(F.col("_time"))
    if spec.interactions:
        parts.append(F.flatten(F.transform("_age1", lambda a: F.transform("_time1", lambda t: a * t))))
        parts += [scaled(F.col("_male"), "_age"), scaled(F.col("_male"), "_time")]
    if spec.calendar:
        parts.append(F.array("_year"))
    x = F.concat(*parts)
    if spec.time_effect == "bands":
        x = F.when(F.col("_band").isNotNull(), x)
    return rows.withColumns(bases).withColumn(into, x).drop(*bases)


def bases(spec: ModelSpec, age: np.ndarray, time: np.ndarray) -> dict[str, np.ndarray]:
    """The parts of the design that follow from age or from time alone, a row per given value; NaN where that is missing."""
    since = np.maximum(time - WASHOUT_YEARS, 0.0)
    found: dict[str, np.ndarray] = {}
    if spec.age_effect:
        found["age"] = age_spline(spec).values(age)
    if spec.time_effect == "bands":
        edges = np.array(spec.bands)
        band = np.searchsorted(edges, time, "left")
        band[time == edges[0]] = 1
        inside = (band >= 1) & (band < len(edges))
        found["bands"] = np.where(inside[:, None], band[:, None] == np.arange(2, len(edges)), np.nan)
    if spec.time_effect in ("step", "spline"):
        found["after"] = np.where(np.isnan(time), np.nan, time >= WASHOUT_YEARS)[:, None]
    if spec.time_effect == "spline":
        found["time"] = time_spline(spec).values(since)
    if spec.interactions:
        age1, time1 = interaction_splines(spec)
        found["age1"], found["time1"] = age1.values(age), time1.values(since)
    return found


#: Parts that follow from age; the others follow from time.
AGE_BASES = ("age", "age1")


def assembled(spec: ModelSpec, parts: dict[str, np.ndarray], male: np.ndarray, year: np.ndarray | None) -> np.ndarray:
    """The design of weeks from their rows of `bases`; only calendar models need the year."""
    n = len(male)
    blocks: dict[str, np.ndarray] = {"intercept": np.ones((n, 1))}
    if spec.sex_effect:
        blocks["sex"] = male[:, None]
    for name in ("age", "bands", "after", "time"):
        if name in parts:
            blocks[name] = parts[name]
    if spec.interactions:
        blocks["age_time"] = (parts["age1"][:, :, None] * parts["time1"][:, None, :]).reshape(n, -1)
        blocks["sex_age"] = male[:, None] * blocks["age"]
        blocks["sex_time"] = male[:, None] * blocks["time"]
    if spec.calendar:
        blocks["calendar"] = (year - spec.calendar_center)[:, None]
    return np.hstack(list(blocks.values()))


def matrix(spec: ModelSpec, age: np.ndarray, time: np.ndarray, male: np.ndarray, year: np.ndarray | None) -> np.ndarray:
    """The design of `with_design` for arrays of weeks, a row per week; NaN where an input that the terms use is missing."""
    return assembled(spec, bases(spec, age, time), male, year)
