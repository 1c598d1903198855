"""Clustered Poisson log-rate models with AR(1) working correlation.

Person-weeks are nested once per dataset to one row per subject (a subject has a
bounded number of weeks), with the weeks' covariates, and written in blocks of subjects,
each column as its distinct values and their numbers; every specification reads those
blocks and makes its design in the scan, splines once per distinct value. Each iteration is one scan without a shuffle of
rows: with the weeks in wave order, subtracting the previous row times
rho = alpha ** (wave gap) and dividing by sqrt(1 - rho**2) has the same effect as the
inverse of the subject's AR(1) matrix, so a task needs only running p x p sums.
Those are summed per model in Spark, and p x p numbers per model reach the
driver. All scenarios and sub-models of a call share each scan. Scenarios that only end
follow-up earlier are days in an array of the subject, not copies of its weeks: the weeks
that such a scenario drops or shortens are marked, and all scenarios' sums are products
with the one design.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from recurra.config import DAYS_PER_YEAR, PERIOD_AFTER, ModelSpec
from recurra.functions.stats import chi2_p
from recurra.operators.design import AGE_BASES, INTERCEPT, assembled, bases, matrix, term_blocks, terms, with_design
from recurra.operators.persontime import model_rows, wave
from recurra.session import materialize

STATS = ("n_rows", "n_subjects", "squares", "pair_products", "n_pairs")
# Covariance entries that pass through the driver at a time; a call with more writes them in parts.
STORE_ENTRIES = 2_000_000
# Halvings of a step whose sums are not finite, before the fit counts as failed.
MAX_HALVINGS = 20
# Weeks of a written block, and weeks whose design a task holds at a time.
BLOCK_WEEKS = 1 << 18
SLICE_WEEKS = 1 << 12
# Models of scenarios whose sums are made together, and weeks whose products of terms are held at a time.
MODELS_TOGETHER = 32
PRODUCT_WEEKS = 1 << 9


class FitError(RuntimeError):
    """A model that has no fit: it names the model and says why."""


@dataclass
class _Fit:
    """State of one model: its scenario, its columns of the design, and where the iteration is."""

    model_id: str
    scenario_id: str
    columns: list[int]
    beta: np.ndarray
    alpha: float = 0.0
    phi: float = 1.0
    n_rows: int = 0
    n_subjects: int = 0
    iterations: int = 0
    converged: bool = False
    aliased: np.ndarray | None = None
    vcov: np.ndarray | None = None
    change: float = field(default=np.inf)
    step: np.ndarray | None = None
    halvings: int = 0


def nest_subjects(rows: DataFrame, spec: ModelSpec) -> DataFrame:
    """One row per subject with its weeks of one specification in wave order; `x` is the flattened design.

    A week with a missing covariate, status or offset is left out of the fit, as `n_rows` of the fit shows.
    Fits read `nest_weeks` instead; this shows the rows that they use.
    """
    scenario = F.col("scenario_id") if "scenario_id" in rows.columns else F.lit("all")
    rows = model_rows(rows, spec)
    for name in _inputs(spec):
        # Tests of plain columns; a test of the design would compute it twice.
        rows = rows.where(F.col(name).isNotNull())
    designed = with_design(rows, spec).where(F.col("status").isNotNull() & F.col("offset_time").isNotNull())
    if spec.time_effect == "bands":
        designed = designed.where(F.col("x").isNotNull())
    week = F.struct(
        "wave", F.col("status").cast("double").alias("y"), F.col("offset_time").alias("offset"), "x")
    nested = designed.groupBy(scenario.alias("scenario_id"), "patid").agg(
        F.sort_array(F.collect_list(week)).alias("w"))
    return nested.select(
        "scenario_id", "patid", F.col("w.wave").alias("wave"), F.col("w.y").alias("y"),
        F.col("w.offset").alias("offset"), F.flatten("w.x").alias("x"))


def _inputs(spec: ModelSpec) -> list[str]:
    """The covariates that the terms of a specification use."""
    used = {
        "age_at_infection": spec.age_effect or spec.interactions,
        "time_after_index": spec.time_effect != "none" or spec.interactions,
        "sex": spec.sex_effect or spec.interactions,
        "calendar_year": spec.calendar,
    }
    return [name for name, yes in used.items() if yes]


#: Columns of a week in the nested table, each an array per subject.
_WEEK = ("wave", "after", "y", "offset", "age", "time", "male", "year")
_CUT_WEEK = ("n_days", "sum_day", "week", "tail")


def nest_weeks(rows: DataFrame, cuts: Column | None = None) -> DataFrame:
    """One row per subject with the covariates of all its weeks in wave order, for every specification.

    The window of the waves and the grouping share one shuffle by subject. Weeks from
    `scenarios.cuttable_weeks` keep their days, and with `cuts` (`scenarios.cut_days`) each subject
    gets the days at which scenarios cut its tail, so that they are applied in the scan.
    """
    scenario = F.col("scenario_id") if "scenario_id" in rows.columns else F.lit("all")
    week = {
        "wave": F.col("wave"), "after": (F.col("period") == PERIOD_AFTER).cast("int"),
        "y": F.col("status").cast("double"), "offset": F.col("offset_time"), "age": F.col("age_at_infection"),
        "time": F.col("time_after_index"), "male": (F.col("sex") == "male").cast("double"),
        "year": F.col("calendar_year").cast("double"),
    }
    names, subject = list(_WEEK), []
    if cuts is not None:
        week |= {"n_days": F.col("n_days"), "sum_day": F.col("sum_day"), "week": F.col("week"), "tail": F.col("tail_stop").isNotNull().cast("int")}
        names += _CUT_WEEK
        # The same on all of a subject's weeks that belong to the tail.
        subject = [F.max("tail_stop").alias("tail_stop"), F.max("leave_from").alias("leave_from")]
    numbered = wave(rows, "plain")
    nested = numbered.groupBy(scenario.alias("scenario_id"), "patid").agg(
        F.sort_array(F.collect_list(F.struct(*(c.alias(n) for n, c in week.items())))).alias("w"), *subject)
    days = [] if cuts is None else ["tail_stop", F.when(F.col("tail_stop").isNotNull(), cuts).alias("tail_cuts")]
    return nested.select("scenario_id", "patid", *(F.col(f"w.{n}").alias(n) for n in names), *days)


@dataclass
class _Weeks:
    """Weeks of some subjects as arrays; `subject` numbers their rows' subjects."""

    subject: np.ndarray
    columns: dict[str, np.ndarray]

    def take(self, keep: np.ndarray) -> _Weeks:
        return _Weeks(self.subject[keep], {n: v[keep] for n, v in self.columns.items()})


def _unpack(batch: pa.RecordBatch, names: Iterable[str]) -> _Weeks:
    lengths = pc.list_value_length(batch.column("wave")).to_numpy(zero_copy_only=False)
    columns = {n: batch.column(n).flatten().to_numpy(zero_copy_only=False).astype(float) for n in names}
    return _Weeks(np.repeat(np.arange(len(lengths)), lengths), columns)


def _coded(column: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct values of a column in order, and the steps from each week's number of its value to the next one's."""
    codes, values = pd.factorize(column, use_na_sentinel=False)
    order = np.argsort(values)
    number = np.empty(len(order), np.min_scalar_type(max(len(order) - 1, 0)))
    number[order] = np.arange(len(order))
    # Steps repeat where numbers don't, so the file is small; they wrap around, as their sums do.
    return values[order], np.diff(number[codes], prepend=number.dtype.type(0))


def pack_weeks(nested: DataFrame) -> DataFrame:
    """Blocks of some BLOCK_WEEKS weeks of a scenario's subjects from the rows of `nest_weeks`: what a scan of a fit reads.

    A block's columns are bytes, which go to the scan as they are; arrays would be copied number by number.
    """
    cut = "tail_cuts" in nested.columns
    names = _WEEK + _CUT_WEEK if cut else _WEEK

    def task(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for scenario in pc.unique(batch.column("scenario_id")).to_pylist():
                part = batch.filter(pc.equal(batch.column("scenario_id"), scenario))
                for some in _slices(part, BLOCK_WEEKS):
                    yield pa.RecordBatch.from_pylist([{"scenario_id": scenario, **block(some)}], schema=schema)

    def block(some: pa.RecordBatch) -> dict[str, object]:
        weeks = _unpack(some, names)
        y, offset = weeks.columns["y"], weeks.columns["offset"]
        row = {"lengths": np.bincount(weeks.subject, minlength=some.num_rows).astype(np.int32).tobytes(),
               "events": float(np.nansum(y)), "exposure": float(np.exp(offset[~np.isnan(offset)]).sum())}
        for name in names:
            for suffix, array in zip(("values", "steps"), _coded(weeks.columns[name])):
                row[f"{name}_{suffix}"] = array.tobytes()
        if cut:
            lists = some.column("tail_cuts")
            given = lists.is_valid().to_numpy(zero_copy_only=False)
            days = lists.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(given.sum(), -1)
            every = np.full((len(given), days.shape[1]), np.nan)
            every[given] = days
            row["tail_stop"] = some.column("tail_stop").to_numpy(zero_copy_only=False).astype(float).tobytes()
            row["tail_cuts"] = every.tobytes()
        return row

    binary = ["lengths", *(f"{n}_{s}" for n in names for s in ("values", "steps")), *(("tail_stop", "tail_cuts") if cut else ())]
    schema = pa.schema([("scenario_id", pa.string()), ("events", pa.float64()), ("exposure", pa.float64()), *((n, pa.binary()) for n in binary)])
    read = ["scenario_id", *names, *(("tail_stop", "tail_cuts") if cut else ())]
    return nested.select(*read).mapInArrow(
        task, "scenario_id string, events double, exposure double, " + ", ".join(f"{n} binary" for n in binary))


class _Block:
    """A block of `pack_weeks`: distinct values of its columns, and each week's number of its value."""

    def __init__(self, row: dict[str, object], names: Iterable[str]):
        self.lengths = np.frombuffer(row["lengths"], np.int32)
        self.values, self.codes = {}, {}
        for name in names:
            values = np.frombuffer(row[f"{name}_values"])
            steps = np.frombuffer(row[f"{name}_steps"], np.min_scalar_type(max(len(values) - 1, 0)))
            self.values[name], self.codes[name] = values, np.cumsum(steps, dtype=steps.dtype)
        if "tail_cuts" in row:
            self.stop = np.frombuffer(row["tail_stop"])
            self.cuts = np.frombuffer(row["tail_cuts"]).reshape(len(self.lengths), -1)

    def slices(self, most: int) -> Iterator[tuple[slice, slice]]:
        """Subjects of about `most` weeks: their arrays stay in a core's cache. Subjects and weeks of each slice."""
        ends = np.cumsum(self.lengths, dtype=np.int64)
        at = first = 0
        while at < len(ends):
            stop = max(int(np.searchsorted(ends, first + most, "right")), at + 1)
            yield slice(at, stop), slice(first, int(ends[stop - 1]))
            at, first = stop, int(ends[stop - 1])

    def weeks(self, subjects: slice, part: slice) -> _Weeks:
        lengths = self.lengths[subjects]
        columns = {n: self.values[n][c[part]] for n, c in self.codes.items()}
        return _Weeks(np.repeat(np.arange(len(lengths)), lengths), columns)


def _known(weeks: _Weeks, spec: ModelSpec, x: np.ndarray) -> np.ndarray:
    """The rows of a specification's fit."""
    c = weeks.columns
    keep = ~np.isnan(x).any(axis=1) & ~np.isnan(c["y"]) & ~np.isnan(c["offset"])
    if spec.max_age is not None:
        keep &= c["age"] <= spec.max_age
    if spec.max_time is not None:
        keep &= c["time"] <= spec.max_time
    return keep


def _design(weeks: _Weeks, spec: ModelSpec) -> np.ndarray:
    return matrix(spec, *(weeks.columns.get(n) for n in ("age", "time", "male", "year")))


def _rho(alpha: float, follows: np.ndarray, gap: np.ndarray) -> np.ndarray:
    """Correlation of each week with the week before it; 0 where a subject begins."""
    rho = np.where(follows, alpha, 0.0)
    far = np.flatnonzero(follows & (gap != 1))
    rho[far] = np.sign(alpha) ** gap[far] * np.abs(alpha) ** gap[far]
    return rho


def _sums(starts: np.ndarray, wave: np.ndarray, y: np.ndarray, offset: np.ndarray, full: np.ndarray,
          fits: list[_Fit], with_meat: bool) -> Iterator[tuple]:
    """(model_id, sums) for weeks whose subjects begin at `starts`."""
    follows = np.ones(len(wave), dtype=bool)
    follows[starts] = False
    gap = np.where(follows, np.diff(wave, prepend=0), 1)
    adjacent = follows & (gap == 1)
    for fit in fits:
        x = full if len(fit.columns) == full.shape[1] else full[:, fit.columns]
        with np.errstate(over="ignore"):
            mu = np.exp(x @ fit.beta + offset)
        root = np.sqrt(mu)
        e = (y - mu) / root
        if fit.alpha != 0.0:
            rho = _rho(fit.alpha, follows, gap)
            scale = 1.0 / np.sqrt(1.0 - rho**2)
            xw = x * (root * scale)[:, None]
            xw[1:] -= x[:-1] * (rho[1:] * scale[1:] * root[:-1])[:, None]
            ew = (e - rho * np.roll(e, 1)) * scale
        else:
            xw, ew = x * root[:, None], e
        pairs = (e * np.roll(e, 1))[adjacent]
        sums = [(xw.T @ xw).ravel(), ew @ xw]
        if with_meat:
            by_subject = np.add.reduceat(xw * ew[:, None], starts, axis=0)
            sums.append((by_subject.T @ by_subject).ravel())
        sums.append(np.array([len(y), len(starts), e @ e, pairs.sum(), len(pairs)], dtype=float))
        yield fit.model_id, np.concatenate(sums)


def _batch_sums(batch: pa.RecordBatch, fits: list[_Fit], width: int, with_meat: bool) -> Iterator[tuple]:
    """(model_id, sums) for the subjects of a batch of `nest_subjects`."""
    weeks = _unpack(batch, ("wave", "y", "offset"))
    x = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
    c = weeks.columns
    yield from _sums(_starts(weeks), c["wave"], c["y"], c["offset"], x, fits, with_meat)


def _slices(batch: pa.RecordBatch, most: int) -> Iterator[pa.RecordBatch]:
    """Subjects of about `most` weeks."""
    ends = np.cumsum(pc.list_value_length(batch.column("wave")).to_numpy(zero_copy_only=False))
    at = 0
    while at < batch.num_rows:
        stop = max(int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, "right")), at + 1)
        yield batch.slice(at, stop - at)
        at = stop


def _starts(weeks: _Weeks) -> np.ndarray:
    return np.flatnonzero(np.diff(weeks.subject, prepend=-1))


def _prepared(weeks: _Weeks, x: np.ndarray, spec: ModelSpec, complete: bool = False) -> tuple:
    """What `_sums` takes, of the rows of the specification's fit; `complete` says that they all are."""
    if not complete:
        keep = _known(weeks, spec, x)
        weeks, x = weeks.take(keep), x[keep]
    c = weeks.columns
    number = c["wave"] + c["after"] if spec.wave_mode == "skip" else c["wave"]
    return _starts(weeks), number, c["y"], c["offset"], x


def _truncated(weeks: _Weeks, x: np.ndarray, stop: np.ndarray, cut: np.ndarray, spec: ModelSpec, each: bool = False) -> tuple[_Weeks, np.ndarray]:
    """The weeks that are left, and their design, if each subject's tail stops at day `cut` (with `each`, one of each week) instead of `stop`.

    Days cut+1 .. stop of the tail go. The week they begin in keeps its other days, with their
    mean; later weeks go whole. Earlier weeks, and those without a number, stay as they are.
    """
    c = weeks.columns
    stop, cut = stop[weeks.subject], cut if each else cut[weeks.subject]
    with np.errstate(invalid="ignore"):
        low = np.maximum(cut + 1, 7 * (c["week"] - 1) + 1)
        high = np.minimum(7 * c["week"], stop)
        gone = np.where((c["tail"] > 0) & (high >= low), high - low + 1, 0.0)
    changed = gone > 0
    left = c["n_days"] - gone
    part = np.flatnonzero(changed & (left > 0))
    some = weeks.take(part).columns
    days = left[part]
    mean, old = (some["sum_day"] - gone[part] * (low[part] + high[part]) / 2) / days, some["sum_day"] / some["n_days"]
    new = {n: v.copy() for n, v in c.items()}
    for name in ("age", "time"):
        # Days before day 0 of the clock are whole numbers.
        zero = np.rint(some[name] * DAYS_PER_YEAR - old)
        new[name][part] = (mean + zero) / DAYS_PER_YEAR
    new["offset"][part] = np.log(days / DAYS_PER_YEAR)
    moved = _Weeks(weeks.subject, new)
    x = x.copy()
    x[part] = _design(moved.take(part), spec)
    keep = left > 0
    return moved.take(keep), x[keep]


@dataclass
class _Cuts:
    """Which weeks of some subjects models of scenarios drop, and which they shorten; a row per model, the same for every beta.

    A shortened week is the last of its subject in that model: (model, week), with its own design and offset.
    """

    gone: np.ndarray
    model: np.ndarray
    week: np.ndarray
    x: np.ndarray
    offset: np.ndarray


def _limits(weeks: _Weeks, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Days of a cut: a week goes if its subject's tail stops at the first of them or before, and is shortened if before the second."""
    c = weeks.columns
    with np.errstate(invalid="ignore"):
        high = np.minimum(7 * c["week"], stop[weeks.subject])
        within = (c["tail"] > 0) & (high >= 7 * (c["week"] - 1) + 1)
        whole = within & (c["n_days"] <= high - 7 * (c["week"] - 1))
    return np.where(whole, high - c["n_days"], -np.inf), np.where(within, high, -np.inf)


def _plain_subjects(weeks: _Weeks, spec: ModelSpec, x: np.ndarray, gone_at: np.ndarray, short_before: np.ndarray, complete: bool) -> np.ndarray:
    """Subjects all of whose weeks are in the fit, and whose cuts drop all that follows a week that they drop or shorten."""
    plain = np.ones(int(weeks.subject[-1]) + 1 if len(weeks.subject) else 0, dtype=bool)
    if not complete:
        plain[weeks.subject[~_known(weeks, spec, x)]] = False
    same = weeks.subject[1:] == weeks.subject[:-1]
    plain[weeks.subject[1:][same & (gone_at[1:] < short_before[:-1])]] = False
    return plain


def _cuts_of(weeks: _Weeks, spec: ModelSpec, x: np.ndarray, stop: np.ndarray, days: np.ndarray, limits: tuple[np.ndarray, np.ndarray]) -> _Cuts:
    """What each model's days (a row per subject, NaN where nothing is cut) do to the weeks."""
    at = np.where(np.isnan(days), np.inf, days).T[:, weeks.subject]
    gone = at <= limits[0]
    model, week = np.nonzero((at < limits[1]) & ~gone)
    short = weeks.take(week)
    left, design = _truncated(short, x[week], stop, at[model, week], spec, each=True)
    return _Cuts(gone, model, week, design, left.columns["offset"])


def _weighted_squares(weights: np.ndarray, columns: np.ndarray) -> np.ndarray:
    """For each row of weights the sum over weeks of weight times x x'; `columns` has a row per term."""
    p, n = columns.shape
    upper = np.triu_indices(p)
    total = np.zeros((len(weights), len(upper[0])))
    products = np.empty((len(upper[0]), min(PRODUCT_WEEKS, n)))
    for at in range(0, n, PRODUCT_WEEKS):
        part = columns[:, at: at + PRODUCT_WEEKS]
        some, k = products[:, : part.shape[1]], 0
        for i in range(p):
            np.multiply(part[i], part[i:], out=some[k: k + p - i])
            k += p - i
        total += weights[:, at: at + PRODUCT_WEEKS] @ some.T
    square = np.empty((len(weights), p, p))
    square[:, upper[0], upper[1]] = total
    square[:, upper[1], upper[0]] = total
    return square


def _cut_sums(starts: np.ndarray, wave: np.ndarray, y: np.ndarray, offset: np.ndarray, x: np.ndarray,
              beta: np.ndarray, alpha: np.ndarray, cuts: _Cuts, with_meat: bool) -> list[np.ndarray]:
    """Information, score, (score covariance) and residual sums of models of scenarios, a row per model.

    `beta` and `alpha` have a row per model, as have all numbers of weeks here. With w the
    weighted residuals, a week's share of the score is x times v; of the information, its own
    x x' and, for the product with the week before, x x' of both less that of their difference.
    """
    follows = np.ones(len(wave), dtype=bool)
    follows[starts] = False
    gap = np.where(follows, np.diff(wave, prepend=0), 1)
    adjacent = follows & (gap == 1)
    gone, model, week = cuts.gone, cuts.model, cuts.week

    eta = beta @ x.T
    eta += offset
    eta[model, week] = np.einsum("ij,ij->i", cuts.x, beta[model]) + cuts.offset
    # Weeks that are gone are not computed on, whatever their values.
    np.copyto(eta, 0.0, where=gone)
    with np.errstate(over="ignore"):
        mu = np.exp(eta, out=eta)
    root = np.sqrt(mu)
    e = y - mu
    e /= root
    for rows in (mu, root, e):
        np.copyto(rows, 0.0, where=gone)
    if alpha.any():
        rho = np.where(follows, alpha[:, None], 0.0)
        far = np.flatnonzero(follows & (gap != 1))
        rho[:, far] = np.sign(alpha)[:, None] ** gap[far] * np.abs(alpha)[:, None] ** gap[far]
        np.copyto(rho, 0.0, where=gone)
        square = rho * rho
        np.subtract(1.0, square, out=square)
        np.divide(1.0, square, out=square)
        w = rho[:, 1:] * e[:, :-1]
        w = np.concatenate([e[:, :1], np.subtract(e[:, 1:], w, out=w)], axis=1)
        w *= square
        lagged = rho * square
        own = rho * lagged
        square[:, :-1] += own[:, 1:]
        own = np.multiply(square, mu, out=square)
        lagged[:, 1:] *= root[:, 1:]
        lagged[:, 1:] *= root[:, :-1]
        own -= lagged
        own[:, :-1] -= lagged[:, 1:]
        rho *= w
        w[:, :-1] -= rho[:, 1:]
        v = np.multiply(w, root, out=w)
    else:
        v, own, lagged = e * root, mu, None
    information = _weighted_squares(own, np.ascontiguousarray(x.T))
    if lagged is not None:
        step = np.zeros_like(x)
        np.subtract(x[1:], x[:-1], out=step[1:])
        step[starts] = 0.0
        moving = np.flatnonzero(step.any(axis=0))
        information[np.ix_(range(len(beta)), moving, moving)] += _weighted_squares(lagged, np.ascontiguousarray(step[:, moving].T))
    if with_meat:
        bounds = [*starts.tolist(), len(wave)]
        by_subject = np.empty((len(starts), *beta.shape))
        for k, (a, b) in enumerate(zip(bounds, bounds[1:])):
            np.matmul(v[:, a:b], x[a:b], out=by_subject[k])
    else:
        score = v @ x
    if len(model):
        # Shortened weeks have another design: what they add to the sums of the written one.
        old, new = x[week], cuts.x
        score_more = v[model, week][:, None] * (new - old)
        # The pairs are in the order of their models.
        first = np.flatnonzero(np.diff(model, prepend=-1))
        more = own[model, week][:, None, None] * (new[:, :, None] * new[:, None, :] - old[:, :, None] * old[:, None, :])
        if lagged is not None:
            was = step[week]
            now = was + new - old
            more += lagged[model, week][:, None, None] * (now[:, :, None] * now[:, None, :] - was[:, :, None] * was[:, None, :])
        information[model[first]] += np.add.reduceat(more, first, axis=0)
        if with_meat:
            np.add.at(by_subject, (np.searchsorted(starts, week, "right") - 1, model), score_more)
        else:
            score[model[first]] += np.add.reduceat(score_more, first, axis=0)
    found = [information, score if not with_meat else by_subject.sum(axis=0)]
    if with_meat:
        found.append(by_subject.transpose(1, 2, 0) @ by_subject.transpose(1, 0, 2))
    kept = ~gone
    pairs = np.einsum("ij,ij,j->i", e[:, 1:], e[:, :-1], adjacent[1:].astype(float))
    found.append(np.stack([
        kept.sum(axis=1), np.logical_or.reduceat(kept, starts, axis=1).sum(axis=1),
        np.einsum("ij,ij->i", e, e), pairs, kept @ adjacent.astype(float)], axis=1))
    return found


def _block_design(block: _Block, spec: ModelSpec) -> tuple[Callable[[slice, _Weeks], np.ndarray], bool]:
    """The design of parts of a block, bases once per distinct value, then a lookup; and whether all its weeks are in the fit."""
    values = block.values
    tables = bases(spec, values["age"], values["time"])

    def design(part: slice, weeks: _Weeks) -> np.ndarray:
        rows = {n: t[block.codes["age" if n in AGE_BASES else "time"][part]] for n, t in tables.items()}
        return assembled(spec, rows, weeks.columns["male"], weeks.columns.get("year"))

    used = [*tables.values(), values["y"], values["offset"], *(values[n] for n in ("male",) if "sex" in _inputs(spec)), *(values[n] for n in ("year",) if spec.calendar)]
    complete = not any(np.isnan(v).any() for v in used) and all(
        most is None or (values[n] <= most).all() for n, most in (("age", spec.max_age), ("time", spec.max_time)))
    return design, complete


def _block_sums(block: _Block, fits: list[_Fit], spec: ModelSpec, with_meat: bool) -> Iterator[tuple]:
    """(model_id, sums) for the subjects of a block."""
    design, complete = _block_design(block, spec)
    for subjects, part in block.slices(SLICE_WEEKS):
        weeks = block.weeks(subjects, part)
        prepared = _prepared(weeks, design(part, weeks), spec, complete)
        if len(prepared[0]):
            yield from _sums(*prepared, fits, with_meat)


def _cut_block_sums(block: _Block, fits: list[_Fit], spec: ModelSpec, with_meat: bool, place: dict[str, int]) -> Iterator[tuple]:
    """(model_id, sums) for the subjects of a block and models of cuts, which are in the columns given by `place`."""
    design, complete = _block_design(block, spec)
    width = len(terms(spec))
    beta, alpha = np.zeros((len(fits), width)), np.array([fit.alpha for fit in fits])
    for k, fit in enumerate(fits):
        beta[k, fit.columns] = fit.beta
    chosen = [place[fit.scenario_id] for fit in fits]
    groups = [slice(at, at + MODELS_TOGETHER) for at in range(0, len(fits), MODELS_TOGETHER)]
    totals: list[list[np.ndarray] | None] = [None] * len(groups)
    for subjects, part in block.slices(SLICE_WEEKS):
        weeks = block.weeks(subjects, part)
        x = design(part, weeks)
        stop, days = block.stop[subjects], block.cuts[subjects][:, chosen]
        limits = _limits(weeks, stop)
        plain = _plain_subjects(weeks, spec, x, *limits, complete)[weeks.subject]
        if not plain.all():
            # The others one model at a time, with weeks taken out.
            others, design_of_others = weeks.take(~plain), x[~plain]
            for k, fit in enumerate(fits):
                prepared = _prepared(*_truncated(others, design_of_others, stop, days[:, k], spec), spec)
                if len(prepared[0]):
                    yield from _sums(*prepared, [fit], with_meat)
            weeks, x, limits = weeks.take(plain), x[plain], tuple(v[plain] for v in limits)
        if not len(weeks.subject):
            continue
        given = _prepared(weeks, x, spec, complete=True)
        for k, some in enumerate(groups):
            cuts = _cuts_of(weeks, spec, x, stop, days[:, some], limits)
            found = _cut_sums(*given, beta[some], alpha[some], cuts, with_meat)
            totals[k] = found if totals[k] is None else [a + b for a, b in zip(totals[k], found)]
    for some, total in zip(groups, totals):
        if total is None:
            continue
        for k, fit in enumerate(fits[some]):
            square = np.ix_(fit.columns, fit.columns)
            yield fit.model_id, np.concatenate([
                total[0][k][square].ravel(), total[1][k][fit.columns], *(t[k][square].ravel() for t in total[2:-1]), total[-1][k]])


def _pass_sums(packed: DataFrame, fits: list[_Fit], spec: ModelSpec, with_meat: bool, cuts: list[str]) -> dict[str, np.ndarray]:
    """One scan: information, score, (score covariance) and residual sums of each model."""
    by_scenario: dict[str, list[_Fit]] = {}
    for fit in fits:
        by_scenario.setdefault(fit.scenario_id, []).append(
            _Fit(fit.model_id, fit.scenario_id, fit.columns, fit.beta, fit.alpha))
    names = [n for n in (_WEEK + _CUT_WEEK if cuts else _WEEK) if n != "year" or spec.calendar]
    place = {name: k for k, name in enumerate(cuts)}

    def task(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[str, np.ndarray] = {}
        for batch in batches:
            for k in range(batch.num_rows):
                row = {n: v[0] for n, v in batch.slice(k, 1).to_pydict().items()}
                if cuts:
                    found = _cut_block_sums(_Block(row, names), [f for some in by_scenario.values() for f in some], spec, with_meat, place)
                elif row["scenario_id"] in by_scenario:
                    found = _block_sums(_Block(row, names), by_scenario[row["scenario_id"]], spec, with_meat)
                else:
                    continue
                for model_id, sums in found:
                    totals[model_id] = totals[model_id] + sums if model_id in totals else sums
        for model_id, sums in totals.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array([model_id] * len(sums)), pa.array(np.arange(len(sums), dtype=np.int32)),
                 pa.array(sums)], names=["model_id", "k", "v"])

    read = ["scenario_id", "lengths", *(f"{n}_{s}" for n in names for s in ("values", "steps")), *(("tail_stop", "tail_cuts") if cuts else ())]
    partial = packed.select(*read).mapInArrow(task, "model_id string, k int, v double")
    # p x p sums per model: the only numbers that come to the driver.
    total = partial.groupBy("model_id", "k").agg(F.sum("v").alias("v")).toPandas()
    return {
        model_id: rows.sort_values("k")["v"].to_numpy()
        for model_id, rows in total.groupby("model_id")
    }


def _inverse(information: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Inverse on the estimable terms, and a mask of the aliased ones (no rows carry them)."""
    diagonal = np.diag(information).copy()
    aliased = diagonal <= 1e-10 * max(diagonal.max(), 1.0)
    keep = ~aliased
    scale = 1.0 / np.sqrt(diagonal[keep])
    scaled = information[np.ix_(keep, keep)] * scale[:, None] * scale[None, :]
    inverse = np.zeros_like(information)
    inverse[np.ix_(keep, keep)] = np.linalg.pinv(scaled, rcond=1e-12, hermitian=True) * np.outer(scale, scale)
    return inverse, aliased


def _advance(fit: _Fit, sums: np.ndarray, correlation: str, with_meat: bool) -> None:
    p = len(fit.columns)
    information, score = sums[: p * p].reshape(p, p), sums[p * p: p * p + p]
    stats = dict(zip(STATS, sums[-len(STATS):]))
    if not np.isfinite(sums).all():
        # The last step went too far: take half of it.
        if fit.step is None or fit.halvings == MAX_HALVINGS:
            raise FitError(f"model {fit.model_id}: the sums are not finite")
        fit.step = fit.step / 2
        fit.beta = fit.beta - fit.step
        fit.halvings += 1
        fit.change = np.inf
        return
    inverse, aliased = _inverse(information)
    step = inverse @ score
    fit.beta, fit.step, fit.halvings = fit.beta + step, step, 0
    fit.phi = stats["squares"] / max(stats["n_rows"] - (~aliased).sum(), 1)
    alpha = 0.0
    if correlation == "ar1" and stats["n_pairs"] > 0:
        alpha = float(stats["pair_products"] / stats["n_pairs"] / fit.phi) if fit.phi > 0 else 0.0
        if abs(alpha) >= 1:
            raise FitError(f"model {fit.model_id}: the lag-one correlation estimate {alpha:.4f} is not below one")
    fit.change = max(float(np.abs(step).max()), abs(alpha - fit.alpha))
    fit.alpha, fit.aliased = alpha, aliased
    fit.n_rows, fit.n_subjects = int(stats["n_rows"]), int(stats["n_subjects"])
    fit.iterations += 1
    if with_meat:
        meat = sums[p * p + p: 2 * p * p + p].reshape(p, p)
        fit.vcov = inverse @ meat @ inverse


@dataclass(frozen=True)
class ModelStore:
    """Fitted models: coefficients, robust covariances and fit statistics, keyed by model_id."""

    coef: DataFrame
    vcov: DataFrame
    stats: DataFrame

    def nested(self) -> DataFrame:
        """One row per model: terms, beta and the covariance as rows; aliased terms count as 0."""
        beta = F.struct("term_idx", "term", F.coalesce("beta", F.lit(0.0)).alias("beta"))
        row = self.vcov.groupBy("model_id", "i").agg(
            F.sort_array(F.collect_list(F.struct("j", "v"))).alias("r"))
        row = row.select("model_id", F.struct("i", F.col("r.v").alias("v")).alias("m"))
        # Both kinds of rows meet in one grouping; collect_list passes over the NULLs.
        both = self.coef.select("model_id", beta.alias("b")).unionByName(row, allowMissingColumns=True)
        models = both.groupBy("model_id").agg(
            F.sort_array(F.collect_list("b")).alias("b"), F.sort_array(F.collect_list("m")).alias("m"))
        return models.select(
            "model_id", F.col("b.term").alias("terms"), F.col("b.beta").alias("beta"), F.col("m.v").alias("vcov"))

    def only(self, *model_ids: str) -> ModelStore:
        keep = F.col("model_id").isin(list(model_ids))
        return ModelStore(self.coef.where(keep), self.vcov.where(keep), self.stats.where(keep))


def write_model(store: ModelStore, path: str) -> None:
    for name in ("coef", "vcov", "stats"):
        getattr(store, name).write.mode("overwrite").parquet(f"{path}/{name}")


def read_model(spark: SparkSession, path: str) -> ModelStore:
    return ModelStore(*(spark.read.parquet(f"{path}/{name}") for name in ("coef", "vcov", "stats")))


def _to_store(spark: SparkSession, fits: list[_Fit], names: list[str]) -> ModelStore:
    parts, size = [[]], 0
    for fit in fits:
        if size and size + len(fit.columns) ** 2 > STORE_ENTRIES:
            parts.append([])
            size = 0
        parts[-1].append(fit)
        size += len(fit.columns) ** 2
    if len(parts) > 1:
        stores = [_to_store(spark, part, names) for part in parts]
        tables = ([materialize(getattr(s, n), f"models-{n}") for s in stores] for n in ("coef", "vcov", "stats"))
        return ModelStore(*(reduce(DataFrame.unionByName, t) for t in tables))
    coef, vcov, stats = [], [], []
    for fit in fits:
        for k, column in enumerate(fit.columns):
            value = None if fit.aliased[k] else float(fit.beta[k])
            coef.append((fit.model_id, k, names[column], value))
            vcov += [(fit.model_id, k, j, float(fit.vcov[k, j])) for j in range(len(fit.columns))]
        stats.append((fit.model_id, float(fit.alpha), float(fit.phi), fit.n_rows, fit.n_subjects,
                      fit.iterations, fit.converged))
    return ModelStore(
        spark.createDataFrame(coef, "model_id string, term_idx int, term string, beta double"),
        spark.createDataFrame(vcov, "model_id string, i int, j int, v double"),
        spark.createDataFrame(
            stats, "model_id string, alpha double, phi double, n_rows bigint, n_subjects bigint, "
                   "iterations int, converged boolean"))


def fit_nested(
    nested: DataFrame, spec: ModelSpec, subsets: dict[str, list[str]] | None = None,
    cuts: list[str] | None = None, only: list[str] | None = None, tolerance: float = 1e-8, max_iterations: int = 25, require_convergence: bool = True,
) -> ModelStore:
    """Fit one model per scenario and subset of terms on an already written table of `nest_weeks` or of `pack_weeks`.

    `cuts` names the scenarios of the table's cuts, in their order; each of them, or of `only`, is a model of its own.
    A model that has not converged after `max_iterations` raises FitError, or with
    require_convergence=False stands in the store with converged = false.
    """
    if cuts and spec.calendar:
        raise ValueError("cuts move the mean day of a week, but not its calendar year")
    names = terms(spec)
    packed = nested if "lengths" in nested.columns else materialize(pack_weeks(nested), "weeks")
    rate = packed.groupBy("scenario_id").agg(F.sum("events").alias("events"), F.sum("exposure").alias("exposure"))
    fits = []
    for row in rate.toPandas().itertuples():
        start = np.log(max(row.events, 0.5) / row.exposure)
        for scenario in (only or cuts or [row.scenario_id]):
            for suffix, chosen in (subsets or {"": names}).items():
                columns = [names.index(t) for t in chosen]
                beta = np.zeros(len(columns))
                beta[chosen.index(INTERCEPT)] = start
                parts = [spec.name] + [p for p in (scenario, suffix) if p not in ("", "all")]
                fits.append(_Fit(":".join(parts), scenario, columns, beta))
    running = fits
    for iteration in range(max_iterations):
        last = iteration == max_iterations - 1
        # The score covariance is needed at the end only.
        with_meat = last or max(f.change for f in running) < 1e-4
        sums = _pass_sums(packed, running, spec, with_meat, cuts or [])
        for fit in running:
            if fit.model_id not in sums:
                raise FitError(f"model {fit.model_id}: no week has all its covariates")
            _advance(fit, sums[fit.model_id], spec.correlation, with_meat)
            fit.converged = fit.change < tolerance and fit.vcov is not None
        running = [f for f in running if not f.converged]
        if not running:
            break
    if running and (require_convergence or any(f.vcov is None for f in running)):
        raise FitError("not converged: " + ", ".join(f.model_id for f in running))
    return _to_store(nested.sparkSession, fits, names)


def fit_gee(rows: DataFrame, spec: ModelSpec, **options) -> ModelStore:
    """Fit a specification to person-weeks, for every scenario in them at once."""
    return fit_nested(materialize(pack_weeks(nest_weeks(rows)), "weeks"), spec, **options)


def sequence_blocks(spec: ModelSpec) -> tuple[dict[str, list[str]], dict[str, list[str]]]:
    """Terms of the nested models that add one block at a time, and the block each one adds."""
    subsets, so_far, added = {}, [], {}
    for name, block in term_blocks(spec).items():
        so_far = so_far + block
        if name != "intercept":
            subsets[name], added[name] = list(so_far), block
    return subsets, added


def fit_sequence(rows: DataFrame, spec: ModelSpec, **options) -> tuple[ModelStore, dict[str, list[str]]]:
    """Nested models that add one block of terms at a time, and the block each one adds."""
    subsets, added = sequence_blocks(spec)
    return fit_gee(rows, spec, subsets=subsets, **options), added


def wald_test(
    store: ModelStore, blocks: dict[str, list[str]], per_model: bool = False, overall: Iterable[str] | None = None,
) -> DataFrame:
    """Wald chi-square of each block of terms, and the sum over the blocks named by `overall` (all) as "overall".

    per_model: model "<...>:<block>" tests the block of that name only, which
    makes the test sequential on the result of fit_sequence.
    """
    listed = [(block, position, term) for position, (block, names) in enumerate(blocks.items(), 1)
              for term in names]
    spark = store.coef.sparkSession
    wanted = spark.createDataFrame(listed, "block string, position int, term string")
    chosen = store.coef.where(F.col("beta").isNotNull()).join(wanted, "term")
    if per_model:
        suffix = F.concat(F.lit(":"), F.col("block"))
        family = F.expr("substr(model_id, 1, length(model_id) - length(block) - 1)")
        chosen = chosen.where(F.col("model_id").endswith(suffix)).withColumn("family", family)
    else:
        chosen = chosen.withColumn("family", F.col("model_id"))
    chosen = chosen.select("family", "model_id", "block", "position", "term_idx", "beta")
    left = chosen.select("family", "model_id", "block", "position", F.col("term_idx").alias("i"), "beta")
    right = chosen.select("model_id", "block", F.col("term_idx").alias("j"))
    entries = left.join(right, ["model_id", "block"]).join(store.vcov, ["model_id", "i", "j"])

    def test(rows: pd.DataFrame) -> pd.DataFrame:
        matrix = rows.pivot(index="i", columns="j", values="v").to_numpy()
        beta = rows.drop_duplicates("i").sort_values("i")["beta"].to_numpy()
        first = rows.iloc[0]
        chi2 = float(beta @ np.linalg.pinv(matrix, rcond=1e-12, hermitian=True) @ beta)
        return pd.DataFrame({"model_id": [first["family"]], "block": [first["block"]],
                             "position": [first["position"]], "chi2": [chi2], "df": [len(beta)]})

    tested = entries.groupBy("family", "model_id", "block").applyInPandas(
        test, "model_id string, block string, position int, chi2 double, df int")
    part = tested if overall is None else tested.where(F.col("block").isin(list(overall)))
    summed = part.groupBy("model_id").agg(F.sum("chi2").alias("chi2"), F.sum("df").cast("int").alias("df"))
    both = tested.unionByName(summed.select(
        "model_id", F.lit("overall").alias("block"), F.lit(0).alias("position"), "chi2", "df"))

    return both.withColumn("p_value", chi2_p(F.col("chi2"), F.col("df")))
