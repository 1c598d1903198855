"""The scan of a fit: blocks of weeks, and models of scenarios as products with one design."""

import numpy as np
import pyarrow as pa
import pytest

from recurra import config as c
from recurra.operators import design, gee

STOP, CUTS = 60.0, 5


class Table:
    """Stands in for a DataFrame whose rows are one Arrow batch."""

    def __init__(self, batch):
        self.batch, self.columns = batch, batch.schema.names

    def select(self, *names):
        return self

    def mapInArrow(self, task, schema):
        return [row for part in task([self.batch]) for row in part.to_pylist()]


def nested(odd=False, cuts=True, subjects=40):
    """Rows of `nest_weeks`: some weeks before the index event, then a tail of weeks up to STOP, with cuts inside and outside it."""
    rng = np.random.default_rng(3)
    rows = []
    for k in range(subjects):
        before, first, birth = int(rng.integers(0, 4)), int(rng.integers(0, 30)), int(rng.integers(0, 700))
        weeks = [{"n_days": 7, "sum_day": 7 * (7 * w + 4), "week": w + 1, "tail": 0, "after": 0} for w in range(before)]
        day = first
        while day < STOP:
            week = day // 7 + 1
            last = min(7 * week, int(STOP))
            weeks.append({"n_days": last - day, "sum_day": sum(range(day + 1, last + 1)), "week": week, "tail": 1, "after": 1})
            day = last
        for w, x in enumerate(weeks):
            mean = x["sum_day"] / x["n_days"]
            x |= {"wave": w + 1 + (w > 4 and k % 7 == 0), "y": float(rng.poisson(0.3)), "offset": float(np.log(x["n_days"] / 365)),
                  "age": (mean + birth + 200 * x["after"]) / 365, "time": mean / 365 if x["after"] else -1.0, "male": float(k % 2), "year": 2000.0}
        if odd and k % 5 == 0 and len(weeks) > 4:
            # Not in the order of their days, an offset that only a cut supplies, a missing sex, more days than the week has.
            weeks[-1], weeks[-2] = weeks[-2] | {"wave": weeks[-1]["wave"]}, weeks[-1] | {"wave": weeks[-2]["wave"]}
            weeks[-3]["offset"] = None
            weeks[-4]["n_days"] += 9
        if odd and k % 11 == 3:
            for x in weeks:
                x["male"] = None
        row = {"scenario_id": "all", "patid": k, **{n: [x[n] for x in weeks] for n in (*gee._WEEK, *gee._CUT_WEEK)}}
        days = sorted(int(v) for v in rng.integers(0, 70, CUTS - 1))
        tail = {"tail_stop": STOP, "tail_cuts": [*days, int(STOP)]} if not (odd and k % 13 == 1) else {"tail_stop": None, "tail_cuts": None}
        rows.append(row | tail if cuts else {n: v for n, v in row.items() if n not in gee._CUT_WEEK})
    kinds = {"wave": pa.list_(pa.int32()), "after": pa.list_(pa.int32()), "week": pa.list_(pa.int32()), "tail_cuts": pa.list_(pa.int32())}
    names = list(rows[0])
    return pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], kinds.get(n)) for n in names], names)


def summed(found):
    totals = {}
    for name, sums in found:
        totals[name] = totals.get(name, 0) + sums
    return totals


SPECS = [
    c.PERIOD_ONLY, c.EMIGRATION_SWEEP.but(name="ar1"), c.EMIGRATION_MI,
    c.EMIGRATION_SWEEP.but(name="part", max_age=1.6, max_time=0.1),
    c.PIECEWISE.but(name="bands", bands=(-1.0, 0.0, 0.05, 0.12)),
]


@pytest.mark.parametrize("odd", [False, True])
@pytest.mark.parametrize("spec", SPECS, ids=lambda s: s.name)
def test_products_with_one_design_equal_weeks_taken_out(spec, odd, monkeypatch):
    monkeypatch.setattr(gee, "SLICE_WEEKS", 64)
    batch, width = nested(odd), len(design.terms(spec))
    rows = gee.pack_weeks(Table(batch))
    rng = np.random.default_rng(1)
    fits = [gee._Fit(f"m{k}{j}", f"s{k}", columns, rng.normal(size=len(columns)) * 0.1, alpha)
            for k, alpha in enumerate((0.3, -0.2, 0.0, 0.1, 0.05)) for j, columns in enumerate((list(range(width)), list(range(0, width, 2))))]
    if spec.correlation == "independence":
        for fit in fits:
            fit.alpha = 0.0
    names = [n for n in gee._WEEK + gee._CUT_WEEK if n != "year"]
    blocks = [gee._Block(row, names) for row in rows]
    got = summed(s for b in blocks for s in gee._cut_block_sums(b, fits, spec, True, {f"s{k}": k for k in range(CUTS)}))

    def plainly():
        weeks = gee._unpack(batch, gee._WEEK + gee._CUT_WEEK)
        stop = batch.column("tail_stop").to_numpy(zero_copy_only=False).astype(float)
        for fit in fits:
            days = [np.nan if v is None else v[int(fit.scenario_id[1:])] for v in batch.column("tail_cuts").to_pylist()]
            prepared = gee._prepared(*gee._truncated(weeks, gee._design(weeks, spec), stop, np.array(days, float), spec), spec)
            yield from gee._sums(*prepared, [fit], True)

    wanted = summed(plainly())
    assert set(got) == set(wanted)
    for name, sums in wanted.items():
        np.testing.assert_allclose(got[name], sums, rtol=1e-8, atol=1e-9 * np.abs(sums).max())


def test_blocks_give_back_the_weeks(monkeypatch):
    monkeypatch.setattr(gee, "BLOCK_WEEKS", 100)
    batch = nested(odd=True)
    wanted = gee._unpack(batch, gee._WEEK + gee._CUT_WEEK)
    rows = gee.pack_weeks(Table(batch))
    assert len(rows) > 3 and abs(sum(r["events"] for r in rows) - np.nansum(wanted.columns["y"])) < 1e-9
    blocks = [gee._Block(row, gee._WEEK + gee._CUT_WEEK) for row in rows]
    for name, column in wanted.columns.items():
        np.testing.assert_array_equal(np.concatenate([b.values[name][b.codes[name]] for b in blocks]), column)
    assert np.concatenate([b.lengths for b in blocks]).sum() == len(wanted.subject)
    cuts = np.concatenate([b.cuts for b in blocks])
    assert [None if np.isnan(r).all() else r.tolist() for r in cuts] == batch.column("tail_cuts").to_pylist()


def test_a_scan_makes_splines_once_per_value_whatever_the_number_of_models(monkeypatch):
    rows = gee.pack_weeks(Table(nested(subjects=400)))
    blocks = [gee._Block(row, [n for n in gee._WEEK + gee._CUT_WEEK if n != "year"]) for row in rows]
    made, values = [], design.NaturalSpline.values
    monkeypatch.setattr(design.NaturalSpline, "values", lambda self, x: made.append(len(x)) or values(self, x))
    spec = c.EMIGRATION_SWEEP
    fits = [gee._Fit(f"m{k}", f"s{k}", list(range(19)), np.zeros(19)) for k in range(CUTS)]
    assert len(summed(s for b in blocks for s in gee._cut_block_sums(b, fits, spec, False, {f"s{k}": k for k in range(CUTS)}))) == CUTS
    distinct = sum(len(b.values[n]) for b in blocks for n in ("age", "time"))
    shortened = 2 * CUTS * sum(len(b.lengths) for b in blocks)
    assert sum(made) <= distinct + shortened


def test_scenarios_of_one_seed_share_a_draw(spark):
    from pyspark.sql import functions as F

    from recurra.functions.columns import exponential_days
    from recurra.operators import scenarios

    rows = [*c.rate_scenarios([0.2, 0.9, 40.0]), *c.seed_scenarios([11, 498]), c.Emigration("none", 0.0, 11)]
    assert str(scenarios.cut_days(rows)).count("1234") == 1
    df = spark.createDataFrame([(k, 30 * k, 2000) for k in range(20)] + [(99, None, None)], "patid long, leave_from int, tail_stop int")
    alone = F.array(*(F.when(F.lit(float(s.rate)) == 0, F.col("tail_stop")).otherwise(F.least(
        "tail_stop", F.greatest(F.lit(0), F.col("leave_from") + exponential_days(F.lit(float(s.rate)), F.col("patid"), F.lit(s.seed)))))
        for s in rows))
    got = df.where("tail_stop is not null").select(scenarios.cut_days(rows).alias("got"), alone.alias("alone")).collect()
    assert len({tuple(r.got) for r in got}) > 5 and all(r.got == r.alone for r in got)
