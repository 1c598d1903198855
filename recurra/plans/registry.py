"""Named queries over a directory of order tables; each returns a DataFrame."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce, wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recurra import config as c
from recurra.config import CohortConfig, Emigration, ModelSpec
from recurra.functions.columns import cut, recode
from recurra.functions.spline import ns_basis
from recurra.operators import cleaning, contrasts, gee, persontime, scenarios, summary, timeline
from recurra.operators import episodes as ep
from recurra.operators.design import age_spline
from recurra.plans import derive, report
from recurra.session import fingerprint, materialize, tune
from recurra.sources import starschema as star
from recurra.sources.tables import icd_dim

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

DEAD = CohortConfig(followup_end=star.FOLLOWUP_END, worse_as_dead=True)
ALIVE = CohortConfig(followup_end=star.FOLLOWUP_END, worse_as_dead=False)
TRANSITIVE = CohortConfig(followup_end=star.FOLLOWUP_END, worse_as_dead=True, merge_mode="transitive")
PREFILTERED = CohortConfig(
    followup_end=star.FOLLOWUP_END, worse_as_dead=True, prefilter_index_subjects=True)
SCENARIO_ROWS = [Emigration(*row) for row in c.SCENARIOS]
MI_ROWS = c.seed_scenarios(c.IMPUTATION_SEEDS)
SWEEP_ROWS = c.rate_scenarios()
PERIOD = c.PERIOD_ONLY


def query(name: str | None = None) -> Callable[[Query], Query]:
    def register(function: Query) -> Query:
        @wraps(function)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return function(tune(spark), sf_dir)

        QUERIES[name or function.__name__] = run
        return function

    return register


def rounded(df: DataFrame, digits: int, *names: str) -> DataFrame:
    return df.withColumns({name: F.round(name, digits) for name in names})


def _episodes(spark, sf_dir, cfg=DEAD) -> DataFrame:
    return derive.derive_episodes(star.admissions(spark, sf_dir), cfg)


def _days(spark, sf_dir) -> DataFrame:
    return derive.admission_days(star.admissions(spark, sf_dir), DEAD)


def _intervals(spark, sf_dir) -> DataFrame:
    return timeline.risk_intervals(_episodes(spark, sf_dir), DEAD)


def _weeks(spark, sf_dir, cfg=DEAD) -> DataFrame:
    return derive.person_time(_episodes(spark, sf_dir, cfg), cfg)


def _scenario_episodes(spark, sf_dir, rows=SCENARIO_ROWS) -> DataFrame:
    return derive.scenario_episodes(_episodes(spark, sf_dir), rows, star.YEARS)


def _scenario_weeks(spark, sf_dir, rows=SCENARIO_ROWS) -> DataFrame:
    return derive.person_time(_scenario_episodes(spark, sf_dir, rows), DEAD)


# Derivation -----------------------------------------------------------------

@query()
def stage_visit_index(spark, sf_dir):
    rows = star.admissions(spark, sf_dir).select("source_ordinal", "patid", "date_admit", "date_dis")
    return cleaning.number_admissions(rows).select("source_ordinal", "patid", "visit", "visit_last")


DAY_COLUMNS = ["patid", "date_admit", "date_dis", "source_ordinal", "icd_m3", "outcome"]


@query()
def dedupe_exact(spark, sf_dir):
    return cleaning.dedupe_exact(star.admissions(spark, sf_dir).select(DAY_COLUMNS))


@query()
def merge_same_start(spark, sf_dir):
    rows = cleaning.dedupe_exact(star.admissions(spark, sf_dir).select(DAY_COLUMNS))
    return cleaning.merge_same_start(rows, DEAD).select(DAY_COLUMNS)


def _resolve(worse_as_dead: bool) -> Query:
    def run(spark, sf_dir):
        return cleaning.resolve_outcome(_days(spark, sf_dir), worse_as_dead).select("patid", "date_admit", "outcome")

    return run


query("resolve_outcome_0")(_resolve(False))
query("resolve_outcome_1")(_resolve(True))


@query()
def impute_dob(spark, sf_dir):
    return cleaning.impute_dob(_days(spark, sf_dir)).select("patid", "date_admit", "dob", "birthyear")


@query()
def followup_end(spark, sf_dir):
    return derive.with_followup(_days(spark, sf_dir), DEAD).select(
        "patid", "date_admit", "date_dis", "time_at_lastfup", "time_dis_to_lastfup")


@query()
def index_cohort_semi(spark, sf_dir):
    return derive.cohort(_days(spark, sf_dir), DEAD).select(
        "patid", "date_admit", "icd_m3", "measles", "age_at_admit_d")


@query()
def index_order(spark, sf_dir):
    return derive.cohort(_days(spark, sf_dir), DEAD).select("patid", "date_admit", "measles_order")


@query()
def gap_days(spark, sf_dir):
    return ep.gap_days(derive.cohort(_days(spark, sf_dir), DEAD)).select(
        "patid", "date_admit", "tim_diff")


def _merge(cfg: CohortConfig) -> Query:
    def run(spark, sf_dir):
        return derive.merged(_days(spark, sf_dir), cfg).select(
            "patid", "date_admit", "date_dis", "icd_m3", "measles", "measles_order", "measles_group",
            "age_at_admit_d", "outcome")

    return run


query("merge_close_pairwise")(_merge(DEAD))
query("merge_close_transitive")(_merge(TRANSITIVE))


@query()
def event_chains_transitive(spark, sf_dir):
    days = cleaning.merge_same_start(star.event_admissions(spark, sf_dir), TRANSITIVE)
    days = ep.gap_days(ep.index_order(ep.flag_admissions(days, TRANSITIVE)))
    return ep.merge_close(days, TRANSITIVE).select("patid", "date_admit", "date_dis")


@query()
def classify_infection(spark, sf_dir):
    rows = derive.merged(_days(spark, sf_dir), DEAD)
    return ep.classify_infection(rows, DEAD).select("patid", "date_admit", "infection_type")


@query()
def anchor_index(spark, sf_dir):
    return derive.anchored(_days(spark, sf_dir), DEAD).select(
        "patid", "date_admit", "date_admit_index", "date_dis_index", "age_at_index_d", "hospitalization",
        "time_ad_index_to_ad", "period")


@query()
def exclude_anti(spark, sf_dir):
    rows = derive.anchored(_days(spark, sf_dir), DEAD)
    return ep.exclude_code(rows, DEAD).select("patid", "date_admit", "icd_m3")


def _all_episodes(cfg: CohortConfig) -> Query:
    return lambda spark, sf_dir: rounded(_episodes(spark, sf_dir, cfg), 9, "age")


query("episodes")(_all_episodes(DEAD))
query("episodes_worse_alive")(_all_episodes(ALIVE))
query("episodes_prefiltered")(_all_episodes(PREFILTERED))


@query()
def period_counts(spark, sf_dir):
    # Two steps, so that a hot period is summed from per-subject counts.
    per_subject = _episodes(spark, sf_dir).groupBy("period", "patid").agg(F.count(F.lit(1)).alias("n"))
    return per_subject.groupBy("period").agg(
        F.sum("n").alias("n_rows"), F.count(F.lit(1)).alias("n_subjects"))


@query()
def lookback_rows(spark, sf_dir):
    return ep.lookback(_episodes(spark, sf_dir), DEAD.lookback_days).select("patid", "date_admit", "period")


@query()
def last_seen(spark, sf_dir):
    rows = ep.last_seen(_episodes(spark, sf_dir)).where(F.col("period") != c.PERIOD_BEFORE)
    return rows.select("patid", "date_admit", "last_year", "date_dis_last")


@query()
def first_record(spark, sf_dir):
    return ep.first_record(_episodes(spark, sf_dir)).select("patid", "period", "date_admit")


@query()
def stage_counts(spark, sf_dir):
    return derive.stage_counts(star.admissions(spark, sf_dir), DEAD)


# Intervals and person-time --------------------------------------------------

@query()
def before_intervals(spark, sf_dir):
    return timeline.intervals_before(_intervals(spark, sf_dir)).select(
        "patid", "date_admit", "flag_index_impute", "status", "obs_time", "time_start", "time_stop",
        "infection_type", "hospitalization")


@query()
def after_intervals(spark, sf_dir):
    return timeline.intervals_after(_intervals(spark, sf_dir))


@query()
def washout_fold(spark, sf_dir):
    rows = timeline.fold_washout(timeline.sides(_episodes(spark, sf_dir), DEAD), DEAD)
    return rows.where(F.col("side") == timeline.AFTER).select(
        "patid", "period", "date_admit", "date_dis", "date_dis_index", "time_at_lastfup")


def _rounded_weeks(weeks: DataFrame) -> DataFrame:
    return rounded(weeks, 9, "age_at_infection", "time_after_index", "offset_time", "age_at_index_y", "time_interval")


@query()
def person_weeks(spark, sf_dir):
    return _rounded_weeks(_weeks(spark, sf_dir))


@query()
def person_weeks_before(spark, sf_dir):
    return _rounded_weeks(_weeks(spark, sf_dir).where(F.col("period") == c.PERIOD_BEFORE))


@query()
def person_weeks_after(spark, sf_dir):
    return _rounded_weeks(_weeks(spark, sf_dir).where(F.col("period") == c.PERIOD_AFTER))


def _wave(mode: str) -> Query:
    return lambda spark, sf_dir: persontime.wave(_weeks(spark, sf_dir), mode).select(
        "patid", "week", "infection_type", "hospitalization", "period", "wave")


query("wave")(_wave("skip"))
query("wave_plain")(_wave("plain"))


@query()
def calendar_year(spark, sf_dir):
    return _weeks(spark, sf_dir).groupBy("calendar_year", "period").agg(
        F.count(F.lit(1)).alias("n"), F.sum("status").alias("events"), F.sum("n_days").alias("days"))


def _subpopulation(spec: ModelSpec) -> Query:
    def run(spark, sf_dir):
        weeks = persontime.subpopulation(_weeks(spark, sf_dir), spec.max_age, spec.max_time)
        return weeks.groupBy("period").agg(F.count(F.lit(1)).alias("n"), F.sum("n_days").alias("days"))

    return run


query("subpopulation_under13")(_subpopulation(c.UNDER13))
query("subpopulation_under4")(_subpopulation(c.UNDER4))


@query()
def subject_span(spark, sf_dir):
    return rounded(report.figure_spans(_weeks(spark, sf_dir)), 9,
                   "age_at_index_y", "tstart", "age_start", "tstop", "age_stop")


@query()
def figure_events(spark, sf_dir):
    return rounded(report.figure_events(_weeks(spark, sf_dir)), 9, "age_at_infection", "relative_time")


@query()
def followup_by_year(spark, sf_dir):
    return rounded(persontime.followup_by_year(_weeks(spark, sf_dir), *star.YEARS), 6, "person_years")


@query()
def max_event_time(spark, sf_dir):
    return rounded(persontime.max_event_time(_weeks(spark, sf_dir)), 9, "max_time")


@query()
def retention_ratio(spark, sf_dir):
    return rounded(persontime.retention_ratio(_weeks(spark, sf_dir)), 9, "ratio")


# Rates ----------------------------------------------------------------------

@query()
def crude_rates(spark, sf_dir):
    return rounded(persontime.crude_rates(_weeks(spark, sf_dir)), 9, "rate").withColumn(
        "person_years", F.round("person_years", 6))


@query()
def crude_irr_robust(spark, sf_dir):
    return rounded(persontime.crude_irr(_weeks(spark, sf_dir)), 6,
                   "estimate", "std_err", "irr", "irr_lower", "irr_upper")


@query()
def piecewise_rates(spark, sf_dir):
    return rounded(persontime.piecewise_rates(_weeks(spark, sf_dir), c.BANDS), 9, "rate").withColumns(
        {name: F.round(name, 6) for name in ("person_years", "log_rate_ratio")})


@query()
def cut_right_closed(spark, sf_dir):
    band = cut("time_after_index", c.BANDS, include_lowest=True)
    return _weeks(spark, sf_dir).groupBy(band.alias("band")).agg(F.count(F.lit(1)).alias("n"))


# Descriptive tables ---------------------------------------------------------

@query()
def monthly_counts(spark, sf_dir):
    return summary.monthly_counts(star.admissions(spark, sf_dir), DEAD.index_code)


@query()
def monthly_spine(spark, sf_dir):
    return rounded(report.monthly_index_series(star.admissions(spark, sf_dir), DEAD.index_code, *star.YEARS),
                   9, "time")


@query()
def reason_pivot(spark, sf_dir):
    return report.reason_table(_episodes(spark, sf_dir, ALIVE), icd_dim(star.icd_codes(spark)))


@query()
def reason_pivot_repeats(spark, sf_dir):
    return report.reason_table(_episodes(spark, sf_dir, ALIVE), icd_dim(star.icd_codes(spark)), True)


def _table_rows(spark, sf_dir) -> DataFrame:
    return report.table_rows(_episodes(spark, sf_dir, ALIVE))


def _continuous(mode: str) -> Query:
    def run(spark, sf_dir):
        rows = summary.summarize_continuous(_table_rows(spark, sf_dir), "age", "period_label", mode)
        return rounded(rows, 9, *summary.MODES[mode])

    return run


for _name, _mode in [("iqr", "med.IQR"), ("90", "med.90"), ("range", "med.range"), ("mic", "MIC")]:
    query(f"baseline_continuous_{_name}")(_continuous(_mode))


@query()
def order_price_quantiles(spark, sf_dir):
    orders = star.table(spark, sf_dir, "orders")
    rows = summary.summarize_continuous(orders, "o_totalprice", "o_orderstatus", "med.IQR", pooled=True)
    return rounded(rows, 9, *summary.MODES["med.IQR"])


@query()
def pooled_groups(spark, sf_dir):
    rows = summary.summarize_continuous(
        _table_rows(spark, sf_dir), "age", "period_label", "med.IQR", pooled=True)
    return rounded(rows, 9, *summary.MODES["med.IQR"])


TABLE_GROUPS = list(report.TABLE_PERIODS.values())


@query()
def baseline_categorical(spark, sf_dir):
    return summary.summarize_categorical(_table_rows(spark, sf_dir), "outcome", "period_label", TABLE_GROUPS)


@query()
def baseline_characteristics(spark, sf_dir):
    table = report.baseline_characteristics(_episodes(spark, sf_dir, ALIVE))
    return rounded(table, 9, *summary.MODES["med.IQR"])


@query()
def baseline_comparisons(spark, sf_dir):
    """Table 1 with the p-values of its comparisons."""
    table = report.baseline_characteristics(_episodes(spark, sf_dir, ALIVE), compare=True)
    return rounded(table, 9, *summary.MODES["med.IQR"], "p_value")


@query()
def group_sizes(spark, sf_dir):
    return summary.group_sizes(_table_rows(spark, sf_dir), "period_label", pooled=True)


@query()
def outcome_crosstab(spark, sf_dir):
    return summary.crosstab(_episodes(spark, sf_dir), "outcome", "period", c.PERIODS)


@query()
def kruskal_h(spark, sf_dir):
    return rounded(summary.kruskal_h(_episodes(spark, sf_dir), "age", "period"), 6, "h", "p_value")


@query()
def histogram(spark, sf_dir):
    return rounded(summary.histogram(_weeks(spark, sf_dir), "age_at_infection", 0.0, 0.25, ["period"]),
                   6, "bin_start")


@query()
def histogram_relative(spark, sf_dir):
    weeks = _weeks(spark, sf_dir).withColumn("relative_time", report.relative_time())
    return rounded(summary.histogram(weeks, "relative_time", 0.0, 0.25, ["period"]), 6, "bin_start")


@query()
def sample_topk(spark, sf_dir):
    return rounded(report.figure_sample(_weeks(spark, sf_dir)).select("patid", "age_stop"), 9, "age_stop")


@query()
def recode_levels(spark, sf_dir):
    coded = recode("outcome", ["discharged", "dead"], ["Discharged", "Dead"])
    return _episodes(spark, sf_dir).groupBy(coded.alias("r")).agg(F.count(F.lit(1)).alias("n")).select("r.*", "n")


@query()
def bound_chain_join(spark, sf_dir):
    return rounded(report.mortality_rates(star.mortality(spark, sf_dir), year=None), 6, "value")


@query()
def mortality_share(spark, sf_dir):
    return rounded(report.mortality_share(star.mortality(spark, sf_dir), year=2000), 6, "value")


# Scenarios ------------------------------------------------------------------

@query()
def scenario_censoring(spark, sf_dir):
    rows = _episodes(spark, sf_dir).where(F.col("period") == c.PERIOD_INDEX).select("patid")
    return scenarios.censoring_days(scenarios.fan_out(rows, SCENARIO_ROWS)).select(
        "scenario_id", "patid", "emigration_days")


@query()
def scenario_followup(spark, sf_dir):
    return _scenario_episodes(spark, sf_dir).select(
        "scenario_id", "patid", "date_admit", "period", "time_at_lastfup", "time_dis_to_lastfup")


@query()
def scenario_person_time(spark, sf_dir):
    return _scenario_weeks(spark, sf_dir).groupBy("scenario_id", "period").agg(
        F.count(F.lit(1)).alias("n"), F.sum("status").alias("events"), F.sum("n_days").alias("days"))


# Models ---------------------------------------------------------------------

@query("ns_basis")
def ns_basis_means(spark, sf_dir):
    basis = ns_basis("age_at_infection", c.AGE_KNOTS, (0.0, c.AGE_BOUNDARY))
    return (
        _weeks(spark, sf_dir).select("period", F.posexplode(basis).alias("k", "v"))
        .groupBy("period", "k").agg(F.round(F.avg("v"), 5).alias("mean"))
    )


_SAVED: dict[tuple, object] = {}


def _saved(spark: SparkSession, sf_dir: str, key: tuple, make: Callable):
    """Subject tables and fits are made once per session and state of the files, and read by later queries."""
    key = (spark.sparkContext.applicationId, sf_dir, fingerprint(spark, sf_dir), *key)
    if key not in _SAVED:
        _SAVED[key] = make()
    return _SAVED[key]


# All scenarios are cuts of one table.
CUT_ROWS = [*SCENARIO_ROWS, *MI_ROWS, *SWEEP_ROWS]


def _subjects(spark, sf_dir, kind: str = "dead") -> DataFrame:
    """Subjects with their weeks, straight from the derivation: the nesting uses its shuffle by subject."""
    def nested():
        if kind == "cuts":
            return gee.nest_weeks(scenarios.cuttable_weeks(_episodes(spark, sf_dir), DEAD, star.YEARS), scenarios.cut_days(CUT_ROWS))
        return gee.nest_weeks(_weeks(spark, sf_dir, {"dead": DEAD, "alive": ALIVE}[kind]))

    return _saved(spark, sf_dir, ("subjects", kind), lambda: materialize(gee.pack_weeks(nested()), f"subjects-{kind}"))


# Calendar years are centred on the middle of the observed span.
CALENDAR = c.CALENDAR.but(calendar_center=1998)
CUTS_OF = {"emigration_mi": MI_ROWS, "emigration_sweep": SWEEP_ROWS}


def _fit(spark, sf_dir, spec: ModelSpec, rows: list[Emigration] | None = None) -> gee.ModelStore:
    rows = rows or CUTS_OF.get(spec.name)
    kind = "cuts" if rows else "alive" if spec.name == "worse_alive" else "dead"
    chosen = {"cuts": [s.scenario_id for s in CUT_ROWS], "only": [s.scenario_id for s in rows]} if rows else {}
    return _saved(spark, sf_dir, ("fit", spec, *chosen.get("only", ())), lambda: gee.fit_nested(_subjects(spark, sf_dir, kind), spec, **chosen))


def _coefficients(store: gee.ModelStore) -> DataFrame:
    return contrasts.contrast_subset(store).select("model_id", "term", F.col("estimate").alias("beta"), "std_err")


def _model(spec: ModelSpec) -> Query:
    return lambda spark, sf_dir: rounded(_coefficients(_fit(spark, sf_dir, spec)), 6, "beta", "std_err")


query("gee_main")(_model(c.MAIN))
query("gee_interaction")(_model(c.INTERACTION))
query("gee_worse_alive")(_model(c.WORSE_ALIVE))
query("gee_emigration_mi")(_model(c.EMIGRATION_MI))
query("gee_emigration_sweep")(_model(c.EMIGRATION_SWEEP))
query("gee_under13")(_model(c.UNDER13))
query("gee_calendar")(_model(CALENDAR))
query("gee_under4")(_model(c.UNDER4))
query("gee_knots_age6")(_model(c.KNOTS_AGE6))
query("gee_knots_time6")(_model(c.KNOTS_TIME6))
query("gee_period_only")(_model(PERIOD))


@query()
def gee_bands_only(spark, sf_dir):
    """The banded model without other terms, next to the crude rates of the same bands."""
    return rounded(contrasts.band_table(_fit(spark, sf_dir, c.BANDS_ONLY)), 5, "estimate", "std_err").select(
        "band", "estimate", "std_err")


@query()
def gee_piecewise(spark, sf_dir):
    return rounded(contrasts.band_table(_fit(spark, sf_dir, c.PIECEWISE)), 6,
                   "midpoint", "estimate", "std_err", "lower", "upper")


@query()
def gee_period_scenarios(spark, sf_dir):
    store = _fit(spark, sf_dir, PERIOD, SCENARIO_ROWS)
    return rounded(_coefficients(store), 6, "beta", "std_err")


@query()
def pool_rubin_period(spark, sf_dir):
    pooled = contrasts.pool_rubin(_fit(spark, sf_dir, PERIOD, SCENARIO_ROWS))
    return rounded(_coefficients(pooled).select("term", "beta", "std_err"), 6, "beta", "std_err")


@query()
def pool_rubin(spark, sf_dir):
    return rounded(_coefficients(contrasts.pool_rubin(_fit(spark, sf_dir, c.EMIGRATION_MI))), 6, "beta", "std_err")


ESTIMATES = ("estimate", "std_err", "lower", "upper")


@query()
def irr_curve(spark, sf_dir):
    return rounded(contrasts.irr_curve(_fit(spark, sf_dir, c.MAIN), c.MAIN), 6, *ESTIMATES)


@query()
def irr_curve_pooled(spark, sf_dir):
    pooled = contrasts.pool_rubin(_fit(spark, sf_dir, c.EMIGRATION_MI))
    return rounded(contrasts.irr_curve(pooled, c.EMIGRATION_MI, stop=6.0), 6, *ESTIMATES)


@query()
def irr_table(spark, sf_dir):
    return contrasts.irr_table(_fit(spark, sf_dir, c.MAIN), c.MAIN).select(
        "model_id", "position", "label", "irr",
        *(F.round(f"exp_{n}", 6).alias(n) for n in ("estimate", "lower", "upper")))


# The curves and tables of all models: specification and last time shown.
CURVE_ENDS = [(c.MAIN, 10.0), (c.WORSE_ALIVE, 6.0), (c.UNDER13, 6.0), (CALENDAR, 10.0), (c.UNDER4, 2.0),
              (c.KNOTS_AGE6, 10.0), (c.KNOTS_TIME6, 10.0)]


@query()
def model_curves(spark, sf_dir):
    curves = [contrasts.irr_curve(_fit(spark, sf_dir, spec), spec, stop=stop) for spec, stop in CURVE_ENDS]
    return rounded(reduce(DataFrame.unionByName, curves), 6, *ESTIMATES)


@query()
def model_tables(spark, sf_dir):
    pooled = contrasts.pool_rubin(_fit(spark, sf_dir, c.EMIGRATION_MI))
    tables = [contrasts.irr_table(_fit(spark, sf_dir, spec), spec) for spec in (c.MAIN, c.WORSE_ALIVE, c.UNDER13)]
    tables.append(contrasts.irr_table(pooled, c.EMIGRATION_MI))
    return reduce(DataFrame.unionByName, tables).select(
        "model_id", "position", "label", "irr",
        *(F.round(f"exp_{n}", 6).alias(n) for n in ("estimate", "lower", "upper")))


@query()
def scenario_curves(spark, sf_dir):
    store = _fit(spark, sf_dir, c.EMIGRATION_SWEEP)
    return rounded(contrasts.scenario_curves(store, c.EMIGRATION_SWEEP), 6, *ESTIMATES)


@query()
def predict_rate(spark, sf_dir):
    grid = contrasts.rate_grid(_fit(spark, sf_dir, c.MAIN))
    return rounded(contrasts.predict_rate(grid, c.MAIN), 6, *ESTIMATES)


@query()
def predict_rate_period(spark, sf_dir):
    grid = contrasts.rate_grid(
        _fit(spark, sf_dir, PERIOD), [("before", -1.0), ("after", 1.0)], max_age=0.0)
    rows = contrasts.predict_rate(grid, PERIOD).select("sex", "time_label", *ESTIMATES)
    return rounded(rows, 6, *ESTIMATES)


@query()
def rate_difference(spark, sf_dir):
    grid = contrasts.rate_grid(_fit(spark, sf_dir, c.MAIN), contrasts.RATE_TIMES[1:])
    return rounded(contrasts.rate_difference(grid, c.MAIN), 6, *ESTIMATES)


@query()
def rate_difference_period(spark, sf_dir):
    grid = contrasts.rate_grid(_fit(spark, sf_dir, PERIOD), [("after", 1.0)], max_age=0.0)
    rows = contrasts.rate_difference(grid, PERIOD).select("sex", *ESTIMATES)
    return rounded(rows, 6, *ESTIMATES)


@query()
def zero_crossing(spark, sf_dir):
    store = _fit(spark, sf_dir, c.EMIGRATION_SWEEP)
    curves = contrasts.scenario_curves(store, c.EMIGRATION_SWEEP, stop=10.0)
    return rounded(contrasts.zero_crossing(curves, 2 / 52, 10.0), 6, "time_at_zero")


# The same operators on models with a closed form, so that SQL can repeat them.

@query()
def irr_curve_period(spark, sf_dir):
    return rounded(contrasts.irr_curve(_fit(spark, sf_dir, PERIOD), PERIOD), 6, "time_after_index", *ESTIMATES).select(
        "model_id", "time_after_index", *ESTIMATES)


@query()
def irr_table_period(spark, sf_dir):
    return contrasts.irr_table(_fit(spark, sf_dir, PERIOD), PERIOD).select(
        "position", "label", *(F.round(f"exp_{n}", 6).alias(n) for n in ("estimate", "lower", "upper")))


@query()
def irr_table_bands(spark, sf_dir):
    """The banded model's rate ratio at the named times, each in its band."""
    return contrasts.irr_table(_fit(spark, sf_dir, c.BANDS_ONLY), c.BANDS_ONLY, c.TABLE_TIMES).select(
        "position", "label", *(F.round(n, 5).alias(n) for n in ("estimate", "std_err")))


@query()
def scenario_curves_period(spark, sf_dir):
    curves = contrasts.scenario_curves(_fit(spark, sf_dir, PERIOD, SCENARIO_ROWS), PERIOD, step=0.5)
    return rounded(curves, 6, "time_after_index", *ESTIMATES).select("scenario_id", "time_after_index", *ESTIMATES)


@query()
def zero_crossing_bands(spark, sf_dir):
    """Where the banded model's curve changes sign, between points of the grid."""
    curve = contrasts.irr_curve(_fit(spark, sf_dir, c.BANDS_ONLY), c.BANDS_ONLY, start=0.05, step=0.25)
    return rounded(contrasts.zero_crossing(curve, 0.05, 10.0), 3, "time_at_zero")


@query()
def contrast_subset_period(spark, sf_dir):
    return rounded(contrasts.contrast_subset(_fit(spark, sf_dir, PERIOD), subset=["^after$", "Inter"]).select(
        "term", *ESTIMATES), 6, *ESTIMATES)


@query()
def coef_table(spark, sf_dir):
    return contrasts.coef_table(_fit(spark, sf_dir, c.MAIN))


@query()
def coef_table_period(spark, sf_dir):
    names = ("estimate", "std_err", "exp_estimate", "exp_lower", "exp_upper")
    return rounded(contrasts.coef_table(_fit(spark, sf_dir, PERIOD)).select("term", *names), 6, *names)


@query()
def wald_test(spark, sf_dir):
    """Sequential tests of the interaction model's blocks, each in the model that adds it; overall: the interactions."""
    subsets, blocks = gee.sequence_blocks(c.INTERACTION)
    store = _saved(spark, sf_dir, ("sequence",), lambda: gee.fit_nested(_subjects(spark, sf_dir), c.INTERACTION, subsets))
    return rounded(gee.wald_test(store, blocks, per_model=True, overall=("age_time", "sex_age", "sex_time")), 6, "chi2", "p_value")


@query()
def wald_period(spark, sf_dir):
    tested = gee.wald_test(_fit(spark, sf_dir, PERIOD), {"after": ["after"]})
    return rounded(tested.select("block", "chi2", "df"), 4, "chi2")


@query()
def pairwise_diffs(spark, sf_dir):
    return rounded(contrasts.pairwise_diffs(_fit(spark, sf_dir, c.MAIN)), 6, *ESTIMATES)


@query()
def pairwise_diffs_period(spark, sf_dir):
    rows = contrasts.pairwise_diffs(_fit(spark, sf_dir, PERIOD)).select("contrast", "estimate", "std_err")
    return rounded(rows, 6, "estimate", "std_err")


@query()
def contrast_subset(spark, sf_dir):
    return rounded(contrasts.contrast_subset(_fit(spark, sf_dir, c.INTERACTION), subint=["sexmale", "ns_time"]),
                   6, *ESTIMATES)


@query()
def contrast_draws(spark, sf_dir):
    rows = contrasts.unit_contrasts(_fit(spark, sf_dir, c.MAIN), "^(after|ns_time)")
    return rounded(contrasts.contrast_draws(rows, 1000), 6, "value")


def spline_weights():
    basis = age_spline(c.MAIN)
    return basis.knots, basis.weights
