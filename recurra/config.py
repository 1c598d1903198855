"""Run settings: cohort rules, code lists, scenario rows and model specifications."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass, replace

DAYS_PER_YEAR = 365
# Gap given to a subject's first admission, which has no previous discharge.
FIRST_GAP_DAYS = 10000


def code_list(prefix: str, lo: int, hi: int) -> list[str]:
    """Three-character codes prefix+lo .. prefix+hi, two digits each."""
    return [f"{prefix}{n:02d}" for n in range(lo, hi + 1)]


DIARRHEA_CODES = code_list("A", 0, 9)
RESPIRATORY_CODES = code_list("J", 0, 22)
# G08 belongs to the infection list but not to this one.
CNS_CODES = code_list("A", 80, 89) + code_list("G", 0, 7) + ["G09"]
INFECTION_CODES = (
    code_list("A", 0, 99) + code_list("B", 0, 99) + code_list("J", 0, 22) + code_list("G", 0, 9)
)

# Result labels.
LABEL_INDEX = "Measles"
LABEL_REPEAT = "Measles complicated"
LABEL_DIARRHEA = "Diarrhea"
LABEL_RESPIRATORY = "Respiratory Infection"
LABEL_CNS = "CNS Infection"
LABEL_OTHER = "Other infection"

PERIOD_BEFORE, PERIOD_INDEX, PERIOD_AFTER = "before", "measles", "after"
PERIODS = [PERIOD_BEFORE, PERIOD_INDEX, PERIOD_AFTER]

OUTCOME_DISCHARGED = "discharged"
OUTCOME_WORSE = "presumably.worse"
OUTCOME_DEAD = "dead"
UNKNOWN = "unknown"


@dataclass(frozen=True)
class CohortConfig:
    """Rules that turn admissions into episodes and person-time.

    `worse_as_dead` and `followup_end` have no default: the two entry points of
    the analysis use different ones, so each caller states its own.

    na_poison      a missing date voids its group's min/max instead of being skipped
    merge_mode     "pairwise" joins an admission to the one before it only;
                   "transitive" joins whole chains
    birthday_mode  "strict" has no 15th birthday for 29 February births in a
                   non-leap year; "clamp" moves it to 28 February
    washout_from   "admit" or "discharge" of the index event
    """

    followup_end: dt.date
    worse_as_dead: bool
    index_code: str = "B05"
    exclusion_code: str = "B20"
    gap_days: int = 2
    merge_mode: str = "pairwise"
    lookback_days: int = 2 * DAYS_PER_YEAR
    washout_days: int = 14
    washout_from: str = "admit"
    age_cap_years: int = 15
    na_poison: bool = True
    birthday_mode: str = "strict"
    prefilter_index_subjects: bool = False

    @property
    def repeat_code(self) -> str:
        return f"{self.index_code}*"

    @classmethod
    def for_option(cls, option: int, followup_end: dt.date, **other) -> CohortConfig:
        """Outcome policy 0 (worse is alive), 1 (worse is dead) or 2 (as 1, to be censored)."""
        if option not in (0, 1, 2):
            raise ValueError(f"option must be 0, 1 or 2, not {option!r}")
        return cls(followup_end=followup_end, worse_as_dead=option >= 1, **other)


@dataclass(frozen=True)
class Emigration:
    """One censoring scenario; rate per person-year, 0 means nobody leaves."""

    scenario_id: str
    rate: float
    seed: int


# Rates of the one-seed sweep, and the city's own rate.
SWEEP_RATES = [0.01, 0.1, 0.15, 0.2, 0.25, 0.3, 0.35, 0.4, 0.45, 0.5, 0.55, 0.6, 0.65, 0.7,
               0.75, 0.8, 0.85, 0.9, 0.95, 0.975]
CITY_RATE = 0.0083


# Scenarios of the queries that SQL repeats, and the seeds of the multiple imputation.
SCENARIOS = [("none", 0.0, 1), ("city", CITY_RATE, 11), ("fast", 0.25, 1234)]
IMPUTATION_SEEDS = [11 + 487 * i for i in range(20)]


def seed_scenarios(seeds: list[int], rate: float = CITY_RATE) -> list[Emigration]:
    return [Emigration(f"seed_{seed}", rate, seed) for seed in seeds]


def rate_scenarios(rates: list[float] = SWEEP_RATES, seed: int = 1234) -> list[Emigration]:
    return [Emigration(f"rate_{rate:g}", rate, seed) for rate in rates]


# Spline knots in years, and the bands of the piecewise model.
AGE_KNOTS = (0.5, 1.0, 1.5, 2.0, 2.5, 3.0, 5.0)
TIME_KNOTS = (1 / 12, 2 / 12, 5 / 12, 8 / 12, 1.0, 1.5, 3.0)
AGE_BOUNDARY = 7.5
TIME_BOUNDARY = 5.0
BANDS = (-1.0, 0.0, *TIME_KNOTS, 4.5, 6.0, 8.0, 10.0)
WASHOUT_YEARS = 14 / 365


@dataclass(frozen=True)
class ModelSpec:
    """A clustered log-rate model: which terms enter and on which rows.

    time_effect   "spline" (step after washout, then a curve), "bands", "step" or "none"
    wave_mode     "skip" numbers weeks per subject and leaves one number out for
                  the washout; "plain" numbers them without the gap
    correlation   "ar1" or "independence"
    """

    name: str
    age_knots: tuple[float, ...] = AGE_KNOTS
    age_boundary: float = AGE_BOUNDARY
    time_knots: tuple[float, ...] = TIME_KNOTS
    time_boundary: float = TIME_BOUNDARY
    age_effect: bool = True
    sex_effect: bool = True
    time_effect: str = "spline"
    bands: tuple[float, ...] = BANDS
    interactions: bool = False
    interaction_age_knots: tuple[float, ...] = (1.5,)
    interaction_time_knots: tuple[float, ...] = (0.5,)
    calendar: bool = False
    calendar_center: int = 2010
    max_age: float | None = None
    max_time: float | None = None
    wave_mode: str = "skip"
    correlation: str = "ar1"

    def but(self, **changes) -> ModelSpec:
        return replace(self, **changes)


MAIN = ModelSpec("main")
INTERACTION = ModelSpec("interaction", interactions=True)
WORSE_ALIVE = ModelSpec("worse_alive")
EMIGRATION_MI = ModelSpec("emigration_mi", wave_mode="plain")
EMIGRATION_SWEEP = ModelSpec("emigration_sweep")
UNDER13 = ModelSpec("under13", max_age=13.0)
PIECEWISE = ModelSpec("piecewise", time_effect="bands")
CALENDAR = ModelSpec("calendar", calendar=True, wave_mode="plain")
UNDER4 = ModelSpec(
    "under4", age_knots=(0.5, 1.0, 1.5, 2.0, 2.5, 3.0), age_boundary=4.0,
    time_knots=(1 / 12, 2 / 12, 5 / 12, 8 / 12, 1.0, 1.5), time_boundary=2.0,
    max_age=4.0, max_time=2.0,
)
KNOTS_AGE6 = ModelSpec("knots_age6", age_knots=(0.5, 1.0, 1.5, 2.0, 3.0, 5.0))
KNOTS_TIME6 = ModelSpec("knots_time6", time_knots=(1 / 12, 2 / 12, 5 / 12, 8 / 12, 1.0, 3.0))
PERIOD_ONLY = ModelSpec("period_only", age_effect=False, sex_effect=False, time_effect="step",
                        correlation="independence")
BANDS_ONLY = ModelSpec("bands_only", age_effect=False, sex_effect=False, time_effect="bands",
                       correlation="independence")

MODEL_SPECS = {
    spec.name: spec
    for spec in (MAIN, INTERACTION, WORSE_ALIVE, EMIGRATION_MI, EMIGRATION_SWEEP, UNDER13,
                 PIECEWISE, CALENDAR, UNDER4, KNOTS_AGE6, KNOTS_TIME6)
}

# The times of the printed rate-ratio table.
TABLE_TIMES = [
    ("2 weeks", 14 / 365), ("3 weeks", 21 / 365), ("1 month", 30.4 / 365),
    ("2 months", 60.8 / 365), ("3 months", 90.25 / 365), ("6 months", 182.5 / 365),
    ("9 months", 273.8 / 365), ("1 year", 1.0), ("1.5 year", 1.5), ("2 years", 2.0),
    ("3 years", 3.0), ("4 years", 4.0), ("5 years", 5.0), ("5.5 years", 5.5), ("6 years", 6.0),
]
