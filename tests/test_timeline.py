import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from recurra.operators import persontime, timeline
from recurra.plans import derive
from tests.helpers import BORN, CFG, adm, admissions, day, dicts

LAST = 3000  # no admission of the cases lies after this day


def intervals(spark, rows, cfg=CFG):
    return timeline.risk_intervals(derive.derive_episodes(admissions(spark, rows), cfg), cfg)


def before(spark, rows):
    got = dicts(timeline.intervals_before(intervals(spark, rows)), "patid", "time_start")
    return [(r["flag_index_impute"], r["time_start"], r["time_stop"], r["status"]) for r in got]


def after(spark, rows):
    got = dicts(timeline.intervals_after(intervals(spark, rows)), "patid", "time_start")
    return [(r["period"], r["time_start"], r["time_stop"], r["status"]) for r in got]


def end_of_followup(discharge):
    return (BORN.replace(year=2015) - day(discharge)).days


def test_index_without_prior_event(spark):
    assert before(spark, [adm(1, 0, 3, "B05")]) == [(2, 0, 730, 0)]


def test_prior_event_inside_the_lookback_and_tail(spark):
    # Event 100 days before the index: day 630 of the look-back, 4 days in hospital.
    assert before(spark, [adm(1, -100, -96), adm(1, 0, 3, "B05")]) == [(3, 0, 630, 1), (3, 634, 730, 0)]


def test_prior_event_exactly_at_the_start_of_the_lookback(spark):
    assert before(spark, [adm(1, -730, -727), adm(1, 0, 3, "B05")]) == [(3, 0, 1, 1), (3, 4, 730, 0)]


def test_prior_event_before_the_lookback_is_ignored(spark):
    assert before(spark, [adm(1, -731, -727), adm(1, 0, 3, "B05")]) == [(2, 0, 730, 0)]


def test_young_subject_counts_from_birth(spark):
    born = day(-200)
    rows = [adm(1, -50, -48, dob=born, birthyear=2005), adm(1, 0, 3, "B05", dob=born, birthyear=2005)]
    assert before(spark, rows) == [(3, 0, 150, 1), (3, 152, 200, 0)]


def test_born_and_admitted_on_the_same_day(spark):
    born = day(-200)
    rows = [adm(1, -200, -190, dob=born, birthyear=2005), adm(1, 0, 3, "B05", dob=born, birthyear=2005)]
    assert before(spark, rows) == [(3, 0, 1, 1), (3, 11, 200, 0)]


def test_washout_folds_day_14_and_keeps_day_15(spark):
    assert after(spark, [adm(1, 0, 3, "B05"), adm(1, 14, 16)]) == [("measles", 0, end_of_followup(16), 0)]
    assert after(spark, [adm(1, 0, 3, "B05"), adm(1, 15, 17)]) == [
        ("measles", 0, 1, 1), ("after", 3, end_of_followup(14), 0)]


def test_after_interval_with_negative_start(spark):
    # The second stay joins the index, so the third, close to the second, stands alone inside it.
    rows = [adm(1, 0, 12, "B05"), adm(1, 10, 40), adm(1, 20, 22), adm(1, 60, 61)]
    assert after(spark, rows) == [("after", -18, 20, 1), ("after", 21, end_of_followup(40), 0)]


def test_fatal_opener_is_dropped_and_the_interval_before_it_stays(spark):
    rows = [adm(1, 0, 3, "B05"), adm(1, 100, 110, outcome="dead")]
    assert after(spark, rows) == [("measles", 0, 100 - 14, 1)]


def test_washout_from_discharge(spark):
    cfg = CFG.__class__(CFG.followup_end, True, washout_from="discharge")
    got = dicts(timeline.intervals_after(intervals(spark, [adm(1, 0, 10, "B05"), adm(1, 20, 21)], cfg)), "patid")
    assert [(r["date_dis_index"], r["hospitalization_index"]) for r in got] == [(day(24), 24)]


PIECE = "patid bigint, side string, sex string, district string, age_at_index_d int, infection_type string, " \
        "hospitalization int, hospitalization_index int, dob_first date, time_start int, time_stop int, status int"


def piece(patid, start, stop, status, kind="x", stay=1):
    return (patid, "after", "male", "d", 1000, kind, stay, 14, BORN, start, stop, status)


def weeks(spark, rows):
    split = persontime.split_person_time(spark.createDataFrame(rows, PIECE))
    return [
        (r["week"], r["n_days"], r["sum_day"], r["status"])
        for r in dicts(persontime.to_weeks(split), "patid", "infection_type", "week")]


@pytest.mark.parametrize("stop, expected", [
    (7, [(1, 7, 28, 1)]), (8, [(1, 7, 28, 0), (2, 1, 8, 1)]), (14, [(1, 7, 28, 0), (2, 7, 77, 1)])])
def test_week_edges(spark, stop, expected):
    assert weeks(spark, [piece(1, 0, stop, 1)]) == expected


def test_two_intervals_in_one_week(spark):
    same = weeks(spark, [piece(1, 0, 2, 1), piece(1, 4, 7, 1)])
    assert same == [(1, 5, 1 + 2 + 5 + 6 + 7, 2)]
    assert weeks(spark, [piece(1, 0, 2, 1, "x"), piece(1, 4, 7, 1, "y")]) == [(1, 2, 3, 1), (1, 3, 18, 1)]


def test_negative_start_is_one_day_without_week(spark):
    assert weeks(spark, [piece(1, -5, 3, 1)]) == [(1, 3, 6, 1), (None, 1, 0, 0)]
    assert weeks(spark, [piece(1, -5, -2, 1)]) == [(None, 1, 0, 1)]


def test_weekly_expansion_equals_daily_expansion(spark):
    rng = random.Random(7)
    rows, expected = [], {}
    for patid in range(300):
        at = rng.randint(-4, 5)
        for _ in range(rng.randint(1, 6)):
            stop = at + rng.randint(1, 40)
            status, kind = rng.randint(0, 1), rng.choice("xy")
            rows.append(piece(patid, at, stop, status, kind))
            days = ([0] if at < 0 else []) + list(range(max(at, 0) + 1, stop + 1))
            for d in days:
                cell = expected.setdefault((patid, kind, -(-d // 7) if d else None), [0, 0, 0])
                cell[0] += 1
                cell[1] += d
                cell[2] += status if d == max(days) else 0
            at = stop + rng.randint(0, 5)
    split = persontime.split_person_time(spark.createDataFrame(rows, PIECE))
    got = {
        (r["patid"], r["infection_type"], r["week"]): [r["n_days"], r["sum_day"], r["status"]]
        for r in persontime.to_weeks(split).collect()}
    assert got == expected


def test_person_days_and_events_are_conserved(spark):
    rng = random.Random(3)
    rows = []
    for patid in range(60):
        at = -1500
        for _ in range(rng.randint(2, 14)):
            at += rng.randint(1, 300)
            rows.append(adm(patid, at, at + rng.randint(0, 12), rng.choice(["B05", "A09", "J18", "B01"])))
    ints = intervals(spark, rows).where("time_start >= 0")
    total = ints.agg(F.sum(F.col("time_stop") - F.col("time_start")), F.sum("status")).first()
    pw = persontime.person_weeks(ints, CFG).agg(F.sum("n_days"), F.sum("status")).first()
    assert tuple(total) == tuple(pw)
    # No two intervals of a subject and side overlap.
    starts = F.lead("time_start").over(Window.partitionBy("patid", "side").orderBy("time_start"))
    assert ints.withColumn("next", starts).where("next < time_stop").count() == 0
