import datetime as dt

import pytest

from recurra.operators import cleaning
from recurra.plans import derive
from tests.helpers import BORN, CFG, adm, admissions, day, dicts


def episode_rows(spark, rows, cfg=CFG):
    return dicts(derive.derive_episodes(admissions(spark, rows), cfg), "patid", "date_admit")


@pytest.mark.parametrize("mode, kept", [("pairwise", [(0, 3), (5, 6)]), ("transitive", [(0, 6)])])
def test_chain_of_three_close_admissions(spark, mode, kept):
    rows = [adm(1, 0, 1, "B05"), adm(1, 2, 3), adm(1, 5, 6)]
    got = episode_rows(spark, rows, CFG.__class__(CFG.followup_end, True, merge_mode=mode))
    assert [(r["date_admit"], r["date_dis"]) for r in got] == [(day(a), day(b)) for a, b in kept]
    assert got[0]["icd_m3"] == "B05" and got[0]["period"] == "measles"


def test_overlap_merges_and_gap_of_three_does_not(spark):
    got = episode_rows(spark, [adm(1, 0, 9, "B05"), adm(1, 4, 6), adm(1, 12, 13)])
    assert [(r["date_admit"], r["date_dis"]) for r in got] == [(day(0), day(9)), (day(12), day(13))]


def test_merged_row_keeps_values_of_its_last_admission(spark):
    got = episode_rows(spark, [adm(1, 0, 1, "B05"), adm(1, 3, 4, "A09", "dead")])
    assert len(got) == 1
    assert got[0]["outcome"] == "dead"
    assert got[0]["age_at_admit_d"] == (day(3) - BORN).days
    assert got[0]["hospitalization"] == 4 and got[0]["infection_type"] == "Measles"


@pytest.mark.parametrize("codes", [("B01", "B05"), ("B05", "B01")])
def test_same_admission_day_carries_index_code_over(spark, codes):
    rows = admissions(spark, [adm(1, 0, 2, codes[0]), adm(1, 0, 5, codes[1])])
    got = dicts(cleaning.merge_same_start(cleaning.dedupe_exact(rows), CFG), "patid")
    assert [(r["date_dis"], r["icd_m3"]) for r in got] == [(day(5), "B05")]


def test_exact_duplicate_keeps_last_record_and_loses_the_code_of_the_first(spark):
    rows = admissions(spark, [adm(1, 0, 2, "B05"), adm(1, 0, 2, "B01")])
    got = dicts(cleaning.merge_same_start(cleaning.dedupe_exact(rows), CFG), "patid")
    assert [(r["source_ordinal"], r["icd_m3"]) for r in got] == [(1, "B01")]


@pytest.mark.parametrize("poison, rows_left", [(True, 0), (False, 1)])
def test_missing_discharge_in_a_same_day_pair(spark, poison, rows_left):
    cfg = CFG.__class__(CFG.followup_end, True, na_poison=poison)
    rows = admissions(spark, [adm(1, 0, None), adm(1, 0, 5)])
    assert cleaning.merge_same_start(cleaning.dedupe_exact(rows), cfg).count() == rows_left


def test_missing_code_counts_as_not_index(spark):
    rows = admissions(spark, [adm(1, 0, 2, None), adm(1, 0, 5, "B05")])
    got = dicts(cleaning.merge_same_start(cleaning.dedupe_exact(rows), CFG), "patid")
    assert got[0]["icd_m3"] == "B05"


@pytest.mark.parametrize("worse_as_dead, last", [(False, "presumably.worse"), (True, "dead")])
def test_worse_outcome(spark, worse_as_dead, last):
    rows = admissions(spark, [
        adm(1, 0, 1, outcome="presumably.worse"), adm(1, 9, 10, outcome="presumably.worse"),
        adm(2, 0, 1, outcome=None)])
    got = dicts(cleaning.resolve_outcome(rows, worse_as_dead), "patid", "date_admit")
    assert [r["outcome"] for r in got] == ["discharged", last, "unknown"]


def test_birth_dates(spark):
    rows = admissions(spark, [
        adm(1, 0, 1, dob=dt.date(2000, 2, 29)), adm(2, 0, 1, birthyear=None),
        adm(3, 0, 1, dob=None), adm(4, 0, 1, dob=None, birthyear=None)])
    days = cleaning.impute_dob(rows)
    strict = dicts(cleaning.followup_end(days, CFG), "patid")
    assert [r["patid"] for r in strict] == [1, 2, 3]
    assert [r["time_at_lastfup"] for r in strict] == [None, None, dt.date(2015, 6, 30)]
    clamp = CFG.__class__(CFG.followup_end, True, birthday_mode="clamp")
    assert dicts(cleaning.followup_end(days, clamp), "patid")[0]["time_at_lastfup"] == dt.date(2015, 2, 28)
    skip = CFG.__class__(CFG.followup_end, True, na_poison=False)
    assert dicts(cleaning.followup_end(days, skip), "patid")[0]["time_at_lastfup"] == CFG.followup_end


def test_death_replaces_the_cutoff(spark):
    late = (dt.date(2016, 3, 1) - day(0)).days
    rows = admissions(spark, [adm(1, 0, late, outcome="dead")])
    got = dicts(cleaning.followup_end(rows, CFG), "patid")
    assert got[0]["time_at_lastfup"] == dt.date(2016, 3, 1)


def test_repeat_index_event_and_excluded_code(spark):
    got = episode_rows(spark, [
        adm(1, 0, 1, "B05"), adm(1, 50, 51, "B05"), adm(1, 90, 91, "G08"),
        adm(2, 0, 1, "B05"), adm(2, 50, 51, "B20"), adm(3, 0, 1, "B01")])
    assert [(r["patid"], r["icd_m3"], r["infection_type"], r["period"]) for r in got] == [
        (1, "B05", "Measles", "measles"), (1, "B05*", "Measles complicated", "after"),
        (1, "G08", "Other infection", "after")]


def test_numbering_of_raw_admissions_with_small_chunks(spark, monkeypatch):
    monkeypatch.setattr(cleaning, "ORDINAL_CHUNK", 2)
    rows = [adm(1, a, d) for a, d in [(5, 6), (0, 3), (0, 1), (0, 1), (0, 1), (0, 1), (None, 4), (0, None)]]
    rows += [adm(2, 0, 1)]
    df = admissions(spark, rows)
    got = dicts(cleaning.number_admissions(df), "patid", "visit")
    assert [(r["source_ordinal"], r["visit"], r["visit_last"]) for r in got] == [
        (2, 1, 8), (3, 2, 8), (4, 3, 8), (5, 4, 8), (1, 5, 8), (7, 6, 8), (0, 7, 8), (6, 8, 8), (8, 1, 1)]


def test_prefilter_gives_the_same_episodes(spark):
    rows = [adm(p, 40 * v, 40 * v + 1, "B05" if (p + v) % 5 == 0 else "A09") for p in range(9) for v in range(3)]
    cfg = CFG.__class__(CFG.followup_end, True, prefilter_index_subjects=True)
    assert episode_rows(spark, rows) == episode_rows(spark, rows, cfg)


def test_merges_aggregate_before_they_shuffle_and_derivation_shuffles_three_times(spark):
    df = derive.derive_episodes(admissions(spark, [adm(1, 0, 1, "B05")]), CFG)
    plan = df._jdf.queryExecution().sparkPlan().toString()
    executed = df._jdf.queryExecution().executedPlan().toString()
    assert "partial_max" in plan
    assert executed.count("Exchange hashpartitioning") == 3
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_subject_with_a_third_of_all_rows(spark):
    """Copies and same-day admissions of a hot subject leave one row per day, as in plain Python."""
    rows = spark.range(30000).selectExpr(
        "id AS source_ordinal", "CASE WHEN id % 3 = 0 THEN 0 ELSE id % 500 + 1 END AS patid", "'male' AS sex",
        "'d1' AS district", "DATE '2000-03-10' AS dob", "2000 AS birthyear",
        "date_add(DATE '2006-01-01', CAST(id * 7919 % 300 AS INT)) AS date_admit",
        "date_add(DATE '2006-01-01', CAST(id * 7919 % 300 + id % 4 AS INT)) AS date_dis",
        "CASE WHEN id % 11 = 0 THEN 'B05' ELSE 'A09' END AS icd_m3", "'discharged' AS outcome", "'e' AS diagnosis_en")
    last = {}
    for r in rows.orderBy("source_ordinal").collect():
        last[(r.patid, r.date_admit, r.date_dis)] = r
    expected = {}
    for (patid, admit, discharge), r in sorted(last.items()):
        any_index = r.icd_m3 == "B05" or expected.get((patid, admit), (None, None, ""))[2] == "B05"
        expected[(patid, admit)] = (discharge, r.source_ordinal, "B05" if any_index else r.icd_m3)
    days = cleaning.merge_same_start(cleaning.dedupe_exact(rows), CFG)
    got = {(r.patid, r.date_admit): (r.date_dis, r.source_ordinal, r.icd_m3) for r in days.collect()}
    assert got == expected and sum(1 for p, _ in got if p == 0) <= 300
    assert derive.derive_episodes(rows, CFG).where("patid = 0 and period = 'measles'").count() == 1
