import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from recurra import config as c
from recurra.functions.columns import clamp_year, cut, fill_category, recode, relabel
from recurra.operators import cleaning, ranking, scenarios, summary
from recurra.plans import derive, report
from recurra.sources import tables
from tests.helpers import CFG, adm, admissions, day, dicts


def test_quantiles_of_four_values(spark):
    df = spark.createDataFrame([("g", float(v)) for v in (1, 2, 4, 8)], "g string, v double")
    got = summary.summarize_continuous(df, "v", "g").first()
    assert (got.n, got.q_low, got.median, got.q_high) == (4, 1.75, 3.0, 5.0)


@pytest.mark.parametrize("cells", [2, 7, 64])
def test_quantiles_do_not_depend_on_the_cells(spark, cells):
    rng = np.random.default_rng(2)
    values = {"hot": np.round(rng.normal(size=3000), 2), "few": rng.integers(0, 3, 50) * 1.0, "one": np.array([5.0])}
    rows = [(g, float(v)) for g, vs in values.items() for v in vs] + [("hot", None), ("none", None)]
    df = spark.createDataFrame(rows, "g string, v double")
    probs = {"a": 0.05, "b": 0.5, "d": 0.731, "e": 1.0, "z": 0.0}
    got = {r.g: r for r in ranking.exact_quantiles(df, "v", ["g"], probs, cells).collect()}
    assert set(got) == set(values)
    for g, vs in values.items():
        for name, p in probs.items():
            assert abs(got[g][name] - np.quantile(vs, p)) < 1e-12


def test_group_without_values_is_listed_with_zero(spark):
    df = spark.createDataFrame([("a", 1.0), ("b", None)], "g string, v double")
    got = {r.g: (r.n, r.median) for r in summary.summarize_continuous(df, "v", "g").collect()}
    assert got == {"a": (1, 1.0), "b": (0, None)}


def test_percent_rounds_half_to_even_and_empty_cells_are_listed(spark):
    df = spark.createDataFrame([("g", "a")] * 1 + [("g", "b")] * 7 + [("h", "b")] * 2, "g string, v string")
    got = {(r.g, r.level): (r.n, r.denominator, r.percent) for r in
           summary.summarize_categorical(df, "v", "g", ["g", "h"]).collect()}
    assert got == {("g", "a"): (1, 8, 12.0), ("g", "b"): (7, 8, 88.0), ("h", "a"): (0, 2, 0.0), ("h", "b"): (2, 2, 100.0)}
    pooled = summary.summarize_categorical(df, "v", "g", ["g", "h"], pooled=True)
    assert pooled.where("g = 'All patients' and level = 'b'").first().n == 9


def test_baseline_table_picks_the_kind_of_summary(spark):
    df = spark.createDataFrame([("g", "a", float(i), i % 3) for i in range(20)], "g string, s string, x double, k int")
    got = summary.baseline_table(df, ["s", "x", "k"], "g", ["g"])
    rows = {(r.variable, r.level): r for r in got.collect()}
    assert set(rows) == {("s", "a"), ("x", None), ("k", "0"), ("k", "1"), ("k", "2")}
    assert rows[("x", None)].median == 9.5 and rows[("k", "0")].denominator == 20


def test_kruskal_with_ties(spark):
    groups = {"a": [1, 2, 2, 3, 9], "b": [2, 4, 5, 5], "d": [6, 7, 7, 8, 9, 9]}
    pooled = np.array(sorted(v for vs in groups.values() for v in vs))
    ranks = {v: np.mean(np.flatnonzero(pooled == v) + 1) for v in set(pooled)}
    n = len(pooled)
    h = 12 / (n * (n + 1)) * sum(sum(ranks[v] for v in vs) ** 2 / len(vs) for vs in groups.values()) - 3 * (n + 1)
    h /= 1 - sum((pooled == v).sum() ** 3 - (pooled == v).sum() for v in set(pooled)) / (n**3 - n)
    df = spark.createDataFrame([(g, float(v)) for g, vs in groups.items() for v in vs], "g string, v double")
    got = summary.kruskal_h(df, "v", "g").first()
    assert abs(got.h - h) < 1e-9 and got.df == 2 and abs(got.p_value - np.exp(-h / 2)) < 1e-9


def test_cut_is_right_closed(spark):
    df = spark.createDataFrame([(v,) for v in (-1.5, -1.0, 0.0, 0.1, 10.0, 10.1)], "v double")
    got = [r.b for r in df.select(cut("v", [-1, 0, 10], include_lowest=True).alias("b")).collect()]
    assert got == [None, 1, 1, 2, 2, None]
    assert df.select(cut("v", [-1, 0, 10]).alias("b")).collect()[1].b is None


def test_labels(spark):
    df = spark.createDataFrame([("a",), ("b",), (None,)], "v string")
    out = df.select(recode("v", ["b"], ["B"]).alias("r"), relabel("v", {"a": "z"}).alias("l"),
                    fill_category("v").alias("f")).collect()
    assert [(o.r.label, o.r.sort_rank, o.l, o.f) for o in out] == [
        (None, None, "z", "a"), ("B", 1, "b", "b"), (None, None, None, "unknown")]


def test_only_the_neighbouring_years_are_clamped(spark):
    df = spark.range(2003, 2018).select(clamp_year("id", 2005, 2015).alias("y"))
    assert [r.y for r in df.collect()][:3] == [2003, 2005, 2005]
    assert [r.y for r in df.collect()][-3:] == [2015, 2015, 2017]


def test_code_lists():
    assert len(c.INFECTION_CODES) == 233 and len(c.RESPIRATORY_CODES) == 23
    assert "G08" in c.INFECTION_CODES and "G08" not in c.CNS_CODES and len(c.CNS_CODES) == 19


def test_option_presets():
    end = dt.date(2015, 12, 31)
    assert [c.CohortConfig.for_option(o, end).worse_as_dead for o in (0, 1, 2)] == [False, True, True]
    with pytest.raises(ValueError):
        c.CohortConfig.for_option(3, end)
    assert len(c.SWEEP_RATES) == 20


def test_monthly_series_fills_gaps(spark):
    rows = admissions(spark, [adm(1, 0, 1, "B05"), adm(2, 3, 4, "B05"), adm(3, 40, 41, "B05"), adm(4, 40, 41)])
    got = {(r.year, r.month): (r.cases, r.time) for r in
           report.monthly_index_series(rows, "B05", 2005, 2006).collect()}
    assert len(got) == 24
    assert got[(2006, 1)] == (2, 2006.0) and got[(2006, 2)][0] == 1 and got[(2005, 7)] == (0, 2005.5)


def test_icd_dimension_is_collapsed_and_extended(spark):
    codes = spark.createDataFrame(
        [("A82", "Rabies", "s", "ch"), ("A82", "Rabies", "s", "ch"), ("B01", "Varicella", "s", "ch")],
        ", ".join(f"{n} string" for n in tables.ICD_COLUMNS))
    got = {r.three_digit: r.type_id for r in tables.icd_dim(codes).collect()}
    assert got == {"A82": "NTD", "B01": "no NTD", "A16": "no NTD"}


def test_repeat_rows_reach_the_reason_table_only_without_their_mark(spark):
    rows = admissions(spark, [adm(1, 0, 1, "B05"), adm(1, 50, 51, "B05"), adm(1, 500, 501, "B01")])
    ep = derive.derive_episodes(rows, CFG)
    dim = tables.icd_dim(spark.createDataFrame(
        [("B05", "Measles", "s", "ch"), ("B01", "Varicella [chickenpox]", "s", "ch")],
        ", ".join(f"{n} string" for n in tables.ICD_COLUMNS)))
    assert [r.major for r in report.reason_table(ep, dim).collect()] == ["Varicella [chickenpox]"]
    both = {r.major: r.asDict() for r in report.reason_table(ep, dim, True).collect()}
    assert both["Measles complicated"]["below1_year_after_MeV_5to15_years_old"] == 1
    assert both["Varicella [chickenpox]"]["above1_year_after_MeV_5to15_years_old"] == 1


def test_csv_readers(spark, tmp_path):
    header = ("iduse,sex,dob,birthyear,date.admit,date.dis,diagnosis.m3,diagnosis.en,icd.main,"
              "icd.m3,outcome,ward,district,province\n")
    lines = [f"{n % 7},male,NA,2000,2006-01-01,2006-01-03,x,line {n},B05.1,B05,NA,w,d,p\n" for n in range(60000)]
    (tmp_path / "a.csv").write_text(header + "".join(lines))
    rows = tables.read_admissions(spark, str(tmp_path / "a.csv"), "csv")
    assert rows.schema == tables.ADMISSION_SCHEMA
    first = rows.orderBy("source_ordinal").first()
    assert (first.patid, first.dob, first.date_dis, first.icd_m3, first.outcome) == (
        0, None, dt.date(2006, 1, 3), "B05", None)
    # The numbers follow the lines, also where several tasks read the file.
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1m")
    spark.conf.set("spark.sql.files.openCostInBytes", "1m")
    try:
        rows = tables.read_admissions(spark, str(tmp_path / "a.csv"), "csv")
        assert rows.rdd.getNumPartitions() > 2
        ordered = [r.diagnosis_en for r in rows.orderBy("source_ordinal").collect()]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert ordered == [f"line {n}" for n in range(60000)]
    assert cleaning.dedupe_exact(rows.select(tables.CORE_COLUMNS)).orderBy("patid").first().diagnosis_en == "line 59997"
    # Several files, with columns in another order and one more: read by name, numbers unique and in order.
    folder = tmp_path / "many"
    folder.mkdir()
    names = ["extra", *reversed(header.strip().split(","))]
    for i in range(2):
        row = {"iduse": i, "sex": "male", "diagnosis.en": f"file {i}", "date.admit": "2006-01-01", "extra": "e"}
        text = "".join(",".join(str(row.get(n, "NA")) for n in names) + "\n" for _ in range(3))
        (folder / f"{i}.csv").write_text(",".join(names) + "\n" + text)
    got = tables.read_admissions(spark, str(folder), "csv").orderBy("source_ordinal").collect()
    assert [(r.patid, r.diagnosis_en) for r in got] == [(i, f"file {i}") for i in (0, 0, 0, 1, 1, 1)]
    assert len({r.source_ordinal for r in got}) == 6 and got[0].date_admit == dt.date(2006, 1, 1)
    (tmp_path / "short.csv").write_text(header.replace(",outcome", "") + "1\n")
    with pytest.raises(ValueError, match="outcome"):
        tables.read_admissions(spark, str(tmp_path / "short.csv"), "csv")
    (tmp_path / "wide.csv").write_text(
        "Measure,Sex,Value,Location,Cause of death or injury,Year,Age,Lower bound,Upper bound\n"
        "Deaths,Both,2.0,World Bank Low Income,Enteric infections,2015,<5 years,1.0,3.0\n")
    wide = tables.read_mortality(spark, str(tmp_path / "wide.csv")).first()
    assert (wide.cause_of_death, wide.value, wide.lower_bound, wide.upper_bound) == ("Enteric infections", 2.0, 1.0, 3.0)
    (tmp_path / "m.csv").write_text(
        "Location,Year,Age,Cause of death or injury,Value,Lower bound,Upper bound\n"
        "World Bank Low Income,2015,<5 years,Enteric infections,2.0,1.0,3.0\n"
        "World Bank Low Income,2015,5-14 years,Enteric infections,0.5,0.4,0.6\n"
        "World Bank Low Income,2015,<5 years,HIV/AIDS and sexually transmitted infections,9,8,10\n")
    rates = tables.read_mortality(spark, str(tmp_path / "m.csv"))
    got = {r.age: (r.location, r.cause_of_death, r.val) for r in report.mortality_rates(rates).collect()}
    assert got == {"<5 years": ("LI", "Enteric infections", 0.4), "5-14 years": ("LI", "Enteric infections", 3.0)}
    assert report.mortality_share(rates).count() == 2


def test_parquet_admissions_round_trip(spark, tmp_path):
    rows = admissions(spark, [adm(1, 0, 1, "B05"), adm(1, 30, 31)])
    tables.write_result(rows, str(tmp_path / "adm"))
    again = tables.read_admissions(spark, str(tmp_path / "adm"))
    assert dicts(again, "source_ordinal") == dicts(rows, "source_ordinal")


def scenario_rows(spark):
    rows = []
    for patid in range(40):
        rows += [adm(patid, -60, -58, "A09"), adm(patid, 0, 3, "B05"), adm(patid, 200 + patid, 202 + patid)]
    base = derive.derive_episodes(admissions(spark, rows), CFG)
    listed = [c.Emigration("stay", 0.0, 5), c.Emigration("slow", 0.1, 5), c.Emigration("fast", 0.9, 5)]
    return base, derive.scenario_episodes(base, listed)


def test_censoring_is_coupled_by_seed_and_leaves_earlier_rows_alone(spark):
    base, got = scenario_rows(spark)
    rows = dicts(got.where("period <> 'measles'"), "patid", "date_admit", "scenario_id")
    plain = {(r["patid"], r["date_admit"]): r["time_at_lastfup"] for r in dicts(base, "patid")}
    shortened = 0
    for fast, slow, stay in zip(rows[::3], rows[1::3], rows[2::3]):
        assert (fast["scenario_id"], slow["scenario_id"], stay["scenario_id"]) == ("fast", "slow", "stay")
        uncut = plain[(stay["patid"], stay["date_admit"])]
        assert stay["time_at_lastfup"] == uncut
        if stay["period"] == "before":
            assert fast["time_at_lastfup"] == slow["time_at_lastfup"] == uncut
        else:
            assert fast["time_at_lastfup"] <= slow["time_at_lastfup"] <= uncut
            shortened += fast["time_at_lastfup"] < uncut
    assert shortened > 20


def test_years_of_the_last_visit(spark):
    base, _ = scenario_rows(spark)
    listed = [c.Emigration("stay", 0.0, 5)]
    out = derive.scenario_episodes(base, listed, (2007, 2015))
    assert {r.period for r in out.select("period").distinct().collect()} == {"before"}


def test_censoring_days_have_the_rate(spark):
    rows = spark.range(20000).select(F.col("id").alias("patid"))
    days = scenarios.censoring_days(scenarios.fan_out(rows, [c.Emigration("r", 0.5, 1)]))
    mean = days.agg(F.avg("emigration_days")).first()[0]
    assert abs(mean / 730 - 1) < 0.03


def test_sample_is_reproducible(spark):
    rows = spark.range(500).select(F.col("id").alias("patid"))
    first = {r.patid for r in summary.sample_top(rows, "patid", 20, 1).collect()}
    again = {r.patid for r in summary.sample_top(rows.repartition(7), "patid", 20, 1).collect()}
    other = {r.patid for r in summary.sample_top(rows, "patid", 20, 2).collect()}
    assert first == again and len(first) == 20 and first != other


def test_histogram_bins_are_left_closed(spark):
    df = spark.createDataFrame([(0.0,), (0.24,), (0.25,), (-0.1,)], "v double")
    got = {r.bin_start: r.n for r in summary.histogram(df, "v", 0.0, 0.25).collect()}
    assert got == {0.0: 2, 0.25: 1, -0.25: 1}


def test_first_day(spark):
    assert day(0) == dt.date(2006, 1, 1)


def test_kruskal_without_spread(spark):
    rows = spark.createDataFrame([("a", 1.0), ("a", 1.0), ("b", 1.0)], "g string, v double")
    got = summary.kruskal_h(rows, "v", "g").first()
    assert got.n_total == 3 and got.h is None and got.p_value is None


def test_comparisons_in_the_table(spark):
    rows = [(g, a, s) for g, ages, sexes in (
        ("x", [1.0, 2.0, 3.0, 9.0], "mmff"), ("y", [2.0, 5.0, 8.0, 9.0], "mfff"), ("z", [7.0, 9.0, 9.0, None], "mmm" "f"))
        for a, s in zip(ages, sexes)]
    df = spark.createDataFrame(rows, "g string, age double, s string")
    table = summary.baseline_table(df, ["age", "s"], "g", ["x", "y", "z"], pooled=True, cont={"age": True, "s": False}, compare=True)
    got = {r.variable: r.p_value for r in table.select("variable", "p_value").distinct().collect()}
    # Levels by group: m 2, 1, 3 and f 2, 3, 1; all expected counts are 2.
    assert abs(got["s"] - math.exp(-2.0 / 2)) < 1e-9
    assert abs(got["age"] - summary.kruskal_h(df, "age", "g").first().p_value) < 1e-12
    one = summary.baseline_table(df.where("s = 'm'"), ["s"], "g", ["x", "y", "z"], cont={"s": False}, compare=True)
    assert {r.p_value for r in one.collect()} == {None}
    none = summary.baseline_table(df.where("false"), ["s", "age"], "g", ["x", "y"], cont={"s": False, "age": True}, compare=True)
    assert {r.p_value for r in none.collect()} <= {None}
