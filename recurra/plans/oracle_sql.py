"""The registered queries as plain SQL for DuckDB.

Written apart from the DataFrame code: person-time is split into days here,
subjects are chosen by IN / NOT IN, and merges go through GROUP BY and joins.
"""

from __future__ import annotations

from recurra.config import SCENARIOS, TABLE_TIMES

BORN = "DATE '1984-01-01' + CAST((c_custkey * 37) % 4018 AS INTEGER)"
END = "DATE '2001-12-31'"

ADMISSIONS = f"""
adm AS (
  SELECT o_orderkey AS source_ordinal, o_custkey AS patid,
    CASE WHEN c_custkey % 2 = 0 THEN 'male' ELSE 'female' END AS sex,
    n_name AS district, r_name AS province,
    CASE WHEN c_custkey % 50 = 0 THEN NULL WHEN c_custkey % 97 = 5 THEN DATE '1992-02-29'
         ELSE {BORN} END AS dob,
    CASE WHEN c_custkey % 100 = 0 THEN NULL WHEN c_custkey % 97 = 5 THEN 1992
         ELSE year({BORN}) END AS birthyear,
    CAST(o_orderdate AS DATE) AS date_admit,
    CAST(o_orderdate AS DATE) + CAST((o_orderkey * 7 + o_custkey) % 11 AS INTEGER) AS date_dis,
    CASE WHEN o_orderkey % 211 = 3 THEN 'B20' WHEN o_orderkey % 7 = 0 THEN 'B05'
         WHEN o_orderpriority = '1-URGENT' THEN 'A09' WHEN o_orderpriority = '2-HIGH' THEN 'J18'
         WHEN o_orderpriority = '3-MEDIUM' AND o_orderkey % 2 = 0 THEN 'A85'
         WHEN o_orderpriority = '3-MEDIUM' THEN 'G08'
         WHEN o_orderpriority = '4-NOT SPECIFIED' THEN 'B01' ELSE 'K35' END AS icd_m3,
    CASE WHEN o_orderstatus = 'F' THEN 'discharged'
         WHEN o_orderstatus = 'O' AND o_orderkey % 5 = 0 THEN 'presumably.worse'
         WHEN o_orderstatus = 'O' THEN 'discharged'
         WHEN o_orderkey % 61 = 0 THEN 'dead' WHEN o_orderkey % 13 = 0 THEN NULL
         ELSE 'discharged' END AS outcome,
    o_orderpriority AS diagnosis_en
  FROM orders JOIN customer ON o_custkey = c_custkey
  JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""


def _merge(mode: str) -> str:
    if mode == "pairwise":
        group = "visit - CASE WHEN tim_diff <= 2 THEN 1 ELSE 0 END"
    else:
        group = "sum(CASE WHEN tim_diff <= 2 THEN 0 ELSE 1 END) OVER (PARTITION BY patid ORDER BY date_admit)"
    return f"""
mrk AS (SELECT * REPLACE (CASE WHEN measles_order = 'second' THEN 'B05*' ELSE icd_m3 END AS icd_m3),
        row_number() OVER (PARTITION BY patid ORDER BY date_admit) AS visit FROM gap),
sel AS (SELECT *, {group} AS visit_select FROM mrk),
grp AS (SELECT patid, visit_select, min(date_admit) AS a, max(date_dis) AS d,
        CAST(sum(CASE WHEN icd_m3 = 'B05' THEN 1 ELSE 0 END) AS INTEGER) AS measles_group,
        max(visit) AS visit_max FROM sel GROUP BY ALL),
mrg AS (SELECT sel.* EXCLUDE (visit, visit_select, date_admit, date_dis, icd_m3, measles, measles_order),
        a AS date_admit, d AS date_dis, measles_group,
        CASE WHEN measles_group > 0 THEN 'B05' ELSE icd_m3 END AS icd_m3,
        CASE WHEN measles_group > 0 THEN 'yes' ELSE 'no' END AS measles,
        CASE WHEN measles_group > 0 THEN 'first' ELSE measles_order END AS measles_order
        FROM sel JOIN grp USING (patid, visit_select) WHERE visit = visit_max)"""


def base(worse_as_dead: bool = True, mode: str = "pairwise") -> str:
    """All stages from admissions to episodes, as a WITH list."""
    final = "dead" if worse_as_dead else "presumably.worse"
    return f"""WITH {ADMISSIONS},
e2 AS (SELECT * FROM adm QUALIFY row_number() OVER (
        PARTITION BY patid, date_admit, date_dis ORDER BY source_ordinal DESC) = 1),
e3g AS (SELECT patid, date_admit, max(date_dis) AS dmax, bool_or(icd_m3 = 'B05') AS any_index
        FROM e2 GROUP BY ALL),
e3 AS (SELECT e2.* REPLACE (CASE WHEN any_index THEN 'B05' ELSE icd_m3 END AS icd_m3)
        FROM e2 JOIN e3g USING (patid, date_admit) WHERE date_dis = dmax),
e4 AS (SELECT * REPLACE (CASE WHEN outcome IS NULL THEN 'unknown'
          WHEN outcome <> 'presumably.worse' THEN outcome
          WHEN date_admit < max(date_admit) OVER (PARTITION BY patid) THEN 'discharged'
          ELSE '{final}' END AS outcome) FROM e3),
b8 AS (SELECT * REPLACE (coalesce(dob, make_date(birthyear, 6, 30)) AS dob) FROM e4
        WHERE dob IS NOT NULL OR birthyear IS NOT NULL),
cap AS (SELECT *, TRY_CAST(printf('%04d-%02d-%02d', birthyear + 15, month(dob), day(dob)) AS DATE) AS b15 FROM b8),
fin AS (SELECT *, CASE WHEN outcome = 'dead' THEN date_dis WHEN b15 IS NULL THEN NULL
          WHEN b15 < {END} THEN b15 ELSE {END} END AS row_end FROM cap),
fup AS (SELECT * EXCLUDE (b15, row_end), CASE WHEN bool_or(row_end IS NULL) OVER (PARTITION BY patid) THEN NULL
          ELSE min(row_end) OVER (PARTITION BY patid) END AS time_at_lastfup FROM fin),
e5 AS (SELECT *, time_at_lastfup - date_dis AS time_dis_to_lastfup FROM fup),
val AS (SELECT *, CASE WHEN icd_m3 = 'B05' THEN 'yes' ELSE 'no' END AS measles FROM e5
        WHERE time_dis_to_lastfup >= 0),
inf AS (SELECT *, 'yes' AS infection, date_admit - dob AS age_at_admit_d FROM val
        WHERE regexp_matches(icd_m3, '^([AB][0-9][0-9]|J[01][0-9]|J2[0-2]|G0[0-9])$')),
coh AS (SELECT * FROM inf WHERE patid IN (SELECT patid FROM inf WHERE measles = 'yes')),
fst AS (SELECT patid, min(date_admit) AS first_index FROM coh WHERE measles = 'yes' GROUP BY 1),
ord AS (SELECT coh.*, CASE WHEN measles = 'no' THEN 'no' WHEN date_admit = first_index THEN 'first'
        ELSE 'second' END AS measles_order FROM coh JOIN fst USING (patid)),
gap AS (SELECT *, coalesce(date_admit - lag(date_dis) OVER (PARTITION BY patid ORDER BY date_admit), 10000)
        AS tim_diff FROM ord),
{_merge(mode)},
cls AS (SELECT *, CASE WHEN measles_order = 'second' THEN 'Measles complicated'
          WHEN icd_m3 = 'B05' THEN 'Measles' WHEN icd_m3 LIKE 'A0_' THEN 'Diarrhea'
          WHEN regexp_matches(icd_m3, '^J([01][0-9]|2[0-2])$') THEN 'Respiratory Infection'
          WHEN regexp_matches(icd_m3, '^(A8[0-9]|G0[0-79])$') THEN 'CNS Infection'
          ELSE 'Other infection' END AS infection_type FROM mrg),
idx AS (SELECT patid, date_admit AS date_admit_index, date_dis AS date_dis_index,
        age_at_admit_d AS age_at_index_d FROM cls WHERE measles_order = 'first'),
anc AS (SELECT cls.*, date_admit_index, date_dis_index, age_at_index_d,
        date_dis - date_admit AS hospitalization, date_admit - date_admit_index AS time_ad_index_to_ad,
        CASE WHEN date_admit > date_admit_index THEN 'after' WHEN date_admit < date_admit_index THEN 'before'
             ELSE 'measles' END AS period, age_at_admit_d / 365.0::DOUBLE AS age
        FROM cls LEFT JOIN idx USING (patid)),
epi AS (SELECT * FROM anc WHERE patid NOT IN (SELECT patid FROM anc WHERE icd_m3 = 'B20'))"""


def timeline(episodes: str, key: str = "patid") -> str:
    """Intervals, daily rows and weeks of a table of episodes, as further WITH entries."""
    return f"""
dob0 AS (SELECT {key}, arg_min(dob, date_admit) AS dob_first FROM {episodes} GROUP BY ALL),
lb AS (SELECT * FROM {episodes} WHERE period IN ('before', 'measles') AND date_admit_index - date_admit <= 730),
fl AS (SELECT *, CASE WHEN period = 'measles' THEN CASE WHEN row_number() OVER w > 1 THEN 1 ELSE 2 END
        ELSE 3 END AS flag FROM lb WINDOW w AS (PARTITION BY {key} ORDER BY date_admit)),
o1 AS (SELECT *, CASE WHEN date_admit = dob AND age_at_index_d < 730 THEN 1
         WHEN flag = 2 THEN CASE WHEN age_at_index_d >= 730 THEN 730 ELSE age_at_index_d END
         WHEN age_at_index_d >= 730 THEN greatest(730 - abs(time_ad_index_to_ad), 0)
         ELSE age_at_admit_d END AS obs_time FROM fl WHERE flag IN (2, 3)),
o2 AS (SELECT *, coalesce(lag(obs_time) OVER w + lag(hospitalization) OVER w, 0) AS time_start,
         row_number() OVER (PARTITION BY {key} ORDER BY date_admit DESC) AS from_last
       FROM o1 WINDOW w AS (PARTITION BY {key} ORDER BY date_admit)),
o3 AS (SELECT *, CASE WHEN obs_time = 0 THEN time_start + 1 ELSE obs_time END AS time_stop,
         CASE WHEN flag = 3 THEN 1 ELSE 0 END AS status FROM o2),
tail AS (SELECT * REPLACE (time_stop + hospitalization AS time_start,
           CASE WHEN age_at_index_d >= 730 THEN 730 ELSE age_at_index_d END AS time_stop, 0 AS status)
         FROM o3 WHERE flag = 3 AND from_last = 1),
bef AS (SELECT * FROM (SELECT * FROM o3 UNION ALL SELECT * FROM tail) WHERE time_stop > time_start),
ar AS (SELECT * FROM {episodes} WHERE period IN ('after', 'measles')),
wf AS (SELECT {key}, max(CASE WHEN period = 'measles' THEN greatest(date_dis, date_admit_index + 14)
         ELSE date_dis END) AS new_dis FROM ar WHERE date_admit <= date_admit_index + 14 GROUP BY ALL),
fold AS (SELECT ar.* REPLACE (CASE WHEN period = 'measles' THEN new_dis ELSE date_dis END AS date_dis,
           new_dis AS date_dis_index, greatest(time_at_lastfup, new_dis) AS time_at_lastfup)
         FROM ar JOIN wf USING ({key}) WHERE period = 'measles' OR date_admit > date_admit_index + 14),
a1 AS (SELECT *, date_admit - date_dis_index AS obs_time, date_dis_index - date_admit_index AS hospitalization_index,
         lead(date_admit) OVER (PARTITION BY {key} ORDER BY date_admit) AS next_admit FROM fold),
aft AS (SELECT *, CASE WHEN period = 'after' THEN obs_time + hospitalization ELSE 0 END AS time_start,
          CASE WHEN next_admit IS NULL THEN time_at_lastfup - date_dis_index
               ELSE next_admit - date_dis_index END AS time_stop,
          CASE WHEN next_admit IS NULL THEN 0 ELSE 1 END AS status,
          CASE WHEN period = 'after' THEN CASE WHEN next_admit IS NULL THEN 4 ELSE 3 END
               ELSE CASE WHEN next_admit IS NULL THEN 1 ELSE 2 END END AS flag FROM a1),
ain AS (SELECT * FROM aft WHERE outcome <> 'dead' AND time_start < time_stop),
bday AS (SELECT {key}, sex, district, age_at_index_d, infection_type, hospitalization,
           unnest(range(time_start + 1, time_stop + 1)) AS day, time_stop, status FROM bef),
adayp AS (SELECT {key}, sex, district, age_at_index_d, infection_type, hospitalization, hospitalization_index,
           unnest(range(greatest(time_start, 0) + 1, time_stop + 1)) AS day, time_stop, status FROM ain),
aday AS (SELECT * FROM adayp UNION ALL
         SELECT {key}, sex, district, age_at_index_d, infection_type, hospitalization, hospitalization_index,
           0, CASE WHEN time_stop <= 0 THEN 0 ELSE 1 END, status FROM ain WHERE time_start < 0),
bwk AS (SELECT {key}, sex, district, age_at_index_d, infection_type, hospitalization,
          CAST(ceil(day / 7.0) AS INTEGER) AS week,
          CAST(sum(CASE WHEN day = time_stop THEN status ELSE 0 END) AS BIGINT) AS status,
          count(*) AS n_days, CAST(sum(day) AS BIGINT) AS sum_day,
          greatest(age_at_index_d - 730, 0) AS age0, 0 AS hosp0, 'before' AS period FROM bday GROUP BY ALL),
awk AS (SELECT {key}, sex, district, age_at_index_d, infection_type, hospitalization,
          CASE WHEN day > 0 THEN CAST(ceil(day / 7.0) AS INTEGER) END AS week,
          CAST(sum(CASE WHEN day = time_stop THEN status ELSE 0 END) AS BIGINT) AS status,
          count(*) AS n_days, CAST(sum(day) AS BIGINT) AS sum_day,
          age_at_index_d + hospitalization_index AS age0, hospitalization_index AS hosp0, 'after' AS period
        FROM aday GROUP BY ALL),
wk AS (SELECT * FROM bwk UNION ALL SELECT * FROM awk),
pw AS (SELECT wk.* EXCLUDE (age0, hosp0), dob_first AS dob,
         (sum_day::DOUBLE / n_days + age0) / 365.0::DOUBLE AS age_at_infection,
         CASE WHEN period = 'after' THEN (sum_day::DOUBLE / n_days + hosp0) / 365.0::DOUBLE ELSE -1.0::DOUBLE END
           AS time_after_index,
         n_days / 365.0::DOUBLE AS time_interval, ln(n_days / 365.0::DOUBLE) AS offset_time,
         age_at_index_d / 365.0::DOUBLE AS age_at_index_y,
         dob_first + CAST(sum_day // n_days + age0 AS INTEGER) AS dai,
         year(dob_first + CAST(sum_day // n_days + age0 AS INTEGER)) AS calendar_year
       FROM wk JOIN dob0 USING ({key}))"""


def scenarios() -> str:
    rows = ", ".join(f"('{i}', {r}::DOUBLE, {s})" for i, r, s in SCENARIOS)
    return f"""
scn(scenario_id, rate, seed) AS (VALUES {rows}),
lst AS (SELECT patid, max(year(date_admit)) AS last_year, max(date_dis) AS dis_last FROM epi
        WHERE period <> 'before' GROUP BY 1),
drw AS (SELECT patid, scenario_id, rate, seed, last_year, dis_last,
          CASE WHEN rate > 0 THEN CAST(round_even(-ln((('0x' || substr(md5(patid || '|' || seed), 1, 13))::BIGINT
            + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE) / rate * 365, 0) AS INTEGER) END AS days
        FROM lst CROSS JOIN scn),
sep AS (SELECT epi.* REPLACE (
          CASE WHEN period = 'before' OR days IS NULL OR dis_last + days >= time_at_lastfup THEN time_at_lastfup
               ELSE dis_last + days END AS time_at_lastfup), scenario_id, last_year
        FROM epi JOIN drw USING (patid)
        WHERE period = 'before' OR last_year BETWEEN 1995 AND 2001)"""


FULL = base() + "," + timeline("epi")
ALIVE = base(False)
SCEN = base() + "," + scenarios() + "," + timeline("sep", "scenario_id, patid")

# Per subject and side: events and person-years, for the crude rate ratio and its robust variance.
CRUDE = """,
sid AS (SELECT {key}patid, sum(CASE WHEN period = 'before' THEN status ELSE 0 END)::DOUBLE AS y0,
          sum(CASE WHEN period = 'before' THEN n_days ELSE 0 END) / 365.0::DOUBLE AS t0,
          sum(CASE WHEN period = 'after' THEN status ELSE 0 END)::DOUBLE AS y1,
          sum(CASE WHEN period = 'after' THEN n_days ELSE 0 END) / 365.0::DOUBLE AS t1
        FROM pw GROUP BY ALL),
tot AS (SELECT {key}sum(y0) AS sy0, sum(t0) AS st0, sum(y1) AS sy1, sum(t1) AS st1 FROM sid GROUP BY ALL),
rob AS (SELECT {key}any_value(sy0) AS sy0, any_value(st0) AS st0, any_value(sy1) AS sy1, any_value(st1) AS st1,
          ln(any_value(sy0) / any_value(st0)) AS b0,
          ln(any_value(sy1) / any_value(st1)) - ln(any_value(sy0) / any_value(st0)) AS b1,
          sum((y0 - sy0 / st0 * t0) ** 2) / any_value(sy0) ** 2 AS v00,
          sum((y1 - sy1 / st1 * t1) ** 2) / any_value(sy1) ** 2 AS v11,
          sum((y0 - sy0 / st0 * t0) * (y1 - sy1 / st1 * t1)) / (any_value(sy0) * any_value(sy1)) AS v01
        FROM sid {join} GROUP BY ALL)"""
CRUDE_ALL = FULL + CRUDE.format(key="", join="CROSS JOIN tot")
CRUDE_SCEN = SCEN + CRUDE.format(key="scenario_id, ", join="JOIN tot USING (scenario_id)")
Z = 1.959963984540054

BAND_CASE = """CASE WHEN time_after_index >= -1 AND time_after_index <= 0 THEN 1
  WHEN time_after_index <= 1 / 12.0::DOUBLE THEN 2 WHEN time_after_index <= 2 / 12.0::DOUBLE THEN 3
  WHEN time_after_index <= 5 / 12.0::DOUBLE THEN 4 WHEN time_after_index <= 8 / 12.0::DOUBLE THEN 5
  WHEN time_after_index <= 1 THEN 6 WHEN time_after_index <= 1.5 THEN 7 WHEN time_after_index <= 3 THEN 8
  WHEN time_after_index <= 4.5 THEN 9 WHEN time_after_index <= 6 THEN 10 WHEN time_after_index <= 8 THEN 11
  WHEN time_after_index <= 10 THEN 12 END"""

EPISODE_COLS = """patid, sex, district, dob, birthyear, date_admit, date_dis, icd_m3, outcome, diagnosis_en,
  time_at_lastfup, time_dis_to_lastfup, measles, infection, age_at_admit_d, infection_type, date_admit_index,
  date_dis_index, age_at_index_d, hospitalization, time_ad_index_to_ad, period, round(age, 9) AS age"""

PW_COLS = """patid, round(age_at_infection, 9) AS age_at_infection, round(time_after_index, 9) AS time_after_index,
  round(offset_time, 9) AS offset_time, status, period, round(age_at_index_y, 9) AS age_at_index_y,
  infection_type, hospitalization, sex, district, round(time_interval, 9) AS time_interval, dob, dai,
  calendar_year, week, n_days, sum_day"""

REL = """CASE WHEN period = 'before' THEN age_at_infection - age_at_index_y ELSE time_after_index END"""

REASON = """,
dim(three_digit, major, sub_chapter) AS (VALUES
  ('A09', 'Infectious gastroenteritis and colitis, unspecified', 'Intestinal infectious diseases'),
  ('J18', 'Pneumonia, unspecified organism', 'Influenza and pneumonia'),
  ('A85', 'Oth viral encephalitis', 'Viral infections of the central nervous system'),
  ('G08', 'Intracranial phlebitis', 'Inflammatory diseases of the central nervous system'),
  ('B01', 'Varicella [chickenpox]', 'Viral infections characterized by skin lesions'),
  ('B05', 'Measles', 'Viral infections characterized by skin lesions'),
  ('B20', 'Human immunodeficiency virus [HIV] disease', 'Human immunodeficiency virus disease'),
  ('A16', 'Respiratory tuberculosis', 'Tuberculosis')),
rsn AS (SELECT major, sub_chapter, CASE WHEN age >= 5 THEN 'old' ELSE 'young' END AS ag,
          CASE WHEN time_ad_index_to_ad > 365 THEN 'late' ELSE period END AS p
        FROM epi JOIN dim ON {code} = three_digit
        WHERE time_ad_index_to_ad >= -730 AND period <> 'measles'),
rct AS (SELECT major, sub_chapter,
    count(*) FILTER (p = 'before' AND ag = 'young') AS two_years_before_MeV_below5_years_olds,
    count(*) FILTER (p = 'before' AND ag = 'old') AS two_years_before_MeV_5to15_years_old,
    count(*) FILTER (p = 'after' AND ag = 'young') AS below1_year_after_MeV_below5_years_old,
    count(*) FILTER (p = 'after' AND ag = 'old') AS below1_year_after_MeV_5to15_years_old,
    count(*) FILTER (p = 'late' AND ag = 'young') AS above1_year_after_MeV_below5_year_old,
    count(*) FILTER (p = 'late' AND ag = 'old') AS above1_year_after_MeV_5to15_years_old
  FROM rsn GROUP BY ALL)
SELECT * REPLACE (CASE major WHEN 'Oth viral encephalitis' THEN NULL WHEN 'Intracranial phlebitis' THEN NULL
    WHEN 'Measles' THEN 'Measles complicated' ELSE major END AS major), 'no NTD' AS type_id FROM rct"""

LABELLED = """,
lab AS (SELECT *, CASE period WHEN 'measles' THEN 'Measles' WHEN 'before' THEN '2 years before MeV'
          ELSE 'After MeV' END AS period_label FROM epi WHERE time_ad_index_to_ad >= -730)"""

MORTALITY = """WITH mor AS (SELECT
    CASE l_returnflag WHEN 'A' THEN 'HI' WHEN 'N' THEN 'LI' ELSE 'LMI' END AS location,
    year(l_shipdate) AS year,
    CASE WHEN l_linestatus = 'F' THEN '<5 years' ELSE '5-14 years' END AS age,
    CASE l_linenumber % 4 WHEN 0 THEN 'Enteric infections' WHEN 1 THEN 'Respiratory infections and TB'
      ELSE 'Other infectious diseases' END AS cause_of_death,
    avg(l_discount) AS value, min(l_discount) AS lower_bound, max(l_discount) AS upper_bound
  FROM lineitem WHERE l_linenumber % 4 <> 2 GROUP BY ALL)"""


def quantiles(var: str, group: str, source: str, names: dict[str, float], pooled: bool = False) -> str:
    cols = ", ".join(f"round(quantile_cont({var}, {p}), 9) AS {n}" for n, p in names.items())
    own = f"SELECT {group}, count({var}) AS n, {cols} FROM {source} GROUP BY {group}"
    if not pooled:
        return own
    return own + f" UNION ALL SELECT 'All patients', count({var}), {cols} FROM {source}"


def categorical(var: str, group: str, source: str) -> str:
    return f""",
gl AS (SELECT DISTINCT {group} FROM {source}), vl AS (SELECT DISTINCT {var} FROM {source} WHERE {var} IS NOT NULL),
ct AS (SELECT gl.{group}, vl.{var} AS level, count(s.{var}) AS n FROM gl CROSS JOIN vl
       LEFT JOIN {source} s ON s.{group} = gl.{group} AND s.{var} = vl.{var} GROUP BY ALL)
SELECT {group}, level, n, CAST(sum(n) OVER (PARTITION BY {group}) AS BIGINT) AS denominator,
  round_even(100 * (n::DOUBLE / sum(n) OVER (PARTITION BY {group})), 0) AS percent FROM ct"""


IQR = {"q_low": 0.25, "median": 0.5, "q_high": 0.75}


# The banded model in closed form: log rate ratio of each band to the first, with its robust error.
BAND_FITS = f""",
            sb AS (SELECT patid, {BAND_CASE} AS band, sum(status)::DOUBLE AS y, sum(n_days) / 365.0::DOUBLE AS t
                   FROM pw GROUP BY ALL),
            bt AS (SELECT band, sum(y) AS sy, sum(t) AS st FROM sb WHERE band IS NOT NULL GROUP BY 1),
            ub AS (SELECT patid, band, (y - sy / st * t) / sy AS u, sy, st FROM sb JOIN bt USING (band)),
            u1 AS (SELECT patid, u AS u1 FROM ub WHERE band = 1),
            b1 AS (SELECT sum(u * u) AS v1, any_value(sy / st) AS r1 FROM ub WHERE band = 1)
            , est AS (SELECT band, ln(any_value(sy / st) / any_value(r1)) AS estimate,
              sqrt(sum(u * u) + any_value(v1) - 2 * sum(u * coalesce(u1, 0))) AS std_err
            FROM ub LEFT JOIN u1 USING (patid) CROSS JOIN b1 WHERE band > 1 GROUP BY band)"""
AFTER_ERROR = "sqrt(v00 + v11 - 2 * v01)"
TIMES = "SELECT * FROM (VALUES " + ", ".join(
    f"({i}, '{label}', {t!r}::DOUBLE)" for i, (label, t) in enumerate(TABLE_TIMES, 1)) + ") AS x(position, label, t)"


def limits(estimate: str, error: str) -> str:
    return (f"round({estimate}, 6) AS estimate, round({error}, 6) AS std_err, "
            f"round({estimate} - {Z} * {error}, 6) AS lower, round({estimate} + {Z} * {error}, 6) AS upper")


TABLE_ONE = ALIVE + LABELLED + """,
            fr AS (SELECT *, row_number() OVER (PARTITION BY patid, period ORDER BY date_admit) AS r FROM lab),
            f1 AS (SELECT * FROM fr WHERE r = 1),
            g AS (SELECT DISTINCT period_label FROM lab),
            cat AS (
              SELECT 1 AS position, 'sex' AS variable, sex AS level, period_label, count(*) AS n FROM f1 GROUP BY ALL
              UNION ALL
              SELECT 3, 'outcome', o.outcome, g.period_label, count(l.patid) FROM g
                CROSS JOIN (SELECT DISTINCT outcome FROM lab) o
                LEFT JOIN lab l ON l.outcome = o.outcome AND l.period_label = g.period_label GROUP BY ALL)
            SELECT 0 AS position, 'Number of patients' AS variable, NULL AS level, period_label, count(*) AS n,
              NULL::BIGINT AS denominator, NULL::DOUBLE AS percent, NULL::DOUBLE AS q_low, NULL::DOUBLE AS median,
              NULL::DOUBLE AS q_high FROM f1 GROUP BY period_label
            UNION ALL
            SELECT position, variable, level, period_label, n,
              CAST(sum(n) OVER (PARTITION BY position, period_label) AS BIGINT),
              round_even(100 * (n::DOUBLE / sum(n) OVER (PARTITION BY position, period_label)), 0), NULL, NULL, NULL FROM cat
            UNION ALL
            SELECT 2, 'age', NULL, period_label, count(age), NULL, NULL, round(quantile_cont(age, 0.25), 9),
              round(quantile_cont(age, 0.5), 9), round(quantile_cont(age, 0.75), 9) FROM lab GROUP BY period_label"""


def chi_square(rows: str, variable: str) -> str:
    """Pearson's test of a variable against three groups: with even degrees the tail is a finite sum."""
    return f"""
            ct_{variable} AS (SELECT {variable} AS level, period_label, count(*)::DOUBLE AS n FROM {rows}
              WHERE {variable} IS NOT NULL GROUP BY ALL),
            rt_{variable} AS (SELECT level, sum(n) AS r FROM ct_{variable} GROUP BY 1),
            gt_{variable} AS (SELECT period_label, sum(n) AS c FROM ct_{variable} GROUP BY 1),
            st_{variable} AS (SELECT sum((coalesce(n, 0) - r * c / t) ** 2 / (r * c / t)) AS x,
                CAST((SELECT count(*) - 1 FROM rt_{variable}) * (SELECT count(*) - 1 FROM gt_{variable}) / 2 AS BIGINT) AS half
              FROM rt_{variable} CROSS JOIN gt_{variable} CROSS JOIN (SELECT sum(n) AS t FROM ct_{variable})
              LEFT JOIN ct_{variable} USING (level, period_label)),
            tail_{variable} AS (SELECT sum(exp(-x / 2) * (x / 2) ** k / factorial(CAST(k AS INTEGER))) AS p
              FROM st_{variable} CROSS JOIN range(0, 20) AS g(k) WHERE k < half)"""


TESTS = f""",
            rk AS (SELECT period_label, rank() OVER (ORDER BY age) + (count(*) OVER (PARTITION BY age) - 1) / 2.0::DOUBLE
                     AS r, count(*) OVER (PARTITION BY age) AS t FROM lab WHERE age IS NOT NULL),
            gr AS (SELECT period_label, sum(r) AS s, count(*) AS n FROM rk GROUP BY 1),
            tt AS (SELECT sum(t::DOUBLE * t - 1) AS ties, count(*)::DOUBLE AS n FROM rk),
            hh AS (SELECT (12 / (tt.n * (tt.n + 1)) * sum(s * s / gr.n) - 3 * (tt.n + 1))
                     / (1 - ties / (tt.n * tt.n * tt.n - tt.n)) AS h FROM gr CROSS JOIN tt GROUP BY tt.n, ties),
            {chi_square("f1", "sex")}, {chi_square("lab", "outcome")},
            tests AS (SELECT 'age' AS variable, round(exp(-h / 2), 9) AS p_value FROM hh
              UNION ALL SELECT 'sex', round(p, 9) FROM tail_sex UNION ALL SELECT 'outcome', round(p, 9) FROM tail_outcome)"""


def oracles(spline_weights=None) -> dict[str, str]:
    sql = {
        "stage_visit_index": f"WITH {ADMISSIONS} SELECT source_ordinal, patid, row_number() OVER (PARTITION BY patid "
            "ORDER BY date_admit, date_dis, source_ordinal) AS visit, count(*) OVER (PARTITION BY patid) "
            "AS visit_last FROM adm",
        "dedupe_exact": base() + "SELECT patid, date_admit, date_dis, source_ordinal, icd_m3, outcome FROM e2",
        "merge_same_start": base() + "SELECT patid, date_admit, date_dis, source_ordinal, icd_m3, outcome FROM e3",
        "resolve_outcome_0": ALIVE + "SELECT patid, date_admit, outcome FROM e4",
        "resolve_outcome_1": base() + "SELECT patid, date_admit, outcome FROM e4",
        "impute_dob": base() + "SELECT patid, date_admit, dob, birthyear FROM b8",
        "followup_end": base() + "SELECT patid, date_admit, date_dis, time_at_lastfup, time_dis_to_lastfup FROM e5",
        "index_cohort_semi": base() + "SELECT patid, date_admit, icd_m3, measles, age_at_admit_d FROM coh",
        "index_order": base() + "SELECT patid, date_admit, measles_order FROM ord",
        "gap_days": base() + "SELECT patid, date_admit, tim_diff FROM gap",
        "merge_close_pairwise": base() + "SELECT patid, date_admit, date_dis, icd_m3, measles, measles_order, "
            "measles_group, age_at_admit_d, outcome FROM mrg",
        "merge_close_transitive": base(mode="transitive") + "SELECT patid, date_admit, date_dis, icd_m3, measles, "
            "measles_order, measles_group, age_at_admit_d, outcome FROM mrg",
        "classify_infection": base() + "SELECT patid, date_admit, infection_type FROM cls",
        "anchor_index": base() + "SELECT patid, date_admit, date_admit_index, date_dis_index, age_at_index_d, "
            "hospitalization, time_ad_index_to_ad, period FROM anc",
        "exclude_anti": base() + "SELECT patid, date_admit, icd_m3 FROM epi",
        "episodes": base() + f"SELECT {EPISODE_COLS} FROM epi",
        "episodes_worse_alive": ALIVE + f"SELECT {EPISODE_COLS} FROM epi",
        "episodes_prefiltered": base() + f"SELECT {EPISODE_COLS} FROM epi",
        "period_counts": base() + "SELECT period, count(*) AS n_rows, count(DISTINCT patid) AS n_subjects FROM epi "
            "GROUP BY 1",
        "lookback_rows": base() + "SELECT patid, date_admit, period FROM epi WHERE time_ad_index_to_ad >= -730",
        "last_seen": base() + "SELECT patid, date_admit, max(year(date_admit)) OVER (PARTITION BY patid) AS last_year, "
            "max(date_dis) OVER (PARTITION BY patid) AS date_dis_last FROM epi WHERE period <> 'before'",
        "first_record": base() + "SELECT patid, period, min(date_admit) AS date_admit FROM epi GROUP BY ALL",
        "before_intervals": FULL + "SELECT patid, date_admit, flag AS flag_index_impute, status, obs_time, time_start, "
            "time_stop, infection_type, hospitalization FROM bef",
        "after_intervals": FULL + "SELECT patid, period, status, time_start, time_stop, sex, district, age_at_index_d, "
            "hospitalization_index, date_dis_index, infection_type, hospitalization FROM ain",
        "washout_fold": FULL + "SELECT patid, period, date_admit, date_dis, date_dis_index, time_at_lastfup FROM fold",
        "person_weeks": FULL + f"SELECT {PW_COLS} FROM pw",
        "person_weeks_before": FULL + f"SELECT {PW_COLS} FROM pw WHERE period = 'before'",
        "person_weeks_after": FULL + f"SELECT {PW_COLS} FROM pw WHERE period = 'after'",
        "wave": FULL + "SELECT patid, week, infection_type, hospitalization, period, row_number() OVER (PARTITION BY patid "
            "ORDER BY age_at_infection, time_after_index, week NULLS FIRST, infection_type, hospitalization) + "
            "CASE WHEN period = 'after' THEN 1 ELSE 0 END AS wave FROM pw",
        "wave_plain": FULL + "SELECT patid, week, infection_type, hospitalization, period, row_number() OVER ("
            "PARTITION BY patid ORDER BY age_at_infection, time_after_index, week NULLS FIRST, infection_type, "
            "hospitalization) AS wave FROM pw",
        "calendar_year": FULL + "SELECT calendar_year, period, count(*) AS n, CAST(sum(status) AS BIGINT) AS events, "
            "CAST(sum(n_days) AS BIGINT) AS days FROM pw GROUP BY ALL",
        "subpopulation_under13": FULL + "SELECT period, count(*) AS n, CAST(sum(n_days) AS BIGINT) AS days FROM pw "
            "WHERE age_at_infection <= 13 GROUP BY ALL",
        "subpopulation_under4": FULL + "SELECT period, count(*) AS n, CAST(sum(n_days) AS BIGINT) AS days FROM pw "
            "WHERE age_at_infection <= 4 AND time_after_index <= 2 GROUP BY ALL",
        "subject_span": FULL + f"SELECT patid, round(age_at_index_y, 9) AS age_at_index_y, round(min({REL}), 9) AS tstart, "
            f"round(min(age_at_infection), 9) AS age_start, round(max({REL}), 9) AS tstop, "
            "round(max(age_at_infection), 9) AS age_stop FROM pw GROUP BY patid, age_at_index_y",
        "figure_events": FULL + f"SELECT patid, period, round(age_at_infection, 9) AS age_at_infection, "
            f"round({REL}, 9) AS relative_time FROM pw WHERE status = 1",
        "followup_by_year": FULL + "SELECT CASE calendar_year WHEN 1994 THEN 1995 WHEN 2002 THEN 2001 ELSE calendar_year "
            "END AS calendar_year, CASE WHEN time_after_index <= 0 THEN 'pre-MeV' WHEN time_after_index <= 10 THEN "
            "'post-MeV' END AS time_band, round(sum(n_days) / 365.0::DOUBLE, 6) AS person_years FROM pw GROUP BY 1, 2",
        "max_event_time": FULL + "SELECT round(max(time_after_index), 9) AS max_time FROM pw WHERE status = 1",
        "retention_ratio": FULL + "SELECT count(*) FILTER (time_after_index >= 1) AS n_past_1y, count(*) FILTER "
            "(time_after_index >= 2) AS n_past_2y, round(count(*) FILTER (time_after_index >= 2)::DOUBLE / "
            "count(*) FILTER (time_after_index >= 1), 9) AS ratio FROM pw",
        "stage_counts": base() + " UNION ALL ".join(
            f"SELECT '{name}' AS stage, count(*) AS n_rows, count(DISTINCT patid) AS n_subjects FROM {table}"
            for name, table in [
                ("1 admissions", "adm"), ("2 exact duplicates merged", "e2"), ("3 same admission day merged", "e3"),
                ("4 birth date known", "b8"), ("5 follow-up valid", "val"),
                ("6 infections of index subjects", "coh"), ("7 close admissions merged", "mrg"),
                ("8 excluded code removed", "epi")]),
        "crude_rates": FULL + "SELECT period, CAST(sum(status) AS BIGINT) AS events, round(sum(n_days) / 365.0::DOUBLE, 6) "
            "AS person_years, round(sum(status) / (sum(n_days) / 365.0::DOUBLE), 9) AS rate FROM pw GROUP BY 1",
        "crude_irr_robust": CRUDE_ALL + f"SELECT round(b1, 6) AS estimate, round(sqrt(v00 + v11 - 2 * v01), 6) AS std_err, "
            f"round(exp(b1), 6) AS irr, round(exp(b1 - {Z} * sqrt(v00 + v11 - 2 * v01)), 6) AS irr_lower, "
            f"round(exp(b1 + {Z} * sqrt(v00 + v11 - 2 * v01)), 6) AS irr_upper FROM rob",
        "piecewise_rates": FULL + f""",
            bnd AS (SELECT {BAND_CASE} AS band, sum(status) AS events, sum(n_days) / 365.0::DOUBLE AS py FROM pw GROUP BY 1)
            SELECT band, CAST(events AS BIGINT) AS events, round(py, 6) AS person_years, round(events / py, 9) AS rate,
              CASE WHEN events > 0 THEN round(ln((events / py) / (SELECT events / py FROM bnd WHERE band = 1)), 6) END
                AS log_rate_ratio
            FROM bnd WHERE band IS NOT NULL""",
        "cut_right_closed": FULL + f"SELECT {BAND_CASE} AS band, count(*) AS n FROM pw GROUP BY 1",
        "monthly_counts": f"WITH {ADMISSIONS} SELECT year(date_admit) AS year, month(date_admit) AS month, "
            "count(*) AS cases FROM adm WHERE icd_m3 = 'B05' GROUP BY ALL",
        "monthly_spine": f"""WITH {ADMISSIONS}, m AS (SELECT unnest(generate_series(DATE '1995-01-01', DATE '2001-12-01',
            INTERVAL 1 MONTH))::DATE AS d)
            SELECT year(d) AS year, month(d) AS month, count(patid) AS cases,
              round(year(d) + (month(d) - 1) / 12.0::DOUBLE, 9) AS time
            FROM m LEFT JOIN adm ON date_trunc('month', date_admit) = d AND icd_m3 = 'B05' GROUP BY d""",
        "reason_pivot": ALIVE + REASON.format(code="icd_m3"),
        "reason_pivot_repeats": ALIVE + REASON.format(code="rtrim(icd_m3, '*')"),
        "baseline_continuous_iqr": ALIVE + LABELLED + quantiles("age", "period_label", "lab", IQR),
        "baseline_continuous_90": ALIVE + LABELLED + quantiles(
            "age", "period_label", "lab", {"q_low": 0.05, "median": 0.5, "q_high": 0.95}),
        "baseline_continuous_range": ALIVE + LABELLED + quantiles(
            "age", "period_label", "lab", {"q_low": 0.0, "median": 0.5, "q_high": 1.0}),
        "baseline_continuous_mic": ALIVE + LABELLED + quantiles(
            "age", "period_label", "lab", {"median": 0.5, "q90": 0.9, "min": 0.0, "max": 1.0}),
        "order_price_quantiles": quantiles("o_totalprice", "o_orderstatus", "orders", IQR, pooled=True),
        "pooled_groups": ALIVE + LABELLED + quantiles("age", "period_label", "lab", IQR, pooled=True),
        "baseline_categorical": ALIVE + LABELLED + categorical("outcome", "period_label", "lab"),
        "group_sizes": ALIVE + LABELLED + "SELECT period_label, count(*) AS n FROM lab GROUP BY 1 "
            "UNION ALL SELECT 'All patients', count(*) FROM lab",
        "outcome_crosstab": base() + "SELECT outcome, count(*) FILTER (period = 'before') AS before, "
            "count(*) FILTER (period = 'measles') AS measles, count(*) FILTER (period = 'after') AS after "
            "FROM epi GROUP BY 1",
        "kruskal_h": base() + """,
            rk AS (SELECT period, age, rank() OVER (ORDER BY age) + (count(*) OVER (PARTITION BY age) - 1) / 2.0::DOUBLE
                     AS r, count(*) OVER (PARTITION BY age) AS t FROM epi),
            gr AS (SELECT period, sum(r) AS s, count(*) AS n FROM rk GROUP BY 1),
            tt AS (SELECT sum(t::DOUBLE * t - 1) AS ties, count(*)::DOUBLE AS n FROM rk),
            hh AS (SELECT (12 / (tt.n * (tt.n + 1)) * sum(s * s / gr.n) - 3 * (tt.n + 1))
                     / (1 - ties / (tt.n * tt.n * tt.n - tt.n)) AS h, CAST(tt.n AS BIGINT) AS n_total,
                     count(*) AS n_groups FROM gr CROSS JOIN tt GROUP BY tt.n, ties)
            SELECT n_total, n_groups, round(h, 6) AS h, n_groups - 1 AS df, round(exp(-h / 2), 6) AS p_value FROM hh""",
        "histogram": FULL + "SELECT period, CAST(floor(age_at_infection / 0.25) AS BIGINT) AS bin, count(*) AS n, "
            "round(floor(age_at_infection / 0.25) * 0.25, 6) AS bin_start FROM pw GROUP BY ALL",
        "histogram_relative": FULL + f"SELECT period, CAST(floor(({REL}) / 0.25) AS BIGINT) AS bin, count(*) AS n, "
            f"round(floor(({REL}) / 0.25) * 0.25, 6) AS bin_start FROM pw GROUP BY ALL",
        "sample_topk": FULL + "SELECT patid, round(max(age_at_infection), 9) AS age_stop FROM pw GROUP BY patid "
            "ORDER BY md5(patid || '|12321'), patid LIMIT 20",
        "recode_levels": base() + "SELECT CASE outcome WHEN 'discharged' THEN 'Discharged' WHEN 'dead' THEN 'Dead' END "
            "AS label, CASE outcome WHEN 'discharged' THEN 1 WHEN 'dead' THEN 2 END AS sort_rank, count(*) AS n "
            "FROM epi GROUP BY ALL",
        "scenario_censoring": base() + "," + scenarios() +
            "SELECT scenario_id, patid, days AS emigration_days FROM drw",
        "scenario_followup": base() + "," + scenarios() + "SELECT scenario_id, patid, date_admit, period, "
            "time_at_lastfup, CASE WHEN period = 'before' THEN time_dis_to_lastfup ELSE time_at_lastfup - date_dis_index "
            "END AS time_dis_to_lastfup FROM sep",
        "scenario_person_time": SCEN + "SELECT scenario_id, period, count(*) AS n, CAST(sum(status) AS BIGINT) AS events, "
            "CAST(sum(n_days) AS BIGINT) AS days FROM pw GROUP BY ALL",
        "event_chains_transitive": """WITH d AS (SELECT DISTINCT user_id AS patid, CAST(ts AS DATE) AS day FROM events),
            g AS (SELECT *, day - lag(day) OVER (PARTITION BY patid ORDER BY day) AS gap FROM d),
            c AS (SELECT patid, day, sum(CASE WHEN gap <= 2 THEN 0 ELSE 1 END) OVER (PARTITION BY patid ORDER BY day)
              AS chain FROM g)
            SELECT patid, min(day) AS date_admit, max(day) AS date_dis FROM c GROUP BY patid, chain""",
        "bound_chain_join": MORTALITY + """ SELECT m.location, m.year, m.age, m.cause_of_death, round(m.value, 6) AS value,
            m.lower_bound, m.upper_bound, CASE m.age WHEN '<5 years' THEN p.lower_bound ELSE p.upper_bound END AS val
            FROM mor m LEFT JOIN mor p ON p.location = m.location AND p.year = m.year
              AND p.cause_of_death = m.cause_of_death AND p.age <> m.age""",
        "mortality_share": MORTALITY + " SELECT location, year, age, cause_of_death, round(value, 6) AS value, "
            "lower_bound, upper_bound FROM mor WHERE year = 2000",
        "gee_period_only": CRUDE_ALL + """SELECT 'period_only' AS model_id, '(Intercept)' AS term, round(b0, 6) AS beta,
            round(sqrt(v00), 6) AS std_err FROM rob UNION ALL
            SELECT 'period_only', 'after', round(b1, 6), round(sqrt(v00 + v11 - 2 * v01), 6) FROM rob""",
        "gee_bands_only": FULL + f"""{BAND_FITS}
            SELECT CAST(every.band AS INTEGER) AS band, round(estimate, 5) AS estimate, round(std_err, 5) AS std_err
            FROM (SELECT unnest(range(2, 13)) AS band) every LEFT JOIN est ON est.band = every.band""",
        "baseline_characteristics": TABLE_ONE,
        "baseline_comparisons": TABLE_ONE.replace("SELECT 0 AS position", TESTS + " SELECT t.*, p_value FROM (SELECT 0 AS position", 1)
            + ") t LEFT JOIN tests USING (variable)",
        "coef_table_period": CRUDE_ALL + f"""SELECT 'after' AS term, round(b1, 6) AS estimate,
            round(sqrt(v00 + v11 - 2 * v01), 6) AS std_err, round(exp(b1), 6) AS exp_estimate,
            round(exp(b1 - {Z} * sqrt(v00 + v11 - 2 * v01)), 6) AS exp_lower,
            round(exp(b1 + {Z} * sqrt(v00 + v11 - 2 * v01)), 6) AS exp_upper FROM rob""",
        "wald_period": CRUDE_ALL + """SELECT 'after' AS block, round(b1 * b1 / (v00 + v11 - 2 * v01), 4) AS chi2,
            1 AS df FROM rob UNION ALL SELECT 'overall', round(b1 * b1 / (v00 + v11 - 2 * v01), 4), 1 FROM rob""",
        "predict_rate_period": CRUDE_ALL + f""", pr AS (SELECT t AS time_label, CASE WHEN t = 'before' THEN b0 ELSE b0 + b1 END
            AS e, CASE WHEN t = 'before' THEN sqrt(v00) ELSE sqrt(v11) END AS s
            FROM rob CROSS JOIN (VALUES ('before'), ('after')) AS x(t))
            SELECT sex, time_label, {limits("e", "s")} FROM pr CROSS JOIN (VALUES ('male'), ('female')) AS y(sex)""",
        "rate_difference_period": CRUDE_ALL + f""", rd AS (SELECT sy1 / st1 - sy0 / st0 AS e,
            sqrt((sy1 / st1) ** 2 * v11 + (sy0 / st0) ** 2 * v00 - 2 * (sy1 / st1) * (sy0 / st0) * v01) AS s FROM rob)
            SELECT sex, {limits("e", "s")} FROM rd CROSS JOIN (VALUES ('male'), ('female')) AS y(sex)""",
        "irr_curve_period": CRUDE_ALL + f"""SELECT 'period_only' AS model_id, round(2 / 52.0::DOUBLE + k * 0.01::DOUBLE, 6)
            AS time_after_index, {limits("b1", AFTER_ERROR)} FROM rob CROSS JOIN range(0, 997) AS g(k)""",
        "irr_table_period": CRUDE_ALL + f"""SELECT CAST(position AS INTEGER) AS position, label, round(exp(b1), 6) AS estimate,
            round(exp(b1 - {Z} * {AFTER_ERROR}), 6) AS lower, round(exp(b1 + {Z} * {AFTER_ERROR}), 6) AS upper
            FROM rob CROSS JOIN ({TIMES})""",
        "irr_table_bands": FULL + f"""{BAND_FITS} SELECT CAST(position AS INTEGER) AS position, label,
            round(coalesce(estimate, 0), 5) AS estimate, round(coalesce(std_err, 0), 5) AS std_err FROM (SELECT position, label, {BAND_CASE.replace("time_after_index", "t")} AS band FROM ({TIMES}))
            LEFT JOIN est USING (band)""",
        "zero_crossing_bands": FULL + f"""{BAND_FITS}, grid AS (
              SELECT t, coalesce(estimate, 0) AS e, lag(t) OVER (ORDER BY t) AS t0,
                lag(coalesce(estimate, 0)) OVER (ORDER BY t) AS e0
              FROM (SELECT t, {BAND_CASE.replace("time_after_index", "t")} AS band
                    FROM (SELECT 0.05::DOUBLE + k * 0.25::DOUBLE AS t FROM range(0, 40) AS g(k))) LEFT JOIN est USING (band))
            SELECT 'bands_only' AS model_id, round(min(CASE WHEN e = 0 THEN t WHEN e0 * e < 0 THEN t0 + (t - t0) * e0 / (e0 - e) END), 3)
              AS time_at_zero FROM grid""",
        "scenario_curves_period": CRUDE_SCEN + f"""SELECT scenario_id, round(2 / 52.0::DOUBLE + k * 0.5::DOUBLE, 6)
            AS time_after_index, {limits("b1", AFTER_ERROR)} FROM rob CROSS JOIN range(0, 12) AS g(k)""",
        "contrast_subset_period": CRUDE_ALL + f"""SELECT '(Intercept)' AS term, {limits("b0", "sqrt(v00)")} FROM rob UNION ALL
            SELECT 'after', {limits("b1", AFTER_ERROR)} FROM rob""",
        "pairwise_diffs_period": CRUDE_ALL + """SELECT '(Intercept) vs. after' AS contrast, round(b0 - b1, 6) AS estimate,
            round(sqrt(4 * v00 + v11 - 4 * v01), 6) AS std_err FROM rob""",
        "gee_period_scenarios": CRUDE_SCEN + """SELECT 'period_only:' || scenario_id AS model_id, '(Intercept)' AS term,
            round(b0, 6) AS beta, round(sqrt(v00), 6) AS std_err FROM rob UNION ALL
            SELECT 'period_only:' || scenario_id, 'after', round(b1, 6), round(sqrt(v00 + v11 - 2 * v01), 6) FROM rob""",
        "pool_rubin_period": CRUDE_SCEN + """SELECT '(Intercept)' AS term, round(avg(b0), 6) AS beta,
            round(sqrt(avg(v00) + (1 + 1 / 3.0::DOUBLE) * var_samp(b0)), 6) AS std_err FROM rob UNION ALL
            SELECT 'after', round(avg(b1), 6),
            round(sqrt(avg(v00 + v11 - 2 * v01) + (1 + 1 / 3.0::DOUBLE) * var_samp(b1)), 6) FROM rob""",
    }
    if spline_weights is not None:
        sql["ns_basis"] = FULL + _spline_means(*spline_weights)
    return sql


def _spline_means(knots, weights) -> str:
    """Mean of each basis function of age by period, from the cubes of (age - knot)+."""
    cubes = ", ".join(
        f"greatest(age_at_infection - {k!r}::DOUBLE, 0.0::DOUBLE) ** 3 AS c{i}" for i, k in enumerate(knots))
    parts = []
    for position, column in enumerate(zip(*weights)):
        total = " + ".join([f"{column[0]!r}::DOUBLE * (age_at_infection - {knots[0]!r}::DOUBLE)"]
                           + [f"{w!r}::DOUBLE * c{i}" for i, w in enumerate(column[1:])])
        parts.append(f"SELECT period, {position} AS k, round(avg({total}), 5) AS mean FROM cub GROUP BY period")
    return f", cub AS (SELECT period, age_at_infection, {cubes} FROM pw) " + " UNION ALL ".join(parts)
