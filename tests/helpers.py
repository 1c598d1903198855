"""Literal admissions for the small cases."""

import datetime as dt

from recurra.config import CohortConfig
from recurra.sources.tables import ADMISSION_SCHEMA

DAY0 = dt.date(2006, 1, 1)
BORN = dt.date(2000, 3, 10)
CFG = CohortConfig(followup_end=dt.date(2015, 12, 31), worse_as_dead=True)


def day(n):
    return None if n is None else DAY0 + dt.timedelta(days=n)


def adm(patid, admit, dis, code="B01", outcome="discharged", **other):
    """One admission; dates as days since DAY0."""
    row = {
        "patid": patid, "sex": "male", "district": "d1", "dob": BORN, "birthyear": 2000,
        "date_admit": day(admit), "date_dis": day(dis), "icd_m3": code, "outcome": outcome,
    }
    row.update(other)
    return row


def admissions(spark, rows):
    names = [f.name for f in ADMISSION_SCHEMA.fields]
    data = [tuple({"source_ordinal": i, **row}.get(name) for name in names) for i, row in enumerate(rows)]
    return spark.createDataFrame(data, ADMISSION_SCHEMA)


def dicts(df, *order):
    rows = [r.asDict() for r in df.collect()]
    return sorted(rows, key=lambda r: tuple((r[c] is None, r[c]) for c in order))
