"""Column expressions shared by the operators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recurra.config import UNKNOWN


def subject_keys(df: DataFrame) -> list[str]:
    """The columns that identify a subject: with a scenario column, one copy per scenario."""
    return [c for c in ("scenario_id", "patid") if c in df.columns]


def per_subject(df: DataFrame, *order: str | Column):
    """Window over one subject's rows; NULL dates last."""
    window = Window.partitionBy(*subject_keys(df))
    if order:
        window = window.orderBy(*(F.asc_nulls_last(c) if isinstance(c, str) else c for c in order))
    return window


def poisoned(aggregate, col: Column, window, na_poison: bool) -> Column:
    """Aggregate over a window; with na_poison a single NULL makes the result NULL."""
    result = aggregate(col).over(window)
    if not na_poison:
        return result
    complete = F.count(col).over(window) == F.count(F.lit(1)).over(window)
    return F.when(complete, result)


def fill_category(col: str | Column, value: str = UNKNOWN) -> Column:
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(value))


def yes_no(condition: Column) -> Column:
    return F.when(condition, F.lit("yes")).otherwise(F.lit("no"))


def flag_codes(code: str | Column, codes: Sequence[str], yes: str = "yes", no: str = "no") -> Column:
    code = F.col(code) if isinstance(code, str) else code
    return F.when(code.isin(list(codes)), F.lit(yes)).otherwise(F.lit(no))


def birthday(birthyear: Column, dob: Column, years: int, mode: str = "strict") -> Column:
    """Date of the given birthday, from the year of birth and the month and day of `dob`.

    29 February has no date in a non-leap year: NULL in "strict" mode, the 28th in "clamp".
    """
    year = birthyear + F.lit(years)
    leap = (year % 4 == 0) & ((year % 100 != 0) | (year % 400 == 0))
    impossible = (F.month(dob) == 2) & (F.dayofmonth(dob) == 29) & ~leap
    fallback = F.make_date(year, F.lit(2), F.lit(28)) if mode == "clamp" else F.lit(None).cast("date")
    return F.when(impossible, fallback).otherwise(F.make_date(year, F.month(dob), F.dayofmonth(dob)))


def both_or_null(pick, a: Column, b: Column) -> Column:
    """least/greatest that give NULL as soon as one side is NULL."""
    return F.when(a.isNotNull() & b.isNotNull(), pick(a, b))


def cut(col: str | Column, breaks: Sequence[float], include_lowest: bool = False) -> Column:
    """1-based number of the right-closed bin (b[i-1], b[i]]; NULL outside all bins."""
    value = F.col(col) if isinstance(col, str) else col
    result = F.when(F.lit(False), F.lit(0))
    for number, (lo, hi) in enumerate(zip(breaks[:-1], breaks[1:]), start=1):
        above = value >= lo if include_lowest and number == 1 else value > lo
        result = result.when(above & (value <= hi), F.lit(number))
    return result


def clamp_year(year: str | Column, first: int, last: int) -> Column:
    """Move the year before `first` to it and the year after `last` to it; no other year."""
    year = F.col(year) if isinstance(year, str) else year
    return F.when(year == first - 1, first).when(year == last + 1, last).otherwise(year)


def relabel(col: str | Column, mapping: dict[str, str]) -> Column:
    """Replace the listed labels, keep the others."""
    col = F.col(col) if isinstance(col, str) else col
    result = col
    for old, new in mapping.items():
        result = F.when(col == old, F.lit(new)).otherwise(result)
    return result


def recode(col: str | Column, levels: Sequence[str], labels: Sequence[str] | None = None) -> Column:
    """Closed, ordered level set: struct(label, sort_rank); a value not listed gives NULLs."""
    col = F.col(col) if isinstance(col, str) else col
    label, rank = F.when(F.lit(False), F.lit("")), F.when(F.lit(False), F.lit(0))
    for position, (level, shown) in enumerate(zip(levels, labels or levels), start=1):
        label = label.when(col == level, F.lit(shown))
        rank = rank.when(col == level, F.lit(position))
    return F.struct(label.alias("label"), rank.alias("sort_rank"))


def uniform(*parts: Column) -> Column:
    """A number in (0, 1) from the first 52 bits of the md5 of the parts joined by '|'."""
    text = F.concat_ws("|", *(part.cast("string") for part in parts))
    bits = F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double")
    return (bits + F.lit(0.5)) / F.lit(float(1 << 52))


def exponential_days(rate: Column, *parts: Column) -> Column:
    """Whole days until an exponential event with `rate` per year; NULL when the rate is 0."""
    return exponential_of(rate, uniform(*parts))


def exponential_of(rate: Column, drawn: Column) -> Column:
    """`exponential_days` of a number in (0, 1) that is already drawn."""
    draw = F.bround(-F.ln(drawn) / rate * F.lit(365)).cast("int")
    return F.when(rate > 0, draw)
