"""Date parsing, formatting and Oracle month arithmetic.

All are column expressions: they stay in whole-stage codegen.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SENTINEL_LIMIT_DATE = "1980-01-01"   # group / guarantor marker (fixed value)
GROUP_KYC_DATE = "1990-01-01"        # KYC date stamped on group rows (fixed value)


def lit_date(iso: str) -> Column:
    return F.lit(iso).cast("date")


def fmt_dd_mon_yyyy(d: Column) -> Column:
    """``TO_CHAR(d, 'dd/MON/yyyy')`` -> '15/AUG/2023'."""
    return F.upper(F.date_format(d, "dd/MMM/yyyy"))


def fmt_compact(d: Column) -> Column:
    """``TO_CHAR(d, 'yyyymmdd')``."""
    return F.date_format(d, "yyyyMMdd")


def fmt_iso(d: Column) -> Column:
    """``TO_CHAR(d, 'YYYY-MM-DD')``."""
    return F.date_format(d, "yyyy-MM-dd")


def fmt_dmy(d: Column) -> Column:
    """``TO_CHAR(d, 'dd/mm/yyyy')`` (Oracle ``mm`` is the month)."""
    return F.date_format(d, "dd/MM/yyyy")


def month_name(d: Column) -> Column:
    """``TO_CHAR(d, 'MONTH')`` without Oracle's blank padding."""
    return F.upper(F.date_format(d, "MMMM"))


def parse_dmy(s: Column) -> Column:
    """``TO_DATE(s, 'dd/mm/yyyy')``; unparsable text gives NULL (see rejects)."""
    return F.to_date(F.try_to_timestamp(s, F.lit("d/M/yyyy")))


def parse_iso(s: Column) -> Column:
    """``TO_DATE(s, 'YYYY-MM-DD')``."""
    return F.to_date(F.try_to_timestamp(s, F.lit("yyyy-M-d")))


def parse_compact(s: Column) -> Column:
    """``TO_DATE(s, 'YYYYMMDD')``."""
    return F.to_date(F.try_to_timestamp(s, F.lit("yyyyMMdd")))


def add_months_sticky(d: Column, n: Column | int) -> Column:
    """Oracle ``ADD_MONTHS``: a month-end start stays on the month end."""
    n = F.lit(n) if isinstance(n, int) else n
    plain = F.add_months(d, n)
    return F.when(d == F.last_day(d), F.last_day(plain)).otherwise(plain)


def month_end(year: Column, month: Column) -> Column:
    """Last day of (year, month); NULL when the month is outside 1..12."""
    ok = month.between(1, 12)
    return F.when(ok, F.last_day(F.make_date(year.cast("int"), month.cast("int"), F.lit(1))))


def expiry_date(month: Column, signing: Column, years: Column) -> Column:
    """KYC expiry date.

    * no expiry month: signing date + 1 day, plus ``years`` sticky months;
    * same month as signing: month end of that month in year + years;
    * otherwise the month end in the signing year; more than 90 days after
      signing -> year + years - 1, else year + years (this can precede
      the signing date when years = 0; kept as the reference computes it).
    """
    y = F.year(signing)
    first = month_end(y, month)
    same = F.month(signing) == month
    late = F.datediff(first, signing) > 90
    target_year = F.when(same, y + years).when(late, y + years - 1).otherwise(y + years)
    with_month = month_end(target_year, month)
    no_month = add_months_sticky(F.date_add(signing, 1), years * 12)
    return F.when(month.isNull(), no_month).otherwise(with_month)
