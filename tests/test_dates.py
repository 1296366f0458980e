"""Literal vectors for the date rules (FIXTURES.md section 4)."""

import datetime as dt

from pyspark.sql import functions as F

from profilebook.functions import dates
from profilebook.plans.catalog import month_catalog

D = dt.date

EXPIRY = [  # signing, month, years -> result
    (D(2023, 8, 15), 8, 1, D(2024, 8, 31)),
    (D(2023, 8, 15), 12, 1, D(2023, 12, 31)),
    (D(2023, 8, 15), 10, 1, D(2024, 10, 31)),
    (D(2023, 8, 15), 2, 2, D(2025, 2, 28)),
    (D(2022, 8, 15), 2, 2, D(2024, 2, 29)),
    (D(2023, 10, 2), 12, 1, D(2024, 12, 31)),
    (D(2023, 10, 1), 12, 1, D(2023, 12, 31)),
    (D(2024, 3, 31), 6, 3, D(2026, 6, 30)),
    (D(2024, 4, 1), 6, 3, D(2027, 6, 30)),
    (D(2023, 8, 30), None, 1, D(2024, 8, 31)),
    (D(2023, 2, 27), None, 1, D(2024, 2, 29)),
    (D(2023, 8, 15), 8, 0, D(2023, 8, 31)),
    (D(2023, 8, 15), 12, 0, D(2022, 12, 31)),
    (None, 6, 1, None),
    (None, None, 1, None),
]


def test_expiry_vectors(spark):
    df = spark.createDataFrame([(i, s, m, y) for i, (s, m, y, _) in enumerate(EXPIRY)],
                               "i int, s date, m int, y int")
    got = {r.i: r.e for r in df.select("i", dates.expiry_date(F.col("m"), F.col("s"), F.col("y")).alias("e")).collect()}
    assert [got[i] for i in range(len(EXPIRY))] == [e for *_, e in EXPIRY]


def test_add_months_sticks_to_month_end(spark):
    df = spark.createDataFrame([(D(2023, 2, 28),), (D(2023, 1, 31),), (D(2023, 1, 15),)], "d date")
    got = [r.x for r in df.select(dates.add_months_sticky(F.col("d"), 12).alias("x")).collect()]
    assert got == [D(2024, 2, 29), D(2024, 1, 31), D(2024, 1, 15)]


def test_formats(spark):
    df = spark.createDataFrame([(D(2023, 8, 5),)], "d date")
    r = df.select(dates.fmt_dd_mon_yyyy(F.col("d")).alias("a"), dates.fmt_compact(F.col("d")).alias("b"),
                  dates.fmt_dmy(F.col("d")).alias("c"), dates.month_name(F.col("d")).alias("m")).first()
    assert (r.a, r.b, r.c, r.m) == ("05/AUG/2023", "20230805", "05/08/2023", "AUGUST")


def test_parse_bad_text_is_null(spark):
    df = spark.createDataFrame([("9/8/2023",), ("31/02/2023",), ("junk",)], "s string")
    assert [r.d for r in df.select(dates.parse_dmy(F.col("s")).alias("d")).collect()] == [D(2023, 8, 9), None, None]


def test_month_catalog(spark):
    full = month_catalog(spark).orderBy("CODIGO").collect()
    assert [r.DESCRIPCION for r in full][:3] == ["JANUARY", "FEBRUARY", "MARCH"] and len(full) == 12
    assert all(r.ADICIONAL1 is None for r in full)
    assert [(r.CODIGO, r.DESCRIPCION) for r in month_catalog(spark, "MA").orderBy("CODIGO").collect()] == [
        (3, "MARCH"), (5, "MAY")]
    assert month_catalog(spark, "ma").count() == 0
