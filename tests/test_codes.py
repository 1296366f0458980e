"""Literal vectors for the code rules (FIXTURES.md section 4)."""

from pyspark.sql import functions as F

from profilebook.functions import codes


def _col(spark, rows, schema, expr):
    df = spark.createDataFrame(rows, schema)
    return [r.x for r in df.select(expr.alias("x")).collect()]


def test_type_derivation(spark):
    rows = [(None, "C"), (None, "B"), ("02", "C"), ("02", "b"), ("07", "C"), ("07", "B"), ("99", "C"), (None, "I")]
    got = _col(spark, rows, "seg string, l string", codes.customer_type(F.col("seg"), F.col("l")))
    assert got == [1, 2, 4, 5, 6, 7, 1, None]


def test_ny_agency(spark):
    rows = [("YES", "x"), ("NO", "BR"), (None, "BR"), (None, "ARG"), (None, "PA"), ("yes", "BR"), ("yes", "PA")]
    got = _col(spark, rows, "f string, c string", codes.ny_agency(F.col("f"), F.col("c")))
    assert got == ["1", "0", "1", "1", "0", "1", "0"]


def test_flags(spark):
    assert _col(spark, [(4,), (5,), (1,), (None,)], "t int", codes.limit_type(F.col("t"))) == ["E", "E", "C", "C"]
    assert _col(spark, [(" Y ",), ("N",), (None,), ("y",)], "p string", codes.pep_flag(F.col("p"))) == ["1", "0", "0", "0"]
    assert _col(spark, [("1",), ("0",), (None,)], "s string", codes.exporter_text(F.col("s"))) == ["SI", "NO", "NO"]
    assert _col(spark, [("1",), ("0",), (None,)], "s string", codes.agency_text(F.col("s"))) == ["YES", "NO", None]


def test_rating_text(spark):
    rows = [("MOODYS:A1 SP:AA FITCH:",), (None,)]
    df = spark.createDataFrame(rows, "r string")
    got = [(x.sp, x.fi, x.mo) for x in df.select(codes.rating_part(F.col("r"), 2).alias("sp"),
                                                 codes.rating_part(F.col("r"), 3).alias("fi"),
                                                 codes.rating_part(F.col("r"), 1).alias("mo")).collect()]
    assert got == [("AA", "NC", "A1"), ("NC", "NC", "NC")]


def test_truncate_and_pad(spark):
    assert _col(spark, [(None,), ("ab   ",), ("x" * 200,)], "s string", codes.truncate_default(F.col("s"))) == [
        "NA", "ab", "x" * 105]
    assert _col(spark, [(3,), (11,), (None,)], "m int", codes.pad_month(F.col("m"))) == ["03", "11", None]
