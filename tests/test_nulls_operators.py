"""Null model and operator properties (no row multiplication, bounded text, keys)."""

from pyspark.sql import Window
import pytest
from pyspark.sql import functions as F

from profilebook.functions.nulls import ncat, opt_eq, opt_eq_null
from profilebook.operators.aggregates import latest_per_key, listagg
from profilebook.operators.joins import not_in
from profilebook.operators.keys import assign_keys, rank_within
from profilebook.operators.lookups import Lookup, lookups


def test_ncat_treats_null_as_empty(spark):
    df = spark.createDataFrame([("a", None), (None, None)], "a string, b string")
    got = [r.x for r in df.select(ncat(F.col("a"), "|", F.col("b")).alias("x")).collect()]
    assert got == ["a|", "|"]
    got = [r.x for r in df.select(ncat(F.col("a"), F.col("b")).alias("x")).collect()]
    assert got == ["a", None]


def test_optional_filters(spark):
    df = spark.createDataFrame([(1,), (2,), (None,)], "k int")
    assert sorted(r.k for r in df.filter(opt_eq(F.col("k"), None)).collect()) == [1, 2]
    assert len(df.filter(opt_eq_null(F.col("k"), None)).collect()) == 3
    assert [r.k for r in df.filter(opt_eq(F.col("k"), 2)).collect()] == [2]
    assert [r.k for r in df.filter(opt_eq_null(F.col("k"), 2)).collect()] == [2]


def test_lookup_never_multiplies_rows(spark):
    fact = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "id int, k string")
    dim = spark.createDataFrame([("a", "x1"), ("a", "x0"), ("b", "y")], "k string, v string")
    out = lookups(fact, [Lookup(dim, ["k"], ["k"], {"v": "v"})]).orderBy("id").collect()
    assert [(r.id, r.v) for r in out] == [(1, "x0"), (2, "y"), (3, None)]


def test_listagg_is_whole(spark):
    long = [(2, f"name {i:05d}") for i in range(2000)]
    df = spark.createDataFrame([(1, "b"), (1, "a"), (1, ""), (3, None), *reversed(long)], "k int, v string")
    out = {r.k: r.t for r in listagg(df, ["k"], F.col("v"), [F.col("v")], "|", "t", trailing=True).collect()}
    assert out == {1: "a|b|", 2: "".join(f"{v}|" for _, v in long)}


def test_creation_id_is_never_cut(spark):
    from profilebook.plans.upsert import _creation_id
    ids = spark.createDataFrame([(7,), (10 ** 13 - 1,)], "n long").select(_creation_id(F.col("n")).alias("i")).collect()
    assert [r.i for r in ids] == ["CUS0000000000007", "CUS9999999999999"]
    with pytest.raises(Exception, match="13 digits"):
        spark.createDataFrame([(10 ** 13,)], "n long").select(_creation_id(F.col("n")).alias("i")).collect()


def test_creation_ids_go_on_with_free_numbers(spark, monkeypatch):
    from profilebook.plans import upsert
    schema = "ID_SOLICITUD long, CUSTOMER_NO long, ID_CUSTOMER_FCC string, ID_EXISTE_FCC string, ID_STATUS_FCC int, CHK_CREATE_FCC int"
    last = 10 ** 13 - 1
    issued = [0, 1, 2, 3, 5, 6, 9, 9, 12, last - 2]
    rows = [(1, i, f"CUS{n:013d}", "0" if n in (3, 9) else "1", 0, 1) for i, n in enumerate(issued)]
    rows += [(2, i, None, "0" if i < 2 else "1", None, 1) for i in range(5)] + [(3, 0, "other", "1", 0, 1)]
    profile = spark.createDataFrame(rows, schema)
    free = [last - 1, last] + [n for n in range(1, 50) if n not in issued]
    failed = [(1, 3), (1, 6), (1, 7), (2, 0), (2, 1)]
    first = dict(zip([(2, i) for i in range(5)], free))
    both = first | dict(zip(failed, free[5:]))
    for block in (1, 2, 3, 1 << 20):
        monkeypatch.setattr(upsert, "FREE_BLOCK", block)
        for passes, expected in ((1, first), (2, both)):
            got = {(r.ID_SOLICITUD, r.CUSTOMER_NO): r.NEW_ID for r in upsert.creation_ids(profile, passes=passes).collect()}
            assert got == {k: f"CUS{n:013d}" for k, n in expected.items()}


def test_creation_ids_fail_when_no_number_is_left(spark, monkeypatch):
    from profilebook.plans import upsert
    monkeypatch.setattr(upsert, "LAST_NUMBER", 4)
    schema = "ID_SOLICITUD long, CUSTOMER_NO long, ID_CUSTOMER_FCC string, ID_EXISTE_FCC string, ID_STATUS_FCC int, CHK_CREATE_FCC int"
    held = [(1, n, f"CUS{n:013d}", "1", 0, 1) for n in (1, 3)]
    for missing, fits in ((2, True), (3, False)):
        profile = spark.createDataFrame(held + [(2, i, None, "1", 0, 1) for i in range(missing)], schema)
        ids = upsert.creation_ids(profile).select("NEW_ID")
        if fits:
            assert sorted(r.NEW_ID for r in ids.collect()) == ["CUS0000000000002", "CUS0000000000004"]
        else:
            with pytest.raises(Exception, match="13 digits"):
                ids.collect()


def test_exists_flag_keeps_null_keys(spark):
    from profilebook.operators.lookups import exists_flag
    fact = spark.createDataFrame([(1, "a"), (2, None), (3, "z")], "id int, k string")
    dim = spark.createDataFrame([("a",), (None,)], "d string")
    assert sorted((r.id, r.e) for r in exists_flag(fact, dim, "k", "d", "e").collect()) == [(1, "1"), (2, "0"), (3, "0")]


def test_assign_keys_dense_and_ordered(spark):
    df = spark.range(0, 1000).select(((F.col("id") * 7919) % 1000).alias("k")).repartition(7)
    out = assign_keys(df, ["k"], F.lit(100).cast("long"), "n", partitions=5).collect()
    assert sorted((r.k, r.n) for r in out) == [(k, 101 + k) for k in range(1000)]


def test_rank_within_matches_row_number(spark):
    rows = [(g, (g * 31 + i * 17) % 23) for g in range(5) for i in range(40 if g == 0 else 3)]
    df = spark.createDataFrame(rows, "g int, o int")
    got = sorted((r.g, r.o, r.RN) for r in rank_within(df, ["g"], ["o"]).collect())
    w = Window.partitionBy("g").orderBy("o")
    exp = sorted((r.g, r.o, r.rn) for r in df.withColumn("rn", F.row_number().over(w)).collect())
    assert [(g, o) for g, o, _ in got] == [(g, o) for g, o, _ in exp]
    # positions within equal (g, o) may swap; the multiset of ranks per value matches
    assert sorted(got) == sorted(exp)


def test_not_in_null_rules(spark):
    df = spark.createDataFrame([(1,), (2,), (None,)], "x int")
    lst = spark.createDataFrame([(2,)], "y int")
    assert sorted(r.x for r in not_in(df, "x", lst, "y").collect()) == [1]
    with_null = spark.createDataFrame([(2,), (None,)], "y int")
    assert not_in(df, "x", with_null, "y").count() == 0
    empty = spark.createDataFrame([], "y int")
    assert not_in(df, "x", empty, "y").count() == 3


def test_latest_per_key_ignores_late_and_repeats(spark):
    rows = [("a", 2, 1, "new"), ("a", 1, 2, "late"), ("a", 2, 1, "new"), ("b", 5, 9, "only")]
    df = spark.createDataFrame(rows, "k string, ts int, id int, v string")
    out = {r.k: r.v for r in latest_per_key(df, ["k"], ["ts", "id"], ["v"]).collect()}
    assert out == {"a": "new", "b": "only"}
