"""Guards: none, one and several rows; date faults; column changes; every action code."""

import pytest
from pyspark.sql import functions as F

from profilebook.functions import dates
from profilebook.operators import guards
from profilebook.operators.guards import ROWS_FOUND, column_changes, date_fault, rejected, scalar_lookup, split_faults
from profilebook.plans import basics, checks
from profilebook.plans.actions import ACTIONS, run_action
from profilebook.plans.refresh import refresh
from profilebook.registry.queries import AS_OF
from profilebook.session import landed
from profilebook.sources import schema


@pytest.fixture(scope="module")
def frames(spark):
    fact = spark.createDataFrame([(1, "a"), (2, "b"), (3, "x"), (4, None)], "id long, k string")
    dim = spark.createDataFrame([("a", "one"), ("b", "two"), ("b", "three"), ("c", "u"), ("c", "v"), (None, "n")], "code string, name string")
    return fact, dim


def test_several_rows_raise_only_when_they_are_asked_for(frames):
    fact, dim = frames
    ok = scalar_lookup(fact.filter("id <> 2"), "k", dim, "code", {"name": "name"})
    assert sorted(map(tuple, ok.select("id", "name", ROWS_FOUND).collect())) == [(1, "one", 1), (3, None, 0), (4, None, 0)]
    with pytest.raises(Exception, match="2 rows of code b"):
        scalar_lookup(fact, "k", dim, "code", {"name": "name"}).collect()


def test_several_rows_are_handed_over_as_rejects(frames):
    fact, dim = frames
    looked = scalar_lookup(fact, "k", dim, "code", {"name": "name"}, "reject")
    assert sorted(map(tuple, looked.select("id", "name").collect())) == [(1, "one"), (2, None), (3, None), (4, None)]
    assert [r["id"] for r in rejected(looked, "k").collect()] == [2]
    assert sorted(r["id"] for r in rejected(looked, "k", none=True).collect()) == [2, 3]
    assert scalar_lookup(fact.filter("false"), "k", dim, "code", {"name": "name"}).collect() == []
    assert scalar_lookup(fact, "k", dim.filter("false"), "code", {"name": "name"}).filter(f"{ROWS_FOUND} > 0").isEmpty()


def test_dates_are_split_in_one_pass(spark):
    texts = ["01/02/2024", "1/2/2024", "31/02/2024", "2024-01-01", "x", None, "29/02/2023"]
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, t string")
    split = split_faults(rows, {"t": (F.col("t"), date_fault(F.col("t"), dates.parse_dmy(F.col("t")), checks.DMY))}, "dates")
    assert (split.read, split.rejected) == (7, 4)
    assert sorted(r["id"] for r in split.good.collect()) == [0, 1, 5]
    assert {(r["id"], r["REASON"], r["VALUE"]) for r in split.faults.collect()} == {
        (2, "CALENDAR", "31/02/2024"), (3, "FORMAT", "2024-01-01"), (4, "FORMAT", "x"), (6, "CALENDAR", "29/02/2023")}
    none = split_faults(rows.filter("false"), {"t": (F.col("t"), F.lit(None).cast("string"))}, "none")
    assert (none.read, none.rejected, none.good.count(), none.faults.count()) == (0, 0, 0, 0)


def test_faults_write_no_rows_and_parse_a_text_once(spark, monkeypatch):
    """The rows are written when the good ones or the counts are asked for, once; their faults need no more than their texts."""
    written = []
    monkeypatch.setattr(guards, "landed", lambda df, name: written.append(name) or landed(df, name))
    rows = spark.createDataFrame([(0, "1/2/2024", "x", "wide"), (1, "31/02/2024", None, "wide")], "id int, t string, u string, w string")
    split = split_faults(rows, {c: (F.col(c), date_fault(F.col(c), dates.parse_dmy(F.col(c)), checks.DMY)) for c in ("t", "u")}, "texts")
    found = split.faults.select("id", "COLUMN_NAME", "REASON")
    assert sorted(map(tuple, found.collect())) == [(0, "u", "FORMAT"), (1, "t", "CALENDAR")]
    assert found._jdf.queryExecution().executedPlan().toString().count("gettimestamp(") == 2
    assert written == []
    assert (split.read, split.rejected, split.good.count(), split.read) == (2, 2, 0, 2)
    assert written == ["texts"]


def test_column_changes_are_null_safe(spark):
    old = spark.createDataFrame([(1, "a", None, 3), (2, "a", "b", 3), (9, "z", "z", 0)], "k int, x string, `y 1` string, z int")
    new = spark.createDataFrame([("r", 1, "a", None, 4), ("s", 2, None, "B", 3), ("t", 3, "q", "q", 1)], "id string, core int, x2 string, y2 string, z2 int")
    got = column_changes(old, new, F.col("core") == F.col("__old_k"), ["id"], {"X": ("x", "x2"), "Y": ("y 1", "y2"), "Z": ("z", "z2")})
    assert sorted(map(tuple, got.collect())) == [("r", "Z", "3", "4"), ("s", "X", "a", None), ("s", "Y", "b", "B")]


def test_dropped_descriptions_are_those_a_refresh_drops(cat):
    """A country name without a code leaves no row among the copied multi-values."""
    bad = checks.description_rejects(cat).select("ID_SOLICITUD", "CUSTOMER_NO", "DESCRIPCION1").distinct()
    r = refresh(cat, cat.table("wf_refresh_request"), F.lit(AS_OF).cast("timestamp_ntz"))
    names = r.children.filter("ID_TIPO_CAMPO = 12").select("DESCRIPCION1").distinct()
    assert bad.count() > 0 and names.join(bad.select("DESCRIPCION1").distinct(), "DESCRIPCION1").count() == 0


@pytest.mark.parametrize("code", list(ACTIONS))
def test_every_action_code_runs(cat, code):
    out = run_action(cat, code, F.lit(AS_OF).cast("timestamp_ntz"))
    assert out.columns and out.limit(1).count() <= 1
    with pytest.raises(KeyError):
        run_action(cat, "18")


def test_a_table_keeps_its_old_files_when_columns_are_added(cat):
    rows = basics.add_columns(cat)
    assert set(schema.PROFILE_ADDED_COLUMNS) < set(rows.columns)
    even = rows.filter("ID_SOLICITUD % 2 = 0")
    assert even.count() > 0 and even.filter("PROJECT_FINANCE IS NOT NULL OR GROUP_EXPIRATION_MONTH IS NOT NULL").isEmpty()
    assert not rows.filter("ID_SOLICITUD % 2 = 1 AND GROUP_EXPIRATION_MONTH IS NOT NULL").isEmpty()
    assert not [t.name for t in cat.spark.catalog.listTables() if t.name.startswith("evolving_")]
