"""Landed tables: the narrow profile computes what its SQL says, files grow with the input, no request fills one file."""

import re
import time

from pyspark.sql import functions as F

from profilebook.functions.nulls import normalise_empty
from profilebook.sources import catalog, standins
from profilebook.session import DROP_SHUFFLES, landed
from profilebook.sources.catalog import Catalog

TABLES = {
    "region": ("r_regionkey int, r_name string", [(0, "AFRICA"), (1, "")]),
    "nation": ("n_nationkey int, n_name string, n_regionkey int", [(0, "ALGERIA", 0), (1, "ARGENTINA", 1), (2, "BRAZIL", None), (3, "CHINA", 1)]),
    "customer": ("c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
                 [(1, "Customer#1", 0, 6000.0, "BUILDING"), (2, None, 1, -5.0, None), (2, "Customer#2", 1, None, "MACHINERY"),
                  (3, "Customer#3", None, 1.0, "FURNITURE"), (4, "", 3, 9000.0, "AUTOMOBILE"), (None, "x", 0, 1.0, "BUILDING")]),
    "supplier": ("s_suppkey long, s_name string, s_nationkey int, s_acctbal double",
                 [(7, "Supplier#7", 0, 1.5), (8, None, 1, None), (8, "Supplier#8", 3, 2.5), (9, "Supplier#9", 2, 0.0)]),
    "part": ("p_partkey long, p_type string", [(1, "PROMO"), (2, "SMALL")]),
    "orders": ("o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz, o_orderpriority string",
               [(1, 1, "O", 200000.0, None, "1-URGENT"), (2, 2, "F", None, None, "5-LOW"), (2, 2, "F", 10.5, None, "1-URGENT"),
                (3, 3, "P", 1.0, None, "1-URGENT"), (4, 4, None, 7.0, None, None), (5, None, "F", 1.0, None, "2-HIGH"), (8, 4, "P", 3.0, None, "5-LOW")]),
    "lineitem": ("l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_returnflag string, "
                 "l_linestatus string, l_shipdate timestamp_ntz",
                 [(1, 1, 7, 1, 1.0, "R", "F", None), (1, 2, 7, 2, 2.0, "A", "F", None), (2, 1, 8, 1, 1.0, None, "O", None), (3, 1, 9, 1, 1.0, "N", "O", None),
                  (3, 2, None, 2, 1.0, "N", "O", None), (4, 25, 7, 1, 1.0, "N", None, None), (9, 1, 7, 1, 1.0, "N", "F", None), (None, 1, 7, 1, 1.0, "R", "F", None)]),
    "events": ("event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string", [(1, None, 1, "view", 1.0, "{}")]),
}


def _data(spark, path, **more):
    for name, (schema, rows) in TABLES.items():
        df = spark.createDataFrame(more.get(name, rows), schema)
        dated = {c: F.lit("1996-03-05 10:00:00").cast("timestamp_ntz") for c, t in df.dtypes if t == "timestamp_ntz"}
        df.withColumns(dated).write.parquet(f"{path}/{name}.parquet")
    return str(path)


def _rows(df):
    return sorted(map(repr, df.collect()))


def _by_sql(cat):
    frames = {d: cat.base(d) for d in standins.dependencies("wf_customer_info")}
    return normalise_empty(cat.spark.sql(standins.spark_text("wf_customer_info"), **frames))


def test_narrow_profile_equals_its_sql(spark, tmp_path, monkeypatch):
    data = _data(spark, tmp_path)
    expected = _by_sql(Catalog(spark, data, land=False))
    assert expected.count() > 10
    for few in (catalog.MAX_SUPPLIERS, 0):   # suppliers broadcast after the shuffle, or joined before it
        monkeypatch.setattr(catalog, "MAX_SUPPLIERS", few)
        got = Catalog(spark, data).profile()
        assert [(f.name, f.dataType) for f in got.schema] == [(f.name, f.dataType) for f in expected.schema]
        assert _rows(got) == _rows(expected)


def test_profile_lands_its_sources_only(spark, tmp_path):
    cat = Catalog(spark, _data(spark, tmp_path))
    cat.profile()
    landed = spark.read.parquet(f"{cat.land_dir}/wf_customer_info").columns
    assert set(landed) == {*standins.PROFILE_KEY, "__part", *[c for names in standins.PROFILE_SOURCES for c in names]}


def test_profile_needs_no_shuffle_by_its_key(spark, cat):
    plan = cat.profile().groupBy(*standins.PROFILE_KEY).agg(F.count(F.lit(1)))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


def test_files_grow_with_the_input(spark, tmp_path, monkeypatch):
    cat = Catalog(spark, _data(spark, tmp_path))
    least = spark.sparkContext.defaultParallelism * 2
    assert cat._files("wf_customer_info") == least
    lines = len(TABLES["lineitem"][1])
    monkeypatch.setattr(catalog, "ROWS_PER_FILE", 0.25)
    assert cat._files("wf_customer_info") == cat._files("wf_directors") == max(least, lines * 4)
    assert cat._files("fcc_customer") == cat._files("cif_fields") == max(least, len(TABLES["customer"][1]) * 4)


def test_busy_application_fills_several_files(spark, tmp_path):
    orders = [(k, 1, "O", 1.0, None, "1-URGENT") for k in range(1, 41)]
    lines = [(k, 25, 7, n, 1.0, "N", "F", None) for k in range(1, 41) for n in range(1, 6)]
    cat = Catalog(spark, _data(spark, tmp_path, orders=orders, lineitem=lines))
    hot = cat.table("wf_profile_changes").filter(F.col("IN_ID_SOLICITUD") == standins.HOT_APPLICATION)
    per_file = [r["count"] for r in hot.groupBy(F.input_file_name()).count().collect()]
    assert sum(per_file) >= 200
    assert len(per_file) > 1 and max(per_file) < 150


def _shuffle_files(spark) -> int:
    return spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString(" ").count("shuffle_")


def _settles_at(spark, files: int) -> bool:
    """Whether the shuffle files go down to ``files``: Spark removes them in the background."""
    for _ in range(40):
        if _shuffle_files(spark) <= files:
            return True
        time.sleep(0.25)
    return False


def test_landing_leaves_no_shuffle_files(spark, tmp_path):
    cat = Catalog(spark, _data(spark, tmp_path))
    cat._files("wf_directors")
    before = _shuffle_files(spark)
    assert cat.table("wf_directors").select("NAME").collect()
    spread = landed(spark.range(100).repartition(5, "id"), "some")
    assert len(spread.collect()) == 100
    assert spark.conf.get(DROP_SHUFFLES) == "false"
    assert _settles_at(spark, before)


def _written(cat, monkeypatch) -> list:
    parts = []
    bucketed = Catalog._bucketed
    monkeypatch.setattr(Catalog, "_bucketed", lambda self, name, *dfs: parts.extend(dfs) or bucketed(self, name, *dfs))
    return parts


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_lines_are_grouped_where_they_are_dealt(spark, tmp_path, monkeypatch):
    cat = Catalog(spark, _data(spark, tmp_path))
    parts = _written(cat, monkeypatch)
    cat.profile()
    assert len(parts) == 2   # written one after the other
    assert not re.search(r"hashpartitioning\(l_orderkey#\d+L?, l_suppkey", _plan(parts[0]))
    assert "hashpartitioning(ID_SOLICITUD" in _plan(parts[0])


def test_copies_of_an_order_keep_their_related_parties(spark, tmp_path):
    orders = [(1, 1, "O", 1.0, None, "5-LOW")] * 3 + [(1, 2, "O", 1.0, None, "5-LOW")]
    lines = [(1, 1, 7, n, 1.0, f, "F", None) for n, f in ((1, "A"), (2, "R"), (3, "N"))]
    data = _data(spark, tmp_path, orders=orders, lineitem=lines)
    got = Catalog(spark, data).profile().filter("RELACIONADO = '1'")
    assert _rows(got) == _rows(_by_sql(Catalog(spark, data, land=False)).filter("RELACIONADO = '1'"))
    assert got.count() == 5   # three copies with customer 1, one with each of the two customers 2


def test_submissions_are_dealt_as_their_sources(spark, tmp_path, monkeypatch):
    cat = Catalog(spark, _data(spark, tmp_path))
    parts = _written(cat, monkeypatch)
    got = cat.table("wf_profile_changes")
    below = parts[0]._jdf.queryExecution().optimizedPlan().toString().split("RepartitionByExpression", 1)[1]
    assert "IN_FULLNAME" not in below and "holding" not in below
    plain = Catalog(spark, cat.data_dir, land=False).table("wf_profile_changes")
    assert got.dtypes == plain.dtypes and got.count() > 5 and _rows(got) == _rows(plain)


def test_submissions_land_their_sources_only(spark, tmp_path):
    cat = Catalog(spark, _data(spark, tmp_path))
    changes = cat.table("wf_profile_changes")
    landed = spark.read.parquet(f"{cat.land_dir}/wf_profile_changes").columns
    assert "REQ_ID" in landed and len(landed) < len(changes.columns) and not [c for c in landed if c.startswith("IN_")]
    plan = _plan(changes.groupBy("REQ_ID").agg(F.count(F.lit(1))))
    assert "Exchange" not in plan


def test_related_parties_of_a_large_input_land_in_passes(spark, tmp_path, monkeypatch):
    data = _data(spark, tmp_path)
    expected = _by_sql(Catalog(spark, data, land=False))
    monkeypatch.setattr(catalog, "FILES_AT_ONCE", 1)
    for few in (catalog.MAX_SUPPLIERS, 0):
        monkeypatch.setattr(catalog, "MAX_SUPPLIERS", few)
        cat = Catalog(spark, data)
        with monkeypatch.context() as m:
            parts = _written(cat, m)
            got = cat.profile()
        assert len(parts) == catalog.LINE_PASSES + 1
        assert sum(p.count() for p in parts[:-1]) == expected.filter("RELACIONADO = '1'").count()
        assert _rows(got) == _rows(expected)
