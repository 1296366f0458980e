"""Jobs that write tables: run again, lost in the middle, untouched buckets, schema changes."""

from __future__ import annotations

import uuid

import pytest
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from profilebook.plans.refresh import refresh
from profilebook.plans.upsert import upsert_profiles
from profilebook.plans.writes import ProfileTables
from profilebook.registry.queries import AS_OF
from profilebook.sources.snapshots import AppendLog, Snapshot


def same(a, b):
    return a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def folder(cat):
    return f"{cat.land_dir}/test-{uuid.uuid4().hex[:8]}"


@pytest.fixture(scope="module")
def as_of():
    return F.lit(AS_OF).cast("timestamp_ntz")


def test_refresh_lost_in_the_middle_and_run_again(cat, as_of, monkeypatch):
    requests = cat.table("wf_refresh_request")
    want = refresh(cat, requests, as_of)
    t = ProfileTables(cat, folder(cat), buckets=4)
    merge = t.profile.merge

    def lost(*_):
        raise RuntimeError("lost before the profile")

    monkeypatch.setattr(t.profile, "merge", lost)
    with pytest.raises(RuntimeError):
        t.refresh(requests, as_of, "r1")
    assert same(t.profile.read(), cat.profile())
    monkeypatch.setattr(t.profile, "merge", merge)
    assert t.refresh(requests, as_of, "r1") and not t.refresh(requests, as_of, "r1")
    assert same(t.audit.read(), want.audit)
    assert same(t.values.read(), cat.table("wf_multi_values").unionByName(want.children))
    kept = cat.profile().join(requests, "ID_SOLICITUD", "left_anti")
    assert same(t.profile.read(), kept.unionByName(want.snapshot_apps.drop("MODE")))


def test_upsert_run_again_and_a_second_run(cat, as_of):
    changes = cat.table("wf_profile_changes")
    t = ProfileTables(cat, folder(cat), buckets=4)
    assert t.upsert(changes, as_of, "u1") and not t.upsert(changes, as_of, "u1")
    once = upsert_profiles(cat.profile(), changes, cat.master(), as_of)
    keys = ["ID_SOLICITUD", "CUSTOMER_NO", "CUSTOMER_NO_FCC", "CUSTOMER_NAME1", "SHORT_NAME"]
    assert same(t.profile.read().select(keys), once.snapshot.select(keys))
    n = t.results.read().count()
    few = changes.filter("REQ_ID < 100")
    assert t.upsert(few, as_of, "u2") and t.results.read().count() == n + few.count()


SCHEMA = StructType().add("k", "long").add("v", "string")


def test_buckets_that_are_not_touched_keep_their_files(spark, cat):
    s = Snapshot(spark, folder(cat), SCHEMA, ["k"], buckets=8)
    rows = spark.range(200).selectExpr("id AS k", "'a' AS v")
    assert s.read().count() == 0 and s.overwrite(rows, "start") and not s.overwrite(rows, "start")
    files = {b: p for b, p in s.current().items()}
    one = spark.createDataFrame([(17,)], "k long")
    touched = s.merge(one, lambda cur: cur.withColumn("v", F.when(F.col("k") == 17, "b").otherwise(F.col("v"))), "c1")
    assert len(touched) == 1 and s.merge(one, lambda cur: cur.filter("false"), "c1") is None
    assert {b for b, p in s.current().items() if files[b] != p} == set(touched)
    assert sorted(map(tuple, s.read().filter("v = 'b'").collect())) == [(17, "b")] and s.read().count() == 200
    gone = s.merge(one, lambda cur: cur.filter("false"), "c2")
    assert s.read(gone).count() == 0 and s.read().join(one, "k").count() == 0 and 0 < s.read().count() < 200
    with pytest.raises(ValueError):
        s.overwrite(rows, "c3", touched)
    again = Snapshot(spark, s.root, SCHEMA, ["k"], buckets=8)
    assert same(again.read(), s.read())


def test_null_keys_empty_tables_and_lost_attempts(spark, cat):
    s = Snapshot(spark, folder(cat), SCHEMA, ["k"], buckets=4)
    s.overwrite(spark.createDataFrame([(None, "n"), (None, "m"), (1, None)], SCHEMA), "start")
    assert s.read().count() == 3 and len(s.buckets_of(spark.createDataFrame([(None,)], "k long"))) == 1
    e = Snapshot(spark, folder(cat), SCHEMA, ["k"], buckets=4)
    assert e.overwrite(spark.createDataFrame([], SCHEMA), "start") and e.read().count() == 0
    log = AppendLog(spark, folder(cat), SCHEMA)
    # an attempt that wrote its rows and was lost before its commit
    spark.createDataFrame([(9, "lost")], SCHEMA).write.parquet(f"{log.data}/commit_seq=0")
    assert log.read().count() == 0
    assert log.append(spark.createDataFrame([(1, "a")], SCHEMA), "one") and not log.append(spark.createDataFrame([(1, "a")], SCHEMA), "one")
    assert [tuple(r) for r in log.read().collect()] == [(1, "a")]
    assert log.append(spark.createDataFrame([], SCHEMA), "two") and log.read(without="one").count() == 0


def test_columns_added_between_commits_are_null_in_older_files(spark, cat):
    root = folder(cat)
    old = Snapshot(spark, root, SCHEMA, ["k"], buckets=4)
    old.overwrite(spark.range(40).selectExpr("id AS k", "'a' AS v"), "start")
    new = Snapshot(spark, root, StructType().add("k", "long").add("v", "string").add("extra", "integer"), ["k"], buckets=4)
    new.merge(spark.createDataFrame([(3,)], "k long"), lambda cur: cur.withColumn("extra", F.lit(1)), "c1")
    got = new.read()
    assert got.count() == 40 and 0 < got.filter("extra = 1").count() < 40 and got.filter("extra IS NULL").count() > 0


def test_wide_snapshots_are_written_without_a_shuffle(spark, cat, monkeypatch):
    """The tasks that have the rows write them, each row once, whatever the number of files a task may keep open."""
    rows = spark.range(0, 300, 1, 3).selectExpr("id AS k", "concat('v', id % 7) AS v").unionByName(
        spark.createDataFrame([(None, "n"), (5, "twice")], SCHEMA))
    hinted = []
    hint = DataFrame.hint
    monkeypatch.setattr(type(rows), "hint", lambda self, *a: hinted.append(a) or hint(self, *a))
    for buckets in (4, 100):
        s = Snapshot(spark, folder(cat), SCHEMA, ["k"], buckets=buckets, wide=True)
        assert s.overwrite(rows, "start") and not hinted
        assert same(s.read(), rows)
        in_bucket = s.read().groupBy(F.input_file_name().alias("f")).agg(F.countDistinct(F.pmod(F.xxhash64(
            F.col("k").cast("string")), F.lit(buckets))).alias("n"))
        assert in_bucket.filter("n > 1").isEmpty()
        touched = s.merge(spark.createDataFrame([(5,)], "k long"), lambda cur: cur.filter("k IS NULL OR k <> 5"), "c1")
        assert len(touched) == 1 and same(s.read(), rows.filter("k IS NULL OR k <> 5"))


def test_refresh_meets_carried_values_before_rows_are_wide(cat, as_of):
    """The carried values join kept rows as the landed profile stores them, and candidates before their customer's star."""
    r = refresh(cat, cat.table("wf_refresh_request"), as_of)
    plan = r.snapshot_apps._jdf.queryExecution().optimizedPlan()
    widths = []

    def visit(node):
        if node.nodeName() == "Join" and all(k in node.condition().toString() for k in ("__p_app", "__p_core")) and "LeftOuter" in node.joinType().toString():
            widths.append(node.left().output().size())
        for i in range(node.children().size()):
            visit(node.children().apply(i))

    visit(plan)
    assert len(widths) == 2 and max(widths) < len(cat.profile().columns) / 2
