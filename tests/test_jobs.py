"""Job-level properties on the smallest driver tables."""

from pyspark.sql import functions as F

from profilebook.plans import search, upsert
from profilebook.registry.queries import AS_OF


def test_search_keeps_row_count(cat):
    p = cat.profile().filter(F.col("LMT_CUSTOMER_TYPE") != "G")
    assert search.search_profiles(cat, ordered=False).count() == p.count()


def test_upsert_twice_equals_once(cat):
    as_of = F.lit(AS_OF).cast("timestamp_ntz")
    changes = cat.table("wf_profile_changes")
    once = upsert.upsert_profiles(cat.profile(), changes, cat.master(), as_of)
    snap1 = once.snapshot
    twice = upsert.upsert_profiles(snap1, changes, cat.master(), as_of)
    keys = ["ID_SOLICITUD", "CUSTOMER_NO"]
    a = once.snapshot.select(*keys, "CUSTOMER_NAME1", "SHORT_NAME", "LIAB_ID")
    b = twice.snapshot.select(*keys, "CUSTOMER_NAME1", "SHORT_NAME", "LIAB_ID")
    # the second pass updates the rows the first one inserted (matched by core id)
    assert a.count() == b.count()
    assert a.exceptAll(b).count() == 0


def test_status_update_idempotent(cat):
    events = cat.table("wf_status_events")
    snap, touched = upsert.record_status(cat.profile(), events)
    snap2, touched2 = upsert.record_status(snap, events.unionByName(events))
    cols = ["ID_SOLICITUD", "CUSTOMER_NO", "ID_STATUS_FCC", "MSG_ERROR_FCC"]
    assert touched.select(*cols).exceptAll(touched2.select(*cols)).count() == 0


def test_action_dispatcher_covers_all_codes(cat):
    from profilebook.plans.actions import ACTIONS, run_action
    assert sorted(ACTIONS, key=int) == [str(i) for i in range(1, 18)]
    assert set(run_action(cat, "2").columns) == {"ID_SOLICITUD", "RESULTADO"}
    assert run_action(cat, 9).columns == ["FIELD_NAME"]
