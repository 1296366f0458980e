"""Batch = stream for the status write-back and the completeness counts."""

import uuid

import pytest
from pyspark.sql import functions as F

from profilebook.plans import upsert
from profilebook.plans.creation import at_completion_stage
from profilebook.streaming.delivery import deliver
from profilebook.streaming.status import KEPT, SET, StatusStream, completeness


def same(a, b):
    return a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def base(cat):
    return f"{cat.land_dir}/test-stream-{uuid.uuid4().hex[:8]}"


@pytest.fixture(scope="module")
def expected(cat):
    snapshot, touched = upsert.record_status(cat.profile(), cat.table("wf_status_events"))
    return snapshot, touched


@pytest.mark.parametrize("parts, files", [(3, 1), (4, 2)])
def test_stream_equals_batch(cat, expected, parts, files):
    events, out = cat.table("wf_status_events"), base(cat)
    # ids that no profile row carries stay out
    more = events.unionByName(events.limit(5).withColumn("ID_CUSTOMER_FCC", F.concat(F.lit("NO"), "ID_CUSTOMER_FCC")).withColumn(
        "EVENT_ID", -F.col("EVENT_ID")))
    deliver(more, f"{out}/source", "EVENT_ID", parts=parts, resend=2)
    s = StatusStream(cat.spark, cat.profile(), at_completion_stage(cat), out)
    s.run(f"{out}/source", events.schema, files)
    snapshot, touched = expected
    assert same(s.touched(), touched.select(*KEPT, *SET))
    assert same(s.profile(), snapshot)
    assert same(s.counts(), completeness(snapshot, at_completion_stage(cat)))


def test_restart_goes_on_from_the_last_batch(cat, expected):
    events, out = cat.table("wf_status_events"), base(cat)
    early = events.filter(F.col("EVENT_ID") % 2 == 0)
    deliver(early, f"{out}/source", "EVENT_ID", parts=1, resend=0)
    StatusStream(cat.spark, cat.profile(), at_completion_stage(cat), out).run(f"{out}/source", events.schema)
    deliver(events.filter(F.col("EVENT_ID") % 2 == 1), f"{out}/source", "EVENT_ID", parts=1, resend=0)
    s = StatusStream(cat.spark, cat.profile(), at_completion_stage(cat), out)
    s.run(f"{out}/source", events.schema)
    assert same(s.touched(), expected[1].select(*KEPT, *SET))
    assert same(s.counts(), completeness(expected[0], at_completion_stage(cat)))


def test_a_batch_run_again_counts_once(cat, expected):
    events, out = cat.table("wf_status_events"), base(cat)
    s = StatusStream(cat.spark, cat.profile(), at_completion_stage(cat), out)
    first, second = events.filter(F.col("EVENT_ID") % 2 == 0), events.filter(F.col("EVENT_ID") % 2 == 1)
    recount = s._recount

    def lost(epoch, touched):
        raise RuntimeError("lost between the two merges")

    s._recount = lost
    with pytest.raises(RuntimeError):
        s.apply(first, 0)
    s._recount = recount
    for epoch, batch in ((0, first), (0, first), (1, second), (1, second)):
        s.apply(batch, epoch)
    assert same(s.touched(), expected[1].select(*KEPT, *SET))
    assert same(s.counts(), completeness(expected[0], at_completion_stage(cat)))


def test_an_older_event_never_wins_and_untouched_buckets_keep_their_files(cat):
    out = base(cat)
    s = StatusStream(cat.spark, cat.profile(), at_completion_stage(cat), out, buckets=32)
    events = cat.table("wf_status_events").join(cat.profile().select("ID_CUSTOMER_FCC").distinct(), "ID_CUSTOMER_FCC", "left_semi")
    one = events.orderBy(F.desc("EVENT_TS")).limit(1).select(events.columns)
    s.apply(one, 0)
    before = s.snapshot.current()
    want = s.touched().collect()
    s.apply(one.withColumn("EVENT_TS", F.expr("EVENT_TS - INTERVAL 1 DAY")).withColumn("ID_STATUS_FCC", F.lit(0)), 1)
    assert s.touched().collect() == want and want
    after = s.snapshot.current()
    assert {b for b in after if after[b] != before[b]} == set(s.snapshot.buckets_of(one))
    assert len(after) > 1
