"""Request chains on busy applications against one call per request."""

from __future__ import annotations

import random
import time

import pytest
from pyspark.sql import functions as F

from profilebook.plans import upsert
from profilebook.plans.upsert import hits_in_order
from profilebook.session import landed

PROFILE = "ID_SOLICITUD long, CUSTOMER_NO long, CUSTOMER_NO_FCC string"
CHANGES = "REQ_ID long, IN_ID_SOLICITUD long, IN_CUSTOMER_NO long, IN_CUSTOMER_NO_FCC string"


def calls(rows, requests):
    """(REQ_ID, application, number, inserting request) of every hit, one call after the other."""
    state = [[app, no, fcc, None] for app, no, fcc in rows]
    out = []
    for req, app, no, fcc in sorted(requests):
        hit = [x for x in state if app is not None and x[0] == app and ((no is not None and x[1] == no) or (fcc is not None and x[2] == fcc))]
        out += [(req, app, x[1], x[3]) for x in hit]
        for x in hit:
            x[2] = fcc
        if not hit:
            state.append([app, None, fcc, req])
    return sorted(out, key=repr)


def got(spark, rows, requests):
    h = hits_in_order(spark.createDataFrame(rows, PROFILE), spark.createDataFrame(requests, CHANGES))
    return sorted((tuple(r) for r in h.select("REQ_ID", "ID_SOLICITUD", "CUSTOMER_NO", "__ins").collect()), key=repr)


@pytest.mark.parametrize("seed, n, apps", [(1, 400, 3), (2, 600, 1), (3, 250, 40), (4, 1, 1)])
def test_chains_match_one_call_per_request(spark, seed, n, apps):
    draw = random.Random(seed)
    core = [None, *"ABCDEF"]
    rows = [(a, 10 * a + k, draw.choice(core)) for a in range(apps) for k in range(3)]
    ids = draw.sample(range(10 * n), n)
    requests = [(i, draw.choice([None, *range(apps)]) if draw.random() < 0.1 else draw.randrange(apps),
                 None if draw.random() < 0.5 else 10 * draw.randrange(apps) + draw.randrange(4), draw.choice(core)) for i in ids]
    assert got(spark, rows, requests) == calls(rows, requests)


def test_no_request_and_no_row(spark):
    assert got(spark, [(1, 1, "A")], []) == []
    assert got(spark, [], [(1, 1, 1, "A"), (2, 1, 1, "A"), (3, None, 1, "A")]) == [(2, 1, None, 1)]


def test_a_hundred_thousand_requests_on_one_application(spark):
    """The row's core id changes at every second request, so pairing spans with requests by core id alone would make 2.5
    billion pairs."""
    n = 100_000
    changes = spark.range(n).selectExpr("id AS REQ_ID", "7L AS IN_ID_SOLICITUD", "if(id % 2 = 0, 70L, NULL) AS IN_CUSTOMER_NO",
                                        "if(id % 4 < 2, 'A', 'B') AS IN_CUSTOMER_NO_FCC")
    began = time.time()
    h = hits_in_order(spark.createDataFrame([(7, 70, "B"), (7, 71, "C")], PROFILE), changes)
    assert h.count() == h.filter("CUSTOMER_NO = 70 AND ID_SOLICITUD = 7 AND __ins IS NULL").select("REQ_ID").distinct().count() == n
    assert time.time() - began < 120


def test_spans_are_cut_into_their_blocks(spark):
    levels = upsert._levels(100)
    spans = [(a, b) for a in range(0, 40, 3) for b in range(a, 100, 7)]
    d = spark.createDataFrame(spans, "a long, b long")
    for r in d.select("a", "b", upsert._dyadic_parts(d.a, d.b, levels).alias("parts")).collect():
        cover = sorted(x for p in r["parts"] for x in range(p["block"] << p["level"], p["block"] + 1 << p["level"]))
        assert cover == list(range(r["a"], r["b"])) and len(r["parts"]) <= 2 * levels


def test_blocks_grow_with_the_requests_of_an_application(spark, monkeypatch):
    kept = {}
    monkeypatch.setattr(upsert, "landed", lambda df, name: kept.setdefault(name, landed(df, name)))
    requests = [(10 + i, i, None, "B") for i in range(64)] + [(5, 7, 70, "C"), (1, None, None, None)]
    h = hits_in_order(spark.createDataFrame([(i, i * 10, "B") for i in range(64)], PROFILE), spark.createDataFrame(requests, CHANGES))
    assert {(r.REQ_ID, r.CUSTOMER_NO) for r in h.collect()} == {(5, 70)} | {(10 + i, i * 10) for i in range(64) if i != 7}
    assert {(r.r_app, r.at, r.r_count) for r in kept["requests"].filter("r_app = 7 or r_app = 8").collect()} == {(7, 0, 2), (7, 1, 2), (8, 0, 1)}
    n = spark.range(1, 200).select("id", upsert._levels(F.col("id")).alias("l")).collect()
    assert all(r.l == upsert._levels(r.id) for r in n)


def test_numbers_of_inserted_rows_land_no_wide_rows(spark, cat, monkeypatch):
    names = []
    monkeypatch.setattr(upsert, "landed", lambda df, name: names.append(name) or landed(df, name))
    made = upsert.upsert_profiles(cat.profile(), cat.table("wf_profile_changes"), cat.master(), F.lit("2024-02-01").cast("timestamp_ntz"))
    assert made.inserted.count() and "touched" not in names
    assert made.touched.count() and made.snapshot.columns and names.count("touched") == 1
