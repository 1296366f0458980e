"""A subset of the registered queries against their DuckDB oracle (sf0.001)."""

import pytest

from conftest import SMALL_SF

import __spark_entry__ as entry_mod
from compare import digest, duck

NAMES = ["profile_search_all", "notice_text", "count_correlated", "expiry_date", "upsert_null_preserving",
         "refresh_group", "master_profile", "export_customers", "anti_not_in_null", "text_ops"]


@pytest.fixture(scope="module")
def con():
    return duck(SMALL_SF)


@pytest.mark.parametrize("name", NAMES)
def test_matches_oracle(spark, con, name):
    df = entry_mod.queries()[name](spark, SMALL_SF)
    srows = [tuple(r) for r in df.collect()]
    res = con.execute(entry_mod.oracle_sql()[name])
    dcols = [d[0] for d in res.description]
    drows = res.fetchall()
    assert sorted(df.columns) == sorted(dcols)
    assert len(srows) == len(drows)
    assert digest(df.columns, srows)[0] == digest(dcols, drows)[0]


def test_entry_runs(spark):
    df = entry_mod.entry(spark)
    assert len(df.columns) == 130
    assert df.count() >= 0
