"""Registered queries: name -> callable(spark, data_dir) -> DataFrame."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from profilebook.plans import catalog as catplan
from profilebook.plans import basics, checks, columns, creation, export, master, refresh, search, upsert
from profilebook.plans.writes import ProfileTables
from profilebook.sources.catalog import Catalog
from pyspark.sql import functions as F

AS_OF = "2024-02-01 00:00:00"   # fixed run time of the registered change jobs

_catalogs: dict[tuple[str, str], Catalog] = {}


def catalog(spark: SparkSession, data_dir: str) -> Catalog:
    key = (spark.sparkContext.applicationId, data_dir)
    if key not in _catalogs:
        _catalogs[key] = Catalog(spark, data_dir)
    return _catalogs[key]


def _q(fn) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, data_dir: str) -> DataFrame:
        return fn(catalog(spark, data_dir))
    run.__doc__ = fn.__doc__
    return run


REGISTRY: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "profile_search_all": _q(lambda c: search.search_profiles(c)),
    "profile_search_by_app": _q(lambda c: search.search_profiles(c, application=4711)),
    "profile_search_by_core": _q(lambda c: search.search_profiles(c, core_id="C00000007")),
    "profile_search_by_customer": _q(lambda c: search.search_profiles(c, customer_no=47110000000)),
    "search_recent": _q(lambda c: search.search_recent(c)),
    # catalogue, risk and expiry
    "risk_list": _q(lambda c: catplan.risk_list(c)),
    "mode_update": _q(lambda c: catplan.apply_risk_updates(c.profile(), c.table("wf_risk_request")).select(
        "ID_SOLICITUD", "CUSTOMER_NO", "PROJECT_FINANCE", "PROBABILITY_DEFAULT", "LOSS_GIVEN_DEFAULT")),
    "affected_rows": _q(lambda c: catplan.affected_rows(c.profile(), c.table("wf_risk_request"))),
    "month_catalog": _q(lambda c: columns.month_names(c)),
    "month_catalog_filter": _q(lambda c: columns.month_names(c, "MA")),
    "expiry_date": _q(lambda c: catplan.expiry_dates(c)),
    # column-function reports
    "text_ops": _q(columns.text_ops),
    "split_rating": _q(columns.split_rating),
    "truncate_default": _q(columns.truncate_default),
    "pad_month": _q(columns.pad_month),
    "date_formats": _q(columns.date_formats),
    "date_parse": _q(columns.date_parse),
    "date_parts": _q(columns.date_parts),
    "add_months_sticky": _q(columns.add_months_sticky),
    "flag_codings": _q(columns.flag_codings),
    "type_derivation": _q(columns.type_derivation),
    "agency_derivation": _q(columns.agency_derivation),
    "aml_effective": _q(columns.aml_effective),
    "bank_type_codes": _q(columns.bank_type_codes),
    "relation_by_purpose": _q(columns.relation_by_purpose),
    "main_reference": _q(columns.main_reference),
    # creation manager checks (D8, D13-D16, D18, D24; A1-A7, J16, J17, U1)
    "flag_zero_when_any": _q(creation.any_creation_error),
    "flag_one_when_any": _q(creation.any_pending_creation),
    "count_correlated": _q(creation.completion_check),
    "counts_expected_actual": _q(creation.approval_check),
    "group_approval_list": _q(creation.group_approval_list),
    "existing_auth_check": _q(creation.existing_authorisation_check),
    "union_distinct": _q(creation.created_parties),
    "notice_text": _q(creation.notice_text),
    # core-banking master views (D17, D19-D23, D25; J24, J9-J12)
    "field_catalogue": _q(master.field_catalogue),
    "master_profile": _q(master.master_profile),
    "master_profile_any": _q(master.master_profile_any),
    "profile_diff": _q(master.change_comparison_set),
    "directors_sorted": _q(master.directors_sorted),
    "master_directors": _q(master.master_directors),
    "shareholder_list": _q(master.shareholder_list),
    # table changes
    "upsert_profiles": _q(lambda c: _upsert(c).results),
    "upsert_null_preserving": _q(lambda c: _upsert(c).touched),
    "either_key_match": _q(lambda c: _upsert(c).matches),
    "exists_flag": _q(lambda c: upsert.existence(upsert.with_parameter_defaults(c.table("wf_profile_changes")),
                                                 c.master()).select("REQ_ID", "IN_CUSTOMER_NO_FCC",
                                                                    F.col("__exists").alias("ID_EXISTE_FCC"))),
    "assign_keys": _q(lambda c: _upsert(c).inserted),
    "parameter_defaults": _q(lambda c: upsert.with_parameter_defaults(c.table("wf_profile_changes")).select(
        "REQ_ID", *sorted(upsert.PARAMETER_DEFAULTS))),
    "propagate_name": _q(lambda c: upsert.propagate_names(c.table("wf_lmt_customer"),
                                                          upsert.with_parameter_defaults(c.table("wf_profile_changes")),
                                                          _upsert(c).matches)),
    "status_update": _q(lambda c: upsert.record_status(c.profile(), c.table("wf_status_events"))[1].select(*_STATUS)),
    "copy_main_to_group": _q(lambda c: upsert.copy_main_to_group(c, c.profile()).filter(
        F.col("LMT_CUSTOMER_TYPE") == "G").select("ID_SOLICITUD", "CUSTOMER_NO", "CUSTOMER_TYPE", "CUSTOMER_CATEGORY",
                                                  "INDUSTRY", "FECHA_KYC")),
    "fill_missing_ids": _q(lambda c: upsert.fill_missing_ids(c.profile(), passes=1).select(
        "ID_SOLICITUD", "CUSTOMER_NO", "ID_CUSTOMER_FCC")),
    "reissue_failed_ids": _q(lambda c: upsert.fill_missing_ids(c.profile(), passes=2).select(
        "ID_SOLICITUD", "CUSTOMER_NO", "ID_CUSTOMER_FCC")),
    # application refresh (D27, D32-D34, D44; M9-M13, J20-J22, J25, A9, A11, S5-S7)
    "group_expand": _q(lambda c: _refresh(c).expansion.filter(F.col("MODE") == "G").select(*_CAND)),
    "one_expand": _q(lambda c: _refresh(c).expansion.filter(F.col("MODE") == "S").select(*_CAND)),
    "previous_row": _q(lambda c: _refresh(c).previous.select("ID_SOLICITUD", "CORE_ID", "NEW_NO", "PREV_SOLICITUD",
                                                            "PREV_CUSTOMER_NO")),
    "latest_application": _q(lambda c: search.latest_application(c).select("CUSTOMER_NO_FCC", "ID_SOLICITUD",
                                                                          "CUSTOMER_NO", "FECHA")),
    "refresh_single": _q(lambda c: _refresh(c).rows.filter(F.col("REFRESH_MODE") == "S")),
    "refresh_group": _q(lambda c: _refresh(c).rows.filter(F.col("REFRESH_MODE") == "G")),
    "carry_forward": _q(lambda c: _carried(c)),
    "slice_delete": _q(lambda c: _refresh(c).slice),
    "child_copy_recode": _q(lambda c: _refresh(c).children),
    "values_to_text": _q(lambda c: _refresh(c).rows.join(
        _refresh(c).previous.select(F.col("ID_SOLICITUD").alias("__a"), F.col("CORE_ID").alias("__c")),
        (F.col("ID_SOLICITUD") == F.col("__a")) & (F.col("CUSTOMER_NO_FCC") == F.col("__c")), "left_semi").select(
        "ID_SOLICITUD", "CUSTOMER_NO", "COUNTRIES_WHERE_OFFERS")),
    "append_rows": _q(lambda c: _refresh(c).snapshot_apps.select("ID_SOLICITUD", "CUSTOMER_NO", "CUSTOMER_NO_FCC", "MODE")),
    # tables written by the jobs, each run twice under one name, read back
    "audit_rows": _q(lambda c: _refreshed_tables(c).audit.read()),
    "slice_overwrite": _q(lambda c: _refreshed_tables(c).profile.read().select(*_WRITTEN)),
    "append_children": _q(lambda c: _refreshed_tables(c).values.read()),
    "upsert_written": _q(lambda c: _upserted_tables(c).profile.read().select(*_WRITTEN)),
    "append_results": _q(lambda c: _upserted_tables(c).results.read()),
    "conditional_child_address": _q(refresh.master_addresses),
    # generic operators
    "project_rename": _q(basics.project_rename),
    "constant_null_columns": _q(basics.constant_null_columns),
    "filter_equality": _q(basics.filter_equality),
    "filter_not_equal": _q(basics.filter_not_equal),
    "filter_ne_or_null": _q(basics.filter_ne_or_null),
    "filter_null_default": _q(basics.filter_null_default),
    "filter_in_list": _q(basics.filter_in_list),
    "filter_like": _q(basics.filter_like),
    "filter_null_tests": _q(basics.filter_null_tests),
    "filter_sentinel_date": _q(basics.filter_sentinel_date),
    "filter_status_set": _q(basics.filter_status_set),
    "lookup_filtered_role": _q(basics.lookup_filtered_role),
    "lookup_prefix_key": _q(basics.lookup_prefix_key),
    "lookup_concat_key": _q(basics.lookup_concat_key),
    "lookup_trim_key": _q(basics.lookup_trim_key),
    "lookup_chain": _q(basics.lookup_chain),
    "lookup_prefer": _q(basics.lookup_prefer),
    "lookup_scalar": _q(basics.lookup_scalar),
    "lookup_fallback": _q(basics.lookup_fallback),
    "join_inner_multi": _q(basics.join_inner_multi),
    "join_inlist_stage": _q(basics.join_inlist_stage),
    "anti_not_in": _q(basics.anti_not_in),
    "anti_not_in_null": _q(basics.anti_not_in_null),
    "main_row_values": _q(basics.main_row_values),
    "distinct_groups": _q(basics.distinct_groups),
    "sort_main_first": _q(basics.sort_main_first),
    "first_of_many": _q(basics.first_of_many),
    "add_columns": _q(basics.add_columns),
    "param_broadcast": _q(columns.relation_by_purpose),
    "sort_multi": _q(master.directors_sorted),
    # rejects, changes and action codes
    "date_rejects": _q(checks.date_rejects),
    "date_checked": _q(checks.date_checked),
    "main_rejects": _q(lambda c: checks.main_rejects(_upsert(c).snapshot)),
    "lookup_scalar_rejects": _q(checks.several_field_records),
    "description_rejects": _q(checks.description_rejects),
    "profile_changes": _q(checks.profile_changes),
    "action_rows": _q(lambda c: checks.action_rows(c, F.lit(AS_OF).cast("timestamp_ntz"))),
    # streams (T1, T2)
    "stream_status": _q(lambda c: _stream(c).touched().select(*_STATUS)),
    "stream_completeness": _q(lambda c: _stream(c).counts()),
    # export record sets
    "export_customers": _q(lambda c: export.export_customers(c, F.lit(AS_OF).cast("timestamp_ntz"))),
    "export_groups": _q(lambda c: export.export_groups(c, F.lit(AS_OF).cast("timestamp_ntz"))),
    "directors_by_core": _q(lambda c: master.directors_sorted(c, core_id="C00000007")),
}

_STATUS = ["ID_SOLICITUD", "CUSTOMER_NO", "ID_CUSTOMER_FCC", "ID_STATUS_FCC", "MSG_ERROR_FCC", "FECHA_CREACION_CLIENTE",
           "INCEPTION_DATE"]
_WRITTEN = ["ID_SOLICITUD", "CUSTOMER_NO", "CUSTOMER_NO_FCC", "CUSTOMER_NAME1", "MAIN_CUSTOMER", "SHORT_NAME", "LIAB_ID",
            "COUNTRIES_WHERE_OFFERS", "FECHA_KYC"]
_CAND = ["ID_SOLICITUD", "CORE_ID", "LIABILITY_NO", "GROUP_CODE", "MAIN_ID", "NEW_NO"]


def _refresh(c: Catalog):
    return refresh.refresh(c, c.table("wf_refresh_request"), F.lit(AS_OF).cast("timestamp_ntz"))


def _carried(c: Catalog):
    from profilebook.plans import refresh_rules as R
    cols = sorted(set(dict(R.carry_rules(False))) | set(dict(R.carry_rules(True))))
    r = _refresh(c)
    keys = r.previous.select(F.col("ID_SOLICITUD").alias("__a"), F.col("CORE_ID").alias("__c"))
    return r.rows.join(keys, (F.col("ID_SOLICITUD") == F.col("__a")) & (F.col("CUSTOMER_NO_FCC") == F.col("__c")),
                       "left_semi").select("ID_SOLICITUD", "CUSTOMER_NO", *cols)


def _upsert(c: Catalog):
    return upsert.upsert_profiles(c.profile(), c.table("wf_profile_changes"), c.master(),
                                  F.lit(AS_OF).cast("timestamp_ntz"))



def _refreshed_tables(c: Catalog) -> ProfileTables:
    t = ProfileTables(c, f"{c.land_dir}/refreshed")
    for _ in range(2):
        t.refresh(c.table("wf_refresh_request"), F.lit(AS_OF).cast("timestamp_ntz"), "refresh 1")
    return t


def _upserted_tables(c: Catalog) -> ProfileTables:
    t = ProfileTables(c, f"{c.land_dir}/upserted")
    for _ in range(2):
        t.upsert(c.table("wf_profile_changes"), F.lit(AS_OF).cast("timestamp_ntz"), "upsert 1")
    return t


def _stream(c: Catalog):
    """Run T1 + T2 over the status events delivered as files (out of order, with re-sends)."""
    import uuid
    from profilebook.streaming.delivery import deliver
    from profilebook.streaming.status import StatusStream
    base = f"{c.land_dir}/stream-{uuid.uuid4().hex[:8]}"
    events = c.table("wf_status_events")
    deliver(events, f"{base}/source", "EVENT_ID")
    s = StatusStream(c.spark, c.profile(), creation.at_completion_stage(c), base)
    s.run(f"{base}/source", events.schema)
    return s
