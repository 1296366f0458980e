"""The generic operators of the reference, each applied to a whole table.

Projections and filters (P1-P14), lookup forms (J2, J4-J8, J12, J14),
join forms (J9-J11, J15, J17), distinct / sort / first-row operators (A5, A6,
O1, O3, W4) and schema evolution (S8).  The business plans use the same
functions inline; here each runs alone so it can be checked and timed.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from profilebook.functions import dates
from profilebook.functions.nulls import ne_or_null, nvl_in
from profilebook.operators.aggregates import first_per_key
from profilebook.operators.guards import ROWS_FOUND, scalar_lookup
from profilebook.operators.joins import not_in
from profilebook.operators.lookups import Lookup, lookups
from profilebook.plans import creation
from profilebook.sources import schema
from profilebook.sources.catalog import Catalog

KEY = ["ID_SOLICITUD", "CUSTOMER_NO"]


def project_rename(cat: Catalog) -> DataFrame:
    """Pick and rename columns, quoted names with spaces included."""
    return schema.project(cat.master(), {"CUSTOMER_NO": "Customer No", "CUSTOMER_NAME1": "Customer Name",
                                         "FULL_NAME": "Legal or Commercial Name", "SHORT_NAME2": "SHORT_NAME",
                                         "NATIONALITY": "NationalityCod"})


def constant_null_columns(cat: Catalog) -> DataFrame:
    """Literal columns and typed NULL columns ('' is NULL)."""
    p = cat.profile().select(*KEY)
    return p.select(*KEY, F.lit("MAIL").alias("DEFAULT_MEDIA"), F.lit("NA").alias("WEBSITE"),
                    F.lit("NC").alias("S_AND_P_EXTERNAL_R_RAT"), F.lit(None).cast("string").alias("IDENT_NAME"),
                    F.lit(None).cast("string").alias("DIGITO_VERIFICADOR"))


def filter_equality(cat: Catalog, value: str = "E") -> DataFrame:
    """``col = :p`` with a bound parameter (pushed into the scan)."""
    return cat.profile().filter(F.col("LMT_CUSTOMER_TYPE") == F.lit(value)).select(*KEY, "LMT_CUSTOMER_TYPE")


def filter_not_equal(cat: Catalog) -> DataFrame:
    """``t <> 'G'`` (three-valued: NULL types are dropped too)."""
    return cat.profile().filter(F.col("LMT_CUSTOMER_TYPE") != "G").select(*KEY, "LMT_CUSTOMER_TYPE")


def filter_ne_or_null(cat: Catalog) -> DataFrame:
    """``(s <> 3 OR s IS NULL)``."""
    return cat.profile().filter(ne_or_null(F.col("ID_STATUS_FCC"), 3)).select(*KEY, "ID_STATUS_FCC")


def filter_null_default(cat: Catalog) -> DataFrame:
    """``NVL(s, 0) IN (1, 3)``."""
    return cat.profile().filter(nvl_in(F.col("ID_STATUS_FCC"), 0, [1, 3])).select(*KEY, "ID_STATUS_FCC")


def filter_in_list(cat: Catalog) -> DataFrame:
    """P10: literal IN lists on the stage history."""
    he = cat.table("wf_stage_history")
    return he.filter(F.col("ID_PROCESO").isin(*creation.COMPLETION_PROCESSES)
                     & F.col("ID_STEP").isin(*creation.APPROVAL_STEPS)).select(
        "NUMEROINCIDENTE", "ID_PROCESO", "ID_STEP", "ESTADO_ETAPA")


def filter_like(cat: Catalog, text: str = "#00000001") -> DataFrame:
    """``LIKE '%' || :p || '%'`` (case-sensitive; % and _ in p are wildcards)."""
    p = cat.profile()
    return p.filter(F.col("CUSTOMER_NAME1").like(f"%{text}%")).select(*KEY, "CUSTOMER_NAME1")


def filter_null_tests(cat: Catalog) -> DataFrame:
    """IS NULL / IS NOT NULL."""
    p = cat.profile()
    return p.filter(F.col("ID_CUSTOMER_FCC").isNull() & F.col("CUSTOMER_NO_FCC").isNotNull()).select(
        *KEY, "CUSTOMER_NO_FCC")


def filter_sentinel_date(cat: Catalog) -> DataFrame:
    """The 1980-01-01 marker, compared as a date literal, both ways."""
    p = cat.profile()
    s = dates.lit_date(dates.SENTINEL_LIMIT_DATE)
    lim = F.col("LIMIT_EXP_DATE")
    return p.select(*KEY, F.coalesce(lim == s, F.lit(False)).alias("IS_SENTINEL"),
                    ((lim != s) | lim.isNull()).alias("NOT_SENTINEL"))


def filter_status_set(cat: Catalog) -> DataFrame:
    """Open, authorised-or-unauthorised master records."""
    m = cat.master()
    return m.filter(F.col("AUTH_STAT").isin("U", "A") & (F.col("RECORD_STAT") == "O")).select(
        "CUSTOMER_NO", "AUTH_STAT", "RECORD_STAT")


def lookup_filtered_role(cat: Catalog) -> DataFrame:
    """Code list filtered by its role constant before the left join."""
    p = cat.profile().select(*KEY, "RELATIONTYPE")
    return lookups(p, [Lookup(cat.table("fcc_lov"), ["RELATIONTYPE"], ["LOV"], {"RELATIONTYPE_DESC": "LOV_DESC"},
                              where=F.col("FIELD_NAME") == "RELATION_TYPE")])


def lookup_prefix_key(cat: Catalog) -> DataFrame:
    """``id = SUBSTR(REC_KEY, 1, 9)`` (the STDCIF record; master-sized, shuffle join)."""
    p = cat.profile().select(*KEY, "CUSTOMER_NO_FCC")
    u = cat.table("fcc_userdef").filter(F.col("FUNCTION_ID") == "STDCIF")
    return lookups(p, [Lookup(u.withColumn("__k", F.substring("REC_KEY", 1, 9)), ["CUSTOMER_NO_FCC"], ["__k"],
                              {"FIELD_VAL_7": "FIELD_VAL_7", "FIELD_VAL_8": "FIELD_VAL_8"}, small=False)])


def lookup_concat_key(cat: Catalog) -> DataFrame:
    """``CUSTOMER_NO || '~' = REC_KEY``."""
    m = cat.master().select("CUSTOMER_NO")
    u = cat.table("fcc_userdef")
    return lookups(m, [Lookup(u, [F.concat(F.col("CUSTOMER_NO"), F.lit("~"))], ["REC_KEY"],
                              {"INTERNAL_CLASSIFICATION": "FIELD_VAL_1"}, small=False)])


def lookup_trim_key(cat: Catalog) -> DataFrame:
    """``TRIM(a) = TRIM(b)``."""
    p = cat.profile().select(*KEY, "LMT_CUSTOMER_TYPE")
    t = cat.table("wf_lmt_customer_type")
    return lookups(p, [Lookup(t, [F.trim("LMT_CUSTOMER_TYPE")], [F.trim("CO_CUSTOMER_TYPE")],
                              {"CO_CUSTOMER_TYPE_KCC": "CO_CUSTOMER_TYPE_KCC"})])


def _type_chain(cat: Catalog) -> DataFrame:
    kct = cat.table("wf_customer_type")
    return cat.table("wf_lmt_customer_type").join(
        kct.select(F.col("CUSTOMER_ID").alias("__kid"), F.col("CUSTOMER_DESCRIPTION").alias("__kdesc")),
        F.col("CO_CUSTOMER_TYPE_KCC") == F.col("__kid"), "left").select(
        F.trim("CO_CUSTOMER_TYPE").alias("__ctype"), "__kid", "__kdesc")


def lookup_chain(cat: Catalog) -> DataFrame:
    """Limit type -> type map -> type description, pre-joined into one small dim."""
    p = cat.profile().select(*KEY, "LMT_CUSTOMER_TYPE")
    return lookups(p, [Lookup(_type_chain(cat), [F.trim("LMT_CUSTOMER_TYPE")], ["__ctype"],
                              {"KCT_CUSTOMER_ID": "__kid", "KCT_DESCRIPTION": "__kdesc"})])


def lookup_prefer(cat: Catalog) -> DataFrame:
    """``NVL(a.desc, b.desc)`` over two lookups."""
    p = cat.profile().select(*KEY, "CUSTOMER_TYPE", "LMT_CUSTOMER_TYPE")
    j = lookups(p, [
        Lookup(cat.table("wf_customer_type"), ["CUSTOMER_TYPE"], ["CUSTOMER_ID"], {"__a": "CUSTOMER_DESCRIPTION"}),
        Lookup(_type_chain(cat), [F.trim("LMT_CUSTOMER_TYPE")], ["__ctype"], {"__b": "__kdesc", "__bid": "__kid"}),
    ])
    return j.select(*KEY, F.coalesce("CUSTOMER_TYPE", "__bid").alias("CUSTOMER_TYPE"),
                    F.coalesce("__a", "__b").alias("CUSTOMER_TYPE_DESC"))


def lookup_scalar(cat: Catalog) -> DataFrame:
    """Correlated scalar lookup; the plan raises when a row asks for a key with several rows, as the reference does."""
    p = cat.profile().select(*KEY, "LANGUAGEID")
    return scalar_lookup(p, "LANGUAGEID", cat.table("fcc_language"), "LANG_CODE", {"LANGUAGEID_DESC": "LANG_NAME"}).drop(ROWS_FOUND)


def lookup_fallback(cat: Catalog) -> DataFrame:
    """``NVL((first group row's code), (first limits code))`` per application."""
    from profilebook.plans.export import _group_code_fallback
    apps = cat.table("wf_application").select("ID_SOLICITUD")
    fb = _group_code_fallback(cat, cat.profile())
    return apps.join(fb, F.col("ID_SOLICITUD") == F.col("__g_app"), "left").select(
        "ID_SOLICITUD", F.col("__group_code").alias("GROUP_CODE"))


def join_inner_multi(cat: Catalog) -> DataFrame:
    """Inner joins profile x master x application."""
    p = cat.profile().select(*KEY, "CUSTOMER_NO_FCC")
    m = cat.master().select(F.col("CUSTOMER_NO").alias("__core"), "AUTH_STAT")
    a = cat.table("wf_application").select("ID_SOLICITUD", "NU_INCIDENTE")
    return p.join(m, F.col("CUSTOMER_NO_FCC") == F.col("__core")).join(a, "ID_SOLICITUD").select(
        *KEY, "CUSTOMER_NO_FCC", "AUTH_STAT", "NU_INCIDENTE")


def join_inlist_stage(cat: Catalog) -> DataFrame:
    """Applications whose incident has an open completion stage (IN lists on the joined side)."""
    a = cat.table("wf_application").select("ID_SOLICITUD", "NU_INCIDENTE")
    return a.join(creation._stage(cat, creation.COMPLETION_PROCESSES, creation.COMPLETION_STEPS),
                  "NU_INCIDENTE", "left_semi")


def anti_not_in(cat: Catalog) -> DataFrame:
    """Applications whose incident is NOT IN the completed list."""
    a = cat.table("wf_application").select("ID_SOLICITUD", "NU_INCIDENTE")
    return not_in(a, "NU_INCIDENTE", cat.table("wf_completion_cif"), "INCIDENT")


def anti_not_in_null(cat: Catalog) -> DataFrame:
    """J17 with a NULL in the list: NOT IN keeps no row at all."""
    a = cat.table("wf_application").select("ID_SOLICITUD", "NU_INCIDENTE")
    no_incident = cat.table("wf_application").agg(
        F.max(F.when(F.lit(False), F.col("NU_INCIDENTE"))).alias("INCIDENT"))   # one NULL entry
    listed = cat.table("wf_completion_cif").select("INCIDENT").unionByName(no_incident)
    return not_in(a, "NU_INCIDENTE", listed, "INCIDENT")


def main_row_values(cat: Catalog) -> DataFrame:
    """The main party's officer and location put on every row of its application."""
    p = cat.profile()
    main = first_per_key(p.filter(F.col("MAIN_CUSTOMER") == 1), ["ID_SOLICITUD"], ["CUSTOMER_NO"],
                         ["ACCOUNT_OFFICERID", "LOCATIONID"]).select(
        F.col("ID_SOLICITUD").alias("__m"), F.col("ACCOUNT_OFFICERID").alias("ACCOUNT_OFFICER"),
        F.col("LOCATIONID").alias("LOCATION"))
    return p.select(*KEY).join(main, F.col("ID_SOLICITUD") == F.col("__m"), "left").drop("__m")


def distinct_groups(cat: Catalog) -> DataFrame:
    """DISTINCT / GROUP BY without aggregates over the created rows."""
    base = creation._created_rows(cat, group_rows=False)
    return base.select("ID_CUSTOMER_FCC", "ID_STATUS_FCC", "ID_SOLICITUD", F.col("__core").alias("CUSTOMER_NO"),
                       "NU_INCIDENTE").distinct()


def sort_main_first(cat: Catalog) -> DataFrame:
    """O1: main party first (DESC puts NULL first, as Oracle does), total order."""
    p = cat.profile().select(*KEY, "MAIN_CUSTOMER")
    return p.orderBy(F.col("MAIN_CUSTOMER").desc_nulls_first(), "ID_SOLICITUD", "CUSTOMER_NO")


def first_of_many(cat: Catalog) -> DataFrame:
    """``ROWNUM <= 1`` made deterministic: the lowest-numbered main row."""
    p = cat.profile().filter(F.col("MAIN_CUSTOMER") == 1)
    return first_per_key(p, ["ID_SOLICITUD"], ["CUSTOMER_NO"], ["CUSTOMER_NO", "CUSTOMER_NO_FCC"])


def add_columns(cat: Catalog) -> DataFrame:
    """A table whose first files were written before the two schema changes, and others after."""
    p = cat.profile().select(*KEY, *schema.PROFILE_ADDED_COLUMNS)
    early = F.col("ID_SOLICITUD") % 2 == 0
    with schema.EvolvingTable(cat.spark, p.filter(early).select(*KEY), f"{cat.land_dir}/evolving-{uuid.uuid4().hex}") as t:
        t.add_columns(schema.PROFILE_ADDED_COLUMNS)
        t.append(p.filter(~early))
        return t.read()
