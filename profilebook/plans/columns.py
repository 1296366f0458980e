"""Column-function reports: the scalar rules of the reference applied to whole tables.

Each report reads a workflow/master table and adds the derived columns of one
family of rules (text, dates, flags, types).  They are what the export and
refresh jobs use inline; here each family runs on its own so it can be
checked and measured in isolation.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from profilebook.functions import codes, dates
from profilebook.functions.nulls import empty_to_null, ncat
from profilebook.operators.aggregates import first_per_key
from profilebook.operators.lookups import Lookup, lookup
from profilebook.plans.search import main_party
from profilebook.sources.catalog import Catalog

KEY = ["ID_SOLICITUD", "CUSTOMER_NO"]


def text_ops(cat: Catalog) -> DataFrame:
    """Null-safe concat, UPPER, TRIM of a number, RTRIM, SUBSTR, REPLACE, LENGTH."""
    p = cat.profile()
    name = F.col("CUSTOMER_NAME1")
    return p.select(
        *KEY,
        ncat(F.col("TELEPHONENUMBER"), "|", F.col("TELEPHONENUMBER2"), "|", F.col("FAXNUMBER")).alias("PHONES"),
        F.upper(F.col("PHYSICALALINE3")).alias("PHYSICAL3_UPPER"),
        F.trim(codes.number_text(F.col("NETWORTH"))).alias("NETWORTH_TEXT"),
        empty_to_null(F.rtrim(F.col("NAMEEXTERNALAUDITORS"))).alias("AUDITORS"),
        F.substring(F.col("CUSTOMER_NO_FCC"), 1, 5).alias("CORE_PREFIX"),
        empty_to_null(F.substring(name, F.lit(1), F.length(name) - 3)).alias("NAME_CUT"),
        F.replace(ncat(F.col("POSTALALINE1"), ",", F.col("POSTALACITY")), F.lit(","), F.lit(" ^ ")).alias("POSTAL"),
        F.length(name).alias("NAME_LENGTH"),
    )


def split_rating(cat: Catalog) -> DataFrame:
    """S&P, Fitch and Moody's ratings out of the packed agency text."""
    p = cat.profile()
    r = F.col("NAMEINTERNATIONALRISK")
    return p.select(*KEY, codes.rating_part(r, 2).alias("S_AND_P_EXTERNAL_R_RAT"),
                    codes.rating_part(r, 3).alias("FITCH_EXTERNAL_R_RAT"),
                    codes.rating_part(r, 1).alias("MOODYS_EXTNL_R_RAT"))


def truncate_default(cat: Catalog) -> DataFrame:
    """F8 on whole documents: default 'NA', right-trim, first 105 characters."""
    d = cat.base("documents")
    t = F.col("text")
    return d.select("doc_id", codes.truncate_default(t).alias("TEXT_105"),
                    F.length(F.rtrim(t)).alias("TRIMMED_LENGTH"))


def pad_month(cat: Catalog) -> DataFrame:
    """two-digit expiry month."""
    p = cat.profile()
    return p.select(*KEY, codes.pad_month(F.col("GROUP_EXPIRATION_MONTH")).alias("KYC_REVISION_MONTH"))


def date_formats(cat: Catalog) -> DataFrame:
    """The reference's TO_CHAR formats."""
    p = cat.profile()
    d = F.col("INCORP_DATE")
    return p.select(*KEY, dates.fmt_dd_mon_yyyy(d).alias("D_MON"), dates.fmt_compact(d).alias("D_COMPACT"),
                    dates.fmt_iso(d).alias("D_ISO"), dates.fmt_dmy(d).alias("D_DMY"),
                    dates.month_name(F.col("FECHA_KYC")).alias("KYC_MONTH"))


def date_parse(cat: Catalog) -> DataFrame:
    """text dates of the user fields (ISO) and day-first texts; bad text -> NULL."""
    u = cat.table("fcc_userdef").filter(F.col("FUNCTION_ID") == "STDCIF")
    dmy = dates.fmt_dmy(dates.parse_iso(F.col("FIELD_VAL_39")))
    return u.select(
        "REC_KEY",
        dates.parse_iso(F.col("FIELD_VAL_17")).alias("LIMIT_EXP_DATE"),
        dates.parse_iso(F.col("FIELD_VAL_40")).alias("INCEPTION_DATE"),
        dates.parse_iso(F.col("FIELD_VAL_53")).alias("DATE_ESG_RATING"),
        dates.parse_dmy(dmy).alias("FECHA_KYC"),
        dates.parse_compact(F.regexp_replace(F.col("FIELD_VAL_39"), "-", "")).alias("KYC_COMPACT"),
        dates.parse_iso(F.col("FIELD_VAL_9")).alias("NOT_A_DATE"),
    )


def date_parts(cat: Catalog) -> DataFrame:
    """Parts, month end, day differences, day and month arithmetic."""
    p = cat.profile()
    k, lim, m = F.col("FECHA_KYC"), F.col("LIMIT_EXP_DATE"), F.col("GROUP_EXPIRATION_MONTH")
    return p.select(*KEY, F.year(k).alias("Y"), F.month(k).alias("M"), F.dayofmonth(k).alias("D"),
                    F.last_day(k).alias("MONTH_END"), F.datediff(lim, k).alias("DAYS_TO_LIMIT"),
                    F.date_add(k, 1).alias("NEXT_DAY"), F.add_months(k, 6).alias("PLUS_6M"),
                    dates.month_end(F.year(k), m).alias("EXPIRY_MONTH_END"))


def add_months_sticky(cat: Catalog) -> DataFrame:
    """F16: Oracle ADD_MONTHS (month ends stay month ends)."""
    p = cat.profile()
    return p.select(*KEY, dates.add_months_sticky(F.col("FECHA_KYC"), 12).alias("KYC_PLUS_12"),
                    dates.add_months_sticky(F.last_day(F.col("INCORP_DATE")), 1).alias("INCORP_END_PLUS_1"),
                    dates.add_months_sticky(F.col("LIMIT_EXP_DATE"), -1).alias("LIMIT_MINUS_1"))


def flag_codings(cat: Catalog) -> DataFrame:
    """yes/no codings of the export and the SWIFT rule."""
    p = cat.profile()
    ny = F.col("NY_AGENCY")
    return p.select(
        *KEY,
        codes.yes_no(F.col("CUSTOMER_CLASSIFICATION_PEP")).alias("IS_PEP"),
        codes.yes_no(F.col("PROJECT_FINANCE")).alias("PF_INDICATOR"),
        codes.agency_text(ny).alias("CUST_CAN_BE_USE_NY_AGENCY"),
        codes.exporter_text(F.col("SALES_MORE_30_PERCENT")).alias("CLIENTE_EXP_30PCT_VTAS_O_MAS"),
        codes.si_no(F.col("CHK_CONTR_APROB_VF")).alias("CONTR_APROB_VF_1"),
        codes.swift_for_banks(F.col("CUSTOMER_TYPE"), F.col("SWIFT_CODE")).alias("SWIFT_CODE"),
        codes.limit_type(F.col("CUSTOMER_TYPE")).alias("LMT_CUSTOMER_TYPE"),
    )


def _master_with_fields(cat: Catalog) -> DataFrame:
    m = cat.master()
    udf = cat.table("fcc_userdef").filter(F.col("FUNCTION_ID") == "STDCIF").withColumn(
        "__core", F.substring("REC_KEY", 1, 9))
    corp = cat.table("fcc_corporate").select(F.col("CUSTOMER_NO").alias("__corp_no"), "INCORP_COUNTRY")
    j = m.join(udf, m.CUSTOMER_NO == udf["__core"], "left")
    return j.join(corp, F.col("CUSTOMER_NO") == F.col("__corp_no"), "left")


def type_derivation(cat: Catalog) -> DataFrame:
    """D28 (+ M4's limit type): type code from client segment and master letter."""
    j = _master_with_fields(cat)
    t = codes.customer_type(F.col("FIELD_VAL_42"), F.col("CUSTOMER_TYPE"))
    return j.select("CUSTOMER_NO", t.alias("TIPO"), codes.limit_type(t).alias("LMT_CUSTOMER_TYPE"))


def agency_derivation(cat: Catalog) -> DataFrame:
    """NY agency, PEP, counterpart and main-customer flags from the master."""
    j = _master_with_fields(cat)
    return j.select("CUSTOMER_NO",
                    codes.ny_agency(F.col("FIELD_VAL_32"), F.col("INCORP_COUNTRY")).alias("NY_AGENCY"),
                    codes.pep_flag(F.col("FIELD_VAL_41")).alias("CUSTOMER_CLASSIFICATION_PEP"),
                    codes.counterpart_flag(F.col("FIELD_VAL_36")).alias("CHK_CONTR_APROB_VF"),
                    codes.main_flag(F.col("CUSTOMER_NO"), F.col("FIELD_VAL_31")).alias("MAIN_CUSTOMER"))


def aml_effective(cat: Catalog) -> DataFrame:
    """Effective AML rating, search form and export form."""
    p = cat.profile()
    ny, nyr, r = F.col("NY_AGENCY"), F.col("AML_RATINGID_NY"), F.col("AML_RATINGID")
    return p.select(*KEY, codes.aml_rating_search(ny, nyr, r).alias("AML_RATING"),
                    codes.aml_rating_export(ny, nyr, r).alias("AML_RISK_RATING"))


def first_code_by_label(cat: Catalog, field: str) -> DataFrame:
    """First code of each description in one code list (lowest code)."""
    lov = cat.table("fcc_lov").filter(F.col("FIELD_NAME") == field)
    return first_per_key(lov, ["LOV_DESC"], ["LOV"], ["LOV"])


def bank_type_codes(cat: Catalog) -> DataFrame:
    """Bank-type description -> code ('NA' kept / default), and label clean-up."""
    p = cat.profile().select(*KEY, "BANKTYPE")
    first = first_code_by_label(cat, "BANK TYPE")
    j = lookup(p, Lookup(first, ["BANKTYPE"], ["LOV_DESC"], {"__code": "LOV"}))
    code = F.coalesce(F.when(F.col("BANKTYPE") == codes.NOT_GIVEN, F.col("BANKTYPE")).otherwise(F.col("__code")),
                      F.lit(codes.NOT_GIVEN))
    return j.select(*KEY, code.alias("BANK_TYPE"), codes.bank_type_label(F.col("BANKTYPE")).alias("BANK_TYPE_LABEL"))


def relation_by_purpose(cat: Catalog) -> DataFrame:
    """D40 with J23: the application's purpose (one value per application) on every row."""
    p = cat.profile().select(*KEY, "RELATIONTYPE")
    purpose = cat.table("wf_lmt_customer_info").select(F.col("ID_SOLICITUD").alias("__app"), "PURPOSE_ID")
    purpose = purpose.groupBy("__app").agg(F.min("PURPOSE_ID").alias("PURPOSE_ID"))
    j = p.join(purpose, F.col("ID_SOLICITUD") == F.col("__app"), "left")
    v = codes.relation_type_for_purpose(F.coalesce(F.col("PURPOSE_ID"), F.lit(0)), F.col("RELATIONTYPE"))
    return j.select(*KEY, v.alias("RELATION_TYPE"))


def main_reference(cat: Catalog) -> DataFrame:
    """D43 with J15: the main party's core id on every row, NULL on sentinel rows."""
    p = cat.profile()
    mains = p.filter((F.col("MAIN_CUSTOMER") == 1) & F.col("RELACIONADO").isNull())
    main_core = first_per_key(mains, ["ID_SOLICITUD"], ["CUSTOMER_NO"], ["CUSTOMER_NO_FCC"]).select(
        F.col("ID_SOLICITUD").alias("__app"), F.col("CUSTOMER_NO_FCC").alias("__main_core"))
    j = p.select(*KEY, "LIMIT_EXP_DATE").join(main_core, F.col("ID_SOLICITUD") == F.col("__app"), "left")
    return j.select(*KEY, codes.main_ref_unless_sentinel(F.col("LIMIT_EXP_DATE"), F.col("__main_core")).alias(
        "CLIENTE_PRINCIPAL"))


def month_names(cat: Catalog, criterion: str | None = None) -> DataFrame:
    """D37 applied: each profile's expiry month named through the month catalogue.

    With a criterion, only profiles whose month name matches it (LIKE).
    """
    from profilebook.plans.catalog import month_catalog
    months = month_catalog(cat.spark, criterion).select(F.col("CODIGO").alias("__m"), "DESCRIPCION")
    p = cat.profile().select(*KEY, "GROUP_EXPIRATION_MONTH")
    how = "left" if criterion is None else "inner"
    return p.join(F.broadcast(months), F.col("GROUP_EXPIRATION_MONTH") == F.col("__m"), how).drop("__m")


__all__ = [n for n in dir() if not n.startswith("_")] + ["main_party"]
