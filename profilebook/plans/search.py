"""Customer search (D1-D6): the profile enriched with every description.

Plan shape (see ``explain``): the wide profile is filtered at the scan
(optional parameters fold into pushed predicates), enriched with the
master-sized lookups on a *narrow* key projection (one shuffle per key, on
a handful of columns), joined back once on (application, customer), and then
runs a single pipelined stage of broadcast joins against the code lists.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from profilebook.functions import codes, dates
from profilebook.functions.nulls import ncat, opt_eq, opt_eq_null
from profilebook.operators.aggregates import latest_per_key, listagg
from profilebook.operators.lookups import Lookup, lookups
from profilebook.session import ensure_checkpoint_dir
from profilebook.sources.catalog import Catalog

DIRECTORS, MANAGERS = 1, 2


def main_party(profile: DataFrame) -> DataFrame:
    """Main party per application: (ID_SOLICITUD, MAIN_NO, MAIN_COUNT).

    The reference's SELECT INTO raises on two mains; the lowest number is
    taken and MAIN_COUNT > 1 exposes such applications.
    """
    mains = profile.filter((F.col("MAIN_CUSTOMER") == 1) & F.col("RELACIONADO").isNull())
    return mains.groupBy("ID_SOLICITUD").agg(F.min("CUSTOMER_NO").alias("MAIN_NO"),
                                             F.count(F.lit(1)).alias("MAIN_COUNT"))


def _only(df: DataFrame, apps: DataFrame | None) -> DataFrame:
    """Restrict a per-application table to ``apps`` (semi join) when given."""
    return df if apps is None else df.join(apps, "ID_SOLICITUD", "left_semi")


def people_texts(cat: Catalog, apps: DataFrame | None = None) -> DataFrame:
    """Directors (type 1) and managers (type 2) text per (application, party)."""
    d = _only(cat.table("wf_directors"), apps).filter(F.col("TYPE").isin(DIRECTORS, MANAGERS))
    item = ncat(F.col("NAME"), " (", F.col("POSITION"), ")")
    t = listagg(d.filter(F.col("NAME").isNotNull()), ["ID_SOLICITUD", "CUSTOMER_NO", "TYPE"], item,
                        [F.col("NAME"), F.col("POSITION")], ", ", "TXT")
    return t.groupBy("ID_SOLICITUD", "CUSTOMER_NO").agg(
        F.max(F.when(F.col("TYPE") == DIRECTORS, F.col("TXT"))).alias("BOARDOFDIRECTORS"),
        F.max(F.when(F.col("TYPE") == MANAGERS, F.col("TXT"))).alias("TOPMANAGEMENT"))


def holder_texts(cat: Catalog, apps: DataFrame | None = None) -> DataFrame:
    s = _only(cat.table("wf_shareholders"), apps)
    item = F.concat(F.col("NAME"), F.lit(" "), F.col("PERCENTAGE").cast("string"), F.lit("%"))
    return listagg(s, ["ID_SOLICITUD", "CUSTOMER_NO"], item, [F.col("NAME"), F.col("PERCENTAGE")],
                   ", ", "SHAREHOLDERS")


def limit_counts(cat: Catalog, apps: DataFrame | None = None) -> DataFrame:
    """Rows of the limits table per (limit application, local customer)."""
    lm = _only(cat.table("wf_lmt_customer"), apps)
    return lm.groupBy(F.col("ID_SOLICITUD").alias("__lm_app"), F.col("CUSTOMER_ID").alias("__lm_cust")).agg(
        F.count(F.lit(1)).alias("__lm_n"))


def bank_type_by_core(cat: Catalog, key: str = "prefix") -> DataFrame:
    """User field 7, described through the BANK_TYPE list, keyed for the join.

    ``prefix`` (J4): the STDCIF record whose 9-character key prefix is the
    core id.  ``concat`` (J5): the record whose whole key is the local
    number followed by '~', as the most-recent search joins it.
    """
    udf = cat.table("fcc_userdef")
    if key == "prefix":
        udf = udf.filter(F.col("FUNCTION_ID") == "STDCIF").select(
            F.substring("REC_KEY", 1, 9).alias("__bt_core"), F.col("FIELD_VAL_7").alias("__bt_code"))
    else:
        udf = udf.select(F.col("REC_KEY").alias("__bt_core"), F.col("FIELD_VAL_7").alias("__bt_code"))
    udf = udf.groupBy("__bt_core").agg(F.min("__bt_code").alias("__bt_code"))
    return lookups(udf, [Lookup(cat.table("fcc_lov"), ["__bt_code"], ["LOV"], {"BANKTYPE_DESC": "LOV_DESC"},
                                where=F.col("FIELD_NAME") == "BANK_TYPE")]).drop("__bt_code")


def _narrow_enrichment(cat: Catalog, rows: DataFrame, bank_key: str = "prefix", full: bool = True,
                       selective: bool = False) -> DataFrame:
    """Every lookup, run on narrow projections of the rows, one branch per key.

    The director/holder texts (by application and party), the limit count
    (by limit application and customer), the bank type (by core id) and the
    debtor's name (by debtor id) are independent lookups: each runs as its
    own branch and comes back keyed by the row key, so the branches shuffle
    in parallel and every later join shares one partitioning on the row key
    (including the caller's single join back to the wide rows).  Code lists
    join by checked broadcast, without a shuffle.
    """
    profile = cat.profile()
    narrow = rows.select(*dict.fromkeys(_KEY + ["CUSTOMER_NO_FCC", "CO_DEUDOR_PRINCIPAL", "CHK_SAMESHOLDERS_MAINCUST",
                                                "ID_SOLICITUD_LM"] + _LOOKUP_KEYS))
    # a selective search first narrows the per-application tables to the
    # applications it returns (semi joins), instead of aggregating them all
    apps = rows.select("ID_SOLICITUD").distinct() if selective else None

    # texts: the row's own party, or the application's main party when the
    # row shares its holders with the main customer
    mp = main_party(_only(profile, apps)).select("ID_SOLICITUD", "MAIN_NO")
    t = narrow.select(*_KEY, "CHK_SAMESHOLDERS_MAINCUST").join(mp, "ID_SOLICITUD", "left")
    party = F.when(F.col("CHK_SAMESHOLDERS_MAINCUST") == "1", F.coalesce(F.col("MAIN_NO"), F.lit(0))).otherwise(
        F.col("CUSTOMER_NO"))
    t = t.withColumn("__party", party)
    people = people_texts(cat, apps).withColumnRenamed("CUSTOMER_NO", "__party")
    holders = holder_texts(cat, apps).withColumnRenamed("CUSTOMER_NO", "__party")
    texts = t.join(people, ["ID_SOLICITUD", "__party"], "left").join(holders, ["ID_SOLICITUD", "__party"], "left") \
        .select(*_KEY, "BOARDOFDIRECTORS", "TOPMANAGEMENT", "SHAREHOLDERS")

    lm = limit_counts(cat, rows.select(F.col("ID_SOLICITUD_LM").alias("ID_SOLICITUD")).distinct() if selective
                      else None)
    limits = narrow.select(*_KEY, "ID_SOLICITUD_LM").join(
        lm, (F.col("ID_SOLICITUD_LM") == F.col("__lm_app")) & (F.col("CUSTOMER_NO") == F.col("__lm_cust"))) \
        .select(*_KEY, F.col("__lm_n").alias("__lm_n"))

    bt = bank_type_by_core(cat, bank_key)
    bt_key = (F.col("CUSTOMER_NO_FCC") if bank_key == "prefix"
              else F.concat(F.col("CUSTOMER_NO").cast("string"), F.lit("~")))
    bank = narrow.select(*_KEY, "CUSTOMER_NO_FCC").join(bt, bt_key == F.col("__bt_core")).select(*_KEY, "BANKTYPE_DESC")

    debtor = cat.master().select(F.col("CUSTOMER_NO").alias("__dp_no"), F.col("CUSTOMER_NAME1").alias("__dp_name"))
    debtor = debtor.groupBy("__dp_no").agg(F.min("__dp_name").alias("__dp_name"))
    debtors = narrow.select(*_KEY, "CO_DEUDOR_PRINCIPAL").join(
        debtor, F.col("CO_DEUDOR_PRINCIPAL") == F.col("__dp_no")).select(
        *_KEY, F.col("__dp_name").alias("DEUDOR_PRINCIPAL_DESC"), F.col("__dp_no").alias("DEUDOR_PRINCIPAL_CODE"))

    coded = lookups(narrow.select(*_KEY, *_LOOKUP_KEYS), _code_lookups(cat, full)).drop(*_LOOKUP_KEYS)
    out = coded.join(texts, _KEY, "left").join(limits, _KEY, "left").join(bank, _KEY, "left").join(
        debtors, _KEY, "left")
    return out.withColumn("ES_DE_LIMITE", F.coalesce(F.col("__lm_n"), F.lit(0))).drop("__lm_n")


def _lov(cat: Catalog, field: str, key: str, values: dict) -> Lookup:
    return Lookup(cat.table("fcc_lov"), [key], ["LOV"], values, where=F.col("FIELD_NAME") == field)


def _code_lookups(cat: Catalog, full: bool = True) -> list[Lookup]:
    country = cat.table("fcc_country")
    mis = cat.table("fcc_mis_code")
    kct = cat.table("wf_customer_type")
    # Type -> type map -> type description, pre-joined into one small dim.
    chain = cat.table("wf_lmt_customer_type").join(
        kct.select(F.col("CUSTOMER_ID").alias("__kid"), F.col("CUSTOMER_DESCRIPTION").alias("__kdesc")),
        F.col("CO_CUSTOMER_TYPE_KCC") == F.col("__kid"), "left").select(
        F.trim("CO_CUSTOMER_TYPE").alias("__ctype"), "__kid", "__kdesc")
    common = [
        Lookup(mis, ["INDUSTRY"], ["MIS_CODE"], {"INDUSTRY_DESC": "CODE_DESC"}),
        Lookup(kct, ["CUSTOMER_TYPE"], ["CUSTOMER_ID"], {"__ct_desc": "CUSTOMER_DESCRIPTION"}),
        Lookup(cat.table("wf_dflt_media"), ["DEFAULT_MEDIA"], ["MEDIA"], {"DEFAULT_MEDIA_DESC": "DESCRIPTION"}),
        _lov(cat, "RELATION_TYPE", "RELATIONTYPE", {"RELATIONTYPE_DESC": "LOV_DESC"}),
        Lookup(cat.table("fcc_customer_cat"), ["CUSTOMER_CATEGORY"], ["CUST_CAT"],
               {"CUSTOMER_CATEGORY_DESC": "CUST_CAT_DESC"},
               where=(F.col("RECORD_STAT") == "O") & (F.col("AUTH_STAT") == "A")),
        Lookup(chain, [F.trim("LMT_CUSTOMER_TYPE")], ["__ctype"], {"__kct_id": "__kid", "__kct_desc": "__kdesc"}),
        Lookup(mis, ["ACCOUNT_OFFICERID"], ["MIS_CODE"], {"OFFICER_DESCRIPTION": "CODE_DESC"}),
        Lookup(mis, ["LOCATIONID"], ["MIS_CODE"], {"LOCATION_DESCRIPTION": "CODE_DESC"}),
        _lov(cat, "AML_RISK_RATING", "AML_RATINGID", {"AML_DESCRIPTION": "LOV_DESC"}),
        Lookup(cat.table("wf_sbp_category"), ["SBP_CATEGORYID"], ["CATEGORYID"],
               {"SBP_CATEGORY_DESCRIPTION": "CATEGORY_DESCRIPCION"}),
        Lookup(country, ["RESIDENCECOUNTRY"], ["COUNTRY_CODE"], {"RESCTRY_DESC": "DESCRIPTION"}),
        Lookup(country, ["NATIONALITYID"], ["COUNTRY_CODE"], {"NATIONALITYIDDESCR": "DESCRIPTION"}),
        Lookup(country, ["EXPOSURE_COUNTRYID"], ["COUNTRY_CODE"], {"EXPCTRY_DESC": "DESCRIPTION"}),
        Lookup(country, ["INCORP_COUNTRYID"], ["COUNTRY_CODE"], {"INCORP_CNTRY_DESC": "DESCRIPTION"}),
        Lookup(cat.table("fcc_location"), ["RESIDENCELOCATIONID"], ["LOC_CODE"], {"RESLOC_DESC": "DESCRIPTION"}),
        Lookup(cat.table("fcc_language"), ["LANGUAGEID"], ["LANG_CODE"], {"LANGUAGEID_DESC": "LANG_NAME"}),
    ]
    if not full:
        return common
    # Lookups whose values only the full search shows (an unused left join
    # is not pruned by the optimizer, so it is not added at all).
    return common + [
        _lov(cat, "AML_RISK_RATING", "AML_RATINGID_NY", {"AML_DESCRIPTION_NY": "LOV_DESC"}),
        _lov(cat, "TIPO DE CLIENTE", "TIPO_DE_CLIENTE", {"__tdc_desc": "LOV_DESC", "TIPO_DE_CLIENTE_CODE": "LOV"}),
        _lov(cat, "INTERNAL_CONTROL", "INTERNAL_CONTROL", {"__ic_desc": "LOV_DESC", "INTERNAL_CONTROL_CODE": "LOV"}),
        _lov(cat, "COVENANTS CIF", "CO_COVENANTS", {"COVENANTS_DESC": "LOV_DESC", "COVENANTS_CODE": "LOV"}),
        _lov(cat, "COD_ACTIVIDAD_CINU", "CINU", {"CINU_DESC": "LOV_DESC"}),
        _lov(cat, "OFICINA_DE_GESTION", "CO_OFICINA_GESTION", {"DESC_OFICINA_GESTION": "LOV_DESC"}),
    ]


_KEY = ["ID_SOLICITUD", "CUSTOMER_NO"]
_LOOKUP_KEYS = ["INDUSTRY", "CUSTOMER_TYPE", "DEFAULT_MEDIA", "RELATIONTYPE", "CUSTOMER_CATEGORY", "LMT_CUSTOMER_TYPE",
                "ACCOUNT_OFFICERID", "LOCATIONID", "AML_RATINGID", "SBP_CATEGORYID", "RESIDENCECOUNTRY", "NATIONALITYID",
                "EXPOSURE_COUNTRYID", "INCORP_COUNTRYID", "RESIDENCELOCATIONID", "LANGUAGEID", "AML_RATINGID_NY",
                "TIPO_DE_CLIENTE", "INTERNAL_CONTROL", "CO_COVENANTS", "CINU", "CO_OFICINA_GESTION"]


def _c(name: str) -> Column:
    return F.col(name)


def _search_columns(full: bool) -> list[Column]:
    fmt = dates.fmt_dd_mon_yyyy
    cols: list[Column] = [
        _c("ID_SOLICITUD"), _c("CUSTOMER_NO"), _c("SHAREHOLDER"),
        F.coalesce(_c("CUSTOMER_TYPE"), _c("__kct_id")).alias("CUSTOMER_TYPE"),
        _c("CUSTOMER_NAME1"), _c("FULLNAME"), _c("TAXIDNUMBER"), _c("DV"), _c("CUSTOMER_CATEGORY"),
        _c("RELATIONTYPE"), _c("INDUSTRY"), _c("NAMEOFECONOMICGROUP"), _c("LEGALREPRESENTATIVE"),
        _c("NAMEEXTERNALAUDITORS"), _c("NAMEINTERNATIONALRISK"), _c("POSTALALINE1"), _c("POSTALALINE2"),
        _c("POSTALALINE3"), _c("POSTALACITY"), _c("PHYSICALALINE1"), _c("PHYSICALALINE2"), _c("PHYSICALALINE3"),
        _c("TELEPHONENUMBER"), _c("TELEPHONENUMBER2"), _c("FAXNUMBER"), _c("WEBSITE"), _c("DEFAULT_MEDIA"),
        _c("INCORP_COUNTRYID"), fmt(_c("INCORP_DATE")).alias("INCORP_DATE"), _c("RESIDENCECOUNTRY"),
        _c("RESCTRY_DESC"), _c("NATIONALITYID"), _c("NATIONALITYIDDESCR"), _c("RESIDENCELOCATIONID"),
        _c("RESLOC_DESC"), _c("LANGUAGEID"), _c("LANGUAGEID_DESC"), _c("BANKTYPE"), _c("TYPEOFLICENCE"),
        _c("SWIFT_CODE"), _c("ABACODEVALUE"), _c("COMPLIANCEOFFICER"), _c("ADDRESSPROCESSAGENTINUSA"),
        codes.number_text(_c("NETWORTH")).alias("NETWORTH"), _c("EXPOSURE_COUNTRYID"), _c("EXPCTRY_DESC"),
        fmt(_c("INCEPTION_DATE")).alias("INCEPTION_DATE"), _c("PRODUCT_SERVICE_OFFERED"),
        _c("RELATEDCOMPANIES"), _c("EMAIL"), _c("NAME_ADDRESS_LEGAL_ADVISOR"),
        _c("REFERENCE_BANKING_COMMERCIAL").alias("REFERENCE_BANKING_COMME"), _c("NAME_OF_STOCK"),
        _c("COUNTRIES_WHERE_OFFERS"), _c("REGULATORY_AUTHORITY"), _c("RELATEDACCOUNT"),
        _c("INCORP_CNTRY_DESC"), _c("MAIN_CUSTOMER"), _c("INDUSTRY_DESC"),
        ncat(_c("TELEPHONENUMBER"), "|", _c("TELEPHONENUMBER2"), "|", _c("FAXNUMBER"), "|", _c("WEBSITE"), "|",
             _c("EMAIL")).alias("TELFAXWEBEMAIL"),
        F.nullif(F.rtrim(ncat(_c("POSTALALINE1"), " ", _c("POSTALALINE2"), " ", _c("POSTALALINE3"), " ",
                              _c("POSTALACITY"), " | ", _c("PHYSICALALINE1"), " ", _c("PHYSICALALINE2"), " ",
                              _c("PHYSICALALINE3"))), F.lit("")).alias("ADDRESS"),
        _c("BOARDOFDIRECTORS"), _c("TOPMANAGEMENT"), _c("CUSTOMER_NO_FCC"), _c("SHORT_NAME"), _c("LIAB_ID"),
        _c("GROUP_CODE"), _c("ID_SOLICITUD_LM"), _c("ACCOUNT_OFFICERID"),
        _c("ADDRESSPROCESSAGENTINUSA").alias("USA_PROCESS_AGENT"),
        F.coalesce(_c("__ct_desc"), _c("__kct_desc")).alias("CUSTOMER_TYPE_DESC"), _c("ID_EXISTE_FCC"),
        _c("BANKTYPE_DESC"), _c("LOCATIONID"), _c("AML_RATINGID"), _c("DEFAULT_MEDIA_DESC"), _c("NY_AGENCY"),
        _c("SBP_CATEGORYID"), _c("RELATIONTYPE_DESC"), _c("CUSTOMER_CLASSIFICATION_PEP"), _c("DESCRIPCION_PEP"),
        _c("CUSTOMER_CATEGORY_DESC"), _c("INCORPORATION_PURPOSE"), _c("OFFICER_DESCRIPTION"), _c("SUB_ECOGR_CD"),
        _c("LOCATION_DESCRIPTION"), _c("AML_DESCRIPTION"), _c("ECONOMICGROUPRUC"), _c("SBP_CATEGORY_DESCRIPTION"),
        _c("LEGALREPRESENTATIVE_INFO"), _c("LAST_CHANGE_DATE"), _c("DIGNATARIES"), _c("POWER_DEES"),
        _c("CHK_CREATE_FCC"), _c("AUTHORIZED_SIGNATURES"), _c("RELATION_CORRESPONSAL"),
        _c("CHK_SAMESHOLDERS_MAINCUST"), _c("SHAREHOLDERS"),
    ]
    if full:
        cols += [
            _c("SALES_MORE_30_PERCENT"), _c("EXPORT_SHARE"), _c("CUSTOMER_TYPE").alias("REAL_CUSTOMER_TYPE"),
            _c("AML_RATINGID_NY"), _c("AML_DESCRIPTION_NY"), _c("RELACIONADO"), _c("ID_MAIN_CUSTOMER"),
            _c("PUBLIC_TRADE_COMP"), fmt(_c("PATRIOT_EXC_DATE")).alias("PATRIOT_EXC_DATE"),
            fmt(_c("AML_EXC_DATE")).alias("AML_EXC_DATE"), _c("ES_DE_LIMITE"), _c("GIIN_NUMBER"),
            fmt(_c("W8_FORM_DATE")).alias("W8_FORM_DATE"),
            codes.aml_rating_search(_c("NY_AGENCY"), _c("AML_RATINGID_NY"), _c("AML_RATINGID")).alias("AML_RATING"),
            _c("FECHA_INTEG_BSARADAR"), fmt(_c("FECHA_KYC")).alias("FECHA_KYC"),
            _c("__tdc_desc").alias("TIPO_DE_CLIENTE"), _c("TIPO_DE_CLIENTE_CODE"),
            _c("__ic_desc").alias("INTERNAL_CONTROL"), _c("INTERNAL_CONTROL_CODE"), _c("NEGATIVE_NEWS"),
            _c("SANCTIONS"), _c("COVENANTS_DESC"), _c("COVENANTS_CODE"), _c("DEUDOR_PRINCIPAL_DESC"),
            _c("DEUDOR_PRINCIPAL_CODE"), _c("CHK_CONTR_APROB_VF"), _c("CINU"), _c("CINU_DESC"),
            _c("CO_OFICINA_GESTION"), _c("DESC_OFICINA_GESTION"),
        ]
    cols.append(_c("GROUP_EXPIRATION_MONTH"))
    return cols


def enrich(cat: Catalog, rows: DataFrame, full: bool = True, ordered: bool = True,
           bank_key: str = "prefix", selective: bool = False) -> DataFrame:
    """Attach every description to ``rows``.

    A selective search (a parameter given, or the most-recent search)
    materialises its selected rows once with a reliable checkpoint in the
    shared folder: they feed several lookup branches, and recomputing the
    selection (e.g. the latest-application aggregation) in each is the
    larger cost.
    """
    if selective:
        ensure_checkpoint_dir(rows.sparkSession)
        rows = rows.checkpoint(eager=True)
    extra = _narrow_enrichment(cat, rows, bank_key, full, selective)
    wide = rows.join(extra, _KEY, "left")
    out = wide.select(*_search_columns(full))
    if ordered:
        # O1: main party first (Oracle DESC puts NULLs first); the key columns
        # make the order total, so range partitioning of the sort stays even.
        out = out.orderBy(F.col("MAIN_CUSTOMER").desc_nulls_first(), "ID_SOLICITUD", "CUSTOMER_NO")
    return out


def _all_in_order(cat: Catalog, where: Column) -> DataFrame:
    """The profile's rows that ``where`` holds for with every description, main party first.

    They meet their descriptions and are sorted as the profile stores them; the wide rows are computed behind the sort, not also in
    its sampling pass and in the shuffle."""
    stored, widened = cat.profile_rows()
    extra = _narrow_enrichment(cat, cat.profile().filter(where), full=True)
    found = stored.withColumn("__row", F.struct(*stored.columns))
    found = widened(found, "__row").filter(where).select("__row.*", F.col("MAIN_CUSTOMER").alias("__main"))
    found = found.join(extra, _KEY, "left").orderBy(F.col("__main").desc_nulls_first(), "ID_SOLICITUD", "CUSTOMER_NO")
    return widened(found, *[c for c in extra.columns if c not in _KEY]).select(*_search_columns(True))


def search_profiles(cat: Catalog, customer_no=None, application=None, core_id=None,
                    ordered: bool = True) -> DataFrame:
    """Optional-parameter search over non-group profiles, main party first."""
    where = (opt_eq(F.col("CUSTOMER_NO"), customer_no) & opt_eq(F.col("ID_SOLICITUD"), application)
             & (F.col("LMT_CUSTOMER_TYPE") != "G") & opt_eq_null(F.col("CUSTOMER_NO_FCC"), core_id))
    selective = customer_no is not None or application is not None or core_id is not None
    if ordered and not selective:
        return _all_in_order(cat, where)
    return enrich(cat, cat.profile().filter(where), full=True, ordered=ordered, selective=selective)


def latest_application(cat: Catalog) -> DataFrame:
    """Latest completed application of every core id, with its local number.

    'Completed' = application status F; latest by (date, application id,
    local number).  Partial aggregation (``max_by``) keeps hot ids cheap.
    """
    p = cat.profile().filter(F.col("CUSTOMER_NO_FCC").isNotNull()).select(
        "ID_SOLICITUD", "CUSTOMER_NO", "CUSTOMER_NO_FCC")
    apps = cat.table("wf_application").filter(F.col("STATUS") == "F").select("ID_SOLICITUD", "FECHA")
    return latest_per_key(p.join(apps, "ID_SOLICITUD"), ["CUSTOMER_NO_FCC"],
                          ["FECHA", "ID_SOLICITUD", "CUSTOMER_NO"], ["ID_SOLICITUD", "CUSTOMER_NO", "FECHA"])


def search_recent(cat: Catalog, core_id=None, ordered: bool = True) -> DataFrame:
    """The profile of each core id in its latest completed application."""
    latest = latest_application(cat)
    if core_id is not None:
        latest = latest.filter(F.col("CUSTOMER_NO_FCC") == core_id)
    rows = cat.profile().filter(F.col("LMT_CUSTOMER_TYPE") != "G").join(
        latest.select("ID_SOLICITUD", "CUSTOMER_NO"), ["ID_SOLICITUD", "CUSTOMER_NO"], "left_semi")
    return enrich(cat, rows, full=False, ordered=ordered, bank_key="concat", selective=True)
