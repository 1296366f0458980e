"""DuckDB oracle SQL for the search family."""

from __future__ import annotations

from profilebook.registry.sqlkit import fmt_mon, listagg, ncat, number_text, with_tables

_SEARCH_TABLES = ["fcc_userdef", "fcc_lov", "fcc_customer", "fcc_mis_code", "wf_customer_type", "wf_dflt_media",
                  "fcc_customer_cat", "wf_lmt_customer_type", "wf_sbp_category", "fcc_country", "fcc_location",
                  "fcc_language", "wf_directors", "wf_shareholders", "wf_lmt_customer", "wf_application"]


def _ctes(bank_key: str) -> list[str]:
    dir_item = ncat("NAME", "' ('", "POSITION", "')'")
    hold_item = "NAME || ' ' || CAST(PERCENTAGE AS VARCHAR) || '%'"
    if bank_key == "prefix":
        bt_src = "SELECT substr(REC_KEY, 1, 9) AS core, min(FIELD_VAL_7) AS code FROM fcc_userdef WHERE FUNCTION_ID = 'STDCIF' GROUP BY 1"
    else:
        bt_src = "SELECT REC_KEY AS core, min(FIELD_VAL_7) AS code FROM fcc_userdef GROUP BY 1"
    return [
        "mp AS (SELECT ID_SOLICITUD, min(CUSTOMER_NO) AS MAIN_NO FROM profile "
        "WHERE MAIN_CUSTOMER = 1 AND RELACIONADO IS NULL GROUP BY ID_SOLICITUD)",
        f"dirs AS (SELECT ID_SOLICITUD, CUSTOMER_NO, TYPE, {listagg('item', 'NAME, POSITION, item', ', ')} AS txt "
        f"FROM (SELECT *, {dir_item} AS item FROM wf_directors WHERE TYPE IN (1, 2) AND NAME IS NOT NULL) "
        "GROUP BY 1, 2, 3)",
        "people AS (SELECT ID_SOLICITUD, CUSTOMER_NO, max(CASE WHEN TYPE = 1 THEN txt END) AS BOARDOFDIRECTORS, "
        "max(CASE WHEN TYPE = 2 THEN txt END) AS TOPMANAGEMENT FROM dirs GROUP BY 1, 2)",
        f"holders AS (SELECT ID_SOLICITUD, CUSTOMER_NO, {listagg('item', 'NAME, PERCENTAGE, item', ', ')} "
        f"AS SHAREHOLDERS FROM (SELECT *, {hold_item} AS item FROM wf_shareholders) GROUP BY 1, 2)",
        "lm AS (SELECT ID_SOLICITUD, CUSTOMER_ID, count(*) AS n FROM wf_lmt_customer GROUP BY 1, 2)",
        "lov AS (SELECT FIELD_NAME, LOV, min(LOV_DESC) AS LOV_DESC FROM fcc_lov GROUP BY 1, 2)",
        f"bt AS (SELECT u.core, l.LOV_DESC AS BANKTYPE_DESC FROM ({bt_src}) u "
        "LEFT JOIN lov l ON l.FIELD_NAME = 'BANK_TYPE' AND l.LOV = u.code)",
        "dp AS (SELECT CUSTOMER_NO, min(CUSTOMER_NAME1) AS name FROM fcc_customer GROUP BY 1)",
        "chain AS (SELECT trim(t.CO_CUSTOMER_TYPE) AS ctype, k.CUSTOMER_ID AS kid, k.CUSTOMER_DESCRIPTION AS kdesc "
        "FROM wf_lmt_customer_type t LEFT JOIN wf_customer_type k ON k.CUSTOMER_ID = t.CO_CUSTOMER_TYPE_KCC)",
    ]


def _select(full: bool) -> str:
    cols = [
        "c.ID_SOLICITUD", "c.CUSTOMER_NO", "c.SHAREHOLDER", "coalesce(c.CUSTOMER_TYPE, clt.kid) AS CUSTOMER_TYPE",
        "c.CUSTOMER_NAME1", "c.FULLNAME", "c.TAXIDNUMBER", "c.DV", "c.CUSTOMER_CATEGORY", "c.RELATIONTYPE",
        "c.INDUSTRY", "c.NAMEOFECONOMICGROUP", "c.LEGALREPRESENTATIVE", "c.NAMEEXTERNALAUDITORS",
        "c.NAMEINTERNATIONALRISK", "c.POSTALALINE1", "c.POSTALALINE2", "c.POSTALALINE3", "c.POSTALACITY",
        "c.PHYSICALALINE1", "c.PHYSICALALINE2", "c.PHYSICALALINE3", "c.TELEPHONENUMBER", "c.TELEPHONENUMBER2",
        "c.FAXNUMBER", "c.WEBSITE", "c.DEFAULT_MEDIA", "c.INCORP_COUNTRYID",
        f"{fmt_mon('c.INCORP_DATE')} AS INCORP_DATE", "c.RESIDENCECOUNTRY", "c1.DESCRIPTION AS RESCTRY_DESC",
        "c.NATIONALITYID", "c2.DESCRIPTION AS NATIONALITYIDDESCR", "c.RESIDENCELOCATIONID",
        "rl.DESCRIPTION AS RESLOC_DESC", "c.LANGUAGEID", "lang.LANG_NAME AS LANGUAGEID_DESC", "c.BANKTYPE",
        "c.TYPEOFLICENCE", "c.SWIFT_CODE", "c.ABACODEVALUE", "c.COMPLIANCEOFFICER", "c.ADDRESSPROCESSAGENTINUSA",
        f"{number_text('c.NETWORTH')} AS NETWORTH", "c.EXPOSURE_COUNTRYID", "c3.DESCRIPTION AS EXPCTRY_DESC",
        f"{fmt_mon('c.INCEPTION_DATE')} AS INCEPTION_DATE", "c.PRODUCT_SERVICE_OFFERED", "c.RELATEDCOMPANIES",
        "c.EMAIL", "c.NAME_ADDRESS_LEGAL_ADVISOR", "c.REFERENCE_BANKING_COMMERCIAL AS REFERENCE_BANKING_COMME",
        "c.NAME_OF_STOCK", "c.COUNTRIES_WHERE_OFFERS", "c.REGULATORY_AUTHORITY", "c.RELATEDACCOUNT",
        "c4.DESCRIPTION AS INCORP_CNTRY_DESC", "c.MAIN_CUSTOMER", "ind.CODE_DESC AS INDUSTRY_DESC",
        ncat("c.TELEPHONENUMBER", "'|'", "c.TELEPHONENUMBER2", "'|'", "c.FAXNUMBER", "'|'", "c.WEBSITE", "'|'",
             "c.EMAIL") + " AS TELFAXWEBEMAIL",
        "nullif(rtrim(" + ncat("c.POSTALALINE1", "' '", "c.POSTALALINE2", "' '", "c.POSTALALINE3", "' '",
                               "c.POSTALACITY", "' | '", "c.PHYSICALALINE1", "' '", "c.PHYSICALALINE2", "' '",
                               "c.PHYSICALALINE3") + "), '') AS ADDRESS",
        "pe.BOARDOFDIRECTORS", "pe.TOPMANAGEMENT", "c.CUSTOMER_NO_FCC", "c.SHORT_NAME", "c.LIAB_ID", "c.GROUP_CODE",
        "c.ID_SOLICITUD_LM", "c.ACCOUNT_OFFICERID", "c.ADDRESSPROCESSAGENTINUSA AS USA_PROCESS_AGENT",
        "coalesce(ct.CUSTOMER_DESCRIPTION, clt.kdesc) AS CUSTOMER_TYPE_DESC", "c.ID_EXISTE_FCC",
        "bt.BANKTYPE_DESC", "c.LOCATIONID", "c.AML_RATINGID", "dem.DESCRIPTION AS DEFAULT_MEDIA_DESC",
        "c.NY_AGENCY", "c.SBP_CATEGORYID", "udfd2.LOV_DESC AS RELATIONTYPE_DESC", "c.CUSTOMER_CLASSIFICATION_PEP",
        "c.DESCRIPCION_PEP", "ccat.CUST_CAT_DESC AS CUSTOMER_CATEGORY_DESC", "c.INCORPORATION_PURPOSE",
        "accoffi.CODE_DESC AS OFFICER_DESCRIPTION", "c.SUB_ECOGR_CD", "loc.CODE_DESC AS LOCATION_DESCRIPTION",
        "aml.LOV_DESC AS AML_DESCRIPTION", "c.ECONOMICGROUPRUC", "sbp.CATEGORY_DESCRIPCION AS SBP_CATEGORY_DESCRIPTION",
        "c.LEGALREPRESENTATIVE_INFO", "c.LAST_CHANGE_DATE", "c.DIGNATARIES", "c.POWER_DEES", "c.CHK_CREATE_FCC",
        "c.AUTHORIZED_SIGNATURES", "c.RELATION_CORRESPONSAL", "c.CHK_SAMESHOLDERS_MAINCUST", "ho.SHAREHOLDERS",
    ]
    if full:
        cols += [
            "c.SALES_MORE_30_PERCENT", "c.EXPORT_SHARE", "c.CUSTOMER_TYPE AS REAL_CUSTOMER_TYPE", "c.AML_RATINGID_NY",
            "nyc.LOV_DESC AS AML_DESCRIPTION_NY", "c.RELACIONADO", "c.ID_MAIN_CUSTOMER", "c.PUBLIC_TRADE_COMP",
            f"{fmt_mon('c.PATRIOT_EXC_DATE')} AS PATRIOT_EXC_DATE", f"{fmt_mon('c.AML_EXC_DATE')} AS AML_EXC_DATE",
            "coalesce(lm.n, 0) AS ES_DE_LIMITE", "c.GIIN_NUMBER", f"{fmt_mon('c.W8_FORM_DATE')} AS W8_FORM_DATE",
            "CASE WHEN c.NY_AGENCY = '1' THEN c.AML_RATINGID_NY WHEN c.NY_AGENCY = '0' THEN c.AML_RATINGID END "
            "AS AML_RATING",
            "c.FECHA_INTEG_BSARADAR", f"{fmt_mon('c.FECHA_KYC')} AS FECHA_KYC", "tdc.LOV_DESC AS TIPO_DE_CLIENTE",
            "tdc.LOV AS TIPO_DE_CLIENTE_CODE", "ic.LOV_DESC AS INTERNAL_CONTROL", "ic.LOV AS INTERNAL_CONTROL_CODE",
            "c.NEGATIVE_NEWS", "c.SANCTIONS", "cov.LOV_DESC AS COVENANTS_DESC", "cov.LOV AS COVENANTS_CODE",
            "dp.name AS DEUDOR_PRINCIPAL_DESC", "dp.CUSTOMER_NO AS DEUDOR_PRINCIPAL_CODE", "c.CHK_CONTR_APROB_VF",
            "c.CINU", "cinu.LOV_DESC AS CINU_DESC", "c.CO_OFICINA_GESTION", "ofi.LOV_DESC AS DESC_OFICINA_GESTION",
        ]
    cols.append("c.GROUP_EXPIRATION_MONTH")
    return ",\n  ".join(cols)


def _joins(bank_key: str) -> str:
    bt_on = "bt.core = c.CUSTOMER_NO_FCC" if bank_key == "prefix" else "bt.core = CAST(c.CUSTOMER_NO AS VARCHAR) || '~'"
    party = "CASE WHEN c.CHK_SAMESHOLDERS_MAINCUST = '1' THEN coalesce(mp.MAIN_NO, 0) ELSE c.CUSTOMER_NO END"
    return f"""
LEFT JOIN mp ON mp.ID_SOLICITUD = c.ID_SOLICITUD
LEFT JOIN people pe ON pe.ID_SOLICITUD = c.ID_SOLICITUD AND pe.CUSTOMER_NO = {party}
LEFT JOIN holders ho ON ho.ID_SOLICITUD = c.ID_SOLICITUD AND ho.CUSTOMER_NO = {party}
LEFT JOIN lm ON lm.ID_SOLICITUD = c.ID_SOLICITUD_LM AND lm.CUSTOMER_ID = c.CUSTOMER_NO
LEFT JOIN bt ON {bt_on}
LEFT JOIN dp ON dp.CUSTOMER_NO = c.CO_DEUDOR_PRINCIPAL
LEFT JOIN fcc_mis_code ind ON ind.MIS_CODE = c.INDUSTRY
LEFT JOIN wf_customer_type ct ON ct.CUSTOMER_ID = c.CUSTOMER_TYPE
LEFT JOIN wf_dflt_media dem ON dem.MEDIA = c.DEFAULT_MEDIA
LEFT JOIN lov udfd2 ON udfd2.FIELD_NAME = 'RELATION_TYPE' AND udfd2.LOV = c.RELATIONTYPE
LEFT JOIN fcc_customer_cat ccat ON ccat.CUST_CAT = c.CUSTOMER_CATEGORY AND ccat.RECORD_STAT = 'O' AND ccat.AUTH_STAT = 'A'
LEFT JOIN chain clt ON clt.ctype = trim(c.LMT_CUSTOMER_TYPE)
LEFT JOIN fcc_mis_code accoffi ON accoffi.MIS_CODE = c.ACCOUNT_OFFICERID
LEFT JOIN fcc_mis_code loc ON loc.MIS_CODE = c.LOCATIONID
LEFT JOIN lov aml ON aml.FIELD_NAME = 'AML_RISK_RATING' AND aml.LOV = c.AML_RATINGID
LEFT JOIN wf_sbp_category sbp ON sbp.CATEGORYID = c.SBP_CATEGORYID
LEFT JOIN lov nyc ON nyc.FIELD_NAME = 'AML_RISK_RATING' AND nyc.LOV = c.AML_RATINGID_NY
LEFT JOIN lov tdc ON tdc.FIELD_NAME = 'TIPO DE CLIENTE' AND tdc.LOV = c.TIPO_DE_CLIENTE
LEFT JOIN lov ic ON ic.FIELD_NAME = 'INTERNAL_CONTROL' AND ic.LOV = c.INTERNAL_CONTROL
LEFT JOIN lov cov ON cov.FIELD_NAME = 'COVENANTS CIF' AND cov.LOV = c.CO_COVENANTS
LEFT JOIN lov cinu ON cinu.FIELD_NAME = 'COD_ACTIVIDAD_CINU' AND cinu.LOV = c.CINU
LEFT JOIN lov ofi ON ofi.FIELD_NAME = 'OFICINA_DE_GESTION' AND ofi.LOV = c.CO_OFICINA_GESTION
LEFT JOIN fcc_country c1 ON c1.COUNTRY_CODE = c.RESIDENCECOUNTRY
LEFT JOIN fcc_country c2 ON c2.COUNTRY_CODE = c.NATIONALITYID
LEFT JOIN fcc_country c3 ON c3.COUNTRY_CODE = c.EXPOSURE_COUNTRYID
LEFT JOIN fcc_country c4 ON c4.COUNTRY_CODE = c.INCORP_COUNTRYID
LEFT JOIN fcc_location rl ON rl.LOC_CODE = c.RESIDENCELOCATIONID
LEFT JOIN fcc_language lang ON lang.LANG_CODE = c.LANGUAGEID
"""


def search_sql(where: str, full: bool = True, rows_cte: str | None = None, bank_key: str = "prefix") -> str:
    rows = rows_cte or f"rows AS (SELECT * FROM profile WHERE {where})"
    head = with_tables(_SEARCH_TABLES, _ctes(bank_key) + [rows], profile=True)
    return f"{head}SELECT\n  {_select(full)}\nFROM rows c{_joins(bank_key)}"


LATEST_APP_CTE = (
    "latest AS (SELECT CUSTOMER_NO_FCC, ID_SOLICITUD, CUSTOMER_NO, FECHA FROM ("
    "SELECT p.CUSTOMER_NO_FCC, p.ID_SOLICITUD, p.CUSTOMER_NO, a.FECHA, row_number() OVER ("
    "PARTITION BY p.CUSTOMER_NO_FCC ORDER BY a.FECHA DESC, p.ID_SOLICITUD DESC, p.CUSTOMER_NO DESC) AS rn "
    "FROM profile p JOIN wf_application a ON a.ID_SOLICITUD = p.ID_SOLICITUD "
    "WHERE a.STATUS = 'F' AND p.CUSTOMER_NO_FCC IS NOT NULL) WHERE rn = 1)"
)


def oracle() -> dict[str, str]:
    base = "CUSTOMER_NO IS NOT NULL AND ID_SOLICITUD IS NOT NULL AND LMT_CUSTOMER_TYPE <> 'G'"
    recent_rows = (LATEST_APP_CTE + ",\nrows AS (SELECT p.* FROM profile p WHERE p.LMT_CUSTOMER_TYPE <> 'G' AND EXISTS ("
                   "SELECT 1 FROM latest l WHERE l.ID_SOLICITUD = p.ID_SOLICITUD AND l.CUSTOMER_NO = p.CUSTOMER_NO))")
    return {
        "profile_search_all": search_sql(base),
        "profile_search_by_app": search_sql(base.replace("ID_SOLICITUD IS NOT NULL", "ID_SOLICITUD = 4711")),
        "profile_search_by_core": search_sql(base + " AND CUSTOMER_NO_FCC = 'C00000007'"),
        "profile_search_by_customer": search_sql(base + " AND CUSTOMER_NO = 47110000000"),
        "search_recent": search_sql("", full=False, rows_cte=recent_rows, bank_key="concat"),
    }
