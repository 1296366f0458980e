"""DuckDB oracle SQL for the export actions (3 and 4)."""

from __future__ import annotations

from profilebook.registry.sqlkit import listagg, ncat, with_tables

AS_OF_DATE = "DATE '2024-02-01'"


def ids_cte(scope: str = "true") -> str:
    """W2 + W3 in one pass over the keys: ``ids`` (ID_SOLICITUD, CUSTOMER_NO, FIRST_ID after W2, NEW_ID after W3).

    Numbers go on from the largest issued one, first for rows without an id, then for failed ones, each in key order."""
    failed = "ID_EXISTE_FCC = '0' AND coalesce(ID_STATUS_FCC, 0) = 0 AND CHK_CREATE_FCC = 1"
    number = "'CUS' || lpad(CAST({} AS VARCHAR), 13, '0')"
    return (
        "ids AS MATERIALIZED (SELECT ID_SOLICITUD, CUSTOMER_NO, "
        f"CASE WHEN missing THEN {number.format('issued + m_before')} ELSE ID_CUSTOMER_FCC END AS FIRST_ID, "
        f"CASE WHEN failed THEN {number.format('issued + m_all + f_before')} WHEN missing THEN {number.format('issued + m_before')} "
        "ELSE ID_CUSTOMER_FCC END AS NEW_ID FROM (SELECT *, count(*) FILTER (missing) OVER so_far AS m_before, "
        "count(*) FILTER (failed) OVER so_far AS f_before, count(*) FILTER (missing) OVER () AS m_all, "
        "coalesce(max(CASE WHEN regexp_full_match(ID_CUSTOMER_FCC, 'CUS[0-9]{13}') THEN CAST(substr(ID_CUSTOMER_FCC, 4) AS BIGINT) END) OVER (), 0) AS issued "
        f"FROM (SELECT ID_SOLICITUD, CUSTOMER_NO, ID_CUSTOMER_FCC, ({scope}) AND ID_CUSTOMER_FCC IS NULL AS missing, "
        f"({scope}) AND coalesce({failed}, false) AS failed FROM profile) "
        "WINDOW so_far AS (ORDER BY ID_SOLICITUD, CUSTOMER_NO)))")


def _ready(src: str = "profile") -> str:
    return f"ready AS (SELECT p.* REPLACE (ids.NEW_ID AS ID_CUSTOMER_FCC) FROM {src} p JOIN ids USING (ID_SOLICITUD, CUSTOMER_NO))"


def _td(col: str) -> str:
    return f"nullif(substr(rtrim(coalesce({col}, 'NA')), 1, 105), '')"


def _rating(part: int) -> str:
    inner = f"nullif(split_part(CUST.NAMEINTERNATIONALRISK, ' ', {part}), '')"
    return f"coalesce(nullif(split_part({inner}, ':', 2), ''), 'NC')"


def _yn(x: str) -> str:
    return f"CASE WHEN coalesce(CAST({x} AS VARCHAR), '0') = '1' THEN 'Y' ELSE 'N' END"


def oracle() -> dict[str, str]:
    q: dict[str, str] = {}
    contact = ncat("NAME", "' - '", "POSITION")
    dir_item = ncat("NAME", "' ('", "POSITION", "')'")
    ctes = [
        "info AS (SELECT ID_SOLICITUD AS app, min(coalesce(PURPOSE_ID, 0)) AS purpose FROM wf_lmt_customer_info GROUP BY 1)",
        ids_cte("ID_SOLICITUD IN (SELECT app FROM info)"), _ready(),
        "mc AS (SELECT ID_SOLICITUD, arg_min(CUSTOMER_NO_FCC, CUSTOMER_NO) AS core FROM profile "
        "WHERE MAIN_CUSTOMER = 1 AND RELACIONADO IS NULL GROUP BY 1)",
        "ct AS (SELECT ID_SOLICITUD, CUSTOMER_NO, max(CASE WHEN rn = 1 THEN t END) AS C1, max(CASE WHEN rn = 2 THEN t END) AS C2, "
        f"max(CASE WHEN rn = 3 THEN t END) AS C3 FROM (SELECT ID_SOLICITUD, CUSTOMER_NO, {contact} AS t, row_number() OVER ("
        "PARTITION BY ID_SOLICITUD, CUSTOMER_NO ORDER BY NAME, POSITION) AS rn FROM wf_directors WHERE TYPE = 3 "
        "AND NAME IS NOT NULL) GROUP BY 1, 2)",
        "ho AS (SELECT ID_SOLICITUD, CUSTOMER_NO, max(CASE WHEN rn = 1 THEN t END) AS H1, max(CASE WHEN rn = 2 THEN t END) AS H2, "
        "max(CASE WHEN rn = 3 THEN t END) AS H3 FROM (SELECT ID_SOLICITUD, CUSTOMER_NO, NAME || ' ' || CAST(PERCENTAGE AS VARCHAR) "
        "|| '%' AS t, row_number() OVER (PARTITION BY ID_SOLICITUD, CUSTOMER_NO ORDER BY PERCENTAGE DESC, NAME) AS rn "
        "FROM wf_shareholders WHERE PERCENTAGE > 20) GROUP BY 1, 2)",
        f"dc AS (SELECT ID_SOLICITUD, CUSTOMER_NO, {listagg('item', 'NAME, POSITION, item', ', ')} AS txt FROM ("
        f"SELECT *, {dir_item} AS item FROM wf_directors WHERE TYPE = 1 AND NAME IS NOT NULL) GROUP BY 1, 2)",
        "bt AS (SELECT LOV_DESC, min(LOV) AS LOV FROM fcc_lov WHERE FIELD_NAME = 'BANK TYPE' GROUP BY LOV_DESC)",
        "g1 AS (SELECT ID_SOLICITUD AS app, min(GROUP_CODE) AS gc FROM profile WHERE LIMIT_EXP_DATE = DATE '1980-01-01' "
        "AND LMT_CUSTOMER_TYPE = 'G' AND GROUP_CODE IS NOT NULL GROUP BY 1)",
        "g2 AS (SELECT ID_SOLICITUD AS app, min(GROUP_CODE) AS gc FROM wf_ec_rc_limits WHERE GROUP_CODE IS NOT NULL GROUP BY 1)",
    ]
    w = with_tables(["wf_lmt_customer_info", "wf_application", "wf_customer_type", "wf_directors", "wf_shareholders",
                     "fcc_lov", "wf_ec_rc_limits"], ctes, profile=True)
    q["export_customers"] = w + f"""SELECT CUST.ID_SOLICITUD, CUST.CUSTOMER_NO_FCC, CTYPE.CUSTOMER_TYPE AS CUSTOMER_TYPE, CUST.CUSTOMER_NAME1,
 CUST.FULLNAME, CUST.SHORT_NAME, CUST.CUSTOMER_CATEGORY, CUST.POSTALALINE1, CUST.POSTALALINE2, CUST.POSTALALINE3,
 CUST.POSTALACITY, CUST.RESIDENCECOUNTRY, CUST.NATIONALITYID, CUST.LANGUAGEID, CUST.DEFAULT_MEDIA, NULL::VARCHAR IDENT_NAME,
 NULL::VARCHAR ABACODEVALUE, CUST.EXPOSURE_COUNTRYID, CUST.RESIDENCELOCATIONID, CUST.RISK_RATING CRRATE,
 strftime({AS_OF_DATE}, '%Y%m%d') REVDT, NULL::VARCHAR OVRLIM, CUST.LIAB_ID, CUST.RISK_RATING,
 coalesce(g1.gc, g2.gc) AS GROUP_CODE, CUST.WEBSITE, CUST.TELEPHONENUMBER, CUST.PHYSICALALINE1, CUST.PHYSICALALINE2,
 CUST.PHYSICALALINE3, CASE WHEN CUST.INCORP_DATE IS NOT NULL THEN strftime(CUST.INCORP_DATE, '%Y%m%d') END INCORP_DATE,
 CUST.INCORP_COUNTRYID, coalesce(CUST.NETWORTH, 0) NETWORTH, CUST.INDUSTRY INDUSTRY_CODE, dc.txt DIREC_COMMITE, CUST.TAXIDNUMBER,
 CASE WHEN CUST.CUSTOMER_TYPE IN (2, 5, 7) THEN CUST.SWIFT_CODE ELSE NULL END SWIFT_CODE, CUST.ID_CUSTOMER_FCC,
 CUST.INTERNAL_CLASSIFICATION INTERNAL_CLASSIFICAT, {_rating(2)} S_AND_P_EXTERNAL_R_RAT, {_rating(3)} FITCH_EXTERNAL_R_RAT,
 {_rating(1)} MOODYS_EXTNL_R_RAT, CUST.ECONOMICGROUPRUC ECONOMIC_GROUP_RUC,
 coalesce(CASE WHEN CUST.BANKTYPE = 'NA' THEN CUST.BANKTYPE ELSE bt.LOV END, 'NA') BANK_TYPE,
 CASE WHEN info.purpose = 7 THEN 'NA' ELSE CUST.RELATIONTYPE END RELATION_TYPE, coalesce(CUST.TYPEOFLICENCE, 'NA') TYPE_OF_LICENSE,
 {_td('CUST.NAME_ADDRESS_LEGAL_ADVISOR')} RESIDENT_AGENT, coalesce(CUST.COMPLIANCEOFFICER, 'NA') COMPLIANCE_OFFICER,
 sol.GOVERMENT_TYPE, {_td('CUST.LEGALREPRESENTATIVE')} LEGAL_REPRESENTATIVE, {_td('CUST.NAMEEXTERNALAUDITORS')} EXTERNAL_AUDITORS,
 CUST.SUB_ECOGR_CD, {_td('CUST.ADDRESSPROCESSAGENTINUSA')} USA_PROCESS_AGENT, strftime(CUST.LIMIT_EXP_DATE, '%Y%m%d') LIMIT_EXP_DATE,
 CUST.DV DIGITO_VERIFICADOR, CUST.TELEPHONENUMBER2 TEL_2_PANAMA,
 CASE WHEN CUST.NY_AGENCY = '1' THEN CUST.AML_RATINGID_NY ELSE CUST.AML_RATINGID END AML_RISK_RATING,
 ct.C1 CONTACT_1, ct.C2 CONTACT_2, ct.C3 CONTACT_3, ho.H1 SHAREHOLD_MORE_20_PCT_1, ho.H2 SHAREHOLD_MORE_20_PCT_2,
 ho.H3 SHAREHOLD_MORE_20_PCT_3,
 CASE WHEN strftime(CUST.LIMIT_EXP_DATE, '%Y%m%d') = '19800101' THEN NULL ELSE mc.core END CLIENTE_PRINCIPAL,
 CUST.CUSTOMER_NO SEC_UNICO_CUST_GRID,
 CASE WHEN CUST.NY_AGENCY = '1' THEN 'YES' WHEN CUST.NY_AGENCY = '0' THEN 'NO' END CUST_CAN_BE_USE_NY_AGENCY,
 CUST.ACCOUNT_OFFICERID ACCOUNT_OFFICER, CUST.LOCATIONID LOCATION,
 CASE WHEN CUST.SALES_MORE_30_PERCENT = '1' THEN 'SI' ELSE 'NO' END CLIENTE_EXP_30PCT_VTAS_O_MAS,
 CUST.EXPORT_SHARE PORCENTAJE_DE_EXPORTACIONES, CUST.FAXNUMBER, CUST.MAIN_CUSTOMER, CUST.EMAIL, CUST.LMT_CUSTOMER_TYPE,
 NULL::VARCHAR USUARIO_ULT_CIF, strftime(CUST.FECHA_KYC, '%Y%m%d') LAST_KYC_DATE, strftime({AS_OF_DATE}, '%Y%m%d') INCEPTION_DATE,
 {_yn('CUST.CUSTOMER_CLASSIFICATION_PEP')} IS_PEP, CUST.TIPO_DE_CLIENTE "TIPO DE CLIENTE", CUST.INTERNAL_CONTROL,
 CUST.CO_COVENANTS "COVENANTS CIF", CUST.CO_DEUDOR_PRINCIPAL RELATED_CUSTOMER,
 CASE CUST.CHK_CONTR_APROB_VF WHEN 1 THEN 'SI' ELSE 'NO' END CONTR_APROB_VF_1, CUST.CINU COD_ACTIVIDAD_CINU,
 CUST.CO_ESG_RATING RATING_ESG, strftime(CUST.DATE_ESG_RATING, '%Y-%m-%d') DATE_ESG, CUST.CO_CLIENT_BETTER_COUNTRY CTE_MEJOR_PAIS,
 CUST.CO_RISK_CUST_TYPE TIPO_CLIENTE_RIESGO, CUST.CO_OFICINA_GESTION OFICINA_DE_GESTION, CUST.PROBABILITY_DEFAULT PF_PD,
 CUST.LOSS_GIVEN_DEFAULT PF_LGD, {_yn('CUST.PROJECT_FINANCE')} PF_INDICATOR,
 CASE WHEN CUST.GROUP_EXPIRATION_MONTH < 10 THEN '0' || CAST(CUST.GROUP_EXPIRATION_MONTH AS VARCHAR)
      ELSE CAST(CUST.GROUP_EXPIRATION_MONTH AS VARCHAR) END KYC_REVISION_MONTH
FROM ready CUST JOIN wf_customer_type CTYPE ON CUST.CUSTOMER_TYPE = CTYPE.CUSTOMER_ID
JOIN info ON info.app = CUST.ID_SOLICITUD
LEFT JOIN wf_application sol ON sol.ID_SOLICITUD = CUST.ID_SOLICITUD
LEFT JOIN mc ON mc.ID_SOLICITUD = CUST.ID_SOLICITUD
LEFT JOIN ct ON ct.ID_SOLICITUD = CUST.ID_SOLICITUD AND ct.CUSTOMER_NO = CUST.CUSTOMER_NO
LEFT JOIN ho ON ho.ID_SOLICITUD = CUST.ID_SOLICITUD AND ho.CUSTOMER_NO = CUST.CUSTOMER_NO
LEFT JOIN dc ON dc.ID_SOLICITUD = CUST.ID_SOLICITUD AND dc.CUSTOMER_NO = CUST.CUSTOMER_NO
LEFT JOIN bt ON bt.LOV_DESC = CUST.BANKTYPE
LEFT JOIN g1 ON g1.app = CUST.ID_SOLICITUD LEFT JOIN g2 ON g2.app = CUST.ID_SOLICITUD
WHERE (CUST.ID_EXISTE_FCC = '0' OR CUST.ID_EXISTE_FCC IS NULL) AND coalesce(CUST.ID_STATUS_FCC, 0) = 0
 AND CUST.CHK_CREATE_FCC = 1 AND CUST.LMT_CUSTOMER_TYPE <> 'G'"""
    gctes = [
        "tm AS (SELECT p.ID_SOLICITUD, arg_min(k.CUSTOMER_TYPE, p.CUSTOMER_NO) AS kt, arg_min(p.CUSTOMER_TYPE, p.CUSTOMER_NO) AS t, "
        "arg_min(p.CUSTOMER_CATEGORY, p.CUSTOMER_NO) AS c, arg_min(p.INDUSTRY, p.CUSTOMER_NO) AS i FROM profile p "
        "JOIN wf_customer_type k ON k.CUSTOMER_ID = p.CUSTOMER_TYPE WHERE p.MAIN_CUSTOMER = 1 GROUP BY 1)",
        "scope AS (SELECT ID_SOLICITUD AS app FROM tm)",
        "copied AS (SELECT p.* REPLACE (CASE WHEN p.LMT_CUSTOMER_TYPE = 'G' AND tm.ID_SOLICITUD IS NOT NULL THEN tm.t ELSE p.CUSTOMER_TYPE END "
        "AS CUSTOMER_TYPE, CASE WHEN p.LMT_CUSTOMER_TYPE = 'G' AND tm.ID_SOLICITUD IS NOT NULL THEN tm.c ELSE p.CUSTOMER_CATEGORY END "
        "AS CUSTOMER_CATEGORY, CASE WHEN p.LMT_CUSTOMER_TYPE = 'G' AND tm.ID_SOLICITUD IS NOT NULL THEN tm.i ELSE p.INDUSTRY END "
        "AS INDUSTRY, CASE WHEN p.LMT_CUSTOMER_TYPE = 'G' AND tm.ID_SOLICITUD IS NOT NULL THEN DATE '1990-01-01' ELSE p.FECHA_KYC END "
        "AS FECHA_KYC) FROM profile p LEFT JOIN tm ON tm.ID_SOLICITUD = p.ID_SOLICITUD)",
        ids_cte("ID_SOLICITUD IN (SELECT app FROM scope)"), _ready("copied"),
        "mv AS (SELECT ID_SOLICITUD, arg_min(ACCOUNT_OFFICERID, CUSTOMER_NO) AS o, arg_min(LOCATIONID, CUSTOMER_NO) AS l, "
        "arg_min(RESIDENCELOCATIONID, CUSTOMER_NO) AS r FROM profile WHERE MAIN_CUSTOMER = 1 GROUP BY 1)",
    ]
    wg = with_tables(["wf_customer_type"], gctes, profile=True)
    q["export_groups"] = wg + f"""SELECT CUST.ID_SOLICITUD, CUST.CUSTOMER_NO_FCC, CTYPE.CUSTOMER_TYPE AS CUSTOMER_TYPE, CUST.CUSTOMER_NAME1,
 CUST.FULLNAME, CUST.SHORT_NAME, CUST.CUSTOMER_CATEGORY, CUST.POSTALALINE1, CUST.POSTALALINE2, CUST.POSTALALINE3, CUST.POSTALACITY,
 CUST.RESIDENCECOUNTRY, CUST.NATIONALITYID, CUST.LANGUAGEID, 'MAIL' AS DEFAULT_MEDIA, NULL::VARCHAR IDENT_NAME,
 NULL::VARCHAR ABACODEVALUE, CUST.EXPOSURE_COUNTRYID, mv.r RESIDENCELOCATIONID, NULL::VARCHAR CRRATE,
 strftime({AS_OF_DATE}, '%Y%m%d') REVDT, NULL::VARCHAR OVRLIM, CUST.LIAB_ID, CUST.RISK_RATING, NULL::VARCHAR GROUP_CODE,
 'NA' WEBSITE, 'NA' TELEPHONENUMBER, CUST.PHYSICALALINE1, CUST.PHYSICALALINE2, CUST.PHYSICALALINE3,
 CASE WHEN CUST.INCORP_DATE IS NOT NULL THEN strftime(CUST.INCORP_DATE, '%Y%m%d') END INCORP_DATE, CUST.INCORP_COUNTRYID,
 coalesce(CUST.NETWORTH, 0) NETWORTH, CUST.INDUSTRY INDUSTRY_CODE, CUST.TAXIDNUMBER,
 CASE WHEN CUST.CUSTOMER_TYPE IN (2, 5, 7) THEN CUST.SWIFT_CODE ELSE NULL END SWIFT_CODE, CUST.ID_CUSTOMER_FCC,
 'NA' INTERNAL_CLASSIFICAT, 'NC' S_AND_P_EXTERNAL_R_RAT, 'NC' FITCH_EXTERNAL_R_RAT, 'NC' MOODYS_EXTNL_R_RAT,
 'NA' ECONOMIC_GROUP_RUC, 'NA' BANK_TYPE, 'NA' RELATION_TYPE, 'NA' TYPE_OF_LICENSE, 'NA' RESIDENT_AGENT, 'NA' COMPLIANCE_OFFICER,
 'NA' GOVERMENT_TYPE, 'NA' LEGAL_REPRESENTATIVE, 'NA' EXTERNAL_AUDITORS, CUST.SUB_ECOGR_CD, 'NA' USA_PROCESS_AGENT,
 strftime(CUST.LIMIT_EXP_DATE, '%Y%m%d') LIMIT_EXP_DATE, NULL::VARCHAR DIGITO_VERIFICADOR, NULL::VARCHAR TEL_2_PANAMA,
 'NA' AML_RISK_RATING, NULL::VARCHAR CONTACT_1, NULL::VARCHAR CONTACT_2, NULL::VARCHAR CONTACT_3,
 NULL::VARCHAR SHAREHOLD_MORE_20_PCT_1, NULL::VARCHAR "SHAREHOLD MORE_20_PCT_2", NULL::VARCHAR "SHAREHOLD MORE_20_PCT_3",
 CUST.CUSTOMER_NO SEC_UNICO_CUST_GRID, mv.o ACCOUNT_OFFICER, mv.l LOCATION, NULL::VARCHAR DIREC_COMMITE,
 NULL::VARCHAR CLIENTE_PRINCIPAL, 'NO' CUST_CAN_BE_USE_NY_AGENCY, NULL::VARCHAR CLIENTE_EXP_30PCT_VTAS_O_MAS,
 NULL::VARCHAR PORCENTAJE_DE_EXPORTACIONES, NULL::VARCHAR CONTR_APROB_VF_1, NULL::VARCHAR FAXNUMBER, NULL::INT MAIN_CUSTOMER,
 NULL::VARCHAR EMAIL, CUST.LMT_CUSTOMER_TYPE, NULL::VARCHAR USUARIO_ULT_CIF, strftime(CUST.FECHA_KYC, '%Y%m%d') LAST_KYC_DATE,
 strftime({AS_OF_DATE}, '%Y%m%d') INCEPTION_DATE, {_yn('CUST.CUSTOMER_CLASSIFICATION_PEP')} IS_PEP
FROM ready CUST JOIN scope ON scope.app = CUST.ID_SOLICITUD JOIN wf_customer_type CTYPE ON CUST.CUSTOMER_TYPE = CTYPE.CUSTOMER_ID
LEFT JOIN mv ON mv.ID_SOLICITUD = CUST.ID_SOLICITUD
WHERE coalesce(CUST.ID_EXISTE_FCC, '0') = '0' AND coalesce(CUST.ID_STATUS_FCC, 0) = 0
 AND CUST.LIMIT_EXP_DATE = DATE '1980-01-01' AND CUST.CHK_CREATE_FCC = 1 AND CUST.LMT_CUSTOMER_TYPE = 'G'"""
    return q
