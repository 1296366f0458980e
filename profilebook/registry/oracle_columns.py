"""DuckDB oracle SQL for the catalogue/risk plans and the column-function reports."""

from __future__ import annotations

from profilebook.registry.sqlkit import (fmt_compact, fmt_dmy, fmt_iso, fmt_mon, ncat, number_text,
                                         with_tables)

KEY = "ID_SOLICITUD, CUSTOMER_NO"


def _p(select: str, tables: list[str] | None = None, ctes: list[str] | None = None, src: str = "profile") -> str:
    return with_tables(tables or [], ctes, profile=True) + f"SELECT {select} FROM {src}"


def _sticky(d: str, n: str) -> str:
    plain = f"CAST({d} + to_months({n}) AS DATE)"
    return f"CASE WHEN {d} = last_day({d}) THEN last_day({plain}) ELSE {plain} END"


def _month_end(y: str, m: str) -> str:
    return f"CASE WHEN {m} BETWEEN 1 AND 12 THEN last_day(make_date(CAST({y} AS INT), CAST({m} AS INT), 1)) END"


def _rating(expr: str, part: int) -> str:
    inner = f"nullif(split_part({expr}, ' ', {part}), '')"
    return f"coalesce(nullif(split_part({inner}, ':', 2), ''), 'NC')"


def _months() -> str:
    return ("months AS (SELECT CAST(i AS INT) AS CODIGO, upper(strftime(CAST(DATE '2000-12-01' + to_months(CAST(i AS INT)) "
            "AS DATE), '%B')) AS DESCRIPCION FROM range(1, 13) t(i))")


def expiry_sql(month: str, signing: str, years: str) -> str:
    y = f"year({signing})"
    first = _month_end(y, month)
    target = (f"CASE WHEN month({signing}) = {month} THEN {y} + {years} "
              f"WHEN date_diff('day', {signing}, {first}) > 90 THEN {y} + {years} - 1 ELSE {y} + {years} END")
    with_month = _month_end(target, month)
    no_month = _sticky(f"({signing} + 1)", f"{years} * 12")
    return f"CASE WHEN {month} IS NULL THEN {no_month} ELSE {with_month} END"


def _master_fields() -> str:
    return ("SELECT m.*, u.*, corp.INCORP_COUNTRY FROM fcc_customer m "
            "LEFT JOIN (SELECT *, substr(REC_KEY, 1, 9) AS core FROM fcc_userdef WHERE FUNCTION_ID = 'STDCIF') u "
            "ON u.core = m.CUSTOMER_NO LEFT JOIN fcc_corporate corp ON corp.CUSTOMER_NO = m.CUSTOMER_NO")


def _ctype(seg: str, letter: str) -> str:
    up = f"upper({letter})"

    def pair(c, b):
        return f"CASE WHEN {up} = 'C' THEN {c} WHEN {up} = 'B' THEN {b} END"
    return (f"CAST(CASE WHEN {seg} IS NULL THEN {pair(1, 2)} WHEN {seg} = '02' THEN {pair(4, 5)} "
            f"WHEN {seg} = '07' THEN {pair(6, 7)} ELSE {pair(1, 2)} END AS INT)")


def _limit_type(t: str) -> str:
    return f"CASE WHEN CAST({t} AS VARCHAR) IN ('4', '5') THEN 'E' ELSE 'C' END"


def _yes_no(x: str) -> str:
    return f"CASE WHEN coalesce(CAST({x} AS VARCHAR), '0') = '1' THEN 'Y' ELSE 'N' END"


def oracle() -> dict[str, str]:
    q: dict[str, str] = {}
    q["risk_list"] = _p("ID_SOLICITUD, CUSTOMER_NO, CUSTOMER_NO_FCC, CUSTOMER_NAME1, PROJECT_FINANCE, "
                        "coalesce(PROBABILITY_DEFAULT, 0) AS PROBABILITY_DEFAULT, "
                        "coalesce(LOSS_GIVEN_DEFAULT, 0) AS LOSS_GIVEN_DEFAULT", src="profile WHERE LMT_CUSTOMER_TYPE <> 'G'")
    latest = ("req AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY MODO, ID_SOLICITUD, CUSTOMER_ID "
              "ORDER BY REQ_ID DESC) AS rn FROM wf_risk_request WHERE MODO IN (1, 2, 3)) WHERE rn = 1)")
    q["mode_update"] = _p(
        "p.ID_SOLICITUD, p.CUSTOMER_NO, CASE WHEN r1.REQ_ID IS NOT NULL THEN r1.PF ELSE p.PROJECT_FINANCE END AS PROJECT_FINANCE, "
        "CASE WHEN r2.REQ_ID IS NOT NULL THEN r2.PD ELSE p.PROBABILITY_DEFAULT END AS PROBABILITY_DEFAULT, "
        "CASE WHEN r3.REQ_ID IS NOT NULL THEN r3.LGD ELSE p.LOSS_GIVEN_DEFAULT END AS LOSS_GIVEN_DEFAULT",
        ["wf_risk_request"], [latest],
        src="profile p LEFT JOIN req r1 ON r1.MODO = 1 AND r1.ID_SOLICITUD = p.ID_SOLICITUD AND r1.CUSTOMER_ID = p.CUSTOMER_NO "
            "LEFT JOIN req r2 ON r2.MODO = 2 AND r2.ID_SOLICITUD = p.ID_SOLICITUD AND r2.CUSTOMER_ID = p.CUSTOMER_NO "
            "LEFT JOIN req r3 ON r3.MODO = 3 AND r3.ID_SOLICITUD = p.ID_SOLICITUD AND r3.CUSTOMER_ID = p.CUSTOMER_NO")
    q["affected_rows"] = _p(
        "r.REQ_ID, r.MODO, CAST(CASE WHEN r.MODO IN (1, 2, 3) THEN (SELECT count(*) FROM profile p "
        "WHERE p.ID_SOLICITUD = r.ID_SOLICITUD AND p.CUSTOMER_NO = r.CUSTOMER_ID) ELSE 0 END AS BIGINT) AS FILAS",
        ["wf_risk_request"], src="wf_risk_request r")
    q["month_catalog"] = _p("p.ID_SOLICITUD, p.CUSTOMER_NO, p.GROUP_EXPIRATION_MONTH, m.DESCRIPCION", ctes=[_months()],
                            src="profile p LEFT JOIN months m ON m.CODIGO = p.GROUP_EXPIRATION_MONTH")
    q["month_catalog_filter"] = _p("p.ID_SOLICITUD, p.CUSTOMER_NO, p.GROUP_EXPIRATION_MONTH, m.DESCRIPCION",
                                   ctes=[_months()],
                                   src="profile p JOIN months m ON m.CODIGO = p.GROUP_EXPIRATION_MONTH "
                                       "WHERE m.DESCRIPCION LIKE '%MA%'")
    years = "coalesce(r.TIEMPO_RENOVACION, 0)"
    q["expiry_date"] = _p(f"p.ID_SOLICITUD, p.CUSTOMER_NO, {years} AS ANIOS_RENOVACION, "
                          f"{expiry_sql('p.GROUP_EXPIRATION_MONTH', 'p.FECHA_KYC', years)} AS FECHA_VENCIMIENTO",
                          ["wf_renewal"], src="profile p LEFT JOIN wf_renewal r ON r.RATING = p.AML_RATINGID")
    q["text_ops"] = _p(
        f"{KEY}, {ncat('TELEPHONENUMBER', chr(39) + '|' + chr(39), 'TELEPHONENUMBER2', chr(39) + '|' + chr(39), 'FAXNUMBER')} AS PHONES, "
        "upper(PHYSICALALINE3) AS PHYSICAL3_UPPER, "
        f"trim({number_text('NETWORTH')}) AS NETWORTH_TEXT, nullif(rtrim(NAMEEXTERNALAUDITORS), '') AS AUDITORS, "
        "substr(CUSTOMER_NO_FCC, 1, 5) AS CORE_PREFIX, "
        "nullif(CASE WHEN length(CUSTOMER_NAME1) - 3 > 0 THEN substr(CUSTOMER_NAME1, 1, length(CUSTOMER_NAME1) - 3) ELSE '' END, '') AS NAME_CUT, "
        f"replace({ncat('POSTALALINE1', chr(39) + ',' + chr(39), 'POSTALACITY')}, ',', ' ^ ') AS POSTAL, "
        "length(CUSTOMER_NAME1) AS NAME_LENGTH")
    q["split_rating"] = _p(f"{KEY}, {_rating('NAMEINTERNATIONALRISK', 2)} AS S_AND_P_EXTERNAL_R_RAT, "
                           f"{_rating('NAMEINTERNATIONALRISK', 3)} AS FITCH_EXTERNAL_R_RAT, "
                           f"{_rating('NAMEINTERNATIONALRISK', 1)} AS MOODYS_EXTNL_R_RAT")
    q["truncate_default"] = ("SELECT doc_id, nullif(substr(rtrim(coalesce(text, 'NA')), 1, 105), '') AS TEXT_105, "
                             "length(rtrim(text)) AS TRIMMED_LENGTH FROM documents")
    q["pad_month"] = _p(f"{KEY}, CASE WHEN GROUP_EXPIRATION_MONTH < 10 THEN '0' || CAST(GROUP_EXPIRATION_MONTH AS VARCHAR) "
                        "ELSE CAST(GROUP_EXPIRATION_MONTH AS VARCHAR) END AS KYC_REVISION_MONTH")
    q["date_formats"] = _p(f"{KEY}, {fmt_mon('INCORP_DATE')} AS D_MON, {fmt_compact('INCORP_DATE')} AS D_COMPACT, "
                           f"{fmt_iso('INCORP_DATE')} AS D_ISO, {fmt_dmy('INCORP_DATE')} AS D_DMY, "
                           "upper(strftime(FECHA_KYC, '%B')) AS KYC_MONTH")
    iso = "CAST(try_strptime({}, '%Y-%m-%d') AS DATE)"
    q["date_parse"] = with_tables(["fcc_userdef"]) + (
        f"SELECT REC_KEY, {iso.format('FIELD_VAL_17')} AS LIMIT_EXP_DATE, {iso.format('FIELD_VAL_40')} AS INCEPTION_DATE, "
        f"{iso.format('FIELD_VAL_53')} AS DATE_ESG_RATING, "
        f"CAST(try_strptime(strftime({iso.format('FIELD_VAL_39')}, '%d/%m/%Y'), '%d/%m/%Y') AS DATE) AS FECHA_KYC, "
        f"CAST(try_strptime(replace(FIELD_VAL_39, '-', ''), '%Y%m%d') AS DATE) AS KYC_COMPACT, "
        f"{iso.format('FIELD_VAL_9')} AS NOT_A_DATE FROM fcc_userdef WHERE FUNCTION_ID = 'STDCIF'")
    q["date_parts"] = _p(f"{KEY}, year(FECHA_KYC) AS Y, month(FECHA_KYC) AS M, day(FECHA_KYC) AS D, "
                         "last_day(FECHA_KYC) AS MONTH_END, date_diff('day', FECHA_KYC, LIMIT_EXP_DATE) AS DAYS_TO_LIMIT, "
                         "FECHA_KYC + 1 AS NEXT_DAY, CAST(FECHA_KYC + INTERVAL 6 MONTH AS DATE) AS PLUS_6M, "
                         f"{_month_end('year(FECHA_KYC)', 'GROUP_EXPIRATION_MONTH')} AS EXPIRY_MONTH_END")
    q["add_months_sticky"] = _p(f"{KEY}, {_sticky('FECHA_KYC', '12')} AS KYC_PLUS_12, "
                                f"{_sticky('last_day(INCORP_DATE)', '1')} AS INCORP_END_PLUS_1, "
                                f"{_sticky('LIMIT_EXP_DATE', '-1')} AS LIMIT_MINUS_1")
    q["flag_codings"] = _p(
        f"{KEY}, {_yes_no('CUSTOMER_CLASSIFICATION_PEP')} AS IS_PEP, {_yes_no('PROJECT_FINANCE')} AS PF_INDICATOR, "
        "CASE WHEN NY_AGENCY = '1' THEN 'YES' WHEN NY_AGENCY = '0' THEN 'NO' END AS CUST_CAN_BE_USE_NY_AGENCY, "
        "CASE WHEN SALES_MORE_30_PERCENT = '1' THEN 'SI' ELSE 'NO' END AS CLIENTE_EXP_30PCT_VTAS_O_MAS, "
        "CASE WHEN CHK_CONTR_APROB_VF = 1 THEN 'SI' ELSE 'NO' END AS CONTR_APROB_VF_1, "
        "CASE WHEN CUSTOMER_TYPE IN (2, 5, 7) THEN SWIFT_CODE END AS SWIFT_CODE, "
        f"{_limit_type('CUSTOMER_TYPE')} AS LMT_CUSTOMER_TYPE")
    mf = ["fcc_customer", "fcc_userdef", "fcc_corporate"]
    q["type_derivation"] = with_tables(mf) + (
        f"SELECT CUSTOMER_NO, {_ctype('FIELD_VAL_42', 'CUSTOMER_TYPE')} AS TIPO, "
        f"{_limit_type(_ctype('FIELD_VAL_42', 'CUSTOMER_TYPE'))} AS LMT_CUSTOMER_TYPE FROM ({_master_fields()})")
    q["agency_derivation"] = with_tables(mf) + (
        "SELECT CUSTOMER_NO, CASE WHEN FIELD_VAL_32 = 'YES' THEN '1' WHEN FIELD_VAL_32 = 'NO' THEN '0' "
        "WHEN INCORP_COUNTRY IN ('BR', 'ARG') THEN '1' ELSE '0' END AS NY_AGENCY, "
        "CASE WHEN trim(coalesce(FIELD_VAL_41, 'N')) = 'Y' THEN '1' ELSE '0' END AS CUSTOMER_CLASSIFICATION_PEP, "
        "CASE WHEN upper(FIELD_VAL_36) = 'SI' THEN 1 ELSE 0 END AS CHK_CONTR_APROB_VF, "
        f"CASE WHEN CUSTOMER_NO = FIELD_VAL_31 THEN 1 ELSE 0 END AS MAIN_CUSTOMER FROM ({_master_fields()})")
    q["aml_effective"] = _p(f"{KEY}, CASE WHEN NY_AGENCY = '1' THEN AML_RATINGID_NY WHEN NY_AGENCY = '0' THEN AML_RATINGID END "
                            "AS AML_RATING, CASE WHEN NY_AGENCY = '1' THEN AML_RATINGID_NY ELSE AML_RATINGID END AS AML_RISK_RATING")
    first = ("bt AS (SELECT LOV_DESC, min(LOV) AS LOV FROM fcc_lov WHERE FIELD_NAME = 'BANK TYPE' GROUP BY LOV_DESC)")
    q["bank_type_codes"] = _p(
        "p.ID_SOLICITUD, p.CUSTOMER_NO, coalesce(CASE WHEN p.BANKTYPE = 'NA' THEN p.BANKTYPE ELSE bt.LOV END, 'NA') AS BANK_TYPE, "
        "CASE WHEN p.BANKTYPE IN ('Not aplicable', 'NA') THEN 'NA' ELSE p.BANKTYPE END AS BANK_TYPE_LABEL",
        ["fcc_lov"], [first], src="profile p LEFT JOIN bt ON bt.LOV_DESC = p.BANKTYPE")
    q["relation_by_purpose"] = _p(
        "p.ID_SOLICITUD, p.CUSTOMER_NO, CASE WHEN coalesce(i.PURPOSE_ID, 0) = 7 THEN 'NA' ELSE p.RELATIONTYPE END AS RELATION_TYPE",
        ["wf_lmt_customer_info"], ["i AS (SELECT ID_SOLICITUD, min(PURPOSE_ID) AS PURPOSE_ID FROM wf_lmt_customer_info GROUP BY 1)"],
        src="profile p LEFT JOIN i ON i.ID_SOLICITUD = p.ID_SOLICITUD")
    mc = ("mc AS (SELECT ID_SOLICITUD, arg_min(CUSTOMER_NO_FCC, CUSTOMER_NO) AS core FROM profile "
          "WHERE MAIN_CUSTOMER = 1 AND RELACIONADO IS NULL GROUP BY 1)")
    q["main_reference"] = _p(
        "p.ID_SOLICITUD, p.CUSTOMER_NO, CASE WHEN strftime(p.LIMIT_EXP_DATE, '%Y%m%d') = '19800101' THEN NULL "
        "ELSE mc.core END AS CLIENTE_PRINCIPAL", ctes=[mc], src="profile p LEFT JOIN mc ON mc.ID_SOLICITUD = p.ID_SOLICITUD")
    return q
