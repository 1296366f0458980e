"""DuckDB oracle SQL for the creation-manager checks, written the reference's way
(correlated count subqueries, NOT IN, DISTINCT over GROUP BY)."""

from __future__ import annotations

from profilebook.registry.sqlkit import listagg, ncat, with_tables

_T = ["fcc_customer", "wf_application", "wf_stage_history", "wf_completion_cif", "wf_contracts"]


def _w(ctes: list[str] | None = None) -> str:
    return with_tables(_T, ctes, profile=True)


_CREATED = ("{a}.ID_CUSTOMER_FCC IS NOT NULL AND ({a}.ID_STATUS_FCC <> 3 OR {a}.ID_STATUS_FCC IS NULL) "
            "AND {a}.LMT_CUSTOMER_TYPE {typ} 'G' AND {a}.ID_STATUS_FCC = 1")


def _count(a: str, contracts: bool, auth: bool, extra: str = "", created: bool = True) -> str:
    b = f"JOIN wf_contracts B{a[-1]} ON {a}.ID_CUSTOMER_FCC = B{a[-1]}.XREF_NUMERO_CONTRATO " if contracts else ""
    bnn = f"B{a[-1]}.XREF_NUMERO_CONTRATO IS NOT NULL AND " if contracts else ""
    cond = _CREATED.format(a=a, typ="<>") if created else extra
    auth_c = f" AND C{a[-1]}.AUTH_STAT = 'A'" if auth else ""
    return (f"(SELECT COUNT({a}.ID_SOLICITUD) FROM profile {a} {b}"
            f"JOIN fcc_customer C{a[-1]} ON C{a[-1]}.CUSTOMER_NO = {a}.CUSTOMER_NO_FCC "
            f"JOIN wf_application D{a[-1]} ON {a}.ID_SOLICITUD = D{a[-1]}.ID_SOLICITUD "
            f"WHERE {bnn}{cond}{auth_c} AND {a}.ID_SOLICITUD = A.ID_SOLICITUD)")


def oracle() -> dict[str, str]:
    q: dict[str, str] = {}
    q["flag_zero_when_any"] = _w() + (
        "SELECT a.ID_SOLICITUD, (SELECT CASE WHEN COUNT(*) > 0 THEN '0' ELSE '1' END FROM profile p "
        "WHERE p.ID_SOLICITUD = a.ID_SOLICITUD AND p.ID_STATUS_FCC = 0 AND p.CHK_CREATE_FCC = 1) AS RESULTADO "
        "FROM wf_application a")
    q["flag_one_when_any"] = _w() + (
        "SELECT a.ID_SOLICITUD, (SELECT CASE WHEN COUNT(*) > 0 THEN '1' ELSE '0' END FROM profile p "
        "WHERE p.ID_SOLICITUD = a.ID_SOLICITUD AND coalesce(p.ID_STATUS_FCC, 0) = 0) AS RESULTADO "
        "FROM wf_application a")
    q["count_correlated"] = _w() + (
        f"SELECT DISTINCT D.NU_INCIDENTE AS INCIDENTE, {_count('A1', False, True)} AS ULT_CANTIDAD, "
        f"{_count('A2', False, True)} AS FCC_CANTIDAD "
        "FROM profile A JOIN fcc_customer C ON C.CUSTOMER_NO = A.CUSTOMER_NO_FCC "
        "JOIN wf_application D ON A.ID_SOLICITUD = D.ID_SOLICITUD "
        "JOIN wf_stage_history HE ON HE.NUMEROINCIDENTE = D.NU_INCIDENTE AND HE.ID_PROCESO IN (1000, 2200) "
        "AND HE.ID_STEP IN (1012, 2215) "
        f"WHERE {_CREATED.format(a='A', typ='<>')} AND C.AUTH_STAT = 'A' "
        "AND D.NU_INCIDENTE NOT IN (SELECT INCIDENT FROM wf_completion_cif) AND HE.ESTADO_ETAPA = 1 "
        "GROUP BY A.ID_CUSTOMER_FCC, A.ID_STATUS_FCC, A.ID_SOLICITUD, C.CUSTOMER_NO, D.NU_INCIDENTE")
    q["counts_expected_actual"] = _w() + (
        f"SELECT DISTINCT D.NU_INCIDENTE AS INCIDENTE, {_count('A1', True, False)} AS ULT_CANTIDAD, "
        f"{_count('A2', True, True)} AS FCC_CANTIDAD "
        "FROM profile A JOIN wf_contracts B ON A.ID_CUSTOMER_FCC = B.XREF_NUMERO_CONTRATO "
        "JOIN fcc_customer C ON C.CUSTOMER_NO = A.CUSTOMER_NO_FCC "
        "JOIN wf_application D ON A.ID_SOLICITUD = D.ID_SOLICITUD "
        "JOIN wf_stage_history HE ON HE.NUMEROINCIDENTE = D.NU_INCIDENTE AND HE.ID_PROCESO IN (1000, 2200) "
        "AND HE.ID_STEP IN (1012, 2215, 1013) "
        f"WHERE B.XREF_NUMERO_CONTRATO IS NOT NULL AND {_CREATED.format(a='A', typ='<>')} AND C.AUTH_STAT = 'A' "
        "AND HE.ESTADO_ETAPA = 1 "
        "GROUP BY B.XREF_NUMERO_CONTRATO, A.ID_CUSTOMER_FCC, A.ID_STATUS_FCC, A.ID_SOLICITUD, C.CUSTOMER_NO, D.NU_INCIDENTE")
    q["group_approval_list"] = _w() + (
        "SELECT B.XREF_NUMERO_CONTRATO, A.ID_CUSTOMER_FCC, A.ID_STATUS_FCC, A.ID_SOLICITUD, C.CUSTOMER_NO, "
        "D.NU_INCIDENTE AS INCIDENTE FROM profile A JOIN wf_contracts B ON A.ID_CUSTOMER_FCC = B.XREF_NUMERO_CONTRATO "
        "JOIN fcc_customer C ON C.CUSTOMER_NO = A.CUSTOMER_NO_FCC JOIN wf_application D ON A.ID_SOLICITUD = D.ID_SOLICITUD "
        f"WHERE B.XREF_NUMERO_CONTRATO IS NOT NULL AND {_CREATED.format(a='A', typ='=')} AND C.AUTH_STAT = 'A'")
    ex1 = "A1.ID_CUSTOMER_FCC IS NULL AND A1.MSG_ERROR_FCC IS NULL AND A1.ID_SOLICITUD_LM IS NULL AND A1.ID_EXISTE_FCC = '1'"
    ex2 = ("A2.ID_CUSTOMER_FCC IS NULL AND C2.AUTH_STAT = 'A' AND A2.ID_SOLICITUD_LM IS NULL "
           "AND A2.ID_EXISTE_FCC = '1'")
    q["existing_auth_check"] = _w() + (
        f"SELECT DISTINCT D.NU_INCIDENTE AS INCIDENTE, {_count('A1', False, False, ex1, created=False)} AS ULT_CANTIDAD, "
        f"{_count('A2', False, False, ex2, created=False)} AS FCC_CANTIDAD "
        "FROM profile A JOIN fcc_customer C ON C.CUSTOMER_NO = A.CUSTOMER_NO_FCC "
        "JOIN wf_application D ON A.ID_SOLICITUD = D.ID_SOLICITUD "
        "JOIN wf_stage_history HE ON HE.NUMEROINCIDENTE = D.NU_INCIDENTE AND HE.ID_PROCESO = 1000 AND HE.ID_STEP = 1013 "
        "WHERE A.ID_CUSTOMER_FCC IS NULL AND C.AUTH_STAT = 'A' AND A.MSG_ERROR_FCC IS NULL "
        "AND A.ID_SOLICITUD_LM IS NULL AND A.ID_EXISTE_FCC = '1' AND HE.ESTADO_ETAPA = 1 "
        "GROUP BY A.ID_CUSTOMER_FCC, A.ID_STATUS_FCC, A.ID_SOLICITUD, C.CUSTOMER_NO, D.NU_INCIDENTE")
    item = ncat("customer_name1", "' / '", "customer_no_fcc")
    created = (f"created AS (SELECT ID_SOLICITUD, {item} AS CLIENTE FROM profile WHERE coalesce(ID_STATUS_FCC, 0) IN (1, 3) "
               "AND (LIMIT_EXP_DATE <> DATE '1980-01-01' OR LIMIT_EXP_DATE IS NULL) "
               f"UNION SELECT ID_SOLICITUD, {item} FROM profile WHERE coalesce(ID_STATUS_FCC, 0) IN (1, 3) "
               "AND LIMIT_EXP_DATE = DATE '1980-01-01')")
    q["union_distinct"] = _w([created]) + "SELECT ID_SOLICITUD, CLIENTE FROM created"
    groups = (f"grows AS (SELECT ID_SOLICITUD, {item} AS item FROM profile WHERE coalesce(ID_STATUS_FCC, 0) IN (1, 3) "
              "AND LIMIT_EXP_DATE = DATE '1980-01-01' AND customer_no_fcc <> liab_id)")
    cust = (f"cust AS (SELECT ID_SOLICITUD, {listagg('CLIENTE', 'CLIENTE', '|', trailing=True)} AS CLIENTES, "
            "sum(length(CLIENTE) + 1) > 2000 AS ov FROM created GROUP BY 1)")
    grp = (f"grp AS (SELECT ID_SOLICITUD, {listagg('item', 'item', '|', trailing=True)} AS GRUPOS, "
           "sum(length(item) + 1) > 2000 AS ov FROM grows GROUP BY 1)")
    q["notice_text"] = _w([created, groups, cust, grp]) + (
        "SELECT a.ID_SOLICITUD, cust.CLIENTES, grp.GRUPOS, coalesce(cust.ov, false) OR coalesce(grp.ov, false) "
        "AS NOTICE_OVERFLOW FROM wf_application a LEFT JOIN cust ON cust.ID_SOLICITUD = a.ID_SOLICITUD "
        "LEFT JOIN grp ON grp.ID_SOLICITUD = a.ID_SOLICITUD")
    return q
