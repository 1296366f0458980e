"""DuckDB oracle SQL for the generic operators."""

from __future__ import annotations

from profilebook.registry.sqlkit import with_tables

K = "ID_SOLICITUD, CUSTOMER_NO"


def _p(sql: str, tables: list[str] | None = None, ctes: list[str] | None = None) -> str:
    return with_tables(tables or [], ctes, profile=True) + sql


def oracle() -> dict[str, str]:
    q: dict[str, str] = {}
    q["project_rename"] = with_tables(["fcc_customer"]) + (
        'SELECT CUSTOMER_NO "Customer No", CUSTOMER_NAME1 "Customer Name", FULL_NAME "Legal or Commercial Name", '
        'SHORT_NAME2 "SHORT_NAME", NATIONALITY "NationalityCod" FROM fcc_customer')
    q["constant_null_columns"] = _p(f"SELECT {K}, 'MAIL' AS DEFAULT_MEDIA, 'NA' AS WEBSITE, 'NC' AS S_AND_P_EXTERNAL_R_RAT, "
                                    "NULL::VARCHAR AS IDENT_NAME, NULL::VARCHAR AS DIGITO_VERIFICADOR FROM profile")
    q["filter_equality"] = _p(f"SELECT {K}, LMT_CUSTOMER_TYPE FROM profile WHERE LMT_CUSTOMER_TYPE = 'E'")
    q["filter_not_equal"] = _p(f"SELECT {K}, LMT_CUSTOMER_TYPE FROM profile WHERE LMT_CUSTOMER_TYPE <> 'G'")
    q["filter_ne_or_null"] = _p(f"SELECT {K}, ID_STATUS_FCC FROM profile WHERE (ID_STATUS_FCC <> 3 OR ID_STATUS_FCC IS NULL)")
    q["filter_null_default"] = _p(f"SELECT {K}, ID_STATUS_FCC FROM profile WHERE coalesce(ID_STATUS_FCC, 0) IN (1, 3)")
    q["filter_in_list"] = with_tables(["wf_stage_history"]) + (
        "SELECT NUMEROINCIDENTE, ID_PROCESO, ID_STEP, ESTADO_ETAPA FROM wf_stage_history "
        "WHERE ID_PROCESO IN (1000, 2200) AND ID_STEP IN (1012, 2215, 1013)")
    q["filter_like"] = _p(f"SELECT {K}, CUSTOMER_NAME1 FROM profile WHERE CUSTOMER_NAME1 LIKE '%' || '#00000001' || '%'")
    q["filter_null_tests"] = _p(f"SELECT {K}, CUSTOMER_NO_FCC FROM profile WHERE ID_CUSTOMER_FCC IS NULL "
                                "AND CUSTOMER_NO_FCC IS NOT NULL")
    q["filter_sentinel_date"] = _p(f"SELECT {K}, coalesce(LIMIT_EXP_DATE = DATE '1980-01-01', false) AS IS_SENTINEL, "
                                   "(LIMIT_EXP_DATE <> DATE '1980-01-01' OR LIMIT_EXP_DATE IS NULL) AS NOT_SENTINEL FROM profile")
    q["filter_status_set"] = with_tables(["fcc_customer"]) + (
        "SELECT CUSTOMER_NO, AUTH_STAT, RECORD_STAT FROM fcc_customer WHERE (AUTH_STAT = 'U' OR AUTH_STAT = 'A') "
        "AND RECORD_STAT = 'O'")
    q["lookup_filtered_role"] = _p(
        "SELECT p.ID_SOLICITUD, p.CUSTOMER_NO, p.RELATIONTYPE, l.LOV_DESC AS RELATIONTYPE_DESC FROM profile p "
        "LEFT JOIN fcc_lov l ON l.LOV = p.RELATIONTYPE AND l.FIELD_NAME = 'RELATION_TYPE'", ["fcc_lov"])
    q["lookup_prefix_key"] = _p(
        "SELECT p.ID_SOLICITUD, p.CUSTOMER_NO, p.CUSTOMER_NO_FCC, u.FIELD_VAL_7, u.FIELD_VAL_8 FROM profile p "
        "LEFT JOIN (SELECT * FROM fcc_userdef WHERE FUNCTION_ID = 'STDCIF') u ON p.CUSTOMER_NO_FCC = substr(u.REC_KEY, 1, 9)",
        ["fcc_userdef"])
    q["lookup_concat_key"] = with_tables(["fcc_customer", "fcc_userdef"]) + (
        "SELECT m.CUSTOMER_NO, u.FIELD_VAL_1 AS INTERNAL_CLASSIFICATION FROM fcc_customer m "
        "LEFT JOIN fcc_userdef u ON m.CUSTOMER_NO || '~' = u.REC_KEY")
    q["lookup_trim_key"] = _p(
        "SELECT p.ID_SOLICITUD, p.CUSTOMER_NO, p.LMT_CUSTOMER_TYPE, t.CO_CUSTOMER_TYPE_KCC FROM profile p "
        "LEFT JOIN wf_lmt_customer_type t ON trim(t.CO_CUSTOMER_TYPE) = trim(p.LMT_CUSTOMER_TYPE)", ["wf_lmt_customer_type"])
    chain = ("chain AS (SELECT trim(t.CO_CUSTOMER_TYPE) AS ctype, k.CUSTOMER_ID AS kid, k.CUSTOMER_DESCRIPTION AS kdesc "
             "FROM wf_lmt_customer_type t LEFT JOIN wf_customer_type k ON k.CUSTOMER_ID = t.CO_CUSTOMER_TYPE_KCC)")
    q["lookup_chain"] = _p(
        "SELECT p.ID_SOLICITUD, p.CUSTOMER_NO, p.LMT_CUSTOMER_TYPE, c.kid AS KCT_CUSTOMER_ID, c.kdesc AS KCT_DESCRIPTION "
        "FROM profile p LEFT JOIN chain c ON c.ctype = trim(p.LMT_CUSTOMER_TYPE)",
        ["wf_lmt_customer_type", "wf_customer_type"], [chain])
    q["lookup_prefer"] = _p(
        "SELECT p.ID_SOLICITUD, p.CUSTOMER_NO, coalesce(p.CUSTOMER_TYPE, c.kid) AS CUSTOMER_TYPE, "
        "coalesce(ct.CUSTOMER_DESCRIPTION, c.kdesc) AS CUSTOMER_TYPE_DESC FROM profile p "
        "LEFT JOIN wf_customer_type ct ON ct.CUSTOMER_ID = p.CUSTOMER_TYPE LEFT JOIN chain c ON c.ctype = trim(p.LMT_CUSTOMER_TYPE)",
        ["wf_lmt_customer_type", "wf_customer_type"], [chain])
    q["lookup_scalar"] = _p(
        "SELECT p.ID_SOLICITUD, p.CUSTOMER_NO, p.LANGUAGEID, (SELECT LANG_NAME FROM fcc_language l "
        "WHERE l.LANG_CODE = p.LANGUAGEID) AS LANGUAGEID_DESC FROM profile p", ["fcc_language"])
    q["lookup_fallback"] = _p(
        "SELECT a.ID_SOLICITUD, coalesce((SELECT min(GROUP_CODE) FROM profile p WHERE p.ID_SOLICITUD = a.ID_SOLICITUD "
        "AND p.LIMIT_EXP_DATE = DATE '1980-01-01' AND p.LMT_CUSTOMER_TYPE = 'G' AND p.GROUP_CODE IS NOT NULL), "
        "(SELECT min(GROUP_CODE) FROM wf_ec_rc_limits l WHERE l.ID_SOLICITUD = a.ID_SOLICITUD)) AS GROUP_CODE "
        "FROM wf_application a", ["wf_application", "wf_ec_rc_limits"])
    q["join_inner_multi"] = _p(
        "SELECT p.ID_SOLICITUD, p.CUSTOMER_NO, p.CUSTOMER_NO_FCC, m.AUTH_STAT, a.NU_INCIDENTE "
        "FROM profile p, fcc_customer m, wf_application a WHERE m.CUSTOMER_NO = p.CUSTOMER_NO_FCC "
        "AND a.ID_SOLICITUD = p.ID_SOLICITUD", ["fcc_customer", "wf_application"])
    q["join_inlist_stage"] = with_tables(["wf_application", "wf_stage_history"]) + (
        "SELECT DISTINCT a.NU_INCIDENTE, a.ID_SOLICITUD FROM wf_application a JOIN wf_stage_history he "
        "ON he.NUMEROINCIDENTE = a.NU_INCIDENTE AND he.ID_PROCESO IN (1000, 2200) AND he.ID_STEP IN (1012, 2215) "
        "WHERE he.ESTADO_ETAPA = 1")
    q["anti_not_in"] = with_tables(["wf_application", "wf_completion_cif"]) + (
        "SELECT ID_SOLICITUD, NU_INCIDENTE FROM wf_application WHERE NU_INCIDENTE NOT IN (SELECT INCIDENT FROM wf_completion_cif)")
    q["anti_not_in_null"] = with_tables(["wf_application", "wf_completion_cif"]) + (
        "SELECT ID_SOLICITUD, NU_INCIDENTE FROM wf_application WHERE NU_INCIDENTE NOT IN ("
        "SELECT INCIDENT FROM wf_completion_cif UNION ALL SELECT NULL)")
    q["main_row_values"] = _p(
        "SELECT p.ID_SOLICITUD, p.CUSTOMER_NO, m.o AS ACCOUNT_OFFICER, m.l AS LOCATION FROM profile p LEFT JOIN ("
        "SELECT ID_SOLICITUD, arg_min(ACCOUNT_OFFICERID, CUSTOMER_NO) AS o, arg_min(LOCATIONID, CUSTOMER_NO) AS l "
        "FROM profile WHERE MAIN_CUSTOMER = 1 GROUP BY 1) m ON m.ID_SOLICITUD = p.ID_SOLICITUD")
    q["distinct_groups"] = _p(
        "SELECT A.ID_CUSTOMER_FCC, A.ID_STATUS_FCC, A.ID_SOLICITUD, C.CUSTOMER_NO, D.NU_INCIDENTE FROM profile A "
        "JOIN fcc_customer C ON C.CUSTOMER_NO = A.CUSTOMER_NO_FCC JOIN wf_application D ON A.ID_SOLICITUD = D.ID_SOLICITUD "
        "WHERE A.ID_CUSTOMER_FCC IS NOT NULL AND (A.ID_STATUS_FCC <> 3 OR A.ID_STATUS_FCC IS NULL) "
        "AND A.LMT_CUSTOMER_TYPE <> 'G' AND A.ID_STATUS_FCC = 1 "
        "GROUP BY A.ID_CUSTOMER_FCC, A.ID_STATUS_FCC, A.ID_SOLICITUD, C.CUSTOMER_NO, D.NU_INCIDENTE",
        ["fcc_customer", "wf_application"])
    q["sort_main_first"] = _p(f"SELECT {K}, MAIN_CUSTOMER FROM profile ORDER BY MAIN_CUSTOMER DESC NULLS FIRST, {K}")
    q["first_of_many"] = _p("SELECT ID_SOLICITUD, min(CUSTOMER_NO) AS CUSTOMER_NO, arg_min(CUSTOMER_NO_FCC, CUSTOMER_NO) "
                            "AS CUSTOMER_NO_FCC FROM profile WHERE MAIN_CUSTOMER = 1 GROUP BY 1")
    added = ", ".join(f"CASE WHEN ID_SOLICITUD % 2 = 0 THEN NULL ELSE {c} END AS {c}" for c in (
        "GROUP_EXPIRATION_MONTH", "PROJECT_FINANCE", "PROBABILITY_DEFAULT", "LOSS_GIVEN_DEFAULT"))
    q["add_columns"] = _p(f"SELECT {K}, {added} FROM profile")
    q["param_broadcast"] = _p(
        "SELECT p.ID_SOLICITUD, p.CUSTOMER_NO, CASE WHEN coalesce(i.PURPOSE_ID, 0) = 7 THEN 'NA' ELSE p.RELATIONTYPE END "
        "AS RELATION_TYPE FROM profile p LEFT JOIN (SELECT ID_SOLICITUD, min(PURPOSE_ID) AS PURPOSE_ID FROM "
        "wf_lmt_customer_info GROUP BY 1) i ON i.ID_SOLICITUD = p.ID_SOLICITUD", ["wf_lmt_customer_info"])
    q["sort_multi"] = _p("SELECT d.ID_SOLICITUD, p.CUSTOMER_NO_FCC, d.TYPE, d.NAME, d.POSITION FROM wf_directors d "
                         "JOIN profile p ON p.ID_SOLICITUD = d.ID_SOLICITUD AND p.CUSTOMER_NO = d.CUSTOMER_NO "
                         "WHERE p.CUSTOMER_NO_FCC IS NOT NULL AND d.TYPE <> 3 ORDER BY 1, 2, 3, 4, 5", ["wf_directors"])
    return q
