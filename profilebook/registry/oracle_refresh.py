"""DuckDB oracle SQL for the application refresh."""

from __future__ import annotations

from profilebook.plans import refresh_rules as R
from profilebook.registry.oracle_search import LATEST_APP_CTE
from profilebook.registry.sqlkit import listagg, ncat, with_tables
from profilebook.sources import standins

AS_OF = "TIMESTAMP '2024-02-01 00:00:00'"
_T = ["fcc_customer", "fcc_userdef", "fcc_corporate", "fcc_mis_default", "fcc_personal", "fcc_cust_address",
      "fcc_group_code", "fcc_lov", "wf_application", "wf_multi_values", "fcc_country", "wf_refresh_request"]
_UDF = [f"u.FIELD_VAL_{n}" for n in standins.UDF_FIELD_NUMBERS]


def _t(col: str) -> str:
    t = standins.PROFILE_TYPES[col]
    return {"STRING": "VARCHAR", "TIMESTAMP_L": "TIMESTAMP"}.get(t, t)


def _term(t: tuple) -> str:
    k = t[0]
    if k in ("m", "corp", "mit", "cp"):
        return f"s.{t[1]}"
    if k == "udf":
        return f"s.FIELD_VAL_{t[1]}"
    if k == "udf_date":
        return f"CAST(try_strptime(s.FIELD_VAL_{t[1]}, '%Y-%m-%d') AS DATE)"
    if k == "udf_num":
        return f"s.FIELD_VAL_{t[1]}"
    if k == "grp":
        return "s.grp"
    if k == "addr":
        return f"CASE WHEN s.DEFAULT_MEDIA IN ('FAX', 'SWIFT') THEN s.a{t[1]} ELSE s.ADDRESS_LINE{t[1]} END"
    if k == "bank":
        return "s.bank"
    if k == "iclass":
        return "s.iclass"
    if k == "cand":
        return f"c.{t[1]}"
    if k == "req":
        return f"c.{t[1]}"
    if k == "seq":
        return "c.NEW_NO"
    if k == "lit":
        return "NULL" if t[1] is None else repr(t[1])
    if k == "ny":
        return ("CASE WHEN s.FIELD_VAL_32 = 'YES' THEN '1' WHEN s.FIELD_VAL_32 = 'NO' THEN '0' "
                "WHEN s.INCORP_COUNTRY IN ('BR', 'ARG') THEN '1' ELSE '0' END")
    if k == "main":
        return "CASE WHEN c.CORE_ID = c.MAIN_ID THEN 1 ELSE 0 END"
    if k == "pep":
        return "CASE WHEN trim(coalesce(s.FIELD_VAL_41, 'N')) = 'Y' THEN '1' ELSE '0' END"
    if k == "cpt":
        return "CASE WHEN upper(s.FIELD_VAL_36) = 'SI' THEN 1 ELSE 0 END"
    if k == "ctype":
        up = "upper(s.CUSTOMER_TYPE)"

        def pair(a, b):
            return f"CASE WHEN {up} = 'C' THEN {a} WHEN {up} = 'B' THEN {b} END"
        return (f"CASE WHEN s.FIELD_VAL_42 IS NULL THEN {pair(1, 2)} WHEN s.FIELD_VAL_42 = '02' THEN {pair(4, 5)} "
                f"WHEN s.FIELD_VAL_42 = '07' THEN {pair(6, 7)} ELSE {pair(1, 2)} END")
    if k == "rating":
        return ncat("'MOODYS:'", "s.FIELD_VAL_5", "' SP:'", "s.FIELD_VAL_3", "' FITCH:'", "s.FIELD_VAL_4")
    raise ValueError(k)


def _load(rules: list) -> str:
    d = dict(rules)
    return ", ".join(f"TRY_CAST({_term(d[c])} AS {_t(c)}) AS {c}" if c in d else f"CAST(NULL AS {_t(c)}) AS {c}"
                     for c in standins.PROFILE_COLUMNS)


def _carry(col: str, t: tuple) -> str:
    k = t[0]
    if k == "prev":
        return f"pv.{col}"
    if k == "lit":
        return f"CAST({'NULL' if t[1] is None else repr(t[1])} AS {_t(col)})"
    if k == "udf_if":
        return f"CAST(CASE WHEN cu.FIELD_VAL_32 = '{t[1]}' THEN cu.FIELD_VAL_{t[2]} END AS {_t(col)})"
    if k == "udf_date":
        return f"CAST(try_strptime(cu.FIELD_VAL_{t[1]}, '%Y-%m-%d') AS DATE)"
    if k == "udf":
        return f"CAST(cu.FIELD_VAL_{t[1]} AS {_t(col)})"
    raise ValueError(k)


def _ctes() -> list[str]:
    single, group = dict(R.carry_rules(False)), dict(R.carry_rules(True))
    carry_cols = []
    for c in standins.PROFILE_COLUMNS:
        if c == "COUNTRIES_WHERE_OFFERS":
            carry_cols.append("CASE WHEN cp.PREV_SOLICITUD IS NOT NULL THEN tx.countries ELSE b.COUNTRIES_WHERE_OFFERS END "
                              "AS COUNTRIES_WHERE_OFFERS")
            continue
        if c in single or c in group:
            e = "CASE"
            if c in single:
                e += f" WHEN cp.PREV_SOLICITUD IS NOT NULL AND cp.MODE = 'S' THEN {_carry(c, single[c])}"
            if c in group:
                e += f" WHEN cp.PREV_SOLICITUD IS NOT NULL AND cp.MODE = 'G' THEN {_carry(c, group[c])}"
            carry_cols.append(f"{e} ELSE b.{c} END AS {c}")
        else:
            carry_cols.append(f"b.{c}")
    udf_cols = ", ".join(_UDF)
    return [
        "mu AS (SELECT m.CUSTOMER_NO AS CORE_ID, m.LIABILITY_NO, m.GROUP_CODE, u.FIELD_VAL_31 AS MAIN_ID "
        "FROM fcc_customer m JOIN fcc_userdef u ON m.CUSTOMER_NO = substr(u.REC_KEY, 1, 9) AND u.FUNCTION_ID = 'STDCIF' "
        "WHERE u.FIELD_VAL_17 <> '1970-01-01')",
        "cand0 AS (SELECT r.ID_SOLICITUD, r.ID_PURPOSE, mu.*, 'S' AS MODE FROM wf_refresh_request r "
        "JOIN mu ON r.ID_PURPOSE = 6 AND mu.CORE_ID = r.CUSTOMER_NO_FCC UNION ALL "
        "SELECT r.ID_SOLICITUD, r.ID_PURPOSE, mu.*, 'G' FROM wf_refresh_request r "
        "JOIN mu ON NOT coalesce(r.ID_PURPOSE = 6, false) AND mu.MAIN_ID = r.CUSTOMER_NO_FCC)",
        "cand AS (SELECT *, (SELECT max(CUSTOMER_NO) FROM profile) + row_number() OVER (ORDER BY ID_SOLICITUD, CORE_ID) "
        "AS NEW_NO FROM cand0)",
        "addr AS (SELECT CUSTOMER_NO, ADDRESS1 AS a1, ADDRESS2 AS a2, ADDRESS3 AS a3, ADDRESS4 AS a4 FROM ("
        "SELECT *, row_number() OVER (PARTITION BY CUSTOMER_NO ORDER BY ADDRESS1, ADDRESS2, ADDRESS3, ADDRESS4) AS rn "
        "FROM fcc_cust_address WHERE MEDIA = 'MAIL' AND LOCATION = 'CIF' AND RECORD_STAT = 'O' AND AUTH_STAT = 'A') "
        "WHERE rn = 1)",
        "lov AS (SELECT FIELD_NAME, LOV, min(LOV_DESC) AS LOV_DESC FROM fcc_lov GROUP BY 1, 2)",
        "star AS (SELECT m.CUSTOMER_NO, m.CUSTOMER_TYPE, m.CUSTOMER_NAME1, m.FULL_NAME, m.SHORT_NAME, m.COUNTRY, "
        "m.NATIONALITY, m.EXPOSURE_COUNTRY, m.LOC_CODE, m.DEFAULT_MEDIA, m.CUSTOMER_CATEGORY, m.SWIFT_CODE, m.UDF_1, "
        "m.ADDRESS_LINE1, m.ADDRESS_LINE2, m.ADDRESS_LINE3, m.ADDRESS_LINE4, corp.C_NATIONAL_ID, corp.INCORP_COUNTRY, "
        f"corp.INCORP_DATE, corp.NETWORTH, corp.R_ADDRESS1, corp.R_ADDRESS2, corp.R_ADDRESS3, {udf_cols}, "
        "mit.CUST_MIS_1, mit.COMP_MIS_1, mit.COMP_MIS_2, cp.TELEPHONE, cp.FAX, cp.E_MAIL, a.a1, a.a2, a.a3, a.a4, "
        "grp.DESCRIPTION AS grp, bt.LOV_DESC AS bank, (SELECT min(FIELD_VAL_1) FROM fcc_userdef x "
        "WHERE x.REC_KEY = m.CUSTOMER_NO || '~') AS iclass "
        "FROM fcc_customer m LEFT JOIN fcc_corporate corp ON corp.CUSTOMER_NO = m.CUSTOMER_NO "
        "LEFT JOIN (SELECT * FROM fcc_userdef WHERE FUNCTION_ID = 'STDCIF') u ON m.CUSTOMER_NO = substr(u.REC_KEY, 1, 9) "
        "LEFT JOIN fcc_mis_default mit ON mit.CUSTOMER = m.CUSTOMER_NO "
        "LEFT JOIN fcc_personal cp ON cp.CUSTOMER_NO = m.CUSTOMER_NO LEFT JOIN addr a ON a.CUSTOMER_NO = m.CUSTOMER_NO "
        "LEFT JOIN fcc_group_code grp ON grp.GROUP_CODE = m.GROUP_CODE "
        "LEFT JOIN lov bt ON bt.FIELD_NAME = 'BANK_TYPE' AND bt.LOV = u.FIELD_VAL_7 "
        "WHERE m.AUTH_STAT IN ('U', 'A') AND m.RECORD_STAT = 'O')",
        f"loaded AS (SELECT {_load(R.LOAD_COMMON + R.LOAD_SINGLE_ONLY)}, 'S' AS MODE FROM cand c JOIN star s "
        f"ON s.CUSTOMER_NO = c.CORE_ID WHERE c.MODE = 'S' UNION ALL SELECT {_load(R.LOAD_COMMON + R.LOAD_GROUP_ONLY)}, "
        "'G' FROM cand c JOIN star s ON s.CUSTOMER_NO = c.CORE_ID WHERE c.MODE = 'G')",
        "apps AS (SELECT ID_SOLICITUD AS app, bool_or(NOT coalesce(ID_PURPOSE = 6, false) AND coalesce(ID_PURPOSE <> 1, false)) "
        "AS del FROM wf_refresh_request GROUP BY 1)",
        "kept AS (SELECT p.*, CAST(NULL AS VARCHAR) AS MODE FROM profile p JOIN apps ON apps.app = p.ID_SOLICITUD WHERE NOT apps.del)",
        LATEST_APP_CTE,
        "cp AS (SELECT c.*, l.ID_SOLICITUD AS PREV_SOLICITUD, l.CUSTOMER_NO AS PREV_CUSTOMER_NO FROM cand c "
        "LEFT JOIN latest l ON l.CUSTOMER_NO_FCC = c.CORE_ID)",
        "children0 AS (SELECT mv.ID_CAMPO, mv.ID_TIPO_CAMPO, mv.DESCRIPCION1, CASE WHEN mv.ID_TIPO_CAMPO = 12 THEN "
        "(SELECT min(COUNTRY_CODE) FROM fcc_country WHERE DESCRIPTION = mv.DESCRIPCION1) ELSE mv.DESCRIPCION2 END AS DESCRIPCION2, "
        "cp.NEW_NO AS CUSTOMER_NO, cp.ID_SOLICITUD FROM wf_multi_values mv JOIN cp ON mv.ID_SOLICITUD = cp.PREV_SOLICITUD "
        "AND mv.CUSTOMER_NO = cp.PREV_CUSTOMER_NO WHERE mv.ID_TIPO_CAMPO <> 13)",
        "children AS (SELECT * FROM children0 WHERE NOT (ID_TIPO_CAMPO = 12 AND DESCRIPCION2 IS NULL))",
        f"tx AS (SELECT ID_SOLICITUD, CUSTOMER_NO, {listagg("replace(DESCRIPCION1, ',', ' ^ ')", 'DESCRIPCION1', ' ^ ')} AS countries "
        "FROM children WHERE ID_TIPO_CAMPO = 12 GROUP BY 1, 2)",
        "base AS (SELECT * FROM kept UNION ALL SELECT * FROM loaded)",
        f"fin AS (SELECT {', '.join(carry_cols)}, b.MODE, cp.MODE AS P_MODE FROM base b "
        "LEFT JOIN cp ON cp.ID_SOLICITUD = b.ID_SOLICITUD AND cp.CORE_ID = b.CUSTOMER_NO_FCC "
        "LEFT JOIN latest l2 ON FALSE "
        "LEFT JOIN profile pv ON pv.ID_SOLICITUD = cp.PREV_SOLICITUD AND pv.CUSTOMER_NO = cp.PREV_CUSTOMER_NO "
        "LEFT JOIN (SELECT * FROM fcc_userdef WHERE FUNCTION_ID = 'STDCIF') cu ON substr(cu.REC_KEY, 1, 9) = cp.CORE_ID "
        "LEFT JOIN tx ON tx.ID_SOLICITUD = b.ID_SOLICITUD AND tx.CUSTOMER_NO = cp.NEW_NO)",
    ]


#: Columns by which written tables are read back.
WRITTEN = ["ID_SOLICITUD", "CUSTOMER_NO", "CUSTOMER_NO_FCC", "CUSTOMER_NAME1", "MAIN_CUSTOMER", "SHORT_NAME", "LIAB_ID",
           "COUNTRIES_WHERE_OFFERS", "FECHA_KYC"]


def oracle() -> dict[str, str]:
    w = with_tables(_T, _ctes(), profile=True)
    cols = ", ".join(standins.PROFILE_COLUMNS)
    q: dict[str, str] = {}
    q["group_expand"] = w + "SELECT ID_SOLICITUD, CORE_ID, LIABILITY_NO, GROUP_CODE, MAIN_ID, NEW_NO FROM cand WHERE MODE = 'G'"
    q["one_expand"] = w + "SELECT ID_SOLICITUD, CORE_ID, LIABILITY_NO, GROUP_CODE, MAIN_ID, NEW_NO FROM cand WHERE MODE = 'S'"
    q["previous_row"] = w + ("SELECT ID_SOLICITUD, CORE_ID, NEW_NO, PREV_SOLICITUD, PREV_CUSTOMER_NO FROM cp "
                             "WHERE PREV_SOLICITUD IS NOT NULL")
    q["latest_application"] = w + "SELECT CUSTOMER_NO_FCC, ID_SOLICITUD, CUSTOMER_NO, FECHA FROM latest"
    q["refresh_single"] = w + f"SELECT {cols}, P_MODE AS REFRESH_MODE FROM fin WHERE P_MODE = 'S'"
    q["refresh_group"] = w + f"SELECT {cols}, P_MODE AS REFRESH_MODE FROM fin WHERE P_MODE = 'G'"
    single, group = dict(R.carry_rules(False)), dict(R.carry_rules(True))
    carried = sorted(set(single) | set(group))
    q["carry_forward"] = w + (f"SELECT ID_SOLICITUD, CUSTOMER_NO, {', '.join(carried)} FROM fin f WHERE EXISTS ("
                              "SELECT 1 FROM cp WHERE cp.PREV_SOLICITUD IS NOT NULL AND cp.ID_SOLICITUD = f.ID_SOLICITUD "
                              "AND cp.CORE_ID = f.CUSTOMER_NO_FCC)")
    q["slice_delete"] = w + ("SELECT p.ID_SOLICITUD, count(CASE WHEN apps.del THEN 1 END) AS DELETED_ROWS, "
                             "count(CASE WHEN NOT apps.del THEN 1 END) AS KEPT_ROWS FROM profile p "
                             "JOIN apps ON apps.app = p.ID_SOLICITUD GROUP BY 1")
    q["child_copy_recode"] = w + ("SELECT ID_CAMPO, ID_TIPO_CAMPO, DESCRIPCION1, DESCRIPCION2, CUSTOMER_NO, ID_SOLICITUD "
                                  "FROM children")
    q["values_to_text"] = w + ("SELECT f.ID_SOLICITUD, f.CUSTOMER_NO, f.COUNTRIES_WHERE_OFFERS FROM fin f WHERE EXISTS ("
                               "SELECT 1 FROM cp WHERE cp.PREV_SOLICITUD IS NOT NULL AND cp.ID_SOLICITUD = f.ID_SOLICITUD "
                               "AND cp.CORE_ID = f.CUSTOMER_NO_FCC)")
    q["append_rows"] = w + "SELECT ID_SOLICITUD, CUSTOMER_NO, CUSTOMER_NO_FCC, MODE FROM fin"
    q["audit_rows"] = w + (
        f"SELECT CASE WHEN coalesce(ID_PURPOSE = 6, false) THEN '1. ES KYC UPDATE' ELSE '1. NO ES KYC UPDATE' END AS X, "
        f"CASE WHEN coalesce(ID_PURPOSE = 6, false) THEN CUSTOMER_NO_FCC END AS Y, {AS_OF} AS FECHA FROM wf_refresh_request "
        f"UNION ALL SELECT '2. DESPUES DE INSERT ' || CAST(NEW_NO AS VARCHAR) || '-' || CORE_ID || '-' || "
        f"CAST(PREV_SOLICITUD AS VARCHAR), ' CUSTOMER ANT. ' || CAST(PREV_CUSTOMER_NO AS VARCHAR), {AS_OF} "
        "FROM cp WHERE PREV_SOLICITUD IS NOT NULL "
        f"UNION ALL SELECT '3. DESPUES DE UPDATE ' || CAST(NEW_NO AS VARCHAR) || '-' || CORE_ID, "
        f"' CUSTOMER ANT. ' || CAST(PREV_CUSTOMER_NO AS VARCHAR), {AS_OF} FROM cp WHERE PREV_SOLICITUD IS NOT NULL")
    written = ", ".join(WRITTEN)
    q["slice_overwrite"] = w + (f"SELECT {written} FROM fin UNION ALL SELECT {written} FROM profile p WHERE NOT EXISTS ("
                                "SELECT 1 FROM apps WHERE apps.app = p.ID_SOLICITUD)")
    q["append_children"] = w + (
        "SELECT ID_CAMPO, ID_TIPO_CAMPO, nullif(DESCRIPCION1, '') AS DESCRIPCION1, nullif(DESCRIPCION2, '') AS DESCRIPCION2, "
        "CUSTOMER_NO, ID_SOLICITUD FROM wf_multi_values UNION ALL "
        "SELECT ID_CAMPO, ID_TIPO_CAMPO, DESCRIPCION1, DESCRIPCION2, CUSTOMER_NO, ID_SOLICITUD FROM children")
    q["conditional_child_address"] = w + (
        "SELECT m.CUSTOMER_NO, CASE WHEN m.DEFAULT_MEDIA IN ('FAX', 'SWIFT') THEN a.a1 ELSE m.ADDRESS_LINE1 END AS POSTALALINE1, "
        "CASE WHEN m.DEFAULT_MEDIA IN ('FAX', 'SWIFT') THEN a.a2 ELSE m.ADDRESS_LINE2 END AS POSTALALINE2, "
        "CASE WHEN m.DEFAULT_MEDIA IN ('FAX', 'SWIFT') THEN a.a3 ELSE m.ADDRESS_LINE3 END AS POSTALALINE3, "
        "CASE WHEN m.DEFAULT_MEDIA IN ('FAX', 'SWIFT') THEN a.a4 ELSE m.ADDRESS_LINE4 END AS POSTALACITY "
        "FROM fcc_customer m LEFT JOIN addr a ON a.CUSTOMER_NO = m.CUSTOMER_NO")
    return q
