"""DuckDB oracle SQL for rejects, changes and action codes."""

from __future__ import annotations

from profilebook.plans.checks import COMPARED, FIELD_DATES, SUBMITTED_DATES
from profilebook.registry import oracle_upsert
from profilebook.registry.sqlkit import with_tables

_TABLES = ["wf_profile_changes", "fcc_userdef"]
_ACTIONS = {
    "1": "status_update", "2": "flag_zero_when_any", "3": "export_customers", "4": "export_groups", "5": "flag_one_when_any",
    "6": "count_correlated", "7": "counts_expected_actual", "8": "group_approval_list", "9": "field_catalogue", "10": "notice_text",
    "11": "profile_diff", "12": "master_profile", "13": "master_profile_any", "14": "directors_sorted", "15": "master_directors",
    "16": "existing_auth_check", "17": "shareholder_list",
}


def _fault(column: str, fmt: str, shape: str) -> str:
    return (f"CASE WHEN {column} <> '' AND try_strptime({column}, '{fmt}') IS NULL THEN "
            f"CASE WHEN regexp_matches({column}, '{shape}') THEN 'CALENDAR' ELSE 'FORMAT' END END")


def _faults() -> str:
    parts = [(c, "SUBMISSION", "CAST(REQ_ID AS VARCHAR)", "wf_profile_changes", "%d/%m/%Y", "^[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}$") for c in SUBMITTED_DATES]
    parts += [(c, "USER FIELDS", "REC_KEY", "(SELECT * FROM fcc_userdef WHERE FUNCTION_ID = 'STDCIF')", "%Y-%m-%d", "^[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}$")
              for c in FIELD_DATES]
    return " UNION ALL ".join(f"SELECT '{source}' AS SOURCE, {key} AS ROW_KEY, '{c}' AS COLUMN_NAME, {c} AS VALUE, {_fault(c, fmt, shape)} AS REASON "
                              f"FROM {table} WHERE {_fault(c, fmt, shape)} IS NOT NULL" for c, source, key, table, fmt, shape in parts)


def oracle(others: dict[str, str]) -> dict[str, str]:
    q: dict[str, str] = {}
    faults = f"faults AS ({_faults()})"
    q["date_rejects"] = with_tables(_TABLES, [faults]) + "SELECT * FROM faults"
    q["date_checked"] = with_tables(_TABLES, [faults, (
        "seen AS (SELECT 'SUBMISSION' AS SOURCE, count(*) AS n FROM wf_profile_changes UNION ALL "
        "SELECT 'USER FIELDS', count(*) FROM fcc_userdef WHERE FUNCTION_ID = 'STDCIF')")]) + (
        "SELECT SOURCE, n AS ROWS_READ, bad AS ROWS_REJECTED, n - bad AS ROWS_GOOD FROM (SELECT s.SOURCE, s.n, count(DISTINCT f.ROW_KEY) AS bad "
        "FROM seen s LEFT JOIN faults f ON f.SOURCE = s.SOURCE GROUP BY 1, 2)")
    q["main_rejects"] = oracle_upsert.after_sql() + (
        "SELECT ID_SOLICITUD, min(CUSTOMER_NO) AS MAIN_NO, count(*) AS MAIN_COUNT FROM (SELECT ID_SOLICITUD, CUSTOMER_NO, MAIN_CUSTOMER, RELACIONADO "
        "FROM after UNION ALL SELECT ID_SOLICITUD, CUSTOMER_NO, MAIN_CUSTOMER, RELACIONADO FROM profile p WHERE NOT EXISTS (SELECT 1 FROM m "
        "WHERE m.ID_SOLICITUD = p.ID_SOLICITUD AND m.CUSTOMER_NO = p.CUSTOMER_NO)) WHERE MAIN_CUSTOMER = 1 AND RELACIONADO IS NULL "
        "GROUP BY 1 HAVING count(*) > 1")
    q["lookup_scalar_rejects"] = with_tables(["fcc_userdef"], [], profile=True) + (
        "SELECT * FROM (SELECT ID_SOLICITUD, CUSTOMER_NO, CUSTOMER_NO_FCC, (SELECT count(*) FROM fcc_userdef u "
        "WHERE substr(u.REC_KEY, 1, 9) = p.CUSTOMER_NO_FCC) AS ROWS_FOUND FROM profile p) WHERE ROWS_FOUND > 1")
    q["description_rejects"] = with_tables(["wf_multi_values", "fcc_country"]) + (
        "SELECT * FROM (SELECT ID_SOLICITUD, CUSTOMER_NO, DESCRIPCION1, (SELECT count(*) FROM fcc_country c "
        "WHERE c.DESCRIPTION = v.DESCRIPCION1) AS ROWS_FOUND FROM wf_multi_values v WHERE ID_TIPO_CAMPO = 12 AND DESCRIPCION1 <> '') "
        "WHERE ROWS_FOUND <> 1")
    cells = ", ".join(f"{{'c': '{a}', 'o': CAST(o.\"{a}\" AS VARCHAR), 'n': CAST(n.\"{b}\" AS VARCHAR)}}" for a, b in COMPARED.items())
    q["profile_changes"] = (
        f"WITH new_rows AS ({others['profile_diff']}), old_rows AS ({others['master_profile']}) SELECT ID_SOLICITUD, CUSTOMER_NO_FCC, "
        "x.c AS COLUMN_NAME, x.o AS OLD_VALUE, x.n AS NEW_VALUE FROM (SELECT n.ID_SOLICITUD, n.CUSTOMER_NO_FCC, "
        f"unnest([{cells}]) AS x FROM new_rows n JOIN old_rows o ON o.\"Customer No\" = n.CUSTOMER_NO_FCC) WHERE x.o IS DISTINCT FROM x.n")
    q["action_rows"] = " UNION ALL ".join(f"SELECT '{code}' AS ACCION, count(*) AS FILAS FROM ({others[name]})" for code, name in _ACTIONS.items())
    return q
