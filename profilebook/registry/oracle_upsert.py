"""DuckDB oracle SQL for the change jobs (upsert, status, group copy, ids)."""

from __future__ import annotations

from profilebook.plans.profile_rules import INSERT_RULES, PARAMETER_DEFAULTS, PARAMETERS, UPDATE_RULES
from profilebook.registry.oracle_export import ids_cte
from profilebook.registry.oracle_refresh import WRITTEN
from profilebook.registry.sqlkit import recursive, with_tables
from profilebook.sources import standins

AS_OF = "TIMESTAMP '2024-02-01 00:00:00'"
# Columns the change stand-in passes; every other parameter takes its default.
CHANGE_COLUMNS = {
    "REQ_ID", "IN_ID_SOLICITUD", "IN_CUSTOMER_NO", "IN_CUSTOMER_NO_FCC", "IN_CUSTOMER_NAME1", "IN_FULLNAME",
    "IN_SHORT_NAME", "IN_LIAB_ID", "IN_SUB_ECOGR_CD", "IN_CUSTOMER_TYPE", "IN_CUSTOMER_CATEGORY",
    "IN_LEGALREPRESENTATIVE", "IN_LEGALREPRESENTATIVE_INFO", "IN_TELEPHONENUMBER", "IN_PHYSICALALINE3",
    "IN_USA_PROCESS_AGENT", "IN_LOCATIONID", "IN_INCORP_DATE", "IN_FECHA_KYC", "IN_NETWORTH", "IN_AML_RATINGID_NY",
    "IN_NY_AGENCY", "IN_MAIN_CUSTOMER", "IN_CHK_CREATE_FCC", "IN_TIPO_DE_CLIENTE", "IN_GROUP_EXPIRATION_MONTH",
}


def _t(col: str) -> str:
    t = standins.PROFILE_TYPES[col]
    return {"STRING": "VARCHAR", "TIMESTAMP_L": "TIMESTAMP"}.get(t, t)


def _val(rule, old: str | None) -> str:
    col, param, kind = rule
    t = _t(col)
    v = f"c.{param}" if param else None
    if kind == "plain":
        return f"TRY_CAST({v} AS {t})"
    if kind == "upper":
        return f"TRY_CAST(upper(CAST({v} AS VARCHAR)) AS {t})"
    if kind == "date":
        return f"CAST(try_strptime(CAST({v} AS VARCHAR), '%d/%m/%Y') AS DATE)"
    if kind == "keep":
        return f"coalesce(TRY_CAST({v} AS {t}), {old})"
    if kind == "keep_upper":
        return f"coalesce(upper(CAST({v} AS VARCHAR)), {old})"
    if kind == "seq":
        return "c.NEW_NO"
    if kind == "now":
        return f"CAST({AS_OF} AS {t})"
    if kind == "exists":
        return "c.EXISTE"
    if kind == "sentinel":
        return "DATE '1980-01-01'"
    if kind == "decode":
        return f"CASE WHEN CAST({v} AS VARCHAR) IN ('4', '5') THEN 'E' ELSE 'C' END"
    raise ValueError(kind)


def _ctes() -> list[str]:
    extra = []
    for p in PARAMETERS:
        if p not in CHANGE_COLUMNS:
            d = PARAMETER_DEFAULTS.get(p)
            extra.append(f"CAST({repr(d) if d is not None else 'NULL'} AS VARCHAR) AS {p}")
    chg = "chg0 AS (SELECT *, " + ", ".join(extra) + " FROM wf_profile_changes)"
    ex = ("chg AS (SELECT c.*, CASE WHEN c.IN_CUSTOMER_NO_FCC IS NOT NULL AND EXISTS (SELECT 1 FROM fcc_customer f "
          "WHERE f.CUSTOMER_NO = c.IN_CUSTOMER_NO_FCC) THEN '1' ELSE '0' END AS EXISTE FROM chg0 c)")
    # the routine called once per request, application by application, in REQ_ID order: the state of an application is the
    # list of its rows' keys; ins is the request that inserted a row (its number is not known to the requests)
    rq = ("rq AS MATERIALIZED (SELECT REQ_ID, IN_ID_SOLICITUD AS app, IN_CUSTOMER_NO AS no, IN_CUSTOMER_NO_FCC AS fcc, "
          "row_number() OVER (PARTITION BY IN_ID_SOLICITUD ORDER BY REQ_ID) AS k FROM chg0 WHERE IN_ID_SOLICITUD IS NOT NULL)")
    hit = "(coalesce(x.no = r.no, false) OR coalesce(x.fcc = r.fcc, false))"
    call = ("call AS (SELECT a.app, CAST(0 AS BIGINT) AS k, CAST(NULL AS BIGINT) AS REQ_ID, coalesce(list({'no': p.CUSTOMER_NO, "
            "'fcc': p.CUSTOMER_NO_FCC, 'ins': CAST(NULL AS BIGINT)}) FILTER (p.CUSTOMER_NO IS NOT NULL), []) AS state, "
            "CAST([] AS STRUCT(no BIGINT, fcc VARCHAR, ins BIGINT)[]) AS hit "
            "FROM (SELECT DISTINCT app FROM rq) a LEFT JOIN profile p ON p.ID_SOLICITUD = a.app GROUP BY a.app "
            f"UNION ALL SELECT c.app, r.k, r.REQ_ID, CASE WHEN len(list_filter(c.state, lambda x: {hit})) = 0 "
            "THEN list_append(c.state, {'no': CAST(NULL AS BIGINT), 'fcc': r.fcc, 'ins': r.REQ_ID}) "
            f"ELSE list_transform(c.state, lambda x: CASE WHEN {hit} THEN {{'no': x.no, 'fcc': r.fcc, 'ins': x.ins}} ELSE x END) END, "
            f"list_filter(c.state, lambda x: {hit}) FROM call c JOIN rq r ON r.app = c.app AND r.k = c.k + 1)")
    hits = ("hits AS MATERIALIZED (SELECT REQ_ID, app, h.no AS no, h.ins AS ins FROM (SELECT REQ_ID, app, unnest(hit) AS h FROM call))")
    ins = ("ins AS (SELECT c.*, (SELECT coalesce(max(CUSTOMER_NO), 0) FROM profile) + row_number() OVER (ORDER BY c.REQ_ID) "
           "AS NEW_NO FROM chg c WHERE NOT EXISTS (SELECT 1 FROM hits h WHERE h.REQ_ID = c.REQ_ID))")
    m = ("m AS (SELECT h.REQ_ID, h.app AS ID_SOLICITUD, coalesce(h.no, i.NEW_NO) AS CUSTOMER_NO FROM hits h "
         "LEFT JOIN ins i ON i.REQ_ID = h.ins)")
    return [chg, ex, rq, call, hits, ins, m]


def _touched() -> tuple[str, str]:
    """Tables, and the select over them, of the rows as the calls leave them: the last call writes the row, a kept column takes the last value given."""
    upd = {r[0]: r for r in UPDATE_RULES}
    ins = {r[0]: r for r in INSERT_RULES}
    kept = [c for c, r in upd.items() if r[2] in ("keep", "keep_upper")]
    icols = ", ".join(f"{_val(ins[col], None) if col in ins else 'CAST(NULL AS ' + _t(col) + ')'} AS {col}"
                      for col in standins.PROFILE_COLUMNS)
    before = f"before AS (SELECT {', '.join(standins.PROFILE_COLUMNS)} FROM profile UNION ALL SELECT {icols} FROM ins c)"
    given = ", ".join(f"arg_max({_val(upd[col], 'NULL')}, c.REQ_ID) FILTER ({_val(upd[col], 'NULL')} IS NOT NULL) AS g_{col}" for col in kept)
    last = f"last AS (SELECT m.ID_SOLICITUD, m.CUSTOMER_NO, max(m.REQ_ID) AS REQ_ID, {given} FROM m JOIN chg c ON c.REQ_ID = m.REQ_ID GROUP BY 1, 2)"
    ucols = ", ".join((f"coalesce(u.g_{col}, o.{col})" if col in kept else _val(upd[col], None) if col in upd else f"o.{col}") + f" AS {col}"
                      for col in standins.PROFILE_COLUMNS)
    names = ", ".join("o." + col for col in standins.PROFILE_COLUMNS)
    return f", {before}, {last}", (f"SELECT {ucols} FROM before o JOIN last u ON u.ID_SOLICITUD = o.ID_SOLICITUD AND u.CUSTOMER_NO = o.CUSTOMER_NO "
            f"JOIN chg c ON c.REQ_ID = u.REQ_ID UNION ALL SELECT {names} FROM before o JOIN ins i ON i.NEW_NO = o.CUSTOMER_NO "
            "WHERE NOT EXISTS (SELECT 1 FROM last u WHERE u.ID_SOLICITUD = o.ID_SOLICITUD AND u.CUSTOMER_NO = o.CUSTOMER_NO)")


def after_sql() -> str:
    """Tables of the calls and ``after``: the rows they leave."""
    tables, select = _touched()
    head = recursive(with_tables(["wf_profile_changes", "fcc_customer"], _ctes(), profile=True)).rstrip()
    return f"{head}{tables}, after AS ({select}) "


def oracle() -> dict[str, str]:
    q: dict[str, str] = {}
    w = recursive(with_tables(["wf_profile_changes", "fcc_customer"], _ctes(), profile=True))
    q["upsert_profiles"] = w + (
        "SELECT c.REQ_ID, CASE WHEN EXISTS (SELECT 1 FROM m WHERE m.REQ_ID = c.REQ_ID) THEN 'ACTUALIZADO' ELSE 'INSERTADO' END "
        "AS RESULTADO, CASE WHEN EXISTS (SELECT 1 FROM m WHERE m.REQ_ID = c.REQ_ID) THEN CAST(c.IN_CUSTOMER_NO AS BIGINT) "
        "ELSE (SELECT i.NEW_NO FROM ins i WHERE i.REQ_ID = c.REQ_ID) END AS CUSTOMER_NO FROM chg c")
    tables, select = _touched()
    q["upsert_null_preserving"] = f"{w.rstrip()}{tables} {select}"
    written = ", ".join(WRITTEN)
    q["upsert_written"] = f"{after_sql()}SELECT {written} FROM after UNION ALL SELECT {written} FROM profile p " + (
        "WHERE NOT EXISTS (SELECT 1 FROM m WHERE m.ID_SOLICITUD = p.ID_SOLICITUD AND m.CUSTOMER_NO = p.CUSTOMER_NO)")
    q["append_results"] = q["upsert_profiles"]
    q["either_key_match"] = w + "SELECT REQ_ID, ID_SOLICITUD, CUSTOMER_NO FROM m"
    q["exists_flag"] = w + "SELECT REQ_ID, IN_CUSTOMER_NO_FCC, EXISTE AS ID_EXISTE_FCC FROM chg"
    q["assign_keys"] = w + "SELECT REQ_ID, NEW_NO AS CUSTOMER_NO FROM ins"
    q["parameter_defaults"] = w + ("SELECT REQ_ID, " + ", ".join(sorted(PARAMETER_DEFAULTS)) + " FROM chg")
    lm = with_tables(["wf_profile_changes", "fcc_customer", "wf_lmt_customer"], _ctes() + [
        "u AS (SELECT * FROM chg c WHERE EXISTS (SELECT 1 FROM m WHERE m.REQ_ID = c.REQ_ID))",
        "a AS (SELECT IN_ID_SOLICITUD, IN_CUSTOMER_NO, arg_max(IN_CUSTOMER_NAME1, REQ_ID) AS n1, max(REQ_ID) * 2 AS o1 "
        "FROM u GROUP BY 1, 2)",
        "b AS (SELECT IN_ID_SOLICITUD, IN_CUSTOMER_NO_FCC, arg_max(IN_CUSTOMER_NAME1, REQ_ID) AS n2, max(REQ_ID) * 2 + 1 AS o2 "
        "FROM u GROUP BY 1, 2)"], profile=True)
    q["propagate_name"] = recursive(lm) + (
        "SELECT l.ID_SOLICITUD, l.CUSTOMER_ID, l.CUSTOMER_NO, CASE WHEN a.o1 IS NULL AND b.o2 IS NULL THEN l.CUSTOMER_NAME "
        "WHEN coalesce(b.o2, -1) > coalesce(a.o1, -1) THEN b.n2 ELSE a.n1 END AS CUSTOMER_NAME, l.CUSTOMER_TYPE "
        "FROM wf_lmt_customer l LEFT JOIN a ON a.IN_ID_SOLICITUD = l.ID_SOLICITUD AND a.IN_CUSTOMER_NO = l.CUSTOMER_ID "
        "LEFT JOIN b ON b.IN_ID_SOLICITUD = l.ID_SOLICITUD AND b.IN_CUSTOMER_NO_FCC = l.CUSTOMER_NO AND l.CUSTOMER_TYPE <> 'G'")
    ev = ("ev AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY ID_CUSTOMER_FCC ORDER BY EVENT_TS DESC, "
          "EVENT_ID DESC) AS rn FROM wf_status_events) WHERE rn = 1)")
    q["status_update"] = with_tables(["wf_status_events"], [ev], profile=True) + (
        "SELECT p.ID_SOLICITUD, p.CUSTOMER_NO, p.ID_CUSTOMER_FCC, ev.ID_STATUS_FCC, ev.MSG_ERROR_FCC, "
        "ev.EVENT_TS AS FECHA_CREACION_CLIENTE, CAST(ev.EVENT_TS AS DATE) AS INCEPTION_DATE "
        "FROM profile p JOIN ev ON ev.ID_CUSTOMER_FCC = p.ID_CUSTOMER_FCC")
    mains = ("mn AS (SELECT p.ID_SOLICITUD, arg_min(p.CUSTOMER_TYPE, p.CUSTOMER_NO) AS t, "
             "arg_min(p.CUSTOMER_CATEGORY, p.CUSTOMER_NO) AS c, arg_min(p.INDUSTRY, p.CUSTOMER_NO) AS i FROM profile p JOIN wf_customer_type k ON k.CUSTOMER_ID = p.CUSTOMER_TYPE "
             "WHERE p.MAIN_CUSTOMER = 1 GROUP BY 1)")
    q["copy_main_to_group"] = with_tables(["wf_customer_type"], [mains], profile=True) + (
        "SELECT p.ID_SOLICITUD, p.CUSTOMER_NO, CASE WHEN mn.ID_SOLICITUD IS NOT NULL THEN mn.t ELSE p.CUSTOMER_TYPE END AS CUSTOMER_TYPE, "
        "CASE WHEN mn.ID_SOLICITUD IS NOT NULL THEN mn.c ELSE p.CUSTOMER_CATEGORY END AS CUSTOMER_CATEGORY, "
        "CASE WHEN mn.ID_SOLICITUD IS NOT NULL THEN mn.i ELSE p.INDUSTRY END AS INDUSTRY, "
        "CASE WHEN mn.ID_SOLICITUD IS NOT NULL THEN DATE '1990-01-01' ELSE p.FECHA_KYC END AS FECHA_KYC "
        "FROM profile p LEFT JOIN mn ON mn.ID_SOLICITUD = p.ID_SOLICITUD WHERE p.LMT_CUSTOMER_TYPE = 'G'")
    ids = with_tables([], [ids_cte()], profile=True)
    q["fill_missing_ids"] = ids + "SELECT ID_SOLICITUD, CUSTOMER_NO, FIRST_ID AS ID_CUSTOMER_FCC FROM ids"
    q["reissue_failed_ids"] = ids + "SELECT ID_SOLICITUD, CUSTOMER_NO, NEW_ID AS ID_CUSTOMER_FCC FROM ids"
    return q
