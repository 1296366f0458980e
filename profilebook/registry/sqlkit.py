"""Helpers that write DuckDB oracle SQL mirroring the Oracle semantics."""

from __future__ import annotations

from profilebook.sources import standins


def profile_cte() -> str:
    """The profile with the null model applied ('' -> NULL), as CTE ``profile``."""
    cols = []
    for c in standins.PROFILE_COLUMNS:
        if standins.PROFILE_TYPES[c] == "STRING":
            cols.append(f"nullif({c}, '') AS {c}")
        else:
            cols.append(c)
    return "profile AS (SELECT " + ", ".join(cols) + " FROM wf_customer_info)"


def with_tables(names: list[str], extra_ctes: list[str] | None = None, profile: bool = False) -> str:
    """WITH clause: the stand-ins named (plus dependencies), then extra CTEs."""
    need = list(names) + (["wf_customer_info"] if profile else [])
    head = standins.with_clause(need)
    ctes = ([profile_cte()] if profile else []) + list(extra_ctes or [])
    if not ctes:
        return head
    if head:
        return head.rstrip("\n") + ",\n" + ",\n".join(ctes) + "\n"
    return "WITH " + ",\n".join(ctes) + "\n"


def recursive(head: str) -> str:
    """A WITH clause whose tables may refer to themselves."""
    return head.replace("WITH ", "WITH RECURSIVE ", 1)


def ncat(*parts: str) -> str:
    """Oracle ``||`` (NULL as '') with '' -> NULL; bare strings are SQL expressions."""
    return "nullif(concat(" + ", ".join(f"coalesce(CAST({p} AS VARCHAR), '')" for p in parts) + "), '')"


def fmt_mon(col: str) -> str:
    return f"upper(strftime({col}, '%d/%b/%Y'))"


def fmt_compact(col: str) -> str:
    return f"strftime({col}, '%Y%m%d')"


def fmt_dmy(col: str) -> str:
    return f"strftime({col}, '%d/%m/%Y')"


def fmt_iso(col: str) -> str:
    return f"strftime({col}, '%Y-%m-%d')"


def number_text(col: str) -> str:
    s = f"CAST({col} AS VARCHAR)"
    s = (f"CASE WHEN strpos({s}, '.') > 0 THEN regexp_replace(regexp_replace({s}, '0+$', ''), '\\.$', '') "
         f"ELSE {s} END")
    return f"regexp_replace({s}, '^(-?)0\\.', '\\1.')"


def listagg(item: str, order: str, sep: str, trailing: bool = False) -> str:
    """string_agg of the non-empty items, in order, whole."""
    agg = f"string_agg({item}, '{sep}' ORDER BY {order}) FILTER (WHERE {item} <> '')"
    return f"{agg} || '{sep}'" if trailing else agg
