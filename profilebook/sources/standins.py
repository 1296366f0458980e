"""Workflow and core-banking tables, landed from the driver's TPC-H-style tables.

The reference reads a local workflow schema (``WF_*``) and a core-banking
master through a database link.  Neither ships data, so each table here is a
*stand-in*: a plain SQL projection of the driver tables into the schema the
jobs expect (mapping in FIXTURES.md section 3).  A stand-in does none of the
jobs' work; it only gives rows of the right shape, with nulls, empty texts,
duplicates and sentinels where the jobs must cope with them.

The SQL is written in the subset that both Spark SQL and DuckDB accept, so the
Spark jobs and the DuckDB oracle read byte-identical inputs.  Placeholders in
braces name driver tables or other stand-ins; :func:`build` resolves them to
DataFrames through ``spark.sql(text, **frames)``, :func:`with_clause` to CTEs.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

BASE_TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
)

# Fixed values of the mapping (stated once, used everywhere below).
# Local party number = application * PARTY_STRIDE for the main party,
# + supplier key + 1 for a related party; the group row of an application
# takes the last number of its block.
PARTY_STRIDE = 10000000
GROUP_SLOT = PARTY_STRIDE - 1


def _cc(nk: str) -> str:
    """Country code of a nation key: three codes the rules name, else N<kk>."""
    return (f"CASE {nk} WHEN 1 THEN 'ARG' WHEN 2 THEN 'BR' WHEN 3 THEN 'PA' "
            f"ELSE 'N' || lpad(CAST({nk} AS STRING), 2, '0') END")


def _core(prefix: str, key: str) -> str:
    return f"'{prefix}' || lpad(CAST({key} AS STRING), 8, '0')"


def _creation_id(local_no: str) -> str:
    return f"'CUS' || lpad(CAST({local_no} AS STRING), 13, '0')"


def _date(y: str, m: str, d: str) -> str:
    return f"make_date(CAST({y} AS INT), CAST({m} AS INT), CAST({d} AS INT))"


CUST_CORE = _core("C", "c.c_custkey")
SUPP_CORE = _core("S", "s.s_suppkey")
GROUP_CORE = _core("G", "n.n_nationkey")
MAIN_NO = f"o.o_orderkey * {PARTY_STRIDE}"
REL_NO = f"l.l_orderkey * {PARTY_STRIDE} + l.l_suppkey + 1"
GRP_NO = f"o.o_orderkey * {PARTY_STRIDE} + {GROUP_SLOT}"

# --------------------------------------------------------------------------
# Profile table (WF_KCC_CUSTOMER_INFO): one row per (application, party).
# (column, type, main-party expr, related-party expr, group-row expr)
# --------------------------------------------------------------------------
PROFILE_SPEC: list[tuple[str, str, str, str, str]] = [
    ("ID_SOLICITUD", "BIGINT", "o.o_orderkey", "l.l_orderkey", "o.o_orderkey"),
    ("CUSTOMER_NO", "BIGINT", MAIN_NO, REL_NO, GRP_NO),
    ("CUSTOMER_NO_FCC", "STRING",
     f"CASE WHEN o.o_orderstatus = 'P' AND o.o_orderpriority = '5-LOW' THEN NULL ELSE {CUST_CORE} END",
     SUPP_CORE, GROUP_CORE),
    ("MAIN_CUSTOMER", "INT", "1", "CASE WHEN l.l_suppkey % 4 = 0 THEN NULL ELSE 0 END", "0"),
    ("RELACIONADO", "STRING", "NULL", "'1'", "NULL"),
    ("ID_MAIN_CUSTOMER", "STRING", _core("C", "nm.main_custkey"), CUST_CORE, _core("C", "nm.main_custkey")),
    ("SHAREHOLDER", "BIGINT", "NULL", "l.l_suppkey", "NULL"),
    ("CUSTOMER_TYPE", "INT",
     "CASE c.c_mktsegment WHEN 'BUILDING' THEN NULL WHEN 'MACHINERY' THEN 4 WHEN 'FURNITURE' THEN 6 ELSE 1 END",
     "CASE s.s_nationkey % 3 WHEN 0 THEN 2 WHEN 1 THEN 5 ELSE 7 END", "1"),
    ("LMT_CUSTOMER_TYPE", "STRING",
     "CASE WHEN c.c_mktsegment = 'MACHINERY' THEN 'E' ELSE 'C' END",
     "CASE WHEN s.s_nationkey = 0 THEN NULL WHEN s.s_nationkey % 3 = 1 THEN 'E' ELSE 'C' END", "'G'"),
    ("CUSTOMER_NAME1", "STRING", "c.c_name", "s.s_name", "'GROUP ' || n.n_name"),
    ("FULLNAME", "STRING", "c.c_name || ' S.A.'", "s.s_name || ' BANK'", "'ECONOMIC GROUP ' || n.n_name"),
    ("SHORT_NAME", "STRING", "substr(c.c_name, 10)", "substr(s.s_name, 10)", "n.n_name"),
    ("TAXIDNUMBER", "STRING", "'RUC-' || CAST(c.c_custkey AS STRING)", "'RUC-S' || CAST(s.s_suppkey AS STRING)", "NULL"),
    ("DV", "STRING", "CAST(c.c_custkey % 97 AS STRING)", "CAST(s.s_suppkey % 97 AS STRING)", "NULL"),
    ("CUSTOMER_CATEGORY", "STRING", "substr(c.c_mktsegment, 1, 4)", "'BANK'", "substr(c.c_mktsegment, 1, 4)"),
    ("RELATIONTYPE", "STRING",
     "CASE o.o_orderpriority WHEN '1-URGENT' THEN 'RT_PROMO' WHEN '2-HIGH' THEN 'RT_STANDARD' "
     "WHEN '3-MEDIUM' THEN 'RT_LARGE' WHEN '4-NOT SPECIFIED' THEN 'RT_UNKNOWN' ELSE NULL END",
     "CASE l.l_returnflag WHEN 'R' THEN 'RT_SMALL' WHEN 'A' THEN 'RT_ECONOMY' ELSE 'RT_MEDIUM' END", "NULL"),
    ("INDUSTRY", "STRING", "'IND_' || c.c_mktsegment", "NULL", "'IND_' || c.c_mktsegment"),
    ("NAMEOFECONOMICGROUP", "STRING", "'GROUP ' || n.n_name", "NULL", "'GROUP ' || n.n_name"),
    ("LEGALREPRESENTATIVE", "STRING", "'rep ' || c.c_name", "NULL", "NULL"),
    ("LEGALREPRESENTATIVE_INFO", "STRING", "'passport ' || CAST(c.c_custkey AS STRING)", "NULL", "NULL"),
    ("NAMEEXTERNALAUDITORS", "STRING",
     "CASE WHEN c.c_acctbal > 0 THEN 'AUDIT ' || r.r_name || '   ' ELSE NULL END", "'BANK AUDITOR'", "NULL"),
    ("NAMEINTERNATIONALRISK", "STRING",
     "'MOODYS:A' || CAST(c.c_custkey % 3 + 1 AS STRING) || ' SP:' || "
     "CASE WHEN c.c_custkey % 4 = 0 THEN '' ELSE 'AA' END || ' FITCH:' || "
     "CASE WHEN c.c_acctbal > 5000 THEN 'BBB' ELSE '' END",
     "CASE WHEN s.s_suppkey % 2 = 0 THEN 'MOODYS:Aa2 SP:AA- FITCH:AA' ELSE NULL END", "NULL"),
    ("POSTALALINE1", "STRING", "'PO BOX ' || CAST(c.c_custkey AS STRING)", "'SWIFT HOUSE ' || CAST(s.s_suppkey AS STRING)", "NULL"),
    ("POSTALALINE2", "STRING", "CASE WHEN c.c_custkey % 2 = 0 THEN 'ZONE ' || CAST(c.c_nationkey AS STRING) ELSE NULL END", "NULL", "NULL"),
    ("POSTALALINE3", "STRING", "CASE WHEN c.c_custkey % 5 = 0 THEN '' ELSE NULL END", "NULL", "NULL"),
    ("POSTALACITY", "STRING", "'CITY ' || r.r_name", "'CITY ' || r.r_name", "NULL"),
    ("PHYSICALALINE1", "STRING", "'STREET ' || CAST(c.c_custkey % 50 AS STRING)", "'AVENUE ' || CAST(s.s_suppkey AS STRING)", "'HQ ' || n.n_name"),
    ("PHYSICALALINE2", "STRING", "CASE WHEN c.c_custkey % 3 = 0 THEN 'FLOOR 2' ELSE NULL END", "NULL", "NULL"),
    ("PHYSICALALINE3", "STRING", "'building ' || c.c_mktsegment", "NULL", "NULL"),
    ("TELEPHONENUMBER", "STRING", "'+507-' || lpad(CAST(c.c_custkey AS STRING), 7, '0')", "'+1-' || lpad(CAST(s.s_suppkey AS STRING), 7, '0')", "NULL"),
    ("TELEPHONENUMBER2", "STRING", "CASE WHEN c.c_custkey % 3 = 0 THEN '' ELSE '+1-' || lpad(CAST(c.c_custkey AS STRING), 7, '0') END", "NULL", "NULL"),
    ("FAXNUMBER", "STRING", "CASE WHEN c.c_mktsegment = 'AUTOMOBILE' THEN '+507-FAX-' || CAST(c.c_custkey AS STRING) ELSE NULL END", "'+1-FAX-' || CAST(s.s_suppkey AS STRING)", "NULL"),
    ("WEBSITE", "STRING", "CASE WHEN c.c_custkey % 4 = 1 THEN '' ELSE 'www.c' || CAST(c.c_custkey AS STRING) || '.com' END", "'www.s' || CAST(s.s_suppkey AS STRING) || '.com'", "NULL"),
    ("EMAIL", "STRING", "'INFO@C' || CAST(c.c_custkey AS STRING) || '.COM'", "NULL", "NULL"),
    ("DEFAULT_MEDIA", "STRING", "CASE c.c_mktsegment WHEN 'AUTOMOBILE' THEN 'FAX' WHEN 'BUILDING' THEN 'SWIFT' ELSE 'MAIL' END", "'SWIFT'", "'MAIL'"),
    ("INCORP_COUNTRYID", "STRING", _cc("n.n_nationkey"), _cc("n.n_nationkey"), _cc("n.n_nationkey")),
    ("INCORP_DATE", "DATE", _date("1950 + c.c_custkey % 60", "1 + c.c_custkey % 12", "1 + c.c_custkey % 28"), _date("1900 + s.s_suppkey % 100", "6", "30"), "NULL"),
    ("RESIDENCECOUNTRY", "STRING", _cc("n.n_nationkey"), _cc("n.n_nationkey"), _cc("n.n_nationkey")),
    ("NATIONALITYID", "STRING", _cc("(n.n_nationkey + 1) % 25"), _cc("n.n_nationkey"), "NULL"),
    ("EXPOSURE_COUNTRYID", "STRING", _cc("n.n_regionkey * 5"), "NULL", "NULL"),
    ("RESIDENCELOCATIONID", "STRING", "'L' || CAST(n.n_regionkey AS STRING)", "'L' || CAST(n.n_regionkey AS STRING)", "'L' || CAST(n.n_regionkey AS STRING)"),
    ("LANGUAGEID", "STRING", "CASE WHEN c.c_custkey % 6 = 0 THEN NULL ELSE upper(substr(r.r_name, 1, 3)) END", "'ENG'", "'ENG'"),
    ("BANKTYPE", "STRING", "CASE WHEN c.c_custkey % 9 = 0 THEN 'Not aplicable' ELSE 'NA' END",
     "CASE WHEN s.s_suppkey % 7 = 0 THEN 'BANK UNKNOWN' ELSE 'BANK ' || r.r_name END", "'NA'"),
    ("TYPEOFLICENCE", "STRING", "CASE WHEN c.c_custkey % 2 = 0 THEN 'GENERAL' ELSE NULL END", "'INTERNATIONAL'", "NULL"),
    ("SWIFT_CODE", "STRING", "'SWC' || CAST(c.c_custkey AS STRING)", "'SWS' || CAST(s.s_suppkey AS STRING)", "NULL"),
    ("ABACODEVALUE", "STRING", "NULL", "'ABA' || CAST(s.s_suppkey AS STRING)", "NULL"),
    ("COMPLIANCEOFFICER", "STRING", "CASE WHEN c.c_custkey % 3 = 2 THEN NULL ELSE 'OFFICER ' || CAST(c.c_nationkey AS STRING) END", "'BANK COMPLIANCE'", "NULL"),
    ("ADDRESSPROCESSAGENTINUSA", "STRING", "CASE WHEN c.c_custkey % 2 = 1 THEN 'AGENT NY ' || CAST(c.c_custkey AS STRING) || '  ' ELSE NULL END", "NULL", "NULL"),
    ("NETWORTH", "DECIMAL(38,10)", "CAST(c.c_acctbal AS DECIMAL(38,10))", "CAST(s.s_acctbal AS DECIMAL(38,10))", "NULL"),
    ("INCEPTION_DATE", "DATE", "CAST(o.o_orderdate AS DATE)", "CAST(l.l_shipdate AS DATE)", "NULL"),
    ("PRODUCT_SERVICE_OFFERED", "STRING", "'PRODUCTS ' || c.c_mktsegment", "'CORRESPONDENT BANKING'", "NULL"),
    ("RELATEDCOMPANIES", "STRING", "CASE WHEN c.c_custkey % 5 = 2 THEN 'SUBSIDIARY OF ' || n.n_name ELSE NULL END", "NULL", "NULL"),
    ("RELATEDACCOUNT", "STRING", "'ACC' || CAST(o.o_orderkey AS STRING)", "NULL", "NULL"),
    ("NAME_ADDRESS_LEGAL_ADVISOR", "STRING", "CASE WHEN c.c_custkey % 4 = 2 THEN NULL ELSE 'LAW FIRM ' || r.r_name || ' ' END", "NULL", "NULL"),
    ("REFERENCE_BANKING_COMMERCIAL", "STRING", "'REF BANK ' || CAST(c.c_nationkey AS STRING)", "NULL", "NULL"),
    ("NAME_OF_STOCK", "STRING", "CASE WHEN c.c_acctbal > 8000 THEN 'STOCK ' || n.n_name ELSE NULL END", "NULL", "NULL"),
    ("COUNTRIES_WHERE_OFFERS", "STRING", "n.n_name", "NULL", "NULL"),
    ("REGULATORY_AUTHORITY", "STRING", "'SBP'", "'CENTRAL BANK ' || n.n_name", "NULL"),
    ("GROUP_CODE", "STRING", _core("G", "n.n_nationkey"), "NULL",
     f"CASE WHEN o.o_orderstatus = 'F' THEN NULL ELSE {_core('G', 'n.n_nationkey')} END"),
    ("LIAB_ID", "STRING", CUST_CORE, SUPP_CORE, _core("C", "nm.main_custkey")),
    ("ID_SOLICITUD_LM", "BIGINT", "CASE WHEN o.o_orderstatus <> 'P' THEN o.o_orderkey ELSE NULL END",
     "CASE WHEN l.l_returnflag = 'R' THEN l.l_orderkey ELSE NULL END", "NULL"),
    ("SUB_ECOGR_CD", "STRING", "'SEG' || CAST(n.n_regionkey AS STRING)", "NULL", "'SEG' || CAST(n.n_regionkey AS STRING)"),
    ("ECONOMICGROUPRUC", "STRING", "'RUC-G' || CAST(n.n_nationkey AS STRING)", "NULL", "'RUC-G' || CAST(n.n_nationkey AS STRING)"),
    ("LAST_CHANGE_DATE", "TIMESTAMP_L", "o.o_orderdate", "l.l_shipdate", "o.o_orderdate"),
    ("CHK_CREATE_FCC", "INT", "CASE WHEN o.o_orderstatus = 'P' AND o.o_orderpriority = '4-NOT SPECIFIED' THEN 0 ELSE 1 END",
     "CASE WHEN l.l_suppkey % 3 = 0 THEN 0 ELSE 1 END", "1"),
    ("CHK_SAMESHOLDERS_MAINCUST", "STRING", "'0'", "CASE WHEN l.l_suppkey % 2 = 0 THEN '1' ELSE '0' END", "NULL"),
    ("ID_EXISTE_FCC", "STRING", "CASE o.o_orderstatus WHEN 'F' THEN '1' WHEN 'O' THEN '0' ELSE NULL END",
     "CASE WHEN l.l_returnflag = 'N' THEN '1' ELSE '0' END", "CASE WHEN o.o_orderstatus = 'F' THEN '1' ELSE NULL END"),
    ("LIMIT_EXP_DATE", "DATE", f"CASE WHEN o.o_orderpriority = '5-LOW' THEN NULL ELSE {_date('2025 + o.o_orderkey % 3', '1 + o.o_orderkey % 12', '15')} END",
     "CASE WHEN l.l_suppkey % 5 = 0 THEN DATE '1980-01-01' ELSE NULL END", "DATE '1980-01-01'"),
    ("ACCOUNT_OFFICERID", "STRING",
     "CASE o.o_orderpriority WHEN '1-URGENT' THEN 'OFF_PROMO' WHEN '2-HIGH' THEN 'OFF_STANDARD' WHEN '3-MEDIUM' THEN 'OFF_LARGE' ELSE 'OFF_SMALL' END",
     "NULL", "'OFF_ECONOMY'"),
    ("LOCATIONID", "STRING", "'LOC_' || r.r_name", "NULL", "'LOC_' || r.r_name"),
    ("AML_RATINGID", "STRING", "c.c_mktsegment", "'HOUSEHOLD'", "NULL"),
    ("AML_RATINGID_NY", "STRING", "CASE WHEN c.c_acctbal > 5000 THEN 'AUTOMOBILE' ELSE NULL END", "NULL", "NULL"),
    ("NY_AGENCY", "STRING", "CASE c.c_custkey % 3 WHEN 0 THEN '1' WHEN 1 THEN '0' ELSE NULL END", "'0'", "NULL"),
    ("SBP_CATEGORYID", "INT", "n.n_regionkey + 1", "NULL", "NULL"),
    ("CUSTOMER_CLASSIFICATION_PEP", "STRING", "CASE c.c_custkey % 4 WHEN 0 THEN '1' WHEN 1 THEN '0' WHEN 2 THEN NULL ELSE '2' END", "'0'", "NULL"),
    ("DESCRIPCION_PEP", "STRING", "CASE WHEN c.c_custkey % 4 = 0 THEN 'minister relative' ELSE NULL END", "NULL", "NULL"),
    ("INCORPORATION_PURPOSE", "STRING", "'trade ' || c.c_mktsegment", "NULL", "NULL"),
    ("DIGNATARIES", "STRING", "'PRESIDENT ' || CAST(c.c_custkey AS STRING)", "NULL", "NULL"),
    ("POWER_DEES", "STRING", "CASE WHEN c.c_custkey % 2 = 0 THEN 'GENERAL POWER' ELSE NULL END", "NULL", "NULL"),
    ("AUTHORIZED_SIGNATURES", "STRING", "'SIGNATURES ' || CAST(c.c_custkey % 5 AS STRING)", "NULL", "NULL"),
    ("RELATION_CORRESPONSAL", "INT", "NULL", "CAST(s.s_suppkey % 2 AS INT)", "NULL"),
    ("SALES_MORE_30_PERCENT", "STRING", "CASE c.c_custkey % 3 WHEN 0 THEN '1' WHEN 1 THEN '0' ELSE NULL END", "NULL", "NULL"),
    ("EXPORT_SHARE", "DECIMAL(38,10)", "CASE WHEN c.c_custkey % 3 = 0 THEN CAST(c.c_custkey % 100 AS DECIMAL(38,10)) ELSE NULL END", "NULL", "NULL"),
    ("PUBLIC_TRADE_COMP", "INT", "CAST(c.c_custkey % 2 AS INT)", "1", "NULL"),
    ("PATRIOT_EXC_DATE", "DATE", "CASE WHEN c.c_custkey % 10 = 0 THEN CAST(o.o_orderdate AS DATE) ELSE NULL END", "NULL", "NULL"),
    ("AML_EXC_DATE", "DATE", "CASE WHEN c.c_custkey % 10 = 1 THEN CAST(o.o_orderdate AS DATE) ELSE NULL END", "NULL", "NULL"),
    ("GIIN_NUMBER", "STRING", "CASE WHEN c.c_custkey % 3 = 0 THEN 'GIIN' || CAST(c.c_custkey AS STRING) ELSE NULL END", "NULL", "NULL"),
    ("W8_FORM_DATE", "DATE", "CASE WHEN c.c_custkey % 3 = 0 THEN CAST(o.o_orderdate AS DATE) ELSE NULL END", "NULL", "NULL"),
    ("FECHA_INTEG_BSARADAR", "DATE", "CAST(o.o_orderdate AS DATE)", "NULL", "NULL"),
    ("FECHA_KYC", "DATE", _date("2015 + o.o_orderkey % 9", "1 + o.o_custkey % 12", "1 + o.o_orderkey % 28"), "NULL", "NULL"),
    ("TIPO_DE_CLIENTE", "STRING", "'TC' || CAST(n.n_regionkey AS STRING)", "NULL", "NULL"),
    ("INTERNAL_CONTROL", "STRING", "CASE WHEN c.c_custkey % 2 = 0 THEN 'IC' || CAST(n.n_regionkey AS STRING) ELSE NULL END", "NULL", "NULL"),
    ("NEGATIVE_NEWS", "STRING", "CASE WHEN c.c_acctbal < 0 THEN 'YES' ELSE 'NO' END", "NULL", "NULL"),
    ("SANCTIONS", "STRING", "'NO'", "NULL", "NULL"),
    ("CO_COVENANTS", "STRING", "CASE o.o_orderpriority WHEN '1-URGENT' THEN 'CV_PROMO' WHEN '2-HIGH' THEN 'CV_LARGE' ELSE NULL END", "NULL", "NULL"),
    ("CO_DEUDOR_PRINCIPAL", "STRING", "CASE WHEN c.c_custkey % 2 = 0 THEN " + _core("C", "nm.main_custkey") + " ELSE NULL END", "NULL", "NULL"),
    ("CHK_CONTR_APROB_VF", "INT", "CASE c.c_custkey % 3 WHEN 0 THEN 1 WHEN 1 THEN 0 ELSE NULL END", "NULL", "NULL"),
    ("CINU", "STRING", "'CI' || CAST(c.c_nationkey AS STRING)", "NULL", "NULL"),
    ("CO_OFICINA_GESTION", "STRING", "'OF' || CAST(n.n_regionkey AS STRING)", "NULL", "NULL"),
    ("CO_ESG_RATING", "STRING", "CASE WHEN c.c_custkey % 2 = 0 THEN 'ESG-B' ELSE NULL END", "NULL", "NULL"),
    ("DATE_ESG_RATING", "DATE", "CASE WHEN c.c_custkey % 2 = 0 THEN CAST(o.o_orderdate AS DATE) ELSE NULL END", "NULL", "NULL"),
    ("CO_CLIENT_BETTER_COUNTRY", "STRING", "CASE WHEN c.c_acctbal > 1000 THEN 'Y' ELSE 'N' END", "NULL", "NULL"),
    ("CO_RISK_CUST_TYPE", "STRING", "'RISK-' || substr(c.c_mktsegment, 1, 2)", "NULL", "NULL"),
    ("GROUP_EXPIRATION_MONTH", "INT", "NULLIF(CAST(o.o_orderkey % 13 AS INT), 0)", "NULL", "NULLIF(CAST(o.o_orderkey % 13 AS INT), 0)"),
    ("ID_STATUS_FCC", "INT",
     "CASE o.o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN CASE o.o_orderpriority WHEN '1-URGENT' THEN 3 WHEN '2-HIGH' THEN 3 "
     "WHEN '5-LOW' THEN NULL ELSE 0 END ELSE CASE WHEN o.o_orderpriority = '3-MEDIUM' THEN 0 ELSE NULL END END",
     "CASE l.l_returnflag WHEN 'R' THEN 0 WHEN 'A' THEN 1 ELSE NULL END",
     "CASE WHEN o.o_orderstatus = 'F' THEN 1 ELSE NULL END"),
    ("ID_CUSTOMER_FCC", "STRING", f"CASE WHEN o.o_orderstatus = 'P' THEN NULL ELSE {_creation_id(MAIN_NO)} END",
     f"CASE WHEN l.l_returnflag = 'N' THEN NULL ELSE {_creation_id(REL_NO)} END",
     f"CASE WHEN o.o_orderstatus = 'F' THEN {_creation_id(GRP_NO)} ELSE NULL END"),
    ("MSG_ERROR_FCC", "STRING",
     "CASE WHEN o.o_orderstatus = 'O' AND o.o_orderpriority IN ('3-MEDIUM', '4-NOT SPECIFIED') THEN 'FCC-ERR ' || o.o_orderpriority ELSE NULL END",
     "CASE WHEN l.l_returnflag = 'R' THEN 'FCC-ERR R' ELSE NULL END", "NULL"),
    ("FECHA_CREACION_CLIENTE", "TIMESTAMP_L", "CASE WHEN o.o_orderstatus = 'F' THEN o.o_orderdate ELSE NULL END", "NULL", "NULL"),
    ("RISK_RATING", "STRING", "'RR' || CAST(c.c_custkey % 5 AS STRING)", "'RR1'", "'RR0'"),
    ("INTERNAL_CLASSIFICATION", "STRING", "'CLASS ' || substr(c.c_mktsegment, 1, 1)", "'CLASS B'", "NULL"),
    ("MONITOREO_TRANSACCIONAL", "STRING", "CASE WHEN c.c_custkey % 2 = 0 THEN 'HIGH' ELSE 'NORMAL' END", "NULL", "NULL"),
    ("PROJECT_FINANCE", "STRING", "CASE o.o_orderkey % 4 WHEN 0 THEN '1' WHEN 1 THEN '0' WHEN 2 THEN NULL ELSE 'x' END", "NULL", "NULL"),
    ("PROBABILITY_DEFAULT", "DECIMAL(38,10)", "CASE WHEN o.o_orderkey % 5 = 0 THEN NULL ELSE CAST(o.o_totalprice / 10000000 AS DECIMAL(38,10)) END", "NULL", "NULL"),
    ("LOSS_GIVEN_DEFAULT", "DECIMAL(38,10)", "CASE WHEN o.o_orderkey % 7 = 0 THEN NULL ELSE CAST(0.45 AS DECIMAL(38,10)) END", "NULL", "NULL"),
]

PROFILE_COLUMNS = [c[0] for c in PROFILE_SPEC]
PROFILE_KEY = ["ID_SOLICITUD", "CUSTOMER_NO"]
PROFILE_TYPES = {c[0]: c[1] for c in PROFILE_SPEC}
PROFILE_STRING_COLUMNS = [c for c, t in PROFILE_TYPES.items() if t == "STRING"]


def _sql_type(t: str) -> str:
    # Timestamps are kept in the driver's zone-less type on both engines.
    return t


def _profile_sql() -> str:
    def proj(i: int) -> str:
        out = []
        for col, typ, *exprs in PROFILE_SPEC:
            e = exprs[i]
            if typ == "TIMESTAMP_L":
                out.append(f"{e} AS {col}" if e != "NULL" else f"CAST(NULL AS TIMESTAMP_NTZ_T) AS {col}")
            else:
                out.append(f"CAST({e} AS {typ}) AS {col}")
        return ",\n  ".join(out)

    nation_main = "(SELECT c_nationkey AS nk, min(c_custkey) AS main_custkey FROM {customer} GROUP BY c_nationkey) nm"
    main = (f"SELECT\n  {proj(0)}\nFROM {{orders}} o JOIN {{customer}} c ON c.c_custkey = o.o_custkey "
            f"JOIN {{nation}} n ON n.n_nationkey = c.c_nationkey JOIN {{region}} r ON r.r_regionkey = n.n_regionkey "
            f"JOIN {nation_main} ON nm.nk = c.c_nationkey")
    related = (f"SELECT\n  {proj(1)}\nFROM (SELECT l_orderkey, l_suppkey, max(l_returnflag) AS l_returnflag, "
               f"min(l_shipdate) AS l_shipdate FROM {{lineitem}} GROUP BY l_orderkey, l_suppkey) l "
               f"JOIN {{orders}} o ON o.o_orderkey = l.l_orderkey JOIN {{customer}} c ON c.c_custkey = o.o_custkey "
               f"JOIN {{supplier}} s ON s.s_suppkey = l.l_suppkey JOIN {{nation}} n ON n.n_nationkey = s.s_nationkey "
               f"JOIN {{region}} r ON r.r_regionkey = n.n_regionkey")
    group = (f"SELECT\n  {proj(2)}\nFROM {{orders}} o JOIN {{customer}} c ON c.c_custkey = o.o_custkey "
             f"JOIN {{nation}} n ON n.n_nationkey = c.c_nationkey JOIN {{region}} r ON r.r_regionkey = n.n_regionkey "
             f"JOIN {nation_main} ON nm.nk = c.c_nationkey WHERE o.o_orderpriority = '1-URGENT'")
    return f"{main}\nUNION ALL\n{related}\nUNION ALL\n{group}"



#: The driver columns that a profile row is computed from, as the expressions of PROFILE_SPEC name them.
_SOURCE_COLUMN = re.compile(r"\b(?:o|c|n|r|nm|l|s)\.((?:[a-z]_|main_)[a-z]+)")
#: What every row of a part holds, in order of the expressions of PROFILE_SPEC: main parties, related parties, groups.
PROFILE_SOURCES = [sorted({m for spec in PROFILE_SPEC for m in _SOURCE_COLUMN.findall(spec[2 + i])}) for i in range(3)]


def profile_key(number: int) -> list[str]:
    """The row key (PROFILE_KEY) of a part, over its driver columns."""
    return [f"CAST({_SOURCE_COLUMN.sub(r'\1', spec[2 + number])} AS {spec[1]})" for spec in PROFILE_SPEC if spec[0] in PROFILE_KEY]


def profile_expressions(part: str) -> list[str]:
    """The columns of the profile as Spark SQL over PROFILE_SOURCES and the number ``part`` of the row's part.

    The same expressions as in the SQL of wf_customer_info, so a landed profile needs to hold their inputs only.  The row
    key is landed itself.
    """
    out = []
    for col, typ, *exprs in PROFILE_SPEC:
        typ = "TIMESTAMP_NTZ" if typ == "TIMESTAMP_L" else typ
        values = [_SOURCE_COLUMN.sub(r"\1", e) for e in exprs]
        if col in PROFILE_KEY:
            out.append(col)
        elif len(set(values)) == 1:
            out.append(f"CAST({values[0]} AS {typ}) AS {col}")
        else:
            whens = " ".join(f"WHEN {i} THEN CAST({v} AS {typ})" for i, v in enumerate(values) if v != "NULL")
            out.append(f"CASE {part} {whens} END AS {col}")
    return out


# --------------------------------------------------------------------------
# Core-banking master (STTM_CUSTOMER and satellites): customers (C), banks
# (suppliers, B) and economic groups (nations, G).
# --------------------------------------------------------------------------
_MASTER_PARTIES = (
    "SELECT 'C' AS kind, c_custkey AS k, c_name AS name, c_nationkey AS nk, c_acctbal AS bal, "
    "c_mktsegment AS seg FROM {customer} "
    "UNION ALL SELECT 'B', s_suppkey, s_name, s_nationkey, s_acctbal, 'BANKING' FROM {supplier} "
    "UNION ALL SELECT 'G', n_nationkey, 'GROUP ' || n_name, n_nationkey, 0.0, 'GROUPS' FROM {nation}"
)
_PARTY_CORE = ("CASE p.kind WHEN 'C' THEN 'C' WHEN 'B' THEN 'S' ELSE 'G' END || "
               "lpad(CAST(p.k AS STRING), 8, '0')")

STANDINS: dict[str, str] = {}

STANDINS["wf_customer_info"] = _profile_sql()

STANDINS["fcc_parties"] = (
    f"SELECT p.kind, p.k, p.name, p.nk, p.bal, p.seg, {_PARTY_CORE} AS core_id, "
    "n.n_regionkey AS rk, r.r_name AS rname, nm.main_custkey "
    f"FROM ({_MASTER_PARTIES}) p JOIN {{nation}} n ON n.n_nationkey = p.nk "
    "JOIN {region} r ON r.r_regionkey = n.n_regionkey "
    "JOIN (SELECT c_nationkey AS nk, min(c_custkey) AS main_custkey FROM {customer} GROUP BY c_nationkey) nm "
    "ON nm.nk = p.nk"
)

STANDINS["fcc_customer"] = f"""
SELECT p.core_id AS CUSTOMER_NO,
  CASE WHEN p.kind = 'B' THEN 'B' WHEN p.kind = 'C' AND p.bal < -900 THEN 'I' ELSE 'C' END AS CUSTOMER_TYPE,
  p.name AS CUSTOMER_NAME1, p.name || ' LTD' AS FULL_NAME, substr(p.name, 1, 8) AS SHORT_NAME,
  substr(p.name, 10) AS SHORT_NAME2,
  'LINE1 ' || p.core_id AS ADDRESS_LINE1, 'LINE2 ' || p.rname AS ADDRESS_LINE2,
  CASE WHEN p.k % 2 = 0 THEN 'LINE3' ELSE NULL END AS ADDRESS_LINE3, 'CITY ' || p.rname AS ADDRESS_LINE4,
  {_cc('p.nk')} AS COUNTRY, {_cc('(p.nk + 1) % 25')} AS NATIONALITY, {_cc('p.rk * 5')} AS EXPOSURE_COUNTRY,
  'L' || CAST(p.rk AS STRING) AS LOC_CODE, upper(substr(p.rname, 1, 3)) AS LANGUAGE,
  CASE WHEN p.kind = 'B' THEN 'SWIFT' WHEN p.seg = 'AUTOMOBILE' THEN 'FAX' ELSE 'MAIL' END AS DEFAULT_MEDIA,
  CASE WHEN p.kind = 'B' THEN 'BANK' ELSE substr(p.seg, 1, 4) END AS CUSTOMER_CATEGORY,
  'SW' || p.core_id AS SWIFT_CODE, CASE WHEN p.kind = 'B' THEN 'ABA' || CAST(p.k AS STRING) ELSE NULL END AS UNIQUE_ID_VALUE,
  CASE WHEN p.k % 3 = 0 THEN 'FAX-' || p.core_id ELSE NULL END AS FAX_NUMBER,
  'www.' || lower(p.core_id) || '.com' AS UDF_1, '+00-' || CAST(p.k AS STRING) AS UDF_2,
  CASE WHEN p.kind = 'G' THEN {_core('C', 'p.main_custkey')} ELSE p.core_id END AS LIABILITY_NO,
  {_core('G', 'p.nk')} AS GROUP_CODE, 'RC' || CAST(p.k % 4 AS STRING) AS RISK_CATEGORY,
  CASE WHEN p.bal < 0 THEN 'U' ELSE 'A' END AS AUTH_STAT,
  CASE WHEN p.kind = 'C' AND p.k % 50 = 7 THEN 'C' ELSE 'O' END AS RECORD_STAT
FROM {{fcc_parties}} p
"""

STANDINS["fcc_corporate"] = f"""
SELECT p.core_id AS CUSTOMER_NO, 'NID-' || p.core_id AS C_NATIONAL_ID, {_cc('p.nk')} AS INCORP_COUNTRY,
  {_date('1960 + p.k % 50', '1 + p.k % 12', '1 + p.k % 27')} AS INCORP_DATE,
  CAST(p.bal * 1000 AS DECIMAL(38,10)) AS NETWORTH,
  'R1 ' || p.name AS R_ADDRESS1, 'R2 ' || p.rname AS R_ADDRESS2,
  CASE WHEN p.k % 2 = 1 THEN 'R3' ELSE NULL END AS R_ADDRESS3
FROM {{fcc_parties}} p WHERE p.kind <> 'G'
"""

STANDINS["fcc_personal"] = """
SELECT p.core_id AS CUSTOMER_NO, '+11-' || CAST(p.k AS STRING) AS TELEPHONE,
  CASE WHEN p.k % 4 = 0 THEN NULL ELSE 'F-' || CAST(p.k AS STRING) END AS FAX,
  lower(p.core_id) || '@mail.test' AS E_MAIL
FROM {fcc_parties} p WHERE p.kind <> 'G'
"""

# User-defined fields; positions per FIXTURES.md section 2.  Function STDCIF is
# the one the jobs read; banks also carry an STDCUS record with the same
# 9-character prefix, so a prefix join must name the function.
_UDF_FIELDS = {
    1: "'ICLASS-' || substr(p.seg, 1, 1)",
    3: "CASE WHEN p.k % 4 = 0 THEN NULL ELSE 'AA' END",
    4: "CASE WHEN p.bal > 5000 THEN 'BBB+' ELSE NULL END",
    5: "'A' || CAST(p.k % 3 + 1 AS STRING)",
    6: "'RUC-G' || CAST(p.nk AS STRING)",
    7: "CASE WHEN p.kind = 'B' THEN 'BT' || CAST(p.rk AS STRING) ELSE NULL END",
    8: "CASE p.k % 6 WHEN 0 THEN 'RT_PROMO' WHEN 1 THEN 'RT_STANDARD' WHEN 2 THEN 'RT_LARGE' WHEN 3 THEN 'RT_SMALL' "
       "WHEN 4 THEN 'RT_NONE' ELSE NULL END",
    9: "'LICENCE ' || CAST(p.k % 3 AS STRING)",
    11: "'COMPLIANCE ' || p.rname",
    12: "'GOV ' || CAST(p.rk AS STRING)",
    13: "'LEGAL REP ' || p.name",
    14: "CASE WHEN p.k % 2 = 0 THEN 'AUDITORS ' || p.rname ELSE NULL END",
    16: "'AGENT USA ' || CAST(p.k AS STRING)",
    17: "CASE WHEN p.k % 9 = 4 THEN '1970-01-01' ELSE CAST(" + _date("2024 + p.k % 3", "1 + p.k % 12", "1 + p.k % 28") + " AS STRING) END",
    18: "CAST(p.k % 97 AS STRING)",
    19: "'+22-' || CAST(p.k AS STRING)",
    20: "CASE p.k % 4 WHEN 0 THEN 'AUTOMOBILE' WHEN 1 THEN 'BUILDING' WHEN 2 THEN 'HOUSEHOLD' ELSE NULL END",
    21: "'CONTACT A ' || CAST(p.k AS STRING)",
    22: "CASE WHEN p.k % 2 = 0 THEN 'CONTACT B ' || CAST(p.k AS STRING) ELSE NULL END",
    23: "NULL",
    31: _core("C", "p.main_custkey"),
    32: "CASE p.k % 3 WHEN 0 THEN 'YES' WHEN 1 THEN 'NO' ELSE NULL END",
    36: "CASE p.k % 3 WHEN 0 THEN 'si' WHEN 1 THEN 'NO' ELSE NULL END",
    39: "CAST(" + _date("2016 + p.k % 8", "1 + p.k % 12", "1 + p.k % 28") + " AS STRING)",
    40: "CASE WHEN p.k % 5 = 0 THEN NULL ELSE CAST(" + _date("2000 + p.k % 20", "1 + p.k % 12", "10") + " AS STRING) END",
    41: "CASE p.k % 4 WHEN 0 THEN ' Y ' WHEN 1 THEN 'N' WHEN 2 THEN NULL ELSE 'y' END",
    42: "CASE p.k % 4 WHEN 0 THEN NULL WHEN 1 THEN '02' WHEN 2 THEN '07' ELSE '99' END",
    43: "CASE WHEN p.k % 2 = 0 THEN 'HIGH' ELSE 'NORMAL' END",
    45: "'IC' || CAST(p.rk AS STRING)",
    46: "CASE WHEN p.k % 3 = 0 THEN 'CV_PROMO' ELSE NULL END",
    47: "'OF' || CAST(p.rk AS STRING)",
    48: "CASE WHEN p.k % 2 = 0 THEN " + _core("C", "p.main_custkey") + " ELSE NULL END",
    49: "CASE WHEN p.bal > 1000 THEN 'Y' ELSE 'N' END",
    50: "'CI' || CAST(p.nk AS STRING)",
    52: "CASE WHEN p.k % 2 = 0 THEN 'ESG-A' ELSE NULL END",
    53: "CASE WHEN p.k % 2 = 0 THEN CAST(" + _date("2021", "1 + p.k % 12", "5") + " AS STRING) ELSE NULL END",
    54: "'RISK-' || substr(p.seg, 1, 2)",
    59: "CAST(p.k % 100 AS STRING) || '.5'",
    60: "CASE WHEN p.k % 3 = 0 THEN NULL ELSE '0.45' END",
    61: "CASE WHEN p.k % 13 = 0 THEN NULL ELSE lpad(CAST(p.k % 13 AS STRING), 2, '0') END",
}
UDF_FIELD_NUMBERS = sorted(_UDF_FIELDS)

STANDINS["fcc_userdef"] = (
    "SELECT p.core_id || '~' AS REC_KEY, 'STDCIF' AS FUNCTION_ID, "
    + ", ".join(f"CAST({e} AS STRING) AS FIELD_VAL_{n}" for n, e in sorted(_UDF_FIELDS.items()))
    + " FROM {fcc_parties} p "
    "UNION ALL SELECT p.core_id || '~2', 'STDCUS', "
    + ", ".join(f"CAST(NULL AS STRING)" for _ in UDF_FIELD_NUMBERS)
    + " FROM {fcc_parties} p WHERE p.kind = 'B'"
)

STANDINS["fcc_mis_default"] = """
SELECT p.core_id AS CUSTOMER, CASE WHEN p.kind = 'C' THEN 'IND_' || p.seg ELSE NULL END AS CUST_MIS_1,
  CASE p.k % 4 WHEN 0 THEN 'OFF_PROMO' WHEN 1 THEN 'OFF_STANDARD' WHEN 2 THEN 'OFF_LARGE' ELSE NULL END AS COMP_MIS_1,
  'LOC_' || p.rname AS COMP_MIS_2
FROM {fcc_parties} p WHERE p.kind <> 'G'
"""

STANDINS["fcc_cust_address"] = """
SELECT p.core_id AS CUSTOMER_NO, 'MAIL' AS MEDIA, 'CIF' AS LOCATION,
  'MAIL1 ' || p.core_id AS ADDRESS1, 'MAIL2 ' || p.rname AS ADDRESS2,
  CASE WHEN p.k % 2 = 0 THEN 'MAIL3' ELSE NULL END AS ADDRESS3, 'MAILCITY ' || p.rname AS ADDRESS4,
  CASE WHEN p.k % 10 = 3 THEN 'C' ELSE 'O' END AS RECORD_STAT, 'A' AS AUTH_STAT
FROM {fcc_parties} p WHERE p.kind <> 'G'
UNION ALL
SELECT p.core_id, 'FAX', 'CIF', 'FAXADDR ' || p.core_id, NULL, NULL, NULL, 'O', 'A'
FROM {fcc_parties} p WHERE p.kind <> 'G'
"""

_CUST_SUPP = ("(SELECT DISTINCT o.o_custkey AS ck, l.l_suppkey AS sk FROM {lineitem} l "
              "JOIN {orders} o ON o.o_orderkey = l.l_orderkey) cs")

STANDINS["fcc_corp_directors"] = (
    f"SELECT {_core('C', 'cs.ck')} AS CUSTOMER_NO, "
    "CASE WHEN cs.sk % 7 = 0 THEN NULL ELSE 'DIRECTOR ' || s.s_name END AS DIRECTOR_NAME "
    f"FROM {_CUST_SUPP} JOIN {{supplier}} s ON s.s_suppkey = cs.sk"
)

STANDINS["fcc_shareholders"] = (
    f"SELECT {_core('C', 'cs.ck')} AS CUSTOMER_NO, {_core('S', 'cs.sk')} AS SHAREHOLDER_ID, "
    "CAST((cs.ck + cs.sk) % 100 AS DECIMAL(10,2)) AS PERCENTAGE_HOLDING FROM " + _CUST_SUPP
)

# ---------------------------- code lists -----------------------------------
STANDINS["fcc_lov"] = """
SELECT fn AS FIELD_NAME, 'BT' || CAST(r_regionkey AS STRING) AS LOV, 'BANK ' || r_name AS LOV_DESC
  FROM {region} CROSS JOIN (SELECT 'BANK_TYPE' AS fn UNION ALL SELECT 'BANK TYPE') f
UNION ALL SELECT 'BANK TYPE', 'BX' || CAST(r_regionkey AS STRING), 'BANK ' || r_name FROM {region} WHERE r_regionkey < 2
UNION ALL SELECT fn, 'RT_' || p_type, 'RELATION ' || p_type
  FROM (SELECT DISTINCT p_type FROM {part}) t CROSS JOIN (SELECT 'RELATION_TYPE' AS fn UNION ALL SELECT 'RELATION TYPE') f
UNION ALL SELECT 'AML_RISK_RATING', c_mktsegment, 'RISK ' || c_mktsegment FROM (SELECT DISTINCT c_mktsegment FROM {customer}) s
UNION ALL SELECT 'TIPO DE CLIENTE', 'TC' || CAST(r_regionkey AS STRING), 'CLIENT ' || r_name FROM {region}
UNION ALL SELECT 'INTERNAL_CONTROL', 'IC' || CAST(r_regionkey AS STRING), 'CONTROL ' || r_name FROM {region}
UNION ALL SELECT 'COVENANTS CIF', 'CV_' || p_type, 'COVENANT ' || p_type FROM (SELECT DISTINCT p_type FROM {part}) t
UNION ALL SELECT 'COD_ACTIVIDAD_CINU', 'CI' || CAST(n_nationkey AS STRING), 'ACTIVITY ' || n_name FROM {nation}
UNION ALL SELECT 'OFICINA_DE_GESTION', 'OF' || CAST(r_regionkey AS STRING), 'OFFICE ' || r_name FROM {region}
"""

STANDINS["fcc_mis_code"] = """
SELECT 'IND_' || c_mktsegment AS MIS_CODE, 'INDUSTRY' AS MIS_CLASS,
  CASE WHEN c_mktsegment = 'HOUSEHOLD' THEN 'I' ELSE 'A' END AS ACTIVE, 'INDUSTRY ' || c_mktsegment AS CODE_DESC
  FROM (SELECT DISTINCT c_mktsegment FROM {customer}) s
UNION ALL SELECT 'OFF_' || p_type, 'OFFICER', 'A', 'OFFICER ' || p_type FROM (SELECT DISTINCT p_type FROM {part}) t
UNION ALL SELECT 'LOC_' || r_name, 'LOCATION', 'A', 'BRANCH ' || r_name FROM {region}
"""

STANDINS["fcc_country"] = f"SELECT {_cc('n_nationkey')} AS COUNTRY_CODE, n_name AS DESCRIPTION FROM {{nation}}"
STANDINS["fcc_location"] = "SELECT 'L' || CAST(r_regionkey AS STRING) AS LOC_CODE, 'CITY ' || r_name AS DESCRIPTION FROM {region}"
STANDINS["fcc_language"] = "SELECT upper(substr(r_name, 1, 3)) AS LANG_CODE, 'LANGUAGE ' || r_name AS LANG_NAME FROM {region}"
STANDINS["fcc_group_code"] = (f"SELECT {_core('G', 'n_nationkey')} AS GROUP_CODE, 'GROUP ' || n_name AS DESCRIPTION "
                              "FROM {nation}")
STANDINS["fcc_customer_cat"] = """
SELECT substr(c_mktsegment, 1, 4) AS CUST_CAT, 'CATEGORY ' || c_mktsegment AS CUST_CAT_DESC, 'O' AS RECORD_STAT,
  CASE WHEN c_mktsegment = 'FURNITURE' THEN 'U' ELSE 'A' END AS AUTH_STAT
FROM (SELECT DISTINCT c_mktsegment FROM {customer}) s
"""
STANDINS["fcc_udf_fields_map"] = """
SELECT DISTINCT CASE WHEN p_type = 'PROMO' THEN 'STDCUS' ELSE 'STDCIF' END AS FUNCTION_ID,
  p_brand || ' ' || p_type AS FIELD_NAME, CASE WHEN p_type = 'SMALL' THEN 'U' ELSE 'A' END AS AUTH_STAT
FROM {part}
"""
# Customer types 1..7 are the domain the reference's type rule produces.
STANDINS["wf_customer_type"] = """
SELECT CAST(n_nationkey AS INT) AS CUSTOMER_ID,
  CASE WHEN n_nationkey IN (2, 5, 7) THEN 'B' ELSE 'C' END AS CUSTOMER_TYPE,
  'CUSTOMER TYPE ' || n_name AS CUSTOMER_DESCRIPTION
FROM {nation} WHERE n_nationkey BETWEEN 1 AND 7
"""
STANDINS["wf_lmt_customer_type"] = """
SELECT DISTINCT LMT_CUSTOMER_TYPE || ' ' AS CO_CUSTOMER_TYPE,
  CAST(CASE LMT_CUSTOMER_TYPE WHEN 'E' THEN 4 WHEN 'C' THEN 1 ELSE NULL END AS INT) AS CO_CUSTOMER_TYPE_KCC
FROM {wf_customer_info} WHERE LMT_CUSTOMER_TYPE IS NOT NULL
"""
STANDINS["wf_dflt_media"] = "SELECT DISTINCT DEFAULT_MEDIA AS MEDIA, 'MEDIA ' || DEFAULT_MEDIA AS DESCRIPTION FROM {fcc_customer}"
STANDINS["wf_sbp_category"] = ("SELECT CAST(r_regionkey + 1 AS INT) AS CATEGORYID, 'SBP ' || r_name AS CATEGORY_DESCRIPCION "
                               "FROM {region}")
# Renewal years by AML rating; two segments have no row (default 0 applies).
STANDINS["wf_renewal"] = """
SELECT DISTINCT c_mktsegment AS RATING,
  CAST(CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 1 WHEN 'BUILDING' THEN 2 ELSE 3 END AS INT) AS TIEMPO_RENOVACION
FROM {customer} WHERE c_mktsegment IN ('AUTOMOBILE', 'BUILDING', 'FURNITURE')
"""

# ------------------------- workflow tables ---------------------------------
STANDINS["wf_application"] = f"""
SELECT o_orderkey AS ID_SOLICITUD,
  CASE WHEN o_orderpriority = '5-LOW' THEN NULL ELSE 'GOV ' || substr(o_orderpriority, 3) END AS GOVERMENT_TYPE,
  o_custkey AS NU_INCIDENTE, {_core('C', 'o_custkey')} AS CUSTOMER_NO_FCC,
  o_orderstatus AS STATUS, CAST(o_orderdate AS DATE) AS FECHA
FROM {{orders}}
"""
STANDINS["wf_lmt_customer_info"] = """
SELECT o_orderkey AS ID_SOLICITUD,
  CAST(CASE o_orderpriority WHEN '2-HIGH' THEN 1 WHEN '3-MEDIUM' THEN NULL ELSE 0 END AS INT) AS CHK_COUNTERPART,
  CAST(CASE o_orderpriority WHEN '2-HIGH' THEN 6 WHEN '3-MEDIUM' THEN 7 WHEN '4-NOT SPECIFIED' THEN 1
       WHEN '5-LOW' THEN NULL ELSE 2 END AS INT) AS PURPOSE_ID
FROM {orders} WHERE o_orderstatus <> 'P'
"""
STANDINS["wf_ec_rc_limits"] = (f"SELECT o.o_orderkey AS ID_SOLICITUD, {_core('G', 'c.c_nationkey')} AS GROUP_CODE "
                               "FROM {orders} o JOIN {customer} c ON c.c_custkey = o.o_custkey "
                               "WHERE o.o_orderstatus = 'F'")
STANDINS["wf_lmt_customer"] = f"""
SELECT l.l_orderkey AS ID_SOLICITUD, l.l_orderkey * {PARTY_STRIDE} + l.l_suppkey + 1 AS CUSTOMER_ID,
  {_core('S', 'l.l_suppkey')} AS CUSTOMER_NO, s.s_name AS CUSTOMER_NAME, 'C' AS CUSTOMER_TYPE
FROM {{lineitem}} l JOIN {{supplier}} s ON s.s_suppkey = l.l_suppkey WHERE l.l_returnflag = 'R'
UNION ALL
SELECT o.o_orderkey, o.o_orderkey * {PARTY_STRIDE}, {_core('C', 'o.o_custkey')}, 'LIMIT ' || CAST(o.o_custkey AS STRING), 'C'
FROM {{orders}} o WHERE o.o_orderstatus = 'F'
UNION ALL
SELECT o.o_orderkey, o.o_orderkey * {PARTY_STRIDE} + {GROUP_SLOT}, {_core('G', 'c.c_nationkey')}, 'LIMIT GROUP', 'G'
FROM {{orders}} o JOIN {{customer}} c ON c.c_custkey = o.o_custkey WHERE o.o_orderpriority = '1-URGENT'
"""
STANDINS["wf_stage_history"] = """
SELECT user_id AS NUMEROINCIDENTE,
  CAST(CASE WHEN value > 50 THEN 2200 ELSE 1000 END AS INT) AS ID_PROCESO,
  CAST(CASE event_type WHEN 'view' THEN 1012 WHEN 'click' THEN 2215 WHEN 'purchase' THEN 1013
       WHEN 'signup' THEN 1011 ELSE 9999 END AS INT) AS ID_STEP,
  CAST(CASE WHEN value < 10 THEN 0 ELSE 1 END AS INT) AS ESTADO_ETAPA,
  ts AS FECHA_ETAPA
FROM {events}
"""
STANDINS["wf_completion_cif"] = """
SELECT DISTINCT o.o_custkey AS INCIDENT FROM {orders} o
LEFT JOIN (SELECT DISTINCT l_orderkey FROM {lineitem}) l ON l.l_orderkey = o.o_orderkey
WHERE l.l_orderkey IS NULL
"""
STANDINS["wf_contracts"] = f"""
SELECT DISTINCT {_creation_id(f'l_orderkey * {PARTY_STRIDE} + l_suppkey + 1')} AS XREF_NUMERO_CONTRATO
FROM {{lineitem}} WHERE l_linestatus = 'F'
UNION
SELECT {_creation_id(f'o_orderkey * {PARTY_STRIDE}')} FROM {{orders}} WHERE o_orderstatus = 'F'
UNION
SELECT {_creation_id(f'o_orderkey * {PARTY_STRIDE} + {GROUP_SLOT}')} FROM {{orders}}
WHERE o_orderstatus = 'F' AND o_orderpriority = '1-URGENT'
"""
_LINE_PARTY = (f"CASE WHEN l_linenumber % 2 = 1 THEN l_orderkey * {PARTY_STRIDE} "
               f"ELSE l_orderkey * {PARTY_STRIDE} + l_suppkey + 1 END")
STANDINS["wf_directors"] = f"""
SELECT l_orderkey AS ID_SOLICITUD, {_LINE_PARTY} AS CUSTOMER_NO,
  CAST(CASE l_returnflag WHEN 'A' THEN 1 WHEN 'N' THEN 2 ELSE 3 END AS INT) AS TYPE,
  CASE WHEN l_partkey % 11 = 0 THEN NULL ELSE 'PERSON ' || lpad(CAST(l_partkey AS STRING), 6, '0') END AS NAME,
  CASE l_linestatus WHEN 'F' THEN 'PRESIDENT' ELSE 'DIRECTOR' END AS POSITION
FROM {{lineitem}}
"""
STANDINS["wf_shareholders"] = f"""
SELECT l_orderkey AS ID_SOLICITUD, {_LINE_PARTY} AS CUSTOMER_NO,
  'HOLDER ' || lpad(CAST(l_partkey AS STRING), 6, '0') AS NAME,
  CAST(l_quantity AS DECIMAL(10,2)) AS PERCENTAGE
FROM {{lineitem}}
"""
STANDINS["wf_multi_values"] = f"""
SELECT DISTINCT CAST(s.s_nationkey AS INT) AS ID_CAMPO,
  CAST(CASE l.l_returnflag WHEN 'R' THEN 13 WHEN 'A' THEN 12 ELSE 11 END AS INT) AS ID_TIPO_CAMPO,
  CASE WHEN l.l_returnflag = 'A' AND l.l_linestatus = 'O' THEN n.n_name || ' (OLD)' ELSE n.n_name END AS DESCRIPCION1,
  CASE WHEN l.l_returnflag = 'N' THEN 'V' || CAST(year(l.l_shipdate) AS STRING) ELSE NULL END AS DESCRIPCION2,
  o.o_orderkey * {PARTY_STRIDE} AS CUSTOMER_NO, o.o_orderkey AS ID_SOLICITUD
FROM {{lineitem}} l JOIN {{orders}} o ON o.o_orderkey = l.l_orderkey
JOIN {{supplier}} s ON s.s_suppkey = l.l_suppkey JOIN {{nation}} n ON n.n_nationkey = s.s_nationkey
"""
# Refresh requests: every open application asks for a refresh of its customer;
# purpose 6 refreshes that one customer, any other purpose its whole group.
STANDINS["wf_refresh_request"] = f"""
SELECT o.o_orderkey AS ID_SOLICITUD, {_core('C', 'o.o_custkey')} AS CUSTOMER_NO_FCC, i.PURPOSE_ID AS ID_PURPOSE
FROM {{orders}} o JOIN {{wf_lmt_customer_info}} i ON i.ID_SOLICITUD = o.o_orderkey
WHERE o.o_orderstatus = 'O'
"""
# Status events from the core bank (action 1 callbacks): error -> 0,
# signup/purchase -> 1, view -> 3; clicks carry no status.
STANDINS["wf_status_events"] = f"""
SELECT event_id AS EVENT_ID, ts AS EVENT_TS,
  {_creation_id(f'user_id * {PARTY_STRIDE}')} AS ID_CUSTOMER_FCC,
  CAST(CASE event_type WHEN 'error' THEN 0 WHEN 'view' THEN 3 ELSE 1 END AS INT) AS ID_STATUS_FCC,
  CASE WHEN event_type = 'error' THEN 'FCC ERROR ' || props ELSE 'OK ' || event_type END AS MSG_ERROR_FCC
FROM {{events}} WHERE event_type <> 'click'
"""


# ------------------------------ assembly ------------------------------------
_PLACEHOLDER = re.compile(r"\{([a-z_]+)\}")


def dependencies(name: str) -> list[str]:
    return sorted(set(_PLACEHOLDER.findall(STANDINS[name])))


def _duck_text(text: str) -> str:
    return text.replace("TIMESTAMP_NTZ_T", "TIMESTAMP")


def _spark_text(text: str) -> str:
    return text.replace("TIMESTAMP_NTZ_T", "TIMESTAMP_NTZ")


def spark_text(name: str) -> str:
    return _spark_text(STANDINS[name])


def closure(names: list[str]) -> list[str]:
    """Stand-ins needed for ``names``, in dependency order."""
    order: list[str] = []

    def visit(n: str) -> None:
        if n in BASE_TABLES or n in order:
            return
        for d in dependencies(n):
            visit(d)
        order.append(n)

    for n in names:
        visit(n)
    return order


def with_clause(names: list[str]) -> str:
    """``WITH a AS (...), b AS (...)`` for DuckDB; base tables stay as views."""
    parts = []
    for n in closure(names):
        body = _PLACEHOLDER.sub(lambda m: m.group(1), _duck_text(STANDINS[n]))
        parts.append(f"{n} AS (\n{body}\n)")
    return "WITH " + ",\n".join(parts) + "\n" if parts else ""


@dataclass
class StandinBuilder:
    """Builds stand-in DataFrames lazily from a dict of base DataFrames."""

    spark: object
    base: dict
    _cache: dict | None = None

    def get(self, name: str):
        if self._cache is None:
            self._cache = {}
        if name in self.base:
            return self.base[name]
        if name not in self._cache:
            frames = {d: self.get(d) for d in dependencies(name)}
            self._cache[name] = self.spark.sql(_spark_text(STANDINS[name]), **frames)
        return self._cache[name]

# PD/LGD change requests (one call of the update routine per row): mode 1
# sets project finance, 2 the PD, 3 the LGD; mode 4 is unknown (no change).
STANDINS["wf_risk_request"] = f"""
SELECT o_orderkey AS REQ_ID, CAST(1 + o_orderkey % 4 AS INT) AS MODO, o_orderkey AS ID_SOLICITUD,
  CASE WHEN o_orderkey % 9 = 5 THEN o_orderkey * {PARTY_STRIDE} + 1 ELSE o_orderkey * {PARTY_STRIDE} END AS CUSTOMER_ID,
  CASE WHEN o_totalprice > 100000 THEN '1' ELSE NULL END AS PF,
  CAST(o_totalprice / 20000000 AS DECIMAL(38,10)) AS PD,
  CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE CAST(0.4 AS DECIMAL(38,10)) END AS LGD
FROM {{orders}} WHERE o_orderstatus = 'O'
"""

# Profile form submissions (one call of the insert-or-update routine each).
# Urgent open applications edit their main party by local number, high ones
# by core id; medium ones add a new party (a group id that exists in the
# master, or an id the master does not know).  Every eighth application is
# submitted four more times: its main party moves to another core id, is met
# there, left without one, and its old core id comes back as a new party.  One
# application gets a share of all submissions (hot), which move its main party
# between five core ids, meet it there, and add and meet new parties.  Dates
# arrive as dd/mm/yyyy text, some of them invalid.
HOT_APPLICATION = 1
_SUBMISSIONS = f"""(
SELECT o_orderkey AS o_key, o_orderkey AS req, o_orderkey AS app, CAST(0 AS BIGINT) AS v, CAST(0 AS BIGINT) AS k FROM {{orders}}
WHERE o_orderstatus = 'O' AND o_orderpriority IN ('1-URGENT', '2-HIGH', '3-MEDIUM')
UNION ALL
SELECT o_orderkey, t.v * 1000000000000 + o_orderkey, o_orderkey, t.v, CAST(0 AS BIGINT)
FROM {{orders}} JOIN (SELECT CAST(1 AS BIGINT) AS v UNION ALL SELECT 2 UNION ALL SELECT 3 UNION ALL SELECT 4) t ON o_orderkey % 8 = 0
UNION ALL
SELECT l_orderkey, 10000000000000 + l_orderkey * 10 + l_linenumber,
  CAST({HOT_APPLICATION} AS BIGINT), 5 + l_linenumber % 4, min(l_suppkey) % 5
FROM {{lineitem}} WHERE l_partkey % 25 = 0 GROUP BY l_orderkey, l_linenumber)"""
_DMY = ("lpad(CAST(dayofmonth(o.o_orderdate) AS STRING), 2, '0') || '/' || "
        "lpad(CAST(month(o.o_orderdate) AS STRING), 2, '0') || '/' || CAST(year(o.o_orderdate) AS STRING)")
_CHANGE_COLUMNS = f"""s.req AS REQ_ID, s.app AS IN_ID_SOLICITUD,
  CASE WHEN s.v = 0 AND o.o_orderpriority = '1-URGENT' THEN s.app * {PARTY_STRIDE}
       WHEN s.v IN (1, 3, 5, 8) THEN s.app * {PARTY_STRIDE} ELSE NULL END AS IN_CUSTOMER_NO,
  CASE WHEN s.v = 1 OR s.v = 2 THEN {_core('Y', 'o.o_orderkey')} WHEN s.v = 3 THEN NULL WHEN s.v = 4 THEN {_core('C', 'o.o_custkey')}
       WHEN s.v = 8 AND s.k = 0 THEN NULL WHEN s.v IN (5, 6, 8) THEN {_core('Z', 's.k')} WHEN s.v = 7 THEN {_core('W', 's.k')}
       WHEN o.o_orderpriority = '1-URGENT' THEN NULL WHEN o.o_orderpriority = '2-HIGH' THEN {_core('C', 'o.o_custkey')}
       WHEN o.o_custkey % 2 = 0 THEN {_core('G', 'c.c_nationkey')} ELSE {_core('X', 'o.o_orderkey')} END
    AS IN_CUSTOMER_NO_FCC,
  lower(c.c_name) || ' ltd' AS IN_CUSTOMER_NAME1, c.c_name || ' holding' AS IN_FULLNAME,
  CASE WHEN o.o_custkey % 2 = 0 THEN NULL ELSE 'short ' || CAST(o.o_custkey AS STRING) END AS IN_SHORT_NAME,
  CASE WHEN o.o_custkey % 3 = 0 THEN NULL ELSE 'LIAB-' || CAST(o.o_custkey AS STRING) END AS IN_LIAB_ID,
  CASE WHEN o.o_custkey % 5 = 0 THEN 'seg-new' ELSE NULL END AS IN_SUB_ECOGR_CD,
  CAST(1 + o.o_custkey % 7 AS BIGINT) AS IN_CUSTOMER_TYPE,
  'cat ' || substr(c.c_mktsegment, 1, 3) AS IN_CUSTOMER_CATEGORY,
  'new rep ' || c.c_name AS IN_LEGALREPRESENTATIVE, 'new info' AS IN_LEGALREPRESENTATIVE_INFO,
  'tel ' || CAST(o.o_custkey AS STRING) AS IN_TELEPHONENUMBER, 'line3 ' || c.c_mktsegment AS IN_PHYSICALALINE3,
  'agent ' || CAST(o.o_custkey AS STRING) AS IN_USA_PROCESS_AGENT, 'loc_' || CAST(c.c_nationkey AS STRING) AS IN_LOCATIONID,
  CASE WHEN o.o_orderkey % 4 = 0 THEN '31/02/' || CAST(year(o.o_orderdate) AS STRING) ELSE {_DMY} END AS IN_INCORP_DATE,
  {_DMY} AS IN_FECHA_KYC,
  CAST(CAST(o.o_totalprice AS DECIMAL(18,2)) AS STRING) AS IN_NETWORTH, 'NYR-' || c.c_mktsegment AS IN_AML_RATINGID_NY,
  CASE WHEN o.o_custkey % 2 = 0 THEN '1' ELSE '0' END AS IN_NY_AGENCY,
  CAST(CASE WHEN s.v IN (4, 7) THEN 1 WHEN o.o_orderpriority = '3-MEDIUM' THEN 0 ELSE NULL END AS BIGINT) AS IN_MAIN_CUSTOMER,
  CAST(1 AS BIGINT) AS IN_CHK_CREATE_FCC, 'TC' || CAST(c.c_nationkey % 5 AS STRING) AS IN_TIPO_DE_CLIENTE,
  CAST(o.o_orderkey % 13 AS BIGINT) AS IN_GROUP_EXPIRATION_MONTH"""
_CHANGE_ROWS = f"""FROM {_SUBMISSIONS} s JOIN {{orders}} o ON o.o_orderkey = s.o_key JOIN {{customer}} c ON c.c_custkey = o.o_custkey"""
STANDINS["wf_profile_changes"] = f"""
SELECT {_CHANGE_COLUMNS}
{_CHANGE_ROWS}
"""
# The same table in two steps for its landing: the driver columns of a submission, and its columns as they follow from them.
_CHANGE_SOURCE = re.compile(r"\b(s|o|c)\.([a-z_]+)")
CHANGE_SOURCES = f"SELECT {', '.join(sorted({m.group() for m in _CHANGE_SOURCE.finditer(_CHANGE_COLUMNS)}))} {_CHANGE_ROWS}"
CHANGE_PROJECTION = f"SELECT {_CHANGE_SOURCE.sub(r'\2', _CHANGE_COLUMNS)} FROM {{dealt}}"
