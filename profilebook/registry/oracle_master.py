"""DuckDB oracle SQL for the master views (actions 9, 11-15, 17).

A view is written as a list of output columns, each with the source of its value: a field of the master record, of one of
its satellites, or a code's description.  Every value is a scalar read of its own with one aggregate per key, so nothing
is joined and no row can be multiplied; the rows are those of the driving table that pass the view's conditions.
"""

from __future__ import annotations

from profilebook.registry.sqlkit import fmt_dmy, ncat, with_tables

#: Satellites of a core id: table, its key, condition.
_SATELLITES = {
    "corp": ("fcc_corporate", "CUSTOMER_NO", "true"),
    "field": ("fcc_userdef", "substr(REC_KEY, 1, 9)", "FUNCTION_ID = 'STDCIF'"),
    "mis": ("fcc_mis_default", "CUSTOMER", "true"),
}
#: Code lists: table, code, description, condition.
_CODES = {
    "group": ("fcc_group_code", "GROUP_CODE", "DESCRIPTION", "true"), "language": ("fcc_language", "LANG_CODE", "LANG_NAME", "true"),
    "place": ("fcc_location", "LOC_CODE", "DESCRIPTION", "true"), "country": ("fcc_country", "COUNTRY_CODE", "DESCRIPTION", "true"),
    "industry": ("fcc_mis_code", "MIS_CODE", "CODE_DESC", "true"), "media": ("wf_dflt_media", "MEDIA", "DESCRIPTION", "true"),
    "bank": ("fcc_lov", "LOV", "LOV_DESC", "FIELD_NAME = 'BANK TYPE'"), "relation": ("fcc_lov", "LOV", "LOV_DESC", "FIELD_NAME = 'RELATION TYPE'"),
    "category": ("fcc_customer_cat", "CUST_CAT", "CUST_CAT_DESC", "RECORD_STAT = 'O' AND AUTH_STAT = 'A'"),
    "known group": ("fcc_group_code", "GROUP_CODE", "GROUP_CODE", "true"),
    "active industry": ("fcc_mis_code", "MIS_CODE", "CODE_DESC", "ACTIVE = 'A' AND MIS_CLASS = 'INDUSTRY'"),
}
_TABLES = sorted({"fcc_customer", *(s[0] for s in _SATELLITES.values()), *(c[0] for c in _CODES.values())})

#: The output columns of the master views and where each comes from.  A plain name is a field of the master
#: record, "corp X" and "mis X" fields of its satellites, "field n" the n-th user field, "role of source" a description.
_MASTER = """
Customer No = CUSTOMER_NO | Customer Name = CUSTOMER_NAME1 | Legal or Commercial Name = FULL_NAME | Tax Identification Number = corp C_NATIONAL_ID
Dv = field 18 | Customer Category = CUSTOMER_CATEGORY | Relation Type = field 8 | Name of Economic Group = group of GROUP_CODE
Name of External Auditors = field 14 | Name Intl. Risk Rating Agency = rating | Postal Address Line1 = ADDRESS_LINE1 | Postal Address Line2 = ADDRESS_LINE2
Postal Address Line3 = ADDRESS_LINE3 | Postal Address City = ADDRESS_LINE4 | Physical Address Line1 = corp R_ADDRESS1
Physical Address Line2 = corp R_ADDRESS2 | Physical Address Line3 = corp R_ADDRESS3 | Telephone Number = UDF_2 | 2nd Telephone Number = field 19
Fax Number = FAX_NUMBER | WebSite = UDF_1 | Default Media = DEFAULT_MEDIA | INCORP_CNTRY = corp INCORP_COUNTRY
Country of Incorporation = country of corp INCORP_COUNTRY | Incorporation Date = incorporation | RESIDENCE_CNTRY = COUNTRY
Residence Country = country of COUNTRY | NATIONALITYCOD = NATIONALITY | Residence Location = place of LOC_CODE | LANGUAGEID = LANGUAGE
Language = language of LANGUAGE | Bank Type = field 7 | Type of License = field 9 | SWIFTCode = SWIFT_CODE | ABA Code Value = UNIQUE_ID_VALUE
Compliance Officer = field 11 | Name Process Agent In USA = field 16 | NETWORTH = corp NETWORTH | EXPOSURE_COUNTRY = EXPOSURE_COUNTRY
Contact1 = field 21 | Contact2 = field 22 | Contact3 = field 23 | LIABILITY_NO = LIABILITY_NO | GROUP_CODE = known group of GROUP_CODE
RISK_CATEGORY = RISK_CATEGORY | BANKTYPE_DESC = bank of field 7 | DEFAULT_MEDIA_DESC = media of DEFAULT_MEDIA | RELATIONTYPE_DESC = relation of field 8
CUST_CAT_DESC = category of CUSTOMER_CATEGORY | Economic Group RUC = field 6
"""
_AUTHORISED = """
INDUSTRY_CODE = mis CUST_MIS_1 | INDUSTRY = industry of mis CUST_MIS_1 | Name Legal Advisors = field 13 | NATIONALITY = country of NATIONALITY
RESIDENCELOCATION = LOC_CODE | EXPOSURE_COUNTRY_DESC = country of EXPOSURE_COUNTRY | SHORT_NAME = SHORT_NAME
"""
_ANY = """
Nationality = country of NATIONALITY | ResidenceLocation = LOC_CODE | Exposure_country_desc = country of EXPOSURE_COUNTRY | Location = mis COMP_MIS_2
Account Officer = mis COMP_MIS_1 | Industry_code = mis CUST_MIS_1 | Industry = industry of mis CUST_MIS_1 | Legal Representative Name = field 13
Goverment Type = field 12 | Aml Rating = field 20 | Can be used by NY Agency = field 32 | SHORT_NAME = SHORT_NAME2 | AUTH_STAT = AUTH_STAT
"""
#: The output columns of the comparison set; a plain name is a field of the profile row, "record" the
#: relation type of the user-field record.
_COMPARISON = """
ID_SOLICITUD = ID_SOLICITUD | CUSTOMER_NO_FCC = CUSTOMER_NO_FCC | CUSTOMER_NAME1 = CUSTOMER_NAME1 | FULLNAME = FULLNAME | TAXIDNUMBER = TAXIDNUMBER
DIGITO VERIFICADOR = DV | EMPTY1 = nothing | INCORP_CNTRY_DESC = country of INCORP_COUNTRYID | INCORP_DATE = incorporation | EMPTY2 = nothing
RESCTRY_DESC = country of RESIDENCECOUNTRY | EMPTY3 = nothing | NATIONALITYIDDESCR = country of NATIONALITYID | EMPTY4 = nothing
RESLOC_DESC = place of RESIDENCELOCATIONID | EMPTY5 = nothing | LANGUAGEID_DESC = language of LANGUAGEID | EMPTY6 = nothing
EXPCTRY_DESC = country of EXPOSURE_COUNTRYID | LOCATIONID = LOCATIONID | PHYSICALALINE1 = PHYSICALALINE1 | PHYSICALALINE2 = PHYSICALALINE2
PHYSICALALINE3 = PHYSICALALINE3 | POSTALACITY = POSTALACITY | POSTALALINE1 = POSTALALINE1 | POSTALALINE2 = POSTALALINE2 | POSTALALINE3 = POSTALALINE3
TELEPHONENUMBER = TELEPHONENUMBER | TEL 2 PANAMA = TELEPHONENUMBER2 | FAXNUMBER = FAXNUMBER | WEBSITE = WEBSITE | DEFAULT_MEDIA = DEFAULT_MEDIA
CUSTOMER_CATEGORY = CUSTOMER_CATEGORY | RELATION TYPE = RELATIONTYPE | ACCOUNT OFFICER = ACCOUNT_OFFICERID | EMPTY0 = nothing
INDUSTRY_DESC = active industry of INDUSTRY | LEGAL REPRESENTATIVE = representative | EXTERNAL AUDITORS = NAMEEXTERNALAUDITORS
NAMEINTERNATIONALRISK = NAMEINTERNATIONALRISK | NAMEOFECONOMICGROUP = NAMEOFECONOMICGROUP | ECONOMIC GROUP RUC = ECONOMICGROUPRUC | BANK TYPE = bank type
TYPE OF LICENSE = TYPEOFLICENCE | SWIFT_CODE = SWIFT_CODE | ABACODEVALUE = nothing | COMPLIANCE OFFICER = COMPLIANCEOFFICER
USA PROCESS AGENT = ADDRESSPROCESSAGENTINUSA | CONTACT 1 = contact 1 | CONTACT 2 = contact 2 | CONTACT 3 = contact 3 | GOVERMENT_TYPE = government
AML_RATINGID = AML_RATINGID | CUSTOMER_USED_NY = new york | NETWORTH = NETWORTH | LIAB_ID = LIAB_ID | SHORT_NAME = SHORT_NAME | GROUP_CODE = GROUP_CODE
EMPTY8 = nothing | EMPTY9 = nothing | EMPTY10 = nothing | RELATIONTYPE_DESC = relation of record | EMPTY12 = nothing
"""


def _satellite(name: str, column: str, core: str) -> str:
    table, key, where = _SATELLITES[name]
    return f"(SELECT min({column}) FROM {table} WHERE {key} = {core} AND {where})"


def _value(source: str, row: str, core: str) -> str:
    """SQL of one source for the row alias ``row`` whose core id is ``core``."""
    role, _, rest = source.partition(" of ")
    if rest:
        table, code, text, where = _CODES[role]
        return f"(SELECT min({text}) FROM {table} WHERE {code} = {_value(rest, row, core)} AND {where})"
    kind, _, name = source.partition(" ")
    if kind == "field":
        return _satellite("field", f"FIELD_VAL_{name}", core)
    if kind in ("corp", "mis"):
        return _satellite(kind, name, core)
    return {
        "nothing": "CAST(NULL AS VARCHAR)",
        "record": "r.relation",
        "rating": ncat("'MOODYS:'", _value("field 5", row, core), "' SP:'", _value("field 3", row, core), "' FITCH:'", _value("field 4", row, core)),
        "representative": f"substr(rtrim({row}.LEGALREPRESENTATIVE), 1, 105)",
        "bank type": f"CASE WHEN {row}.BANKTYPE IN ('Not aplicable', 'NA') THEN 'NA' ELSE {row}.BANKTYPE END",
        "new york": f"CASE {row}.NY_AGENCY WHEN '1' THEN 'YES' WHEN '0' THEN 'NO' END",
        "government": f"(SELECT min(GOVERMENT_TYPE) FROM wf_application WHERE ID_SOLICITUD = {row}.ID_SOLICITUD)",
    }.get(source) or (
        f"(SELECT list(t ORDER BY NAME, POSITION)[{name}] FROM person WHERE ID_SOLICITUD = {row}.ID_SOLICITUD AND CUSTOMER_NO = {row}.CUSTOMER_NO)"
        if kind == "contact" else f"{row}.{source}")


def _columns(listing: str, row: str, core: str, incorporation: str) -> str:
    cells = (cell.split(" = ") for line in listing.strip().splitlines() for cell in line.split(" | "))
    return ", ".join(f'{fmt_dmy(incorporation) if source == "incorporation" else _value(source, row, core)} AS "{name}"' for name, source in cells)


def _master(listing: str, authorised: tuple[str, ...]) -> str:
    incorporation = _satellite("corp", "INCORP_DATE", "m.CUSTOMER_NO")
    states = ", ".join(f"'{a}'" for a in authorised)
    return with_tables(_TABLES) + (f"SELECT {_columns(_MASTER.strip() + chr(10) + listing.strip(), 'm', 'm.CUSTOMER_NO', incorporation)} "
                                   f"FROM fcc_customer m WHERE m.RECORD_STAT = 'O' AND m.AUTH_STAT IN ({states})")


def _comparison() -> str:
    person = (f"person AS (SELECT ID_SOLICITUD, CUSTOMER_NO, NAME, POSITION, {ncat('NAME', chr(39) + ' - ' + chr(39), 'POSITION')} AS t "
              "FROM wf_directors WHERE TYPE = 3 AND NAME IS NOT NULL)")
    # a row of the set for each user-field record of the customer whose relation type is listed
    records = ("record AS (SELECT substr(REC_KEY, 1, 9) AS core, FIELD_VAL_8 AS relation FROM fcc_userdef "
               "WHERE FIELD_VAL_8 IN (SELECT LOV FROM fcc_lov WHERE FIELD_NAME = 'RELATION TYPE'))")
    columns = _columns(_COMPARISON, "p", "p.CUSTOMER_NO_FCC", "p.INCORP_DATE")
    return with_tables([*_TABLES, "wf_customer_type", "wf_application", "wf_directors"], [person, records], profile=True) + (
        f"SELECT {columns} FROM profile p, record r WHERE r.core = p.CUSTOMER_NO_FCC AND p.ID_EXISTE_FCC = '1' "
        "AND p.ID_SOLICITUD IN (SELECT ID_SOLICITUD FROM wf_application) AND p.CUSTOMER_TYPE IN (SELECT CUSTOMER_ID FROM wf_customer_type) "
        "AND p.CUSTOMER_NO_FCC IN (SELECT CUSTOMER FROM fcc_mis_default WHERE CUST_MIS_1 IN (SELECT MIS_CODE FROM fcc_mis_code))")


def oracle() -> dict[str, str]:
    q: dict[str, str] = {}
    q["field_catalogue"] = with_tables(["fcc_udf_fields_map"]) + (
        "SELECT FIELD_NAME FROM fcc_udf_fields_map WHERE FUNCTION_ID = 'STDCIF' AND AUTH_STAT = 'A'")
    q["master_profile"] = _master(_AUTHORISED, ("A",))
    q["master_profile_any"] = _master(_ANY, ("U", "A"))
    q["profile_diff"] = _comparison()
    q["directors_sorted"] = with_tables(["wf_directors"], profile=True) + (
        "SELECT d.ID_SOLICITUD, p.CUSTOMER_NO_FCC, d.TYPE, d.NAME, d.POSITION FROM wf_directors d "
        "JOIN profile p ON p.ID_SOLICITUD = d.ID_SOLICITUD AND p.CUSTOMER_NO = d.CUSTOMER_NO "
        "WHERE p.CUSTOMER_NO_FCC IS NOT NULL AND d.TYPE <> 3 ORDER BY 1, 2, 3, 4, 5")
    q["directors_by_core"] = with_tables(["wf_directors"], profile=True) + (
        "SELECT p.ID_SOLICITUD, p.CUSTOMER_NO_FCC, d.TYPE, d.NAME, d.POSITION FROM profile p JOIN wf_directors d "
        "USING (ID_SOLICITUD, CUSTOMER_NO) WHERE p.CUSTOMER_NO_FCC = 'C00000007' AND d.TYPE <> 3 ORDER BY 1, 2, 3, 4, 5")
    q["master_directors"] = with_tables(["fcc_corp_directors", "fcc_customer"]) + (
        "SELECT d.CUSTOMER_NO, d.DIRECTOR_NAME, (SELECT min(AUTH_STAT) FROM fcc_customer m WHERE m.CUSTOMER_NO = d.CUSTOMER_NO) AS AUTH_STAT "
        "FROM fcc_corp_directors d WHERE d.DIRECTOR_NAME IS NOT NULL AND d.CUSTOMER_NO IN ("
        "SELECT CUSTOMER_NO FROM fcc_customer WHERE AUTH_STAT IN ('U', 'A'))")
    q["shareholder_list"] = with_tables(["fcc_shareholders"]) + (
        "SELECT CUSTOMER_NO, SHAREHOLDER_ID, PERCENTAGE_HOLDING FROM fcc_shareholders")
    return q
