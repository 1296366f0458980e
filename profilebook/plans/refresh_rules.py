"""Column rules of the application refresh (fixed values of the reference).

Sources are small symbolic terms, read by the Spark job and by the oracle:
  ("m", col)   master customer column        ("corp", col)  corporate column
  ("udf", n)   user field n (STDCIF record)  ("udf_date", n) user field n as 'YYYY-MM-DD' date
  ("udf_num", n) user field n as a number    ("mit", col)   MIS-defaults column
  ("cp", col)  personal-data column          ("grp",)       economic group description
  ("addr", i)  postal line i: the open, authorised MAIL/CIF address when the
               default media is FAX or SWIFT, else the master address line (J25)
  ("bank",)    bank type description of field 7    ("iclass",) field 1 of record '<id>~'
  ("cand", col) expansion cursor column       ("req", col)  request column
  ("seq",) new local number   ("lit", v) constant   ("ny",) NY-agency rule
  ("main",) main-customer flag  ("pep",) PEP flag  ("cpt",) counterpart flag
  ("ctype",) customer-type rule  ("rating",) packed agency ratings
"""

from __future__ import annotations

SINGLE_PURPOSE = 6          # refresh of one customer; any other purpose refreshes the group
KEEP_SLICE_PURPOSE = 1      # the only purpose that keeps the application's existing rows
UNSET_LIMIT_TEXT = "1970-01-01"
COUNTRY_LIST_TYPE = 12      # multi-value type holding countries (description -> code)
DROPPED_CHILD_TYPE = 13     # multi-value type not carried forward
COUNTRY_TEXT_LIMIT = 900    # size of the country list variable
LOAD_LANGUAGE = "ENG"

LOAD_COMMON = [
    ("CUSTOMER_NO", ("seq",)), ("CUSTOMER_NAME1", ("m", "CUSTOMER_NAME1")), ("FULLNAME", ("m", "FULL_NAME")),
    ("TAXIDNUMBER", ("corp", "C_NATIONAL_ID")), ("DV", ("udf", 18)), ("INCORP_COUNTRYID", ("corp", "INCORP_COUNTRY")),
    ("INCORP_DATE", ("corp", "INCORP_DATE")), ("RESIDENCECOUNTRY", ("m", "COUNTRY")),
    ("NATIONALITYID", ("m", "NATIONALITY")), ("RESIDENCELOCATIONID", ("m", "LOC_CODE")),
    ("LANGUAGEID", ("lit", LOAD_LANGUAGE)), ("EXPOSURE_COUNTRYID", ("m", "EXPOSURE_COUNTRY")),
    ("LOCATIONID", ("mit", "COMP_MIS_2")), ("PHYSICALALINE1", ("corp", "R_ADDRESS1")),
    ("PHYSICALALINE2", ("corp", "R_ADDRESS2")), ("PHYSICALALINE3", ("corp", "R_ADDRESS3")),
    ("POSTALALINE1", ("addr", 1)), ("POSTALALINE2", ("addr", 2)), ("POSTALALINE3", ("addr", 3)),
    ("POSTALACITY", ("addr", 4)), ("TELEPHONENUMBER", ("cp", "TELEPHONE")), ("TELEPHONENUMBER2", ("udf", 19)),
    ("FAXNUMBER", ("cp", "FAX")), ("WEBSITE", ("m", "UDF_1")), ("DEFAULT_MEDIA", ("m", "DEFAULT_MEDIA")),
    ("CUSTOMER_CATEGORY", ("m", "CUSTOMER_CATEGORY")), ("RELATIONTYPE", ("udf", 8)),
    ("ACCOUNT_OFFICERID", ("mit", "COMP_MIS_1")), ("INDUSTRY", ("mit", "CUST_MIS_1")),
    ("LEGALREPRESENTATIVE", ("udf", 13)), ("NAMEEXTERNALAUDITORS", ("udf", 14)), ("NAMEINTERNATIONALRISK", ("rating",)),
    ("NAMEOFECONOMICGROUP", ("grp",)), ("ECONOMICGROUPRUC", ("udf", 6)), ("BANKTYPE", ("bank",)),
    ("TYPEOFLICENCE", ("udf", 9)), ("SWIFT_CODE", ("m", "SWIFT_CODE")), ("COMPLIANCEOFFICER", ("udf", 11)),
    ("ADDRESSPROCESSAGENTINUSA", ("udf", 16)), ("ABACODEVALUE", ("udf", 20)), ("NY_AGENCY", ("ny",)),
    ("NETWORTH", ("corp", "NETWORTH")), ("LIAB_ID", ("cand", "LIABILITY_NO")), ("SHORT_NAME", ("m", "SHORT_NAME")),
    ("GROUP_CODE", ("cand", "GROUP_CODE")), ("ID_SOLICITUD", ("req", "ID_SOLICITUD")),
    ("CUSTOMER_NO_FCC", ("cand", "CORE_ID")), ("RELACIONADO", ("lit", "1")), ("ID_MAIN_CUSTOMER", ("udf", 31)),
    ("MAIN_CUSTOMER", ("main",)), ("EMAIL", ("cp", "E_MAIL")), ("INTERNAL_CLASSIFICATION", ("iclass",)),
    ("FECHA_KYC", ("udf_date", 39)), ("INCEPTION_DATE", ("udf_date", 40)), ("CUSTOMER_CLASSIFICATION_PEP", ("pep",)),
    ("TIPO_DE_CLIENTE", ("udf", 42)), ("MONITOREO_TRANSACCIONAL", ("udf", 43)), ("INTERNAL_CONTROL", ("udf", 45)),
    ("CO_COVENANTS", ("udf", 46)), ("CO_DEUDOR_PRINCIPAL", ("udf", 48)), ("CHK_CONTR_APROB_VF", ("cpt",)),
    ("CUSTOMER_TYPE", ("ctype",)), ("CINU", ("udf", 50)), ("CO_ESG_RATING", ("udf", 52)),
    ("DATE_ESG_RATING", ("udf_date", 53)), ("CO_CLIENT_BETTER_COUNTRY", ("udf", 49)), ("CO_RISK_CUST_TYPE", ("udf", 54)),
]
LOAD_SINGLE_ONLY = [("LIMIT_EXP_DATE", ("udf_date", 17))]
LOAD_GROUP_ONLY = [
    ("CO_OFICINA_GESTION", ("udf", 47)), ("PROBABILITY_DEFAULT", ("udf_num", 59)),
    ("LOSS_GIVEN_DEFAULT", ("udf_num", 60)), ("GROUP_EXPIRATION_MONTH", ("udf_num", 61)),
]

# Carry-forward from the previous application's row: "prev" copies the
# previous value, ("lit", v) sets a constant, ("udf_if", flag, n) sets user
# field n when field 32 equals flag (else NULL), ("udf_date", n) / ("udf", n)
# read the STDCIF record.
_CARRY_BASE = [
    "SHAREHOLDER", "PRODUCT_SERVICE_OFFERED", "RELATEDCOMPANIES", "NAME_ADDRESS_LEGAL_ADVISOR",
    "REFERENCE_BANKING_COMMERCIAL", "NAME_OF_STOCK", "COUNTRIES_WHERE_OFFERS", "REGULATORY_AUTHORITY",
    "RELATEDACCOUNT", "CHK_SAMESHOLDERS_MAINCUST", ("ID_EXISTE_FCC", ("lit", "1")), "SBP_CATEGORYID",
    "DESCRIPCION_PEP", "INCORPORATION_PURPOSE", "SUB_ECOGR_CD", "LEGALREPRESENTATIVE_INFO", "LAST_CHANGE_DATE",
    "DIGNATARIES", "POWER_DEES", ("CHK_CREATE_FCC", ("lit", 0)), "AUTHORIZED_SIGNATURES", "RELATION_CORRESPONSAL",
    "SALES_MORE_30_PERCENT", "EXPORT_SHARE", "CUSTOMER_NO_FCC", "ID_CUSTOMER_FCC", "ID_SOLICITUD_LM",
]
CARRY_SINGLE = _CARRY_BASE + [
    ("ID_STATUS_FCC", ("lit", None)), ("AML_RATINGID_NY", ("udf_if", "YES", 20)),
    ("LIMIT_EXP_DATE", ("udf_date", 17)), "LMT_CUSTOMER_TYPE", "RISK_RATING", "PATRIOT_EXC_DATE",
    "NAMEOFECONOMICGROUP", "FAXNUMBER", "FECHA_CREACION_CLIENTE", "PUBLIC_TRADE_COMP", "AML_EXC_DATE",
    "GIIN_NUMBER", "W8_FORM_DATE", ("AML_RATINGID", ("udf_if", "NO", 20)), ("FECHA_KYC", ("udf_date", 39)),
    ("INCEPTION_DATE", ("udf_date", 40)), ("TIPO_DE_CLIENTE", ("udf", 42)), ("MONITOREO_TRANSACCIONAL", ("udf", 43)),
    ("INTERNAL_CONTROL", ("udf", 45)), "NEGATIVE_NEWS", "SANCTIONS",
]
CARRY_GROUP = _CARRY_BASE + [
    ("ID_STATUS_FCC", ("lit", 1)), ("AML_RATINGID_NY", ("udf_if", "YES", 20)), "INTERNAL_CLASSIFICATION",
    "LIMIT_EXP_DATE", "LMT_CUSTOMER_TYPE", "RISK_RATING", "PATRIOT_EXC_DATE", "NAMEOFECONOMICGROUP", "FAXNUMBER",
    "FECHA_CREACION_CLIENTE", "PUBLIC_TRADE_COMP", "AML_EXC_DATE", "GIIN_NUMBER", "W8_FORM_DATE",
    ("AML_RATINGID", ("udf_if", "NO", 20)),
]


def carry_rules(group: bool) -> list[tuple[str, tuple]]:
    out = []
    for r in (CARRY_GROUP if group else CARRY_SINGLE):
        out.append((r, ("prev",)) if isinstance(r, str) else r)
    return out
