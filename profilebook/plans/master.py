"""Core-banking master views (actions 9, 11-15, 17; D17, D19-D23, D25).

The master and its satellites (corporate data, user fields, MIS defaults)
are all keyed by the 9-character core id and landed in buckets of it, so the
star joins need no shuffle; code lists join by checked broadcast.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from profilebook.functions import codes, dates
from profilebook.functions.nulls import ncat
from profilebook.operators.broadcast import bounded_broadcast
from profilebook.operators.keys import top_n_pivot
from profilebook.operators.lookups import Lookup, lookups
from profilebook.sources.catalog import Catalog

CIF_FUNCTION = "STDCIF"
CONTACT_TYPE = 3   # director/manager/contact list: 1 directors, 2 managers, 3 contacts


def field_catalogue(cat: Catalog, function_id: str = CIF_FUNCTION) -> DataFrame:
    """D17 (action 9): authorised user-field names of one function."""
    m = cat.table("fcc_udf_fields_map")
    return m.filter((F.col("FUNCTION_ID") == function_id) & (F.col("AUTH_STAT") == "A")).select("FIELD_NAME")


def cif_fields(cat: Catalog) -> DataFrame:
    """User-field record of each core id (function STDCIF, 9-char key prefix, J4)."""
    return cat.cif_fields().withColumnRenamed("CORE_ID", "__udf_core")


def _star(cat: Catalog, auth: tuple[str, ...], cores: DataFrame | None = None) -> DataFrame:
    """Master + corporate + user fields + MIS defaults, all by core id; only the customers of ``cores`` (CORE_ID) when
    given.  The landed tables are bucketed by that id: nothing is shuffled."""
    m = cat.master().filter(F.col("AUTH_STAT").isin(*auth) & (F.col("RECORD_STAT") == "O"))
    if cores is not None:
        m = m.join(bounded_broadcast(cores), F.col("CUSTOMER_NO") == F.col("CORE_ID"), "left_semi")
    corp = cat.table("fcc_corporate").withColumnRenamed("CUSTOMER_NO", "__corp_no")
    mit = cat.table("fcc_mis_default")
    j = m.join(corp, F.col("CUSTOMER_NO") == F.col("__corp_no"), "left")
    j = j.join(cif_fields(cat), F.col("CUSTOMER_NO") == F.col("__udf_core"), "left")
    return j.join(mit, F.col("CUSTOMER_NO") == F.col("CUSTOMER"), "left")


def _star_codes(cat: Catalog) -> list[Lookup]:
    country = cat.table("fcc_country")
    lov = cat.table("fcc_lov")
    return [
        Lookup(cat.table("fcc_group_code"), ["GROUP_CODE"], ["GROUP_CODE"],
               {"__grp_desc": "DESCRIPTION", "__grp_code": "GROUP_CODE"}),
        Lookup(cat.table("fcc_language"), ["LANGUAGE"], ["LANG_CODE"], {"__lang": "LANG_NAME"}),
        Lookup(cat.table("fcc_location"), ["LOC_CODE"], ["LOC_CODE"], {"__loc": "DESCRIPTION"}),
        Lookup(country, ["INCORP_COUNTRY"], ["COUNTRY_CODE"], {"__cn1": "DESCRIPTION"}),
        Lookup(country, ["COUNTRY"], ["COUNTRY_CODE"], {"__cn2": "DESCRIPTION"}),
        Lookup(country, ["NATIONALITY"], ["COUNTRY_CODE"], {"__cn3": "DESCRIPTION"}),
        Lookup(country, ["EXPOSURE_COUNTRY"], ["COUNTRY_CODE"], {"__cn4": "DESCRIPTION"}),
        Lookup(cat.table("fcc_mis_code"), ["CUST_MIS_1"], ["MIS_CODE"], {"__ind": "CODE_DESC"}),
        Lookup(lov, ["FIELD_VAL_7"], ["LOV"], {"BANKTYPE_DESC": "LOV_DESC"}, where=F.col("FIELD_NAME") == "BANK TYPE"),
        Lookup(cat.table("wf_dflt_media"), ["DEFAULT_MEDIA"], ["MEDIA"], {"DEFAULT_MEDIA_DESC": "DESCRIPTION"}),
        Lookup(lov, ["FIELD_VAL_8"], ["LOV"], {"RELATIONTYPE_DESC": "LOV_DESC"},
               where=F.col("FIELD_NAME") == "RELATION TYPE"),
        Lookup(cat.table("fcc_customer_cat"), ["CUSTOMER_CATEGORY"], ["CUST_CAT"], {"CUST_CAT_DESC": "CUST_CAT_DESC"},
               where=(F.col("RECORD_STAT") == "O") & (F.col("AUTH_STAT") == "A")),
    ]


def _rating_text() -> F.Column:
    return ncat("MOODYS:", F.col("FIELD_VAL_5"), " SP:", F.col("FIELD_VAL_3"), " FITCH:", F.col("FIELD_VAL_4"))


def master_profile(cat: Catalog, core_id: str | None = None) -> DataFrame:
    """D20 (action 12): authorised, open master profile, 57 columns."""
    j = _star(cat, ("A",))
    if core_id is not None:
        j = j.filter(F.col("CUSTOMER_NO") == core_id)
    j = lookups(j, _star_codes(cat))
    c = F.col
    return j.select(
        c("CUSTOMER_NO").alias("Customer No"), c("CUSTOMER_NAME1").alias("Customer Name"),
        c("FULL_NAME").alias("Legal or Commercial Name"), c("C_NATIONAL_ID").alias("Tax Identification Number"),
        c("FIELD_VAL_18").alias("Dv"), c("CUSTOMER_CATEGORY").alias("Customer Category"),
        c("FIELD_VAL_8").alias("Relation Type"), c("CUST_MIS_1").alias("INDUSTRY_CODE"), c("__ind").alias("INDUSTRY"),
        c("__grp_desc").alias("Name of Economic Group"), c("FIELD_VAL_13").alias("Name Legal Advisors"),
        c("FIELD_VAL_14").alias("Name of External Auditors"), _rating_text().alias("Name Intl. Risk Rating Agency"),
        c("ADDRESS_LINE1").alias("Postal Address Line1"), c("ADDRESS_LINE2").alias("Postal Address Line2"),
        c("ADDRESS_LINE3").alias("Postal Address Line3"), c("ADDRESS_LINE4").alias("Postal Address City"),
        c("R_ADDRESS1").alias("Physical Address Line1"), c("R_ADDRESS2").alias("Physical Address Line2"),
        c("R_ADDRESS3").alias("Physical Address Line3"), c("UDF_2").alias("Telephone Number"),
        c("FIELD_VAL_19").alias("2nd Telephone Number"), c("FAX_NUMBER").alias("Fax Number"),
        c("UDF_1").alias("WebSite"), c("DEFAULT_MEDIA").alias("Default Media"), c("INCORP_COUNTRY").alias("INCORP_CNTRY"),
        c("__cn1").alias("Country of Incorporation"), dates.fmt_dmy(c("INCORP_DATE")).alias("Incorporation Date"),
        c("COUNTRY").alias("RESIDENCE_CNTRY"), c("__cn2").alias("Residence Country"),
        c("NATIONALITY").alias("NATIONALITYCOD"), c("__cn3").alias("NATIONALITY"),
        c("LOC_CODE").alias("RESIDENCELOCATION"), c("__loc").alias("Residence Location"),
        c("LANGUAGE").alias("LANGUAGEID"), c("__lang").alias("Language"), c("FIELD_VAL_7").alias("Bank Type"),
        c("FIELD_VAL_9").alias("Type of License"), c("SWIFT_CODE").alias("SWIFTCode"),
        c("UNIQUE_ID_VALUE").alias("ABA Code Value"), c("FIELD_VAL_11").alias("Compliance Officer"),
        c("FIELD_VAL_16").alias("Name Process Agent In USA"), c("NETWORTH"), c("EXPOSURE_COUNTRY"),
        c("__cn4").alias("EXPOSURE_COUNTRY_DESC"), c("FIELD_VAL_21").alias("Contact1"),
        c("FIELD_VAL_22").alias("Contact2"), c("FIELD_VAL_23").alias("Contact3"), c("LIABILITY_NO"), c("SHORT_NAME"),
        c("__grp_code").alias("GROUP_CODE"), c("RISK_CATEGORY"), c("BANKTYPE_DESC"), c("DEFAULT_MEDIA_DESC"),
        c("RELATIONTYPE_DESC"), c("CUST_CAT_DESC"), c("FIELD_VAL_6").alias("Economic Group RUC"),
    )


def master_profile_any(cat: Catalog, core_id: str | None = None) -> DataFrame:
    """D21 (action 13): as D20 for authorised or unauthorised records, 63 columns."""
    j = _star(cat, ("U", "A"))
    if core_id is not None:
        j = j.filter(F.col("CUSTOMER_NO") == core_id)
    j = lookups(j, _star_codes(cat))
    c = F.col
    return j.select(
        c("CUSTOMER_NO").alias("Customer No"), c("CUSTOMER_NAME1").alias("Customer Name"),
        c("FULL_NAME").alias("Legal or Commercial Name"), c("C_NATIONAL_ID").alias("Tax Identification Number"),
        c("FIELD_VAL_18").alias("Dv"), c("INCORP_COUNTRY").alias("INCORP_CNTRY"),
        c("__cn1").alias("Country of Incorporation"), dates.fmt_dmy(c("INCORP_DATE")).alias("Incorporation Date"),
        c("COUNTRY").alias("RESIDENCE_CNTRY"), c("__cn2").alias("Residence Country"),
        c("NATIONALITY").alias("NATIONALITYCOD"), c("__cn3").alias("Nationality"),
        c("LOC_CODE").alias("ResidenceLocation"), c("__loc").alias("Residence Location"),
        c("LANGUAGE").alias("LANGUAGEID"), c("__lang").alias("Language"), c("EXPOSURE_COUNTRY"),
        c("__cn4").alias("Exposure_country_desc"), c("COMP_MIS_2").alias("Location"),
        c("R_ADDRESS1").alias("Physical Address Line1"), c("R_ADDRESS2").alias("Physical Address Line2"),
        c("R_ADDRESS3").alias("Physical Address Line3"), c("ADDRESS_LINE4").alias("Postal Address City"),
        c("ADDRESS_LINE1").alias("Postal Address Line1"), c("ADDRESS_LINE2").alias("Postal Address Line2"),
        c("ADDRESS_LINE3").alias("Postal Address Line3"), c("UDF_2").alias("Telephone Number"),
        c("FIELD_VAL_19").alias("2nd Telephone Number"), c("FAX_NUMBER").alias("Fax Number"),
        c("UDF_1").alias("WebSite"), c("DEFAULT_MEDIA").alias("Default Media"),
        c("CUSTOMER_CATEGORY").alias("Customer Category"), c("FIELD_VAL_8").alias("Relation Type"),
        c("COMP_MIS_1").alias("Account Officer"), c("CUST_MIS_1").alias("Industry_code"), c("__ind").alias("Industry"),
        c("FIELD_VAL_13").alias("Legal Representative Name"), c("FIELD_VAL_14").alias("Name of External Auditors"),
        _rating_text().alias("Name Intl. Risk Rating Agency"), c("__grp_desc").alias("Name of Economic Group"),
        c("FIELD_VAL_6").alias("Economic Group RUC"), c("FIELD_VAL_7").alias("Bank Type"),
        c("FIELD_VAL_9").alias("Type of License"), c("SWIFT_CODE").alias("SWIFTCode"),
        c("UNIQUE_ID_VALUE").alias("ABA Code Value"), c("FIELD_VAL_11").alias("Compliance Officer"),
        c("FIELD_VAL_16").alias("Name Process Agent In USA"), c("FIELD_VAL_21").alias("Contact1"),
        c("FIELD_VAL_22").alias("Contact2"), c("FIELD_VAL_23").alias("Contact3"),
        c("FIELD_VAL_12").alias("Goverment Type"), c("FIELD_VAL_20").alias("Aml Rating"),
        c("FIELD_VAL_32").alias("Can be used by NY Agency"), c("NETWORTH"), c("LIABILITY_NO"),
        c("SHORT_NAME2").alias("SHORT_NAME"), c("__grp_code").alias("GROUP_CODE"), c("RISK_CATEGORY"),
        c("BANKTYPE_DESC"), c("DEFAULT_MEDIA_DESC"), c("RELATIONTYPE_DESC"), c("CUST_CAT_DESC"), c("AUTH_STAT"),
    )


def contacts(cat: Catalog, n: int = 3, apps: DataFrame | None = None) -> DataFrame:
    """Contacts 1..n of each (application, party), by name then position
    (only for ``apps`` when given)."""
    d = cat.table("wf_directors")
    if apps is not None:
        d = d.join(apps, "ID_SOLICITUD", "left_semi")
    d = d.filter((F.col("TYPE") == CONTACT_TYPE) & F.col("NAME").isNotNull())
    text = ncat(F.col("NAME"), " - ", F.col("POSITION"))
    return top_n_pivot(d, ["ID_SOLICITUD", "CUSTOMER_NO"], ["NAME", "POSITION"], text, n, "CONTACT_")


def change_comparison_set(cat: Catalog) -> DataFrame:
    """D19 (action 11): existing customers with master codes, for the change mail.

    Inner joins as in the reference: a customer without relation type, user
    fields or MIS industry is not part of the set.
    """
    p = cat.profile().filter(F.col("ID_EXISTE_FCC") == "1")
    apps = cat.table("wf_application").select(F.col("ID_SOLICITUD").alias("__sol"), "GOVERMENT_TYPE")
    ctype = cat.table("wf_customer_type").select(F.col("CUSTOMER_ID").alias("__ct"))
    rel = cat.table("fcc_lov").filter(F.col("FIELD_NAME") == "RELATION TYPE").select(
        F.col("LOV").alias("__rt"), F.col("LOV_DESC").alias("RELATIONTYPE_DESC"))
    udf = cat.table("fcc_userdef").select(F.substring("REC_KEY", 1, 9).alias("__uc"), F.col("FIELD_VAL_8").alias("__f8"))
    mit = cat.table("fcc_mis_default").select(F.col("CUSTOMER").alias("__mc"), F.col("CUST_MIS_1").alias("__m1"))
    ind_all = cat.table("fcc_mis_code").select(F.col("MIS_CODE").alias("__im"))
    j = (p.join(apps, F.col("ID_SOLICITUD") == F.col("__sol"))
         .join(bounded_broadcast(ctype), F.col("CUSTOMER_TYPE") == F.col("__ct"))
         .join(udf, F.col("CUSTOMER_NO_FCC") == F.col("__uc"))
         .join(bounded_broadcast(rel), F.col("__f8") == F.col("__rt"))
         .join(mit, F.col("CUSTOMER_NO_FCC") == F.col("__mc"))
         .join(bounded_broadcast(ind_all), F.col("__m1") == F.col("__im")))
    country = cat.table("fcc_country")
    mis = cat.table("fcc_mis_code")
    j = lookups(j, [
        Lookup(country, ["INCORP_COUNTRYID"], ["COUNTRY_CODE"], {"INCORP_CNTRY_DESC": "DESCRIPTION"}),
        Lookup(country, ["RESIDENCECOUNTRY"], ["COUNTRY_CODE"], {"RESCTRY_DESC": "DESCRIPTION"}),
        Lookup(country, ["NATIONALITYID"], ["COUNTRY_CODE"], {"NATIONALITYIDDESCR": "DESCRIPTION"}),
        Lookup(country, ["EXPOSURE_COUNTRYID"], ["COUNTRY_CODE"], {"EXPCTRY_DESC": "DESCRIPTION"}),
        Lookup(cat.table("fcc_location"), ["RESIDENCELOCATIONID"], ["LOC_CODE"], {"RESLOC_DESC": "DESCRIPTION"}),
        Lookup(cat.table("fcc_language"), ["LANGUAGEID"], ["LANG_CODE"], {"LANGUAGEID_DESC": "LANG_NAME"}),
        Lookup(mis, ["INDUSTRY"], ["MIS_CODE"], {"INDUSTRY_DESC": "CODE_DESC"},
               where=(F.col("ACTIVE") == "A") & (F.col("MIS_CLASS") == "INDUSTRY")),
    ])
    ct = contacts(cat).withColumnRenamed("ID_SOLICITUD", "__ca").withColumnRenamed("CUSTOMER_NO", "__cc")
    j = j.join(ct, (F.col("ID_SOLICITUD") == F.col("__ca")) & (F.col("CUSTOMER_NO") == F.col("__cc")), "left")
    c = F.col
    null = F.lit(None).cast("string")
    ny = c("NY_AGENCY")
    return j.select(
        c("ID_SOLICITUD"), c("CUSTOMER_NO_FCC"), c("CUSTOMER_NAME1"), c("FULLNAME"), c("TAXIDNUMBER"),
        c("DV").alias("DIGITO VERIFICADOR"), null.alias("EMPTY1"), c("INCORP_CNTRY_DESC"),
        dates.fmt_dmy(c("INCORP_DATE")).alias("INCORP_DATE"), null.alias("EMPTY2"), c("RESCTRY_DESC"),
        null.alias("EMPTY3"), c("NATIONALITYIDDESCR"), null.alias("EMPTY4"), c("RESLOC_DESC"), null.alias("EMPTY5"),
        c("LANGUAGEID_DESC"), null.alias("EMPTY6"), c("EXPCTRY_DESC"), c("LOCATIONID"), c("PHYSICALALINE1"),
        c("PHYSICALALINE2"), c("PHYSICALALINE3"), c("POSTALACITY"), c("POSTALALINE1"), c("POSTALALINE2"),
        c("POSTALALINE3"), c("TELEPHONENUMBER"), c("TELEPHONENUMBER2").alias("TEL 2 PANAMA"), c("FAXNUMBER"),
        c("WEBSITE"), c("DEFAULT_MEDIA"), c("CUSTOMER_CATEGORY"), c("RELATIONTYPE").alias("RELATION TYPE"),
        c("ACCOUNT_OFFICERID").alias("ACCOUNT OFFICER"), null.alias("EMPTY0"), c("INDUSTRY_DESC"),
        F.substring(F.rtrim(c("LEGALREPRESENTATIVE")), 1, codes.EXPORT_TEXT_LIMIT).alias("LEGAL REPRESENTATIVE"),
        c("NAMEEXTERNALAUDITORS").alias("EXTERNAL AUDITORS"), c("NAMEINTERNATIONALRISK"), c("NAMEOFECONOMICGROUP"),
        c("ECONOMICGROUPRUC").alias("ECONOMIC GROUP RUC"), codes.bank_type_label(c("BANKTYPE")).alias("BANK TYPE"),
        c("TYPEOFLICENCE").alias("TYPE OF LICENSE"), c("SWIFT_CODE"), null.alias("ABACODEVALUE"),
        c("COMPLIANCEOFFICER").alias("COMPLIANCE OFFICER"), c("ADDRESSPROCESSAGENTINUSA").alias("USA PROCESS AGENT"),
        c("CONTACT_1").alias("CONTACT 1"), c("CONTACT_2").alias("CONTACT 2"), c("CONTACT_3").alias("CONTACT 3"),
        c("GOVERMENT_TYPE"), c("AML_RATINGID"),
        F.when(ny == "1", F.lit("YES")).when(ny == "0", F.lit("NO")).alias("CUSTOMER_USED_NY"),
        c("NETWORTH"), c("LIAB_ID"), c("SHORT_NAME"), c("GROUP_CODE"), null.alias("EMPTY8"), null.alias("EMPTY9"),
        null.alias("EMPTY10"), c("RELATIONTYPE_DESC"), null.alias("EMPTY12"),
    )


def directors_sorted(cat: Catalog, application=None, core_id: str | None = None) -> DataFrame:
    """D22 (action 14): directors and managers (type <> 3) of each (application, core id), or of those given."""
    p = cat.profile().select("ID_SOLICITUD", F.col("CUSTOMER_NO").alias("__local"), "CUSTOMER_NO_FCC").filter(
        F.col("CUSTOMER_NO_FCC").isNotNull())
    if application is not None:
        p = p.filter(F.col("ID_SOLICITUD") == F.lit(application))
    if core_id is not None:
        p = p.filter(F.col("CUSTOMER_NO_FCC") == F.lit(core_id))
    d = cat.table("wf_directors").filter(F.col("TYPE") != CONTACT_TYPE)
    j = d.join(p, (d.ID_SOLICITUD == p.ID_SOLICITUD) & (d.CUSTOMER_NO == F.col("__local"))).select(
        d.ID_SOLICITUD, "CUSTOMER_NO_FCC", "TYPE", "NAME", "POSITION")
    return j.orderBy("ID_SOLICITUD", "CUSTOMER_NO_FCC", F.col("TYPE").asc_nulls_last(),
                     F.col("NAME").asc_nulls_last(), F.col("POSITION").asc_nulls_last())


def master_directors(cat: Catalog) -> DataFrame:
    """D23 (action 15): named directors of open or authorised master customers."""
    d = cat.table("fcc_corp_directors").filter(F.col("DIRECTOR_NAME").isNotNull())
    m = cat.master().filter(F.col("AUTH_STAT").isin("U", "A")).select(F.col("CUSTOMER_NO").alias("__m"), "AUTH_STAT")
    j = d.join(m, F.col("CUSTOMER_NO") == F.col("__m")).select("CUSTOMER_NO", "DIRECTOR_NAME", "AUTH_STAT")
    return j.orderBy("CUSTOMER_NO", F.col("DIRECTOR_NAME").asc_nulls_last())


def shareholder_list(cat: Catalog, core_id: str | None = None) -> DataFrame:
    """D25 (action 17): shareholder percentages by core id."""
    s = cat.table("fcc_shareholders")
    if core_id is not None:
        s = s.filter(F.col("CUSTOMER_NO") == core_id)
    return s.select("CUSTOMER_NO", "SHAREHOLDER_ID", "PERCENTAGE_HOLDING")
