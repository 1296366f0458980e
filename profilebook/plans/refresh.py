"""Application refresh from the core-banking master (D27, D32-D34, D44; M9-M13, J20-J22, J25, A9, A11).

One set-based job for any number of refresh requests.  The reference walks a
cursor per request and per customer; here every step is a join keyed so the
large sides shuffle once:

  requests -> expansion (J20 group / J21 single; master x user fields by core id)
           -> new local numbers (W1, range-partitioned, no single-task window)
           -> load from the master star (J24 + J25 address rule)
           -> slice delete (M10) and union with the kept rows
           -> previous completed application per core id (A9, partial agg)
           -> carry-forward of the previous row (M9)
           -> child rows copied and recoded (M11, M12, D44), country text (A11, M13)
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from profilebook.functions import codes, dates
from profilebook.functions.nulls import ncat
from profilebook.operators.aggregates import first_per_key, listagg
from profilebook.operators.broadcast import bounded_broadcast
from profilebook.operators.keys import assign_keys, with_base
from profilebook.operators.lookups import Lookup, lookups
from profilebook.plans import refresh_rules as R
from profilebook.plans.master import _star, cif_fields
from profilebook.plans.search import latest_application
from profilebook.session import landed
from profilebook.sources.catalog import Catalog

KEY = ["ID_SOLICITUD", "CUSTOMER_NO"]
AUDIT_STEPS = {"S": "1. ES KYC UPDATE", "G": "1. NO ES KYC UPDATE", "P": "2. DESPUES DE INSERT",
               "C": "3. DESPUES DE UPDATE"}


def expansion(cat: Catalog, requests: DataFrame) -> DataFrame:
    """Master customers each request loads.

    Purpose 6 loads the requested customer itself; any other purpose (NULL
    included) loads every customer whose field 31 names the requested id as
    its group's main customer.  Records whose limit expiry field holds the
    1970 placeholder (or nothing) are skipped.
    """
    m = cat.master().select(F.col("CUSTOMER_NO").alias("CORE_ID"), "LIABILITY_NO", "GROUP_CODE")
    u = cif_fields(cat).select("__udf_core", F.col("FIELD_VAL_31").alias("MAIN_ID"), "FIELD_VAL_17")
    mu = m.join(u, F.col("CORE_ID") == F.col("__udf_core")).filter(
        F.col("FIELD_VAL_17") != R.UNSET_LIMIT_TEXT).drop("__udf_core", "FIELD_VAL_17")
    r = requests.select("ID_SOLICITUD", "ID_PURPOSE", F.col("CUSTOMER_NO_FCC").alias("__req_core"))
    single_req = F.coalesce(F.col("ID_PURPOSE") == R.SINGLE_PURPOSE, F.lit(False))
    single = r.filter(single_req).join(mu, F.col("__req_core") == F.col("CORE_ID")).withColumn("MODE", F.lit("S"))
    group = r.filter(~single_req).join(mu, F.col("__req_core") == F.col("MAIN_ID")).withColumn("MODE", F.lit("G"))
    return single.unionByName(group).drop("__req_core")


def mail_addresses(cat: Catalog) -> DataFrame:
    """The open, authorised MAIL/CIF address of each customer (first if several)."""
    a = cat.table("fcc_cust_address").filter(
        (F.col("MEDIA") == "MAIL") & (F.col("LOCATION") == "CIF") & (F.col("RECORD_STAT") == "O")
        & (F.col("AUTH_STAT") == "A"))
    return first_per_key(a, ["CUSTOMER_NO"], ["ADDRESS1", "ADDRESS2", "ADDRESS3", "ADDRESS4"],
                         ["ADDRESS1", "ADDRESS2", "ADDRESS3", "ADDRESS4"]).select(
        F.col("CUSTOMER_NO").alias("__addr_no"), *[F.col(f"ADDRESS{i}").alias(f"__addr_{i}") for i in range(1, 5)])


def postal_line(i: int) -> Column:
    """Address line i (4 = city) by the default-media rule."""
    master_line = F.col(f"ADDRESS_LINE{i}")
    return F.when(F.col("DEFAULT_MEDIA").isin("FAX", "SWIFT"), F.col(f"__addr_{i}")).otherwise(master_line)


def master_addresses(cat: Catalog) -> DataFrame:
    """J25 over the whole master: postal lines as the refresh loads them."""
    m = cat.master().join(mail_addresses(cat), F.col("CUSTOMER_NO") == F.col("__addr_no"), "left")
    return m.select("CUSTOMER_NO", *[postal_line(i).alias(n) for i, n in
                                     ((1, "POSTALALINE1"), (2, "POSTALALINE2"), (3, "POSTALALINE3"), (4, "POSTALACITY"))])


def _load_star(cat: Catalog, cores: DataFrame) -> DataFrame:
    """The master star of the customers in ``cores``, restricted before its satellites are joined."""
    star = _star(cat, ("U", "A"), cores)
    cp = cat.table("fcc_personal").select(F.col("CUSTOMER_NO").alias("__cp_no"), "TELEPHONE", "FAX", "E_MAIL")
    star = star.join(cp, F.col("CUSTOMER_NO") == F.col("__cp_no"), "left")
    star = star.join(mail_addresses(cat), F.col("CUSTOMER_NO") == F.col("__addr_no"), "left")
    # the record keyed "<core id>~", by its core id: the star keeps its partitioning
    u = cat.table("fcc_userdef").filter(F.col("REC_KEY").endswith("~"))
    iclass = u.groupBy(F.expr("left(REC_KEY, length(REC_KEY) - 1)").alias("__ic_core")).agg(F.min("FIELD_VAL_1").alias("__iclass"))
    star = star.join(iclass, F.col("CUSTOMER_NO") == F.col("__ic_core"), "left")
    return lookups(star, [
        Lookup(cat.table("fcc_group_code"), ["GROUP_CODE"], ["GROUP_CODE"], {"__grp": "DESCRIPTION"}),
        Lookup(cat.table("fcc_lov"), ["FIELD_VAL_7"], ["LOV"], {"__bank": "LOV_DESC"},
               where=F.col("FIELD_NAME") == "BANK_TYPE"),
    ])


def _term(t: tuple, dtype) -> Column:
    kind = t[0]
    if kind == "m" or kind == "corp" or kind == "mit" or kind == "cp":
        c = F.col(t[1])
    elif kind == "udf":
        c = F.col(f"FIELD_VAL_{t[1]}")
    elif kind == "udf_date":
        c = dates.parse_iso(F.col(f"FIELD_VAL_{t[1]}"))
    elif kind == "udf_num":
        c = F.col(f"FIELD_VAL_{t[1]}")
    elif kind == "grp":
        c = F.col("__grp")
    elif kind == "addr":
        c = postal_line(t[1])
    elif kind == "bank":
        c = F.col("__bank")
    elif kind == "iclass":
        c = F.col("__iclass")
    elif kind == "cand":
        c = F.col(f"__cand_{t[1]}")
    elif kind == "req":
        c = F.col(f"__req_{t[1]}")
    elif kind == "seq":
        c = F.col("__new_no")
    elif kind == "lit":
        c = F.lit(t[1])
    elif kind == "ny":
        c = codes.ny_agency(F.col("FIELD_VAL_32"), F.col("INCORP_COUNTRY"))
    elif kind == "main":
        c = codes.main_flag(F.col("__cand_CORE_ID"), F.col("__cand_MAIN_ID"))
    elif kind == "pep":
        c = codes.pep_flag(F.col("FIELD_VAL_41"))
    elif kind == "cpt":
        c = codes.counterpart_flag(F.col("FIELD_VAL_36"))
    elif kind == "ctype":
        c = codes.customer_type(F.col("FIELD_VAL_42"), F.col("CUSTOMER_TYPE"))
    elif kind == "rating":
        c = ncat("MOODYS:", F.col("FIELD_VAL_5"), " SP:", F.col("FIELD_VAL_3"), " FITCH:", F.col("FIELD_VAL_4"))
    else:
        raise ValueError(kind)
    return c.try_cast(dtype)


@dataclass
class RefreshResult:
    expansion: DataFrame      # candidates with MODE and new local number
    previous: DataFrame       # candidates with their previous application and row
    loaded: DataFrame         # rows inserted from the master
    rows: DataFrame           # final rows of the refreshed (application, core id) pairs
    snapshot_apps: DataFrame  # every row of the refreshed applications after the job
    slice: DataFrame          # per refreshed application: deleted / kept old rows
    children: DataFrame       # multi-value rows copied into the new applications
    audit: DataFrame          # trace rows (step, key, time)


def refresh(cat: Catalog, requests: DataFrame, as_of: Column) -> RefreshResult:
    profile = cat.profile()
    schema = profile.schema
    cand = expansion(cat, requests)
    cand = with_base(cand, profile, "CUSTOMER_NO", "__base")
    cand = assign_keys(cand, ["ID_SOLICITUD", "CORE_ID"], F.col("__base"), "NEW_NO").drop("__base")

    # load (D27): candidates x master star; a customer that is not open or
    # (un)authorised loads nothing but keeps its consumed number, as a sequence would
    c_cols = [F.col(c).alias(f"__cand_{c}") for c in ("CORE_ID", "LIABILITY_NO", "GROUP_CODE", "MAIN_ID")]
    cj = cand.select(F.col("ID_SOLICITUD").alias("__req_ID_SOLICITUD"), "MODE", F.col("NEW_NO").alias("__new_no"), *c_cols)
    star = _load_star(cat, cand.select("CORE_ID").distinct())
    j = cj.join(star, F.col("__cand_CORE_ID") == F.col("CUSTOMER_NO"))
    single_cols = {c: t for c, t in R.LOAD_COMMON + R.LOAD_SINGLE_ONLY}
    group_cols = {c: t for c, t in R.LOAD_COMMON + R.LOAD_GROUP_ONLY}

    # one projection for both modes (a union of two would compute the star twice)
    def column(f) -> Column:
        s_t, g_t = single_cols.get(f.name), group_cols.get(f.name)
        single, group = F.col("MODE") == "S", F.col("MODE") == "G"
        if s_t is not None and s_t == g_t:
            return _term(s_t, f.dataType)
        if s_t is not None and g_t is not None:
            return F.when(single, _term(s_t, f.dataType)).otherwise(_term(g_t, f.dataType))
        if s_t is not None:
            return F.when(single, _term(s_t, f.dataType))
        if g_t is not None:
            return F.when(group, _term(g_t, f.dataType))
        return F.lit(None).cast(f.dataType)
    load = [column(f).alias(f.name) for f in schema.fields]
    loaded = j.select(*load)

    # slice delete (M10): group refreshes whose purpose is set and is not 1
    req_apps = requests.select(F.col("ID_SOLICITUD").alias("__app"), "ID_PURPOSE")
    delete = (~F.coalesce(F.col("ID_PURPOSE") == R.SINGLE_PURPOSE, F.lit(False))) & (
        F.col("ID_PURPOSE") != R.KEEP_SLICE_PURPOSE)
    app_flags = req_apps.groupBy("__app").agg(F.max(F.coalesce(delete, F.lit(False))).alias("__del"))
    # one row per requested application: broadcast when the batch is provably small
    old = profile.join(bounded_broadcast(app_flags), F.col("ID_SOLICITUD") == F.col("__app"))
    slice_stats = old.groupBy(F.col("__app").alias("ID_SOLICITUD")).agg(
        F.count(F.when(F.col("__del"), 1)).alias("DELETED_ROWS"), F.count(F.when(~F.col("__del"), 1)).alias("KEPT_ROWS"))

    # previous completed application of each core id (A9) and its row
    latest = latest_application(cat).select(F.col("CUSTOMER_NO_FCC").alias("__lcore"),
                                            F.col("ID_SOLICITUD").alias("PREV_SOLICITUD"),
                                            F.col("CUSTOMER_NO").alias("PREV_CUSTOMER_NO"))
    # one narrow row per candidate, landed: four of the steps below read it
    cand_prev = landed(cand.join(latest, F.col("CORE_ID") == F.col("__lcore"), "left").drop("__lcore"), "candidates")
    prev = cand_prev.filter(F.col("PREV_SOLICITUD").isNotNull())

    # child rows (M12, M11, D44) and the country text (A11, M13), per candidate
    mv = cat.table("wf_multi_values").filter(F.col("ID_TIPO_CAMPO") != R.DROPPED_CHILD_TYPE)
    src = prev.select(F.col("ID_SOLICITUD").alias("__n_app"), F.col("NEW_NO").alias("__n_no"),
                      F.col("PREV_SOLICITUD").alias("__o_app"), F.col("PREV_CUSTOMER_NO").alias("__o_no"))
    ch = mv.join(src, (F.col("ID_SOLICITUD") == F.col("__o_app")) & (F.col("CUSTOMER_NO") == F.col("__o_no")))
    country = cat.table("fcc_country")
    ch = lookups(ch, [Lookup(country, ["DESCRIPCION1"], ["DESCRIPTION"], {"__code": "COUNTRY_CODE"})])
    ch = ch.select("ID_CAMPO", "ID_TIPO_CAMPO", "DESCRIPCION1",
                   F.when(F.col("ID_TIPO_CAMPO") == R.COUNTRY_LIST_TYPE, F.col("__code")).otherwise(
                       F.col("DESCRIPCION2")).alias("DESCRIPCION2"),
                   F.col("__n_no").alias("CUSTOMER_NO"), F.col("__n_app").alias("ID_SOLICITUD"))
    children = ch.filter(~((F.col("ID_TIPO_CAMPO") == R.COUNTRY_LIST_TYPE) & F.col("DESCRIPCION2").isNull()))
    # commas inside a name become separators too, as the routine replaces them in the whole text
    text = listagg(children.filter(F.col("ID_TIPO_CAMPO") == R.COUNTRY_LIST_TYPE), KEY,
                   F.replace(F.col("DESCRIPCION1"), F.lit(","), F.lit(" ^ ")), [F.col("DESCRIPCION1")], " ^ ", "__countries")
    text = text.select(F.col("ID_SOLICITUD").alias("__t_app"), F.col("CUSTOMER_NO").alias("__t_no"), "__countries")

    # carry-forward (M9): the new values are first gathered per candidate on
    # narrow frames (previous row, user fields, country text), then applied to
    # every row of the new application with that core id in one join
    single_carry = dict(R.carry_rules(group=False))
    group_carry = dict(R.carry_rules(group=True))
    carried_cols = [f for f in schema.fields if f.name in single_carry or f.name in group_carry]
    prev_cols = sorted({c for c, t in list(single_carry.items()) + list(group_carry.items()) if t[0] == "prev"})
    prev_rows = profile.select(F.col("ID_SOLICITUD").alias("__prev_app"), F.col("CUSTOMER_NO").alias("__prev_no"),
                               *[F.col(c).alias(f"__prev_{c}") for c in prev_cols])
    udf = cif_fields(cat).select("__udf_core", *[F.col(f"FIELD_VAL_{n}").alias(f"__cu_{n}")
                                                 for n in (17, 20, 32, 39, 40, 42, 43, 45)])
    ct = prev.select(F.col("ID_SOLICITUD").alias("__p_app"), F.col("CORE_ID").alias("__p_core"),
                     F.col("MODE").alias("__p_mode"), "PREV_SOLICITUD", "PREV_CUSTOMER_NO", F.col("NEW_NO").alias("__p_new"))
    ct = ct.join(prev_rows, (F.col("PREV_SOLICITUD") == F.col("__prev_app"))
                 & (F.col("PREV_CUSTOMER_NO") == F.col("__prev_no")), "left")
    ct = ct.join(udf, F.col("__p_core") == F.col("__udf_core"), "left")
    ct = ct.join(text, (F.col("__p_app") == F.col("__t_app")) & (F.col("__p_new") == F.col("__t_no")), "left")

    def carry_term(col: str, t: tuple, dtype) -> Column:
        kind = t[0]
        if kind == "prev":
            return F.col(f"__prev_{col}")
        if kind == "lit":
            return F.lit(t[1]).cast(dtype)
        if kind == "udf_if":
            return F.when(F.col("__cu_32") == t[1], F.col(f"__cu_{t[2]}")).cast(dtype)
        if kind == "udf_date":
            return dates.parse_iso(F.col(f"__cu_{t[1]}"))
        if kind == "udf":
            return F.col(f"__cu_{t[1]}").cast(dtype)
        raise ValueError(kind)

    is_s, is_g = F.col("__p_mode") == "S", F.col("__p_mode") == "G"
    values = []
    for f in carried_cols:
        v = F.when(F.lit(False), F.lit(None).cast(f.dataType))
        if f.name in single_carry:
            v = v.when(is_s, carry_term(f.name, single_carry[f.name], f.dataType))
        if f.name in group_carry:
            v = v.when(is_g, carry_term(f.name, group_carry[f.name], f.dataType))
        applies = (is_s if f.name in single_carry else F.lit(False)) | (is_g if f.name in group_carry else F.lit(False))
        values += [v.alias(f"__cv_{f.name}"), applies.alias(f"__ca_{f.name}")]
    ct = ct.select("__p_app", "__p_core", "__p_mode", "__p_new", *values, F.col("__countries").alias("__cv_countries"))
    # rows without a previous application still need their mode and number
    no_prev = cand_prev.filter(F.col("PREV_SOLICITUD").isNull()).select(
        F.col("ID_SOLICITUD").alias("__p_app"), F.col("CORE_ID").alias("__p_core"), F.col("MODE").alias("__p_mode"),
        F.col("NEW_NO").alias("__p_new"))
    ct = ct.withColumn("__has_prev", F.lit(True)).unionByName(
        no_prev.withColumn("__has_prev", F.lit(False)), allowMissingColumns=True)

    # the carried values meet the rows by (application, core id) before these are wide: kept rows as the profile stores them,
    # loaded ones as candidates, whose core id their rows have
    narrow, widened = cat.profile_rows()
    kept = narrow.join(bounded_broadcast(app_flags), F.col("ID_SOLICITUD") == F.col("__app")).filter(~F.col("__del")).drop("__app", "__del")
    kept = widened(kept.withColumn("__row", F.struct(*kept.columns)), "__row").select("__row.*", F.col("CUSTOMER_NO_FCC").alias("__fcc"))
    kept = kept.join(ct, (F.col("ID_SOLICITUD") == F.col("__p_app")) & (F.col("__fcc") == F.col("__p_core")), "left")
    kept = widened(kept, *ct.columns).withColumn("MODE", F.lit(None).cast("string"))
    met = cj.join(ct, (F.col("__req_ID_SOLICITUD") == F.col("__p_app")) & (F.col("__cand_CORE_ID") == F.col("__p_core")), "left")
    met = met.join(star, F.col("__cand_CORE_ID") == F.col("CUSTOMER_NO")).select(*load, *ct.columns, "MODE")
    x = kept.unionByName(met)
    has_prev = F.coalesce(F.col("__has_prev"), F.lit(False))
    out = []
    for f in schema.fields:
        c = F.col(f.name)
        if f.name == "COUNTRIES_WHERE_OFFERS":
            c = F.when(has_prev, F.col("__cv_countries")).otherwise(c)
        elif f.name in single_carry or f.name in group_carry:
            c = F.when(has_prev & F.col(f"__ca_{f.name}"), F.col(f"__cv_{f.name}")).otherwise(c)
        out.append(c.alias(f.name))
    snapshot_apps = x.select(*out, "MODE", "__p_mode")
    rows = snapshot_apps.filter(F.col("__p_mode").isNotNull()).withColumnRenamed("__p_mode", "REFRESH_MODE").drop("MODE")

    aud_req = requests.select(F.when(F.coalesce(F.col("ID_PURPOSE") == R.SINGLE_PURPOSE, F.lit(False)),
                                     F.lit(AUDIT_STEPS["S"])).otherwise(F.lit(AUDIT_STEPS["G"])).alias("X"),
                              F.when(F.coalesce(F.col("ID_PURPOSE") == R.SINGLE_PURPOSE, F.lit(False)),
                                     F.col("CUSTOMER_NO_FCC")).alias("Y"))
    aud_prev = prev.select(F.concat(F.lit(AUDIT_STEPS["P"] + " "), F.col("NEW_NO").cast("string"), F.lit("-"),
                                    F.col("CORE_ID"), F.lit("-"), F.col("PREV_SOLICITUD").cast("string")).alias("X"),
                           F.concat(F.lit(" CUSTOMER ANT. "), F.col("PREV_CUSTOMER_NO").cast("string")).alias("Y"))
    # step 3: once for each previous application, after its carry-forward
    aud_carried = prev.select(F.concat(F.lit(AUDIT_STEPS["C"] + " "), F.col("NEW_NO").cast("string"), F.lit("-"),
                                       F.col("CORE_ID")).alias("X"),
                              F.concat(F.lit(" CUSTOMER ANT. "), F.col("PREV_CUSTOMER_NO").cast("string")).alias("Y"))
    audit = aud_req.unionByName(aud_prev).unionByName(aud_carried).withColumn("FECHA", as_of)
    return RefreshResult(cand, prev, loaded, rows, snapshot_apps.drop("__p_mode"), slice_stats,
                         children, audit)
