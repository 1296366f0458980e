"""Profile insert-or-update, status write-back and related table changes.

(D7, D26, M1-M6, M8, J18, J19, W1-W3, F30.)  Parquet tables cannot be
updated in place, so every change is a pure function ``old snapshot +
changes -> new snapshot``: rows not touched pass through, touched rows are
rebuilt by the column rules, new rows are appended.  The caller writes the
result.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from profilebook.functions import codes, dates
from profilebook.operators.aggregates import latest_per_key
from profilebook.operators.broadcast import bounded_broadcast
from profilebook.operators.keys import assign_keys, with_base
from profilebook.operators.lookups import exists_flag
from profilebook.plans.profile_rules import INSERT_RULES, PARAMETER_DEFAULTS, PARAMETERS, UPDATE_RULES
from profilebook.session import landed
from profilebook.sources.catalog import Catalog

KEY = ["ID_SOLICITUD", "CUSTOMER_NO"]
CREATION_PREFIX = "CUS"   # creation ids: prefix + 13-digit counter (16 characters)
LAST_NUMBER = 10 ** 13 - 1
# Numbers that are looked up together when the issue goes back to free ones.
FREE_BLOCK = 1 << 20


def with_parameter_defaults(changes: DataFrame) -> DataFrame:
    """a parameter that is not passed takes the routine's default (else NULL).

    A parameter passed as NULL stays NULL, as in PL/SQL.
    """
    out = changes
    present = set(changes.columns)
    for p in PARAMETERS:
        if p not in present:
            d = PARAMETER_DEFAULTS.get(p)
            out = out.withColumn(p, F.lit(d).cast(StringType()))
    return out


def _rule_value(rule, dtype, old: Column | None, as_of: Column) -> Column:
    col, param, kind = rule
    v = F.col(param) if param else None
    if kind == "plain":
        return v.try_cast(dtype)
    if kind == "upper":
        return F.upper(v.cast("string")).try_cast(dtype)
    if kind == "date":
        return dates.parse_dmy(v.cast("string"))
    if kind == "keep":
        return F.coalesce(v.try_cast(dtype), old)
    if kind == "keep_upper":
        return F.coalesce(F.upper(v.cast("string")), old)
    if kind == "seq":
        return F.col("__new_no")
    if kind == "now":
        return as_of.cast(dtype)
    if kind == "exists":
        return F.col("__exists")
    if kind == "sentinel":
        return dates.lit_date(dates.SENTINEL_LIMIT_DATE)
    if kind == "decode":
        return codes.limit_type(v)
    raise ValueError(kind)


def _levels(n: int | Column) -> int | Column:
    """Levels of dyadic blocks over the numbers 0 to n - 1."""
    if isinstance(n, Column):
        return F.length(F.bin(F.greatest(n - 1, F.lit(1)))) + 1
    return max(n - 1, 1).bit_length() + 1


def _dyadic_parts(begin: Column, end: Column, levels: int) -> Column:
    """The dyadic blocks (level, number) that together are [begin, end): at most two a level."""
    def at(k):
        size = F.pow(F.lit(2.0), k).cast("long")
        lo, hi = F.floor((begin + size - 1) / size).cast("long"), F.floor(end / size).cast("long")
        part = lambda ok, b: F.when(ok & (lo < hi), F.struct(k.alias("level"), b.alias("block")))
        return F.array(part(lo % 2 == 1, lo), part(hi % 2 == 1, hi - 1))
    parts = F.flatten(F.transform(F.sequence(F.lit(0), F.lit(levels)), at))
    return F.filter(parts, lambda x: x.isNotNull())


def hits_in_order(profile: DataFrame, changes: DataFrame) -> DataFrame:
    """J19, (REQ_ID, ID_SOLICITUD, CUSTOMER_NO, __ins): every row a request updates when the routine is called once per
    request in REQ_ID order.  ``__ins`` is the inserting request where the row is one this batch inserts (CUSTOMER_NO null).

    A request hits the rows of its application with its local number or its core id, and gives them its core id.  So a
    row's core id changes only by requests that name its local number: it is the core id of the last such request before,
    or its first one.  That is resolved set-wise, whatever the number of requests on one application:

    * by number: an equi-join;
    * by core id, rows whose number no request names: an equi-join;
    * by core id, the other rows: their core ids hold for spans of requests.  Spans are cut into dyadic blocks and
      requests meet them by the blocks they lie in, so only true hits are paired;
    * a request that hits none of these inserts a row, unless an earlier one did with the same core id, which it and all
      later requests of that core id hit.  Numbers drawn in the batch are not known to its requests.
    """
    no_t, fcc_t = profile.schema["CUSTOMER_NO"].dataType, profile.schema["CUSTOMER_NO_FCC"].dataType
    app_t = profile.schema["ID_SOLICITUD"].dataType
    r = changes.select("REQ_ID", F.col("IN_ID_SOLICITUD").cast(app_t).alias("r_app"), F.col("IN_CUSTOMER_NO").try_cast(no_t).alias("r_no"),
                       F.col("IN_CUSTOMER_NO_FCC").try_cast(fcc_t).alias("r_fcc"))
    # 0, 1, ... in REQ_ID order within each application: the fewer requests it has, the fewer blocks below
    r = assign_keys(r, ["r_app", "REQ_ID"], F.lit(-1).cast("long"), "at")
    per_app = r.groupBy("r_app").agg(F.min("at").alias("r_first"), F.count(F.lit(1)).alias("r_count"))
    r = landed(r.filter(F.col("r_app").isNull()).select("*", F.lit(0).cast("long").alias("r_count")).unionByName(
        r.join(bounded_broadcast(per_app), "r_app").withColumn("at", F.col("at") - F.col("r_first")).drop("r_first")), "requests")
    asked = r.filter(F.col("r_app").isNotNull())
    # rows of the requested applications only; the list grows with the batch
    apps = bounded_broadcast(asked.select("r_app").distinct())
    rows = landed(profile.select("ID_SOLICITUD", "CUSTOMER_NO", "CUSTOMER_NO_FCC").join(
        apps, F.col("ID_SOLICITUD") == F.col("r_app"), "left_semi"), "requested-rows")

    row = ["ID_SOLICITUD", "CUSTOMER_NO"]
    named = landed(asked.filter(F.col("r_no").isNotNull()).join(
        rows, (F.col("ID_SOLICITUD") == F.col("r_app")) & (F.col("CUSTOMER_NO") == F.col("r_no"))).select(
        "REQ_ID", "at", "r_count", *row, "r_fcc", "CUSTOMER_NO_FCC"), "named-rows")
    keyed = asked.filter(F.col("r_fcc").isNotNull()).select("REQ_ID", "at", "r_count", "r_app", "r_fcc")
    same_fcc = lambda c: (F.col("ID_SOLICITUD") == F.col("r_app")) & (F.col(c) == F.col("r_fcc"))
    still = rows.join(named.select(*row).distinct(), row, "left_anti")
    by_still = keyed.join(still, same_fcc("CUSTOMER_NO_FCC")).select("REQ_ID", *row)

    # spans of requests over which a named row keeps one core id (null spans are hit by nobody)
    first = named.select(*row, F.lit(-1).cast("long").alias("at"), "r_count", F.col("CUSTOMER_NO_FCC").alias("fcc")).distinct()
    steps = first.unionByName(named.select(*row, "at", "r_count", F.col("r_fcc").alias("fcc")))
    w = Window.partitionBy(*row).orderBy("at")
    moves = steps.withColumn("was", F.lag("fcc").over(w)).filter((F.col("at") == -1) | ~F.col("fcc").eqNullSafe(F.col("was")))
    spans = moves.withColumn("end", F.coalesce(F.lead("at").over(w) + 1, F.col("r_count"))).filter(F.col("fcc").isNotNull())
    levels = _levels(F.col("r_count"))
    spans = spans.select(*row, "fcc", F.explode(_dyadic_parts(F.col("at") + 1, F.col("end"), levels)).alias("part"))
    blocks = F.transform(F.sequence(F.lit(0), levels), lambda k: F.struct(
        k.alias("r_level"), F.floor(F.col("at") / F.pow(F.lit(2.0), k)).cast("long").alias("r_block")))
    # only requests for a core id that some named row of their application holds at some time
    held = steps.select(F.col("ID_SOLICITUD").alias("r_app"), F.col("fcc").alias("r_fcc")).distinct()
    moving = keyed.join(held, ["r_app", "r_fcc"], "left_semi")
    moving = moving.select("REQ_ID", "r_app", "r_fcc", F.explode(blocks).alias("b")).select("REQ_ID", "r_app", "r_fcc", "b.*")
    by_span = moving.join(spans.hint("merge"), same_fcc("fcc") & (F.col("part.level") == F.col("r_level")) & (F.col("part.block") == F.col("r_block")))
    hits = landed(named.select("REQ_ID", *row).unionByName(by_still).unionByName(by_span.select("REQ_ID", *row)).distinct(), "old-hits")

    free = r.join(hits.select("REQ_ID").distinct(), "REQ_ID", "left_anti").filter(F.col("r_app").isNotNull() & F.col("r_fcc").isNotNull())
    new = free.groupBy(F.col("r_app").alias("n_app"), F.col("r_fcc").alias("n_fcc")).agg(F.min("at").alias("n_at"), F.min_by("REQ_ID", "at").alias("__ins"))
    again = keyed.join(new, (F.col("r_app") == F.col("n_app")) & (F.col("r_fcc") == F.col("n_fcc")) & (F.col("at") > F.col("n_at")))
    return landed(hits.withColumn("__ins", F.lit(None).cast("long")).unionByName(again.select(
        "REQ_ID", F.col("n_app").alias("ID_SOLICITUD"), F.lit(None).cast(no_t).alias("CUSTOMER_NO"), F.col("__ins").cast("long").alias("__ins"))), "hits")


def existence(changes: DataFrame, master: DataFrame) -> DataFrame:
    """ID_EXISTE_FCC per request: '1' when the given core id is in the master."""
    c = changes.select("REQ_ID", "IN_CUSTOMER_NO_FCC")
    return exists_flag(c, master, "IN_CUSTOMER_NO_FCC", "CUSTOMER_NO", "__exists")


class UpsertResult:
    def __init__(self, rows: Callable[[], tuple[DataFrame, DataFrame]], results: DataFrame, matches: DataFrame,
                 inserted: DataFrame):
        self._rows = rows             # makes snapshot and touched, when they are asked for: that lands wide rows
        self.results = results        # per request: RESULTADO, CUSTOMER_NO
        self.matches = matches        # J19 matches
        self.inserted = inserted      # W1: (REQ_ID, CUSTOMER_NO) of new rows

    @functools.cached_property
    def _made(self) -> tuple[DataFrame, DataFrame]:
        return self._rows()

    @property
    def snapshot(self) -> DataFrame:
        """The whole new profile."""
        return self._made[0]

    @property
    def touched(self) -> DataFrame:
        """Updated and inserted rows (new values)."""
        return self._made[1]


def upsert_profiles(profile: DataFrame, changes: DataFrame, master: DataFrame, as_of: Column) -> UpsertResult:
    """Count matches per request; none -> insert, else update all matches.

    Several requests touching one row: the batch equals calling the routine in
    REQ_ID order.  The last request writes the row; a column that keeps its old
    value for a null parameter takes the last request that gives one.
    """
    schema = profile.schema
    # the requests, the rows they hit and what they write there grow with the batch: each is landed once, so that the
    # plans over the wide profile stay small
    c = with_parameter_defaults(changes)
    c = landed(c.join(existence(c, master).select("REQ_ID", "__exists"), "REQ_ID"), "changes")
    hits = hits_in_order(profile, c)
    # inserts: requests without a match get the next sequence numbers
    fresh = c.join(hits.select("REQ_ID").distinct(), "REQ_ID", "left_anti")
    fresh = with_base(fresh, profile, "CUSTOMER_NO", "__base")
    fresh = assign_keys(fresh, ["REQ_ID"], F.col("__base"), "__new_no")   # checkpointed inside
    ins_cols = {r[0]: r for r in INSERT_RULES}
    inserted = fresh.select(*[
        (_rule_value(ins_cols[f.name], f.dataType, None, as_of) if f.name in ins_cols
         else F.lit(None).cast(f.dataType)).alias(f.name) for f in schema.fields], "REQ_ID")

    def rows() -> tuple[DataFrame, DataFrame]:
        upd_cols = {r[0]: r for r in UPDATE_RULES}
        kept = [r for r in UPDATE_RULES if r[2] in ("keep", "keep_upper")]
        given = c.select("REQ_ID", *[_rule_value(r, schema[r[0]].dataType, F.lit(None), as_of).alias(f"__k_{r[0]}") for r in kept])
        per_row = hits.join(given, "REQ_ID").groupBy(*KEY, "__ins").agg(
            F.max("REQ_ID").alias("__req"),
            *[F.max_by(f"__k_{r[0]}", F.when(F.col(f"__k_{r[0]}").isNotNull(), F.col("REQ_ID"))).alias(f"__k_{r[0]}") for r in kept])
        # each touched row with its last request
        per_row = landed(per_row.join(c.withColumnRenamed("REQ_ID", "__req"), "__req"), "touched")

        def rewritten(f):
            if f.name not in upd_cols:
                return F.col(f"o.{f.name}")
            if upd_cols[f.name][2] in ("keep", "keep_upper"):
                return F.coalesce(F.col(f"__k_{f.name}"), F.col(f"o.{f.name}"))
            return _rule_value(upd_cols[f.name], f.dataType, None, as_of)

        # the rows a batch touches grow with the batch, not with the profile:
        # broadcast them when provably small, so the wide profile is not shuffled
        on_old = per_row.filter(F.col("__ins").isNull()).drop("__ins")
        hit = profile.alias("o").join(bounded_broadcast(on_old), KEY)
        updated = hit.select(*[rewritten(f).alias(f.name) for f in schema.fields])

        # rows inserted and then updated by later requests of the batch
        on_new = per_row.filter(F.col("__ins").isNotNull()).drop(*KEY)
        renewed = inserted.alias("o").join(on_new, F.col("o.REQ_ID") == F.col("__ins")).select(
            *[rewritten(f).alias(f.name) for f in schema.fields])
        final = inserted.join(on_new.select("__ins"), F.col("REQ_ID") == F.col("__ins"), "left_anti").drop("REQ_ID")

        untouched = profile.join(bounded_broadcast(on_old.select(*KEY)), KEY, "left_anti")
        touched = updated.unionByName(final).unionByName(renewed)
        return untouched.unionByName(touched), touched

    numbers = inserted.select(F.col("REQ_ID").alias("__ins"), F.col("CUSTOMER_NO").alias("__new"))
    matches = hits.join(numbers, "__ins", "left").select(
        "REQ_ID", "ID_SOLICITUD", F.coalesce("CUSTOMER_NO", "__new").alias("CUSTOMER_NO"))

    req = c.select("REQ_ID", "IN_CUSTOMER_NO")
    n = matches.groupBy("REQ_ID").agg(F.count(F.lit(1)).alias("__n"))
    res = req.join(n, "REQ_ID", "left").join(inserted.select("REQ_ID", F.col("CUSTOMER_NO").alias("__new")), "REQ_ID",
                                             "left")
    results = res.select("REQ_ID",
                         F.when(F.col("__n") > 0, F.lit("ACTUALIZADO")).otherwise(F.lit("INSERTADO")).alias("RESULTADO"),
                         F.when(F.col("__n") > 0, F.col("IN_CUSTOMER_NO").cast("long")).otherwise(F.col("__new"))
                         .alias("CUSTOMER_NO"))
    return UpsertResult(rows, results, matches,
                        inserted.select("REQ_ID", "CUSTOMER_NO"))


def propagate_names(limits: DataFrame, changes: DataFrame, matches: DataFrame) -> DataFrame:
    """M5: an updating request writes its name to the limits table, by local id
    and, for non-group rows, by core id; the later statement wins."""
    upd = changes.join(matches.select("REQ_ID").distinct(), "REQ_ID", "left_semi")
    by_id = latest_per_key(upd.select("REQ_ID", "IN_ID_SOLICITUD", "IN_CUSTOMER_NO", "IN_CUSTOMER_NAME1")
                           .withColumn("__ord", F.col("REQ_ID") * 2),
                           ["IN_ID_SOLICITUD", "IN_CUSTOMER_NO"], ["__ord"], ["__ord", "IN_CUSTOMER_NAME1"])
    by_fcc = latest_per_key(upd.select("REQ_ID", "IN_ID_SOLICITUD", "IN_CUSTOMER_NO_FCC", "IN_CUSTOMER_NAME1")
                            .withColumn("__ord", F.col("REQ_ID") * 2 + 1),
                            ["IN_ID_SOLICITUD", "IN_CUSTOMER_NO_FCC"], ["__ord"], ["__ord", "IN_CUSTOMER_NAME1"])
    a = by_id.select(F.col("IN_ID_SOLICITUD").alias("__a1"), F.col("IN_CUSTOMER_NO").alias("__k1"),
                     F.col("__ord").alias("__o1"), F.col("IN_CUSTOMER_NAME1").alias("__n1"))
    b = by_fcc.select(F.col("IN_ID_SOLICITUD").alias("__a2"), F.col("IN_CUSTOMER_NO_FCC").alias("__k2"),
                      F.col("__ord").alias("__o2"), F.col("IN_CUSTOMER_NAME1").alias("__n2"))
    j = limits.join(a, (F.col("ID_SOLICITUD") == F.col("__a1")) & (F.col("CUSTOMER_ID") == F.col("__k1")), "left")
    j = j.join(b, (F.col("ID_SOLICITUD") == F.col("__a2")) & (F.col("CUSTOMER_NO") == F.col("__k2"))
               & (F.col("CUSTOMER_TYPE") != "G"), "left")
    o1, o2 = F.coalesce(F.col("__o1"), F.lit(-1)), F.coalesce(F.col("__o2"), F.lit(-1))
    name = (F.when(F.col("__o1").isNull() & F.col("__o2").isNull(), F.col("CUSTOMER_NAME"))
            .when(o2 > o1, F.col("__n2")).otherwise(F.col("__n1")))
    return j.select("ID_SOLICITUD", "CUSTOMER_ID", "CUSTOMER_NO", name.alias("CUSTOMER_NAME"), "CUSTOMER_TYPE")


def record_status(profile: DataFrame, events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """D7/M6 (action 1): the latest status event per creation id updates every
    profile row carrying that id (status, message, creation and inception
    dates = the event time).  Returns (new snapshot, touched rows)."""
    latest = latest_per_key(events, ["ID_CUSTOMER_FCC"], ["EVENT_TS", "EVENT_ID"],
                            ["ID_STATUS_FCC", "MSG_ERROR_FCC", "EVENT_TS"])
    ev = latest.select(F.col("ID_CUSTOMER_FCC").alias("__cid"), F.col("ID_STATUS_FCC").alias("__st"),
                       F.col("MSG_ERROR_FCC").alias("__msg"), F.col("EVENT_TS").alias("__ts"))
    named = profile.filter(F.col("ID_CUSTOMER_FCC").isNotNull())
    j = named.join(bounded_broadcast(ev), F.col("ID_CUSTOMER_FCC") == F.col("__cid"), "left")
    hit = F.col("__cid").isNotNull()
    schema = profile.schema
    sets = {
        "ID_STATUS_FCC": F.col("__st").cast(schema["ID_STATUS_FCC"].dataType),
        "MSG_ERROR_FCC": F.col("__msg"),
        "FECHA_CREACION_CLIENTE": F.col("__ts").cast(schema["FECHA_CREACION_CLIENTE"].dataType),
        "INCEPTION_DATE": F.to_date(F.col("__ts")),
    }
    snap = j.select(*[(F.when(hit, sets[f.name]).otherwise(F.col(f.name)) if f.name in sets else F.col(f.name))
                      .alias(f.name) for f in schema.fields], hit.alias("__hit"))
    touched = snap.filter("__hit").drop("__hit")
    # rows without a creation id match no event and never enter the join
    return snap.drop("__hit").unionByName(profile.filter(F.col("ID_CUSTOMER_FCC").isNull())), touched


def copy_main_to_group(cat: Catalog, profile: DataFrame, mains_from: DataFrame | None = None) -> DataFrame:
    """M8 (action 4 pre-step): group rows take type code, category and industry
    of their application's main party and the KYC date 1990-01-01.

    ``mains_from`` is where the main parties are looked up (default: the rows
    being updated), so a caller may update only the group rows.
    The main party is the first main row (lowest number) whose type has a code
    row; an application without one leaves its group rows unchanged, as the
    reference's lookup falls into its no-data handler before updating.
    """
    ctype = cat.table("wf_customer_type").select(F.col("CUSTOMER_ID").alias("__ct"))
    src = profile if mains_from is None else mains_from
    mains = src.filter(F.col("MAIN_CUSTOMER") == 1).join(ctype, F.col("CUSTOMER_TYPE") == F.col("__ct"))
    first = latest_per_key(mains.withColumn("__neg", -F.col("CUSTOMER_NO")), ["ID_SOLICITUD"], ["__neg"],
                           ["CUSTOMER_TYPE", "CUSTOMER_CATEGORY", "INDUSTRY"])
    m = first.select(F.col("ID_SOLICITUD").alias("__app"), F.col("CUSTOMER_TYPE").alias("__t"),
                     F.col("CUSTOMER_CATEGORY").alias("__c"), F.col("INDUSTRY").alias("__i"))
    j = profile.join(m, F.col("ID_SOLICITUD") == F.col("__app"), "left")
    grp = (F.col("LMT_CUSTOMER_TYPE") == "G") & F.col("__app").isNotNull()
    sets = {"CUSTOMER_TYPE": F.col("__t"), "CUSTOMER_CATEGORY": F.col("__c"), "INDUSTRY": F.col("__i"),
            "FECHA_KYC": dates.lit_date(dates.GROUP_KYC_DATE)}
    return j.select(*[(F.when(grp, sets[f.name]).otherwise(F.col(f.name)) if f.name in sets else F.col(f.name))
                      .alias(f.name) for f in profile.schema.fields])


def _creation_id(n: Column) -> Column:
    """The id of counter value ``n``; a counter that needs more than 13 digits fails instead of being cut."""
    full = F.raise_error(F.concat(F.lit("creation-id counter exceeds 13 digits: "), n.cast("string")))
    return F.when(n > LAST_NUMBER, full.cast("string")).otherwise(
        F.concat(F.lit(CREATION_PREFIX), F.lpad(n.cast("string"), 13, "0")))


def _number(column: str) -> Column:
    return F.substring(column, len(CREATION_PREFIX) + 1, 13).cast("long")


def _issued(profile: DataFrame) -> DataFrame:
    """The ids of the profile that a counter value gave (``__id``), one row each; they sort as their numbers do."""
    return profile.select(F.col("ID_CUSTOMER_FCC").alias("__id")).filter(F.col("__id").rlike(r"^CUS\d{13}$"))


def _with_free_numbers(rows: DataFrame, issued: DataFrame, most: int, wanted: int) -> DataFrame:
    """``rows`` with ``__number``: for ``__k`` = 1, 2, ..., ``wanted`` the k-th number from 1 on that is not ``issued``.

    ``most`` is at least the count of issued numbers, so only those up to ``wanted + most`` matter.  Numbers below the i-th
    issued one, a, of which a - i are free, are found in blocks of ``FREE_BLOCK``: a row of k adds the largest i with
    a - i < k.  Each block starts with what the blocks before it add.
    """
    id_of = lambda n: f"{CREATION_PREFIX}{min(n, LAST_NUMBER):013d}"
    held = issued.filter(F.col("__id").between(id_of(1), id_of(wanted + most))).select(_number("__id").alias("__n")).distinct()
    ranked = assign_keys(held, ["__n"], F.lit(0).cast("long"), "__rank")
    steps = landed(ranked.groupBy((F.col("__n") - F.col("__rank")).alias("__at")).agg(F.max("__rank").alias("__add")).filter(
        F.col("__at") < wanted).withColumn("__block", F.floor(F.col("__at") / FREE_BLOCK).cast("long")), "number-gaps")
    per_block = steps.groupBy("__block").agg(F.max("__add").alias("__most"))
    before = Window.orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = steps.sparkSession.range((wanted - 1) // FREE_BLOCK + 1).withColumnRenamed("id", "__block")
    starts = blocks.join(per_block, "__block", "left").select(
        "__block", F.lit(-1).cast("long").alias("__at"), F.lit(0).alias("__step"), F.max("__most").over(before).alias("__add"))
    found = rows.withColumns({"__block": F.floor((F.col("__k") - 1) / FREE_BLOCK).cast("long"), "__at": F.col("__k"),
                              "__step": F.lit(0), "__add": F.lit(None).cast("long")})
    both = found.unionByName(steps.withColumn("__step", F.lit(1)).unionByName(starts), allowMissingColumns=True)
    so_far = Window.partitionBy("__block").orderBy("__at", "__step").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    added = F.coalesce(F.max("__add").over(so_far), F.lit(0))
    return both.withColumn("__number", F.col("__k") + added).filter(F.col("__k").isNotNull()).drop(
        "__block", "__at", "__step", "__add")


def creation_ids(profile: DataFrame, applications: DataFrame | None = None, passes: int = 2) -> DataFrame:
    """W2 + W3 on the narrow key projection: (ID_SOLICITUD, CUSTOMER_NO, NEW_ID)
    for every row that receives a new creation id.

    (1) every row without a creation id gets the next number; (2) rows not in
    the master, not created and marked for creation get another new number
    (rows just filled included).  Numbers run in (application, customer)
    order after the current counter; only the given applications (default
    all) take part.  An id has 13 digits: when the numbers after the counter
    are used up, the issue goes on with those that no row holds, from 1 on.
    """
    keys = profile.select(*KEY, "ID_CUSTOMER_FCC", "ID_EXISTE_FCC", "ID_STATUS_FCC", "CHK_CREATE_FCC")
    if applications is not None:
        keys = keys.join(applications.select("ID_SOLICITUD").distinct(), "ID_SOLICITUD", "left_semi")
    issued = _issued(profile)
    counter, held = issued.agg(F.max("__id").alias("__id"), F.count(F.lit(1)).alias("__held")).select(
        F.coalesce(_number("__id"), F.lit(0)), "__held").first()
    zero = F.lit(0).cast("long")
    new = assign_keys(keys.filter(F.col("ID_CUSTOMER_FCC").isNull()).select(*KEY), KEY, zero, "__n1").select(*KEY, "__n1")
    wanted = new.count()
    if passes == 1:
        new = new.withColumnRenamed("__n1", "__nth")
    else:
        failed = ((F.col("ID_EXISTE_FCC") == "0") & (F.coalesce(F.col("ID_STATUS_FCC"), F.lit(0)) == 0)
                  & (F.col("CHK_CREATE_FCC") == 1))
        again = assign_keys(keys.filter(failed).select(*KEY), KEY, F.lit(wanted).cast("long"), "__n2").select(*KEY, "__n2")
        wanted += again.count()
        new = new.join(again, KEY, "full").select(*KEY, F.coalesce("__n2", "__n1").alias("__nth"))
    after, room = F.lit(counter) + F.col("__nth"), LAST_NUMBER - counter
    if wanted <= room:
        return new.select(*KEY, _creation_id(after).alias("NEW_ID"))
    beyond = new.filter(F.col("__nth") > room).withColumn("__k", F.col("__nth") - room)
    free = _with_free_numbers(beyond, issued, held, wanted - room)
    # a free number above the counter is one that this issue has given already: none is left
    free = free.select(*KEY, F.when(F.col("__number") <= counter, F.col("__number")).otherwise(after).alias("__number"))
    numbers = new.filter(F.col("__nth") <= room).select(*KEY, after.alias("__number")).unionByName(free)
    return numbers.select(*KEY, _creation_id(F.col("__number")).alias("NEW_ID"))


def with_creation_ids(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """Apply new creation ids to ``rows`` (any subset of profile rows)."""
    m = ids.select(*[F.col(k).alias(f"__i_{k}") for k in KEY], "NEW_ID")
    j = rows.join(m, (F.col("ID_SOLICITUD") == F.col("__i_ID_SOLICITUD"))
                  & (F.col("CUSTOMER_NO") == F.col("__i_CUSTOMER_NO")), "left")
    return j.withColumn("ID_CUSTOMER_FCC", F.coalesce(F.col("NEW_ID"), F.col("ID_CUSTOMER_FCC"))).drop(
        "NEW_ID", "__i_ID_SOLICITUD", "__i_CUSTOMER_NO")


def fill_missing_ids(profile: DataFrame, applications: DataFrame | None = None, passes: int = 2) -> DataFrame:
    """The profile after W2 (+ W3 when ``passes`` = 2) for the given applications."""
    return with_creation_ids(profile, creation_ids(profile, applications, passes)).select(*profile.columns)
