"""Risk parameters, month catalogue and KYC expiry."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from profilebook.functions import dates
from profilebook.operators.aggregates import latest_per_key
from profilebook.operators.lookups import Lookup, lookup
from profilebook.sources.catalog import Catalog

PF_MODE, PD_MODE, LGD_MODE = 1, 2, 3


def risk_list(cat: Catalog, application=None) -> DataFrame:
    """PD/LGD of the non-group customers; NULL risk shown as 0.

    ``application=None`` lists every application (the batch form of the
    routine, which is called once per application id).
    """
    p = cat.profile().filter(F.col("LMT_CUSTOMER_TYPE") != "G")
    if application is not None:
        p = p.filter(F.col("ID_SOLICITUD") == F.lit(application))
    return p.select("ID_SOLICITUD", "CUSTOMER_NO", "CUSTOMER_NO_FCC", "CUSTOMER_NAME1", "PROJECT_FINANCE",
                    F.coalesce("PROBABILITY_DEFAULT", F.lit(0)).alias("PROBABILITY_DEFAULT"),
                    F.coalesce("LOSS_GIVEN_DEFAULT", F.lit(0)).alias("LOSS_GIVEN_DEFAULT"))


def _latest_request(requests: DataFrame, mode: int, value: str, out: str) -> DataFrame:
    r = requests.filter(F.col("MODO") == mode)
    r = latest_per_key(r, ["ID_SOLICITUD", "CUSTOMER_ID"], ["REQ_ID"], [value])
    return r.select(F.col("ID_SOLICITUD").alias(f"__{out}_app"), F.col("CUSTOMER_ID").alias(f"__{out}_cust"),
                    F.col(value).alias(f"__{out}_v"), F.lit(True).alias(f"__{out}_hit"))


def apply_risk_updates(profile: DataFrame, requests: DataFrame) -> DataFrame:
    """Each request sets one column of one (application, customer) row.

    Mode 1 -> PROJECT_FINANCE, 2 -> PROBABILITY_DEFAULT, 3 ->
    LOSS_GIVEN_DEFAULT; the value is written even when NULL; any other mode
    changes nothing.  Several requests for one row and mode: the latest
    (highest REQ_ID) wins.  One left join per mode, all on the row key.
    """
    out = profile
    for mode, value, col in ((PF_MODE, "PF", "PROJECT_FINANCE"), (PD_MODE, "PD", "PROBABILITY_DEFAULT"),
                             (LGD_MODE, "LGD", "LOSS_GIVEN_DEFAULT")):
        r = _latest_request(requests, mode, value, value)
        out = out.join(r, (F.col("ID_SOLICITUD") == F.col(f"__{value}_app"))
                       & (F.col("CUSTOMER_NO") == F.col(f"__{value}_cust")), "left")
        out = out.withColumn(col, F.when(F.col(f"__{value}_hit"), F.col(f"__{value}_v").cast(
            profile.schema[col].dataType)).otherwise(F.col(col)))
        out = out.drop(f"__{value}_app", f"__{value}_cust", f"__{value}_v", f"__{value}_hit")
    return out


def affected_rows(profile: DataFrame, requests: DataFrame) -> DataFrame:
    """A10: ``SQL%ROWCOUNT`` of each request: matched rows for modes 1-3, else 0."""
    keys = profile.select(F.col("ID_SOLICITUD").alias("__a"), F.col("CUSTOMER_NO").alias("__c"))
    keys = keys.groupBy("__a", "__c").agg(F.count(F.lit(1)).alias("__n"))
    j = requests.join(keys, (F.col("ID_SOLICITUD") == F.col("__a")) & (F.col("CUSTOMER_ID") == F.col("__c")), "left")
    filas = F.when(F.col("MODO").isin(PF_MODE, PD_MODE, LGD_MODE), F.coalesce(F.col("__n"), F.lit(0))).otherwise(0)
    return j.select("REQ_ID", "MODO", filas.cast("long").alias("FILAS"))


def month_catalog(spark: SparkSession, criterion: str | None = None) -> DataFrame:
    """Months 1..12 named from 2000-12-01 + n months.

    Without a criterion: (CODIGO, DESCRIPCION, ADICIONAL1..3 all NULL); with
    one: (CODIGO, DESCRIPCION) whose name contains it (LIKE, case-sensitive,
    '%' and '_' in the criterion act as wildcards).
    """
    months = spark.range(1, 13).select(F.col("id").cast("int").alias("CODIGO"))
    months = months.withColumn("DESCRIPCION", dates.month_name(F.add_months(dates.lit_date("2000-12-01"),
                                                                            F.col("CODIGO"))))
    if criterion is None:
        return months.select("CODIGO", "DESCRIPCION", *[F.lit(None).cast("string").alias(f"ADICIONAL{i}")
                                                         for i in (1, 2, 3)])
    return months.filter(F.col("DESCRIPCION").like(f"%{criterion}%")).select("CODIGO", "DESCRIPCION")


def renewal_years(cat: Catalog, rows: DataFrame, rating_col: str, out: str = "ANIOS_RENOVACION") -> DataFrame:
    """Renewal years of the row's AML rating, 0 when the rating has no row."""
    r = lookup(rows, Lookup(cat.table("wf_renewal"), [rating_col], ["RATING"], {"__years": "TIEMPO_RENOVACION"}))
    return r.withColumn(out, F.coalesce(F.col("__years"), F.lit(0))).drop("__years")


def expiry_dates(cat: Catalog) -> DataFrame:
    """D38 over the whole profile: month = group expiry month, signing = KYC date."""
    p = cat.profile().select("ID_SOLICITUD", "CUSTOMER_NO", "GROUP_EXPIRATION_MONTH", "FECHA_KYC", "AML_RATINGID")
    p = renewal_years(cat, p, "AML_RATINGID")
    return p.select("ID_SOLICITUD", "CUSTOMER_NO", "ANIOS_RENOVACION",
                    dates.expiry_date(F.col("GROUP_EXPIRATION_MONTH"), F.col("FECHA_KYC"),
                                      F.col("ANIOS_RENOVACION")).alias("FECHA_VENCIMIENTO"))
