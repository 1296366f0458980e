"""Status events keep the profile current (T1) and completeness counts live.

The reference receives one call per status event (action 1), which updates the profile rows of a creation id, and is
polled for completeness per application at an open stage (actions 6, 7, 16).  Here both are one streaming query:

* Events are de-duplicated by event id within the watermark, then ``foreachBatch`` merges the latest event of each
  creation id into a bucketed snapshot of the profile's status columns (M6); the other columns of the wide profile never
  change here and are not rewritten.  The snapshot keeps each row's last event (time, id): an older or repeated event
  never wins, whatever the split into batches.  Ids unknown to the profile match no row and leave no trace.  Only the
  buckets that hold the batch's ids are read and rewritten.
* A merged row also keeps the status it had before and the batch that changed it.  The batch's count changes per
  application are read from the merged buckets, joined to the table of counts, which holds the applications at the
  stage (static stage table, joined when the counts are set up), and merged there.  The work of a batch grows with the
  buckets it touches, not with the history of the stream.

Every merge is committed under the batch number.  A batch that is run again, also after a loss between the two merges,
finds its commit and goes on from there.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from profilebook.sources.snapshots import Snapshot

CREATED = (1, 3)
FAILED = (0,)
#: Longest time by which an event may follow a later one before it counts as lost.
LATENESS = "60 days"
#: What identifies and classifies a row, and what a status event sets.
KEPT = ["ID_SOLICITUD", "CUSTOMER_NO", "ID_CUSTOMER_FCC", "CHK_CREATE_FCC", "LMT_CUSTOMER_TYPE"]
SET = ["ID_STATUS_FCC", "MSG_ERROR_FCC", "FECHA_CREACION_CLIENTE", "INCEPTION_DATE"]
KEY = KEPT[:2]


def latest_status(events: DataFrame) -> DataFrame:
    """Latest event per creation id by (event time, event id)."""
    pick = F.max_by(F.struct("ID_STATUS_FCC", "MSG_ERROR_FCC", "EVENT_TS", "EVENT_ID"), F.struct("EVENT_TS", "EVENT_ID"))
    return events.filter(F.col("ID_CUSTOMER_FCC").isNotNull()).groupBy("ID_CUSTOMER_FCC").agg(pick.alias("__l")).select(
        "ID_CUSTOMER_FCC", *[F.col(f"__l.{c}").alias(c) for c in ("ID_STATUS_FCC", "MSG_ERROR_FCC", "EVENT_TS", "EVENT_ID")])


def _is(status: Column, codes: tuple) -> Column:
    return F.coalesce(status.isin(*codes), F.lit(False)).cast("int")


def _counted(profile: DataFrame) -> DataFrame:
    """The rows that completeness counts: marked for creation, not a group."""
    return profile.filter((F.col("CHK_CREATE_FCC") == 1) & (F.col("LMT_CUSTOMER_TYPE") != "G"))


def completeness(profile: DataFrame, at_stage: DataFrame) -> DataFrame:
    """T2 batch form: per application of ``at_stage`` (ID_SOLICITUD), the rows expected, created and failed."""
    p = _counted(profile).join(at_stage, "ID_SOLICITUD", "left_semi")
    s = F.col("ID_STATUS_FCC")
    return p.groupBy("ID_SOLICITUD").agg(F.count(F.lit(1)).alias("EXPECTED"), F.sum(_is(s, CREATED)).cast("long").alias("CREATED"),
                                         F.sum(_is(s, FAILED)).cast("long").alias("FAILED"))


class StatusStream:
    """T1 and T2 over a folder of status-event files.

    ``profile`` (as before the stream) and ``at_stage`` (the applications at the stage) set up the snapshot and the counts
    when ``out_dir`` is new; after a restart both are read from ``out_dir``.
    """

    def __init__(self, spark: SparkSession, profile: DataFrame, at_stage: DataFrame, out_dir: str, buckets: int = 8,
                 lateness: str = LATENESS, state_partitions: int | None = None):
        self.spark, self.out_dir, self.lateness = spark, out_dir, lateness
        # state-store partitions are fixed in the query's checkpoint at its first start: size them to the cluster
        self.state_partitions = state_partitions or 2 * spark.sparkContext.defaultParallelism
        self.base = profile
        rows = profile.filter(F.col("ID_CUSTOMER_FCC").isNotNull()).select(*KEPT, *SET)
        schema = StructType([*rows.schema.fields, StructField("LAST_EVENT_TS", profile.schema["FECHA_CREACION_CLIENTE"].dataType),
                             StructField("LAST_EVENT_ID", LongType()), StructField("PREVIOUS_STATUS", profile.schema["ID_STATUS_FCC"].dataType),
                             StructField("CHANGED_BY", LongType())])
        self.snapshot = Snapshot(spark, f"{out_dir}/profile", schema, ["ID_CUSTOMER_FCC"], buckets)
        start = rows.select("*", *[F.lit(None).cast(f.dataType).alias(f.name) for f in schema.fields[len(rows.columns):]])
        self.snapshot.overwrite(start, "start")
        counts = completeness(profile, at_stage)
        self.totals = Snapshot(spark, f"{out_dir}/counts", counts.schema, ["ID_SOLICITUD"], buckets)
        self.totals.overwrite(counts, "start")

    def _merged(self, rows: DataFrame, latest: DataFrame, epoch: int) -> DataFrame:
        """M6 on the rows of the touched buckets."""
        e = latest.select(F.col("ID_CUSTOMER_FCC").alias("__id"), *[F.col(c).alias(f"__{c}") for c in (
            "ID_STATUS_FCC", "MSG_ERROR_FCC", "EVENT_TS", "EVENT_ID")])
        j = rows.join(e, F.col("ID_CUSTOMER_FCC") == F.col("__id"), "left")
        newer = F.col("__id").isNotNull() & (F.col("LAST_EVENT_TS").isNull() | (
            F.struct("__EVENT_TS", "__EVENT_ID") > F.struct(F.col("LAST_EVENT_TS").alias("__EVENT_TS"), F.col("LAST_EVENT_ID").alias("__EVENT_ID"))))
        sets = {"ID_STATUS_FCC": F.col("__ID_STATUS_FCC"), "MSG_ERROR_FCC": F.col("__MSG_ERROR_FCC"),
                "FECHA_CREACION_CLIENTE": F.col("__EVENT_TS"), "INCEPTION_DATE": F.to_date("__EVENT_TS"),
                "LAST_EVENT_TS": F.col("__EVENT_TS"), "LAST_EVENT_ID": F.col("__EVENT_ID"),
                "PREVIOUS_STATUS": F.col("ID_STATUS_FCC"), "CHANGED_BY": F.lit(epoch)}
        return j.select(*[F.when(newer, sets[f.name].cast(f.dataType)).otherwise(F.col(f.name)).alias(f.name) if f.name in sets
                          else F.col(f.name) for f in self.snapshot.schema.fields])

    def _recount(self, epoch: int, touched: list[int]) -> None:
        """What the batch's rows were and are, added to the counts of their applications."""
        now, was = F.col("ID_STATUS_FCC"), F.col("PREVIOUS_STATUS")
        changed = _counted(self.snapshot.read(touched)).filter(F.col("CHANGED_BY") == epoch)
        delta = changed.groupBy(F.col("ID_SOLICITUD").alias("__app")).agg(
            F.sum(_is(now, CREATED) - _is(was, CREATED)).alias("__c"), F.sum(_is(now, FAILED) - _is(was, FAILED)).alias("__f"))
        delta = delta.filter((F.col("__c") != 0) | (F.col("__f") != 0))
        self.totals.merge(delta.select(F.col("__app").alias("ID_SOLICITUD")), lambda t: t.join(
            delta, F.col("ID_SOLICITUD") == F.col("__app"), "left").select(
            "ID_SOLICITUD", "EXPECTED", (F.col("CREATED") + F.coalesce("__c", F.lit(0))).alias("CREATED"),
            (F.col("FAILED") + F.coalesce("__f", F.lit(0))).alias("FAILED")), f"batch {epoch}")

    def apply(self, events: DataFrame, epoch: int) -> None:
        """One batch; running it again changes nothing."""
        # written and read back: the stateful plan behind ``events`` runs once
        path = f"{self.out_dir}/batches/latest-{epoch}"
        latest_status(events).write.mode("overwrite").parquet(path)
        latest = self.spark.read.parquet(path)
        self.snapshot.merge(latest.select("ID_CUSTOMER_FCC"), lambda rows: self._merged(rows, latest, epoch), f"batch {epoch}")
        touched = [r[0] for r in self.snapshot.log().filter(F.col("name") == f"batch {epoch}").select("bucket").collect()]
        self._recount(epoch, touched)

    def run(self, source_dir: str, schema: StructType, files_per_batch: int = 1) -> None:
        """Process the files that are there, in batches, and return."""
        events = (self.spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(source_dir)
                  .withColumn("event_time", F.col("EVENT_TS").cast("timestamp"))   # a watermark takes no TIMESTAMP_NTZ
                  .withWatermark("event_time", self.lateness).dropDuplicatesWithinWatermark(["EVENT_ID"]))
        conf = self.spark.conf
        saved = conf.get("spark.sql.shuffle.partitions")
        conf.set("spark.sql.shuffle.partitions", str(self.state_partitions))
        try:
            q = (events.writeStream.outputMode("append").option("checkpointLocation", f"{self.out_dir}/_checkpoint")
                 .foreachBatch(self.apply).trigger(availableNow=True).start())
            q.awaitTermination()
        finally:
            conf.set("spark.sql.shuffle.partitions", saved)

    def touched(self) -> DataFrame:
        """T1 result: the status columns of the profile rows that events have reached."""
        return self.snapshot.read().filter(F.col("LAST_EVENT_TS").isNotNull()).select(*KEPT, *SET)

    def profile(self) -> DataFrame:
        """The whole profile as of the last batch."""
        hit = self.touched().select(*[F.col(c).alias(f"__{c}") for c in KEY + SET], F.lit(True).alias("__hit"))
        j = self.base.join(hit, (F.col("ID_SOLICITUD") == F.col("__ID_SOLICITUD")) & (F.col("CUSTOMER_NO") == F.col("__CUSTOMER_NO")), "left")
        return j.select(*[F.when(F.col("__hit"), F.col(f"__{c}")).otherwise(F.col(c)).alias(c) if c in SET else F.col(c)
                          for c in self.base.columns])

    def counts(self) -> DataFrame:
        """T2 result: per application at the stage, the rows expected, created and failed."""
        return self.totals.read()
