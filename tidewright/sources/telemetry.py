"""Private reports and their dimensions: views of the events table, channel weights, router policy, micro-batches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKETS = 32
EPSILONS = (0.5, 1.0, 2.0)
MECHANISM, CALIBRATION = "pm32", "cal_v1"
#: operator, semantic layer, output relation, privacy effect; the last is the workflow's only
POLICY = (
    ("stuck_mixture", "iid stuck-at", "cleaning_records", "post_processing"),
    ("stuck_hmm", "persistent flatline", "cleaning_records", "post_processing"),
    ("window_glr", "field-QC local regime", "cleaning_records", "post_processing"),
    ("dropout_hmm", "explicit availability", "cleaning_records", "post_processing"),
)
#: Base batches, those that are sent again (and after which), and the share of early reports that is corrected.
BATCHES, REPLAYED, CORRECTED = 10, ((3, 3), (6, 9)), 97


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def reports(events: DataFrame, *more: str) -> DataFrame:
    """A report for each event: the device is the user, ts whole hours since 2024-01-01, value the bucket. The event's
    columns named in `more` come along."""
    epsilon = F.element_at(F.array(*map(F.lit, EPSILONS)), ((F.col("user_id") + F.col("event_id")) % 3 + 1).cast("int"))
    return events.select(
        F.col("event_id").alias("report_id"),
        F.col("user_id").cast("int").alias("device_id"),
        F.floor(F.unix_timestamp(F.col("ts").cast("timestamp")) / 3600 - 473352).cast("int").alias("ts"),
        F.least(F.lit(BUCKETS - 1), F.floor(F.col("value") / F.lit(7.0))).cast("int").alias("report_bucket"),
        epsilon.alias("epsilon"),
        F.lit(MECHANISM).alias("mechanism_id"),
        F.lit(CALIBRATION).alias("calibration_version"),
        *more,
    )


def make_reports(spark: SparkSession, rows: int, devices: int, seed: int = 1) -> DataFrame:
    """Synthetic reports of any number, for load tests: buckets by a hash of the id and the seed."""
    ids = spark.range(rows).withColumnRenamed("id", "report_id")
    epsilon = F.element_at(F.array(*map(F.lit, EPSILONS)), ((F.col("device_id") + F.col("report_id")) % 3 + 1).cast("int"))
    return ids.select(
        "report_id",
        (F.col("report_id") % devices).cast("int").alias("device_id"),
        F.floor(F.col("report_id") / devices).cast("int").alias("ts"),
        F.pmod(F.xxhash64("report_id", F.lit(seed)), F.lit(BUCKETS)).cast("int").alias("report_bucket"),
    ).select("*", epsilon.alias("epsilon"), F.lit(MECHANISM).alias("mechanism_id"), F.lit(CALIBRATION).alias("calibration_version"))


def mechanism_weights(spark: SparkSession) -> DataFrame:
    """Log-likelihoods of a report bucket when normal and when stuck at a bucket: 3 x 32 x 32 rows, whatever the data."""
    grid = spark.range(len(EPSILONS) * BUCKETS * BUCKETS, numPartitions=1)
    epsilon = F.element_at(F.array(*map(F.lit, EPSILONS)), (F.col("id") / (BUCKETS * BUCKETS)).cast("int") + 1)
    grid = grid.select(epsilon.alias("epsilon"), ((F.col("id") / BUCKETS).cast("int") % BUCKETS).alias("report_bucket"), (F.col("id") % BUCKETS).cast("int").alias("stuck_bucket"))
    distance = F.abs(F.col("report_bucket") - F.col("stuck_bucket"))
    fault = F.log(F.lit(0.002) + F.lit(0.55) * F.exp(-F.col("epsilon") * distance / F.lit(8.0)))
    return grid.select(F.lit(MECHANISM).alias("mechanism_id"), "epsilon", "report_bucket", "stuck_bucket", F.log(F.lit(1.0 / BUCKETS)).alias("logp_normal"), fault.alias("logp_fault"))


def router_policy(spark: SparkSession, workflow: bool = False) -> DataFrame:
    return spark.createDataFrame(list(POLICY if workflow else POLICY[:3]), "operator string, semantic_layer string, output_relation string, privacy_effect string")


def micro_batches(found: DataFrame) -> DataFrame:
    """The reports as a stream of numbered batches, with two that come again and corrections of early reports last.

    Adds source_event_id, batch_id, batch_kind and correction_version. Base batches are cut by report_id; batch
    numbers are their places in the order of arrival.
    """
    last = found.agg(F.max("report_id").alias("last"))
    size = F.ceil((F.col("last") + 1) / BATCHES)
    base = found.crossJoin(F.broadcast(last)).withColumn("base", F.floor(F.col("report_id") / size))
    arrival: Column = F.col("base")
    for _, after in REPLAYED:
        arrival = arrival + F.when(F.col("base") > after, 1).otherwise(0)
    event = F.concat(F.lit("evt-"), F.col("report_id"))
    columns = [c for c in found.columns]
    out = base.select(*columns, event.alias("source_event_id"), arrival.cast("int").alias("batch_id"), F.lit("base").alias("batch_kind"), F.lit(0).alias("correction_version"))
    for k, (again, after) in enumerate(REPLAYED):
        copy = base.where(F.col("base") == again)
        out = out.unionByName(copy.select(*columns, event.alias("source_event_id"), F.lit(after + k + 1).alias("batch_id"), F.lit(f"replay_batch_{again}").alias("batch_kind"), F.lit(0).alias("correction_version")))
    early = base.where((F.col("report_id") % CORRECTED == 0) & (F.col("report_id") * 3 < F.col("last") + 1))
    early = early.withColumn("ts", F.greatest(F.lit(0), F.col("ts") - 7)).withColumn("report_bucket", (F.col("report_bucket") + 11) % BUCKETS)
    return out.unionByName(early.select(*columns, F.concat(F.lit("corr-"), F.col("report_id")).alias("source_event_id"), F.lit(BATCHES + len(REPLAYED)).alias("batch_id"), F.lit("late_corrections").alias("batch_kind"), F.lit(1).alias("correction_version")))
