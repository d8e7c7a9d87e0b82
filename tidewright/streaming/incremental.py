"""Aggregates maintained over a stream of reports: counts, ledger, repair sums, event bounds, device histograms."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewright.operators import relations

REPORTS = "report_id long, device_id int, ts int, report_bucket int, epsilon double, mechanism_id string, calibration_version string"


def source(spark: SparkSession, path: str, files: int = 1) -> DataFrame:
    return spark.readStream.schema(REPORTS).option("maxFilesPerTrigger", files).parquet(path)


def counts(stream: DataFrame) -> DataFrame:
    return relations.report_counts(stream)


def ledger(stream: DataFrame, budget: float = relations.BUDGET) -> DataFrame:
    return relations.ledger(stream, budget)


def device_counts(stream: DataFrame) -> DataFrame:
    return stream.groupBy("device_id", "report_bucket").agg(F.count("*").alias("n"))


def repair_sums(stream: DataFrame) -> DataFrame:
    """Cleaning is a projection of a report, so its sums need no join of streams."""
    p, value = relations.posterior(), relations.decode()
    rows = stream.withColumn("correction_version", F.lit(0)).withColumn("p", p).withColumn("value", value)
    return rows.groupBy("device_id", relations.hour().alias("hour_id")).agg(F.count("*").alias("reports"), F.sum("value").alias("cleaned_sum"), F.sum("value").alias("raw_sum"), F.sum(F.col("p") * (F.lit(1.0) - F.col("p"))).alias("uncertainty_sum"), F.count_if(F.col("p") >= 0.8).alias("repair_count"))


def event_bounds(stream: DataFrame) -> DataFrame:
    rows = stream.withColumn("correction_version", F.lit(0)).withColumn("p", relations.posterior()).where("p >= 0.65")
    return rows.groupBy("device_id", relations.hour().alias("hour_id")).agg(F.min("ts").alias("start_ts"), F.max("ts").alias("end_ts"), F.count("*").alias("flagged_reports"), F.sum("p").alias("posterior_sum"))


def maintain(aggregate: DataFrame, folder: str):
    """Runs a streaming aggregate to the end of its source; folder/state/n has the whole state after epoch n."""

    def store(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/state/{epoch}")

    return aggregate.writeStream.outputMode("complete").foreachBatch(store).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
