"""The micro-batch workflow: replays, late corrections and the privacy-budget guard.

Each batch is decided against two state tables, what is known of each report and what each device has spent, and its
decisions are one table: accepted, rejected, duplicate or correction, for every event of the batch. Known reports are
narrow rows of all earlier decisions, of which only those of the batch's reports are looked at; spending has a row for
each device and is written anew. As a batch overwrites its own tables, a batch that runs again changes nothing.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewright import stage
from tidewright.operators import relations

#: Epsilon that a device may spend.
CAP = 60.0


def decide(batch: DataFrame, known: DataFrame | None, spent: DataFrame | None, watermark: int, cap: float) -> DataFrame:
    """Adds late_event, status and projected_epsilon_sum to the events of one batch.

    known: report_id, correction_version of what was accepted or corrected before, repeated ids allowed; spent:
    device_id, spent. Of events with one report_id in the batch only that of the highest version counts (of equal
    versions the one with the smallest ts and source_event_id), the others are duplicates. An event whose report is
    known with the same or a higher version is a duplicate, with a lower one a correction. The others are candidates:
    along ts and report_id, what a device has spent and all candidates so far, rejected ones too, must stay within the
    cap. Late events are marked, never dropped.
    """
    place = F.row_number().over(Window.partitionBy("report_id").orderBy(F.desc("correction_version"), "ts", "source_event_id"))
    rows = batch.withColumn("late_event", (F.col("ts") < watermark).cast("int")).withColumn("_first", place == 1)
    if known is None:
        rows = rows.withColumn("_known", F.lit(None).cast("int"))
    else:
        own = known.join(batch.select("report_id"), "report_id", "left_semi")
        rows = rows.join(own.groupBy("report_id").agg(F.max("correction_version").alias("_known")), "report_id", "left")
    if spent is None:
        rows = rows.withColumn("_spent", F.lit(0.0))
    else:
        rows = rows.join(spent.select("device_id", F.col("spent").alias("_spent")), "device_id", "left").fillna(0.0, ["_spent"])
    candidate = F.col("_known").isNull() & F.col("_first")
    # a device's events of one batch are one task's, as a batch is of bounded size
    order = Window.partitionBy("device_id").orderBy("ts", "report_id").rowsBetween(Window.unboundedPreceding, 0)
    asked = F.sum(F.when(candidate, F.col("epsilon"))).over(order)
    rows = rows.withColumn("projected_epsilon_sum", F.when(candidate, F.col("_spent") + asked))
    duplicate = ~F.col("_first") | (F.col("_known") >= F.col("correction_version"))
    status = F.when(duplicate, "duplicate").when(~candidate, "correction").when(F.col("projected_epsilon_sum") > cap, "rejected").otherwise("accepted")
    return rows.withColumn("status", status).drop("_known", "_spent", "_first")


def known_of(decisions: DataFrame) -> DataFrame:
    return decisions.where(F.col("status").isin("accepted", "correction")).select("report_id", "correction_version")


def spending(decisions: DataFrame, spent: DataFrame | None) -> DataFrame:
    """What each device has spent, with one batch's decisions added."""
    new = decisions.where("status = 'accepted' and correction_version = 0").groupBy("device_id").agg(F.sum("epsilon").alias("spent"))
    return new if spent is None else relations.upsert(spent, new, ["device_id"], ["spent"])


def run(batches: DataFrame, cap: float = CAP) -> DataFrame:
    """The decisions on all batches, in the order of batch_id.

    A batch reads its own rows only, and of the earlier decisions those batches whose range of report ids meets its own.
    """
    batches = stage.table(batches, "batches", by="batch_id")
    tables: list[tuple[int | None, int | None, DataFrame]] = []
    spent, watermark = None, -1
    bounds = batches.groupBy("batch_id").agg(F.max("ts"), F.min("report_id"), F.max("report_id")).orderBy("batch_id").collect()
    for number, latest, low, high in bounds:
        # a batch without ids meets none
        met = [known_of(d) for least, most, d in tables if low is not None and least is not None and least <= high and most >= low]
        known = reduce(DataFrame.unionByName, met).where(F.col("report_id").between(low, high)) if met else None
        decided = stage.table(decide(batches.where(F.col("batch_id") == number), known, spent, watermark, cap), "decisions")
        tables.append((low, high, decided))
        spent = stage.table(spending(decided, spent), "spent")
        watermark = max(watermark, latest)
    return reduce(DataFrame.unionByName, [d for _, _, d in tables])


def stream(spark: SparkSession, source: str, schema: str, folder: str, cap: float = CAP):
    """The same over a stream of Parquet files, one batch for each file in the order of their times.

    Decisions of epoch n go to folder/decisions/n, spending after it to folder/spent/n and the watermark to
    folder/watermark/n, which a repeated epoch overwrites; returns the running query.
    """

    def process(batch: DataFrame, epoch: int) -> None:
        own = batch.sparkSession
        known = spent = None
        watermark = -1
        if epoch:
            known = known_of(own.read.parquet(*[f"{folder}/decisions/{n}" for n in range(epoch)]))
            spent = own.read.parquet(f"{folder}/spent/{epoch - 1}")
            watermark = own.read.parquet(f"{folder}/watermark/{epoch - 1}").first()[0]
        decide(batch, known, spent, watermark, cap).write.mode("overwrite").parquet(f"{folder}/decisions/{epoch}")
        decided = own.read.parquet(f"{folder}/decisions/{epoch}")
        spending(decided, spent).write.mode("overwrite").parquet(f"{folder}/spent/{epoch}")
        decided.agg(F.greatest(F.max("ts"), F.lit(watermark)).alias("watermark")).write.mode("overwrite").parquet(f"{folder}/watermark/{epoch}")

    events = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
    return events.writeStream.foreachBatch(process).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()


def reports(decisions: DataFrame) -> DataFrame:
    """The reports in force: of each id the highest version, of equal versions the first batch."""
    kept = decisions.where(F.col("status").isin("accepted", "correction"))
    best = F.row_number().over(Window.partitionBy("report_id").orderBy(F.desc("correction_version"), "batch_id"))
    return kept.withColumn("_n", best).where("_n = 1").drop("_n")


def rejected(decisions: DataFrame) -> DataFrame:
    rows = decisions.where("status = 'rejected'")
    return rows.select("batch_id", "source_event_id", "report_id", "device_id", "ts", "epsilon", "projected_epsilon_sum", F.lit("device_budget_guard").alias("reason"))


def manifest(decisions: DataFrame) -> DataFrame:
    """A row for each batch; the window over it has as many rows as there are batches."""
    count = lambda s: F.count_if(F.col("status") == s)
    rows = decisions.groupBy("batch_id", "batch_kind").agg(
        F.count("*").alias("input_events"), count("accepted").alias("accepted_new_events"), count("duplicate").alias("duplicate_events"), count("correction").alias("correction_events"),
        count("rejected").alias("rejected_budget_events"), F.count_if(F.col("late_event") == 1).alias("late_events"), F.max("ts").alias("latest"),
    )
    order = Window.orderBy("batch_id")
    after = F.greatest(F.lit(-1), F.max("latest").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    before = F.coalesce(F.greatest(F.lit(-1), F.max("latest").over(order.rowsBetween(Window.unboundedPreceding, -1))), F.lit(-1))
    return rows.withColumn("watermark_before", before).withColumn("watermark_after", after).drop("latest")


def budget_state(decisions: DataFrame, cap: float = CAP) -> DataFrame:
    spent = (F.col("status") == "accepted") & (F.col("correction_version") == 0)
    total = F.coalesce(F.sum(F.when(spent, F.col("epsilon"))), F.lit(0.0))
    return decisions.groupBy("device_id").agg(F.count_if(spent).alias("accepted_reports"), total.alias("epsilon_sum"), F.lit(cap).alias("device_budget"), (F.lit(cap) - total).alias("remaining_budget"))


def cleaning(found: DataFrame) -> DataFrame:
    return relations.cleaning(found, "router_v2")


def provenance(found: DataFrame, cleaned: DataFrame) -> DataFrame:
    rows = found.select("report_id", "source_event_id", "mechanism_id", "calibration_version", "batch_id").join(cleaned.select("report_id", "operator", "correction_version"), "report_id")
    return rows.select(F.col("report_id").alias("output_report_id"), F.lit("reports").alias("source_table"), F.col("source_event_id").alias("source_key"), F.col("operator").alias("transform"), "mechanism_id", "calibration_version", "batch_id", "correction_version")


def checks(decisions: DataFrame, cap: float = CAP) -> DataFrame:
    """Invariants of the workflow: name, observed, expected, status; one row each, all by one aggregate a relation."""
    found = reports(decisions)
    per_report = found.groupBy("report_id").agg(F.count("*").alias("n")).agg(F.count_if(F.col("n") > 1).alias("repeated"), F.count("*").alias("reports"))
    cleaned = cleaning(found)
    rows = [
        per_report.select(F.lit("unique_report_ids").alias("name"), F.col("repeated").alias("observed"), F.lit(0).cast("long").alias("expected")),
        cleaned.join(found.select("report_id"), "report_id", "left_anti").agg(F.count("*").alias("observed")).select(F.lit("cleaning_without_report").alias("name"), "observed", F.lit(0).cast("long").alias("expected")),
        budget_state(decisions, cap).agg(F.count_if(F.col("epsilon_sum") > cap).alias("observed")).select(F.lit("devices_over_cap").alias("name"), "observed", F.lit(0).cast("long").alias("expected")),
        decisions.where("batch_kind like 'replay%'").agg(F.count_if(F.col("status") == "accepted").alias("observed")).select(F.lit("replay_inserts").alias("name"), "observed", F.lit(0).cast("long").alias("expected")),
        found.where("correction_version > 0").agg(F.count_if(~F.col("source_event_id").startswith("corr-")).alias("observed")).select(F.lit("correction_lineage").alias("name"), "observed", F.lit(0).cast("long").alias("expected")),
        decisions.agg(F.count_if(F.col("status").isNull()).alias("observed")).select(F.lit("undecided_events").alias("name"), "observed", F.lit(0).cast("long").alias("expected")),
    ]
    return reduce(DataFrame.unionByName, rows).withColumn("status", F.when(F.col("observed") == F.col("expected"), "pass").otherwise("fail"))
