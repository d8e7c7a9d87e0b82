"""The relations of the telemetry pipeline: counts, likelihoods, cleaning, provenance, ledger, trace, windows.

Every relation is a function of DataFrames, so that Catalyst sees whole queries. Dimensions of a fixed size (the
channel weights, the policy) are broadcast; everything else is joined and grouped on its keys.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUDGET = 1000.0
KEYS = ["mechanism_id", "epsilon", "report_bucket"]
#: Ticks of an hour window.
HOUR = 60


def decode(bucket: str = "report_bucket") -> Column:
    return F.lit(2.0) * F.col(bucket) / F.lit(31.0) - F.lit(1.0)


def hour(ts: str = "ts") -> Column:
    return F.floor(F.col(ts) / HOUR)


def posterior() -> Column:
    """A stand-in for inference, by arithmetic on bucket, device and correction."""
    mixed = F.col("report_bucket") * 17 + F.col("device_id") + F.col("correction_version") * 13
    return (mixed % 100) / F.lit(100.0)


def report_counts(reports: DataFrame) -> DataFrame:
    return reports.groupBy(*KEYS).agg(F.count("*").alias("n"))


def likelihoods_base(reports: DataFrame, weights: DataFrame) -> DataFrame:
    """From each report: 32 rows for each before they are summed."""
    joined = reports.join(F.broadcast(weights), KEYS)
    return joined.groupBy("mechanism_id", "epsilon", "stuck_bucket").agg(F.sum("logp_fault").alias("fault_loglik"), F.sum("logp_normal").alias("normal_loglik"), F.sum(F.col("logp_fault") - F.col("logp_normal")).alias("llr"))


def likelihoods(counts: DataFrame, weights: DataFrame) -> DataFrame:
    """From counts: the aggregate is below the join, so only a row for each key meets the weights."""
    joined = counts.join(F.broadcast(weights), KEYS)
    n = F.col("n")
    return joined.groupBy("mechanism_id", "epsilon", "stuck_bucket").agg(F.sum(n * F.col("logp_fault")).alias("fault_loglik"), F.sum(n * F.col("logp_normal")).alias("normal_loglik"), F.sum(n * (F.col("logp_fault") - F.col("logp_normal"))).alias("llr"))


def cleaning(reports: DataFrame, version: str = "router_v1") -> DataFrame:
    if "correction_version" not in reports.columns:
        reports = reports.withColumn("correction_version", F.lit(0))
    p = F.col("posterior")
    return reports.withColumn("posterior", posterior()).select(
        "report_id",
        "device_id",
        "ts",
        F.when(p >= 0.80, "stuck_hmm").when(p >= 0.65, "window_glr").otherwise("stuck_mixture").alias("operator"),
        "posterior",
        F.when(p >= 0.65, F.col("report_bucket")).alias("stuck_bucket"),
        F.lit(0.2).alias("fault_ratio"),
        F.when(p >= 0.80, "repair").when(p >= 0.65, "flag").otherwise("pass").alias("action"),
        decode().alias("repair_value"),
        F.lit(version).alias("provenance_version"),
        "correction_version",
    )


def provenance(cleaned: DataFrame) -> DataFrame:
    return cleaned.select(F.col("report_id").alias("output_report_id"), F.lit("reports").alias("source_table"), F.col("report_id").alias("source_key"), F.col("operator").alias("transform"), F.lit("pm32").alias("mechanism_id"), F.lit("cal_v1").alias("calibration_version"))


def ledger(reports: DataFrame, budget: float = BUDGET) -> DataFrame:
    spent = F.sum("epsilon")
    return reports.groupBy("device_id").agg(F.count("*").alias("reports"), spent.alias("epsilon_sum"), F.lit(budget).alias("device_budget"), (F.lit(budget) - spent).alias("remaining_budget"))


def running_sum(rows: DataFrame, key: str, block: Column, order: list[str], value: str, name: str) -> DataFrame:
    """Running sum of value within key along order, in blocks that follow the order, so that a hot key takes many tasks.

    Within a block rows are summed by a window; what stands before it comes from the blocks' own sums, a row for
    each, which partly happen before the shuffle.
    """
    rows = rows.withColumn("_block", block)
    sums = rows.groupBy(key, "_block").agg(F.sum(value).alias("_sum"))
    before = Window.partitionBy(key).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(key, "_block", F.coalesce(F.sum("_sum").over(before), F.lit(0.0)).alias("_before"))
    inside = Window.partitionBy(key, "_block").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("_inside", F.sum(value).over(inside)).join(sums, [key, "_block"]).withColumn(name, F.col("_before") + F.col("_inside")).drop("_block", "_inside", "_before")


def budget_trace(reports: DataFrame, budget: float = BUDGET) -> DataFrame:
    rows = reports.select("report_id", "device_id", "ts", "epsilon")
    rows = running_sum(rows, "device_id", hour(), ["ts", "report_id"], "epsilon", "cumulative_epsilon")
    return rows.select("report_id", "device_id", "ts", "epsilon", "cumulative_epsilon", (F.lit(budget) - F.col("cumulative_epsilon")).alias("remaining_budget"))


def hourly(reports: DataFrame, cleaned: DataFrame) -> DataFrame:
    value = F.when(F.col("action") == "repair", F.col("repair_value")).otherwise(decode())
    joined = reports.select("report_id", "device_id", "ts", "report_bucket").join(cleaned.select("report_id", "posterior", "action", "repair_value"), "report_id")
    return joined.groupBy("device_id", hour().alias("hour_id")).agg(F.count("*").alias("reports"), F.avg("posterior").alias("avg_fault_posterior"), F.count_if(F.col("action") == "repair").alias("repaired_reports"), F.avg(value).alias("cleaned_mean"))


def event_windows(cleaned: DataFrame, policy: DataFrame, least: int = 2) -> DataFrame:
    rows = cleaned.where(F.col("action").isin("flag", "repair")).join(F.broadcast(policy), "operator")
    layers = F.array_join(F.array_sort(F.collect_set("semantic_layer")), ",")  # as many as the policy has
    return rows.groupBy("device_id", hour().alias("hour_id")).agg(F.min("ts").alias("start_ts"), F.max("ts").alias("end_ts"), F.count("*").alias("flagged_reports"), F.avg("posterior").alias("avg_posterior"), layers.alias("routed_semantics")).where(F.col("flagged_reports") >= least)


def event_windows_workflow(cleaned: DataFrame) -> DataFrame:
    flagged = F.col("action").isin("flag", "repair")
    return cleaned.groupBy("device_id", hour().alias("hour_id")).agg(F.count("*").alias("reports"), F.count_if(flagged).alias("flagged_reports"), F.avg("posterior").alias("avg_posterior"), F.max("posterior").alias("max_posterior")).where("flagged_reports > 0")


def repair_analytics(reports: DataFrame, cleaned: DataFrame) -> DataFrame:
    value = F.when(F.col("action") == "repair", F.col("repair_value")).otherwise(decode())
    joined = reports.select("report_id", "device_id", "ts", "report_bucket").join(cleaned.select("report_id", "posterior", "action", "repair_value"), "report_id")
    p = F.col("posterior")
    return joined.groupBy("device_id", hour().alias("hour_id")).agg(F.count("*").alias("reports"), F.avg(value).alias("cleaned_mean"), F.avg(decode()).alias("unrepaired_mean"), F.avg(p * (F.lit(1.0) - p)).alias("uncertainty_proxy"), F.count_if(F.col("action") == "repair").alias("repair_count"))


def partial_sums(reports: DataFrame, cleaned: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What the incremental design maintains instead of means: sums of repairs and of events by device and hour."""
    value = F.when(F.col("action") == "repair", F.col("repair_value")).otherwise(decode())
    p = F.col("posterior")
    joined = reports.select("report_id", "device_id", "ts", "report_bucket").join(cleaned.select("report_id", "posterior", "action", "repair_value"), "report_id")
    repairs = joined.groupBy("device_id", hour().alias("hour_id")).agg(F.count("*").alias("reports"), F.sum(value).alias("cleaned_sum"), F.sum(decode()).alias("raw_sum"), F.sum(p * (F.lit(1.0) - p)).alias("uncertainty_sum"), F.count_if(F.col("action") == "repair").alias("repair_count"))
    flagged = cleaned.where(F.col("action").isin("flag", "repair"))
    events = flagged.groupBy("device_id", hour().alias("hour_id")).agg(F.min("ts").alias("start_ts"), F.max("ts").alias("end_ts"), F.count("*").alias("flagged_reports"), F.sum("posterior").alias("posterior_sum"))
    return repairs, events


def upsert(state: DataFrame, delta: DataFrame, key: list[str], sums: list[str], least: list[str] = (), most: list[str] = ()) -> DataFrame:
    """State with a delta added to it by key: sums add up, bounds widen."""
    both = state.unionByName(delta)
    return both.groupBy(*key).agg(*[F.sum(c).alias(c) for c in sums], *[F.min(c).alias(c) for c in least], *[F.max(c).alias(c) for c in most])


def replace(state: DataFrame, rows: DataFrame, key: list[str]) -> DataFrame:
    """State with rows instead of those that have the same key."""
    return state.join(rows.select(*key).distinct(), key, "left_anti").unionByName(rows)
