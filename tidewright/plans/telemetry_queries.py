"""The telemetry pipeline's named queries: its stages, the query suite, the physical designs, the workflow."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewright import stage
from tidewright.operators import relations as R
from tidewright.sources import telemetry as S
from tidewright.streaming import workflow as W

Query = Callable[[SparkSession, str], DataFrame]
#: Remaining budget under which a device is near its cap; the workflow's bands.
NEAR_CAP, BANDS = 925.0, (5.0, 25.0)
#: Digits of means (exact fractions, so six would often be a tie) and of sums of logarithms.
DIGITS, LOG_DIGITS = 9, 6
LOGS = ("fault_loglik", "normal_loglik", "llr")


def rounded(df: DataFrame) -> DataFrame:
    return df.select(*[F.round(c, LOG_DIGITS if c in LOGS else DIGITS).alias(c) if kind == "double" else F.col(c) for c, kind in df.dtypes])


class Relations:
    """The base relations over one folder; each is a plan, nothing runs before a query does."""

    def __init__(self, spark: SparkSession, sf_dir: str, reports: DataFrame | None = None):
        self.spark = spark
        self.reports = S.reports(S.table(spark, sf_dir, "events")) if reports is None else reports
        self.weights, self.policy = S.mechanism_weights(spark), S.router_policy(spark)
        self.counts = R.report_counts(self.reports)
        self.likelihoods = R.likelihoods(self.counts, self.weights)
        self.cleaned = R.cleaning(self.reports).drop("correction_version")
        self.provenance = R.provenance(self.cleaned)
        self.ledger, self.trace = R.ledger(self.reports), R.budget_trace(self.reports)
        self.hourly = R.hourly(self.reports, self.cleaned)
        self.events, self.repairs = R.event_windows(self.cleaned, self.policy), R.repair_analytics(self.reports, self.cleaned)


def topk(rows: DataFrame, n: int) -> DataFrame:
    return rows.select("epsilon", "stuck_bucket", "llr").orderBy(F.desc(F.round("llr", LOG_DIGITS)), "epsilon", "stuck_bucket").limit(n)


def budget_audit(rows: DataFrame, name: str = "reports") -> DataFrame:
    return rows.agg(F.count("*").alias(name), F.min("remaining_budget").alias("min_remaining_budget"), F.avg("remaining_budget").alias("avg_remaining_budget"))


def repair_dashboard(repairs: DataFrame) -> DataFrame:
    return repairs.groupBy("device_id").agg(F.count("*").alias("hourly_groups"), F.avg("cleaned_mean").alias("avg_cleaned_mean"), F.sum("repair_count").alias("repaired_reports"), F.avg("uncertainty_proxy").alias("avg_uncertainty_proxy"))


def event_drilldown(r: Relations) -> DataFrame:
    rows = r.events.join(r.repairs.drop("reports"), ["device_id", "hour_id"]).join(r.ledger.select("device_id", "remaining_budget"), "device_id").where("avg_posterior >= 0.72D")
    rows = rows.select("device_id", "hour_id", "flagged_reports", "avg_posterior", "cleaned_mean", "uncertainty_proxy", "remaining_budget")
    return rows.orderBy(F.desc("flagged_reports"), F.desc(F.round("avg_posterior", DIGITS)), "device_id", "hour_id").limit(100)


def dashboard(repairs: DataFrame, ledger: DataFrame, events: DataFrame, repaired: bool = False) -> DataFrame:
    band = F.when(F.col("remaining_budget") < NEAR_CAP, "near_cap").otherwise("ok")
    rows = repairs.join(ledger.select("device_id", "remaining_budget"), "device_id").join(events.select("device_id", "hour_id", "flagged_reports"), ["device_id", "hour_id"], "left")
    out = [F.count("*").alias("hourly_groups"), F.sum(F.coalesce("flagged_reports", F.lit(0))).alias("flagged_reports"), F.avg("cleaned_mean").alias("avg_cleaned_mean"), F.avg("uncertainty_proxy").alias("avg_uncertainty_proxy")]
    return rows.groupBy(band.alias("budget_band")).agg(*out, *([F.sum("repair_count").alias("repair_count")] if repaired else []))


def provenance_drilldown(r: Relations) -> DataFrame:
    rows = r.cleaned.where(F.col("action").isin("flag", "repair")).select("report_id", "operator", "posterior", "stuck_bucket").join(r.reports, "report_id")
    rows = rows.join(r.provenance.select(F.col("output_report_id").alias("report_id"), "transform"), "report_id").withColumn("stuck_bucket", F.coalesce("stuck_bucket", "report_bucket"))
    rows = rows.join(F.broadcast(r.weights), [*R.KEYS, "stuck_bucket"]).withColumn("llr_component", F.col("logp_fault") - F.col("logp_normal"))
    return rows.select("report_id", "device_id", "ts", "operator", "posterior", "transform", "llr_component").orderBy(F.desc("posterior"), F.desc("ts"), "report_id").limit(100)


def lineage_drilldown(r: Relations) -> DataFrame:
    rows = r.cleaned.join(r.reports.select("report_id", "report_bucket"), "report_id").join(r.provenance.select(F.col("output_report_id").alias("report_id"), "transform"), "report_id")
    return rows.select("report_id", "device_id", "ts", "report_bucket", "operator", "posterior", "transform").orderBy(F.desc("posterior"), "report_id").limit(100)


def designs(query: str) -> dict[str, Query]:
    """One of the four queries of the physical-design study in each of its designs."""

    def indexed(spark: SparkSession, sf_dir: str) -> DataFrame:
        """Over reports that are written once in the order of device and time: files have narrow ranges of both."""
        base = Relations(spark, sf_dir).reports
        ordered = stage.table(base.repartitionByRange("device_id", "ts").sortWithinPartitions("device_id", "ts", "report_id"), "ordered-reports")
        return over_relations(Relations(spark, sf_dir, ordered))

    def direct(spark: SparkSession, sf_dir: str) -> DataFrame:
        return over_relations(Relations(spark, sf_dir))

    def over_relations(r: Relations) -> DataFrame:
        if query == "candidate_likelihood_topk":
            return R.likelihoods_base(r.reports, r.weights).orderBy(F.desc(F.round("llr", LOG_DIGITS)), "epsilon", "stuck_bucket").limit(96)
        if query == "privacy_budget_accounting":
            return budget_audit(r.trace)
        return dashboard(r.repairs, r.ledger, r.events, True) if query == "uncertainty_privacy_dashboard" else provenance_drilldown(r)

    def materialized(spark: SparkSession, sf_dir: str) -> DataFrame:
        r = Relations(spark, sf_dir)
        if query == "candidate_likelihood_topk":
            return stage.table(r.likelihoods, "likelihoods").orderBy(F.desc(F.round("llr", LOG_DIGITS)), "epsilon", "stuck_bucket").limit(96)
        if query == "privacy_budget_accounting":
            return budget_audit(stage.table(r.trace, "trace").where("remaining_budget < 1000.0D"))
        if query == "uncertainty_privacy_dashboard":
            return dashboard(stage.table(r.repairs, "repairs"), stage.table(r.ledger, "ledger"), stage.table(r.events, "events"), True)
        r.cleaned = stage.table(r.cleaned, "cleaned")
        r.provenance = R.provenance(r.cleaned)
        return provenance_drilldown(r)

    def incremental(spark: SparkSession, sf_dir: str) -> DataFrame:
        """State made of two halves that are merged, as a maintained view is with a delta."""
        r = Relations(spark, sf_dir)
        old, new = r.reports.where("report_id % 2 = 0"), r.reports.where("report_id % 2 = 1")
        if query == "candidate_likelihood_topk":
            counts = R.upsert(R.report_counts(old), R.report_counts(new), R.KEYS, ["n"])
            return R.likelihoods(counts, r.weights).orderBy(F.desc(F.round("llr", LOG_DIGITS)), "epsilon", "stuck_bucket").limit(96)
        ledger = R.upsert(R.ledger(old).select("device_id", "reports", "epsilon_sum"), R.ledger(new).select("device_id", "reports", "epsilon_sum"), ["device_id"], ["reports", "epsilon_sum"])
        ledger = ledger.withColumn("remaining_budget", F.lit(R.BUDGET) - F.col("epsilon_sum"))
        if query == "privacy_budget_accounting":
            return budget_audit(ledger.where("remaining_budget < 1000.0D"), "devices")
        if query == "provenance_event_drilldown":
            half = stage.table(R.cleaning(old).drop("correction_version"), "cleaned").unionByName(stage.table(R.cleaning(new).drop("correction_version"), "cleaned"))
            r.cleaned, r.provenance = half, R.provenance(half)
            return provenance_drilldown(r)
        (repairs, events), (more, later) = (R.partial_sums(x, R.cleaning(x)) for x in (old, new))
        repairs = R.upsert(repairs, more, ["device_id", "hour_id"], ["reports", "cleaned_sum", "uncertainty_sum", "repair_count"])
        events = R.upsert(events, later, ["device_id", "hour_id"], ["flagged_reports", "posterior_sum"], ["start_ts"], ["end_ts"]).where("flagged_reports >= 2")
        means = repairs.select("device_id", "hour_id", (F.col("cleaned_sum") / F.col("reports")).alias("cleaned_mean"), (F.col("uncertainty_sum") / F.col("reports")).alias("uncertainty_proxy"), "repair_count")
        return dashboard(means, ledger, events, True)

    forms = {"heap": direct, "indexed": indexed, "materialized_batch": materialized, "incremental_mv": incremental}
    return {f"pd_{query}_{name}": (lambda spark, d, f=f: rounded(f(spark, d))) for name, f in forms.items()}


def over(build: Callable[[Relations], DataFrame]) -> Query:
    return lambda spark, sf_dir: rounded(build(Relations(spark, sf_dir)))


def over_workflow(build: Callable[[DataFrame], DataFrame]) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        batches = S.micro_batches(S.reports(S.table(spark, sf_dir, "events")))
        return rounded(build(W.run(batches)))

    return run


def correction_lineage(d: DataFrame) -> DataFrame:
    found = W.reports(d)
    cleaned = W.cleaning(found)
    rows = found.where("correction_version > 0 and late_event = 1").select("report_id", "device_id", "ts", "report_bucket")
    rows = rows.join(cleaned.select("report_id", "operator", "posterior"), "report_id").join(W.provenance(found, cleaned).select(F.col("output_report_id").alias("report_id"), "source_key", "batch_id"), "report_id")
    return rows.orderBy(F.desc("posterior"), "report_id").limit(50)


def rejected_drilldown(d: DataFrame) -> DataFrame:
    rows = W.rejected(d).groupBy("device_id").agg(F.count("*").alias("rejected"), F.min("ts").alias("first_rejected_ts"), F.max("projected_epsilon_sum").alias("max_projected"))
    return rows.orderBy(F.desc("rejected"), "device_id").limit(20)


def device_trace(d: DataFrame) -> DataFrame:
    rows = R.budget_trace(W.reports(d), W.CAP).groupBy("device_id").agg(F.min("remaining_budget").alias("min_remaining_budget"), F.max("cumulative_epsilon").alias("max_cumulative_epsilon"), F.count("*").alias("reports"))
    return rows.orderBy("min_remaining_budget", "device_id").limit(20)


def event_uncertainty(d: DataFrame) -> DataFrame:
    found = W.reports(d)
    cleaned = W.cleaning(found)
    rows = R.event_windows_workflow(cleaned).drop("reports").join(R.repair_analytics(found, cleaned), ["device_id", "hour_id"]).where("flagged_reports >= 3")
    return rows.select("device_id", "hour_id", "flagged_reports", "avg_posterior", "cleaned_mean", "uncertainty_proxy").orderBy(F.desc("flagged_reports"), F.desc(F.round("avg_posterior", DIGITS)), "device_id", "hour_id").limit(100)


def workflow_dashboard(d: DataFrame) -> DataFrame:
    found = W.reports(d)
    cleaned = W.cleaning(found)
    band: Column = F.when(F.col("remaining_budget") < BANDS[0], "near_cap").when(F.col("remaining_budget") < BANDS[1], "low").otherwise("ok")
    rows = R.repair_analytics(found, cleaned).join(W.budget_state(d).select("device_id", "remaining_budget"), "device_id")
    rows = rows.join(R.event_windows_workflow(cleaned).select("device_id", "hour_id", "flagged_reports"), ["device_id", "hour_id"], "left")
    return rows.groupBy(band.alias("budget_band")).agg(F.countDistinct("device_id").alias("devices"), F.count("*").alias("hourly_groups"), F.sum(F.coalesce("flagged_reports", F.lit(0))).alias("flagged_reports"), F.avg("cleaned_mean").alias("avg_cleaned_mean"), F.avg("uncertainty_proxy").alias("avg_uncertainty"))


def recovery_dashboard(r: Relations) -> DataFrame:
    rows = r.ledger.select("device_id", "remaining_budget").join(r.repairs.select("device_id", "cleaned_mean", "repair_count"), "device_id", "left")
    rows = rows.groupBy("device_id", "remaining_budget").agg(F.count("cleaned_mean").alias("hourly_groups"), F.avg("cleaned_mean").alias("avg_cleaned_mean"), F.coalesce(F.sum("repair_count"), F.lit(0)).alias("repairs"))
    return rows.orderBy("remaining_budget", "device_id").limit(100)


SUITE: dict[str, Callable[[Relations], DataFrame]] = {
    "candidate_likelihood_base": lambda r: R.likelihoods_base(r.reports, r.weights),
    "candidate_likelihood_counts": lambda r: r.likelihoods,
    "candidate_topk": lambda r: topk(r.likelihoods, 10),
    "privacy_budget_window_base": lambda r: budget_audit(r.trace),
    "privacy_budget_trace_audit": lambda r: budget_audit(r.trace.where("remaining_budget < 1000.0D")),
    "repair_aggregate": lambda r: r.repairs,
    "repair_dashboard": lambda r: repair_dashboard(r.repairs),
    "provenance_event_drilldown": event_drilldown,
    "end_to_end_dashboard": lambda r: dashboard(r.repairs, r.ledger, r.events),
}
STAGES: dict[str, Callable[[Relations], DataFrame]] = {
    "reports": lambda r: r.reports,
    "report_counts": lambda r: r.counts,
    "cleaning_records": lambda r: r.cleaned,
    "provenance_edges": lambda r: r.provenance,
    "privacy_ledger": lambda r: r.ledger,
    "privacy_budget_trace": lambda r: r.trace,
    "hourly_cleaned_analytics": lambda r: r.hourly,
    "cleaned_event_windows": lambda r: r.events,
    "repair_uncertainty_analytics": lambda r: r.repairs,
    "lineage_drilldown": lineage_drilldown,
}
WORKFLOW: dict[str, Callable[[DataFrame], DataFrame]] = {
    "replay_audit": lambda d: W.manifest(d).groupBy("batch_kind").agg(*[F.sum(c).alias(c) for c in ("input_events", "accepted_new_events", "duplicate_events", "rejected_budget_events")]),
    "budget_dashboard": lambda d: W.budget_state(d).agg(F.count("*").alias("devices"), F.min("remaining_budget").alias("min_remaining_budget"), F.avg("remaining_budget").alias("avg_remaining_budget"), F.count_if(F.col("remaining_budget") < BANDS[0]).alias("near_cap_devices")),
    "rejected_drilldown": rejected_drilldown,
    "correction_lineage": correction_lineage,
    "candidate_top20": lambda d: topk(R.likelihoods(R.report_counts(W.reports(d)), S.mechanism_weights(d.sparkSession)), 20),
    "device_trace": device_trace,
    "event_uncertainty": event_uncertainty,
    "dashboard": workflow_dashboard,
    "manifest": W.manifest,
    "checks": W.checks,
}
READERS: dict[str, Callable[[Relations], DataFrame]] = {
    "range_count": lambda r: r.reports.where(F.col("ts").between(100, 400)).groupBy("device_id").agg(F.count("*").alias("reports"), F.avg("report_bucket").alias("avg_bucket")),
    "recovery_dashboard": recovery_dashboard,
}
STUDY = ("candidate_likelihood_topk", "privacy_budget_accounting", "uncertainty_privacy_dashboard", "provenance_event_drilldown")

QUERIES: dict[str, Query] = {
    "candidate_likelihood_topk": over(lambda r: topk(r.likelihoods, 96)),
    **{f"qs{i}_{name}": over(build) for i, (name, build) in enumerate(SUITE.items(), 1)},
    **{f"ps_{name}": over(build) for name, build in STAGES.items()},
    **{key: query for name in STUDY for key, query in designs(name).items()},
    **{f"ee_{name}": over_workflow(build) for name, build in WORKFLOW.items()},
    **{f"dk{i}_{name}": over(SUITE[name]) for i, name in enumerate(("candidate_likelihood_counts", "candidate_topk", "privacy_budget_trace_audit", "repair_dashboard", "end_to_end_dashboard"), 1)},
    **{f"pg{i}_{name}": over(SUITE[name]) for i, name in enumerate(("candidate_likelihood_base", "candidate_likelihood_counts", "candidate_topk", "privacy_budget_trace_audit", "repair_dashboard", "provenance_event_drilldown", "end_to_end_dashboard"), 1)},
    **{f"os{i}_{name}": over(build) for i, (name, build) in enumerate(READERS.items(), 1)},
}
