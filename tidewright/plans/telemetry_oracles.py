"""The telemetry queries in SQL, for comparison."""

from __future__ import annotations

from tidewright.plans.telemetry_queries import BANDS, NEAR_CAP
from tidewright.sources.telemetry import BATCHES, CORRECTED, REPLAYED
from tidewright.streaming.workflow import CAP

WEIGHTS = """w AS (SELECT 'pm32' AS mechanism_id, epsilon::DOUBLE AS epsilon, rb::INTEGER AS report_bucket, sb::INTEGER AS stuck_bucket, ln(1.0::DOUBLE / 32) AS logp_normal,
  ln(0.002::DOUBLE + 0.55::DOUBLE * exp(-epsilon::DOUBLE * abs(rb - sb) / 8.0)) AS logp_fault FROM (VALUES (0.5), (1.0), (2.0)) AS e(epsilon), range(32) AS a(rb), range(32) AS b(sb))"""
REPORTS = """r AS (SELECT event_id AS report_id, user_id::INTEGER AS device_id, (floor(epoch(ts) / 3600.0) - 473352)::INTEGER AS ts, least(31, floor(value / 7.0::DOUBLE))::INTEGER AS report_bucket,
  CASE (user_id + event_id) % 3 WHEN 0 THEN 0.5 WHEN 1 THEN 1.0 ELSE 2.0 END::DOUBLE AS epsilon, 'pm32' AS mechanism_id, 'cal_v1' AS calibration_version FROM events)"""


def cleaned(source: str, version: str) -> str:
    return f"""(SELECT report_id, device_id, ts, CASE WHEN p >= 0.80::DOUBLE THEN 'stuck_hmm' WHEN p >= 0.65::DOUBLE THEN 'window_glr' ELSE 'stuck_mixture' END AS operator, p AS posterior,
  CASE WHEN p >= 0.65::DOUBLE THEN report_bucket END AS stuck_bucket, 0.2::DOUBLE AS fault_ratio, CASE WHEN p >= 0.80::DOUBLE THEN 'repair' WHEN p >= 0.65::DOUBLE THEN 'flag' ELSE 'pass' END AS action,
  2.0::DOUBLE * report_bucket / 31.0::DOUBLE - 1.0::DOUBLE AS repair_value, '{version}' AS provenance_version FROM (SELECT *, ((report_bucket * 17 + device_id + correction_version * 13) % 100) / 100.0::DOUBLE AS p FROM {source}))"""


def likelihoods(source: str) -> str:
    return f"""(SELECT w.mechanism_id, w.epsilon, w.stuck_bucket, sum(w.logp_fault) AS fault_loglik, sum(w.logp_normal) AS normal_loglik, sum(w.logp_fault - w.logp_normal) AS llr
  FROM {source} x JOIN w ON w.mechanism_id = x.mechanism_id AND w.epsilon = x.epsilon AND w.report_bucket = x.report_bucket GROUP BY ALL)"""


def repairs(source: str, clean: str) -> str:
    return f"""(SELECT x.device_id, x.ts // 60 AS hour_id, count(*) AS reports, avg(CASE WHEN k.action = 'repair' THEN k.repair_value ELSE 2.0::DOUBLE * x.report_bucket / 31.0::DOUBLE - 1.0::DOUBLE END) AS cleaned_mean,
  avg(2.0::DOUBLE * x.report_bucket / 31.0::DOUBLE - 1.0::DOUBLE) AS unrepaired_mean, avg(k.posterior * (1.0::DOUBLE - k.posterior)) AS uncertainty_proxy, count(*) FILTER (k.action = 'repair') AS repair_count FROM {source} x JOIN {clean} k USING (report_id) GROUP BY 1, 2)"""


BASE = f"""WITH {WEIGHTS}, {REPORTS}, rv AS (SELECT *, 0 AS correction_version FROM r), c AS {cleaned("rv", "router_v1")}, lk AS {likelihoods("r")},
l AS (SELECT device_id, count(*) AS reports, sum(epsilon) AS epsilon_sum, 1000.0::DOUBLE AS device_budget, 1000.0::DOUBLE - sum(epsilon) AS remaining_budget FROM r GROUP BY 1),
t AS (SELECT *, 1000.0::DOUBLE - cumulative_epsilon AS remaining_budget FROM (SELECT report_id, device_id, ts, epsilon, sum(epsilon) OVER (PARTITION BY device_id ORDER BY ts, report_id ROWS UNBOUNDED PRECEDING) AS cumulative_epsilon FROM r)),
p(operator, semantic_layer) AS (VALUES ('stuck_mixture', 'iid stuck-at'), ('stuck_hmm', 'persistent flatline'), ('window_glr', 'field-QC local regime')),
e AS (SELECT c.device_id, c.ts // 60 AS hour_id, min(c.ts) AS start_ts, max(c.ts) AS end_ts, count(*) AS flagged_reports, avg(c.posterior) AS avg_posterior, string_agg(DISTINCT p.semantic_layer, ',' ORDER BY p.semantic_layer) AS routed_semantics
  FROM c JOIN p USING (operator) WHERE c.action IN ('flag', 'repair') GROUP BY 1, 2 HAVING count(*) >= 2),
h AS {repairs("r", "c")}
"""


def workflow() -> str:
    """Each batch's decisions follow from those before it: a chain of tables."""
    arrival = "b" + "".join(f" + CASE WHEN b > {after} THEN 1 ELSE 0 END" for _, after in REPLAYED)
    parts = [f"SELECT report_id, device_id, ts, report_bucket, epsilon, mechanism_id, calibration_version, 'evt-' || report_id AS source_event_id, ({arrival})::INTEGER AS batch_id, 'base' AS batch_kind, 0 AS correction_version FROM g"]
    for k, (again, after) in enumerate(REPLAYED):
        parts.append(f"SELECT report_id, device_id, ts, report_bucket, epsilon, mechanism_id, calibration_version, 'evt-' || report_id, {after + k + 1}, 'replay_batch_{again}', 0 FROM g WHERE b = {again}")
    last = BATCHES + len(REPLAYED)
    parts.append(f"SELECT report_id, device_id, greatest(0, ts - 7), (report_bucket + 11) % 32, epsilon, mechanism_id, calibration_version, 'corr-' || report_id, {last}, 'late_corrections', 1 FROM g WHERE report_id % {CORRECTED} = 0 AND report_id * 3 < last + 1")
    chain = ["d0 AS (SELECT *, 0 AS late_event, NULL::DOUBLE AS projected_epsilon_sum, 'none' AS status FROM b WHERE false)"]
    for n in range(last + 1):
        chain.append(f"""x{n} AS (SELECT b.*, CASE WHEN b.ts < (SELECT coalesce(max(ts), -1) FROM b WHERE batch_id < {n}) THEN 1 ELSE 0 END AS late_event, k.known, coalesce(s.spent, 0) AS spent FROM b
  LEFT JOIN (SELECT report_id, max(correction_version) AS known FROM d{n} WHERE status IN ('accepted', 'correction') GROUP BY 1) k USING (report_id)
  LEFT JOIN (SELECT device_id, sum(epsilon) AS spent FROM d{n} WHERE status = 'accepted' AND correction_version = 0 GROUP BY 1) s USING (device_id) WHERE b.batch_id = {n}),
y{n} AS (SELECT * EXCLUDE (known, spent), CASE WHEN known IS NULL THEN spent + sum(CASE WHEN known IS NULL THEN epsilon END) OVER (PARTITION BY device_id ORDER BY ts, report_id ROWS UNBOUNDED PRECEDING) END AS projected_epsilon_sum, known FROM x{n}),
d{n + 1} AS MATERIALIZED (SELECT * FROM d{n} UNION ALL BY NAME SELECT * EXCLUDE (known), CASE WHEN known >= correction_version THEN 'duplicate' WHEN known IS NOT NULL THEN 'correction' WHEN projected_epsilon_sum > {CAP} THEN 'rejected' ELSE 'accepted' END AS status FROM y{n})""")
    return f"""WITH {WEIGHTS}, {REPORTS}, g AS (SELECT *, report_id // ceil((max(report_id) OVER () + 1) / {BATCHES}.0)::BIGINT AS b, max(report_id) OVER () AS last FROM r),
b AS ({' UNION ALL '.join(parts)}),
{', '.join(chain)}, d AS (SELECT * FROM d{last + 1}),
f AS (SELECT * FROM d WHERE status IN ('accepted', 'correction') QUALIFY row_number() OVER (PARTITION BY report_id ORDER BY correction_version DESC, batch_id) = 1),
c AS {cleaned("f", "router_v2")}, lk AS {likelihoods("f")},
s AS (SELECT device_id, count(*) FILTER (status = 'accepted' AND correction_version = 0) AS accepted_reports, coalesce(sum(epsilon) FILTER (status = 'accepted' AND correction_version = 0), 0) AS epsilon_sum,
  {CAP} - coalesce(sum(epsilon) FILTER (status = 'accepted' AND correction_version = 0), 0) AS remaining_budget FROM d GROUP BY 1),
e AS (SELECT device_id, ts // 60 AS hour_id, count(*) AS reports, count(*) FILTER (action IN ('flag', 'repair')) AS flagged_reports, avg(posterior) AS avg_posterior FROM c GROUP BY 1, 2 HAVING count(*) FILTER (action IN ('flag', 'repair')) > 0),
h AS {repairs("f", "c")},
m AS (SELECT batch_id, batch_kind, count(*) AS input_events, count(*) FILTER (status = 'accepted') AS accepted_new_events, count(*) FILTER (status = 'duplicate') AS duplicate_events, count(*) FILTER (status = 'correction') AS correction_events,
  count(*) FILTER (status = 'rejected') AS rejected_budget_events, count(*) FILTER (late_event = 1) AS late_events, max(ts) AS latest FROM d GROUP BY 1, 2)
"""


FLOW = workflow()
BAND = f"CASE WHEN l.remaining_budget < {NEAR_CAP} THEN 'near_cap' ELSE 'ok' END"
AUDIT = "count(*) AS {name}, round(min(remaining_budget), 9) AS min_remaining_budget, round(avg(remaining_budget), 9) AS avg_remaining_budget"
LIKELIHOODS = "SELECT mechanism_id, epsilon, stuck_bucket, round(fault_loglik, 6) AS fault_loglik, round(normal_loglik, 6) AS normal_loglik, round(llr, 6) AS llr FROM lk"
TOP = "SELECT epsilon, stuck_bucket, round(llr, 6) AS llr FROM lk ORDER BY llr DESC, epsilon, stuck_bucket LIMIT {n}"
REPAIRS = "SELECT device_id, hour_id::BIGINT AS hour_id, reports, round(cleaned_mean, 9) AS cleaned_mean, round(unrepaired_mean, 9) AS unrepaired_mean, round(uncertainty_proxy, 9) AS uncertainty_proxy, repair_count FROM h"
DASHBOARD = f"SELECT {BAND} AS budget_band, count(*) AS hourly_groups, sum(coalesce(e.flagged_reports, 0))::BIGINT AS flagged_reports, round(avg(h.cleaned_mean), 9) AS avg_cleaned_mean, round(avg(h.uncertainty_proxy), 9) AS avg_uncertainty_proxy{{more}} FROM h JOIN l USING (device_id) LEFT JOIN e USING (device_id, hour_id) GROUP BY 1"
SUITE = {
    "candidate_likelihood_base": LIKELIHOODS,
    "candidate_likelihood_counts": LIKELIHOODS,
    "candidate_topk": TOP.format(n=10),
    "privacy_budget_window_base": f"SELECT {AUDIT.format(name='reports')} FROM t",
    "privacy_budget_trace_audit": f"SELECT {AUDIT.format(name='reports')} FROM t WHERE remaining_budget < 1000",
    "repair_aggregate": REPAIRS,
    "repair_dashboard": "SELECT device_id, count(*) AS hourly_groups, round(avg(cleaned_mean), 9) AS avg_cleaned_mean, sum(repair_count)::BIGINT AS repaired_reports, round(avg(uncertainty_proxy), 9) AS avg_uncertainty_proxy FROM h GROUP BY 1",
    "provenance_event_drilldown": "SELECT device_id, hour_id::BIGINT AS hour_id, e.flagged_reports, round(e.avg_posterior, 9) AS avg_posterior, round(h.cleaned_mean, 9) AS cleaned_mean, round(h.uncertainty_proxy, 9) AS uncertainty_proxy, round(l.remaining_budget, 9) AS remaining_budget FROM e JOIN h USING (device_id, hour_id) JOIN l USING (device_id) WHERE e.avg_posterior >= 0.72::DOUBLE ORDER BY e.flagged_reports DESC, round(e.avg_posterior, 9) DESC, device_id, hour_id LIMIT 100",
    "end_to_end_dashboard": DASHBOARD.format(more=""),
}
STAGES = {
    "reports": "SELECT * FROM r",
    "report_counts": "SELECT mechanism_id, epsilon, report_bucket, count(*) AS n FROM r GROUP BY ALL",
    "cleaning_records": "SELECT * REPLACE (round(posterior, 9) AS posterior, round(repair_value, 9) AS repair_value) FROM c",
    "provenance_edges": "SELECT report_id AS output_report_id, 'reports' AS source_table, report_id AS source_key, operator AS transform, 'pm32' AS mechanism_id, 'cal_v1' AS calibration_version FROM c",
    "privacy_ledger": "SELECT * FROM l",
    "privacy_budget_trace": "SELECT * FROM t",
    "hourly_cleaned_analytics": "SELECT r.device_id, (r.ts // 60)::BIGINT AS hour_id, count(*) AS reports, round(avg(c.posterior), 9) AS avg_fault_posterior, count(*) FILTER (c.action = 'repair') AS repaired_reports, round(avg(2.0::DOUBLE * r.report_bucket / 31.0::DOUBLE - 1.0::DOUBLE), 9) AS cleaned_mean FROM r JOIN c USING (report_id) GROUP BY 1, 2",
    "cleaned_event_windows": "SELECT device_id, hour_id::BIGINT AS hour_id, start_ts, end_ts, flagged_reports, round(avg_posterior, 9) AS avg_posterior, routed_semantics FROM e",
    "repair_uncertainty_analytics": REPAIRS,
    "lineage_drilldown": "SELECT c.report_id, c.device_id, c.ts, r.report_bucket, c.operator, round(c.posterior, 9) AS posterior, c.operator AS transform FROM c JOIN r USING (report_id) ORDER BY c.posterior DESC, c.report_id LIMIT 100",
}
DRILL = "SELECT c.report_id, c.device_id, c.ts, c.operator, round(c.posterior, 9) AS posterior, c.operator AS transform, round(w.logp_fault - w.logp_normal, 9) AS llr_component FROM c JOIN r USING (report_id) JOIN w ON w.epsilon = r.epsilon AND w.report_bucket = r.report_bucket AND w.stuck_bucket = coalesce(c.stuck_bucket, r.report_bucket) WHERE c.action IN ('flag', 'repair') ORDER BY c.posterior DESC, c.ts DESC, c.report_id LIMIT 100"
STUDY = {
    "candidate_likelihood_topk": LIKELIHOODS + " ORDER BY llr DESC, epsilon, stuck_bucket LIMIT 96",
    "privacy_budget_accounting": f"SELECT {AUDIT.format(name='reports')} FROM t WHERE remaining_budget < 1000",
    "uncertainty_privacy_dashboard": DASHBOARD.format(more=", sum(h.repair_count)::BIGINT AS repair_count"),
    "provenance_event_drilldown": DRILL,
}
WORKFLOW = {
    "replay_audit": "SELECT batch_kind, sum(input_events)::BIGINT AS input_events, sum(accepted_new_events)::BIGINT AS accepted_new_events, sum(duplicate_events)::BIGINT AS duplicate_events, sum(rejected_budget_events)::BIGINT AS rejected_budget_events FROM m GROUP BY 1",
    "budget_dashboard": f"SELECT count(*) AS devices, round(min(remaining_budget), 9) AS min_remaining_budget, round(avg(remaining_budget), 9) AS avg_remaining_budget, count(*) FILTER (remaining_budget < {BANDS[0]}) AS near_cap_devices FROM s",
    "rejected_drilldown": "SELECT device_id, count(*) AS rejected, min(ts) AS first_rejected_ts, max(projected_epsilon_sum) AS max_projected FROM d WHERE status = 'rejected' GROUP BY 1 ORDER BY rejected DESC, device_id LIMIT 20",
    "correction_lineage": "SELECT f.report_id, f.device_id, f.ts, f.report_bucket, c.operator, round(c.posterior, 9) AS posterior, f.source_event_id AS source_key, f.batch_id FROM f JOIN c USING (report_id) WHERE f.correction_version > 0 AND f.late_event = 1 ORDER BY c.posterior DESC, f.report_id LIMIT 50",
    "candidate_top20": TOP.format(n=20),
    "device_trace": f"SELECT device_id, min({CAP} - cum) AS min_remaining_budget, max(cum) AS max_cumulative_epsilon, count(*) AS reports FROM (SELECT device_id, sum(epsilon) OVER (PARTITION BY device_id ORDER BY ts, report_id ROWS UNBOUNDED PRECEDING) AS cum FROM f) GROUP BY 1 ORDER BY 2, 1 LIMIT 20",
    "event_uncertainty": "SELECT device_id, hour_id::BIGINT AS hour_id, e.flagged_reports, round(e.avg_posterior, 9) AS avg_posterior, round(h.cleaned_mean, 9) AS cleaned_mean, round(h.uncertainty_proxy, 9) AS uncertainty_proxy FROM e JOIN h USING (device_id, hour_id) WHERE e.flagged_reports >= 3 ORDER BY e.flagged_reports DESC, round(e.avg_posterior, 9) DESC, device_id, hour_id LIMIT 100",
    "dashboard": f"SELECT CASE WHEN s.remaining_budget < {BANDS[0]} THEN 'near_cap' WHEN s.remaining_budget < {BANDS[1]} THEN 'low' ELSE 'ok' END AS budget_band, count(DISTINCT device_id) AS devices, count(*) AS hourly_groups, sum(coalesce(e.flagged_reports, 0))::BIGINT AS flagged_reports, round(avg(h.cleaned_mean), 9) AS avg_cleaned_mean, round(avg(h.uncertainty_proxy), 9) AS avg_uncertainty FROM h JOIN s USING (device_id) LEFT JOIN e USING (device_id, hour_id) GROUP BY 1",
    "manifest": "SELECT * EXCLUDE (latest), coalesce(greatest(-1, max(latest) OVER (ORDER BY batch_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)), -1)::INTEGER AS watermark_before, greatest(-1, max(latest) OVER (ORDER BY batch_id ROWS UNBOUNDED PRECEDING))::INTEGER AS watermark_after FROM m",
    "checks": f"""SELECT name, observed::BIGINT AS observed, 0::BIGINT AS expected, CASE WHEN observed = 0 THEN 'pass' ELSE 'fail' END AS status FROM (
  SELECT 'unique_report_ids' AS name, count(*) FILTER (n > 1) AS observed FROM (SELECT report_id, count(*) AS n FROM f GROUP BY 1) UNION ALL SELECT 'cleaning_without_report', count(*) FROM c WHERE report_id NOT IN (SELECT report_id FROM f)
  UNION ALL SELECT 'devices_over_cap', count(*) FROM (SELECT device_id FROM d WHERE status = 'accepted' AND correction_version = 0 GROUP BY 1 HAVING sum(epsilon) > {CAP}) UNION ALL SELECT 'replay_inserts', count(*) FROM d WHERE batch_kind LIKE 'replay%' AND status = 'accepted'
  UNION ALL SELECT 'correction_lineage', count(*) FROM f WHERE correction_version > 0 AND NOT starts_with(source_event_id, 'corr-') UNION ALL SELECT 'undecided_events', count(*) FROM d WHERE status IS NULL)""",
}
READERS = {
    "range_count": "SELECT device_id, count(*) AS reports, round(avg(report_bucket), 9) AS avg_bucket FROM r WHERE ts BETWEEN 100 AND 400 GROUP BY 1",
    "recovery_dashboard": "SELECT l.device_id, l.remaining_budget, count(h.cleaned_mean) AS hourly_groups, round(avg(h.cleaned_mean), 9) AS avg_cleaned_mean, coalesce(sum(h.repair_count), 0)::BIGINT AS repairs FROM l LEFT JOIN h USING (device_id) GROUP BY 1, 2 ORDER BY 2, 1 LIMIT 100",
}


def oracle(key: str) -> str | None:
    """The SQL of a telemetry query by its key."""
    kind, _, name = key.partition("_")
    if key == "candidate_likelihood_topk":
        return BASE + TOP.format(n=96)
    if kind == "pd":
        for query, sql in STUDY.items():
            if name.startswith(query):
                if query == "privacy_budget_accounting" and name.endswith("incremental_mv"):
                    sql = f"SELECT {AUDIT.format(name='devices')} FROM l WHERE remaining_budget < 1000"
                return BASE + sql
    if kind == "ps":
        return BASE + STAGES[name]
    if kind == "ee":
        return FLOW + WORKFLOW[name]
    if kind[:2] == "os":
        return BASE + READERS[name]
    return BASE + SUITE[name] if kind[:2] in ("qs", "dk", "pg") else None
