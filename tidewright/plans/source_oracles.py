"""The queries of readers and sinks in SQL: what was written, as it must come back."""

from __future__ import annotations

from tidewright.operators.relations import BUDGET
from tidewright.plans.series_oracles import BASE, mad, r
from tidewright.plans.source_queries import BEGIN, CODES, END, FIRST, GONE, NEEDED, TOGETHER
from tidewright.plans.telemetry_oracles import REPORTS

EV = f"WITH ev AS (SELECT * REPLACE (date_trunc('second', ts) AS ts), event_id % {GONE} = 0 AS gone FROM events) "
SHOWN = "strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts"
VALUE = "CASE WHEN gone THEN NULL ELSE value END AS value"
HOUR = "strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS ts"
CODE = f"(['{"', '".join(CODES)}'])[event_id % {len(CODES)} + 1]"
TEXT = " ".join(f"WHEN '{k}' THEN '{' '.join(v.split())}'" for k, v in CODES.items())
BINS = ", ".join(f"count(*) FILTER (bin = {k}) AS b{k}" for k in range(8))

ORACLES: dict[str, str] = {
    "s8_air_quality": EV + f"SELECT {SHOWN}, {VALUE} FROM ev",
    "s9_household_power": EV + f", mi AS (SELECT date_trunc('minute', ts) AS ts, gone, value FROM ev) SELECT {SHOWN}, {VALUE} FROM mi WHERE date_diff('minute', (SELECT min(ts) FROM mi), ts) % 60 = 0",
    "s10_bike_sharing": EV + f"SELECT {HOUR}, (event_id % 1000)::DOUBLE AS value FROM ev",
    "s11_beijing_air": EV + f"SELECT {HOUR}, {VALUE} FROM ev",
    "s12_timestamped": EV + f"SELECT {SHOWN}, {VALUE} FROM ev",
    "s13_gas_drift": EV + "SELECT (event_id % 3 + 1)::INTEGER AS batch, (user_id % 6 + 1)::VARCHAR AS label, value FROM ev WHERE NOT gone",
    "s14_streams": EV + f"SELECT {HOUR}, (event_id % 1000)::DOUBLE AS value, 'bike_sharing' AS series_id FROM ev UNION ALL SELECT {HOUR}, value, 'beijing_air' FROM ev",
    "s15_inside_windows": EV + "SELECT 'user' || user_id AS series_id, count(*) AS n, count(*) FILTER (user_id % 3 = 0 AND day(ts) % 5 = 0 AND ts <= date_trunc('day', ts) + INTERVAL 1 HOUR) AS inside FROM ev GROUP BY 1",
    "s17_arrays": EV + f", du AS (SELECT user_id // {TOGETHER} AS dump, event_id, gone, value, (row_number() OVER (PARTITION BY user_id // {TOGETHER} ORDER BY event_id) - 1)::INTEGER AS place FROM ev) SELECT dump, 'value' AS variable, place, {VALUE} FROM du UNION ALL SELECT dump, 'id', place, event_id::DOUBLE FROM du",
    "s17_dimensions": EV + f"SELECT user_id // {TOGETHER} AS dump, unnest(['time', 'test']) AS dimension, unnest([count(*), 71]) AS size FROM ev GROUP BY 1",
    "s18_codes": EV + f"SELECT {CODE} AS code, CASE {CODE} {TEXT} END || ' ' || count(*) AS description FROM ev GROUP BY event_id % {len(CODES)}",
    "s18_fail_summary": EV + f", pu AS (SELECT event_id % {len(CODES)} AS place, user_id, least(7, floor(avg(gone::INTEGER) * 16)) AS bin FROM ev GROUP BY 1, 2), pb AS (SELECT place, {BINS}, count(*) AS n FROM pu GROUP BY 1) SELECT (place * 40)::INTEGER AS index, (['{"', '".join(CODES)}'])[place + 1] AS code, place * 40 < 71 AS ordered, concat_ws(',', {', '.join(f'b{k}' for k in range(8))}) AS counts, {' + '.join(f'printf(\'%.1f\', b{k} * 100.0::DOUBLE / n)::DOUBLE' for k in range(8))} AS total FROM pb",
    "s20_units_row": EV + f"SELECT {SHOWN}, value FROM ev WHERE ts >= TIMESTAMP '{BEGIN[:10]}' AND ts < TIMESTAMP '{END[:10]}'",
    "s22_water_levels": EV + f"SELECT {SHOWN}, {VALUE}, (event_id % 2)::INTEGER AS label, CASE WHEN user_id % 2 = 0 THEN 'p' ELSE 'v' END AS quality FROM ev",
    "a28_flag_counts": "SELECT '{\"p\":' || count(*) FILTER (user_id % 2 = 0) || ',\"v\":' || count(*) FILTER (user_id % 2 <> 0) || '}' AS counts FROM events",
    "s26_sizes": "SELECT doc_id, round(CASE n_chars % 3 WHEN 0 THEN n_chars / 1024 WHEN 1 THEN printf('%.1f', n_chars / 10.0::DOUBLE)::DOUBLE ELSE n_chars / 1048576 END, 9) AS mb FROM documents",
    "s29_results": EV + "SELECT user_id, count(*) AS n, max(value) FILTER (NOT gone) AS best, max(CASE WHEN event_type = 'error' THEN 'error' END) AS kind FROM ev GROUP BY 1",
    "k3_summary": "SELECT count(*) AS n, max(value) AS highest, NULL::VARCHAR AS note FROM events",
    "j16_backfill": EV + f"SELECT strftime(day, '%Y-%m-%d') AS day, n FROM (SELECT *, coalesce(sum(n) OVER (ORDER BY day DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM (SELECT date_trunc('day', ts) AS day, count(*) AS n FROM ev GROUP BY 1) WHERE day < DATE '{FIRST}') WHERE before < {NEEDED}",
    "st10_ledger": f"WITH {REPORTS} SELECT device_id, count(*) AS reports, sum(epsilon) AS epsilon_sum, {BUDGET}::DOUBLE AS device_budget, {BUDGET}::DOUBLE - sum(epsilon) AS remaining_budget FROM r GROUP BY 1",
    "st12_device_counts": f"WITH {REPORTS} SELECT device_id, report_bucket, count(*) AS n FROM r GROUP BY 1, 2",
    "d21_spike": BASE + mad("n", "v") + f"SELECT series_id, t, {r('abs(v - md)', 'score')} FROM q",
}
