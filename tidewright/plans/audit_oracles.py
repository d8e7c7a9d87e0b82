"""The queries of simulations, audits and layers in SQL, for comparison."""

from __future__ import annotations

from tidewright.operators.channel import D, shape
from tidewright.operators.hmm import transition
from tidewright.operators.simulation import HASH, places
from tidewright.operators.selection import BOUNDARIES, FAILURE, REPEATED, TRIGGERS
from tidewright.plans.audit_queries import BLOCK, CHANNELS, CHOSEN, COMMENTS, ENOUGH, EPISODE, FLEETS, GATED, KINDS, LAYERS, LENGTHS, SOURCES, STREAM_EPSILONS, STREAMS, STRESSED, TEST, TESTS, TRUE_EPSILON, VARIABLES, WIDE, WINDOWS
from tidewright.plans.report_oracles import CASES, FAMILY, FAULTS, POOL, SUITE, grid, of_private, recursive
from tidewright.plans.report_oracles import ORACLES as REPORT_ORACLES
from tidewright.plans.report_queries import LENGTH, SEEDS, SETTINGS
from tidewright.plans.series_oracles import ALONG, BASE, BIN, base, centred, hmm, num, r, ranking
from tidewright.plans.series_queries import SHARE, STUCK

MEASURES = ("kl", "chernoff", "bucket_p_under_fault", "bucket_p_under_normal", "bucket_auc", "llr_auc", "llr_auprc", "stuck_value", "bucket_delta", "auroc_gap")


def advantage(epsilon: float) -> str:
    """The simulation at one epsilon; every draw is a row."""
    _, c = shape(epsilon)
    of, by = "PARTITION BY series_id, candidate", "series_id, candidate, len, kind"
    centre = f"({num(-1 + 1 / D)} + {num(2 / D)} * candidate)"
    scramble = lambda x: f"(xor({x}, {x} >> 16) * {HASH}) & 4294967295"
    steps = ", ".join(f"({i}, {a}, {b})" for i, (a, b) in enumerate(places(max(LENGTHS))))
    code = f"(((((series_id * {len(STREAM_EPSILONS)} + {STREAM_EPSILONS.index(epsilon)}) * {D} + candidate) * 128 + len) * {WINDOWS} + win) * 2 + label) % 4294967296"
    return f"""({base(epsilon)}, h5 AS (SELECT series_id % {STREAMS} AS series_id, stuck_bucket, sum(c) AS c FROM h GROUP BY 1, 2),
al5 AS (SELECT z.series_id, a::INTEGER AS stuck_bucket, (coalesce(c, 0) + 0.001::DOUBLE) / (total + {num(D * 1e-3)}) AS alpha FROM (SELECT series_id, sum(c) AS total FROM h5 GROUP BY 1) z CROSS JOIN range({D}) AS b(a) LEFT JOIN h5 ON h5.series_id = z.series_id AND h5.stuck_bucket = a),
p5 AS (SELECT series_id, report_bucket, greatest(sum(p * alpha), 1e-12) AS p0 FROM al5 JOIN mx USING (stuck_bucket) GROUP BY 1, 2),
d1 AS (SELECT series_id, stuck_bucket AS candidate, report_bucket AS b, p0 / sum(p0) OVER ({of.replace('candidate', 'stuck_bucket')}) AS q0, greatest(p, 1e-12) / sum(greatest(p, 1e-12)) OVER ({of.replace('candidate', 'stuck_bucket')}) AS q1 FROM p5 JOIN mx USING (report_bucket) WHERE stuck_bucket IN (0, 1, {D // 4}, {D // 2}, {3 * D // 4}, {D - 2}, {D - 1})),
d2 AS MATERIALIZED (SELECT *, sum(q0) OVER ({of} ORDER BY b ROWS UNBOUNDED PRECEDING) AS c0, sum(q1) OVER ({of} ORDER BY b ROWS UNBOUNDED PRECEDING) AS c1, ln(q1) - ln(q0) AS llr, greatest(0, least({D - 1}, floor(({centre} + {num(c)}) / {num(2 * c / D)}))) AS own FROM d1),
d3 AS MATERIALIZED (SELECT series_id, candidate, label, b, llr, (b = own)::INTEGER AS hit, CASE WHEN b = 0 THEN -1 ELSE lag(x) OVER (PARTITION BY series_id, candidate, label ORDER BY b) END AS low, CASE WHEN b = {D - 1} THEN 2 ELSE x END AS high FROM (SELECT *, unnest([0, 1]) AS label, unnest([c0, c1]) AS x FROM d2)),
w0 AS (SELECT series_id, candidate, len, win, label, {code} AS x FROM (SELECT DISTINCT series_id, candidate FROM d2) CROSS JOIN (SELECT unnest([{', '.join(map(str, LENGTHS))}]) AS len) CROSS JOIN range({WINDOWS}) AS w(win) CROSS JOIN range(2) AS l(label)),
w1 AS (SELECT * REPLACE ({scramble('x')} AS x) FROM w0), w2 AS (SELECT * REPLACE ({scramble('x')} AS x) FROM w1), w3 AS (SELECT * REPLACE (xor(x, x >> 16) >> 1 AS x) FROM w2),
dr AS (SELECT series_id, candidate, len, win, label, (a * x + k) % 2147483648 / {num(2.0**31)} AS u FROM w3 JOIN (VALUES {steps}) s(i, a, k) ON i < len),
sw AS (SELECT dr.series_id, dr.candidate, len, win, dr.label, round(sum(llr), 9) AS llr, sum(hit)::DOUBLE AS hits FROM dr JOIN d3 ON d3.series_id = dr.series_id AND d3.candidate = dr.candidate AND d3.label = dr.label AND u >= low AND u < high GROUP BY 1, 2, 3, 4, 5),
sc AS (SELECT series_id, candidate, len, label, unnest([0, 1]) AS kind, unnest([llr, hits]) AS score FROM sw), rk AS ({ranking("sc", by)}),
ar AS (SELECT series_id, candidate, len, max(auroc) FILTER (kind = 1) AS bucket_auc, max(auroc) FILTER (kind = 0) AS llr_auc, max(auprc) FILTER (kind = 0) AS llr_auprc FROM rk GROUP BY 1, 2, 3),
di AS (SELECT series_id, candidate, max(own)::INTEGER AS output_bucket, sum(q1 * llr) AS kl, -ln(sum(sqrt(q0 * q1))) AS chernoff, sum(q1) FILTER (b = own) AS bucket_p_under_fault, sum(q0) FILTER (b = own) AS bucket_p_under_normal FROM d2 GROUP BY 1, 2)
SELECT series_id, {num(epsilon)} AS epsilon, candidate AS stuck_bucket, len AS segment_len, output_bucket, kl, chernoff, bucket_p_under_fault, bucket_p_under_normal, bucket_auc, llr_auc, llr_auprc, {centre} AS stuck_value, bucket_p_under_fault - bucket_p_under_normal AS bucket_delta, llr_auc - bucket_auc AS auroc_gap, (round(bucket_auc, 9) <= 0.55::DOUBLE AND round(llr_auc, 9) >= 0.70::DOUBLE)::INTEGER AS hard_case
FROM ar JOIN di USING (series_id, candidate))"""


ADVANTAGE = " UNION ALL ".join(map(advantage, STREAM_EPSILONS))
MEDIANS = ", ".join(f"round(quantile_cont(round({c}, 9), 0.5), 6) + 0 AS median_{c}" for c in ("bucket_auc", "llr_auc", "llr_auprc", "kl", "auroc_gap"))


def of(values: tuple, number: str) -> str:
    quoted = ", ".join("NULL" if v is None else f"'{v}'" for v in values)
    return f"([{quoted}])[({number}) % {len(values)} + 1]"


def family_of(method: str) -> str:
    return FAMILY.replace("method", method)


RUNS_OF = "SELECT series_id, min(t) AS b, max(t) AS e, count(*) AS n FROM (SELECT series_id, t, t - row_number() OVER (PARTITION BY series_id ORDER BY t) AS g FROM {source} WHERE {flag}) GROUP BY series_id, g"
SCALAR = "list_filter(string_split_regex(trim(coalesce(variable, '')), '\\s+'), lambda v: regexp_matches(v, '(?i)^(t|p|rh|wspd|wdir|t_i_)'))"
QUANTITY = "CASE WHEN starts_with(v, 't_i_') OR v IN ('t_i', 't_u', 't_l') THEN 'temperature' WHEN v IN ('p_i', 'p_u', 'p_l') THEN 'pressure' WHEN v IN ('rh_i', 'rh_u', 'rh_l') THEN 'humidity' WHEN starts_with(v, 'wspd') THEN 'wind_speed' WHEN starts_with(v, 'wdir') THEN 'wind_direction' ELSE 'other' END"
TEXT = "coalesce(comment, '') || ' ' || coalesce(variable, '') || ' ' || flag"
RELEVANCE = f"CASE WHEN regexp_matches({TEXT}, '{REPEATED}') THEN 'explicit_repeated_value_or_zero' WHEN regexp_matches({TEXT}, '{FAILURE}') THEN 'sensor_failure_or_suspicious' ELSE 'other_manual_flag' END"
FLAGS = f"""{FAULTS.replace('AS b,', 'AS b, max(t) AS e,')}, mf0 AS (SELECT series_id, b - 2 AS b, e + 2 AS e, series_id * 1000 + b AS flag_id FROM fr UNION ALL SELECT series_id, 0, max(t), max(series_id * 1000 + 999) FROM f WHERE series_id % 5 = 0 GROUP BY 1),
mf AS (SELECT *, {of(VARIABLES, 'flag_id')} AS variable, {of(COMMENTS, 'flag_id // 7')} AS comment, 'CHECKME' AS flag, flag_id % 11 = 0 AS out FROM mf0),
fl AS (SELECT *, {SCALAR} AS scalar, {RELEVANCE} AS relevance FROM mf) """
QC = f""", jp AS (SELECT *, coalesce(obs - lag(obs) OVER ({ALONG}), 0) AS jump FROM o), qc AS (SELECT series_id, t, unnest(['stuck', 'range', 'jump']) AS test, unnest([label, CASE WHEN v > 0.8::DOUBLE THEN 1 WHEN v < -0.8::DOUBLE THEN -1 ELSE 0 END, CASE WHEN jump > 12 THEN 1 WHEN jump < -12 THEN -1 ELSE 0 END]) AS qc FROM jp) """
TRIGGER = "CASE " + " ".join(f"WHEN starts_with(layer, 'field_qc') THEN '{k}'" if v == ("field_qc",) else f"WHEN layer IN ({', '.join(repr(x) for x in v)}) THEN '{k}'" for k, v in TRIGGERS.items() if v) + f" ELSE '{list(TRIGGERS)[-1]}' END"
KIND = "CASE WHEN contains(lower(source), 'dropout') OR contains(lower(layer), 'availability') THEN 'availability' WHEN contains(lower(source), 'hadisd') THEN 'streak' WHEN contains(lower(source), 'co-ops') OR contains(lower(source), 'coops') THEN 'tolerance' WHEN recommended_method IS NOT DISTINCT FROM own_method OR starts_with(recommended_method, 'identity_channel_hmm') THEN 'own' ELSE 'other' END"
BOUNDARY = f"{SUITE}, bd AS (SELECT *, {of(SOURCES, '\"case\"')} AS source, {of(LAYERS, '\"case\"')} AS layer FROM su), bk AS (SELECT *, {KIND} AS kind FROM bd) SELECT \"case\", source, layer, " + ", ".join(f"CASE kind {' '.join(f'WHEN {k!r} THEN {v[i]!r}' for k, v in BOUNDARIES.items())} END AS {name}" for i, name in enumerate(("boundary_class", "supports", "counts"))) + ", round(gain, 9) + 0 AS gain FROM bk"
ROUTER = f"""{CASES}, cx AS (SELECT 0 AS batch, "case", {of(LAYERS, '"case"')} AS layer, method, auprc FROM ca UNION ALL SELECT 1, "case", {of(LAYERS, '"case"')}, method, auprc FROM ca WHERE part = 'test' AND "case" IN (1, 3) UNION ALL SELECT 1, 4, 'all layers', method, auprc FROM ca),
cm AS (SELECT batch, "case", layer, method, avg(auprc) AS auprc FROM cx GROUP BY ALL HAVING avg(auprc) IS NOT NULL), c1 AS (SELECT * FROM cm QUALIFY row_number() OVER (PARTITION BY batch, layer ORDER BY auprc DESC, method) = 1), c2 AS (SELECT * FROM cm WHERE method IN ('point_glr', 'surprise') QUALIFY row_number() OVER (PARTITION BY batch, layer ORDER BY auprc DESC, method) = 1),
ro AS (SELECT layer, {of(SOURCES, 'c1."case"')} AS source, c1.method AS router_operator, {family_of('c1.method')} AS operator_family, round(c1.auprc, 9) AS best_auprc, c2.method AS own_operator, round(c2.auprc, 9) AS own_auprc FROM c1 LEFT JOIN c2 USING (batch, layer) QUALIFY row_number() OVER (PARTITION BY layer ORDER BY batch DESC) = 1) """
ABLATION = CASES + f""", rm AS (SELECT "case", method, {FAMILY} AS family, avg(auprc) FILTER (part = 'validation') AS validation, avg(auroc) FILTER (part = 'test') AS test_auroc, avg(auprc) FILTER (part = 'test') AS test_auprc FROM ca GROUP BY 1, 2),
lo AS (SELECT DISTINCT "case", family AS left_out FROM rm UNION ALL SELECT DISTINCT "case", 'none' FROM rm), al3 AS (SELECT rm.*, left_out, count(*) OVER (PARTITION BY rm."case", left_out) AS methods FROM rm JOIN lo ON lo."case" = rm."case" AND left_out <> family)
SELECT "case", left_out, methods, method AS selected_method, family AS selected_family, round(validation, 9) + 0 AS validation, round(test_auroc, 9) + 0 AS test_auroc, round(test_auprc, 9) + 0 AS test_auprc, round(best - test_auprc, 9) + 0 AS regret FROM al3 JOIN (SELECT "case", max(test_auprc) AS best FROM rm GROUP BY 1) USING ("case")
WHERE validation IS NOT NULL QUALIFY row_number() OVER (PARTITION BY "case", left_out ORDER BY round(validation, 12) DESC, method) = 1"""
REVIEW = f""", sq AS (SELECT o.series_id, o.series_id % 5 AS "case", t, label, round(-ln(greatest(p0, 1e-15)), 6) AS score FROM o JOIN p0 ON p0.series_id = o.series_id AND p0.report_bucket = o.obs),
pl AS (SELECT "case", count(*) AS rows, sum(label)::BIGINT AS positives, {POOL.replace(', 6)', ', 9)')} FROM (SELECT *, count(*) OVER (PARTITION BY "case") AS n, row_number() OVER (PARTITION BY "case" ORDER BY score DESC, t DESC, series_id) AS place FROM sq) GROUP BY 1),
lm AS (SELECT "case", quantile_cont(score, 0.95) FILTER (label = 0) AS cut, sum(label) AS hits FROM sq GROUP BY 1), rf AS (SELECT "case", count(*) FILTER (label = 1 AND score >= cut) / max(hits) AS recall_fpr FROM sq JOIN lm USING ("case") GROUP BY 1),
ov AS (SELECT sum(rows)::BIGINT AS total_test_rows, sum(positives)::BIGINT AS total_fault_rows, avg(precision_1pct) AS p1, avg(precision_5pct) AS p5, avg(lift_1pct) AS l1, avg(lift_5pct) AS l5, avg(recall_fpr) AS rf FROM pl JOIN rf USING ("case"))
SELECT threshold, round(p, 6) + 0 AS precision, round(rc, 6) + 0 AS recall, round(l, 6) + 0 AS prevalence_lift, review_rows::BIGINT AS review_rows, total_test_rows, total_fault_rows, round(total_fault_rows / total_test_rows, 6) + 0 AS pooled_prevalence
FROM (SELECT *, unnest(['top_1pct_rank', 'top_5pct_rank', '5pct_fpr']) AS threshold, unnest([p1, p5, NULL]) AS p, unnest([total_test_rows * 0.01::DOUBLE * p1 / total_fault_rows, total_test_rows * 0.05::DOUBLE * p5 / total_fault_rows, rf]) AS rc, unnest([l1, l5, NULL]) AS l, unnest([round(total_test_rows * 0.01::DOUBLE), round(total_test_rows * 0.05::DOUBLE), NULL]) AS review_rows FROM ov)"""
HITS = f"""{FLAGS} SELECT flag_id, fl.series_id, fl.b AS "begin", fl.e AS "end", fl.e - fl.b AS duration, len(scalar)::INTEGER AS scalar_variable_count, array_to_string(list_sort(list_distinct(list_transform(scalar, lambda v: {QUANTITY}))), ' ') AS variable_families, relevance, (NOT out AND relevance = 'explicit_repeated_value_or_zero' AND len(scalar) > 0)::INTEGER AS usable,
(SELECT count(*) FROM f WHERE f.series_id = fl.series_id AND f.t BETWEEN fl.b AND fl.e) AS rows, coalesce((SELECT sum(label) FROM f WHERE f.series_id = fl.series_id AND f.t BETWEEN fl.b AND fl.e), 0)::BIGINT AS hits FROM fl"""
STREAKS = f"""{FLAGS}, sk AS ({RUNS_OF.format(source='o', flag='obs >= 16')}), un AS (SELECT DISTINCT relevance, sk.series_id, sk.b, sk.n, o.t FROM sk JOIN o ON o.series_id = sk.series_id AND o.t BETWEEN sk.b AND sk.e JOIN fl ON fl.series_id = o.series_id AND o.t BETWEEN fl.b AND fl.e),
up AS (SELECT relevance, series_id, b, n, count(*) AS c FROM un GROUP BY ALL) SELECT relevance, count(*) AS streaks, sum(n)::BIGINT AS streak_rows, sum(c)::BIGINT AS flagged_rows FROM up GROUP BY 1"""
INVENTORY = f""", yb AS (SELECT series_id, t, label, t // {BLOCK} AS block FROM f), lg AS ({RUNS_OF.format(source='f', flag='label = 1')} HAVING count(*) >= {EPISODE}),
pe AS (SELECT yb.series_id, block, count(*) AS c FROM yb JOIN lg ON lg.series_id = yb.series_id AND yb.t BETWEEN lg.b AND lg.e GROUP BY 1, 2), ep AS (SELECT series_id, block, count(*) AS n FROM (SELECT series_id, block, t - row_number() OVER (PARTITION BY series_id, block ORDER BY t) AS g FROM yb WHERE label = 1) GROUP BY series_id, block, g),
es AS (SELECT series_id, block, count(*) AS k, quantile_cont(n::DOUBLE, 0.5) AS md, max(n) AS mx FROM ep GROUP BY 1, 2), co AS (SELECT series_id, block, count(*) FILTER (label = 0) AS good_rows, count(*) FILTER (label = 1) AS all_stuck_rows FROM yb GROUP BY 1, 2)
SELECT series_id, block, good_rows, all_stuck_rows, coalesce(c, 0) AS persistent_stuck_rows, coalesce(k, 0) AS stuck_episodes, md AS median_stuck_episode_length, coalesce(mx, 0) AS max_stuck_episode_length, all_stuck_rows - coalesce(c, 0) AS short_stuck_rows_excluded,
(coalesce(c, 0) > 0 AND row_number() OVER (PARTITION BY series_id ORDER BY coalesce(c, 0) DESC, block) <= {CHOSEN})::INTEGER AS selected FROM co LEFT JOIN pe USING (series_id, block) LEFT JOIN es USING (series_id, block)"""
SUMMARY = QC + """, qr AS (SELECT test, count(*) AS runs, max(n) AS longest FROM (SELECT series_id, test, count(*) AS n FROM (SELECT series_id, test, t - row_number() OVER (PARTITION BY series_id, test ORDER BY t) AS g FROM qc WHERE qc > 0) GROUP BY series_id, test, g) GROUP BY 1)
SELECT test, count(*) AS rows, count(*) FILTER (qc > 0) AS positive_flags, count(*) FILTER (qc < 0) AS negative_flags, coalesce(max(runs), 0) AS positive_runs, coalesce(max(longest), 0) AS max_positive_run_length, count(*) FILTER (qc <> 0) AS nonzero_flags, (test = 'stuck')::INTEGER AS string_or_streak_code, CASE WHEN test = 'stuck' THEN 'value' ELSE '' END AS mapped_variable,
CASE WHEN test = 'stuck' AND count(*) FILTER (qc > 0) > 0 THEN 'semantic candidate' ELSE 'not used' END AS fit FROM qc LEFT JOIN qr USING (test) GROUP BY test"""
EVENTS = QC + f""", st AS ({RUNS_OF.format(source="qc", flag="test = 'stuck' AND qc > 0")}) SELECT a.series_id, a.t, b AS positive_run_start, e AS positive_run_end, n AS positive_run_length, (SELECT string_agg(test, '|' ORDER BY list_position(['{"', '".join(TESTS)}'], test)) FROM qc k WHERE k.series_id = a.series_id AND k.t = a.t AND k.qc > 0) AS cooccurring_positive_flags
FROM qc a JOIN st ON st.series_id = a.series_id AND a.t BETWEEN b AND e WHERE a.test = 'stuck' AND a.qc > 0"""
def chosen(i: int, kind: str, key: str = f"series_id % {SETTINGS}") -> str:
    return f"(([{', '.join(repr(x[i]) for x in STRESSED)}])[{key} + 1])::{kind}"


def stress() -> str:
    """All settings of the posterior model; a channel's table follows from its s, c and size."""
    _, c = shape(TRUE_EPSILON)
    known = ", ".join(f"({k}, {num(shape(e)[0])}, {num(shape(e)[1])}, {d})" for k, (e, d) in enumerate(CHANNELS))
    p01, p11 = transition(SHARE, float(LENGTH))
    inside = lambda x: f"greatest(0, least(d - 1, floor({x})))::INTEGER"
    sizes = f"([{', '.join(str(CHANNELS[x[4]][1]) for x in STRESSED)}])[series_id % {SETTINGS} + 1]"
    means = "count(auprc) AS runs, round(avg(auroc), 6) + 0 AS auroc, round(avg(auprc), 6) + 0 AS auprc"
    plain = ", ".join(str(k) for k, x in enumerate(STRESSED) if x[:2] == ("calibration_contamination", 0.0))
    model = hmm("SELECT a.series_id, a.t, q.stuck_bucket AS candidate, greatest(b.p0, 1e-12) AS e0, greatest(q.p, 1e-12) AS e1 FROM so a JOIN sp b ON b.series_id = a.series_id AND b.report_bucket = a.obs JOIN cm q ON q.channel = a.channel AND q.report_bucket = a.obs", num(SHARE), num(p01), num(p11))
    sql = base(TRUE_EPSILON, grid(len(STRESSED), f"({chosen(2, 'BIGINT', 'g')})"), length=str(LENGTH)) + f""", so0 AS (SELECT *, {sizes} AS d, {chosen(4, 'INTEGER')} AS channel, {chosen(3, 'DOUBLE')} AS share FROM y),
so AS MATERIALIZED (SELECT *, {inside(f'(y + {num(c)}) / ({num(2 * c)} / d)')} AS obs, {inside(f'{num(STUCK + 1.0)} * (d / 2.0::DOUBLE)')} AS bucket FROM so0),
cg AS (SELECT channel, s, c, d, a AS stuck_bucket, b AS report_bucket, 2 / (s - 1) AS width, 2 * c / d AS step, (s * (-1 + 1.0::DOUBLE / d + 2.0::DOUBLE / d * a) - 1) / (s - 1) AS lo FROM (VALUES {known}) k(channel, s, c, d), range(64) AS p(a), range(64) AS q(b) WHERE a < d AND b < d),
co AS (SELECT *, greatest(0::DOUBLE, least(-c + report_bucket * step + step, lo + width) - greatest(-c + report_bucket * step, lo)) AS ov FROM cg),
cw AS (SELECT *, s / (s + 1) / width * ov + 1 / (s + 1) / (2 * c - width) * (step - ov) AS mass FROM co), cm AS MATERIALIZED (SELECT channel, stuck_bucket::INTEGER AS stuck_bucket, report_bucket::INTEGER AS report_bucket, mass / sum(mass) OVER (PARTITION BY channel, stuck_bucket) AS p FROM cw),
sh AS (SELECT series_id, d, channel, share, bucket, {inside('(v + 1.0::DOUBLE) * (d / 2.0::DOUBLE)')} AS sb, count(*) AS n FROM so WHERE part = 'train' GROUP BY ALL),
sa AS (SELECT z.series_id, z.channel, b AS stuck_bucket, (coalesce(n, 0) + 0.001::DOUBLE) / (total + z.d * 0.001::DOUBLE) * (1 - z.share) + CASE WHEN b = z.bucket THEN z.share ELSE 0 END AS alpha FROM (SELECT series_id, d, channel, share, bucket, sum(n) AS total FROM sh GROUP BY ALL) z JOIN range(64) AS w(b) ON b < z.d LEFT JOIN sh ON sh.series_id = z.series_id AND sh.sb = b),
sp AS MATERIALIZED (SELECT series_id, report_bucket, sum(p * alpha) AS p0 FROM sa JOIN cm USING (channel, stuck_bucket) GROUP BY 1, 2){model},
sx AS MATERIALIZED (SELECT series_id, t, so.label, candidate, bucket, round(score, 6) AS score FROM ps JOIN lk USING (series_id, candidate) JOIN so USING (series_id, t)), rk AS ({ranking("sx", "series_id")}),
hi AS (SELECT series_id, max((candidate = bucket)::INTEGER)::DOUBLE AS hit FROM sx GROUP BY 1), fl AS (SELECT unnest([{', '.join(map(str, FLEETS))}]) AS x, {chosen(2, 'INTEGER')} AS seed, series_id // {SETTINGS} AS device, label, score FROM sx WHERE series_id % {SETTINGS} IN ({plain})),
fg AS (SELECT *, device // x AS fleet FROM fl), fk AS ({ranking("fg", "x, seed, fleet")})
SELECT {chosen(0, 'VARCHAR')} AS panel, {chosen(1, 'DOUBLE')} AS x, {chosen(2, 'INTEGER')} AS seed, {means}, round(avg(hit), 6) + 0 AS bucket_hit FROM rk JOIN hi USING (series_id) GROUP BY 1, 2, 3
UNION ALL SELECT 'multi_device_short_traces', x::DOUBLE, seed, {means}, NULL FROM fk GROUP BY ALL"""
    return recursive(sql)


def gate(epsilon: float) -> str:
    """Stuck segments at values of each kind at one epsilon, with the separation of the value's bucket."""
    kind, n = f"(['{"', '".join(KINDS)}'])[{{k}} // {len(SEEDS)} + 1]", len(KINDS) * len(SEEDS)
    tails = f"{BASE}SELECT series_id, quantile_cont(v, 0.05) AS low, quantile_cont(v, 0.95) AS high FROM n WHERE part = 'train' GROUP BY 1"
    drawn = f"""st AS ({tails}), sv0 AS MATERIALIZED (SELECT series_id, '{KINDS[0]}' AS kind, round(low, 6) AS value FROM st UNION ALL SELECT series_id, '{KINDS[1]}', round(high, 6) FROM st WHERE high > low UNION ALL SELECT series_id, kind, value FROM ({REPORT_ORACLES['m17_stuck_values']})),
f AS MATERIALIZED (SELECT m.*, CASE WHEN label = 1 THEN value ELSE v END AS vf FROM m JOIN sv0 ON sv0.series_id = m.series_id // {SETTINGS} AND sv0.kind = {kind.format(k='g')}),"""
    sql = base(epsilon, grid(n, f"(g % {len(SEEDS)})"), length=str(LENGTH))
    begin = sql.index("f AS (SELECT *, CASE WHEN label")
    sql = sql[:begin] + drawn + sql[sql.index("\n", begin) :] + of_private(GATED, num(SHARE), str(LENGTH))
    sql += f""", hn AS (SELECT series_id, {BIN.format(c='v')} AS stuck_bucket, count(*) AS c FROM n0 WHERE part = 'train' GROUP BY 1, 2), an AS (SELECT z.series_id, b AS stuck_bucket, (coalesce(c, 0) + 0.001::DOUBLE) / (total + {num(D * 1e-3)}) AS alpha FROM (SELECT series_id, sum(c) AS total FROM hn GROUP BY 1) z CROSS JOIN range({D}) AS w(b) LEFT JOIN hn ON hn.series_id = z.series_id AND hn.stuck_bucket = b),
pn AS (SELECT series_id, report_bucket, sum(p * alpha) AS p0 FROM an JOIN mx USING (stuck_bucket) GROUP BY 1, 2), sn AS (SELECT series_id, stuck_bucket, 0.5::DOUBLE * sum(abs(p - p0)) AS tv, sum(greatest(p, 1e-12) * ln(greatest(p, 1e-12) / greatest(p0, 1e-12))) AS kl FROM pn JOIN mx USING (report_bucket) GROUP BY 1, 2)
SELECT sv0.series_id, {num(epsilon)} AS epsilon, kind AS stuck_value_type, (rk.series_id % {SETTINGS} % {len(SEEDS)})::INTEGER AS seed, method, auprc, positives / (positives + negatives) AS prevalence, tv AS tv_sep, kl AS kl_sep, CASE WHEN starts_with(kind, 'tail') THEN 'controlled_tail_segment' ELSE 'controlled_central_segment' END AS semantic_layer
FROM rk JOIN sv0 ON sv0.series_id = rk.series_id // {SETTINGS} AND kind = {kind.format(k=f'(rk.series_id % {SETTINGS})')} JOIN sn ON sn.series_id = sv0.series_id AND sn.stuck_bucket = {BIN.format(c='value')}"""
    return f"({recursive(sql)})"


GATE = " UNION ALL ".join(map(gate, STREAM_EPSILONS))
ORACLES: dict[str, str] = {
    "d27_channel_advantage": f"SELECT * REPLACE ({', '.join(r(c, digits=9) for c in MEASURES)}) FROM ({ADVANTAGE})",
    "d27_by_epsilon": f"SELECT epsilon, count(*) AS settings, round(avg(hard_case), 6) + 0 AS weak_bucket_case_fraction, {MEDIANS} FROM ({ADVANTAGE}) GROUP BY 1",
    "j14_flagged_rows": BASE + HITS,
    "b6_boundary_classes": BASE + BOUNDARY,
    "b7_ablation": BASE + ABLATION,
    "b7_operational": BASE + REVIEW,
    "b10_router_rows": BASE + ROUTER + "SELECT * FROM ro",
    "b10_rollup": BASE + ROUTER + "SELECT operator_family, count(*) AS tasks, round(avg(best_auprc), 6) AS mean_best_auprc FROM ro GROUP BY 1",
    "b14_streaks_against_flags": BASE + STREAKS,
    "b14_inventory": BASE + INVENTORY,
    "b14_test_summary": BASE + SUMMARY,
    "b14_streak_events": BASE + EVENTS,
    "p17_layer_triggers": BASE + f"SELECT layer, {TRIGGER} AS semantic_trigger, count(*) AS rows, sum(label)::BIGINT AS faults FROM (SELECT *, {of(LAYERS, 'series_id')} AS layer FROM f) GROUP BY ALL",
    "b12_stress": stress(),
    "b17_gate_runs": f"SELECT * REPLACE ({', '.join(r(c, digits=9) for c in ('auprc', 'prevalence', 'tv_sep', 'kl_sep'))}) FROM ({GATE})",
    "b2_failures": f"SELECT stuck_value_type, epsilon, count(auprc) AS cases, {', '.join(f'round(avg(round({c}, 9)), 6) + 0 AS {c}' for c in ('tv_sep', 'kl_sep', 'auprc', 'prevalence'))} FROM ({GATE}) WHERE method = 'hmm' GROUP BY 1, 2",
    "m1_chronological": BASE + f""", sr AS (SELECT series_id % {STREAMS} AS series_id, x, row_number() OVER (PARTITION BY series_id % {STREAMS} ORDER BY id) - 1 AS t, count(*) OVER (PARTITION BY series_id % {STREAMS}) AS n FROM raw), sp AS (SELECT *, floor(n * 0.6::DOUBLE) AS a, floor(n * 0.2::DOUBLE) AS b FROM sr WHERE n >= {ENOUGH}),
bo AS (SELECT series_id, quantile_cont(x, 0.01) AS low, quantile_cont(x, 0.99) AS high FROM sp WHERE t < a GROUP BY 1), pt AS (SELECT *, CASE WHEN t < a THEN 'train' ELSE 'validation' END AS part FROM sp WHERE t < a + b UNION ALL SELECT *, 'test' FROM sp WHERE CASE WHEN least({TEST}, n - a - b) < {min(200, TEST // 2)} THEN t >= n - {TEST} ELSE t >= a + b AND t < a + b + {TEST} END)
SELECT series_id, t, part, round(greatest(-1::DOUBLE, least(1::DOUBLE, 2.0::DOUBLE * (x - low) / greatest(high - low, 1e-12) - 1.0::DOUBLE)), 6) + 0 AS v FROM pt JOIN bo USING (series_id)""",
    "m7_discretize": BASE + f"SELECT series_id, t, obs, greatest(0, least({D - 1}, ceil((y + {num(shape(TRUE_EPSILON)[1])}) / {num(2 * shape(TRUE_EPSILON)[1] / D)}) - 1))::INTEGER AS \"right\", greatest(0, obs - 1)::INTEGER AS edge, greatest(0, least(23, floor((x - min(x) OVER (PARTITION BY series_id)) / greatest(max(x) OVER (PARTITION BY series_id) - min(x) OVER (PARTITION BY series_id), 1e-12) * 24)))::INTEGER AS raw FROM o",
    "w5_wide_medians": BASE + f""", sr AS (SELECT series_id % {STREAMS} AS series_id, CASE WHEN id % 14 <> 0 THEN x END AS x, row_number() OVER (PARTITION BY series_id % {STREAMS} ORDER BY id) - 1 AS t FROM raw)
SELECT series_id, t, CASE WHEN count(x) OVER w >= {max(3, WIDE // 4)} THEN round(quantile_cont(x, 0.5) OVER w, 6) + 0 END AS median FROM sr WINDOW w AS ({ALONG} {centred(WIDE)})""",
}
