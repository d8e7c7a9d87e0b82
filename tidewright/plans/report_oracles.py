"""The report queries in SQL, for comparison."""

from __future__ import annotations

from functools import cache

import numpy as np

from tidewright.operators.channel import D, shape
from tidewright.plans.report_queries import BLOCK, EPSILONS, LEAST, LENGTH, MODES, SEEDS, SETTINGS, SUBSEQUENCE, SWEEP, TEMPLATE, TOLERANCE
from tidewright.plans.series_oracles import ALONG, BASE, BIN, GLR, MIX, POINT, RUNS, SEP, WINDOWS, Z, base, clip, hmm, num, r, ranking
from tidewright.plans.series_queries import EPSILON, SHARE, STUCK
from tidewright.sources.telemetry import POLICY


@cache
def matrix() -> np.ndarray:
    """The piecewise channel, reports x candidates, by areas of its density."""
    s, c = shape(EPSILON)
    edges, centres = np.linspace(-c, c, D + 1), np.linspace(-1 + 1 / D, 1 - 1 / D, D)
    low = (s * centres - 1) / (s - 1)
    overlap = np.maximum(0, np.minimum(edges[1:, None], low + 2 / (s - 1)) - np.maximum(edges[:-1, None], low))
    mass = s / (s + 1) / (2 / (s - 1)) * overlap + 1 / (s + 1) / (2 * c - 2 / (s - 1)) * (2 * c / D - overlap)
    return mass / mass.sum(axis=0)


INVERSE = ", ".join(f"({c}, {k}, {num(float(np.linalg.pinv(matrix(), rcond=np.finfo(float).eps * D)[c, k]))})" for c in range(D) for k in range(D))
FAMILY = "CASE WHEN contains(method, 'glr') OR contains(method, 'cusum') OR contains(method, 'spike') THEN 'local channel statistic' WHEN contains(method, 'surprise') OR contains(method, 'mixture') THEN 'report distribution' WHEN method IN ('robust_z', 'hampel', 'cusum') THEN 'raw values' ELSE 'other' END"
CASES = f"{RUNS}{SEP}, ca AS (SELECT rr.*, series_id % 5 AS \"case\", CASE WHEN series_id % 2 = 0 THEN 'validation' ELSE 'test' END AS part, positives / (positives + negatives) AS prevalence, tv, kl FROM rr JOIN (SELECT series_id, min(tv) AS tv, min(kl) AS kl FROM se GROUP BY 1) USING (series_id))"
SUITE = f"""{CASES}, mt AS (SELECT "case", method, avg(auroc) AS auroc, avg(auprc) AS auprc, count(auprc) AS cases FROM ca GROUP BY 1, 2 HAVING avg(auprc) IS NOT NULL),
b1 AS (SELECT * FROM mt QUALIFY row_number() OVER (PARTITION BY "case" ORDER BY auprc DESC, method) = 1), b2 AS (SELECT * FROM mt WHERE method IN ('point_glr', 'surprise') QUALIFY row_number() OVER (PARTITION BY "case" ORDER BY auprc DESC, method) = 1),
su AS (SELECT b1."case", b1.method AS recommended_method, b1.auroc AS best_auroc, b1.auprc AS best_auprc, b1.cases, b2.method AS own_method, b2.auroc AS own_auroc, b2.auprc AS own_auprc, b1.auprc - b2.auprc AS gain FROM b1 LEFT JOIN b2 USING ("case")) """


def templates(source: str, x: str, tolerance: float) -> str:
    return f""", tb AS (SELECT *, sum(b) OVER ({ALONG} ROWS UNBOUNDED PRECEDING) AS g FROM (SELECT *, CASE WHEN abs({x} - lag({x}) OVER ({ALONG})) > {num(2 * tolerance)} THEN 1 ELSE 0 END AS b FROM {source})),
tg AS (SELECT series_id, g, min(t) AS b, max(t) + 1 AS e, count(*) AS n, avg({x}) AS level, max({x}) - min({x}) AS rng FROM (SELECT *, max(g) OVER (PARTITION BY series_id) AS last FROM tb) WHERE g < last GROUP BY 1, 2 HAVING count(*) >= {TEMPLATE}),
tf AS (SELECT tg.series_id, tg.b, tg.e, n, level, rng, coalesce(abs(avg(k.{x}) - level), 0) AS delta FROM tg LEFT JOIN {source} k ON k.series_id = tg.series_id AND (k.t BETWEEN tg.b - {TEMPLATE} AND tg.b - 1 OR k.t BETWEEN tg.e AND tg.e + {TEMPLATE - 1}) GROUP BY tg.series_id, tg.b, tg.e, n, level, rng),
ts AS (SELECT *, delta * sqrt(n) / greatest(rng, {num(tolerance)}) AS score, row_number() OVER (PARTITION BY series_id ORDER BY round(delta * sqrt(n) / greatest(rng, {num(tolerance)}), 9) DESC, b) AS rank FROM tf QUALIFY rank <= 24) """


#: Of the faulty series: each series' tolerance, flat pieces of eight rows and more, and their flanks.
MINED = f""", ms AS (SELECT series_id, t, round(vf, 9) AS x FROM f), mo AS (SELECT series_id, greatest(1e-3, coalesce(quantile_cont(step, 0.01) FILTER (step > 1e-12), 1e-3)) AS tol FROM (SELECT series_id, abs(x - lag(x) OVER ({ALONG})) AS step FROM ms) GROUP BY 1),
tb AS (SELECT *, sum(b) OVER ({ALONG} ROWS UNBOUNDED PRECEDING) AS g FROM (SELECT ms.*, tol, CASE WHEN abs(x - lag(x) OVER ({ALONG})) > 2 * tol THEN 1 ELSE 0 END AS b FROM ms JOIN mo USING (series_id))),
tg AS (SELECT series_id, g, min(t) AS b, max(t) + 1 AS e, count(*) AS n, avg(x) AS level, max(x) - min(x) AS rng, max(tol) AS tol FROM (SELECT *, max(g) OVER (PARTITION BY series_id) AS last FROM tb) WHERE g < last GROUP BY 1, 2 HAVING count(*) >= 8),
tf AS (SELECT tg.series_id, tg.b, tg.e, n, level, rng, tol, coalesce(abs(avg(k.x) - level), 0) AS delta FROM tg LEFT JOIN ms k ON k.series_id = tg.series_id AND (k.t BETWEEN tg.b - 8 AND tg.b - 1 OR k.t BETWEEN tg.e AND tg.e + 7) GROUP BY tg.series_id, tg.b, tg.e, n, level, rng, tol),
ts AS (SELECT *, delta * sqrt(n) / greatest(rng, tol) AS score, row_number() OVER (PARTITION BY series_id ORDER BY round(delta * sqrt(n) / greatest(rng, tol), 9) DESC, b) AS rank FROM tf QUALIFY rank <= 24) """
BLOCKS = f", fb AS (SELECT *, t // {BLOCK} AS blk FROM f)"
FAULTS = ", fr AS (SELECT series_id, min(t) AS b, count(*) AS n FROM (SELECT series_id, t, t - row_number() OVER (PARTITION BY series_id ORDER BY t) AS g FROM f WHERE label = 1) GROUP BY series_id, g)"
POOL = ", ".join(f"round(avg(label) FILTER (place <= greatest(1, round(n * {s}::DOUBLE))), 6) + 0 AS precision_{k}, round(sum(label) FILTER (place <= greatest(1, round(n * {s}::DOUBLE))) / nullif(sum(label), 0), 6) + 0 AS recall_{k}, round(avg(label) FILTER (place <= greatest(1, round(n * {s}::DOUBLE))) / nullif(avg(label), 0), 6) + 0 AS lift_{k}" for s, k in (("0.01", "1pct"), ("0.05", "5pct")))
POSTERIOR = "((report_bucket * 17 + device_id) % 100) / 100.0::DOUBLE"
OPERATOR = f"CASE WHEN {POSTERIOR} >= 0.80::DOUBLE THEN 'stuck_hmm' WHEN {POSTERIOR} >= 0.65::DOUBLE THEN 'window_glr' ELSE 'stuck_mixture' END"

POLICIES = ", ".join(map(str, POLICY))



def grid(n: int, seed: str) -> str:
    return f", n AS (SELECT series_id * {SETTINGS} + g AS series_id, t, id + {seed} * 1000003 AS id, x, part, k, v, g FROM n0 CROSS JOIN range({n}) AS q(g))"


def pick(i: int, kind: str) -> str:
    """A setting's value, by the number of the setting in a series' key."""
    return f"(([{', '.join(repr(x[i]) for x in SWEEP)}])[series_id % {SETTINGS} + 1])::{kind}"


def of_private(methods: tuple[str, ...], rate: str, length: str) -> str:
    """Scores of methods and their areas (rk); rate and length: what the posterior model expects of a series."""
    p11 = f"greatest(0.5::DOUBLE, 1 - 1 / greatest(({length})::DOUBLE, 2::DOUBLE))"
    chances = f"SELECT *, least(0.2::DOUBLE, greatest(1e-4::DOUBLE, rho * (1 - p11) / greatest(1 - rho, 1e-6))) AS p01 FROM (SELECT DISTINCT series_id, ({rate})::DOUBLE AS rho, {p11} AS p11 FROM p0)"
    model = hmm("SELECT a.series_id, a.t, c.stuck_bucket AS candidate, greatest(b.p0, 1e-12) AS e0, greatest(c.p, 1e-12) AS e1, rho, p01, p11 FROM o a JOIN p0 b ON b.series_id = a.series_id AND b.report_bucket = a.obs JOIN mx c ON c.report_bucket = a.obs JOIN hc ON hc.series_id = a.series_id", "rho", "p01", "p11")
    found = {
        "robust_z": (Z.format(v="vf", t="f"), "SELECT series_id, t, score FROM rz"),
        "surprise": ("", "SELECT o.series_id, t, -ln(greatest(p0, 1e-15)) AS score FROM o JOIN p0 ON p0.series_id = o.series_id AND p0.report_bucket = o.obs"),
        "point_glr": (POINT, "SELECT series_id, t, score FROM o JOIN pg USING (series_id, obs)"),
        "window_glr": (GLR, WINDOWS),
        "mixture": (MIX, "SELECT o.series_id, t, rate * p / greatest(rate * p + (1 - rate) * p0, 1e-15) AS score FROM o JOIN p0 ON p0.series_id = o.series_id AND p0.report_bucket = o.obs JOIN fit ON fit.series_id = o.series_id JOIN mx ON mx.stuck_bucket = fit.candidate AND mx.report_bucket = o.obs"),
        "hmm": (f", hc AS ({chances})" + model, "SELECT series_id, t, score FROM ps JOIN lk USING (series_id, candidate)"),
    }
    scores = " UNION ALL ".join(f"SELECT z.series_id, z.t, label, round(score, 6) AS score, '{m}' AS method FROM ({found[m][1]}) z JOIN f USING (series_id, t)" for m in methods)
    return "".join(found[m][0] for m in methods) + f", sc AS ({scores}), rk AS ({ranking('sc', 'series_id, method')}) "


#: Of the panel's keyed series: a template drawn for each, and its faults.
DRAWN = f"""tp AS MATERIALIZED ({BASE}{MINED} SELECT series_id, n, level, rank, count(*) OVER (PARTITION BY series_id) AS c FROM ts),
tc AS (SELECT series_id * {SETTINGS} + k AS series_id, n, level FROM tp CROSS JOIN range({len(SEEDS) * len(MODES)}) AS q(k) WHERE rank = ((series_id * {SETTINGS} + k) * 7919 + 12345) % 1000003 % c + 1),
tw AS (SELECT z.series_id, size, coalesce(greatest(8, least(greatest(8, least(96, size // 3)), tc.n)), {LENGTH}) AS length, CASE WHEN level IS NULL THEN high ELSE {clip('level')} END AS level FROM (SELECT series_id, count(*) AS size, quantile_cont(v, 0.95) AS high FROM n GROUP BY 1) z LEFT JOIN tc USING (series_id)),
tl AS (SELECT n.*, level, (row_number() OVER (PARTITION BY n.series_id ORDER BY ((t // length) * 7919 + n.series_id * 104729) % 1000003, t // length, t) <= greatest(1, round(size * {num(SHARE)})))::INTEGER AS label FROM n JOIN tw USING (series_id)),
f AS MATERIALIZED (SELECT series_id, t, id, x, part, k, v, label, CASE WHEN label = 1 THEN {num(STUCK)} ELSE v END AS vf FROM im WHERE g % {len(MODES)} = 0 UNION ALL SELECT series_id, t, id, x, part, k, v, label, CASE WHEN label = 1 THEN CASE WHEN g % {len(MODES)} = 1 THEN {num(STUCK)} ELSE {clip('v + 0.35::DOUBLE')} END ELSE v END FROM m WHERE g % {len(MODES)} IN (1, 3)
  UNION ALL SELECT series_id, t, id, x, part, k, v, label, CASE WHEN label = 1 THEN level ELSE v END FROM tl WHERE g % {len(MODES)} = 2),"""
METHODS = ("robust_z", "surprise", "point_glr", "window_glr", "mixture", "hmm")


def recursive(sql: str) -> str:
    return sql.replace("WITH", "WITH RECURSIVE", 1)


def panel(epsilon: float) -> str:
    sql = base(epsilon, grid(len(SEEDS) * len(MODES), f"(g // {len(MODES)})"), length=str(LENGTH))
    begin = sql.index("f AS (SELECT *, CASE WHEN label")
    sql = sql[:begin] + DRAWN + sql[sql.index("\n", begin) :] + of_private(METHODS, num(SHARE), str(LENGTH))
    modes = " ".join(f"WHEN {k} THEN '{m}'" for k, m in enumerate(MODES))
    return f"({recursive(sql)} SELECT series_id // {SETTINGS} AS series_id, {num(epsilon)} AS epsilon, (series_id % {SETTINGS} // {len(MODES)})::INTEGER AS seed, CASE series_id % {SETTINGS} % {len(MODES)} {modes} END AS mode, method, round(auroc, 6) + 0 AS auroc, round(auprc, 6) + 0 AS auprc FROM rk)"


PANEL = " UNION ALL ".join(map(panel, EPSILONS))
LAYERS = f"""WITH pn AS ({PANEL}), mt AS (SELECT mode, epsilon, method, avg(auroc) AS auroc, avg(auprc) AS auprc, count(auprc) AS cases FROM pn GROUP BY 1, 2, 3 HAVING avg(auprc) IS NOT NULL),
b1 AS (SELECT * FROM mt QUALIFY row_number() OVER (PARTITION BY mode, epsilon ORDER BY auprc DESC, method) = 1), b2 AS (SELECT * FROM mt WHERE method IN ('point_glr', 'surprise') QUALIFY row_number() OVER (PARTITION BY mode, epsilon ORDER BY auprc DESC, method) = 1)
SELECT mode, epsilon, b1.method AS recommended_method, {FAMILY.replace('method', 'b1.method')} AS recommended_family, round(b1.auroc, 9) AS best_auroc, round(b1.auprc, 9) AS best_auprc, b1.cases, b2.method AS own_method, round(b2.auroc, 9) AS own_auroc, round(b2.auprc, 9) AS own_auprc, round(b1.auprc - b2.auprc, 9) + 0 AS gain, CASE WHEN b2.auprc >= b1.auprc - 0.02::DOUBLE THEN b2.method ELSE b1.method END AS router_choice FROM b1 LEFT JOIN b2 USING (mode, epsilon)"""
SWEPT = recursive(base(EPSILONS[0], grid(len(SWEEP), f"({pick(2, 'BIGINT').replace(f'series_id % {SETTINGS}', 'g')})"), share=pick(3, "DOUBLE"), length=f"({pick(4, 'BIGINT')})") + of_private(("window_glr", "hmm", "surprise"), pick(3, "DOUBLE"), pick(4, "DOUBLE")))
SWEPT += f"SELECT {pick(0, 'VARCHAR')} AS axis, {pick(1, 'DOUBLE')} AS axis_value, {pick(2, 'INTEGER')} AS seed, method, count(auprc) AS runs, round(avg(auroc), 6) + 0 AS auroc, round(avg(auprc), 6) + 0 AS auprc FROM rk GROUP BY ALL"

ORACLES: dict[str, str] = {key: BASE + sql for key, sql in {
    "a17_mode": "SELECT series_id, obs AS mode, n FROM (SELECT series_id, obs, count(*) AS n FROM o GROUP BY 1, 2) QUALIFY row_number() OVER (PARTITION BY series_id ORDER BY n DESC, obs) = 1",
    "a23_case_means": CASES + 'SELECT method, count(*) AS cases, round(avg(m), 9) AS case_mean, round(sum(s) / sum(w), 9) AS row_mean FROM (SELECT method, "case", avg(auprc) AS m, sum(auprc * positives) AS s, sum(positives) AS w FROM ca WHERE auprc IS NOT NULL GROUP BY 1, 2) GROUP BY 1',
    "a27_pooled": f', sq AS (SELECT o.series_id, o.series_id % 5 AS "case", t, label, round(-ln(greatest(p0, 1e-15)), 6) AS score FROM o JOIN p0 ON p0.series_id = o.series_id AND p0.report_bucket = o.obs) SELECT "case", count(*) AS rows, sum(label)::BIGINT AS positives, round(avg(label), 6) AS prevalence, {POOL} FROM (SELECT *, count(*) OVER (PARTITION BY "case") AS n, row_number() OVER (PARTITION BY "case" ORDER BY score DESC, t DESC, series_id) AS place FROM sq) GROUP BY 1',
    "a30_accounting": CASES + "SELECT v.b AS bucket, count(x.b) AS count, round(avg(auprc), 9) AS mean_score, round(avg(lift), 9) AS mean_lift FROM (VALUES ('accepted-good'), ('accepted-bad'), ('rejected-good'), ('rejected-bad')) v(b) LEFT JOIN (SELECT CASE WHEN tv >= 0.10::DOUBLE AND kl >= 0.03::DOUBLE THEN 'accepted' ELSE 'rejected' END || '-' || CASE WHEN auprc / prevalence >= 1 THEN 'good' ELSE 'bad' END AS b, auprc, auprc / prevalence AS lift FROM ca WHERE auprc IS NOT NULL) x ON x.b = v.b GROUP BY 1",
    "b3_suite": SUITE + f"SELECT * REPLACE ({', '.join(f'round({c}, 9) + 0 AS {c}' for c in ('best_auroc', 'best_auprc', 'own_auroc', 'own_auprc', 'gain'))}), {FAMILY.replace('method', 'recommended_method')} AS recommended_family FROM su",
    "b5_router_policy": f"SELECT p.*, coalesce(n, 0) AS cleaned, round(a, 6) AS posterior FROM (VALUES {POLICIES}) p(operator, semantic_layer, output_relation, privacy_effect) LEFT JOIN (SELECT {OPERATOR} AS operator, count(*) AS n, avg({POSTERIOR}) AS a FROM r GROUP BY 1) USING (operator)",
    "b6_boundary": SUITE + "SELECT CASE WHEN own_method IS NULL THEN 'no_own_method' WHEN own_method = recommended_method THEN 'compatible' ELSE 'router_boundary' END AS boundary_class, count(*) AS groups, round(avg(gain), 9) + 0 AS mean_gap, round(max(gain), 9) + 0 AS largest_gap FROM su GROUP BY 1",
    "b7_router_ledger": CASES + """, rm AS (SELECT "case", method, avg(auprc) FILTER (part = 'validation') AS validation, avg(auroc) FILTER (part = 'test') AS test_auroc, avg(auprc) FILTER (part = 'test') AS test_auprc FROM ca GROUP BY 1, 2),
al2 AS (SELECT "case", string_agg(method, ',' ORDER BY method) AS allowed_methods FROM rm GROUP BY 1), ch AS (SELECT * FROM rm WHERE validation IS NOT NULL QUALIFY row_number() OVER (PARTITION BY "case" ORDER BY validation DESC, method) = 1), oc AS (SELECT * FROM rm WHERE test_auprc IS NOT NULL QUALIFY row_number() OVER (PARTITION BY "case" ORDER BY test_auprc DESC, method) = 1)
SELECT "case", allowed_methods, ch.method AS selected_method, round(ch.validation, 9) AS validation, round(ch.test_auroc, 9) AS test_auroc, round(ch.test_auprc, 9) AS test_auprc, oc.method AS best_method, round(oc.test_auprc, 9) AS best_auprc, round(oc.test_auprc - ch.test_auprc, 9) + 0 AS regret FROM al2 JOIN ch USING ("case") LEFT JOIN oc USING ("case")""",
    "d26_subsequences": f""", sg AS (SELECT series_id, part, t, list(x) OVER (PARTITION BY series_id, part ORDER BY t ROWS BETWEEN {SUBSEQUENCE - 1} PRECEDING AND CURRENT ROW) AS l FROM raw WHERE part <> 'validation'),
sp AS (SELECT series_id, part, t, list_concat(list_transform(range({SUBSEQUENCE} - len(l)), lambda i: l[1]), l) AS s FROM sg), sz AS (SELECT series_id, part, t, unnest(range({SUBSEQUENCE})) AS i, unnest(list_transform(s, lambda v: (v - list_avg(s)) / greatest(list_stddev_pop(s), 1e-6))) AS z FROM sp),
sd AS (SELECT series_id, i, CASE WHEN stddev_pop(z) > 1e-12 THEN stddev_pop(z) ELSE 1 END AS d FROM sz WHERE part = 'train' GROUP BY 1, 2),
sn AS (SELECT a.series_id, a.t, b.t AS u, sqrt(sum(((a.z - b.z) / d) ** 2)) AS away FROM sz a JOIN sz b ON b.series_id = a.series_id AND b.i = a.i AND b.part = 'train' JOIN sd ON sd.series_id = a.series_id AND sd.i = a.i WHERE a.part = 'test' GROUP BY 1, 2, 3)
SELECT series_id, t, round(avg(away), 6) AS score FROM (SELECT * FROM sn QUALIFY row_number() OVER (PARTITION BY series_id, t ORDER BY away) <= 5) GROUP BY 1, 2""",
    "f4_templates": MINED + f'SELECT series_id, b AS "begin", e AS "end", n, {r("level")}, {r("rng", "range")}, {r("delta", "flank_delta")}, {r("score")}, rank::INTEGER AS rank FROM ts',
    "f4_template_faults": MINED + f""", tn AS (SELECT series_id, ((series_id * 7919 + 12345) % 1000003) % count(*) + 1 AS rank FROM ts GROUP BY 1), tc AS (SELECT ts.series_id, n, level FROM ts JOIN tn USING (series_id, rank)),
tw AS (SELECT z.series_id, size, coalesce(greatest(8, least(greatest(8, least(96, size // 3)), tc.n)), 48) AS length, CASE WHEN level IS NULL THEN high ELSE {clip('level')} END AS level FROM (SELECT series_id, count(*) AS size, quantile_cont(v, 0.95) AS high FROM n GROUP BY 1) z LEFT JOIN tc USING (series_id)),
tl AS (SELECT n.*, level, (row_number() OVER (PARTITION BY n.series_id ORDER BY ((t // length) * 7919 + n.series_id * 104729) % 1000003, t // length, t) <= greatest(1, round(size * {num(SHARE)})))::INTEGER AS label FROM n JOIN tw USING (series_id)) SELECT series_id, t, label, round(CASE WHEN label = 1 THEN level ELSE v END, 6) + 0 AS vf FROM tl""",
    "j15_products": f"SELECT a.series_id, count(*) AS n, count(b.x) AS available, {r('avg(abs(a.x - b.x))', 'difference')} FROM raw a LEFT JOIN raw b ON b.series_id = a.series_id AND b.t = a.t AND b.id % 3 <> 0 GROUP BY 1",
    "j17_prior_rows": BLOCKS + f"SELECT series_id, blk::BIGINT AS block, count(*) AS n, {r('avg(v)', 'mean')} FROM (SELECT a.series_id, a.blk, b.v, row_number() OVER (PARTITION BY a.series_id, a.blk ORDER BY b.t DESC) AS k FROM (SELECT DISTINCT series_id, blk FROM fb) a JOIN fb b ON b.series_id = a.series_id AND b.blk < a.blk AND b.label = 0) WHERE k <= 12 GROUP BY 1, 2",
    "j19_runs_with_shape": RUNS + templates("raw", "x", TOLERANCE) + "SELECT rr.series_id, method, auprc, flatlines FROM rr LEFT JOIN (SELECT series_id, count(*) AS flatlines FROM tg GROUP BY 1) USING (series_id)",
    "j21_matched_negatives": FAULTS + f""", wl AS (SELECT DISTINCT series_id, n AS length FROM fr), ws AS (SELECT a.series_id, length, a.t, max(b.v) - min(b.v) AS rng FROM f a JOIN wl USING (series_id) JOIN f b ON b.series_id = a.series_id AND b.t BETWEEN a.t AND a.t + length - 1 GROUP BY 1, 2, 3 HAVING count(*) = length AND sum(b.label) = 0),
wg AS (SELECT *, count(*) FILTER (rng > {num(2 / D)}) OVER (PARTITION BY series_id, length) AS good FROM ws), wp AS (SELECT series_id, length, t, row_number() OVER (PARTITION BY series_id, length ORDER BY (t * 7919 + series_id * 104729) % 1000003, t) - 1 AS negative FROM wg WHERE rng > {num(2 / D)} OR good < 5)
SELECT fr.series_id, fr.b AS "begin", fr.n, negative::INTEGER AS negative, wp.t AS start FROM fr JOIN wp ON wp.series_id = fr.series_id AND wp.length = fr.n WHERE negative < 5""",
    "m12_estimated_alpha": f", iv(stuck_bucket, obs, w) AS (VALUES {INVERSE}), eq AS (SELECT series_id, obs, count(*) / sum(count(*)) OVER (PARTITION BY series_id) AS q FROM o GROUP BY 1, 2), ea AS (SELECT series_id, stuck_bucket, greatest(sum(w * q), 1e-9) AS a FROM eq JOIN iv USING (obs) GROUP BY 1, 2) SELECT series_id, stuck_bucket::INTEGER AS stuck_bucket, round(a / sum(a) OVER (PARTITION BY series_id), 6) + 0 AS alpha FROM ea",
    "m16_distances": f"SELECT series_id, stuck_bucket, {r('sum(abs(greatest(p, 1e-12) - greatest(p0, 1e-12)))', 'l1')}, {r('sqrt(sum((greatest(p, 1e-12) - greatest(p0, 1e-12)) ** 2))', 'l2')}, {r('-ln(sum(sqrt(greatest(p, 1e-12) * greatest(p0, 1e-12))))', 'chernoff')} FROM p0 JOIN mx USING (report_bucket) GROUP BY 1, 2",
    "m16_channel_quality": f"SELECT series_id, {r('(SELECT min(tv) FROM (SELECT 0.5::DOUBLE * sum(abs(a.p - b.p)) AS tv FROM mx a JOIN mx b ON b.stuck_bucket = a.stuck_bucket + 1 AND b.report_bucket = a.report_bucket GROUP BY a.stuck_bucket))', 'adjacent_tv')}, {r('-sum(alpha * log2(greatest(alpha, 1e-12)))', 'entropy_bits')}, {num(round(float(np.linalg.cond(matrix())), 6))} AS condition_number FROM al GROUP BY 1",
    "m17_stuck_values": f"""{SEP}, sv AS (SELECT series_id, 'median' AS kind, md AS value, {BIN.format(c='md')} AS bucket FROM (SELECT series_id, quantile_cont(v, 0.5) AS md FROM n WHERE part = 'train' GROUP BY 1)
UNION ALL SELECT series_id, 'mode_bucket', {num(-1 + 1 / D)} + {num(2 / D)} * stuck_bucket, stuck_bucket FROM (SELECT * FROM al QUALIFY row_number() OVER (PARTITION BY series_id ORDER BY round(alpha, 12) DESC, stuck_bucket) = 1)
UNION ALL SELECT series_id, 'min_tv_column', {num(-1 + 1 / D)} + {num(2 / D)} * stuck_bucket, stuck_bucket FROM (SELECT * FROM se QUALIFY row_number() OVER (PARTITION BY series_id ORDER BY round(tv, 12), stuck_bucket) = 1)) SELECT series_id, kind, round({clip('value')}, 6) + 0 AS value, bucket::INTEGER AS bucket FROM sv""",
    "m18_device_grid": f"SELECT epsilon, a.minutes, budget, count(DISTINCT device_id) AS devices, count(*) AS reports, {r('1440::DOUBLE / minutes', 'reports_per_day')}, {r('epsilon * (1440::DOUBLE / minutes)', 'epsilon_per_day')}, {r('epsilon * (1440::DOUBLE / minutes) * 30', 'epsilon_per_30_days')}, {r('epsilon * (1440::DOUBLE / minutes) * 365', 'epsilon_per_year')}, floor(budget / epsilon)::BIGINT AS max_reports, {r('floor(budget / epsilon) / (1440::DOUBLE / minutes)', 'days')} FROM r, (VALUES (10), (60), (1440)) a(minutes), (VALUES (1::DOUBLE), (10::DOUBLE)) b(budget) GROUP BY epsilon, a.minutes, budget",
    "o4_top_blocks": BLOCKS + "SELECT series_id, blk::BIGINT AS block, positives::BIGINT AS positives, row_number() OVER (PARTITION BY series_id ORDER BY blk)::INTEGER AS place FROM (SELECT series_id, blk, sum(label) AS positives FROM fb GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY series_id ORDER BY sum(label) DESC, blk) <= 2)",
    "o5_top_and_forced": "SELECT series_id, positives::BIGINT AS positives FROM (SELECT series_id, sum(label) AS positives FROM f GROUP BY 1) QUALIFY row_number() OVER (ORDER BY positives DESC, series_id) <= 3 OR series_id IN (1, 2)",
    "o6_ordered_parts": f"SELECT part, count(*) AS n, {r('avg(v)', 'mean')}, CASE part WHEN 'train' THEN 0 WHEN 'validation' THEN 1 ELSE 2 END AS place FROM n GROUP BY 1",
    "p14_quality_flags": f"SELECT series_id, count(*) FILTER (qf = 1) AS good, count(*) FILTER (qf = 5) AS stuck, count(*) FILTER (qf = 8) AS missing, {r('avg(CASE WHEN qf = 5 THEN vf ELSE v END)', 'usable_mean')}, {r('avg(v) FILTER (qf = 1)', 'good_mean')} FROM (SELECT *, CASE WHEN id % 11 = 0 THEN 8 WHEN label = 1 THEN 5 ELSE 1 END AS qf FROM f) GROUP BY 1",
    "p17_method_profile": RUNS + f"SELECT method, count(*) AS runs, CASE WHEN raw THEN 'raw_upper_bound' ELSE 'pm_ldp_reports' END AS access_regime, raw AS uses_raw_values, NOT raw AS uses_pm_reports, starts_with(name, 'ldp_') AS uses_pm_channel, regexp_matches(name, 'hmm|cusum|bocpd|rolling|window') AS uses_temporal_model, name = 'ldp_window_glr' AS diagnostic_outputs, NOT raw AS privacy_comparable, {FAMILY} AS family FROM (SELECT method, method NOT IN ('surprise', 'point_glr') AS raw, CASE WHEN method IN ('surprise', 'point_glr') THEN 'ldp_' ELSE '' END || method AS name FROM rr) GROUP BY ALL",
    "p18_eligible": f"SELECT series_id, sum(label)::BIGINT AS positives, sum(1 - label)::BIGINT AS negatives, {r('avg(label)', 'rate')} FROM f GROUP BY 1 HAVING sum(label) >= 5 AND sum(1 - label) >= 20 AND sum(label) / count(*) <= 0.2::DOUBLE",
    "p19_calibration_source": BLOCKS + f""", pb AS (SELECT series_id, blk, count(*) FILTER (label = 0) AS c, sum(v) FILTER (label = 0) AS cs, count(*) AS a, sum(v) AS s FROM fb GROUP BY 1, 2), pc AS (SELECT x.*, coalesce(y.c, 0) AS pn, y.cs AS ps FROM pb x LEFT JOIN pb y ON y.series_id = x.series_id AND y.blk = x.blk - 1)
SELECT series_id, blk::BIGINT AS block, CASE WHEN pn >= {LEAST} THEN 'previous' WHEN c >= {LEAST} THEN 'same' ELSE 'all' END AS source, CASE WHEN pn >= {LEAST} THEN pn WHEN c >= {LEAST} THEN c ELSE a END AS n, round(CASE WHEN pn >= {LEAST} THEN ps / pn WHEN c >= {LEAST} THEN cs / c ELSE s / a END, 6) + 0 AS mean FROM pc""",
    "p20_alignment": f", xa AS (SELECT series_id, x, row_number() OVER ({ALONG}) AS k FROM raw WHERE id % 7 <> 0), ya AS (SELECT series_id, label AS y, row_number() OVER ({ALONG}) AS k FROM f WHERE id % 5 <> 0) SELECT series_id, count(*) AS n, {r('avg(x)', 'mean')}, sum(y)::BIGINT AS positives FROM xa JOIN ya USING (series_id, k) GROUP BY 1",
    "p21_block_choice": BLOCKS + ", pb AS (SELECT series_id, blk, sum(label) AS positives, coalesce(sum(sum(1 - label)) OVER (PARTITION BY series_id ORDER BY blk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS earlier FROM fb GROUP BY 1, 2) SELECT series_id, blk::BIGINT AS block, positives::BIGINT AS positives, earlier::BIGINT AS earlier FROM pb WHERE positives >= 1 AND earlier >= 20",
    "u4_set_checks": f"SELECT count(*) FILTER (a.k IS NOT NULL AND b.k IS NOT NULL) AS both, count(*) FILTER (b.k IS NULL) AS left_only, count(*) FILTER (a.k IS NULL) AS right_only, count(*) FILTER (b.k IS NULL) = 0 AS subset FROM (SELECT DISTINCT report_id AS k FROM r WHERE {POSTERIOR} >= 0.80::DOUBLE) a FULL JOIN (SELECT DISTINCT report_id AS k FROM r WHERE report_id % 2 = 0) b USING (k)",
}.items()} | {
    "b4_layers": LAYERS,
    "b12_sweep": SWEPT,
    "b16_panel": PANEL,
    "p16_relevance": r"SELECT lang, CASE WHEN regexp_matches(coalesce(text, ''), '(?i)\b(constant|flat|stuck|persist|zero values|too much zero|give 0degc|same value)\b') THEN 'explicit_repeated_value_or_zero' WHEN regexp_matches(coalesce(text, ''), '(?i)\b(not working|malfunction|sensor drift|suspicious|bad data|disfunctional|failure|failed)\b') THEN 'sensor_failure_or_suspicious' ELSE 'other_manual_flag' END AS relevance, count(*) AS n FROM documents GROUP BY 1, 2",
}
