"""The series queries in SQL, for comparison."""

from __future__ import annotations

from math import exp

from tidewright.operators.channel import DRAWS, D, shape
from tidewright.plans.series_queries import EPSILON, SEGMENT, SHARE, STUCK
from tidewright.plans.telemetry_oracles import REPORTS

S, C = shape(EPSILON)


def num(x: float) -> str:
    return f"({x!r})::DOUBLE"


def uniform(k: int) -> str:
    mixed = f"(((id % 2147483648) * {DRAWS[k]} + {k * 12345}) % 2147483648)"
    return f"(({mixed} * 16807 + {mixed} // 8192) % 2147483648) / {num(2147483648.0)}"


def clip(x: str, low: str = "-1", high: str = "1") -> str:
    return f"greatest({low}::DOUBLE, least({high}::DOUBLE, {x}))"


def normalized(name: str, how: str = "robust", where: str = "part = 'train'") -> str:
    """v counts to 12 digits; else a percentile's last bit would say in which bucket a value on an edge is."""
    low, high = ("quantile_cont(x, 0.01)", "quantile_cont(x, 0.99)") if how == "robust" else ("min(x)", "max(x)")
    return f"""{name}_b AS (SELECT series_id, {low} FILTER ({where}) AS low, {high} FILTER ({where}) AS high FROM raw GROUP BY 1),
{name} AS (SELECT raw.*, CASE WHEN high - low > 0 THEN round({clip("(x - low) / (high - low) * 2.0::DOUBLE - 1.0::DOUBLE")}, 12) + 0 ELSE 0 END AS v FROM raw JOIN {name}_b USING (series_id))"""


def injected(mode: str) -> str:
    """vf on rows i (label by the scatter of ids)."""
    faulty = {
        "iid_stuck": num(STUCK), "bias": "v + 0.35::DOUBLE", "spike": "v + CASE WHEN id % 2 = 0 THEN 0.85 ELSE -0.85 END::DOUBLE", "dropout": "NULL",
        "drift": "v + 0.45::DOUBLE * (sum(label) OVER (PARTITION BY series_id ORDER BY t ROWS UNBOUNDED PRECEDING) - 1) / greatest(sum(label) OVER (PARTITION BY series_id) - 1, 1)",
        "scale": "med + 1.7::DOUBLE * (v - med)",
    }[mode]
    source = "im JOIN (SELECT series_id, quantile_cont(v, 0.5) AS med FROM n GROUP BY 1) USING (series_id)" if mode == "scale" else "im"
    return f"j AS (SELECT series_id, t, id, label, CASE WHEN label = 1 THEN {'NULL' if mode == 'dropout' else clip(faulty)} ELSE v END AS vf FROM {source})"


def base(epsilon: float = EPSILON, grid: str = "", faulty: str = num(STUCK), share: str = num(SHARE), length: str = str(SEGMENT)) -> str:
    """The series, their faults, reports and channel; grid: a CTE n made of n0, the normalised series."""
    s, c = shape(epsilon)
    width, step = 2 / (s - 1), 2 * c / D
    low_y, high_y = f"({num(s)} * vf - 1.0::DOUBLE) / {num(s - 1)}", f"({num(s)} * vf + 1.0::DOUBLE) / {num(s - 1)}"
    return f"""WITH {REPORTS},
s AS (SELECT device_id AS series_id, row_number() OVER (PARTITION BY device_id ORDER BY r.ts, report_id) - 1 AS t, report_id AS id, e.value AS x FROM r JOIN events e ON e.event_id = r.report_id),
raw AS (SELECT *, CASE WHEN t::DOUBLE / k < 0.6::DOUBLE THEN 'train' WHEN t::DOUBLE / k < 0.8::DOUBLE THEN 'validation' ELSE 'test' END AS part, k FROM (SELECT *, count(*) OVER (PARTITION BY series_id) AS k FROM s)),
{normalized("n" if not grid else "n0")}{grid},
m AS (SELECT *, (row_number() OVER (PARTITION BY series_id ORDER BY ((t // {length}) * 7919 + series_id * 104729) % 1000003, t // {length}, t) <= floor(k * {share}))::INTEGER AS label FROM n),
im AS (SELECT *, (row_number() OVER (PARTITION BY series_id ORDER BY (id * 7919) % 1000003, id) <= floor(k * {num(SHARE)}))::INTEGER AS label FROM n),
f AS (SELECT *, CASE WHEN label = 1 THEN {clip(faulty)} ELSE v END AS vf FROM m),
u AS (SELECT *, {uniform(1)} AS u, {uniform(2)} AS w, {low_y} AS lo, {high_y} AS hi FROM f),
y AS (SELECT *, CASE WHEN u < {num(s / (s + 1))} THEN lo + w * (hi - lo) WHEN w * (lo + {num(c)} + {num(c)} - hi) < lo + {num(c)} THEN {num(-c)} + w * (lo + {num(c)} + {num(c)} - hi) ELSE hi + (w * (lo + {num(c)} + {num(c)} - hi) - (lo + {num(c)})) END AS y FROM u),
o AS (SELECT *, greatest(0, least({D - 1}, floor((y + {num(c)}) / {num(2 * c / D)})))::INTEGER AS obs FROM y),
g AS (SELECT a AS stuck_bucket, b AS report_bucket, ({num(s)} * ({num(-1 + 1 / D)} + {num(2 / D)} * a) - 1.0::DOUBLE) / {num(s - 1)} AS lo, {num(-c)} + b * {num(step)} AS e FROM range({D}) AS p(a), range({D}) AS q(b)),
gm AS (SELECT *, greatest(0::DOUBLE, least(e + {num(step)}, lo + {num(width)}) - greatest(e, lo)) AS ov FROM g),
mx AS (SELECT stuck_bucket::INTEGER AS stuck_bucket, report_bucket::INTEGER AS report_bucket, mass / sum(mass) OVER (PARTITION BY stuck_bucket) AS p FROM (SELECT *, {num(s / (s + 1) / width)} * ov + {num(1 / (s + 1) / (2 * c - width))} * ({num(step)} - ov) AS mass FROM gm)),
h AS (SELECT series_id, greatest(0, least({D - 1}, floor((v + 1.0::DOUBLE) * {num(D / 2)})))::INTEGER AS stuck_bucket, count(*) AS c FROM n WHERE part = 'train' GROUP BY 1, 2),
al AS (SELECT z.series_id, a::INTEGER AS stuck_bucket, (coalesce(c, 0) + 0.001::DOUBLE) / (total + {num(D * 1e-3)}) AS alpha FROM (SELECT series_id, sum(c) AS total FROM h GROUP BY 1) z CROSS JOIN range({D}) AS b(a) LEFT JOIN h ON h.series_id = z.series_id AND h.stuck_bucket = a),
p0 AS (SELECT series_id, report_bucket, sum(p * alpha) AS p0 FROM al JOIN mx USING (stuck_bucket) GROUP BY 1, 2),
rt AS (SELECT series_id, mx.report_bucket AS obs, stuck_bucket AS candidate, ln(greatest(p, 1e-15)) - ln(greatest(p0, 1e-15)) AS llr FROM p0 JOIN mx USING (report_bucket))
"""


BASE = base()


def r(x: str, name: str | None = None, digits: int = 6) -> str:
    return f"round({x}, {digits}) + 0 AS {name or x}"


def centred(w: int) -> str:
    return f"ROWS BETWEEN {w // 2} PRECEDING AND {(w - 1) // 2} FOLLOWING"


ALONG = "PARTITION BY series_id ORDER BY t"


def mad(source: str, v: str, w: int = 9, name: str = "q") -> str:
    """Rolling median and median distance; edges take the nearest."""
    least = max(3, w // 4)

    def near(c: str) -> str:
        return f"coalesce({c}, first_value({c} IGNORE NULLS) OVER ({ALONG} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), last_value({c} IGNORE NULLS) OVER ({ALONG} ROWS UNBOUNDED PRECEDING))"

    def roll(x: str) -> str:
        return f"CASE WHEN count({x}) OVER ({ALONG} {centred(w)}) >= {least} THEN quantile_cont({x}, 0.5) OVER ({ALONG} {centred(w)}) END"

    return f""", {name}1 AS (SELECT *, {roll(v)} AS md0 FROM {source}), {name}2 AS (SELECT *, {near("md0")} AS md FROM {name}1), {name}3 AS (SELECT *, abs({v} - md) AS dd FROM {name}2),
{name}4 AS (SELECT *, {roll("dd")} AS ma0 FROM {name}3), {name} AS (SELECT *, {near("ma0")} AS ma FROM {name}4) """


def cusum(source: str, x: str, moments: str, name: str = "cu") -> str:
    return f""", {name}m AS ({moments}), {name}z AS (SELECT a.*, ({x} - mean) / greatest(sqrt(variance), 1e-6) AS z FROM {source} a JOIN {name}m USING (series_id)),
{name}s AS (SELECT *, sum(z - 0.25::DOUBLE) OVER ({ALONG} ROWS UNBOUNDED PRECEDING) AS up, sum(-z - 0.25::DOUBLE) OVER ({ALONG} ROWS UNBOUNDED PRECEDING) AS dn FROM {name}z),
{name} AS (SELECT *, greatest(up - least(0, min(up) OVER ({ALONG} ROWS UNBOUNDED PRECEDING)), dn - least(0, min(dn) OVER ({ALONG} ROWS UNBOUNDED PRECEDING))) AS score FROM {name}s) """


OWN = "SELECT a.series_id, md AS mean, pow(1.4826::DOUBLE * quantile_cont(abs({x} - md), 0.5), 2) AS variance FROM {t} a JOIN (SELECT series_id, quantile_cont({x}, 0.5) AS md FROM {t} WHERE part = 'train' GROUP BY 1) b ON a.series_id = b.series_id WHERE part = 'train' GROUP BY 1, 2"
CENTRED = f", oc AS (SELECT series_id, t, {num(-C)} + (obs + 0.5::DOUBLE) * {num(2 * C / D)} AS yc FROM o)"
MOMENTS = f"SELECT series_id, sum(p0 * yy) AS mean, sum(p0 * yy * yy) - sum(p0 * yy) * sum(p0 * yy) AS variance FROM (SELECT *, {num(-C)} + (report_bucket + 0.5::DOUBLE) * {num(2 * C / D)} AS yy FROM p0) GROUP BY 1"
POINT = ", pg AS (SELECT series_id, obs, max(llr) AS score, min(candidate) FILTER (llr >= best - 1e-9::DOUBLE) AS candidate FROM (SELECT *, max(llr) OVER (PARTITION BY series_id, obs) AS best FROM rt) GROUP BY 1, 2) "
SCORE = f"SELECT series_id, t, {r('score')} FROM "
Z = ", z1 AS (SELECT a.*, abs({v} - md) AS dev FROM {t} a JOIN (SELECT series_id, quantile_cont({v}, 0.5) AS md FROM {t} GROUP BY 1) USING (series_id)), rz AS (SELECT z1.*, dev / greatest(1e-6, 1.4826::DOUBLE * ma) AS score FROM z1 JOIN (SELECT series_id, quantile_cont(dev, 0.5) AS ma FROM z1 GROUP BY 1) USING (series_id)) "
HAMPEL = "least(20::DOUBLE, abs({v} - md) / greatest(1e-6, 1.4826::DOUBLE * ma))"


def spread(width: int) -> str:
    return f"max(coalesce(s{width}, 0)) OVER ({ALONG} {centred(width)})"


WIDTHS = (8, 16, 32, 64)
GLR = f""", sp AS (SELECT series_id, t, candidate, {', '.join(f"CASE WHEN count(*) OVER (PARTITION BY series_id, candidate ORDER BY t ROWS BETWEEN CURRENT ROW AND {w - 1} FOLLOWING) = {w} THEN sum(llr) OVER (PARTITION BY series_id, candidate ORDER BY t ROWS BETWEEN CURRENT ROW AND {w - 1} FOLLOWING) END AS s{w}" for w in WIDTHS)} FROM o JOIN rt USING (series_id, obs)),
{', '.join(f"b{w} AS (SELECT series_id, t + {w // 2} AS t, max(s{w}) AS s{w} FROM sp GROUP BY series_id, t HAVING max(s{w}) IS NOT NULL)" for w in WIDTHS)} """
KL = "".join(f""", ks{w} AS (SELECT a.series_id, a.t, b.obs FROM o a JOIN o b ON a.series_id = b.series_id AND b.t BETWEEN a.t AND a.t + {w - 1}),
kc{w} AS (SELECT series_id, t, obs, count(*) AS c FROM ks{w} GROUP BY 1, 2, 3), b{w} AS (SELECT k.series_id, k.t + {w // 2} AS t, sum(c * ln(c)) - {w} * ln({w}::DOUBLE) - sum(c * ln(greatest(p0, 1e-12))) AS s{w} FROM kc{w} k JOIN p0 ON p0.series_id = k.series_id AND p0.report_bucket = k.obs GROUP BY k.series_id, k.t HAVING sum(c) = {w}) """ for w in WIDTHS)
WINDOWS = "SELECT series_id, t, " + r("greatest(0::DOUBLE, " + ", ".join(spread(w) for w in WIDTHS) + ")", "score") + " FROM o " + " ".join(f"LEFT JOIN b{w} USING (series_id, t)" for w in WIDTHS)
LC = ", lz AS (SELECT series_id, t, candidate, (llr - avg(llr) OVER (PARTITION BY series_id, candidate)) / greatest(stddev_pop(llr) OVER (PARTITION BY series_id, candidate), 1e-6) - 0.25::DOUBLE AS z FROM o JOIN rt USING (series_id, obs)), lq AS (SELECT *, sum(z) OVER (PARTITION BY series_id, candidate ORDER BY t ROWS UNBOUNDED PRECEDING) AS q FROM lz), lc AS (SELECT series_id, t, max(q) AS score FROM (SELECT series_id, t, q - least(0, min(q) OVER (PARTITION BY series_id, candidate ORDER BY t ROWS UNBOUNDED PRECEDING)) AS q FROM lq) GROUP BY 1, 2) "
MIX = """, mq AS (SELECT p0.series_id, p0.report_bucket, p0.p0, coalesce(c, 0) / sum(coalesce(c, 0)) OVER (PARTITION BY p0.series_id) AS q FROM p0 LEFT JOIN (SELECT series_id, obs, count(*) AS c FROM o GROUP BY 1, 2) k ON k.series_id = p0.series_id AND k.obs = p0.report_bucket),
mf AS (SELECT series_id, stuck_bucket, i, 0.01::DOUBLE + i * (0.69::DOUBLE / 99) AS rate, sum((q - (1 - (0.01::DOUBLE + i * (0.69::DOUBLE / 99))) * p0 - (0.01::DOUBLE + i * (0.69::DOUBLE / 99)) * p) ** 2) AS loss FROM mq JOIN mx USING (report_bucket), range(100) AS k(i) GROUP BY ALL),
fit AS (SELECT series_id, stuck_bucket AS candidate, rate, loss FROM mf QUALIFY row_number() OVER (PARTITION BY series_id ORDER BY round(loss, 12), stuck_bucket, rate) = 1) """
MASK = mad("f", "vf") + f", mk AS (SELECT *, (row_number() OVER (PARTITION BY series_id ORDER BY score DESC, t DESC) <= sum(label) OVER (PARTITION BY series_id))::INTEGER AS mask FROM (SELECT *, round({HAMPEL.format(v='vf')}, 6) AS score FROM q)), op AS (SELECT *, CASE WHEN mask = 0 THEN vf END AS x0 FROM mk) "
FWD = f"coalesce(last_value(x0 IGNORE NULLS) OVER ({ALONG} ROWS UNBOUNDED PRECEDING), first_value(x0 IGNORE NULLS) OVER ({ALONG} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))"
GAPS = f"gp AS (SELECT *, last_value(x0 IGNORE NULLS) OVER a AS v0, first_value(x0 IGNORE NULLS) OVER b AS v1, last_value(CASE WHEN x0 IS NOT NULL THEN t END IGNORE NULLS) OVER a AS t0, first_value(CASE WHEN x0 IS NOT NULL THEN t END IGNORE NULLS) OVER b AS t1 FROM op WINDOW a AS ({ALONG} ROWS UNBOUNDED PRECEDING), b AS ({ALONG} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))"
LINEAR = f"{MASK}, {GAPS}, rp AS (SELECT *, coalesce(x0, v0 + (v1 - v0) * (t - t0) / (t1 - t0), v0, v1, vf) AS repaired FROM gp) "
BIN = "greatest(0, least(31, floor(({c} + 1.0::DOUBLE) * 16.0::DOUBLE)))"
SIDES = f", sd AS (SELECT series_id, {BIN.format(c='v')} AS bin, 1 AS a, 0 AS b FROM rp UNION ALL SELECT series_id, {BIN.format(c='repaired')}, 0, 1 FROM rp), sh AS (SELECT series_id, bin, sum(a) / sum(sum(a)) OVER (PARTITION BY series_id) AS a, sum(b) / sum(sum(b)) OVER (PARTITION BY series_id) AS b FROM sd GROUP BY 1, 2) "
METRICS = f"""{LINEAR}{SIDES}, ba AS (SELECT series_id, avg(abs(repaired - v)) AS mae, sqrt(avg((repaired - v) ** 2)) AS rmse, abs(avg(repaired) - avg(v)) AS mean_error, abs(stddev_pop(repaired) - stddev_pop(v)) AS std_error, abs(quantile_cont(repaired, 0.95) - quantile_cont(v, 0.95)) AS p95_error,
  avg(abs(repaired - v)) FILTER (label = 1) AS fault_mae, avg(abs(repaired - v)) FILTER (label = 0) AS clean_mae, avg((mask = 1 AND label = 0)::INTEGER) AS false_repairs FROM rp GROUP BY 1),
sm AS (SELECT series_id, (sum(a) + 0.001::DOUBLE) / (sum(sum(a)) OVER (PARTITION BY series_id) + 0.032::DOUBLE) AS a, (sum(b) + 0.001::DOUBLE) / (sum(sum(b)) OVER (PARTITION BY series_id) + 0.032::DOUBLE) AS b FROM sd GROUP BY series_id, bin),
js AS (SELECT series_id, greatest(0, 0.5::DOUBLE * sum(a * log2(a / ((a + b) / 2)) + b * log2(b / ((a + b) / 2)))) AS js2 FROM sm GROUP BY 1),
wa AS (SELECT a.series_id, avg(abs(a.v - b.repaired)) AS wasserstein FROM (SELECT series_id, v, row_number() OVER (PARTITION BY series_id ORDER BY v) AS n FROM rp) a JOIN (SELECT series_id, repaired, row_number() OVER (PARTITION BY series_id ORDER BY repaired) AS n FROM rp) b USING (series_id, n) GROUP BY 1)
SELECT series_id, {', '.join(r(c) for c in ('mae', 'rmse', 'mean_error', 'std_error', 'p95_error', 'fault_mae', 'clean_mae', 'false_repairs', 'js2', 'wasserstein'))} FROM ba JOIN js USING (series_id) JOIN wa USING (series_id)"""
QS = "WITH qs AS (SELECT lang, doc_id AS t, quality AS label, round(n_chars / (n_chars + 1000), 6) AS score FROM labels JOIN documents USING (doc_id)) "


def ranking(source: str, keys: str) -> str:
    return f"""SELECT {keys}, max(P)::BIGINT AS positives, max(N)::BIGINT AS negatives, sum(n0 * (tp - p0 / 2.0::DOUBLE)) / nullif(max(P) * max(N), 0) AS auroc, CASE WHEN max(N) > 0 THEN sum(p0 / nullif(P, 0) * tp / (tp + fp)) END AS auprc FROM
  (SELECT *, sum(p0) OVER w AS tp, sum(n0) OVER w AS fp, sum(p0) OVER (PARTITION BY {keys}) AS P, sum(n0) OVER (PARTITION BY {keys}) AS N FROM (SELECT {keys}, score, sum(label) AS p0, sum(1 - label) AS n0 FROM {source} GROUP BY ALL) WINDOW w AS (PARTITION BY {keys} ORDER BY score DESC ROWS UNBOUNDED PRECEDING)) GROUP BY ALL"""


RUNS = (
    cusum("f", "vf", OWN.format(x="v", t="n")) + mad("f", "vf") + POINT + Z.format(v="vf", t="f")
    + f""", sc AS (SELECT series_id, t, label, round(score, 6) AS score, 'cusum' AS method FROM cu UNION ALL SELECT series_id, t, label, round({HAMPEL.format(v='vf')}, 6), 'hampel' FROM q
  UNION ALL SELECT series_id, t, label, round(score, 6), 'point_glr' FROM o JOIN pg USING (series_id, obs) UNION ALL SELECT series_id, t, label, round(score, 6), 'robust_z' FROM rz
  UNION ALL SELECT o.series_id, t, label, round(-ln(greatest(p0, 1e-15)), 6), 'surprise' FROM o JOIN p0 ON p0.series_id = o.series_id AND p0.report_bucket = o.obs), rk AS ({ranking("sc", "series_id, method")}), rr AS (SELECT series_id, method, positives, negatives, round(auroc, 6) AS auroc, round(auprc, 6) AS auprc FROM rk) """
)
SEP = ", se AS (SELECT series_id, stuck_bucket, 0.5::DOUBLE * sum(abs(p - p0)) AS tv, sum(greatest(p, 1e-12) * ln(greatest(p, 1e-12) / greatest(p0, 1e-12))) AS kl FROM p0 JOIN mx USING (report_bucket) GROUP BY 1, 2) "
EVENTS = f"""{MASK}, tr AS (SELECT series_id, min(t) AS a, max(t) AS b FROM (SELECT series_id, t, t - row_number() OVER ({ALONG}) AS g FROM f WHERE label = 1) GROUP BY series_id, g), fo AS (SELECT series_id, min(t) AS c, max(t) AS d FROM (SELECT series_id, t, t - row_number() OVER ({ALONG}) AS g FROM mk WHERE mask = 1) GROUP BY series_id, g),
pr AS (SELECT tr.series_id, a, b, greatest(0, min(c) - a) AS delay, sum(least(b, d) - greatest(a, c) + 1) AS common, sum(d - c + 1) AS length FROM tr JOIN fo ON tr.series_id = fo.series_id AND c <= b AND d >= a GROUP BY tr.series_id, a, b)
SELECT tr.series_id, count(*) AS events, round(count(delay) / count(*), 6) AS recall, quantile_cont(delay::DOUBLE, 0.5) AS delay, round(avg(coalesce(common / (tr.b - tr.a + 1 + length - common), 0)), 6) AS iou FROM tr LEFT JOIN pr ON pr.series_id = tr.series_id AND pr.a = tr.a AND pr.b = tr.b GROUP BY 1"""
BOOT = """, bn AS (SELECT method, row_number() OVER (PARTITION BY method ORDER BY series_id) - 1 AS place, count(*) OVER (PARTITION BY method) AS size, auprc FROM rr WHERE auprc IS NOT NULL),
bd AS (SELECT method, r, (((r * 1000003 + place) * 1103515245 + 12345) % 2147483648 // 65536) % size AS place FROM bn, range(500) AS z(r)), bm AS (SELECT method, r, avg(auprc) AS m FROM bd JOIN bn USING (method, place) GROUP BY 1, 2), br AS (SELECT *, row_number() OVER (PARTITION BY method ORDER BY m, r) - 1 AS n FROM bm)
SELECT method, round(max(m) FILTER (n = 12), 6) AS low, round(max(m) FILTER (n = 486), 6) AS high, round(avg(m), 6) AS mean FROM br GROUP BY 1"""
GATE = f"""{RUNS}{SEP}, ga AS (SELECT series_id % 5 AS grp, CASE WHEN series_id % 2 = 0 THEN 'validation' ELSE 'test' END AS part, method, auprc, positives / (positives + negatives) AS prevalence, tv, kl FROM rk JOIN (SELECT series_id, min(tv) AS tv, min(kl) AS kl FROM se GROUP BY 1) USING (series_id)),
gn AS (SELECT grp, method, avg(auprc) FILTER (part = 'validation') AS validation, avg(auprc) FILTER (part = 'test') AS test, avg(prevalence) AS prevalence, min(tv) AS tv, min(kl) AS kl FROM ga GROUP BY 1, 2)
SELECT grp AS "group", method, {r('validation')}, {r('test')}, {r('prevalence')}, {r('tv')}, {r('kl')}, {r('test / prevalence', 'lift')}, CASE WHEN test / prevalence > 1 THEN CASE WHEN tv >= 0.10::DOUBLE AND kl >= 0.03::DOUBLE THEN 'route' ELSE 'use' END ELSE 'abstain' END AS action FROM gn WHERE validation IS NOT NULL QUALIFY row_number() OVER (PARTITION BY grp ORDER BY validation DESC, method) = 1"""

P11 = max(0.5, 1 - 1 / max(float(SEGMENT), 2.0))
P01 = min(0.2, max(1e-4, SHARE * (1 - P11) / max(1 - SHARE, 1e-6)))


def hmm(emissions: str, rho: str = num(SHARE), p01: str = num(P01), p11: str = num(P11)) -> str:
    """Forward and backward pass by recursion over t; emissions: series_id, t, candidate, e0, e1 and what chances are named."""
    named = [c for c in ("rho", "p01", "p11") if c in (rho, p01, p11)]
    of = "".join(f", em.{c}" for c in named)
    step = f"SELECT *, (f0 * (1 - {p01}) + f1 * (1 - {p11})) * x0 AS a0, (f0 * {p01} + f1 * {p11}) * x1 AS a1 FROM (SELECT fw.*, em.e0 AS x0, em.e1 AS x1{of} FROM fw JOIN em ON em.series_id = fw.series_id AND em.candidate = fw.candidate AND em.t = fw.t + 1)"
    back = f"SELECT *, (1 - {p01}) * x0 * g0 + {p01} * x1 * g1 AS a0, (1 - {p11}) * x0 * g0 + {p11} * x1 * g1 AS a1 FROM (SELECT bw.*, em.e0 AS x0, em.e1 AS x1{of} FROM bw JOIN em ON em.series_id = bw.series_id AND em.candidate = bw.candidate AND em.t = bw.t WHERE bw.t > 0)"
    return f""", em AS MATERIALIZED ({emissions}),
fw AS (SELECT series_id, candidate, t, (1 - {rho}) * e0 / ((1 - {rho}) * e0 + {rho} * e1) AS f0, {rho} * e1 / ((1 - {rho}) * e0 + {rho} * e1) AS f1, ln((1 - {rho}) * e0 + {rho} * e1) AS ll FROM em WHERE t = 0
  UNION ALL SELECT series_id, candidate, t + 1, a0 / (a0 + a1), a1 / (a0 + a1), ll + ln(a0 + a1) FROM ({step})),
bw AS (SELECT series_id, candidate, max(t) AS t, 1::DOUBLE AS g0, 1::DOUBLE AS g1 FROM em GROUP BY 1, 2
  UNION ALL SELECT series_id, candidate, t - 1, a0 / (a0 + a1), a1 / (a0 + a1) FROM ({back})),
ps AS (SELECT fw.series_id, fw.t, fw.candidate, f1 * g1 / (f0 * g0 + f1 * g1) AS score FROM fw JOIN bw ON fw.series_id = bw.series_id AND fw.candidate = bw.candidate AND fw.t = bw.t),
lk AS (SELECT series_id, min(candidate) AS candidate FROM (SELECT *, max(ll) OVER (PARTITION BY series_id) AS best FROM (SELECT series_id, candidate, ll, t, max(t) OVER (PARTITION BY series_id) AS last FROM fw) WHERE t = last) WHERE ll >= best - 1e-9::DOUBLE GROUP BY 1) """


def stuck(rows: str = "o", columns: str = "SELECT stuck_bucket AS candidate, report_bucket AS obs, p FROM mx", p0: str = "p0") -> str:
    return hmm(f"SELECT a.series_id, a.t, c.candidate, greatest(b.p0, 1e-12) AS e0, greatest(c.p, 1e-12) AS e1 FROM {rows} a JOIN {p0} b ON b.series_id = a.series_id AND b.report_bucket = a.obs JOIN ({columns}) c ON c.obs = a.obs")


ROWS = f"SELECT series_id, t, {r('score')}, candidate::INTEGER AS candidate, round(avg(score) OVER (PARTITION BY series_id), 6) + 0 AS rate FROM "
BEST = ROWS + "ps JOIN lk USING (series_id, candidate)"
AROUND = "SELECT a.stuck_bucket AS candidate, b.report_bucket AS obs, avg(b.p) AS p FROM (SELECT DISTINCT stuck_bucket FROM mx) a JOIN mx b ON abs(a.stuck_bucket - b.stuck_bucket) <= 2 GROUP BY 1, 2"
IDENTITY = f", vb AS (SELECT series_id, t, {BIN.format(c='vf')}::INTEGER AS obs FROM f), im0 AS (SELECT a AS stuck_bucket, b AS report_bucket, CASE WHEN a = b THEN {num(1 - 1e-4 * (D - 1))} ELSE 0.0001::DOUBLE END AS p FROM range({D}) AS p(a), range({D}) AS q(b)), ip AS (SELECT series_id, report_bucket, sum(p * alpha) AS p0 FROM al JOIN im0 USING (stuck_bucket) GROUP BY 1, 2)"


def mistaken(factor: float) -> str:
    s, c = shape(max(0.05, EPSILON * factor))
    width, step = 2 / (s - 1), 2 * c / D
    overlap = f"greatest(0::DOUBLE, least(e + {num(step)}, lo + {num(width)}) - greatest(e, lo))"
    return f""", wg AS (SELECT a AS stuck_bucket, b AS report_bucket, ({num(s)} * ({num(-1 + 1 / D)} + {num(2 / D)} * a) - 1.0::DOUBLE) / {num(s - 1)} AS lo, {num(-c)} + b * {num(step)} AS e FROM range({D}) AS p(a), range({D}) AS q(b)),
wm AS (SELECT stuck_bucket, report_bucket, mass / sum(mass) OVER (PARTITION BY stuck_bucket) AS p FROM (SELECT *, {num(s / (s + 1) / width)} * {overlap} + {num(1 / (s + 1) / (2 * c - width))} * ({num(step)} - {overlap}) AS mass FROM wg)),
wp AS (SELECT series_id, report_bucket, sum(p * alpha) AS p0 FROM al JOIN wm USING (stuck_bucket) GROUP BY 1, 2)""" + stuck(columns="SELECT stuck_bucket AS candidate, report_bucket AS obs, p FROM wm", p0="wp")


def change_points(source: str, x: str, moments: str, longest: int = 48) -> str:
    """Run lengths by recursion over t; a state holds the chances of all runs and the values so far."""
    own = "hist[len(hist) - r + 1:]"
    chance = f"probs[r + 1] * greatest(exp(-0.5::DOUBLE * pow(x - (CASE WHEN r < 3 THEN mean ELSE list_avg({own}) END), 2) / (CASE WHEN r < 3 THEN greatest(variance, 1e-4) ELSE greatest(list_var_pop({own}), 1e-4) END)) / sqrt(2 * pi() * (CASE WHEN r < 3 THEN greatest(variance, 1e-4) ELSE greatest(list_var_pop({own}), 1e-4) END)), 1e-300)"
    return f""", bm AS MATERIALIZED (SELECT a.series_id, t, {x} AS x, mean, variance FROM {source} a JOIN ({moments}) m ON m.series_id = a.series_id),
cp AS (SELECT DISTINCT series_id, -1::BIGINT AS t, [1.0::DOUBLE] AS probs, []::DOUBLE[] AS hist FROM bm
  UNION ALL SELECT series_id, t + 1, list_transform(w, lambda z: z / greatest(list_sum(w), 1e-300)), list_append(hist, x)[-{longest}:] FROM (
    SELECT *, list_concat([list_sum(g) * {num(1 / longest)}], list_transform(g, lambda z: z * {num(1 - 1 / longest)}))[:{longest}] AS w FROM (
      SELECT *, list_transform(range(len(probs)), lambda r: {chance}) AS g FROM (SELECT cp.*, x, mean, variance FROM cp JOIN bm ON bm.series_id = cp.series_id AND bm.t = cp.t + 1)))) """


def repaired(name: str, source: str, how: str, x: str = "vf") -> str:
    """Masked rows of `source` replaced; name: the CTE that gets repaired."""
    forward = f"coalesce(last_value(x0 IGNORE NULLS) OVER ({ALONG} ROWS UNBOUNDED PRECEDING), first_value(x0 IGNORE NULLS) OVER ({ALONG} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), {x})"
    if how == "median":
        return f", {name} AS (SELECT *, CASE WHEN mask = 0 THEN {x} ELSE coalesce(CASE WHEN count({x}) OVER ({ALONG} {centred(9)}) >= 3 THEN quantile_cont({x}, 0.5) OVER ({ALONG} {centred(9)}) END, {x}) END AS repaired FROM {source})"
    opened = f"(SELECT *, CASE WHEN mask = 0 THEN {x} END AS x0 FROM {source})"
    if how == "forward":
        return f", {name} AS (SELECT * EXCLUDE (x0), {forward} AS repaired FROM {opened})"
    return f", {name} AS (SELECT * EXCLUDE (x0, v0, v1, t0, t1), coalesce(x0, v0 + (v1 - v0) * (t - t0) / (t1 - t0), v0, v1, {x}) AS repaired FROM (SELECT *, last_value(x0 IGNORE NULLS) OVER a AS v0, first_value(x0 IGNORE NULLS) OVER b AS v1, last_value(CASE WHEN x0 IS NOT NULL THEN t END IGNORE NULLS) OVER a AS t0, first_value(CASE WHEN x0 IS NOT NULL THEN t END IGNORE NULLS) OVER b AS t1 FROM {opened} WINDOW a AS ({ALONG} ROWS UNBOUNDED PRECEDING), b AS ({ALONG} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)))"


def top(name: str, score: str) -> str:
    return f", {name} AS (SELECT ra.*, score, (row_number() OVER (PARTITION BY series_id ORDER BY score DESC, t DESC) <= sum(label) OVER (PARTITION BY series_id))::INTEGER AS mask FROM ra JOIN ({score}) USING (series_id, t))"


MEAN = f"SELECT series_id, report_bucket AS obs, sum(p * alpha * ({num(-1 + 1 / D)} + {num(2 / D)} * stuck_bucket)) / sum(p * alpha) AS mean FROM al JOIN mx USING (stuck_bucket) GROUP BY 1, 2"
VARIANTS = (
    f", pm AS ({MEAN}), ra AS (SELECT series_id, t, v, vf, label, mean FROM o JOIN pm USING (series_id, obs))"
    + Z.format(v="y", t="o") + mad("ra", "mean", 9, "pq") + stuck()
    + ", ra0 AS (SELECT *, 0 AS mask FROM ra), ra1 AS (SELECT *, label AS mask FROM ra)"
    + "".join(repaired(f"v{how}", "ra1", how) for how in ("linear", "forward", "median"))
    + top("kz", "SELECT series_id, t, round(score, 6) AS score FROM rz") + repaired("vz", "kz", "linear")
    + top("kh", f"SELECT series_id, t, round({HAMPEL.format(v='mean')}, 6) AS score FROM pq") + repaired("vh", "kh", "linear")
    + POINT + top("kg", "SELECT series_id, t, round(score, 6) AS score FROM o JOIN pg USING (series_id, obs)") + repaired("vg", "kg", "linear")
    + top("kp", "SELECT series_id, t, round(score, 6) AS score FROM ps JOIN lk USING (series_id, candidate)") + repaired("vp", "kp", "linear") + repaired("vm", "kp", "linear", "mean")
    + ", va AS (SELECT series_id, t, v, label, mask, vf AS repaired, 'no_repair' AS repair_method, 'none' AS mask_source FROM ra0"
    + "".join(f" UNION ALL SELECT series_id, t, v, label, mask, repaired, '{m}', '{k}' FROM {c}" for c, m, k in (("vlinear", "linear_interpolation", "oracle_fault_mask"), ("vforward", "locf", "oracle_fault_mask"), ("vmedian", "rolling_median", "oracle_fault_mask"), ("vz", "robust_z_repair", "robust_z_topk_mask_linear"), ("vh", "mean_hampel_repair", "mean_hampel_topk_mask_linear"), ("vg", "point_glr_repair", "point_glr_topk_mask_linear"), ("vp", "posterior_repair", "posterior_topk_mask_linear")))
    + " UNION ALL SELECT series_id, t, v, label, mask, mean + greatest(0, least(1, score)) * (repaired - mean), 'posterior_soft_repair', 'posterior_soft_private' FROM vm) "
    + "SELECT series_id, repair_method, mask_source, sum(mask)::BIGINT AS masked, round(avg(abs(repaired - v)), 6) + 0 AS mae, round(sqrt(avg((repaired - v) ** 2)), 6) + 0 AS rmse, round(avg((mask = 1 AND label = 0)::INTEGER), 6) + 0 AS false_repairs FROM va GROUP BY 1, 2, 3"
)
TRUE_BUCKET = int((STUCK + 1.0) * D / 2)
DIAGNOSIS = stuck() + f""", dg AS (SELECT series_id, t, candidate, round(score, 6) + 0 AS score, round(avg(score) OVER (PARTITION BY series_id), 6) AS rate FROM ps JOIN lk USING (series_id, candidate)),
cal AS (SELECT series_id, sum(e) / sum(n) AS brier, sum(abs(s - y)) / sum(n) AS ece FROM (SELECT series_id, least(floor(score * 10), 9) AS b, count(*) AS n, sum(score) AS s, sum(label) AS y, sum((score - label) ** 2) AS e FROM dg JOIN f USING (series_id, t) GROUP BY 1, 2) GROUP BY 1)
SELECT series_id, {r('avg(label)', 'rate_true', 12)}, {r('max(rate)', 'rate_estimated', 12)}, max(candidate)::INTEGER AS bucket_estimated, {r('abs(max(rate) - avg(label))', 'rate_error', 12)}, {TRUE_BUCKET} AS bucket_true, abs(max(candidate) - {TRUE_BUCKET})::INTEGER AS bucket_error, (max(candidate) = {TRUE_BUCKET})::INTEGER::DOUBLE AS bucket_hit, {r('max(brier)', 'brier', 12)}, {r('max(ece)', 'ece', 12)} FROM dg JOIN f USING (series_id, t) JOIN cal USING (series_id) GROUP BY 1"""
CHANGES = f"SELECT series_id, t, {r('probs[1]', 'score')}, -1::INTEGER AS candidate, 0::DOUBLE AS rate FROM cp WHERE t >= 0"
RECURSIVE: dict[str, str] = {
    "d4_change_points": change_points("n", "v", "SELECT series_id, avg(v) AS mean, var_pop(v) AS variance FROM n WHERE part = 'train' GROUP BY 1") + CHANGES,
    "d4_private_change_points": CENTRED + change_points("oc", "yc", MOMENTS) + CHANGES,
    "d14_stuck_hmm": stuck() + BEST,
    "d15_row_hmm": stuck() + ROWS + "(SELECT series_id, t, max(score) AS score, min(candidate) FILTER (score >= best - 1e-9::DOUBLE) AS candidate FROM (SELECT *, max(score) OVER (PARTITION BY series_id, t) AS best FROM ps) GROUP BY 1, 2)",
    "d16_range_hmm": stuck(columns=AROUND) + BEST,
    "d18_dropout_hmm": f", {injected('dropout')}" + hmm("SELECT series_id, t, candidate, CASE WHEN vf IS NULL THEN 0.01::DOUBLE ELSE 0.99::DOUBLE END AS e0, CASE WHEN vf IS NULL THEN candidate / 100.0::DOUBLE ELSE 1 - candidate / 100.0::DOUBLE END AS e1 FROM j, (VALUES (20), (40), (60), (80)) AS l(candidate)") + BEST,
    "d19_raw_hmm": IDENTITY + stuck("vb", "SELECT stuck_bucket AS candidate, report_bucket AS obs, p FROM im0", "ip") + BEST,
    "d20_wrong_epsilon_half": mistaken(0.5) + BEST,
    "d20_wrong_epsilon_double": mistaken(2.0) + BEST,
    "r2_repair_variants": VARIANTS,
    "e7_diagnosis": DIAGNOSIS,
}

TABLE: dict[str, str] = {
    "m1_robust_normalize": f"SELECT series_id, t, part, {r('v')} FROM n",
    "m5_piecewise_sample": f"SELECT series_id, t, {r('y')}, obs FROM o",
    "m8_binary_sample": f"SELECT series_id, t, ({uniform(1)} < 0.5::DOUBLE + v * {num((exp(EPSILON) - 1) / (2 * (exp(EPSILON) + 1)))})::INTEGER AS bit FROM n",
    "m11_histogram_alpha": f"SELECT series_id, stuck_bucket, {r('alpha', digits=9)} FROM al",
    "m13_normal_reports": f"SELECT series_id, report_bucket, {r('p0', digits=9)} FROM p0",
    "m14_clean_mean": f"SELECT series_id, report_bucket, round(sum(p * alpha * ({num(-1 + 1 / D)} + {num(2 / D)} * stuck_bucket)) / sum(p * alpha), 6) + 0 AS mean FROM al JOIN mx USING (stuck_bucket) GROUP BY 1, 2",
    "m15_output_moments": f"SELECT series_id, {r('mean')}, {r('variance')} FROM ({MOMENTS})",
    "m16_separation": f"{SEP} SELECT series_id, stuck_bucket, {r('tv')}, {r('kl')} FROM se",
    "m18_budget_days": f"SELECT device_id, budget, {r('eps / 30', 'epsilon_per_day')}, {r('eps / 30 * 30', 'epsilon_per_30_days')}, floor(budget * reports / eps)::BIGINT AS max_reports, floor(budget / (eps / 30))::BIGINT AS days FROM (SELECT device_id, count(*) AS reports, sum(epsilon) AS eps FROM r GROUP BY 1), (VALUES (10::DOUBLE), (100::DOUBLE), (1000::DOUBLE)) AS b(budget)",
    "f1_iid_mask": "SELECT series_id, t, label FROM im",
    "f2_segment_mask": "SELECT series_id, t, label FROM m",
    **{f"f3_inject_{mode}": f", {injected(mode)} SELECT series_id, t, {r('vf')} FROM j" for mode in ("iid_stuck", "bias", "drift", "scale", "spike", "dropout")},
    "f7_contaminated": f"SELECT series_id, stuck_bucket, {r(f'alpha * {num(0.9)} + CASE WHEN stuck_bucket = 5 THEN 0.1 ELSE 0 END::DOUBLE', 'alpha', 9)} FROM al",
    "d1_robust_z": Z.format(v="x", t="n") + SCORE + "rz",
    "d2_rolling_median": mad("n", "v") + f"SELECT series_id, t, {r('abs(v - md)', 'score')} FROM q",
    "d2_hampel": mad("n", "v") + f"SELECT series_id, t, {r(HAMPEL.format(v='v'), 'score')} FROM q",
    "d3_cusum": cusum("n", "x", OWN.format(x="x", t="n")) + SCORE + "cu",
    "d3_private_cusum": CENTRED + cusum("oc", "yc", MOMENTS) + SCORE + "cu",
    "d5_surprise": f"SELECT o.series_id, t, {r('-ln(greatest(p0, 1e-15))', 'score')} FROM o JOIN p0 ON p0.series_id = o.series_id AND p0.report_bucket = o.obs",
    "d6_frequency_surprise": f"SELECT series_id, t, {r('-ln((count(*) OVER (PARTITION BY series_id, obs) + 1) / (count(*) OVER (PARTITION BY series_id) + 32))', 'score')} FROM o",
    "d7_point_glr": POINT + f"SELECT series_id, t, {r('score')}, candidate FROM o JOIN pg USING (series_id, obs)",
    "d8_window_glr": GLR + WINDOWS,
    "d9_window_kl": KL + WINDOWS,
    "d10_llr_cusum": LC + SCORE + "lc",
    "d11_smoothed_glr": POINT + f"SELECT series_id, t, {r(f'avg(score) OVER ({ALONG} ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)', 'score')}, candidate FROM o JOIN pg USING (series_id, obs)",
    "d12_mixture_fit": MIX + f"SELECT series_id, candidate, {r('rate')}, {r('loss')} FROM fit",
    "d12_mixture": MIX + f"SELECT o.series_id, t, {r('rate * p / greatest(rate * p + (1 - rate) * p0, 1e-15)', 'score')} FROM o JOIN p0 ON p0.series_id = o.series_id AND p0.report_bucket = o.obs JOIN fit ON fit.series_id = o.series_id JOIN mx ON mx.stuck_bucket = fit.candidate AND mx.report_bucket = o.obs",
    "d22_missing_share": f", {injected('dropout')} SELECT series_id, t, {r(f'CASE WHEN count(*) OVER ({ALONG} {centred(9)}) >= 2 THEN avg((vf IS NULL)::INTEGER) OVER ({ALONG} {centred(9)}) ELSE (vf IS NULL)::INTEGER END', 'score')} FROM j",
    "d23_local_shape": f"SELECT series_id, t, {r(f'max(x) OVER ({ALONG} ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) - min(x) OVER ({ALONG} ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)', 'local_range')}, {r(f'coalesce(avg(st) OVER ({ALONG} ROWS BETWEEN 1 PRECEDING AND 2 FOLLOWING), 0)', 'local_slope')} FROM (SELECT *, abs(x - lag(x) OVER ({ALONG})) AS st FROM raw)",
    "d28_rank_maximum": f"SELECT series_id, t, {r('greatest((rank() OVER (PARTITION BY series_id ORDER BY x) + (count(*) OVER (PARTITION BY series_id, x) - 1) / 2.0::DOUBLE) / k, (rank() OVER (PARTITION BY series_id ORDER BY id)) / k)', 'score')} FROM raw",
    "w7_rolling_features": f"SELECT series_id, t, {', '.join(f'round(avg(x) OVER w{w}, 9) AS mean_{w}, round(coalesce(stddev_samp(x) OVER w{w}, 0), 9) AS std_{w}, round(abs(x - avg(x) OVER w{w}), 9) AS dev_{w}' for w in (4, 8, 16, 32))}, {r(f'coalesce(x - lag(x) OVER ({ALONG}), 0)', 'diff', 9)} FROM raw WINDOW {', '.join(f'w{w} AS ({ALONG} ROWS BETWEEN {w - 1} PRECEDING AND CURRENT ROW)' for w in (4, 8, 16, 32))}",
    "w16_runs": f"SELECT series_id, min(t) AS \"begin\", max(t) AS \"end\", count(*) AS n FROM (SELECT series_id, t, t - row_number() OVER ({ALONG}) AS g FROM o WHERE obs >= 16) GROUP BY series_id, g",
    "w17_flatlines": f", fb AS (SELECT *, sum(b) OVER ({ALONG} ROWS UNBOUNDED PRECEDING) AS g FROM (SELECT *, CASE WHEN abs(x - lag(x) OVER ({ALONG})) > 20 THEN 1 ELSE 0 END AS b FROM raw)) SELECT series_id, min(t) AS \"begin\", max(t) AS \"end\", count(*) AS n, {r('avg(x)', 'level')} FROM (SELECT *, max(g) OVER (PARTITION BY series_id) AS last FROM fb) WHERE g < last GROUP BY series_id, g HAVING count(*) >= 2",
    "w20_block_means": f"SELECT series_id, (t // 8)::BIGINT AS block, {r('avg(x)', 'mean')} FROM raw GROUP BY 1, 2 HAVING count(*) = 8",
    "w21_every_nth": f"SELECT series_id, t, {r('x')} FROM raw WHERE t % 6 = 0",
    "r1_repair_linear": LINEAR + f"SELECT series_id, t, mask, {r('repaired')} FROM rp",
    "r1_repair_forward": MASK + f"SELECT series_id, t, mask, {r(f'coalesce({FWD}, vf)', 'repaired')} FROM op",
    "r1_repair_median": MASK + f"SELECT series_id, t, mask, {r(f'CASE WHEN mask = 0 THEN vf ELSE coalesce(CASE WHEN count(vf) OVER ({ALONG} {centred(9)}) >= 3 THEN quantile_cont(vf, 0.5) OVER ({ALONG} {centred(9)}) END, vf) END', 'repaired')} FROM op",
    "r3_repair_metrics": METRICS,
    "r4_bucket_wasserstein": LINEAR + SIDES + ", wc AS (SELECT series_id, (lead(bin) OVER (PARTITION BY series_id ORDER BY bin) - bin) / 16.0::DOUBLE AS gap, sum(a - b) OVER (PARTITION BY series_id ORDER BY bin ROWS UNBOUNDED PRECEDING) AS cum FROM sh) SELECT series_id, round(coalesce(sum(abs(cum) * gap), 0), 6) AS wasserstein FROM wc GROUP BY 1",
    "r5_block_errors": LINEAR + ", bk AS (SELECT series_id, avg(v) AS a, avg(repaired) AS b FROM rp GROUP BY series_id, t // 8 HAVING count(*) = 8), bl AS (SELECT *, quantile_cont(a, 0.9) OVER (PARTITION BY series_id) AS lim FROM bk) SELECT series_id, round(avg(abs(a - b)), 6) AS block_error, count(*) FILTER (a > lim) AS above, count(*) FILTER (b > lim) AS above_repaired FROM bl GROUP BY 1",
    "e5_events": EVENTS,
    "b1_gate": GATE,
    "b2_tagged_separation": SEP + "SELECT series_id, stuck_bucket, tv, rank, CASE WHEN rank / max(rank) OVER (PARTITION BY series_id) <= 0.05::DOUBLE THEN 'q05' WHEN rank / max(rank) OVER (PARTITION BY series_id) >= 0.95::DOUBLE THEN 'q95' ELSE 'mid' END AS tag FROM (SELECT series_id, stuck_bucket, round(tv, 6) AS tv, dense_rank() OVER (PARTITION BY series_id ORDER BY round(tv, 6))::INTEGER AS rank FROM se)",
    "b3_runs": RUNS + "SELECT * FROM rr",
    "b3_best_method": RUNS + "SELECT series_id, method, auprc FROM rr QUALIFY row_number() OVER (PARTITION BY series_id ORDER BY auprc DESC NULLS LAST, method) = 1",
    "b4_method_summary": RUNS + "SELECT method, count(auprc) AS n, round(avg(auprc), 6) AS mean, round(stddev_samp(auprc), 6) AS std, round(min(auprc), 6) AS least, round(max(auprc), 6) AS most, round(quantile_cont(auprc, 0.5), 6) AS median FROM rk GROUP BY 1",
    "b8_method_total": RUNS + "SELECT coalesce(method, 'all') AS method, count(auprc) AS n, round(avg(auprc), 6) AS mean FROM rk GROUP BY ROLLUP (method)",
    "b9_tiers": RUNS + "SELECT 'all_ge_' || x AS tier, count(*) AS n, round(avg(auprc), 6) AS mean FROM rk, (VALUES (1), (5), (10), (15)) AS z(x) WHERE positives >= x GROUP BY 1",
    "b9_bootstrap": RUNS + BOOT,
    "b11_family_gap": RUNS + ", bo AS (SELECT series_id, method, auprc, row_number() OVER (PARTITION BY series_id ORDER BY auprc DESC NULLS LAST, method) AS n FROM rr), bi AS (SELECT series_id, method, auprc, row_number() OVER (PARTITION BY series_id ORDER BY auprc DESC NULLS LAST, method) AS n FROM rr WHERE method IN ('point_glr', 'surprise')) SELECT series_id, bo.method AS best, bo.auprc AS best_score, bi.method AS own, bi.auprc AS own_score, round(bo.auprc - bi.auprc, 6) AS gap FROM bo JOIN bi USING (series_id) WHERE bo.n = 1 AND bi.n = 1",
    "b11_gap_closed": RUNS + ", gc AS (SELECT *, max(auprc) FILTER (method = 'surprise') OVER w AS b, max(auprc) FILTER (method = 'robust_z') OVER w AS o FROM rr WINDOW w AS (PARTITION BY series_id)) SELECT series_id, method, round(CASE WHEN o - b > 1e-12 THEN (auprc - b) / (o - b) END, 6) + 0 AS gap_closed FROM gc",
    "a19_correlation": f"SELECT series_id, count(*) AS n, {r('CASE WHEN count(*) >= 3 THEN corr(x, id) END', 'r')} FROM raw GROUP BY 1",
    "a31_pivot": f"SELECT series_id, {', '.join(r(f'avg(y) FILTER (t % 3 = {k})', f'y{k}') for k in range(3))} FROM o GROUP BY 1",
    "b13_capped_strata": "SELECT series_id, id FROM raw QUALIFY row_number() OVER (PARTITION BY series_id ORDER BY (id * 7919) % 1000003, id) <= 10",
}
ORACLES: dict[str, str] = {key: BASE + sql for key, sql in TABLE.items()} | {key: BASE.replace("WITH", "WITH RECURSIVE", 1) + sql for key, sql in RECURSIVE.items()} | {
    "m2_range_normalize": f"{BASE}, {normalized('nn', 'range')} SELECT series_id, t, {r('v')} FROM nn",
    "m3_reference_normalize": BASE + ", " + normalized("nn", where="part <> 'test'") + f" SELECT series_id, t, {r('v')} FROM nn",
    "m9_randomized_response": f"{BASE}, rb AS (SELECT *, greatest(0, least(31, floor((v + 1.0::DOUBLE) * 16.0::DOUBLE)))::INTEGER AS b, floor({uniform(2)} * 31)::INTEGER AS other FROM n) SELECT series_id, t, CASE WHEN {uniform(1)} < {num(exp(EPSILON) / (exp(EPSILON) + D - 1))} THEN b ELSE other + CASE WHEN other >= b THEN 1 ELSE 0 END END AS obs FROM rb",
    "d26_nearest_neighbours": "WITH q AS (SELECT a.vec_id AS query_id, sqrt(list_sum(list_transform(list_zip(b.embedding, a.embedding), lambda z: (z[1]::DOUBLE - z[2]::DOUBLE) * (z[1]::DOUBLE - z[2]::DOUBLE)))) AS d FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0) SELECT query_id, round(avg(d), 6) AS score FROM (SELECT * FROM q QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY d) <= 5) GROUP BY 1",
    "a29_profile": " UNION ALL ".join(f"SELECT '{c}' AS \"column\", count(*) AS rows, count({c}) AS valid, round(1 - count({c}) / count(*), 6) AS missing, round(avg({c}::DOUBLE), 6) AS mean, round(stddev_samp({c}::DOUBLE), 6) AS std, round(quantile_cont({c}::DOUBLE, 0.01), 6) AS p01, round(quantile_cont({c}::DOUBLE, 0.5), 6) AS p50, round(quantile_cont({c}::DOUBLE, 0.99), 6) AS p99 FROM events" for c in ("value", "user_id")),
    "e1_ranking": QS + f"SELECT lang, positives, negatives, round(auroc, 6) AS auroc, round(auprc, 6) AS auprc FROM ({ranking('qs', 'lang')})",
    "e2_stepwise_auprc": QS + "SELECT lang, round(sum(CASE WHEN label = 1 THEN tp / n ELSE 0 END) / nullif(sum(label), 0), 6) AS auprc_rows FROM (SELECT *, sum(label) OVER w AS tp, count(*) OVER w AS n FROM qs WINDOW w AS (PARTITION BY lang ORDER BY score DESC, t ROWS UNBOUNDED PRECEDING)) GROUP BY 1",
    "e3_at_budget": QS + "SELECT lang, max(k) AS k, round(count(*) FILTER (n <= k AND label = 1) / max(k), 6) AS precision, round(count(*) FILTER (n <= k AND label = 1) / nullif(sum(label), 0), 6) AS recall FROM (SELECT *, greatest(1, round(count(*) OVER (PARTITION BY lang) * 0.1::DOUBLE))::BIGINT AS k, row_number() OVER (PARTITION BY lang ORDER BY score DESC, t DESC) AS n FROM qs) GROUP BY 1",
    "e4_recall_at_fpr": QS + "SELECT lang, round(CASE WHEN max(lim) IS NOT NULL THEN count(*) FILTER (label = 1 AND score >= lim) / nullif(sum(label), 0) END, 6) AS recall FROM qs LEFT JOIN (SELECT lang, quantile_cont(score, 0.95) AS lim FROM qs WHERE label = 0 GROUP BY 1) USING (lang) GROUP BY 1",
    "e4_recall_by_sweep": QS + "SELECT lang, round(CASE WHEN max(p) > 0 AND max(n) > 0 THEN coalesce(max(tp / p) FILTER (fp / n <= 0.05::DOUBLE), 0) END, 6) AS recall FROM (SELECT lang, sum(label) OVER w AS tp, sum(1 - label) OVER w AS fp, sum(label) OVER (PARTITION BY lang) AS p, sum(1 - label) OVER (PARTITION BY lang) AS n FROM qs WINDOW w AS (PARTITION BY lang ORDER BY score DESC, t ROWS UNBOUNDED PRECEDING)) GROUP BY 1",
    "e6_calibration": QS + "SELECT lang, round(sum(e) / sum(n), 6) AS brier, round(sum(abs(s - y)) / sum(n), 6) AS ece FROM (SELECT lang, least(floor(score * 10), 9) AS b, count(*) AS n, sum(score) AS s, sum(label) AS y, sum((score - label) ** 2) AS e FROM qs GROUP BY 1, 2) GROUP BY 1",
    "s25_html_links": "SELECT page_id, len(l)::INTEGER AS n_links, coalesce(l[1], '') AS first_link, length(regexp_extract(html, '<title>([^<]*)</title>', 1))::INTEGER AS title_chars FROM (SELECT *, regexp_extract_all(html, 'href=\"/([^\"]*)\"', 1) AS l FROM pages)",
}
