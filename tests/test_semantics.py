"""Invariants and plain recursions: what SQL comparison on one data set doesn't show."""

from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewright.operators import channel, detectors, evaluation, faults, hmm, relations, series
from tidewright.sources import telemetry
from tidewright.streaming import incremental, workflow

SF = "/root/testdata/sf0.001"
SERIES = "series_id int, t long, id long, x double"


@pytest.fixture(scope="module")
def reports(spark):
    return telemetry.reports(telemetry.table(spark, SF, "events")).cache()


def test_counts_give_the_likelihoods_of_reports(spark, reports):
    weights = telemetry.mechanism_weights(spark)
    both = relations.likelihoods(relations.report_counts(reports), weights).join(relations.likelihoods_base(reports, weights).withColumnRenamed("llr", "direct"), ["epsilon", "stuck_bucket"])
    assert both.count() == 96 and both.agg(F.max(F.abs(F.col("llr") - F.col("direct")))).first()[0] < 1e-9


def test_running_sum_in_blocks(spark):
    rows = [(k % 3, (k * 37) % 500, k, 0.5 * (k % 4)) for k in range(2000)]
    df = spark.createDataFrame(rows, "device_id int, ts int, report_id long, epsilon double")
    got = {r.report_id: r.s for r in relations.running_sum(df, "device_id", relations.hour(), ["ts", "report_id"], "epsilon", "s").collect()}
    for device in range(3):
        total = 0.0
        for _, _, i, e in sorted((r for r in rows if r[0] == device), key=lambda r: (r[1], r[2])):
            total += e
            assert got[i] == total


@pytest.mark.parametrize("epsilon", [0.5, 2.0, 4.0])
def test_channels_are_column_stochastic(spark, epsilon):
    for matrix in (channel.piecewise_matrix(spark, epsilon), channel.randomized_response_matrix(spark, epsilon), channel.binary_matrix(spark, epsilon), channel.identity_matrix(spark)):
        sums = matrix.groupBy("stuck_bucket").agg(F.sum("p").alias("s"), F.min("p").alias("least"))
        assert sums.where((F.abs(F.col("s") - 1) > 1e-12) | (F.col("least") < 0)).count() == 0 and sums.count() == 32


def test_piecewise_samples_follow_their_matrix(spark):
    rows = spark.range(60_000).select("id", channel.discretize(channel.piecewise(F.lit(0.5), 2.0), 2.0).alias("report_bucket"))
    got = rows.groupBy("report_bucket").agg((F.count("*") / 60_000).alias("q"))
    want = channel.piecewise_matrix(spark, 2.0).where("stuck_bucket = 24")
    assert want.join(got, "report_bucket", "left").agg(F.sum(F.abs(F.coalesce("q", F.lit(0.0)) - F.col("p")))).first()[0] < 0.25


def test_cusum_equals_its_recursion(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=400)
    df = spark.createDataFrame([(1, t, t, float(v), "train" if t < 240 else "test") for t, v in enumerate(x)], SERIES + ", part string")
    got = [r.score for r in detectors.cusum(df).orderBy("t").collect()]
    centre = np.median(x[:240])
    z, up, down, want = (x - centre) / (1.4826 * np.median(np.abs(x[:240] - centre))), 0.0, 0.0, []
    for v in z:
        up, down = max(0.0, up + v - 0.25), max(0.0, down - v - 0.25)
        want.append(max(up, down))
    assert np.allclose(got, want, atol=1e-9)


def test_change_points_equal_their_recursion(spark):
    """Each run written out with the values that it covers."""
    rng = np.random.default_rng(12)
    x = np.r_[rng.normal(0, 0.1, 60), rng.normal(0.8, 0.2, 60)]
    df = spark.createDataFrame([(1, t, t, float(v), "train" if t < 40 else "test") for t, v in enumerate(x)], SERIES + ", part string")
    got = [r.score for r in hmm.change_points(df, detectors.train_moments(df, robust=False), longest=20).orderBy("t").collect()]
    mean, variance, chances, want = x[:40].mean(), max(x[:40].var(), 1e-4), [1.0], []
    for t, v in enumerate(x):
        likely = []
        for r in range(len(chances)):
            run = x[t - r : t]
            m, s = (mean, variance) if r < 3 else (run.mean(), max(run.var(), 1e-4))
            likely.append(max(np.exp(-((v - m) ** 2) / (2 * s)) / np.sqrt(2 * np.pi * s), 1e-300))
        new = ([sum(c * p for c, p in zip(chances, likely, strict=True)) / 20] + [c * p * 19 / 20 for c, p in zip(chances, likely, strict=True)])[:20]
        chances = [c / sum(new) for c in new]
        want.append(chances[0])
    assert np.allclose(got, want, atol=1e-9) and max(got[60:70]) > 2 * got[50]


def test_change_points_whatever_the_cut_into_batches(spark):
    """Series that end within a batch, go on over several, or have one row, side by side; each against plain runs."""
    rng, sizes = np.random.default_rng(13), {1: 70, 2: 1, 3: 3, 4: 24, 5: 13}
    x = {i: np.round(np.r_[rng.normal(0, 0.1, n // 2), rng.normal(0.8, 0.2, n - n // 2)], 3) for i, n in sizes.items()}
    df = spark.createDataFrame([(i, t, t, float(v)) for i, own in x.items() for t, v in enumerate(own)], SERIES).repartition(5)
    moments = spark.createDataFrame([(i, i / 10, i / 50) for i in sizes], "series_id int, mean double, variance double")
    want = {}
    for i, own in x.items():
        chances = np.ones(1)
        for t, v in enumerate(own):
            runs = [(i / 10, max(i / 50, 1e-4)) if r < 3 else (own[t - r : t].mean(), max(own[t - r : t].var(), 1e-4)) for r in range(len(chances))]
            likely = np.array([max(np.exp(-((v - m) ** 2) / (2 * s)) / np.sqrt(2 * np.pi * s), 1e-300) for m, s in runs])
            chances = np.r_[(chances * likely).sum() / 20, chances * likely * 19 / 20][:20]
            chances /= chances.sum()
            want[i, t] = chances[0]
    size = "spark.sql.execution.arrow.maxRecordsPerBatch"
    known = spark.conf.get(size)
    try:
        for rows in (known, "7", "1"):
            spark.conf.set(size, rows)
            got = {(r.series_id, r.t): r.score for r in hmm.change_points(df, moments, longest=20).collect()}
            assert set(got) == set(want) and all(abs(got[key] - want[key]) < 1e-9 for key in want)
    finally:
        spark.conf.set(size, known)
    assert hmm.change_points(df.where("false"), moments).count() == 0


def uniform_reports(spark, m):
    return spark.createDataFrame([(1, k, float(p)) for k, p in enumerate(m.mean(axis=1))], "series_id int, report_bucket int, p0 double")


def plain_posterior(obs, normal, fault, p01, p11, start):
    """Log-likelihood and posterior of state 1 by plain recursions; a missing report tells nothing."""
    e = [(1.0, 1.0) if o is None else (normal[o], fault[o]) for o in obs]
    forward, likelihood = [], 0.0
    for t, (a, b) in enumerate(e):
        f = (1 - start, start) if not t else tuple(forward[-1][0] * x + forward[-1][1] * y for x, y in ((1 - p01, 1 - p11), (p01, p11)))
        f = (f[0] * a, f[1] * b)
        likelihood += np.log(sum(f))
        forward.append((f[0] / sum(f), f[1] / sum(f)))
    back, out = (1.0, 1.0), [0.0] * len(obs)
    for t in range(len(obs) - 1, -1, -1):
        joint = (forward[t][0] * back[0], forward[t][1] * back[1])
        out[t] = joint[1] / sum(joint)
        a, b = e[t][0] * back[0], e[t][1] * back[1]
        back = ((1 - p01) * a + p01 * b, (1 - p11) * a + p11 * b)
        back = (back[0] / sum(back), back[1] / sum(back))
    return likelihood, np.array(out)


def test_learned_and_shortlist_hmm_equal_plain_recursions(spark):
    rng = np.random.default_rng(13)
    matrix = channel.piecewise_matrix(spark, 4.0)
    m = hmm.table(matrix)
    obs = [int(rng.choice(32, p=m[:, int(rng.integers(0, 32))])) for _ in range(60)] + [None, None] + [int(rng.choice(32, p=m[:, 25])) for _ in range(40)]
    rows = spark.createDataFrame([(1, t, o) for t, o in enumerate(obs)], "series_id int, t long, obs int")
    normal = m.mean(axis=1)
    p01, p11 = hmm.transition(0.2, 16.0)
    got = hmm.learned(rows, m, uniform_reports(spark, m), rounds=5, length=16.0).orderBy("t").collect()
    counts = np.full(32, 1e-3)
    for o in obs:
        counts[o] += o is not None
    fault = np.maximum(counts / counts.sum() - normal, 0) + 1e-3
    fault, start = fault / fault.sum(), 0.2
    for _ in range(5):
        score = plain_posterior(obs, normal, fault, p01, p11, start)[1]
        fault = np.full(32, 1e-3 * len(obs))
        for o, s in zip(obs, score, strict=True):
            if o is not None:
                fault[o] += s
        fault, start = fault / fault.sum(), min(max(score[0], 1e-4), 0.95)
    assert np.allclose([r.score for r in got], score, atol=1e-9)
    got = hmm.shortlist(rows, m, uniform_reports(spark, m), few=3, block=10, length=16.0).orderBy("t").collect()
    phi, active, counts, want = {}, [0, 1, 2], np.zeros(32), []
    for t, o in enumerate(obs):
        if o is not None:
            counts[o] += 1
        if t and t % 10 == 0:
            q = counts / counts.sum()
            loss = [(round(min(float(((q - (1 - r) * normal - r * m[:, c]) ** 2).sum()) for r in np.linspace(0.02, 0.65, 32)), 12), c) for c in range(32)]
            active = [c for _, c in sorted(loss)[:3]]
        best = 0.0
        for c in active:
            a, b = phi.get(c, (0.8, 0.2))
            a, b = a * (1 - p01) + b * (1 - p11), a * p01 + b * p11
            if o is not None:
                a, b = a * normal[o], b * m[o, c]
            phi[c] = (a / (a + b), b / (a + b))
            best = max(best, phi[c][1])
        want.append(best)
    assert np.allclose([r.score for r in got], want, atol=1e-9)
    assert hmm.learned(rows.where("false"), m, uniform_reports(spark, m)).count() == 0


def test_mixture_parabola_equals_the_grid(spark):
    rng = np.random.default_rng(2)
    matrix = channel.piecewise_matrix(spark, 2.0)
    m = hmm.table(matrix)
    obs = np.r_[rng.choice(32, 300, p=m.mean(axis=1)), rng.choice(32, 100, p=m[:, 20])]
    rows = spark.createDataFrame([(1, t, int(o)) for t, o in enumerate(obs)], "series_id int, t long, obs int")
    calibration = spark.range(32).select(F.lit(1).alias("series_id"), F.col("id").cast("int").alias("stuck_bucket"), F.lit(1 / 32).alias("alpha"))
    fit = detectors.mixture(rows, matrix, channel.normal(matrix, calibration)).first()
    q = np.bincount(obs, minlength=32) / len(obs)
    losses = [(round(float(((q - (1 - r) * m.mean(axis=1) - r * m[:, c]) ** 2).sum()), 12), c, r) for c in range(32) for r in np.linspace(0.01, 0.70, 100)]
    assert (fit.candidate, round(fit.rate, 9)) == (min(losses)[1], round(min(losses)[2], 9)) and abs(fit.candidate - 20) <= 3


def test_forward_backward_by_enumeration():
    rng = np.random.default_rng(3)
    e, p01, p11, start = rng.uniform(0.1, 1, (6, 2, 3)), 0.1, 0.8, 0.3
    likelihood, posterior = hmm.forward_backward(e, p01, p11, start)
    move = np.array([[1 - p01, p01], [1 - p11, p11]])
    total, ones = np.zeros(3), np.zeros((6, 3))
    for path in np.ndindex(*[2] * 6):
        p = np.array([1 - start, start][path[0]]) * e[0, path[0]]
        for t in range(1, 6):
            p = p * move[path[t - 1], path[t]] * e[t, path[t]]
        total += p
        ones += np.array(path)[:, None] * p
    assert np.allclose(likelihood, np.log(total)) and np.allclose(posterior, ones / total)


def test_stuck_hmm_finds_the_segment(spark):
    rng = np.random.default_rng(4)
    matrix = channel.piecewise_matrix(spark, 4.0)
    m = hmm.table(matrix)
    obs = [int(rng.choice(32, p=m[:, int(rng.integers(0, 32))])) for _ in range(200)] + [int(rng.choice(32, p=m[:, 25])) for _ in range(80)]
    rows = spark.createDataFrame([(1, t, o) for t, o in enumerate(obs)], "series_id int, t long, obs int")
    got = hmm.stuck(rows, m, uniform_reports(spark, m)).toPandas().sort_values("t")
    assert abs(int(got["candidate"].iloc[0]) - 25) <= 1 and got["score"][210:].mean() > 0.9 > 0.3 > got["score"][:190].mean()
    by_candidate = [plain_posterior(obs, m.mean(axis=1), np.maximum(m[:, c], 1e-12), *hmm.transition(0.2, 48.0), 0.2) for c in range(32)]
    best = max(range(32), key=lambda c: by_candidate[c][0])
    assert int(got["candidate"].iloc[0]) == best and np.allclose(got["score"], by_candidate[best][1], atol=1e-9)
    each = hmm.stuck(rows, m, uniform_reports(spark, m), per_row=True).toPandas().sort_values("t")
    assert np.allclose(each["score"], np.max([x[1] for x in by_candidate], axis=0), atol=1e-9)
    assert len(hmm.stuck(rows.where("false"), m, uniform_reports(spark, m)).toPandas()) == 0


def test_ranking_edge_cases(spark):
    rows = [("one", 1, 0.5), ("one", 1, 0.6), ("tie", 1, 0.5), ("tie", 0, 0.5), ("tie", 0, 0.5), ("good", 1, 0.9), ("good", 0, 0.1)]
    got = {r.g: r for r in evaluation.ranking(spark.createDataFrame(rows, "g string, label int, score double"), ["g"]).collect()}
    assert got["one"].auroc is None and got["tie"].auroc == 0.5 and abs(got["tie"].auprc - 1 / 3) < 1e-12 and got["good"].auroc == 1.0
    masked = evaluation.top_mask(spark.createDataFrame([(1, 0, 1.0), (1, 1, 1.0), (1, 2, 0.0)], "series_id int, t long, score double"), F.lit(1))
    assert {r.t: r.mask for r in masked.collect()} == {0: 0, 1: 1, 2: 0}
    assert evaluation.top_mask(masked.drop("mask"), F.lit(9)).agg(F.sum("mask")).first()[0] == 3 and evaluation.top_mask(masked.drop("mask"), F.lit(0)).agg(F.sum("mask")).first()[0] == 0


def test_series_edge_cases(spark):
    rows = [(1, t, t, v) for t, v in enumerate([5.0] * 6 + [50.0] * 3)] + [(2, 0, 90, 1.0), (3, 0, 91, float("nan")), (3, 1, 92, None)]
    df = spark.createDataFrame(rows, SERIES)
    assert series.finite(df).count() == 10
    lines = series.flatlines(series.finite(df), "x", 0.1, 2).collect()
    assert [(r.series_id, r.begin, r.end, r.level) for r in lines] == [(1, 0, 5, 5.0)]  # a series' last run is left out
    flat = series.normalize(series.split(series.finite(df))).collect()
    assert all(-1 <= r.v <= 1 for r in flat) and next(r.v for r in flat if r.series_id == 2) == 0.0
    wide = detectors.window_glr(spark.createDataFrame([(1, 0, 3), (1, 1, 3)], "series_id int, t long, obs int"), spark.createDataFrame([(1, 3, 3, 1.0)], "series_id int, obs int, candidate int, llr double"))
    assert [r.score for r in wide.collect()] == [0.0, 0.0]  # shorter than the window
    for mode in ("iid_stuck", "bias", "drift", "scale", "spike", "dropout"):
        hit = faults.inject(faults.iid_mask(series.normalize(series.split(series.finite(df))), 0.3), mode)
        assert hit.where("label = 0 and vf <> v").count() == 0
    with pytest.raises(ValueError):
        faults.inject(hit, "unknown")


BATCH = "source_event_id string, report_id long, device_id int, ts int, report_bucket int, epsilon double, mechanism_id string, calibration_version string, batch_id int, batch_kind string, correction_version int"


def event(i, device, ts, batch, kind="base", version=0, epsilon=2.0, name=None):
    return (name or f"evt-{i}", i, device, ts, 3, epsilon, "pm32", "cal_v1", batch, kind, version)


def test_workflow_traps(spark):
    rows = [event(1, 1, 5, 0), event(2, 1, 6, 0), event(3, 1, 7, 0, epsilon=1.0), event(4, 2, 9, 0)]  # cap 4: 3 is over
    rows += [event(1, 1, 5, 1, "replay_batch_0"), event(3, 1, 7, 1, "replay_batch_0", epsilon=1.0), event(5, 2, 9, 1), event(6, 2, 8, 1)]
    rows += [event(1, 1, 4, 2, "late_corrections", 1, name="corr-1"), event(1, 1, 4, 3, "late_corrections", 1, name="corr-1"), event(99, 3, 1, 3, "late_corrections", 1, name="corr-99")]
    decisions = workflow.run(spark.createDataFrame(rows, BATCH), cap=4.0).cache()
    got = {(r.batch_id, r.report_id): (r.status, r.late_event) for r in decisions.collect()}
    assert got[0, 2] == ("accepted", 0) and got[0, 3] == ("rejected", 0)  # landing on the cap is within it
    assert got[1, 1] == ("duplicate", 1) and got[1, 3] == ("rejected", 1)  # a rejected event is rejected again
    assert got[1, 6] == ("accepted", 1) and got[1, 5] == ("rejected", 0)  # late is strict; order is by ts
    assert got[2, 1] == ("correction", 1) and got[3, 1] == ("duplicate", 1) and got[3, 99][0] == "accepted"
    state = {r.device_id: (r.accepted_reports, r.epsilon_sum) for r in workflow.budget_state(decisions, 4.0).collect()}
    assert state == {1: (2, 4.0), 2: (2, 4.0), 3: (0, 0.0)}  # corrections of unknown ids don't count
    found = {r.report_id: (r.ts, r.correction_version) for r in workflow.reports(decisions).collect()}
    assert found[1] == (4, 1) and 3 not in found
    assert {r.status for r in workflow.checks(decisions, 4.0).collect()} == {"pass"}


def test_repeated_reports_inside_a_batch(spark):
    rows = [event(1, 1, 5, 0), event(1, 1, 5, 0, name="evt-1b"), event(1, 1, 6, 0), event(2, 1, 7, 0), event(3, 1, 8, 0, version=1, name="corr-3"), event(3, 1, 9, 0)]
    rows += [event(1, 1, 5, 1, version=2, name="corr-1"), event(1, 1, 4, 1, version=1, name="corr-1b"), event(4, 1, 9, 1, epsilon=1.0)]
    decisions = workflow.run(spark.createDataFrame(rows, BATCH), cap=6.0).cache()
    got = sorted((r.batch_id, r.source_event_id, r.ts, r.status) for r in decisions.collect())
    assert got == sorted([(0, "evt-1", 5, "accepted"), (0, "evt-1b", 5, "duplicate"), (0, "evt-1", 6, "duplicate"), (0, "evt-2", 7, "accepted"), (0, "corr-3", 8, "accepted"), (0, "evt-3", 9, "duplicate"), (1, "corr-1", 5, "correction"), (1, "corr-1b", 4, "duplicate"), (1, "evt-4", 9, "accepted")])
    state = workflow.budget_state(decisions, 6.0).first()
    assert (state.accepted_reports, state.epsilon_sum) == (3, 5.0)  # the accepted correction of an unknown id isn't charged
    assert {r.status for r in workflow.checks(decisions, 6.0).collect()} == {"pass"}


def test_stream_of_batches_equals_the_batch_form(spark, reports, tmp_path):
    batches = telemetry.micro_batches(reports).select(*[c.split(" ")[0] for c in BATCH.split(", ")]).cache()
    numbers = sorted(r[0] for r in batches.select("batch_id").distinct().collect())[:5]
    for n in numbers:
        batches.where(F.col("batch_id") == n).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    workflow.stream(spark, str(tmp_path / "in"), BATCH, str(tmp_path / "out")).awaitTermination()
    streamed = spark.read.parquet(*[str(tmp_path / "out" / "decisions" / str(n)) for n in range(len(numbers))])
    whole = workflow.run(batches.where(F.col("batch_id") <= numbers[-1]))
    pick = lambda d: sorted(map(tuple, d.select("batch_id", "report_id", "status", "late_event").collect()))
    assert pick(streamed) == pick(whole)


def test_maintained_aggregates_equal_the_batch(spark, reports, tmp_path):
    reports.repartition(3, "report_id").write.parquet(str(tmp_path / "in"))
    plain = {
        "counts": (incremental.counts, relations.report_counts(reports)), "ledger": (incremental.ledger, relations.ledger(reports)),
        "devices": (incremental.device_counts, reports.groupBy("device_id", "report_bucket").agg(F.count("*").alias("n"))),
        "events": (incremental.event_bounds, relations.partial_sums(reports, relations.cleaning(reports))[1]),
    }
    for name, (build, want) in plain.items():
        out = tmp_path / name
        incremental.maintain(build(incremental.source(spark, str(tmp_path / "in"))), str(out)).awaitTermination()
        last = max(int(p.name) for p in (out / "state").iterdir() if p.name.isdigit())
        got = spark.read.parquet(str(out / "state" / str(last)))
        rounded = lambda d: sorted(tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in d.select(*sorted(want.columns)).collect())
        assert rounded(got) == rounded(want)


def test_upsert_and_replace(spark):
    state, delta = spark.createDataFrame([(1, 2, 5)], "k int, n int, lo int"), spark.createDataFrame([(1, 3, 4), (2, 1, 9)], "k int, n int, lo int")
    assert sorted(map(tuple, relations.upsert(state, delta, ["k"], ["n"], ["lo"]).collect())) == [(1, 5, 4), (2, 1, 9)]
    assert sorted(map(tuple, relations.replace(state, delta, ["k"]).collect())) == [(1, 3, 4), (2, 1, 9)]


def test_choices_of_faults_for_large_series_ids(spark):
    """Products of series ids pass 2**31 from id 20,505 on; ids 1,000,003 apart scatter alike."""
    rows = spark.createDataFrame([(k, t, k * 100 + t, float(t)) for k in (7, 1000010, 2000013) for t in range(24)], SERIES).withColumn("v", F.col("x") / 24)
    labels = {}
    for r in faults.segment_mask(rows, 0.25, 4).collect():
        labels.setdefault(r.series_id, {})[r.t] = r.label
    assert labels[7] == labels[1000010] == labels[2000013] and sum(labels[7].values()) == 6
    known = rows.groupBy("series_id").agg(F.lit(0.5).alias("level"), F.lit(8).alias("n"), F.lit(1).alias("rank"))
    assert faults.template_faults(rows, known, 0.25).groupBy("series_id").agg(F.sum("label").alias("n")).where("n = 6").count() == 3


def test_groups_dealt_at_once_rank_alike_and_posteriors_go_without_rates(spark):
    """What panels leave out of their shuffles changes no area and no score."""
    from tidewright.operators import scan

    rows = spark.createDataFrame([(k, t, (k + t) % 3 % 2, float(t * 7 % 5)) for k in range(6) for t in range(20)], "g int, t int, label int, score double")
    plain, dealt = (sorted(map(tuple, evaluation.ranking(rows, ["g"], many=m).collect())) for m in (False, True))
    assert plain == dealt and len(plain) == 6
    reports = spark.createDataFrame([(1, t, t % 2) for t in range(12)], "series_id long, t long, obs int")
    normal = spark.createDataFrame([(1, [0.6, 0.4])], "series_id long, normal array<double>")
    chain = scan.Chain(np.array([[0.2], [0.8]]), 0.1, 0.8, 0.2)
    full, bare = scan.posteriors(reports, normal, chain), scan.posteriors(reports, normal, chain, rate=False)
    assert "rate" not in bare.columns and sorted(map(tuple, full.drop("rate").select(bare.columns).collect())) == sorted(map(tuple, bare.collect()))


def test_equal_candidates_on_either_side_of_a_half_are_equal(spark):
    """Ratios and likelihoods that differ by an ulp only, about a half of the ninth digit; the score stays unrounded."""
    from tidewright.operators import scan

    low = 0.5085404995
    high = float(np.nextafter(low, 1))
    table = spark.createDataFrame([(1, 0, 20, low), (1, 0, 21, high), (1, 0, 22, 0.1)], "series_id int, obs int, candidate int, llr double")
    rows = spark.createDataFrame([(1, 0, 0)], "series_id int, t long, obs int")
    found = detectors.point_glr(rows, table).first()
    assert (found.candidate, found.score) == (20, high)
    halves = [(k + 0.5) * 1e-9 for k in range(400)]
    close = np.array([[0.0, np.nextafter(x, 0), np.nextafter(x, 1)] for x in halves]) + np.array([0.0, 1.0, 1.0])
    assert (scan.largest(close, 1) == 1).all()


def test_neighbours_in_blocks_against_all_distances(spark):
    """Copies, near copies far from the origin, a repeated id, a row without a vector and one with a gap; blocks of 16 rows."""
    rng = np.random.default_rng(8)
    x = rng.normal(size=(150, 8)).astype(np.float32)
    x[40:60], x[60:90] = x[0], x[1] + 1000 + rng.normal(size=(30, 8)).astype(np.float32) / 1000
    rows = [(i if i != 149 else 100, [float(v) for v in own]) for i, own in enumerate(x)] + [(150, None), (151, [None] + [0.0] * 7)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    queries = frame.where("vec_id % 10 = 0")
    ids, wide = np.array([i for i, _ in rows[:150]]), x.astype(float)
    want = {}
    for q in sorted({int(i) for i in ids if i % 10 == 0}):
        away = np.concatenate([np.sqrt(((wide[ids != q] - own) ** 2).sum(axis=1)) for own in wide[ids == q]])
        want[q] = np.sort(away)[:5].mean()
    for block in (4096, 16):
        found = detectors.nearest_neighbours(queries, frame, block=block).collect()
        got = {r.query_id: r.score for r in found}
        assert len(found) == len(got) and got.pop(150) is None and set(got) == set(want)
        assert all(abs(got[q] - want[q]) < 1e-9 for q in want)


EDGE = "81.86 6.04 5.91 16.85 170.52 21.99 70.09 45.83 54.36 11.08 3.4 121.56 3.78 79.98 26.02 55.98 66.35 58.55 22.31 80.14 102.11 143.01 72.19 8.3 62.2 167.82 34.92 79.84 67.35 88.38 37.5 129.77 41.94 152.31 4.85 61.11 21.62 85.23 62.93 85.83 73.85 7.26 105.31 60.39 62.41 68.02 4.53 30.45 5.24 84.57 3.36 31.58 181.96 29.94 13.86 62.03 55.26 91.34 10.76 122.61 46.62"


def test_values_on_an_edge_whatever_the_last_bit_of_percentiles(spark, tmp_path):
    """User 1006's values as a training part: 62.41 lies on the lower edge of a bucket, and Spark's 1st percentile is an ulp
    above DuckDB's."""
    import duckdb

    from tidewright.plans.catalogue import ORACLES, QUERIES

    values = [float(x) for x in EDGE.split()] + [50.0] * 40
    rows = [(i, datetime(2024, 1, 1) + timedelta(hours=i), 1006, "view", x, "{}") for i, x in enumerate(values)]
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string").write.parquet(f"{tmp_path}/events.parquet")
    con = duckdb.connect()
    con.execute(f"create view events as select * from read_parquet('{tmp_path}/events.parquet/*.parquet')")
    for name in ("m11_histogram_alpha", "d5_surprise"):
        got, want = QUERIES[name](spark, str(tmp_path)), con.sql(ORACLES[name])
        assert sorted(map(tuple, got.select(want.columns).collect())) == sorted(want.fetchall())
    clean = series.normalize(series.split(spark.createDataFrame([(1006, i, i, x) for i, x in enumerate(values)], SERIES)))
    on = {r.x: round((r.v + 1) * 16, 9) for r in clean.where("part = 'train'").collect()}
    buckets = {r.x: r.b for r in clean.withColumn("b", channel.bucket(F.col("v"))).collect()}
    edges = [x for x, place in on.items() if place == int(place) and 0 < place < 32]
    assert edges == [62.41] and buckets[62.41] == on[62.41] == 11


def test_batches_meet_known_reports_by_their_ids(spark, monkeypatch):
    """Decisions that can't hold a batch's ids aren't read; replays and corrections still meet their own."""
    columns = "report_id long, device_id int, ts int, epsilon double, source_event_id string, batch_id int, batch_kind string, correction_version int"
    ids = [(0, range(0, 10), 0), (1, range(10, 20), 0), (2, range(4, 8), 0), (3, range(8, 12), 1), (4, range(30, 33), 0)]
    rows = [(i, i % 3, i, 1.0, f"e{b}-{i}", b, "base", version) for b, own, version in ids for i in own]
    seen, decide = [], workflow.decide

    def noted(batch, known, *rest):
        seen.append(None if known is None else sorted(r.report_id for r in known.collect()))
        return decide(batch, known, *rest)

    monkeypatch.setattr(workflow, "decide", noted)
    found = workflow.run(spark.createDataFrame(rows, columns))
    assert seen == [None, None, [4, 5, 6, 7], [8, 9, 10, 11], None]
    counts = {(r.batch_id, r.status): r["count"] for r in found.groupBy("batch_id", "status").count().collect()}
    assert counts == {(0, "accepted"): 10, (1, "accepted"): 10, (2, "duplicate"): 4, (3, "correction"): 4, (4, "accepted"): 3}


def test_fit_keeps_within_a_row_and_series_are_dealt_once(spark):
    """Grids of rates aren't rows, 1024 rows of a series aren't shuffled; lowest points inside and beyond both ends of the grid,
    and columns equal to what is normal."""
    matrix = channel.piecewise_matrix(spark, 2.0)
    m, rng, rows, shares = hmm.table(matrix), np.random.default_rng(11), [], {}
    for key, (share, column) in enumerate(((0.0, 3), (0.3, 0), (1.0, 31), (0.66, 17))):
        obs = rng.choice(32, 400, p=(1 - share) * m.mean(axis=1) + share * m[:, column])
        rows += [(key, t, int(o)) for t, o in enumerate(obs)]
        shares[key] = np.bincount(obs, minlength=32) / 400
    calibration = spark.range(4).select(F.col("id").cast("int").alias("series_id"), F.explode(F.sequence(F.lit(0), F.lit(31))).alias("stuck_bucket")).withColumn("alpha", F.lit(1 / 32))
    p0 = channel.normal(matrix, calibration)
    fit = detectors.mixture(spark.createDataFrame(rows, "series_id int, t long, obs int"), matrix, p0)
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    assert plan(fit).count("Generate explode") == plan(p0).count("Generate explode")
    assert not any("Exchange hashpartitioning" in line and "report_bucket" in line for line in plan(p0).splitlines())
    found = {r.series_id: (r.loss, r.candidate, round(r.rate, 9)) for r in fit.collect()}
    for key, q in shares.items():
        losses = [(round(float(((q - (1 - r) * m.mean(axis=1) - r * m[:, c]) ** 2).sum()), 12), c, round(r, 9)) for c in range(32) for r in np.linspace(0.01, 0.70, 100)]
        assert found[key] == min(losses)
    flat = matrix.select("stuck_bucket", "report_bucket", F.lit(1 / 32).alias("p"))
    same = detectors.mixture(spark.createDataFrame(rows, "series_id int, t long, obs int"), flat, flat.where("stuck_bucket = 0").select(F.lit(0).alias("series_id"), "report_bucket", F.col("p").alias("p0"))).first()
    assert (same.candidate, same.rate) == (0, 0.01)


def test_lists_of_ratios_are_the_ratios(spark):
    matrix = channel.piecewise_matrix(spark, 2.0)
    calibration = spark.range(64).select((F.col("id") % 2).cast("int").alias("series_id"), F.floor(F.col("id") / 2).cast("int").alias("stuck_bucket"), (F.lit(0.01) + F.col("id") / 3000).alias("alpha"))
    p0 = channel.normal(matrix, calibration).localCheckpoint()
    rows = spark.createDataFrame([(k, t, (t * 7 + k) % 32) for k in range(2) for t in range(70)], "series_id int, t long, obs int")
    lists = detectors.ratio_lists(matrix, p0)
    assert lists.count() == 64 and lists.where("size(of) <> 32").count() == 0
    for detector in (detectors.point_glr, detectors.window_glr, detectors.llr_cusum):
        a, b = (sorted(map(tuple, detector(rows, t).collect())) for t in (detectors.ratios(matrix, p0), lists))
        assert a == b and len(a) == 140


def test_series_lists_are_no_broadcast(spark, tmp_path):
    """Read from small files, what lists leave is 384 MiB of a broadcast at 3,456,000 rows."""
    matrix = channel.piecewise_matrix(spark, 2.0)
    spark.range(64).select((F.col("id") % 2).cast("int").alias("series_id"), F.floor(F.col("id") / 2).cast("int").alias("report_bucket"), F.lit(1 / 32).alias("p0")).write.parquet(str(tmp_path / "p0"))
    lists = detectors.ratio_lists(matrix, spark.read.parquet(str(tmp_path / "p0")))
    rows = spark.createDataFrame([(k, t, t % 32) for k in range(2) for t in range(70)], "series_id int, t long, obs int")
    for detector in (detectors.point_glr, detectors.window_glr):
        assert "SortMergeJoin" in detector(rows, lists)._jdf.queryExecution().executedPlan().toString()
