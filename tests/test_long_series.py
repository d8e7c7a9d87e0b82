"""Series of any length: the parallel scan against the recursion, the stream against the batch, ranges against all windows."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidewright.operators import hmm, scan, selection
from tidewright.operators import series as S
from tidewright.streaming import shortlist

OUT, CANDIDATES = 6, 4


@pytest.fixture(scope="module")
def model():
    rng = np.random.default_rng(1)
    columns = rng.dirichlet(np.ones(OUT), CANDIDATES).T
    columns[:, 3] = columns[:, 1]  # equal candidates: the lower one counts
    return columns, rng.dirichlet(np.ones(OUT), 4)


def series(rng, n: int) -> list[int | None]:
    return [None if x < 0.05 else int(y) for x, y in zip(rng.random(n), rng.integers(0, OUT, n), strict=True)]


@pytest.mark.parametrize("per_row", [False, True])
def test_scan_is_the_recursion(spark, model, per_row):
    columns, normal = model
    rng, p01, p11, start = np.random.default_rng(2), 0.03, 0.9, 0.2
    data = {0: series(rng, 700), 1: series(rng, 1), 2: series(rng, 4), 3: [None] * 9}
    rows = spark.createDataFrame([(i, t, o, "x") for i, own in data.items() for t, o in enumerate(own)], "series_id int, t long, obs int, normal string").drop("normal").withColumn("at", F.lit("clash")).repartition(6)
    normals = spark.createDataFrame([(i, normal[i].tolist()) for i in range(4)], "series_id int, normal array<double>")
    chain = scan.Chain(columns, p01, p11, start)
    for block, fan in ((256, 256), (4, 3)):  # one level, and many
        got = {(r.series_id, r.t): r for r in scan.posteriors(rows, normals, chain, per_row, block, fan).collect()}
        assert len(got) == sum(map(len, data.values()))
        for i, own in data.items():
            e = np.ones((len(own), 2, CANDIDATES))
            for t, o in enumerate(own):
                if o is not None:
                    e[t] = [np.repeat(normal[i, o], CANDIDATES), columns[o]]
            likelihood, posterior = hmm.forward_backward(e, p01, p11, start)
            best = int(np.argmax(np.round(likelihood, 9)))
            want = posterior.max(axis=1) if per_row else posterior[:, best]
            assert np.allclose([got[i, t].score for t in range(len(own))], want, rtol=0, atol=1e-9)
            assert per_row or {got[i, t].candidate for t in range(len(own))} == {best}
            assert abs(got[i, 0].rate - want.mean()) < 1e-9
    assert scan.posteriors(rows.where("false"), normals, chain).count() == 0


def test_stream_equals_the_batch_whatever_the_cut(spark, model):
    columns, normal = model
    rng = np.random.default_rng(3)
    data = {0: series(rng, 90), 1: series(rng, 33), 2: series(rng, 1)}
    rows = spark.createDataFrame([(i, t, o, normal[i].tolist()) for i, own in data.items() for t, o in enumerate(own)], shortlist.ROWS)
    settings = {"few": 2, "block": 8, "rate": 0.1, "length": 12.0}
    for parts in (1, 3):
        got = {(r.series_id, r.t): (r.score, r.candidate) for r in shortlist.replay(rows, columns, settings, parts).collect()}
        for i, own in data.items():
            score, best = hmm.Shortlist.new(columns, normal[i], **settings).feed(own)
            assert [got[i, t] for t in range(len(own))] == list(zip(score, best, strict=True))
    assert shortlist.replay(rows.where("false"), columns, settings).count() == 0


class Kept:
    """A value of state, and the timers of a key, as a test holds them."""

    def __init__(self):
        self.value, self.timers = None, []

    def getValueState(self, name, schema):
        return self

    def exists(self):
        return self.value is not None

    def get(self):
        return self.value

    def update(self, value):
        self.value = value

    def clear(self):
        self.value = None

    def listTimers(self):
        return iter(list(self.timers))

    def registerTimer(self, at):
        self.timers.append(at)

    def deleteTimer(self, at):
        self.timers.remove(at)

    def getCurrentProcessingTimeInMs(self):
        return 1000 + len(self.timers)


def test_silent_series_are_forgotten(model):
    columns, normal = model
    settings, own, kept = {"few": 2, "block": 8}, [1, 2, 3, 4], Kept()
    processor = shortlist.ShortlistProcessor(columns, settings, 500)
    processor.init(kept)

    def send(t: int) -> list[float]:
        batch = pd.DataFrame({"series_id": 5, "t": [t, t + 1], "obs": own[t : t + 2], "normal": [normal[0].tolist()] * 2})
        return pd.concat(processor.handleInputRows((5,), iter([batch]), kept))["score"].tolist()

    fresh = lambda reports: hmm.Shortlist.new(columns, normal[0], **settings).feed(reports)[0]
    assert send(0) + send(2) == fresh(own) and len(kept.timers) == 1  # each batch puts the timer off
    assert not len(pd.concat(processor.handleExpiredTimer((5,), kept, None))) and not kept.exists()
    assert send(2) == fresh(own[2:])


def test_matched_negatives_against_all_windows(spark):
    rng, rows, runs = np.random.default_rng(4), [], []
    for i, n in enumerate((300, 40, 9)):
        label = np.zeros(n, int)
        for at, size in ((5, 1), (20, 3), (28, 7), (100, 37)):
            if at + size <= n:
                label[at : at + size] = 1
                runs.append((i, at, size))
        rows += [(i, t, float(np.round(x, 3)), int(y)) for t, (x, y) in enumerate(zip(rng.normal(size=n).cumsum() * 0.05, label, strict=True))]
    runs.append((2, 0, 9))
    frame = spark.createDataFrame(rows, "series_id long, t long, v double, label int")
    given = spark.createDataFrame(runs, "series_id long, begin long, n long")
    want = set()
    for i, begin, size in runs:
        own = [(x, y) for s, _, x, y in rows if s == i]
        clean = [t for t in range(len(own) - size + 1) if not any(y for _, y in own[t : t + size])]
        good = [t for t in clean if max(x for x, _ in own[t : t + size]) - min(x for x, _ in own[t : t + size]) > 0.06]
        chosen = sorted(good if len(good) >= 5 else clean, key=lambda t: ((t * 7919 + i * 104729) % 1000003, t))[:5]
        want |= {(i, size, begin, k, t) for k, t in enumerate(chosen)}
    for block in (1024, 64):  # windows that reach into the next block
        table = selection.sparse_table(frame, "v", 37, block)
        assert table.where("own").count() == len(rows)
    got = {(r.series_id, r.n, r.begin, r.negative, r.start) for r in selection.matched_negatives(frame, given, "v", 0.06).collect()}
    assert got == want


def test_wide_medians_against_sorted_windows(spark):
    rng, rows = np.random.default_rng(6), []
    for i, n in enumerate((400, 37, 1)):
        rows += [(i, t, None if rng.random() < 0.2 else float(rng.integers(0, 9))) for t in range(n)]  # many ties
    frame = spark.createDataFrame(rows, "series_id long, t long, x double")
    for width, block in ((31, 40), (8, 40), (51, 4096)):
        got = {(r.series_id, r.t): r.median for r in S.wide_median(frame, "x", width, block=block).collect()}
        assert len(got) == len(rows)
        for i in (0, 1, 2):
            own = [x for k, _, x in rows if k == i]
            for t in range(len(own)):
                inside = [x for x in own[max(0, t - width // 2) : t + (width - 1) // 2 + 1] if x is not None]
                assert got[i, t] == (float(np.median(inside)) if len(inside) >= max(3, width // 4) else None)
    assert S.wide_median(frame.where("false"), "x", 9).count() == 0
