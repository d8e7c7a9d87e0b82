"""BOND against all pairs, with nulls, ties, repeated rows, other lengths and several blocks."""

from collections import Counter
from math import floor, inf, nan

import numpy as np
import pytest

from tidewright.llm import hard_negatives

SCHEMA = "vec_id long, embedding array<float>, label int, tag string, anchor string"


def table(n: int = 400, seed: int = 1) -> list[tuple]:
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(3, 12))
    rows = [(i, [float(np.float32(x)) for x in centres[i % 3] * rng.integers(0, 2) + rng.normal(size=12) * 0.7], i % 3, "clash", "clash") for i in range(n)]
    rows += [rows[100], rows[100], rows[7], (100, rows[8][1], 1, "", ""), (200, rows[101][1], 2, "", "")]  # repeats, ids with other vectors, equal vectors
    rows += [(300, [0.5], 0, None, None), (301, [], 1, "", ""), (None, rows[0][1], 0, "", ""), (None, rows[1][1], 1, "", "")]
    rows += [(500, None, 1, "", ""), (501, rows[3][1], None, "", ""), (600, [1.0, nan], 1, "", ""), (700, [inf] * 12, 2, "", ""), (800, [0.1, None], 0, "", "")]
    return rows


def brute(rows: list[tuple], positives: int = 5, negatives: int = 10) -> Counter:
    sound = [(i, lab, [floor(256 * x) for x in v]) for i, v, lab, *_ in rows if v is not None and lab is not None and all(x is not None and np.isfinite(x) for x in v)]
    big = lambda i: (i is None, i or 0)
    out = Counter()
    for a, (anchor, label, q) in enumerate(sound):
        if anchor is None or anchor % 100:
            continue
        scored = [(sum(x * y for x, y in zip(q, v, strict=False)), i, lab) for b, (i, lab, v) in enumerate(sound) if b != a]
        scored.sort(key=lambda s: (-s[0], big(s[1])))
        for p, pos, _ in [s for s in scored if s[2] == label][:positives]:
            hits = [(n, i) for n, i, lab in scored if lab != label and 30 * p <= 100 * n <= 90 * p][:negatives]
            out.update((anchor, pos, rank, i, p, n) for rank, (n, i) in enumerate(hits, 1))
    return out


@pytest.mark.parametrize("sizes", [None, (64, 30)])
def test_mine_equals_all_pairs(spark, monkeypatch, sizes):
    if sizes:  # many blocks of rows, and of anchors
        monkeypatch.setattr(hard_negatives, "BLOCK", sizes[0])
        monkeypatch.setattr(hard_negatives, "ANCHORS", sizes[1])
    rows = table()
    got = hard_negatives.mine(spark.createDataFrame(rows, SCHEMA).repartition(5), "vec_id % 100 = 0")
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    assert Counter(map(tuple, got.collect())) == brute(rows)


def test_no_rows_and_no_anchors(spark):
    frame = spark.createDataFrame(table(), SCHEMA)
    assert hard_negatives.mine(frame.where("false"), "vec_id % 100 = 0").count() == 0
    assert hard_negatives.mine(frame, "vec_id = -1").count() == 0


def test_scores_beyond_64_bits_are_refused(spark):
    frame = spark.createDataFrame([(0, [1e30], 1, "", ""), (1, [1.0], 1, "", "")], SCHEMA)
    with pytest.raises(Exception, match="too large"):
        hard_negatives.mine(frame, "vec_id = 0").collect()


def test_bounds_prune_before_the_last_dimension():
    """A block's columns after the first few are read for candidates only."""
    rng = np.random.default_rng(2)
    columns = rng.integers(-40, 40, (64, 4000))
    columns[:, :50] += 30 * np.sign(columns[:, :1])  # a cluster round the anchor
    block = hard_negatives.Block(np.arange(4000), np.ones(4000, np.int64), np.zeros(4000, np.int64), columns)
    seen, best = [], hard_negatives.Best(6)
    resolve = block.resolve
    block.resolve = lambda q, own, keep: resolve(q, own, lambda a, b: seen.append(len(a)) or keep(a, b))
    hard_negatives.first_of_label(block, 1, columns[:, 0], best)
    want = columns[:, 0] @ columns
    assert best.rows[0].tolist() == np.sort(want)[::-1][:6].tolist()
    assert seen[0] == 4000 and seen[-1] < 100
