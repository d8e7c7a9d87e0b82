"""Detectors on series that go through many settings: a series' rows are dealt once, and only what is asked for leaves its task.

Faults, reports, scores and their ranking are worked on in NumPy where the rows are, blocks of series side by side under all
settings of a channel, so what is shuffled and stored doesn't grow with the settings. A task holds a batch, a block of CELLS and
one series' rows. Series of more than HELD rows don't come here: they take the windows of detectors.py and the scan of scan.py,
which give the same scores whatever a series' length.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import channel, detectors, scan

#: Rows of a series at most, and rows times settings of a block; settings of a series have keys of their own.
HELD, CELLS, SETTINGS = 1 << 14, 1 << 15, 64
LEAST, FLOOR, SMOOTHING = 1e-15, 1e-12, 1e-3
WIDTHS = (8, 16, 32, 64)
MOST = np.iinfo(np.int64).max
COLUMNS = ("series_id", "own", "t", "id", "v", "train")


@dataclass(frozen=True)
class Setting:
    """number: its place in a series' key. Faults of a mode on a share of the rows in segments of a length, held at a value, or at
    that of a series' note of the number `note`; rate and lasts: what the posterior model expects; mixed: the stuck bucket's share
    in the calibration."""

    number: int
    seed: int
    mode: str = "segment_stuck"
    share: float = 0.2
    length: float = 48
    stuck: float = 0.3
    note: int | None = None
    rate: float = 0.2
    lasts: float = 48
    mixed: float = 0.0


@dataclass(frozen=True)
class Channel:
    """The epsilon of the reports, the model's table (reports x candidates, as many of each), and the settings seen through it."""

    epsilon: float
    matrix: np.ndarray
    settings: tuple[Setting, ...]


@dataclass(frozen=True)
class Block:
    """Series from the longest on, rows in the order of t, filled up to the longest one's; notes: numbers, counts, values."""

    ids: np.ndarray
    size: np.ndarray
    inside: np.ndarray
    t: np.ndarray
    id: np.ndarray
    v: np.ndarray
    train: np.ndarray
    notes: tuple[np.ndarray, np.ndarray, np.ndarray]
    noted: np.ndarray


def stream(rows: DataFrame, notes: DataFrame | None = None) -> DataFrame:
    """rows (series_id, t, id, v, part) dealt by series in order; notes (series_id, number, n, value) come before a series' rows."""
    out = rows.select(F.col("series_id").cast("long").alias("series_id"), F.lit(True).alias("own"), F.col("t").cast("long").alias("t"), F.col("id").cast("long").alias("id"), F.col("v").cast("double").alias("v"), (F.col("part") == "train").alias("train"))
    if notes is not None:
        out = out.union(notes.select(F.col("series_id").cast("long"), F.lit(False), F.col("number").cast("long"), F.col("n").cast("long"), F.col("value").cast("double"), F.lit(False)))
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # given, as few bytes here are much work
    return out.repartition(n, "series_id").sortWithinPartitions("series_id", "own", "t")


def blocks(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[Block]:
    """Whole series of about `most` rows, of like lengths."""
    parts: list[list[np.ndarray]] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        parts.append([batch.column(c).to_numpy(zero_copy_only=False) for c in COLUMNS])
        if parts[0][0][0] != parts[-1][0][-1]:
            whole = [np.concatenate(x) for x in zip(*parts, strict=True)]
            begin = int(np.searchsorted(whole[0], whole[0][-1]))
            yield from _cut([x[:begin] for x in whole], most)
            parts = [[x[begin:] for x in whole]]
    if parts:
        yield from _cut([np.concatenate(x) for x in zip(*parts, strict=True)], most)


def _cut(columns: list[np.ndarray], most: int) -> Iterator[Block]:
    own = columns[1].astype(bool)
    (ids, _, t, key, v, train), (noted, _, number, n, value, _) = [x[own] for x in columns], [x[~own] for x in columns]
    if not len(ids):
        return
    names, begin, size = np.unique(ids, return_index=True, return_counts=True)
    order = np.argsort(-size, kind="stable")
    at = 0
    while at < len(order):
        longest = size[order[at]]
        end = min(at + max(1, most // longest), int(np.searchsorted(-size[order], -(longest // 2), "right")))
        chosen = order[at:end]
        inside = np.arange(longest) < size[chosen][:, None]
        places = np.where(inside, begin[chosen][:, None] + np.arange(longest), begin[chosen][:, None])
        first, last = np.searchsorted(noted, names[chosen]), np.searchsorted(noted, names[chosen], "right")
        width = np.arange(max(1, int((last - first).max())))
        where, there = first[:, None] + width, width < (last - first)[:, None]
        given = tuple(np.where(there, x[np.minimum(where, max(0, len(x) - 1))] if len(x) else 0, none) for x, none in ((number, -1), (n, 0), (value, np.nan)))
        yield Block(names[chosen], size[chosen], inside, t[places], key[places], v[places], train[places].astype(bool) & inside, given, last - first)
        at = end


def uniform(ids: np.ndarray, k: int) -> np.ndarray:
    mixed = np.fmod(np.fmod(ids, 2147483648) * channel.DRAWS[k] + k * 12345, 2147483648)
    return np.fmod(mixed * 16807 + mixed // 8192, 2147483648) / 2147483648.0


def piecewise(v: np.ndarray, epsilon: float, u: np.ndarray, w: np.ndarray) -> np.ndarray:
    s, c = channel.shape(epsilon)
    low, high = (s * v - 1.0) / (s - 1), (s * v + 1.0) / (s - 1)
    place = w * (low + c + c - high)
    tail = np.where(place < low + c, -c + place, high + (place - (low + c)))
    return np.where(u < s / (s + 1), low + w * (high - low), tail)


def bins(x: np.ndarray, d: int) -> np.ndarray:
    return np.clip(np.floor(x), 0, d - 1).astype(np.int64)


def first(key: np.ndarray, inside: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The `count` rows of each series whose keys, all different, are the least."""
    key = np.where(inside, key, MOST)
    limit = np.take_along_axis(np.sort(key, axis=1), np.clip(count - 1, 0, key.shape[1] - 1)[:, None], axis=1)
    return inside & (key <= limit) & (count > 0)[:, None]


def percentile(x: np.ndarray, inside: np.ndarray, size: np.ndarray, share: float) -> np.ndarray:
    x, place = np.sort(np.where(inside, x, np.inf), axis=1), (size - 1) * share
    low, high = np.floor(place).astype(np.int64), np.ceil(place).astype(np.int64)
    a, b = (np.take_along_axis(x, i[:, None], axis=1)[:, 0] for i in (low, high))
    return np.where((low == high) | (a == b), a, (high - place) * a + (place - low) * b)


def faulty(block: Block, setting: Setting) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """label, the values with faults, and whether a series has this setting (it lacks one whose note it lacks)."""
    key, size, exists = block.ids * SETTINGS + setting.number, block.size, np.ones(len(block.ids), bool)
    length, value = np.full(len(key), float(setting.length)), np.full(len(key), setting.stuck)
    if setting.mode == "template_stuck":
        drawn = np.fmod(np.fmod(key * 7919 + 12345, 1000003), np.maximum(block.noted, 1)) + 1
        hit = block.notes[0] == drawn[:, None]
        known, own = hit.any(axis=1), hit.argmax(axis=1)[:, None]
        least = np.maximum(8, np.minimum(96, size // 3))
        length = np.maximum(8, np.where(known, np.minimum(least, np.take_along_axis(block.notes[1], own, axis=1)[:, 0]), least)).astype(float)
        level = np.clip(np.take_along_axis(block.notes[2], own, axis=1)[:, 0], -1, 1)
        value = np.where(known, level, percentile(block.v, block.inside, size, 0.95))
        count = np.maximum(1, np.floor(size * setting.share + 0.5)).astype(np.int64)
    else:
        count = np.floor(size * setting.share).astype(np.int64)
    if setting.note is not None:
        hit = block.notes[0] == setting.note
        exists, value = hit.any(axis=1), np.take_along_axis(block.notes[2], hit.argmax(axis=1)[:, None], axis=1)[:, 0]
    if setting.mode == "iid_stuck":
        ids = block.id + setting.seed * 1_000_003
        place = np.argsort(np.argsort(np.where(block.inside, ids, MOST), axis=1, kind="stable"), axis=1)
        order = np.fmod(ids * 7919, 1000003) * (1 << 40) + place
    else:
        segment = np.floor(block.t / length[:, None]).astype(np.int64)
        order = np.fmod(segment * 7919 + key[:, None] * 104729, 1000003) * (1 << 40) + block.t
    label = first(order, block.inside, count)
    bad = np.clip(block.v + 0.35, -1, 1) if setting.mode == "bias" else value[:, None]
    return label, np.where(label, bad, block.v), exists


def window_glr(obs: np.ndarray, size: np.ndarray, logs: np.ndarray, quiet: np.ndarray, widths: tuple[int, ...] = WIDTHS) -> np.ndarray:
    """obs and the chances' logarithms `quiet`: rows x series; logs: candidates x reports; widths are even. As detectors.window_glr."""
    n, m = obs.shape
    inside = (np.arange(n)[:, None] < size).astype(float)
    upto, best = np.zeros((n + 1, m)), {w: np.full((n - w + 1, m), -np.inf) for w in widths if w <= n}
    for own in logs:
        ratio = (own[obs] - quiet) * inside
        for t in range(n):
            np.add(upto[t], ratio[t], out=upto[t + 1])
        for w, found in best.items():
            np.maximum(found, upto[w:] - upto[:-w], out=found)
    score = np.zeros((n, m))
    for w, found in best.items():
        # a window that begins at s lies w rows on; the rows from s + 1 to s + w see it
        near = np.zeros((n + w, m))
        near[w : n + 1] = np.where(np.arange(n - w + 1)[:, None] + w <= size, found, 0.0)
        k = 1
        while 2 * k <= w:
            near[:-k] = np.maximum(near[:-k], near[k:])
            k *= 2
        np.maximum(score, np.maximum(near[:n], near[w - k : n + w - k]), out=score)
    return score * inside


def posterior(obs: np.ndarray, size: np.ndarray, columns: np.ndarray, quiet: np.ndarray, p01: np.ndarray, p11: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """obs and quiet (the normal chances of the reports): rows x series, from the longest series on; columns: reports x
    candidates. As scan.posteriors: the score of each row and the candidate of each series."""
    n, m = obs.shape
    live = np.searchsorted(-size, -np.arange(n), "left")
    a, b, c, d = 1 - p01, p01, 1 - p11, p11
    zero, one, logs = np.repeat((1 - start)[None], columns.shape[1], axis=0), np.repeat(start[None], columns.shape[1], axis=0), np.zeros((columns.shape[1], m))
    across = np.ascontiguousarray(columns.T)
    for t in range(n):
        k = live[t]
        x, y, fault = zero[:, :k], one[:, :k], np.take(across, obs[t, :k], axis=1)
        if t:
            x, y = x * a[:k] + y * c[:k], x * b[:k] + y * d[:k]
        zero[:, :k], one[:, :k] = x * quiet[t, :k], y * fault
        if t % scan.SCALED == scan.SCALED - 1:
            total = zero[:, :k] + one[:, :k]
            zero[:, :k] /= total
            one[:, :k] /= total
            logs[:, :k] += np.log(total)
    best = scan.largest(logs + np.log(zero + one), 0)
    fault, state, score = columns[obs, best], np.empty((n, 2, m)), np.zeros((n, m))
    x, y = 1 - start, start.copy()
    for t in range(n):
        k = live[t]
        if t:
            x, y = x[:k] * a[:k] + y[:k] * c[:k], x[:k] * b[:k] + y[:k] * d[:k]
        x, y = x * quiet[t, :k], y * fault[t, :k]
        total = x + y
        x, y = x / total, y / total
        state[t, 0, :k], state[t, 1, :k] = x, y
    p, q = np.ones(m), np.ones(m)
    for t in range(n - 1, -1, -1):
        k = live[t]
        joint = state[t, 1, :k] * q[:k]
        score[t, :k] = joint / (state[t, 0, :k] * p[:k] + joint)
        x, y = p[:k] * quiet[t, :k], q[:k] * fault[t, :k]
        x, y = a[:k] * x + b[:k] * y, c[:k] * x + d[:k] * y
        p[:k], q[:k] = x / (x + y), y / (x + y)
    return score, best


def mixture(counts: np.ndarray, size: np.ndarray, matrix: np.ndarray, p0: np.ndarray, steps: int = 100) -> np.ndarray:
    """The fault's share at each report (series x reports) by the best fit. As detectors.mixture and mixture_posterior."""
    away, g = counts / size[:, None] - p0, matrix[None] - p0[:, :, None]
    dd, dg, gg = (away * away).sum(axis=1), np.einsum("nb,nbc->nc", away, g), np.einsum("nbc,nbc->nc", g, g)
    low, step = detectors.LOW, (detectors.HIGH - detectors.LOW) / (steps - 1)
    place = np.divide(dg, gg, out=np.zeros_like(dg), where=gg != 0)
    below = np.floor(np.clip((place - low) / step, -1, steps)).astype(np.int64)
    loss = lambda r, x, y: np.floor((dd[:, None] - 2 * r * x + r * r * y) * 1e12 + 0.5)
    least = np.min([loss(low + np.clip(below + k, 0, steps - 1) * step, dg, gg) for k in (-1, 0, 1, 2)], axis=0)
    best = least.argmin(axis=1)[:, None]
    grid = low + np.arange(steps) * step
    own = loss(grid[None], np.take_along_axis(dg, best, axis=1), np.take_along_axis(gg, best, axis=1))
    rate = grid[(own == np.take_along_axis(least, best, axis=1)).argmax(axis=1)][:, None]
    fault, normal = rate * matrix.T[best[:, 0]], (1.0 - rate) * p0
    return fault / np.maximum(fault + normal, LEAST)


def robust_z(x: np.ndarray, inside: np.ndarray, size: np.ndarray) -> np.ndarray:
    away = np.abs(x - percentile(x, inside, size, 0.5)[:, None])
    return away / np.maximum(1e-6, 1.4826 * percentile(away, inside, size, 0.5))[:, None]


def whole(score: np.ndarray) -> np.ndarray:
    """Scores to six digits, in millionths."""
    return np.copysign(np.floor(np.abs(score) * 1e6 + 0.5), score).astype(np.int64)


def areas(score: np.ndarray, label: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """positives, negatives, auroc, auprc of each series' scores in millionths, equal ones together; NaN where a class is missing."""
    n = score.shape[1]
    inside = np.arange(n) < size[:, None]
    key = np.sort(np.where(inside, label - 2 * score, MOST), axis=1)
    hit, value, seen = (key & 1) * inside, key >> 1, np.arange(1, n + 1)
    end = inside & np.concatenate([value[:, 1:] != value[:, :-1], np.ones((len(key), 1), bool)], axis=1)
    end |= seen == size[:, None]
    tp = np.cumsum(hit, axis=1)
    before = np.zeros((2, *key.shape))
    for k, x in enumerate((tp, np.broadcast_to(seen, key.shape))):
        before[k, :, 1:] = np.maximum.accumulate(np.where(end, x, 0), axis=1)[:, :-1]
    hits = tp - before[0]
    others = seen - before[1] - hits
    positives = tp[:, -1]
    negatives = size - positives
    both = (positives > 0) & (negatives > 0)
    with np.errstate(invalid="ignore", divide="ignore"):
        auroc = np.where(end, others * (tp - hits / 2.0), 0.0).sum(axis=1) / positives / negatives
        auprc = np.where(end, hits / positives[:, None] * tp / seen, 0.0).sum(axis=1)
    return positives, negatives, np.where(both, auroc, np.nan), np.where(both, auprc, np.nan)


def scores(block: Block, seen: Channel, methods: tuple[str, ...], known: dict) -> Iterator[tuple[str, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For each method: name, places of series, numbers of settings, scores in millionths, labels, sizes, candidates (-1 for
    none), chances of normal reports; a line for each series and setting that has scores. known: what other channels found."""
    for x in seen.settings:
        if x.number not in known:
            known[x.number] = faulty(block, x)
        if ("seed", x.seed) not in known:
            ids = block.id + x.seed * 1_000_003
            known["seed", x.seed] = uniform(ids, 1), uniform(ids, 2)
    k, (n, longest), out = len(seen.settings), block.t.shape, seen.matrix.shape[0]
    merged = lambda parts: np.stack(parts, axis=1).reshape(n * k, -1)
    label, vf = (merged([known[x.number][i] for x in seen.settings]) for i in (0, 1))
    exists = np.stack([known[x.number][2] for x in seen.settings], axis=1).reshape(-1)
    size, inside = np.repeat(block.size, k), np.repeat(block.inside, k, axis=0)
    place, number = np.repeat(np.arange(n), k), np.tile([x.number for x in seen.settings], n)
    if "robust_z" in methods:
        keep = np.flatnonzero(exists)
        yield "robust_z", place[keep], number[keep], whole(robust_z(vf, inside, size))[keep], label[keep], size[keep], np.full(len(keep), -1), np.full((len(keep), out), np.nan)
    keep = np.flatnonzero(exists & np.repeat(block.train.any(axis=1), k))  # nothing is normal for a series without a training part
    if not len(keep) or set(methods) == {"robust_z"}:
        return
    _, c = channel.shape(seen.epsilon)
    y = merged([piecewise(known[x.number][1], seen.epsilon, *known["seed", x.seed]) for x in seen.settings])
    obs = np.where(inside, bins((y + c) / (2 * c / out), out), 0)[keep]
    home = np.where(block.train, np.arange(n)[:, None] * out + bins((block.v + 1.0) * (out / 2), out), n * out)
    counts = np.bincount(home.ravel(), minlength=n * out + 1)[:-1].reshape(n, out)
    alpha = ((counts + SMOOTHING) / (counts.sum(axis=1, keepdims=True) + out * SMOOTHING))[:, None]
    mixed = np.array([x.mixed for x in seen.settings])[:, None]
    hot = np.stack([np.arange(out) == int(bins(np.array((x.stuck + 1.0) * (out / 2)), out)) for x in seen.settings]) * mixed
    p0 = (alpha * (1 - mixed) + hot).reshape(n * k, out)[keep] @ seen.matrix.T
    label, size, place, number, inside = label[keep], size[keep], place[keep], number[keep], inside[keep]
    lines, none = np.arange(len(keep)), np.full(len(keep), -1)
    at = lambda table: table[lines[:, None], obs]
    quiet, logs = np.log(np.maximum(p0, LEAST)), np.log(np.maximum(seen.matrix, LEAST))
    across = np.ascontiguousarray(obs.T)
    for name in methods:
        best = none
        if name == "surprise":
            score = at(-quiet)
        elif name == "point_glr":
            score = at(logs.max(axis=1) - quiet)
        elif name == "window_glr":
            score = window_glr(across, size, np.ascontiguousarray(logs.T), at(quiet).T).T
        elif name == "mixture":
            seen_counts = np.bincount((lines[:, None] * out + obs)[inside], minlength=len(keep) * out).reshape(-1, out)
            score = at(mixture(seen_counts, size, seen.matrix, p0))
        elif name == "hmm":
            p11 = np.array([max(0.5, 1 - 1 / max(float(x.lasts), 2.0)) for x in seen.settings])
            rate = np.array([x.rate for x in seen.settings])
            p01 = np.minimum(0.2, np.maximum(1e-4, rate * (1 - p11) / np.maximum(1 - rate, 1e-6)))
            own = keep % k
            score, best = posterior(across, size, np.maximum(seen.matrix, FLOOR), at(np.maximum(p0, FLOOR)).T, p01[own], p11[own], rate[own])
            score = score.T
        else:
            continue
        yield name, place, number, whole(score), label, size, best, p0


AREAS = "series_id long, channel int, setting int, method string, positives long, negatives long, auroc double, auprc double, candidate int, tv double, kl double"
SCORES = "series_id long, channel int, setting int, label int, score double"
FORMS = {
    AREAS: pa.schema([("series_id", pa.int64()), ("channel", pa.int32()), ("setting", pa.int32()), ("method", pa.string()), ("positives", pa.int64()), ("negatives", pa.int64()), ("auroc", pa.float64()), ("auprc", pa.float64()), ("candidate", pa.int32()), ("tv", pa.float64()), ("kl", pa.float64())]),
    SCORES: pa.schema([("series_id", pa.int64()), ("channel", pa.int32()), ("setting", pa.int32()), ("label", pa.int32()), ("score", pa.float64())]),
}


def separations(seen: Channel, p0: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Total variation and divergence of the stuck column of a bucket from normal reports. As channel.separation."""
    fault = seen.matrix.T[at]
    p, q = np.maximum(fault, FLOOR), np.maximum(p0, FLOOR)
    return 0.5 * np.abs(fault - p0).sum(axis=1), (p * np.log(p / q)).sum(axis=1)


def areas_of(rows: DataFrame, channels: list[Channel], methods: tuple[str, ...], notes: DataFrame | None = None) -> DataFrame:
    """A row for each series, channel, setting and method: positives, negatives, auroc, auprc, the posterior model's candidate,
    and, where values come from notes, how far the channel sets the value's column apart (tv, kl)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, most):
            known: dict = {}
            for i, seen in enumerate(channels):
                of = {x.number: x for x in seen.settings}
                for name, place, number, score, label, size, best, p0 in scores(block, seen, methods, known):
                    if not len(place):
                        continue
                    positives, negatives, auroc, auprc = areas(score, label, size)
                    tv = kl = np.full(len(place), np.nan)
                    if of[number[0]].note is not None:
                        hit = block.notes[0][place] == np.array([of[x].note for x in number])[:, None]
                        value = np.take_along_axis(block.notes[2][place], hit.argmax(axis=1)[:, None], axis=1)[:, 0]
                        tv, kl = separations(seen, p0, bins((value + 1.0) * (seen.matrix.shape[1] / 2), seen.matrix.shape[1]))
                    columns = [block.ids[place], np.full(len(place), i), number, pa.repeat(name, len(place)), positives, negatives]
                    columns += [pa.array(x, mask=np.isnan(x)) for x in (auroc, auprc)] + [pa.array(best, mask=best < 0)] + [pa.array(x, mask=np.isnan(x)) for x in (tv, kl)]
                    yield _batch(AREAS, columns)

    most = max(1, CELLS // max(len(x.settings) for x in channels))
    return stream(rows, notes).mapInArrow(run, AREAS)


def scores_of(rows: DataFrame, channels: list[Channel], method: str) -> DataFrame:
    """The rows' labels and scores, to six digits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, most):
            known: dict = {}
            for i, seen in enumerate(channels):
                for _, place, number, score, label, size, _, _ in scores(block, seen, (method,), known):
                    inside = np.arange(score.shape[1]) < size[:, None]
                    yield _batch(SCORES, [np.repeat(block.ids[place], size), np.full(int(size.sum()), i), np.repeat(number, size), label[inside], score[inside] / 1e6])

    most = max(1, CELLS // max(len(x.settings) for x in channels))
    return stream(rows).mapInArrow(run, SCORES)


def _batch(form: str, columns: list) -> pa.RecordBatch:
    own = FORMS[form]
    return pa.RecordBatch.from_arrays([(c if isinstance(c, pa.Array) else pa.array(c)).cast(f.type) for c, f in zip(columns, own, strict=True)], schema=own)


def of_number(values: list, column: str) -> Column:
    """What stands for a number from 0 on."""
    return F.element_at(F.array(*map(F.lit, values)), F.col(column) + 1)
