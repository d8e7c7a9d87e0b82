"""Forward and backward over hidden two-state chains of any length, as a parallel scan.

A series is cut into blocks of rows. Each block's rows multiply to one 2 x 2 transfer matrix for each candidate; matrices
of FAN neighbours are multiplied in turn, level by level, until one for a series is left, which has the candidates'
likelihoods. On the way down every node hands its children the state that enters them from the left and the weight of
what follows on the right, so that each block goes forward and backward by itself. No task holds a series.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewright import stage

#: Rows of a block, nodes under one of the next level, rows worked on at a time, steps between two scalings.
BLOCK, FAN, HELD, SCALED = 256, 256, 1 << 14, 8
LEAST = 1e-15
NODES = "series_id long, at long, begin binary, product binary, logs binary"
#: What enters a node and what follows it, for each candidate, and the candidate of the largest likelihood.
ENTERS = "series_id long, at long, left binary, right binary, best int"
SCORES = "series_id long, t long, score double, candidate int"
SCHEMAS = {
    NODES: pa.schema([("series_id", pa.int64()), ("at", pa.int64()), ("begin", pa.binary()), ("product", pa.binary()), ("logs", pa.binary())]),
    ENTERS: pa.schema([("series_id", pa.int64()), ("at", pa.int64()), ("left", pa.binary()), ("right", pa.binary()), ("best", pa.int32())]),
    SCORES: pa.schema([("series_id", pa.int64()), ("t", pa.int64()), ("score", pa.float64()), ("candidate", pa.int32())]),
}


@dataclass(frozen=True)
class Chain:
    """columns: reports x candidates, what state 1 reports, or several such tables of one size, filled up with zeros; p01,
    p11: chances to enter and to stay in it; start: to begin in it; channel: which table holds for a series. Chances and
    channel are numbers, or columns of the table of what is normal."""

    columns: np.ndarray
    p01: float | Column
    p11: float | Column
    start: float | Column
    channel: int | Column = 0

    def emissions(self, normal: np.ndarray, obs: np.ndarray, chosen: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Blocks x rows, and blocks x rows x candidates (or the one chosen of each block): chances of the reports in both
        states; -1 tells nothing. The last entry of what is normal is the channel."""
        known, own, tables = obs >= 0, np.maximum(obs, 0), self.columns.reshape(-1, *self.columns.shape[-2:])
        channel, normal = normal[:, -1:].astype(np.int64), normal[:, :-1]
        fault = tables[channel, own] if chosen is None else tables[channel, own, chosen[:, None]][:, :, None]
        quiet = np.where(known, np.take_along_axis(normal, own, axis=1), 1.0)
        return np.maximum(quiet, LEAST), np.maximum(np.where(known[:, :, None], fault, 1.0), LEAST)

    def products(self, normal: np.ndarray, obs: np.ndarray, sizes: np.ndarray, moves: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """blocks x 2 x 2 x candidates, scaled to a sum of one, and the logarithms of the scales."""
        a, b, c, d = moves[:, :, None, None]
        quiet, fault = self.emissions(normal, obs)
        n, m = len(obs), self.columns.shape[1]
        p = np.zeros((n, 2, 2, m))
        p[:, 0, 0] = p[:, 1, 1] = 1.0
        logs = np.zeros((n, m))
        for t in range(obs.shape[1]):
            stays = (t >= sizes)[:, None, None]
            zero, one = (p[:, :, 0] * a + p[:, :, 1] * c) * quiet[:, t, None, None], (p[:, :, 0] * b + p[:, :, 1] * d) * fault[:, t, None, :]
            p = np.stack([np.where(stays, p[:, :, 0], zero), np.where(stays, p[:, :, 1], one)], axis=2)
            if t % SCALED == SCALED - 1 or t == obs.shape[1] - 1:
                p, logs = scaled(p, logs)
        return p, logs

    def posterior(self, normal: np.ndarray, obs: np.ndarray, sizes: np.ndarray, moves: np.ndarray, left: np.ndarray, right: np.ndarray, chosen: np.ndarray | None) -> np.ndarray:
        """rows x blocks x candidates (or the one chosen of each): chances of state 1."""
        a, b, c, d = moves[:, :, None]
        quiet, fault = self.emissions(normal, obs, chosen)
        state, out = left, np.empty((obs.shape[1], *left.shape))
        for t in range(obs.shape[1]):
            now = np.stack([(state[:, 0] * a + state[:, 1] * c) * quiet[:, t, None], (state[:, 0] * b + state[:, 1] * d) * fault[:, t]], axis=1)
            state = np.where((t >= sizes)[:, None, None], state, now / now.sum(axis=1, keepdims=True))
            out[t] = state
        back, posterior = right, np.empty((obs.shape[1], len(obs), left.shape[2]))
        for t in range(obs.shape[1] - 1, -1, -1):
            joint = out[t] * back
            posterior[t] = joint[:, 1] / joint.sum(axis=1)
            zero, one = back[:, 0] * quiet[:, t, None], back[:, 1] * fault[:, t]
            now = np.stack([a * zero + b * one, c * zero + d * one], axis=1)
            back = np.where((t >= sizes)[:, None, None], back, now / now.sum(axis=1, keepdims=True))
        return posterior


def begins(moves: np.ndarray, start: np.ndarray) -> np.ndarray:
    """blocks x 2: what a move turns into the first row's chances, so that the first row is like any other."""
    a, b, c, d = moves
    return np.stack([(1 - start) * d - start * c, start * a - (1 - start) * b], axis=1) / (a * d - b * c)[:, None]


def scaled(p: np.ndarray, logs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    total = p.sum(axis=(1, 2))
    return p / total[:, None, None], logs + np.log(total)


def largest(x: np.ndarray, axis: int) -> np.ndarray:
    """The first place within 1e-9 of the largest; rounded values would part equal ones that lie on either side of a half."""
    return (x >= x.max(axis=axis, keepdims=True) - 1e-9).argmax(axis=axis)


def multiplied(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Products of 2 x 2 matrices, for each candidate."""
    return np.einsum("ijm,jkm->ikm", p, q)


def _batch(schema: str, columns: list) -> pa.RecordBatch:
    own = SCHEMAS[schema]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, own, strict=True)], schema=own)


def _binary(x: np.ndarray) -> list[bytes]:
    return [r.tobytes() for r in np.ascontiguousarray(x)]


def _array(column: pa.Array | pa.ChunkedArray, *shape: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.float64).reshape(-1, *shape)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Slices of a bounded size with their reports (blocks x rows), the blocks' sizes, what is normal, and the four chances
    of a move (4 x blocks)."""
    for batch in batches:
        at, all_sizes = 0, batch.column("obs").value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        while at < batch.num_rows:
            n = max(1, HELD // max(1, int(all_sizes[at : at + HELD // 8].max())))
            own, sizes = batch.slice(at, n), all_sizes[at : at + n]
            obs = np.full((len(sizes), int(sizes.max())), -1)
            obs[np.arange(obs.shape[1]) < sizes[:, None]] = own.column("obs").flatten().fill_null(-1).to_numpy(zero_copy_only=False)
            normal = own.column("normal").flatten().to_numpy(zero_copy_only=False).reshape(len(sizes), -1)
            p01, p11 = own.column("p01").to_numpy(), own.column("p11").to_numpy()
            yield own, obs, sizes, normal, np.stack([1 - p01, p01, 1 - p11, p11])
            at += n


def posteriors(rows: DataFrame, normal: DataFrame, chain: Chain, per_row: bool = False, block: int = BLOCK, fan: int = FAN, rate: bool = True) -> DataFrame:
    """series_id, t, score, candidate and, if asked for, rate (the mean score of the series).

    rows: series_id, t (whole numbers) and obs, a report's number; a null one tells nothing. normal: series_id, an array
    of the chances of the reports in state 0, and the columns that the chain names. A row's score is the chance of state 1 by the candidate of the
    largest likelihood (of those within 1e-9 of it the lowest), or, with per_row, by the row's best candidate. Rows of
    one t stand in the order of their reports. Of an empty table nothing is returned; other columns are ignored.
    """
    m = chain.columns.shape[-1]
    item = F.struct(F.col("t").cast("long").alias("t"), F.col("obs").cast("int").alias("obs"))
    own = rows.groupBy(F.col("series_id").cast("long").alias("series_id"), F.floor(F.col("t") / block).alias("at")).agg(F.sort_array(F.collect_list(item)).alias("_items"))
    chances = [(v if isinstance(v, Column) else F.lit(v)).cast("double").alias(k) for k, v in (("p01", chain.p01), ("p11", chain.p11), ("start", chain.start), ("channel", chain.channel))]
    own = own.join(normal.select(F.col("series_id").cast("long").alias("series_id"), "normal", *chances), "series_id")
    blocks = stage.table(own.select("series_id", "at", F.col("_items.t").alias("t"), F.col("_items.obs").alias("obs"), F.concat("normal", F.array("channel")).alias("normal"), "p01", "p11", "start"), "blocks")
    chain = Chain(chain.columns, 0.0, 0.0, 0.0)  # what goes to workers

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for own, obs, sizes, normal, moves in _blocks(batches):
            p, logs = chain.products(normal, obs, sizes, moves)
            yield _batch(NODES, [own.column("series_id"), own.column("at"), _binary(begins(moves, own.column("start").to_numpy())), _binary(p), _binary(logs)])

    def up(table: pa.Table) -> pa.Table:
        table = table.sort_by("at")
        products, logs = _array(table["product"], 2, 2, m), _array(table["logs"], m)
        p, log = products[:1], logs[:1]
        for k in range(1, len(products)):
            p, log = scaled(multiplied(p[0], products[k])[None], log + logs[k])
        return pa.Table.from_batches([_batch(NODES, [table["series_id"][:1].to_pylist(), [table["at"][0].as_py() // fan], table["begin"][:1].to_pylist(), _binary(p), _binary(log)])])

    def root(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            products, logs = _array(batch.column("product"), 2, 2, m), _array(batch.column("logs"), m)
            begin = _array(batch.column("begin"), 2)
            likelihood = np.log(np.einsum("ni,nijm->nm", begin, products)) + logs
            best = largest(likelihood, 1).astype(np.int32)
            yield _batch(ENTERS, [batch.column("series_id"), batch.column("at"), _binary(np.repeat(begin[:, :, None], m, axis=2)), [np.ones((2, m)).tobytes()] * n, best])

    def down(table: pa.Table) -> pa.Table:
        table = table.sort_by("at")
        products, n = _array(table["product"], 2, 2, m), table.num_rows
        left, right = np.empty((n, 2, m)), np.empty((n, 2, m))
        state, back = _array(table["left"][:1], 2, m)[0], _array(table["right"][:1], 2, m)[0]
        for k in range(n):
            left[k] = state
            state = np.einsum("im,ijm->jm", state, products[k])
            state = state / state.sum(axis=0)
        for k in range(n - 1, -1, -1):
            right[k] = back
            back = np.einsum("ijm,jm->im", products[k], back)
            back = back / back.sum(axis=0)
        return pa.Table.from_batches([_batch(ENTERS, [table["series_id"].to_pylist(), table["at"].to_pylist(), _binary(left), _binary(right), table["best"].to_pylist()])])

    def last(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for own, obs, sizes, normal, moves in _blocks(batches):
            left, right, best = _array(own.column("left"), 2, m), _array(own.column("right"), 2, m), own.column("best").to_numpy()
            if not per_row:
                left, right = np.take_along_axis(left, best[:, None, None], axis=2), np.take_along_axis(right, best[:, None, None], axis=2)
            posterior = chain.posterior(normal, obs, sizes, moves, left, right, None if per_row else best)
            inside = np.arange(obs.shape[1]) < sizes[:, None]
            score = posterior.max(axis=2).T[inside]
            candidate = largest(posterior, 2).T[inside] if per_row else np.repeat(best, sizes)
            yield _batch(SCORES, [np.repeat(own.column("series_id").to_numpy(), sizes), own.column("t").flatten(), score, candidate.astype(np.int32)])

    levels = [stage.table(blocks.drop("t").mapInArrow(first, NODES), "products")]
    while (levels[-1].groupBy("series_id").count().agg(F.max("count")).first()[0] or 0) > 1:
        parent = F.floor(F.col("at") / fan).alias("parent")
        levels.append(stage.table(levels[-1].groupBy("series_id", parent).applyInArrow(up, NODES), "products"))
    enters = levels[-1].mapInArrow(root, ENTERS)
    for nodes in reversed(levels[:-1]):
        below = nodes.withColumn("parent", F.floor(F.col("at") / fan)).drop("logs", "begin").join(enters.withColumnRenamed("at", "parent"), ["series_id", "parent"])
        enters = stage.table(below.groupBy("series_id", "parent").applyInArrow(down, ENTERS), "enters")
    scores = blocks.join(enters, ["series_id", "at"]).mapInArrow(last, SCORES)
    if not rate:
        return scores
    scores = stage.table(scores, "posteriors")
    return scores.join(scores.groupBy("series_id").agg(F.avg("score").alias("rate")), "series_id")


def normals(p0: DataFrame, out: int, least: float = 1e-12) -> DataFrame:
    """series_id and an array of the chances of reports 0 to out - 1, from series_id, report_bucket and p0."""
    by = F.map_from_entries(F.collect_list(F.struct(F.col("report_bucket").cast("int"), F.col("p0"))))
    rows = p0.groupBy("series_id").agg(by.alias("_p"))
    chances = F.transform(F.sequence(F.lit(0), F.lit(out - 1)), lambda b: F.greatest(F.lit(least), F.coalesce(F.element_at("_p", b), F.lit(0.0))))
    return rows.select("series_id", chances.alias("normal"))
