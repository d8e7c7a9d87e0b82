"""Hard negatives: BOND, a branch-and-bound scan over vertically stored vectors.

A task turns its rows into blocks that stand column by column. For an anchor, a block's dimensions are read by descending
magnitude of the anchor's own components. After each few of them every candidate has a partial score, and the least and
most that the unread dimensions can still add follow from the columns' minima and maxima. Candidates leave the bitmap
once these bounds show that they can't be among the first or in a window; those that stay to the last dimension have
their exact scores. The first scan finds the positives, whose scores give the windows of the second.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

#: Components of a block (16,384 vectors of 64), dimensions read between two looks at the bounds.
BLOCK, STEP = 1 << 20, 8
#: Components of the anchors searched for at a time, 2 MB to broadcast; more anchors take several scans.
ANCHORS = 1 << 18
#: Components, after scaling, within which a score of 16,384 dimensions fits 63 bits.
MOST = 1 << 24
VECTORS = "vec_id long, label long, vector array<int>"
FOUND = "anchor long, positive int, vec_id long, tag long, score long"
NONE = np.iinfo(np.int64).min


@dataclass
class Block:
    """Vectors in columns: ids (null ones as the largest number), labels, tags and one row for each dimension."""

    ids: np.ndarray
    labels: np.ndarray
    tags: np.ndarray
    columns: np.ndarray

    def __post_init__(self) -> None:
        self.low, self.high = self.columns.min(axis=1), self.columns.max(axis=1)

    def resolve(self, vector: np.ndarray, own: np.ndarray, keep: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Rows of `own` that `keep` (least, most -> bitmap) never drops, and their exact scores."""
        n = min(len(vector), len(self.columns))  # what one of the two lacks adds nothing
        order = np.argsort(-np.abs(vector[:n]), kind="stable")
        q, low, high = vector[order], self.low[order], self.high[order]
        least, most = np.where(q > 0, q * low, q * high), np.where(q > 0, q * high, q * low)
        score = np.zeros(len(own), np.int64)
        for at in range(0, n, STEP):
            for d, x in zip(order[at : at + STEP], q[at : at + STEP], strict=True):
                score += x * (self.columns[d] if len(own) == len(self.ids) else self.columns[d][own])
            rest = at + STEP
            stays = keep(score + least[rest:].sum(), score + most[rest:].sum())
            if not stays.all():
                own, score = own[stays], score[stays]
            if not len(own):
                break
        return own, score


def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[Block]:
    """Rows of VECTORS and a tag, BLOCK components or so at a time; shorter vectors end in zeros."""
    held, n = [], 0

    def block() -> Block:
        table = pa.Table.from_batches(held)
        parts = [x.flatten() for x in table["vector"].chunks]
        sizes = np.concatenate([np.diff(np.asarray(x.offsets)) for x in table["vector"].chunks])
        values = np.concatenate([np.asarray(x) for x in parts]).astype(np.int64)
        columns = np.zeros((max(1, int(sizes.max())), len(sizes)), np.int64)
        row = np.repeat(np.arange(len(sizes)), sizes)
        columns[np.arange(len(values)) - np.repeat(np.cumsum(sizes) - sizes, sizes), row] = values
        ids = table["vec_id"].fill_null(np.iinfo(np.int64).max).to_numpy()
        return Block(ids, table["label"].to_numpy(), table["tag"].to_numpy(), columns)

    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            n += len(batch.column(batch.schema.get_field_index("vector")).flatten()) + batch.num_rows
        if n >= BLOCK:
            yield block()
            held, n = [], 0
    if held:
        yield block()


def kth(scores: np.ndarray, k: int) -> int:
    return int(np.partition(scores, len(scores) - k)[len(scores) - k]) if len(scores) >= k else NONE


class Best:
    """The first k rows so far, by descending score and ascending id; a task keeps one for each anchor or window."""

    def __init__(self, k: int):
        self.k, self.rows = k, np.zeros((3, 0), np.int64)  # score, id, tag

    @property
    def floor(self) -> int:
        return int(self.rows[0, -1]) if self.rows.shape[1] == self.k else NONE

    def add(self, scores: np.ndarray, ids: np.ndarray, tags: np.ndarray) -> None:
        rows = np.concatenate([self.rows, np.stack([scores, ids, tags])], axis=1)
        self.rows = rows[:, np.lexsort((rows[2], rows[1], -rows[0]))[: self.k]]


def first_of_label(block: Block, label: int, vector: np.ndarray, best: Best) -> None:
    """Rows with the anchor's label: a row goes once k others surely score higher."""
    floor = best.floor

    def keep(least: np.ndarray, most: np.ndarray) -> np.ndarray:
        return most >= max(floor, kth(least, best.k))

    own, score = block.resolve(vector, np.flatnonzero(block.labels == label), keep)
    best.add(score, block.ids[own], block.tags[own])


def first_in_windows(block: Block, label: int, vector: np.ndarray, windows: list[tuple[int, int]], best: list[Best]) -> None:
    """Rows with other labels: a row goes once it is out of each window, or k others surely in it score higher."""
    floors = [b.floor for b in best]

    def keep(least: np.ndarray, most: np.ndarray) -> np.ndarray:
        stays = np.zeros(len(least), bool)
        for (low, high), floor, own in zip(windows, floors, best, strict=True):
            sure = least[(least >= low) & (most <= high)]
            stays |= (most >= max(low, floor, kth(sure, own.k))) & (least <= high)
        return stays

    own, score = block.resolve(vector, np.flatnonzero(block.labels != label), keep)
    for (low, high), b in zip(windows, best, strict=True):
        inside = (score >= low) & (score <= high)
        b.add(score[inside], block.ids[own[inside]], block.tags[own[inside]])


def window(score: int, least: int, most: int) -> tuple[int, int]:
    """Scores s with least * score <= 100 * s <= most * score."""
    return -(-least * score // 100), most * score // 100


def vectors(rows: DataFrame, vector: str, label: str, scale: float, vec_id: str = "vec_id") -> DataFrame:
    """VECTORS of the rows that take part, each component scaled and rounded down."""
    x = F.transform(rows[vector], lambda v: v.cast("double"))
    sound = rows[label].isNotNull() & rows[vector].isNotNull() & ~F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    scaled = F.transform(x, lambda v: F.when(F.abs(v) < MOST / scale, F.floor(v * scale).cast("int")).otherwise(F.raise_error(F.lit("a component is too large for scores of 64 bits")).cast("int")))
    return rows.where(sound).select(rows[vec_id].cast("long").alias("vec_id"), rows[label].cast("long").alias("label"), scaled.alias("vector"))


def _scan(table: DataFrame, anchors: DataFrame, k: int, bounds: tuple[int, int] | None) -> Iterator[DataFrame]:
    """FOUND rows, the first k of each task: one frame for each block of anchors.

    bounds: none for rows with the anchor's label, else the window's hundredths of each of `positives`' scores.
    """
    spark, columns = table.sparkSession, ["anchor", "label", "vector", *["positives"] * bool(bounds)]
    last, longest = anchors.agg(F.max("anchor"), F.max(F.size("vector"))).first()
    step = max(1, ANCHORS // max(1, longest or 1))
    for low in range(0, (-1 if last is None else last) + 1, step):
        block = [tuple(r) for r in anchors.where(F.col("anchor").between(low, low + step - 1)).select(columns).collect()]
        if not block:
            continue
        packed = spark.sparkContext.broadcast([(a, label, np.array(v, np.int64), [window(s, *bounds) for s in p[0]] if p else []) for a, label, v, *p in block])

        def run(batches: Iterator[pa.RecordBatch], packed=packed) -> Iterator[pa.RecordBatch]:
            common.begin("hard negatives")
            best = {a: [Best(k) for _ in windows or [0]] for a, _, _, windows in packed.value}
            for rows in blocks(batches):
                for a, label, vector, windows in packed.value:
                    if windows:
                        first_in_windows(rows, label, vector, windows, best[a])
                    else:
                        first_of_label(rows, label, vector, best[a][0])
            for some in np.array_split(np.array(list(best), np.int64), max(1, len(best) // 256)):
                own = [(a, p, b.rows) for a in some.tolist() for p, b in enumerate(best[a])]
                sizes = [r.shape[1] for _, _, r in own]
                score, ids, tags = np.concatenate([r for _, _, r in own], axis=1) if own else np.zeros((3, 0), np.int64)
                yield common.batch_of(FOUND, [np.repeat([a for a, _, _ in own], sizes).astype(np.int64), np.repeat([p for _, p, _ in own], sizes).astype(np.int32), ids, tags, score])

        yield table.select("vec_id", "label", "vector", "tag").mapInArrow(run, FOUND)


def _union(frames: Iterator[DataFrame], spark) -> DataFrame:
    """Frames appended to one table, so that a scan ends before the next block of anchors is read."""
    path = common.new_folder(spark, "found")
    spark.createDataFrame([], FOUND).write.parquet(path)
    for x in frames:
        x.write.mode("append").parquet(path)
    return spark.read.schema(FOUND).parquet(path)


def _first(found: DataFrame, by: list[str], k: int) -> DataFrame:
    """The first k of each group with their rank; Spark cuts each task's rows to k before they are shuffled."""
    order = Window.partitionBy(*by).orderBy(F.desc("score"), "vec_id", "tag")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def mine(rows: DataFrame, anchor: str, positives: int = 5, negatives: int = 10, least: int = 30, most: int = 90, scale: float = 256.0, vector: str = "embedding", label: str = "label") -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    rows: vec_id, label and vector; anchor: SQL of the rows that are anchors. Scores are inner products of components
    times `scale` rounded down. An anchor's positives are its first other rows of the same label, by descending score,
    then ascending vec_id; for each, the first rows of other labels follow whose scores are least to most hundredths
    of the positive's (none if it is negative). Rows with a null label or vector, or a null or non-finite component
    take no part; empty vectors score 0, of vectors with different lengths the shorter one ends in zeros. A null
    vec_id comes last among ties. Repeated rows stand for themselves: each is an anchor, and a positive or a negative
    of others. Components beyond MOST / scale raise an error, as scores would leave 64 bits. Other columns are ignored.
    """
    spark = rows.sparkSession
    own = vectors(rows, vector, label, scale).withColumn("tag", F.xxhash64("label", "vector"))
    table = common.stage_table(own, "vectors")
    # equal anchors are searched for once
    same = table.where(anchor).groupBy("vec_id", "label", "vector", "tag").agg(F.count("*").alias("copies"))
    anchors = common.stage_table(_numbered(same), "anchors")
    # an anchor is among the first of its own label or isn't, so one more than asked is enough
    found = _first(_union(_scan(table, anchors, positives + 1, None), spark), ["anchor"], positives + 1)
    found = found.join(anchors.select("anchor", F.col("vec_id").alias("anchor_id"), F.col("tag").alias("anchor_tag")), "anchor")
    mine_ = (F.col("vec_id") == F.col("anchor_id")) & (F.col("tag") == F.col("anchor_tag"))
    itself = F.min(F.when(mine_, F.col("rank"))).over(Window.partitionBy("anchor"))
    others = found.withColumn("itself", itself).where("itself is null or rank != itself").withColumn("positive", F.row_number().over(Window.partitionBy("anchor").orderBy("rank")) - 1).where(F.col("positive") < positives)
    chosen = common.stage_table(others.select("anchor", "positive", "anchor_id", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")), "positives")
    listed = chosen.groupBy("anchor").agg(F.transform(F.sort_array(F.collect_list(F.struct("positive", "positive_score"))), lambda x: x["positive_score"]).alias("positives"))
    second = common.stage_table(anchors.join(listed, "anchor"), "windows")
    hits = _first(_union(_scan(table, second, negatives, (least, most)), spark), ["anchor", "positive"], negatives)
    null = lambda c: F.when(F.col(c) != np.iinfo(np.int64).max, F.col(c))
    out = hits.withColumnRenamed("score", "negative_score").join(chosen, ["anchor", "positive"]).join(anchors.select("anchor", "copies"), "anchor")
    out = out.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    return out.select("anchor_id", null("positive_id").alias("positive_id"), "rank", null("vec_id").alias("negative_id"), "positive_score", "negative_score")


def _numbered(anchors: DataFrame) -> DataFrame:
    """Anchors with dense numbers from 0, so that blocks of them have a bounded size: counted by partition, then added up."""
    staged = common.stage_table(anchors.withColumn("at", F.monotonically_increasing_id()), "anchors")
    part = F.shiftright("at", 33).alias("part")
    before = F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    counts = staged.groupBy(part).agg(F.count("*").alias("n")).withColumn("before", F.coalesce(before, F.lit(0))).drop("n")
    return staged.withColumn("part", part).join(counts, "part").withColumn("anchor", F.col("before") + F.col("at").bitwiseAND((1 << 33) - 1)).drop("part", "before", "at")


def oracle_sql() -> str:
    """Brute force over all pairs; a row's number tells it from its repeats."""
    return """
WITH v AS (SELECT row_number() OVER () AS row, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND coalesce(list_bool_and(list_transform(embedding, lambda x: coalesce(isfinite(x), false))), true)),
pairs AS (SELECT a.row AS anchor, a.vec_id AS anchor_id, b.row AS row, b.vec_id AS vec_id, a.label = b.label AS same, CAST(list_dot_product(a.q, b.q) AS BIGINT) AS score
  FROM v a JOIN v b ON a.row != b.row WHERE a.vec_id % 100 = 0),
positives AS (SELECT * FROM pairs WHERE same QUALIFY row_number() OVER (PARTITION BY anchor ORDER BY score DESC, vec_id, row) <= 5)
SELECT p.anchor_id, p.vec_id AS positive_id, CAST(row_number() OVER (PARTITION BY p.anchor, p.row ORDER BY n.score DESC, n.vec_id, n.row) AS INTEGER) AS rank, n.vec_id AS negative_id, p.score AS positive_score, n.score AS negative_score
FROM positives p JOIN pairs n ON n.anchor = p.anchor AND NOT n.same AND 30 * p.score <= 100 * n.score AND 100 * n.score <= 90 * p.score
QUALIFY rank <= 10"""
