"""Packing of token sequences by Karmarkar-Karp multiway differencing.

Documents are cut where a full sequence ends; what remains of them is cut into short pieces, which are dealt
over windows. A window set is found by differencing: the two partial partitions of largest imbalance merge, the
fullest windows of one with the emptiest of the other, until one is left. When a window goes beyond the
capacity, the number of windows rises and the pieces are dealt anew.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from . import common
from .tokens import coder

ROWS = "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"
#: Remainders of documents are cut into pieces of at most this share of a sequence.
SHARE = 8
#: Tokens of remainders that one differencing deals out, in sequences.
GROUP = 128


def differencing(sizes: np.ndarray, m: int) -> list[list[int]]:
    """Deals items over m windows so that their sums are near equal; the items of each window.

    A partial partition has the loads of its windows in descending order, less the smallest, which all windows
    have in common; only windows with items are kept, the others are empty.
    """
    heap: list = [(-int(s), i, [int(s)], [[i]]) for i, s in enumerate(sizes)]
    if m == 1 or not heap:
        return [[i for i in range(len(sizes))]] + [[] for _ in range(m - 1)]
    heapq.heapify(heap)
    count = len(heap)
    while len(heap) > 1:
        _, _, a, a_items = heapq.heappop(heap)
        _, _, b, b_items = heapq.heappop(heap)
        over = len(a) + len(b) - m  # so many windows have items from both
        if over <= 0:
            loads, items = a + b, a_items + b_items
        else:
            loads, items = a[: m - len(b)], a_items[: m - len(b)]
            loads = loads + [x + y for x, y in zip(a[m - len(b) :], reversed(b[m - len(a) :]), strict=True)] + b[: m - len(a)]
            items = items + [x + y for x, y in zip(a_items[m - len(b) :], reversed(b_items[m - len(a) :]), strict=True)] + b_items[: m - len(a)]
        order = sorted(range(len(loads)), key=loads.__getitem__, reverse=True)
        loads, items = [loads[k] for k in order], [items[k] for k in order]
        if len(loads) == m and loads[-1]:
            least = loads[-1]
            loads = [x - least for x in loads]
        count += 1
        heapq.heappush(heap, (-loads[0], count, loads, items))
    items = heap[0][3]
    return items + [[] for _ in range(m - len(items))]


def windows(sizes: np.ndarray, capacity: int) -> list[list[int]]:
    """As few windows as differencing fills without going beyond the capacity."""
    m = max(1, -(-int(sizes.sum()) // capacity))
    while True:
        dealt = differencing(sizes, m)
        if max(int(sizes[w].sum()) for w in dealt) <= capacity:
            return [w for w in dealt if w]
        m += max(1, m // 200)


def pack(docs: DataFrame, tokenizer: str, capacity: int = 1024, end_id: int = 0) -> DataFrame:
    """Packs the tokens of doc_id and text into sequences of at most `capacity`; a row for each piece.

    doc_id, start (the document's ids before the piece), length, doc_tokens (with end_id, which closes every
    document), sequence_id, offset (in the sequence, without gaps from 0), ids (unsigned 32-bit, little-endian).
    Each task packs the documents that it reads, group by group, so nothing is shuffled and a sequence never
    spans tasks; a task that runs again makes all of its sequences anew. A null text counts as empty: its one
    piece is end_id. Repeated rows and null ids are packed as they come; other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.begin("tokens")
        code, most = coder(tokenizer), max(1, capacity // SHARE)
        next_id, small, held = TaskContext.get().partitionId() << 40, [], 0
        rows: list[tuple] = []

        def emit() -> pa.RecordBatch:
            batch = common.batch_of(ROWS, list(zip(*rows, strict=True)))
            rows.clear()
            return batch

        def deal() -> None:
            nonlocal next_id, held
            for window in windows(np.array([x[2] for x in small]), capacity):
                offset = 0
                for i in window:
                    doc, start, length, total, ids = small[i]
                    rows.append((doc, start, length, total, next_id, offset, ids))
                    offset += length
                next_id += 1
            small.clear()
            held = 0

        for batch in common.chunks(batches, "text"):
            coded, bounds = code.closed(batch.column(1), end_id)
            ids, bounds = coded.tobytes(), bounds.tolist()
            for doc, at, to in zip(common.values(batch, "doc_id"), bounds, bounds[1:], strict=False):
                total = to - at
                full = total // capacity * capacity
                for start in range(0, full, capacity):
                    rows.append((doc, start, capacity, total, next_id, 0, ids[4 * (at + start) : 4 * (at + start + capacity)]))
                    next_id += 1
                for start in range(full, total, most):
                    length = min(most, total - start)
                    small.append((doc, start, length, total, ids[4 * (at + start) : 4 * (at + start + length)]))
                held += total - full
                if held >= GROUP * capacity:
                    deal()
                if len(rows) >= 4096:
                    yield emit()
            if rows:
                yield emit()
        if small:
            deal()
            yield emit()

    return docs.select(common.long_id(docs, "doc_id").alias("doc_id"), common.utf8("text").alias("text")).mapInArrow(run, ROWS)
