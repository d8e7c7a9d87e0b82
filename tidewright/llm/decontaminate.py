"""Benchmark decontamination: passages within an edit distance of benchmark items.

Windows as long as an item are embedded by random walks (Chakraborty, Goldenberg and Koucky): a walk reads a symbol,
writes it, and moves on or stays by a random bit of symbol and step, so texts of small edit distance become texts of
small Hamming distance. Half of the walks go from the window's first word on, half from its last one back, so edits in
a bunch at either end leave the walks from the other end alone; half take as many steps as the window has words and see
one half of it, the others take twice as many. Keys made of a few sampled places of a walk propose items, with as many
walks as reach the target recall for an item's own size, whether the edits allowed are spread or bunched; the edit
distance then decides, exactly. Before that, windows are left out that can't match: with k edits, all but 2k of an item's
word pairs remain. The longer an item, the rarer its walks agree, so one beyond PART words is looked for by its parts:
of the edits that it allows, one part at least has no more than its share, and is found as an item of its size is.
"""

from __future__ import annotations

import uuid
from collections import defaultdict
from collections.abc import Iterator
from functools import reduce
from math import ceil, log

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .rolling import GRAM, Words, mix

ROWS = "doc_id long, item_id long, edits int, first_word int, last_word int"
#: ASCII letters count as lower-case, other ASCII signs part words.
FOLD = np.array([c if c >= 128 or chr(c).isalnum() else 32 for c in range(256)], np.uint8)
FOLD[65:91] += 32
SIMILARITY, RECALL, SAMPLED = 0.8, 0.99, 3
#: Words of an item's part at most, and walks that find 0.99 of parts with so many edits (0, 1, ...), each kind and place
#: of edits for itself, where a fifth of the words may be edited; tests measure it for all sizes.
PART, WALKS = 64, (2, 10, 14, 16, 20, 24, 28, 34, 38, 42, 48, 52, 56)
#: Windows whose walks are held at a time.
HELD = 256
#: Bytes of benchmark text that are searched for at a time: its words, 8 bytes each, are broadcast, and a task keeps
#: about 700 bytes for each item. A larger benchmark takes several passes.
BLOCK = 16 << 20


def allowed(n: int, similarity: float) -> int:
    """Edits within which a passage counts as an item of n words."""
    return int(n * (1 - similarity) + 1e-9)


def repetitions(n: int, similarity: float, recall: float) -> int:
    """Walks for a part of n words."""
    return 2 * ceil(WALKS[allowed(n, similarity)] * max(1.0, log(1 - recall) / log(0.01)) / 2)


class Walks:
    """Repeated walks over windows of any size, with the sampled places of each that make a key."""

    def __init__(self, repetitions: int):
        rng = np.random.default_rng(7)
        # drawn walk by walk, so that a few of many walks are the same as few
        draws = [(rng.integers(0, 1 << 63, 2 * PART, dtype=np.uint64) | np.uint64(1), rng.random(SAMPLED)) for _ in range(repetitions)]
        self.seeds = np.stack([d[0] for d in draws], axis=1)  # steps x walks
        self.shares = np.stack([d[1] for d in draws])
        r = np.arange(repetitions)
        self.back, self.long = r % 2 == 1, r // 2 % 2 == 1
        # the last sampled place of a walk, in window sizes: no walk goes further
        self.reach = self.shares.max(axis=1) * np.where(self.long, 2, 1)

    def keys(self, symbols: np.ndarray, starts: np.ndarray, ends: np.ndarray, sizes: np.ndarray, walks: np.ndarray) -> np.ndarray:
        """Walks x windows: the key of each window, which has at most `sizes` words and none at or after `ends`.

        Only the first `walks` of a window count. The size and the walk are part of the key, so that all keys can be
        looked up together.
        """
        out = np.zeros((int(walks.max(initial=0)), len(starts)), np.uint64)
        for at in range(0, len(starts), HELD):
            part = slice(at, at + HELD)
            most = int(walks[part].max())
            out[:most, part] = self.some(symbols, starts[part], np.minimum(sizes[part], ends[part] - starts[part]), sizes[part], most)
        return out

    def some(self, symbols: np.ndarray, starts: np.ndarray, words: np.ndarray, sizes: np.ndarray, walks: int) -> np.ndarray:
        largest, n = int(sizes.max()), len(starts)
        # windows as columns, forward and then back, ended by zeros, at which a walk stays
        row = np.arange(largest + 1)[:, None]
        inside = row < words
        both = [np.where(inside, symbols[np.where(inside, at, 0)], np.uint64(0)) for at in (starts + row, starts + words - 1 - row)]
        flat = np.concatenate(both).ravel()
        order = np.argsort(-self.reach[:walks], kind="stable")  # at each step the walks that go on are the first
        last = (self.reach[order] * largest).astype(np.int64)
        at = np.where(self.back[order], (largest + 1) * n, 0)[:, None] + np.arange(n)
        written = np.empty((int(last[0]) + 1, walks, n), np.uint64)
        seeds = self.seeds[:, order, None]
        for j in range(len(written)):
            on = int(np.searchsorted(-last, -j, "right"))
            symbol = flat.take(at[:on])
            written[j, :on] = symbol
            at[:on] += ((symbol * seeds[j, :on]) >> np.uint64(63)).view(np.int64) * n
        span = np.where(self.long[order, None], 2 * sizes, sizes)
        key = order.astype(np.uint64)[:, None] * np.uint64(GRAM) + sizes.astype(np.uint64)
        for share in self.shares[order].T:
            place = (share[:, None] * span).astype(np.int64)
            key = mix((key ^ np.take_along_axis(written, place[None], axis=0)[0]) * np.uint64(GRAM))
        out = np.empty_like(key)
        out[order] = key
        return out


def best_match(item: list[int], text: list[int]) -> tuple[int, int]:
    """Least edit distance of the item to a part of the text, and the end of the first such part (bit-parallel)."""
    m = len(item)
    full, top, masks = (1 << m) - 1, 1 << (m - 1), defaultdict(int)
    for i, c in enumerate(item):
        masks[c] |= 1 << i
    up, down, score, best, end = full, 0, m, m, 0
    for j, c in enumerate(text):
        equal = masks.get(c, 0)
        x = equal | down
        h = (((equal & up) + up) ^ up) | equal
        ph, mh = (down | ~(h | up)) & full, up & h
        score += bool(ph & top) - bool(mh & top)
        ph, mh = ph << 1 & full, mh << 1 & full
        up, down = (mh | ~(x | ph)) & full, ph & x
        if score < best:
            best, end = score, j + 1
    return best, end


class Index:
    """The items of one block of a benchmark: their words in one array, their parts, and the keys of these in order."""

    def __init__(self, ids: np.ndarray, words: np.ndarray, begins: np.ndarray, similarity: float, recall: float):
        self.ids, self.words, self.begins, self.similarity, self.recall = ids, words, begins, similarity, recall
        whole = np.diff(begins)
        self.edits = np.array([allowed(n, similarity) for n in whole.tolist()], np.int64)
        # of each part: its item, its first word there and its size
        parts = -(-whole // PART)
        self.item = np.repeat(np.arange(len(whole)), parts)
        at = np.arange(len(self.item)) - np.repeat(np.cumsum(parts) - parts, parts)
        self.offset = at * whole[self.item] // parts[self.item]
        self.sizes = (at + 1) * whole[self.item] // parts[self.item] - self.offset
        first = begins[self.item] + self.offset
        inside = np.ones(max(0, len(words) - 1), bool)
        inside[first[1:] - 1] = False
        # each pair of words once, and the parts that have it
        pairs, owner = pairs_of(words)[inside], np.repeat(np.arange(len(self.sizes)), self.sizes)[:-1][inside]
        order = np.lexsort((owner, pairs))
        pairs, owner = pairs[order], owner[order]
        first_of = np.ones(len(pairs), bool)
        first_of[1:] = (pairs[1:] != pairs[:-1]) | (owner[1:] != owner[:-1])
        self.of_pair = owner[first_of]
        self.pairs, start = np.unique(pairs[first_of], return_index=True)
        self.begins_of = np.append(start, len(self.of_pair))
        self.table = np.zeros(1 << 20, bool)
        self.table[(self.pairs >> np.uint64(44)).astype(np.int64)] = True
        self.within = np.array([allowed(n, similarity) for n in self.sizes.tolist()], np.int64)
        self.needed = {n: repetitions(n, similarity, recall) for n in np.unique(self.sizes).tolist()}
        self.walks = Walks(max(self.needed.values()))
        by = np.argsort(self.sizes, kind="stable")
        needed = np.array([self.needed[n] for n in self.sizes[by].tolist()])
        keys = self.walks.keys(words, first[by], first[by] + self.sizes[by], self.sizes[by], needed)
        of_walk, part = np.nonzero(np.arange(len(keys))[:, None] < needed)
        keys, part = keys[of_walk, part], by[part]
        order = np.argsort(keys, kind="stable")
        self.keys, self.owner = keys[order], part[order].astype(np.int32)

    def search(self, texts: pa.Array) -> list[tuple[int, int, int, int, int]]:
        """text, item, edits, first word, end: the best passage for each item within the similarity."""
        words = Words(texts, FOLD)
        n_words = len(words.hash)
        if not n_words:
            return []
        pairs = pairs_of(words.hash)
        near = np.flatnonzero(self.table[(pairs >> np.uint64(44)).astype(np.int64)])
        near = near[words.doc[near] == words.doc[near + 1]]
        at = np.minimum(np.searchsorted(self.pairs, pairs[near]), max(0, len(self.pairs) - 1))
        right = self.pairs[at] == pairs[near] if len(self.pairs) else np.zeros(len(near), bool)
        starts, sizes = self.windows(words, near[right], at[right])
        ends = words.first[1:][words.doc]  # of each word's document
        proposed: dict[tuple[int, int], set[int]] = defaultdict(set)
        for at in range(0, len(starts), 1 << 14):
            own, n = starts[at : at + (1 << 14)], sizes[at : at + (1 << 14)]
            found = self.walks.keys(words.hash, own, ends[own], n, np.array([self.needed[x] for x in n.tolist()], np.int64))
            low, high = np.searchsorted(self.keys, found, "left"), np.searchsorted(self.keys, found, "right")
            for r, w in zip(*np.nonzero(high > low), strict=True):
                for part in self.owner[low[r, w] : high[r, w]].tolist():
                    proposed[int(words.doc[own[w]]), int(self.item[part])].add(int(own[w]) - int(self.offset[part]))
        out = []
        for (doc, item), places in proposed.items():
            out += self.verify(words, doc, item, sorted(places))
        return out

    def windows(self, words: Words, near: np.ndarray, pair: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts and sizes of the windows that can match; near: places of known pairs of words, pair: which these are.

        With k edits, a window holds all pairs of one part but two for each edit, so as many of the part's places must
        lie within its size and k words.
        """
        counts = np.diff(self.begins_of)[pair]
        place = np.repeat(near, counts)
        part = self.of_pair[np.repeat(self.begins_of[pair], counts) + np.arange(len(place)) - np.repeat(np.cumsum(counts) - counts, counts)]
        order = np.argsort(part, kind="stable")
        place, part = place[order], part[order]
        n, k = self.sizes[part], self.within[part]
        last = np.arange(len(part)) + n - 2 - 2 * k  # the place by which there are enough
        enough = np.flatnonzero((last >= np.arange(len(part))) & (last < len(part)))
        last = last[enough]
        close = (part[last] == part[enough]) & (place[last] - place[enough] < (n + k)[enough]) & (words.doc[place[last]] == words.doc[place[enough]])
        enough, last = enough[close], last[close]
        n, k = n[enough], k[enough]
        low = np.maximum(place[last] - n - k + 1, words.first[words.doc[place[enough]]])
        many = place[enough] - low + 1
        start = np.repeat(low, many) + np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many)
        code = np.unique(np.repeat(n, many) * len(words.hash) + start)
        size, start = code // len(words.hash), code % len(words.hash)
        if 1 in self.needed:  # a single word has no pair
            start, size = np.concatenate([np.arange(len(words.hash)), start]), np.concatenate([np.ones(len(words.hash), np.int64), size])
        fits = words.first[1:][words.doc[start]] - start >= size - (size * (1 - self.similarity) + 1e-9).astype(np.int64)
        return start[fits], size[fits]

    def verify(self, words: Words, doc: int, item: int, places: list[int]) -> list[tuple[int, int, int, int, int]]:
        first, last = int(words.first[doc]), int(words.first[doc + 1])
        item_id, own = int(self.ids[item]), self.words[self.begins[item] : self.begins[item + 1]].tolist()
        n, k = len(own), int(self.edits[item])
        best: tuple | None = None
        begin, end = places[0], places[0]
        for p in [*places[1:], None]:
            if p is not None and p - end <= n:
                end = p
                continue
            # a place is where the item would begin: its part may be k words off, and k more before the part are edits
            a, b = max(first, begin - 2 * k), min(last, end + n + 3 * k)
            text = words.hash[a:b].tolist()
            edits, stop = best_match(own, text)
            if edits <= k and (best is None or edits < best[2]):
                _, back = best_match(own[::-1], text[:stop][::-1][: n + k])
                best = (doc, item_id, edits, a + stop - back - first, a + stop - first)
            if p is not None:
                begin = end = p
        return [best] if best else []


def pairs_of(words: np.ndarray) -> np.ndarray:
    """A hash of each word and the next one."""
    return mix(words[:-1] * np.uint64(GRAM) + words[1:])


def parsed(items: list[tuple[int, str]], similarity: float, recall: float) -> tuple | None:
    """Ids, words, bounds, similarity and recall of an index; none if no item has words."""
    words = Words(pa.array([t.encode() for _, t in items], pa.binary()), FOLD)
    sizes = np.diff(words.first)
    if not sizes.any():
        return None
    ids, sizes = np.array([i for i, _ in items], np.int64)[sizes > 0], sizes[sizes > 0]
    begins = np.concatenate([[0], np.cumsum(sizes)])
    return ids, words.hash, begins, similarity, recall


_indexes: dict[str, Index] = {}
common.CACHES.append(_indexes.clear)


def _index(own: Broadcast) -> Index:
    """One for each broadcast block and Python worker."""
    name, parts = own.value
    if name not in _indexes:
        _indexes.clear()
        _indexes[name] = Index(*parts)
    return _indexes[name]


def _blocks(benchmark: DataFrame, similarity: float, recall: float) -> Iterator[Broadcast]:
    """The items in blocks of BLOCK bytes of text or so."""
    if similarity < SIMILARITY:
        raise ValueError(f"the number of walks is known for similarities of {SIMILARITY} or more")
    items = benchmark.select(common.long_id(benchmark, "item_id").alias("item_id"), benchmark["text"].cast("string").alias("text")).where("item_id is not null and text is not null")
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, ceil(total / (BLOCK // 2)))
    for b in range(blocks):
        part = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b) if blocks > 1 else items
        own = parsed(sorted(map(tuple, part.collect())), similarity, recall)
        if own:
            yield benchmark.sparkSession.sparkContext.broadcast((uuid.uuid4().hex, own))


def find(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY, recall: float = RECALL) -> DataFrame:
    """doc_id, item_id, edits, first_word, last_word: for each document and item, the passage of least edit distance.

    A passage matches an item of n words within n * (1 - similarity) inserted, missing or other words; case and
    ASCII signs don't count. Items with no words, and null ids or texts of the benchmark, match nothing; a null
    document text has no words; repeated rows match each on its own, null ids too; other columns are ignored. Texts and
    items are read whole, however long. The benchmark is a query set: it is read in blocks of a bounded size, each
    searched against all documents. A similarity below 0.8 is refused.
    """
    rows = docs.select(common.long_id(docs, "doc_id").alias("doc_id"), common.utf8(docs["text"]).alias("text"))

    def searched(own: Broadcast) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            common.begin("decontamination")
            for batch in common.chunks(batches, "text"):
                ids = batch.column(0).to_pylist()
                found = _index(own).search(batch.column(1))
                yield common.batch_of(ROWS, list(zip(*[(ids[d], *x) for d, *x in found], strict=True)) or [[]] * 5)

        return rows.mapInArrow(run, ROWS)

    nothing = rows.where("false").select("doc_id", F.col("doc_id").alias("item_id"), *[F.lit(0).alias(c) for c in ("edits", "first_word", "last_word")])
    return reduce(DataFrame.union, map(searched, _blocks(benchmark, similarity, recall)), nothing)


def remove(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY, recall: float = RECALL) -> DataFrame:
    """The rows of docs in which find() has nothing, with all their columns; nothing is shuffled."""

    def without(left: DataFrame, own: Broadcast) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            common.begin("decontamination")
            for batch in common.chunks(batches, "text"):
                texts = batch.column(batch.schema.get_field_index("text")).cast(pa.binary()).fill_null(b"")
                clean = np.ones(batch.num_rows, bool)
                clean[[x[0] for x in _index(own).search(texts)]] = False
                yield batch.filter(pa.array(clean))

        return left.mapInArrow(run, left.schema)

    return reduce(without, _blocks(benchmark, similarity, recall), docs)
