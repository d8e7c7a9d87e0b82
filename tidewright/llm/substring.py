"""Exact substring deduplication: every window of words that also starts earlier goes.

1. Each window of `window` words has an anchor, the least hash among the shorter windows in it. Equal windows
   have equal anchors, so only windows whose anchor occurs in two documents can repeat in another document; the
   anchors of a document are far fewer than its windows and are counted first.
2. The Rabin-Karp hashes of the windows left are counted over all rows, with the first place (doc_id and word) of each.
3. A window goes from a row where it doesn't have that place, and from where it starts earlier in the same row,
   which needs no shuffle to see. Overlapping and touching windows merge into maximal intervals.

Each step is written to the shared folder; texts are shuffled by row twice, windows never as text. Rows are told
apart by a hash of id and text, so rows without an id, or with the same, spread over tasks as any others do.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .rolling import GRAM, WINDOW, Words, sliding_min

#: Bytes of text hashed at a time.
SLICE = 1 << 20
#: A window of a row: its hash, the row's doc_id, the first word that it starts at, the row.
WINDOWS = "hash long, k long, at int, r long"


def _gram(window: int) -> int:
    return max(1, window * 2 // 5)


def _anchors(words: Words, window: int) -> np.ndarray:
    """The anchor of the window from each word on."""
    k = _gram(window)
    grams = words.windows(k, GRAM)
    return sliding_min(grams, window - k + 1) if len(grams) > window - k else np.zeros(0, np.uint64)


def _distinct(doc: np.ndarray, hashes: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The different hashes of each document, with the first word that has each; words are given in order."""
    order = np.lexsort((hashes, doc))
    doc, hashes, at = doc[order], hashes[order], at[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (hashes[1:] != hashes[:-1])
    return doc[new], hashes[new], at[new]


def _numbers(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return batch.column(batch.schema.get_field_index(name)).to_numpy(zero_copy_only=False)


def _text(batch: pa.RecordBatch) -> pa.Array:
    return batch.column(batch.schema.get_field_index("text"))


def deduplicate(docs: DataFrame, window: int = 20, keep: tuple[str, ...] = (), untouched: bool = False) -> DataFrame:
    """Removes each word that a window of `window` words covers which also starts earlier: in a smaller doc_id,
    or in the same document at an earlier word. Windows are judged on the input.

    Returns doc_id, text (the words kept, joined by one space; with `untouched`, a text that loses nothing stays
    as it is), n_words, n_removed, spans (words removed, as begin and end, begin and end, ...) and the columns named in
    `keep` that don't have one of these names, a row for each row of docs. Words are
    runs of bytes other than space and 0x09-0x0D. A null or short text has no windows; a null doc_id counts as
    the smallest. Rows that share a doc_id count as one document whose rows have the same positions: a window at
    a smaller word of any of them is earlier, and none is earlier than another at the same word, so all keep it.
    Equality is that of 64-bit hashes of words and, of windows in different rows, of two 64-bit hashes (anchor and
    window).
    """
    keep = tuple(c for c in keep if c not in ("doc_id", "text", "n_words", "n_removed", "spans"))
    key = F.coalesce(common.long_id(docs, "doc_id"), F.lit(-(1 << 63)))
    rows = docs.select(key.alias("__k"), common.utf8("text").alias("__text"), common.long_id(docs, "doc_id").alias("__id"), *[F.col(c).alias(f"__keep{i}") for i, c in enumerate(keep)])
    rows = rows.select(F.col("__k").alias("k"), F.xxhash64("__k", "__text").alias("r"), F.col("__text").alias("text"), F.col("__id").alias("doc_id"), *[f"__keep{i}" for i in range(len(keep))])

    def anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.begin("substring")
        for batch in common.chunks(batches, "text", SLICE):
            words = Words(_text(batch))
            at = words.whole(window)
            doc, found, _ = _distinct(words.doc[at], _anchors(words, window)[at], at)
            yield common.batch_of("anchor long, r long", [found.view(np.int64), _numbers(batch, "r")[doc]])

    def candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.begin("substring")
        for batch in common.chunks(batches, "text", SLICE):
            words = Words(_text(batch))
            at = words.whole(window)
            wanted = np.unique(batch.column(batch.schema.get_field_index("anchors")).flatten().to_numpy()).view(np.uint64)
            at = at[np.isin(_anchors(words, window)[at], wanted)]
            doc, found, at = _distinct(words.doc[at], words.windows(window, WINDOW)[at], at)
            yield common.batch_of(WINDOWS, [found.view(np.int64), _numbers(batch, "k")[doc], (at - words.first[doc]).astype(np.int32), _numbers(batch, "r")[doc]])

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.begin("substring")
        for batch in common.chunks(batches, "text", SLICE):
            words = Words(_text(batch))
            at, n = words.whole(window), len(words.hash)
            doc, hashes = words.doc[at], words.windows(window, WINDOW)[at]
            order = np.lexsort((at, hashes, doc))  # in a document, all but the first of equal windows go
            again = np.zeros(len(at), bool)
            again[order[1:]] = (doc[order[1:]] == doc[order[:-1]]) & (hashes[order[1:]] == hashes[order[:-1]])
            lists = batch.column(batch.schema.get_field_index("hashes"))
            found = lists.flatten().to_numpy().view(np.uint64)
            owner = np.repeat(np.arange(batch.num_rows), np.nan_to_num(lists.value_lengths().to_numpy(zero_copy_only=False)).astype(np.int64))
            known = np.unique(found)
            if len(known):
                code = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
                pairs = owner * len(known) + np.searchsorted(known, found)
                again |= (known[code] == hashes) & np.isin(doc * len(known) + code, pairs)
            cover = np.zeros(n + 1, np.int64)
            np.add.at(cover, at[again], 1)
            np.add.at(cover, at[again] + window, -1)
            gone = np.cumsum(cover[:-1]) > 0
            new = np.concatenate([np.diff(words.doc, prepend=-1) > 0, [True]])  # an interval stays in its document
            begins = np.flatnonzero(gone & (new[:-1] | ~np.concatenate([[False], gone[:-1]])))
            ends = np.flatnonzero(gone & (new[1:] | ~np.concatenate([gone[1:], [False]]))) + 1
            texts, removed, spans = [], [], []
            for i, text in enumerate(_text(batch).to_pylist()):
                a, b = int(words.first[i]), int(words.first[i + 1])
                lost = int(gone[a:b].sum())
                texts.append(text if untouched and not lost else b" ".join(text.split() if not lost else compress(text.split(), (~gone[a:b]).tolist())))
                removed.append(lost)
                inside = slice(*np.searchsorted(begins, [a, b]).tolist())
                spans.append(np.stack([begins[inside] - a, ends[inside] - a], axis=1).ravel().tolist())
            own = common.batch_of("text binary, n_words long, n_removed long, spans array<int>", [texts, np.diff(words.first), removed, spans])
            yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index("doc_id")), own.column(0).cast(pa.string()), *own.columns[1:], *[batch.column(batch.schema.get_field_index(f"__keep{i}")) for i in range(len(keep))]], names=["doc_id", "text", "n_words", "n_removed", "spans", *keep])

    first = common.stage_table(rows.select("r", "text").mapInArrow(anchors, "anchor long, r long"), "anchors")
    shared = first.groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1").select("anchor")
    shared = common.stage_table(shared, "shared-anchors")
    of_rows = common.stage_table(first.join(shared, "anchor").groupBy("r").agg(F.collect_set("anchor").alias("anchors")), "row-anchors")
    left = rows.select("k", "r", "text").join(of_rows, "r")
    hashed = common.stage_table(left.mapInArrow(candidates, WINDOWS), "windows")
    for done in (first, shared, of_rows):
        common.drop_table(done)
    place = F.struct("k", "at")
    owners = hashed.groupBy("hash").agg(F.min(place).alias("least"), F.max(place).alias("most")).where("least < most").select("hash", "least")
    owners = common.stage_table(owners, "owners")
    later = common.stage_table(hashed.join(owners, "hash").where(place > F.col("least")).groupBy("k", "r").agg(F.collect_set("hash").alias("hashes")), "repeats")
    for done in (hashed, owners):
        common.drop_table(done)
    form = ["doc_id long, text string, n_words long, n_removed long, spans array<int>", *[f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep]]
    return rows.join(later, ["k", "r"], "left").mapInArrow(remove, ", ".join(form))
