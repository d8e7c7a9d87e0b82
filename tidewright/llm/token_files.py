"""Token-id files: a concatenated id array, and Elias-Fano codes of where each document ends in it.

A file holds the ids of its documents one after the other (16 bits each if the vocabulary allows, else 32),
then two Elias-Fano sequences (document ends; document ids above the smallest), then a trailer of fixed size.
Files are cut by ranges of doc_id, so their order is that of the documents. A task writes under a name of its
own and reports it in the manifest, which Spark commits: files of lost attempts are never read.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common
from .elias_fano import EliasFano
from .tokens import coder

MAGIC = b"TWTOKEN1"
TRAILER = np.dtype([("ids", "<u8"), ("docs", "<u8"), ("nulls", "<u8"), ("least", "<i8"), ("width", "<u8"), ("footer", "<u8"), ("magic", "S8")])
MANIFEST = "shard int, path string, n_docs long, n_ids long"
ROWS = "doc_id long, start long, n_tokens long, ids binary"
#: Documents that one reading task looks up at a time.
BLOCK = 2000


def write(docs: DataFrame, folder: str, tokenizer: str, end_id: int) -> DataFrame:
    """Writes doc_id and text of docs as token files under folder; returns the manifest (shard, path, n_docs, n_ids).

    Each document's ids end with end_id. Documents are ordered by doc_id, nulls first, then by text; a null text
    counts as empty; repeated rows are written as often as they occur. Other columns are ignored. An empty table
    gives an empty manifest.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.begin("tokens")
        code, out, path = coder(tokenizer), None, ""
        width = 2 if max(code.tokenizer.get_vocab_size() - 1, end_id) < 1 << 16 else 4
        lengths, ids = [], []
        for batch in common.chunks(batches, "text"):
            if out is None:
                store, base = fs.FileSystem.from_uri(folder)
                store.create_dir(base, recursive=True)
                path = f"{base}/part-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.tok"
                out = store.open_output_stream(path)
            coded, bounds = code.closed(batch.column(1), end_id)
            lengths += np.diff(bounds).tolist()
            ids += common.values(batch, "doc_id")
            out.write(coded.astype(f"<u{width}").tobytes())
        if out is None:
            return
        ends = np.cumsum(lengths, dtype=np.int64)
        nulls = sum(x is None for x in ids)
        known = [x for x in ids if x is not None]
        least = known[0] if known else 0
        out.write(EliasFano.encode(ends).to_bytes() + EliasFano.encode(np.array([x - least for x in known], dtype=np.uint64)).to_bytes())
        out.write(np.array((int(ends[-1]), len(ids), nulls, least, width, int(ends[-1]) * width, MAGIC), TRAILER).tobytes())
        out.close()
        row = [[TaskContext.get().partitionId()], [folder.rstrip("/") + "/" + path.rpartition("/")[2]], [len(ids)], [int(ends[-1])]]
        yield common.batch_of(MANIFEST, row)

    rows = docs.select(common.long_id(docs, "doc_id").alias("doc_id"), common.utf8("text").alias("text"))
    rows = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    return common.stage_table(rows.mapInArrow(run, MANIFEST), "manifest")


class Reader:
    """Random access to one file: trailer and boundaries are read once, ids by byte range."""

    def __init__(self, path: str):
        store, name = fs.FileSystem.from_uri(path)
        self.file = store.open_input_file(name)
        size = self.file.size()
        self.head = np.frombuffer(self.file.read_at(TRAILER.itemsize, size - TRAILER.itemsize), TRAILER)[0]
        if bytes(self.head["magic"]) != MAGIC:
            raise ValueError(f"not a token file: {path}")
        footer = self.file.read_at(size - TRAILER.itemsize - int(self.head["footer"]), int(self.head["footer"]))
        self.ends, used = EliasFano.from_bytes(footer)
        self.ids, _ = EliasFano.from_bytes(footer[used:])

    def documents(self, begin: int, end: int) -> tuple[list, np.ndarray]:
        """Ids of the documents begin to end, and their boundaries: one more than documents."""
        end = min(end, int(self.head["docs"]))
        nulls = int(self.head["nulls"])
        known = self.ids.select(max(0, begin - nulls), max(0, end - nulls)).astype(np.int64) + int(self.head["least"])
        bounds = self.ends.select(max(0, begin - 1), end).astype(np.int64)
        return [None] * max(0, min(end, nulls) - begin) + known.tolist(), bounds if begin else np.concatenate([[0], bounds])

    def tokens(self, begin: int, end: int) -> np.ndarray:
        width = int(self.head["width"])
        return np.frombuffer(self.file.read_at((end - begin) * width, begin * width), f"<u{width}").astype("<u4")


def read(spark: SparkSession, manifest: DataFrame, parallel: int | None = None) -> DataFrame:
    """All documents of the files of a manifest: doc_id, start (ids of all documents before it), n_tokens, ids (u32, little-endian)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, base, block in zip(*(common.values(batch, c) for c in ("path", "base", "block")), strict=True):
                reader, at, last = Reader(path), block * BLOCK, (block + 1) * BLOCK
                last = min(last, int(reader.head["docs"]))
                while at < last:  # few long documents or many short ones
                    known, bounds = reader.documents(at, last)
                    n = max(1, int(np.searchsorted(bounds, bounds[0] + (2 << 20), "right")) - 1)
                    known, bounds = known[:n], bounds[: n + 1]
                    ids = reader.tokens(int(bounds[0]), int(bounds[-1]))
                    cut = bounds - bounds[0]
                    parts = [ids[a:b].tobytes() for a, b in zip(cut[:-1], cut[1:], strict=True)]
                    yield common.batch_of(ROWS, [known, bounds[:-1] + base, np.diff(bounds), parts])
                    at += n

    order = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # a row for each file
    blocks = manifest.select("path", "n_docs", F.coalesce(F.sum("n_ids").over(order), F.lit(0)).alias("base"))
    blocks = blocks.select("path", "base", F.explode(F.sequence(F.lit(0), ((F.col("n_docs") - 1) / BLOCK).cast("int"))).alias("block"))
    parallel = parallel or max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return blocks.repartition(parallel).mapInArrow(run, ROWS)
