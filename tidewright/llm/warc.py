"""WARC archives: written with an index, read back by coalesced byte ranges.

Writing: each task appends records, each a gzip member of its own, to an archive in a shared folder and emits
offset, length, URL and digest of each; Spark commits these rows, so archives of lost attempts are in no index.
Reading: the selected index rows are dealt by blocks of archives, sorted by offset, neighbouring ranges become
one read, and each record is inflated and checked against its digest.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

INDEX = "archive string, offset long, length long, url string, digest string, page_id long, record_type string"
RECORDS = "page_id long, url string, record_type string, refers_to long, digest string, payload binary"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Reads closer than this become one; no read is longer; an archive's blocks of so many bytes go to one task.
GAP, READ, BLOCK = 64 << 10, 4 << 20, 8 << 20
#: Repeated payloads (a digest and a page_id, some 100 bytes each) that are broadcast at most.
SMALL = 500_000


def digest(payload: bytes) -> str:
    """Base32 of the SHA-1, as WARC-Payload-Digest has it after "sha1:"."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _uri(page_id: int | None) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def _id(uri: str) -> int | None:
    return int(x) if (x := uri[10:-1]) else None


def _clean(url: str) -> str:
    """Without what would end a header line: control characters are percent-encoded."""
    return "".join(c if c >= " " else f"%{ord(c):02X}" for c in url)


def record(page_id: int | None, url: str, date: str, payload: bytes, sha1: str, refers_to: int | None, revisit: bool) -> bytes:
    """A response with its payload, or a revisit with the HTTP header alone, as a gzip member."""
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {_uri(page_id)}", f"WARC-Date: {date}", f"WARC-Target-URI: {url}", f"WARC-Payload-Digest: sha1:{sha1}", "Content-Type: application/http; msgtype=response"]
    if revisit:
        lines += [f"WARC-Refers-To: {_uri(refers_to)}", f"WARC-Profile: {PROFILE}"]
    else:
        block += payload
    text = "\r\n".join([*lines, f"Content-Length: {len(block)}", "", ""]).encode()
    pack = zlib.compressobj(1, zlib.DEFLATED, 31)
    return pack.compress(text + block + b"\r\n\r\n") + pack.flush()


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and payload of a gzip member; the payload of a revisit is empty."""
    raw = zlib.decompress(data, 31)
    head, _, rest = raw.partition(b"\r\n\r\n")
    headers = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
    block = rest[: int(headers["Content-Length"])]
    return headers, block.partition(b"\r\n\r\n")[2]


def write(pages: DataFrame, folder: str, date: str = "1970-01-01T00:00:00Z", least_bytes: int = 0) -> DataFrame:
    """Archives page_id, url and html of pages under folder; returns the index, a row for each record.

    Of records with equal payloads of least_bytes or more, that with the largest page_id is the response and the
    others revisit it; if page_id repeats there, all rows with it are responses. A null page_id is the smallest. A
    null html is an empty payload, a null url an empty one. Other columns are ignored.
    """
    rows = pages.select(common.long_id(pages, "page_id").alias("page_id"), F.coalesce(pages["url"], F.lit("")).alias("url"), common.utf8(pages["html"]).alias("payload"))
    rows = rows.withColumn("sha1", F.sha1("payload")).withColumn("bytes", F.length("payload"))
    owners = rows.groupBy("sha1").agg(F.count("*").alias("n"), F.max("page_id").alias("owner"), F.max("bytes").alias("size")).where((F.col("n") > 1) & (F.col("size") >= least_bytes)).select("sha1", "owner")
    owners = common.stage_table(owners, "warc-owners")
    small = owners.count() <= SMALL  # then payloads are written where they are read, else they go to their digest's task
    typed = rows.join(F.broadcast(owners) if small else owners, "sha1", "left").withColumn("revisit", F.col("owner").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("owner")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.begin("warc")
        out, name, at = None, "", 0
        for batch in common.chunks(batches, "payload"):
            if out is None:
                store, base = fs.FileSystem.from_uri(folder)
                store.create_dir(base, recursive=True)
                name = f"part-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.warc.gz"
                out = store.open_output_stream(f"{base}/{name}", compression=None)
            index = []
            for page_id, url, payload, owner, revisit in zip(*(common.values(batch, c) for c in ("page_id", "url", "payload", "owner", "revisit")), strict=True):
                url, sha1 = _clean(url), digest(payload)
                data = record(page_id, url, date, payload, sha1, owner, revisit)
                out.write(data)
                index.append((f"{folder.rstrip('/')}/{name}", at, len(data), url, sha1, page_id, "revisit" if revisit else "response"))
                at += len(data)
            yield common.batch_of(INDEX, list(zip(*index, strict=True)))
        if out is not None:
            out.close()

    return common.stage_table(typed.select("page_id", "url", "payload", "owner", "revisit").mapInArrow(run, INDEX), "warc-index")


def read(selected: DataFrame) -> DataFrame:
    """The records of index rows: page_id, url, record_type, refers_to, digest, payload (null for a revisit)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_name, file = "", None
        group: list[tuple[int, int]] = []

        def fetch() -> pa.RecordBatch:
            begin, end = group[0][0], group[-1][0] + group[-1][1]
            data, rows = file.read_at(end - begin, begin), []
            for offset, length in group:
                h, payload = parse(data[offset - begin : offset - begin + length])
                sha1 = h["WARC-Payload-Digest"].removeprefix("sha1:")
                revisit = h["WARC-Type"] == "revisit"
                if not revisit and digest(payload) != sha1:
                    raise ValueError(f"{open_name}: the record at {offset} doesn't fit its digest")
                rows.append((_id(h["WARC-Record-ID"]), h["WARC-Target-URI"], h["WARC-Type"], _id(h["WARC-Refers-To"]) if revisit else None, sha1, None if revisit else payload))
            group.clear()
            return common.batch_of(RECORDS, list(zip(*rows, strict=True)))

        for batch in batches:
            for name, offset, length in zip(*(common.values(batch, c) for c in ("archive", "offset", "length")), strict=True):
                if group and (name != open_name or offset - sum(group[-1]) > GAP or offset + length - group[0][0] > READ):
                    yield fetch()
                if name != open_name:
                    store, path = fs.FileSystem.from_uri(name)
                    open_name, file = name, store.open_input_file(path)
                group.append((offset, length))
        if group:
            yield fetch()

    rows = selected.select("archive", "offset", "length").withColumn("block", F.floor(F.col("offset") / BLOCK))
    spark = selected.sparkSession  # index rows are short, so their size says nothing of the work: not left to be coalesced
    parallel = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    rows = rows.repartition(parallel, "archive", "block").sortWithinPartitions("archive", "offset")
    return rows.select("archive", "offset", "length").mapInArrow(run, RECORDS)
