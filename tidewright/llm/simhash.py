"""SimHash near-duplicates: bit-sliced comparison of fingerprints in blocks.

Equal fingerprints are one class. Of the 64 bits cut into blocks, two fingerprints within the radius agree on
all but `radius` blocks, so they meet in the bucket of one choice of agreeing blocks. What a bucket leaves free
is `radius` blocks of bits, so with 8-bit blocks and radius 2 it holds at most 2**16 different fingerprints,
whatever the corpus. In a bucket the free bits stand as vertical planes: one number per bit with a lane for
each fingerprint, and carry-save counters add up the differing bits of all lanes at once. A block of lanes is
given up when all of them are beyond the radius. A bucket returns a spanning forest, never its pairs.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common
from .components import components
from .rolling import mix

#: Lanes compared at a time.
LANES = 4096
#: Bytes of a text whose words are cut at a time, and hashes whose bits are counted at a time.
SLICE, BITS = 1 << 20, 1 << 15
BLANK = re.compile(rb"[\t-\r ]")


def shingles(text: bytes, shingle: int) -> Iterator[np.ndarray]:
    """XXH64 (seed 42) of the shingles of a text's words, A-Z as a-z, in blocks; of a shorter text, all its words.

    The words of SLICE bytes or so are cut at a time, as a long text's words take far more memory than the text.
    """
    from xxhash import xxh64_digest

    at, held, seen = 0, [], False
    while at < len(text) or (held and not seen):
        if at < len(text):
            end = m.start() if (m := BLANK.search(text, at + SLICE)) else len(text)
            held += text[at:end].lower().split()
            at = end
            if len(held) < shingle and at < len(text):
                continue
        if len(held) < shingle and (seen or not held):
            return
        parts = map(b" ".join, zip(*(held[i:] for i in range(shingle)), strict=False)) if len(held) >= shingle else [b" ".join(held)]
        yield np.frombuffer(b"".join(map(xxh64_digest, parts, repeat(42))), ">u8").astype(np.uint64)
        held, seen = held[len(held) - shingle + 1 :] if len(held) >= shingle else [], True


def fingerprint(text: bytes, shingle: int) -> int:
    counts, n = np.zeros(64, np.int64), 0
    for h in shingles(text, shingle):
        for part in np.split(h, range(BITS, len(h), BITS)):
            counts += np.unpackbits(part.astype(">u8").view(np.uint8)).reshape(-1, 64).sum(axis=0, dtype=np.int64)
        n += len(h)
    return int.from_bytes(np.packbits(2 * counts > n).tobytes(), "big") if n else 0


def fingerprints(docs: DataFrame, shingle: int) -> DataFrame:
    """doc_id, fp (as a signed long) of each row of docs. A-Z count as a-z; a null text has no words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.begin("simhash")
        for batch in common.chunks(batches, "text", 2 << 20):
            found = [fingerprint(t, shingle) for t in common.values(batch, "text")]
            yield common.batch_of("doc_id long, fp long", [batch.column(0), np.array(found, np.uint64).view(np.int64)])

    return docs.select(common.long_id(docs, "doc_id").alias("doc_id"), common.utf8("text").alias("text")).mapInArrow(run, "doc_id long, fp long")


def planes(fps: np.ndarray, bits: list[int]) -> list[int]:
    """For each bit, a number whose lane i is that bit of fingerprint i."""
    return [int.from_bytes(np.packbits((fps >> np.uint64(b)).astype(np.uint8) & 1, bitorder="little").tobytes(), "little") for b in bits]


def within(vertical: list[int], query: list[int], live: int, radius: int) -> int:
    """The live lanes that differ from the query in at most `radius` bits.

    The counters start so far up that the first difference too many carries out of them.
    """
    width = radius.bit_length()
    start = (1 << width) - 1 - radius
    counters = [live if start >> j & 1 else 0 for j in range(width)]
    for plane, bit in zip(vertical, query, strict=True):
        carry = (~plane if bit else plane) & live
        for j in range(width):
            counters[j], carry = counters[j] ^ carry, counters[j] & carry
        live &= ~carry
        if not live:
            break
    return live


def roots(fps: np.ndarray, bits: list[int], radius: int) -> list[int]:
    """Of each fingerprint, the position of the first one that it is linked to, directly or over others."""
    n = len(fps)
    blocks = [planes(fps[i : i + LANES], bits) for i in range(0, n, LANES)]
    unseen = [(1 << min(LANES, n - i)) - 1 for i in range(0, n, LANES)]
    values, root = [[int(f) >> b & 1 for b in bits] for f in fps.tolist()], [-1] * n
    for seed in range(n):
        if root[seed] >= 0:
            continue
        unseen[seed // LANES] ^= 1 << seed % LANES
        root[seed], stack = seed, [seed]
        while stack:
            query = values[stack.pop()]
            for k, block in enumerate(blocks):
                if unseen[k] and (near := within(block, query, unseen[k], radius)):
                    unseen[k] ^= near
                    while near:
                        low = near & -near
                        near ^= low
                        i = k * LANES + low.bit_length() - 1
                        root[i] = seed
                        stack.append(i)
    return root


def links(distinct: DataFrame, radius: int, blocks: int) -> DataFrame:
    """Edges a, b that connect the fingerprints (fp, each once) within the radius, by way of others or directly."""
    cuts = [64 * i // blocks for i in range(blocks + 1)]
    free = [[b for i in chosen for b in range(cuts[i], cuts[i + 1])] for chosen in combinations(range(blocks), radius)]
    masks = [~sum(1 << b for b in bits) & (1 << 64) - 1 for bits in free]

    def signed(x: int) -> Column:
        return F.lit(x - (1 << 64) if x >> 63 else x).cast("long")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.begin("simhash")
        held: list[np.ndarray] = []

        def done(rows: list[np.ndarray]) -> pa.RecordBatch:
            choice, key, fp = (np.concatenate(x) for x in zip(*rows, strict=True))
            edge = np.flatnonzero((choice[1:] != choice[:-1]) | (key[1:] != key[:-1])) + 1
            begins, ends = np.concatenate([[0], edge]), np.concatenate([edge, [len(fp)]])
            many = ends - begins > 1
            a, b = [], []
            for s, e in zip(begins[many].tolist(), ends[many].tolist(), strict=True):
                own = fp[s:e]
                for i, r in enumerate(roots(own.view(np.uint64), free[choice[s]], radius)):
                    if i != r:
                        a.append(own[i])
                        b.append(own[r])
            return common.batch_of("a long, b long", [np.array(a, np.int64), np.array(b, np.int64)])

        for batch in batches:
            rows = [batch.column(i).to_numpy() for i in range(3)]
            if not len(rows[0]):
                continue
            # the last bucket may go on in the next batch
            last = int(np.flatnonzero((rows[0] != rows[0][-1]) | (rows[1] != rows[1][-1]))[-1]) + 1 if (rows[0][0], rows[1][0]) != (rows[0][-1], rows[1][-1]) else 0
            if last:
                yield done([*held, [x[:last] for x in rows]])
                held = []
            elif held and (held[-1][0][-1], held[-1][1][-1]) != (rows[0][0], rows[1][0]):
                yield done(held)
                held = []
            held.append([x[last:] for x in rows])
        if held:
            yield done(held)

    keys = F.explode(F.array(*[F.struct(F.lit(i).alias("choice"), F.col("fp").bitwiseAND(signed(m)).alias("key")) for i, m in enumerate(masks)]))
    rows = distinct.select(keys.alias("x"), "fp").select("x.choice", "x.key", "fp")
    return rows.repartition("choice", "key").sortWithinPartitions("choice", "key", "fp").mapInArrow(compare, "a long, b long")


def classes(docs: DataFrame, shingle: int = 3, radius: int = 2, blocks: int = 8) -> DataFrame:
    """doc_id, fp and component_id (the smallest doc_id reachable over links) of each row of docs.

    Documents link if their fingerprints differ in at most `radius` bits; all documents without words link, as
    do repeated rows. A null doc_id never names a component unless nothing else is in it. Other columns are
    ignored.
    """
    prints = common.stage_table(fingerprints(docs, shingle), "fingerprints")
    distinct = common.stage_table(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct-fingerprints")
    linked = components(links(distinct.select("fp"), radius, blocks)).withColumnRenamed("node", "fp")
    named = common.stage_table(distinct.join(linked, "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"), "least"), "rooted")
    names = named.groupBy("root").agg(F.min("least").alias("component_id"))
    return prints.join(named.select("fp", "root").join(names, "root").select("fp", "component_id"), "fp").select("doc_id", "fp", "component_id")


#: Bits of the wide fingerprints, keys that make the buckets, and least hashes that make a key.
WIDE, KEYS, DEEP = 256, 9, 3
#: Fingerprints, and hashes of their shingles, that a task compares with as many others.
PART, HELD = 4096, 4_000_000
_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)
#: Odd multipliers: with the four columns of _MIX, as many permutations as the keys take.
_TURNS = mix(np.arange(1, -(-KEYS * DEEP // len(_MIX)) + 1, dtype=np.uint64)) | np.uint64(1)


def shingle_set(text: bytes, shingle: int) -> np.ndarray:
    """The different hashes of the shingles, in order."""
    return np.unique(np.concatenate([np.zeros(0, np.uint64), *shingles(text, shingle)]))


def set_name(h: np.ndarray) -> bytes:
    """The same for the same set of shingles, and different for others."""
    from xxhash import xxh128_digest

    return xxh128_digest(h.tobytes())


def wide_fingerprint(h: np.ndarray) -> tuple[bytes, list[int]]:
    """A fingerprint of WIDE bits, and KEYS keys, each of the least of the shingles' hashes under DEEP permutations."""
    if not len(h):
        return bytes(WIDE // 8), [0] * KEYS
    bits, least = np.zeros(WIDE, np.int64), []
    for part in np.split(h, range(BITS, len(h), BITS)):
        spread = part[:, None] * _MIX  # each column is a hash of its own
        spread ^= spread >> np.uint64(32)
        spread *= _MIX[::-1]
        spread ^= spread >> np.uint64(29)
        bits += np.unpackbits(spread.view(np.uint8), axis=1).sum(axis=0, dtype=np.int64)
        least.append(np.concatenate([(spread * m).min(axis=0) for m in _TURNS]))
    keys = np.zeros(KEYS, np.uint64)
    for one in np.min(least, axis=0)[: KEYS * DEEP].reshape(DEEP, KEYS):
        keys = mix(keys * _MIX[0] + one)
    return np.packbits(2 * bits > len(h)).tobytes(), keys.view(np.int64).tolist()


def radius_of(similarity: float, bits: int = WIDE) -> int:
    """Differing bits to be expected at a Jaccard similarity, and five standard deviations more.

    Texts of few shingles have more differing bits than expected: sets of four and five shingles 48 of 256 at 0.8.
    """
    share = float(np.arccos(2 * similarity / (1 + similarity)) / np.pi)
    return int(bits * share + 5 * (bits * share * (1 - share)) ** 0.5)


def wide_planes(fps: list[bytes]) -> list[int]:
    bits = np.unpackbits(np.frombuffer(b"".join(fps), np.uint8).reshape(len(fps), -1), axis=1)
    return [int.from_bytes(np.packbits(c, bitorder="little").tobytes(), "little") for c in np.ascontiguousarray(bits.T)]


def similar_to(sets: list[np.ndarray], similarity: float) -> Callable[[int, list[int]], list[int]]:
    """A function that gives, of some sets, those whose Jaccard similarity to one set is high enough, exactly."""
    sizes = np.array([len(s) for s in sets], np.int64)
    _, places = np.unique(np.concatenate(sets), return_inverse=True)
    own, marked = np.split(places, np.cumsum(sizes)[:-1]), np.zeros(len(places), bool)

    def near(one: int, others: list[int]) -> list[int]:
        marked[own[one]] = True
        n, out = int(sizes[one]), []
        for i in others:
            m = int(sizes[i])
            if min(m, n) < similarity * max(m, n) - 1e-9:
                continue
            common_ones = int(np.count_nonzero(marked[own[i]]))
            if common_ones >= similarity * (m + n - common_ones) - 1e-9:
                out.append(i)
        marked[own[one]] = False
        return out

    return near


def wide_roots(fps: list[bytes], radius: int, similar: Callable[[int, list[int]], list[int]]) -> list[int]:
    """As roots(), for fingerprints of any width; of those within the radius, the similar ones are linked."""
    n, values = len(fps), [np.unpackbits(np.frombuffer(f, np.uint8)).tolist() for f in fps]
    blocks = [wide_planes(fps[i : i + LANES]) for i in range(0, n, LANES)]
    unseen, root = [(1 << min(LANES, n - i)) - 1 for i in range(0, n, LANES)], [-1] * n
    for seed in range(n):
        if root[seed] >= 0:
            continue
        unseen[seed // LANES] ^= 1 << seed % LANES
        root[seed], stack = seed, [seed]
        while stack:
            one = stack.pop()
            for k, block in enumerate(blocks):
                if unseen[k] and (near := within(block, values[one], unseen[k], radius)):
                    lanes = np.flatnonzero(np.unpackbits(np.frombuffer(near.to_bytes(LANES // 8, "little"), np.uint8), bitorder="little"))
                    for i in similar(one, (k * LANES + lanes).tolist()):
                        unseen[k] ^= 1 << i % LANES
                        root[i] = seed
                        stack.append(i)
    return root


def similar_classes(docs: DataFrame, shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """doc_id, text_hash, component_id (the smallest doc_id reachable), stays: a row for each row of docs.

    Documents link by the similarity of their word shingles. Here the radius is too wide for buckets of agreeing
    bits: at a similarity of 0.8 a seventh of the bits differ. Buckets are documents that share one of KEYS keys, each
    made of the least hashes of their shingles under DEEP permutations: those of that similarity do in all but 1 of 600
    cases, those that share a frequent passage only hardly ever. In a bucket, wide fingerprints are compared bit-sliced,
    with a radius that leaves out hardly any pair of that similarity, and those within it link if the Jaccard similarity
    of their shingles is high enough.

    Equal sets of shingles are one node. All nodes of a bucket meet, whatever its size: one beyond PART nodes is dealt
    into parts, each of which gets the bucket's leader too; nodes that a part ties to the leader are one component and
    needn't meet each other again, and the others meet all nodes, part by part. So a group of near copies costs its own
    size, whatever that is.

    text_hash: XXH64 of the text, which with doc_id names a row. stays: true for the rows of a component's smallest
    doc_id and, of these, hash; repeated rows share it. Rows with one doc_id and different texts are documents of
    their own. A null text has no words, all texts without words are one node; a null doc_id counts as the largest.
    Other columns are ignored.
    """
    radius = radius_of(similarity)
    bucket, form = ["choice", "key", "p", "q"], "node long, fp binary, hashes binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.begin("simhash")
        for batch in common.chunks(batches, "text", 2 << 20):
            sets = [shingle_set(t, shingle) for t in common.values(batch, "text")]
            found = [(set_name(h), len(h), *wide_fingerprint(h)) for h in sets]
            yield common.batch_of(prints_form, [batch.column(0), batch.column(1), *zip(*found, strict=True)])

    def shingled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.begin("simhash")
        for batch in common.chunks(batches, "text", 2 << 20):
            sets = [shingle_set(t, shingle) for t in common.values(batch, "text")]
            yield common.batch_of("name binary, hashes binary", [[set_name(h) for h in sets], [h.tobytes() for h in sets]])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each node of a bucket, with the first one that it is linked to."""
        common.begin("simhash")
        last, held = None, []

        def edges() -> pa.RecordBatch:
            nodes, fps, hashes = zip(*held, strict=True) if held else ((), (), ())
            found = wide_roots(fps, radius, similar_to([np.frombuffer(h, np.uint64) for h in hashes], similarity)) if len(fps) > 1 else []
            head = [(*last[:2], nodes[i], nodes[r]) for i, r in enumerate(found)]
            held.clear()
            return common.batch_of(linked_form, list(zip(*head, strict=True)) or [[]] * 4)

        for batch in batches:
            for *key, node, fp, hashes in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if key != last:
                    yield edges()
                    last = key
                held.append((node, fp, hashes))
        yield edges()

    def met(rows: DataFrame) -> DataFrame:
        rows = rows.select(*bucket, *[x.split(" ")[0] for x in form.split(", ")])
        return rows.repartition(*bucket).sortWithinPartitions(*bucket, "node").mapInArrow(compare, linked_form)

    prints_form = "doc_id long, text_hash long, name binary, size long, fp binary, keys array<long>"
    linked_form = "choice int, key long, a long, b long"
    texts = docs.select(common.long_id(docs, "doc_id").alias("doc_id"), common.utf8("text").alias("text"))
    prints = common.stage_table(texts.select("doc_id", F.xxhash64("text").alias("text_hash"), "text").mapInArrow(run, prints_form), "wide-fingerprints")
    nodes = prints.groupBy("name").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")).alias("least"), F.min("size").alias("size"), F.min("fp").alias("fp"), F.min("keys").alias("keys"))
    nodes = common.stage_table(nodes.withColumn("node", F.monotonically_increasing_id()), "nodes")

    rows = nodes.select(F.posexplode("keys").alias("choice", "key"), "node", "name", "fp", "size")
    counts = (F.count("*").alias("n"), F.sum("size").alias("held"))
    parts = F.greatest(F.ceil(F.col("n") / PART), F.ceil(F.col("held") / HELD), F.lit(1)).cast("int")
    sizes = rows.groupBy("choice", "key").agg(*counts, F.min("node").alias("leader")).where("n > 1").select("choice", "key", "leader", parts.alias("parts"))
    rows = common.stage_table(rows.join(sizes, ["choice", "key"]), "met")
    # only texts that meet others are read again for their shingles
    sets = common.stage_table(_of_nodes(texts, nodes, rows).mapInArrow(shingled, "name binary, hashes binary").groupBy("name").agg(F.first("hashes").alias("hashes")), "shingle-sets")
    own = F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")
    first = rows.withColumn("p", F.explode(F.when(F.col("node") == F.col("leader"), F.sequence(F.lit(0), F.col("parts") - 1)).otherwise(F.array(own))))
    links = common.stage_table(met(first.withColumn("q", F.lit(-1)).join(sets, "name")), "links")

    large = rows.where("parts > 1").select("choice", "key", "node", "name", "leader", "fp", "size", "parts")
    tied = links.join(large.select("choice", "key", "leader").distinct(), ["choice", "key"]).where("b = leader").select("choice", "key", F.col("a").alias("node"), F.lit(False).alias("apart"))
    large = large.join(tied.distinct(), ["choice", "key", "node"], "left").withColumn("apart", F.coalesce("apart", F.lit(True)))
    large = common.stage_table(large, "large-buckets")
    sizes = large.groupBy("choice", "key").agg(F.count_if("apart").alias("others"), F.sum(F.when(F.col("apart"), F.col("size")).otherwise(0)).alias("held")).where("others > 0")
    few = F.greatest(F.ceil(F.col("others") / PART), F.ceil(F.col("held") / HELD), F.lit(1)).cast("int")
    large = large.join(sizes.select("choice", "key", few.alias("few")), ["choice", "key"])
    # a part of the others, p, meets every part of all nodes, q
    all_p = F.sequence(F.lit(0), F.col("few") - 1)
    all_q = F.sequence(F.lit(0), F.col("parts") - 1)
    one_p, one_q = F.pmod(F.xxhash64("node"), F.col("few")).cast("int"), own
    pairs = F.transform(all_p, lambda p: F.struct(p.alias("p"), one_q.alias("q")))
    pairs = F.when(F.col("apart"), F.array_union(pairs, F.transform(all_q, lambda q: F.struct(one_p.alias("p"), q.alias("q"))))).otherwise(pairs)
    second = met(large.withColumn("pq", F.explode(pairs)).select("*", "pq.p", "pq.q").join(sets, "name"))

    found = components(links.unionByName(second).where("a <> b").select("a", "b"))
    named = common.stage_table(nodes.join(found, "node", "left").select("name", "least", F.coalesce("root", "node").alias("root")), "rooted")
    names = named.groupBy("root").agg(F.min("least").alias("first"))
    named = named.select("name", "root").join(names, "root").select("name", "first")
    out = prints.select("doc_id", "text_hash", "name").join(named, "name")
    stays = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("text_hash") == F.col("first.text_hash"))
    return out.select("doc_id", "text_hash", F.col("first.doc_id").alias("component_id"), stays.alias("stays"))


def _of_nodes(texts: DataFrame, nodes: DataFrame, rows: DataFrame) -> DataFrame:
    """A text of each node in rows."""
    wanted = nodes.join(rows.select("node").distinct(), "node", "left_semi").select(F.col("least.doc_id").alias("own_id"), F.col("least.text_hash").alias("own_hash"))
    return texts.join(wanted, texts["doc_id"].eqNullSafe(F.col("own_id")) & (F.xxhash64(texts["text"]) == F.col("own_hash")), "left_semi")
