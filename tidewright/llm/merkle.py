"""Merkle manifest of a dataset: a tree of runs of three whose parents keep the hash's state before each child slot.

A child's digest stands as 64 hex digits, which is one block of SHA-256, so a parent's state before its second and third
child is eight words that can be stored. To fold another digest into a tree, the state before its slot is resumed with
the new digest and the right siblings; what lies to the left is not read. Nodes are held in pages of 243 leaves with five
levels above them. A round of the build gathers the roots of pages into pages of the next round, so neither a large
part nor a large number of parts meets in one task. A second pass goes from the last page down and hands each page the
steps that lead from its root to the tree's.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

#: Children of a parent, levels of a page, leaves of a page, pages worked on at a time.
ARITY, LEVELS = 3, 5
PAGE, SLICE = ARITY**LEVELS, 32
ITEMS = "grp long, page long, total long, ids array<long>, digests array<binary>, changed array<binary>"
#: nodes: digests of the page's upper levels, from the lowest on; states: before the second and third child of each of them.
PAGES = f"{ITEMS}, nodes binary, states binary, root binary"
#: steps: from the page's root to the tree's, STEP bytes each.
PATHS = "grp long, page long, steps binary, subroot binary, root binary"
FOLDED = "id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string"
#: A step up: children of the parent, slot, state before the slot, digests of the other children in order.
STEP = 2 + 32 + 64


def _primes(n: int) -> list[int]:
    found = [2]
    while len(found) < n:
        found.append(next(x for x in range(found[-1] + 1, 4 * found[-1]) if all(x % p for p in found)))
    return found


def _cube_root_bits(p: int) -> int:
    """The first 32 bits after the point of a prime's cube root, by Newton's steps on whole numbers."""
    x = 1 << 36
    while (y := (2 * x + (p << 96) // (x * x)) // 3) < x:
        x = y
    return x & 0xFFFFFFFF


#: By the standard's rule: bits of the roots of the first primes.
START = np.array([isqrt(p << 64) & 0xFFFFFFFF for p in _primes(8)], np.uint32)
ROUND = [np.uint32(_cube_root_bits(p)) for p in _primes(64)]
DIGITS = np.frombuffer(b"0123456789abcdef", np.uint8)


def _turn(x: np.ndarray, n: int) -> np.ndarray:
    return x >> np.uint32(n) | x << np.uint32(32 - n)


def resume(state: np.ndarray, block: np.ndarray) -> np.ndarray:
    """SHA-256's state (8 words x n) after one more block (16 words x n)."""
    w = list(block)
    for t in range(16, 64):
        x, y = w[t - 15], w[t - 2]
        w.append(w[t - 16] + (_turn(x, 7) ^ _turn(x, 18) ^ x >> np.uint32(3)) + w[t - 7] + (_turn(y, 17) ^ _turn(y, 19) ^ y >> np.uint32(10)))
    a, b, c, d, e, f, g, h = state
    for k, x in zip(ROUND, w, strict=True):
        one = h + (_turn(e, 6) ^ _turn(e, 11) ^ _turn(e, 25)) + (g ^ e & (f ^ g)) + k + x
        two = (_turn(a, 2) ^ _turn(a, 13) ^ _turn(a, 22)) + (a & b | c & (a | b))
        a, b, c, d, e, f, g, h = one + two, a, b, c, d + one, e, f, g
    return np.stack([a, b, c, d, e, f, g, h]) + state


def packed(state: np.ndarray) -> np.ndarray:
    """n x 32 bytes of 8 words x n."""
    return np.ascontiguousarray(state.T).astype(">u4").view(np.uint8).reshape(-1, 32)


def words(data: np.ndarray) -> np.ndarray:
    """Words x n of n x bytes."""
    return np.ascontiguousarray(np.ascontiguousarray(data).view(">u4").astype(np.uint32).T)


def block(digests: np.ndarray) -> np.ndarray:
    """The hex digits of n x 32 bytes as a block: 16 words x n."""
    nibbles = np.stack([digests >> 4, digests & 15], axis=2).reshape(len(digests), 64)
    return words(DIGITS[nibbles])


def closed(state: np.ndarray, children: np.ndarray) -> np.ndarray:
    """n x 32 bytes: the digest of a parent whose state has taken in so many children."""
    last = np.zeros((16, len(children)), np.uint32)
    last[0], last[15] = 1 << 31, children * 512
    return packed(resume(state, last))


def _taken(state: np.ndarray, own: np.ndarray, digests: np.ndarray) -> np.ndarray:
    """The state with one more child for the columns in `own`."""
    out = state.copy()
    if len(own):
        out[:, own] = resume(state[:, own], block(digests))
    return out


def depth(total: int) -> int:
    """Levels that a page adds where a tree has so many nodes: as many as leave one, or all of a page's."""
    levels = 0
    while total > 1 and levels < LEVELS:
        total, levels = -(-total // ARITY), levels + 1
    return levels


def sizes(n: int, levels: int) -> list[int]:
    """Nodes of a page at each level, from its leaves to its root."""
    return reduce(lambda x, _: [*x, -(-x[-1] // ARITY)], range(levels), [n])


def grown(digests: np.ndarray, begins: np.ndarray, depths: np.ndarray) -> tuple[list, list]:
    """For each page (rows begins[p] to begins[p + 1] of the digests): its digests and its parents' states by level."""
    pages = range(len(depths))
    nodes, states = [[digests[begins[p] : begins[p + 1]]] for p in pages], [[] for _ in pages]
    for level in range(int(depths.max(initial=0))):
        parents = np.where(depths > level, -(-np.diff(begins) // ARITY), 0)
        ends = np.concatenate([[0], np.cumsum(parents)])
        page = np.repeat(np.arange(len(depths)), parents)
        first = begins[page] + ARITY * (np.arange(ends[-1]) - ends[page])
        children = np.minimum(ARITY, begins[page + 1] - first)
        state, before = np.repeat(START[:, None], ends[-1], axis=1), []
        for slot in range(ARITY):
            if slot:
                before.append(packed(state))
            own = np.flatnonzero(children > slot)
            state = _taken(state, own, digests[first[own] + slot])
        digests, before = closed(state, children), np.concatenate(before, axis=1)
        for p in np.flatnonzero(parents):
            nodes[p].append(digests[ends[p] : ends[p + 1]])
            states[p].append(before[ends[p] : ends[p + 1]])
        begins = ends
    return nodes, states


def steps(nodes: list[np.ndarray], states: list[np.ndarray], above: np.ndarray) -> np.ndarray:
    """Leaves x levels x STEP: the way from each leaf of a page to the tree's root."""
    n, out = len(nodes[0]), []
    for level, before in enumerate(states):
        own, at = nodes[level], np.arange(len(nodes[level]))
        slot, first = at % ARITY, at - at % ARITY
        step = np.zeros((len(own), STEP), np.uint8)
        step[:, 0], step[:, 1] = np.minimum(ARITY, len(own) - first), slot
        start = np.concatenate([np.broadcast_to(packed(START[:, None]), (len(before), 32)), before], axis=1).reshape(-1, ARITY, 32)
        step[:, 2:34] = start[at // ARITY, slot]
        for k in range(ARITY - 1):
            other = first + k + (k >= slot)
            there = other < len(own)
            step[there, 34 + 32 * k : 66 + 32 * k] = own[other[there]]
        out.append(step[np.arange(n) // ARITY**level])
    out += [np.broadcast_to(x, (n, STEP)) for x in above]
    return np.stack(out, axis=1) if out else np.zeros((n, 0, STEP), np.uint8)


def folded(digests: np.ndarray, ways: np.ndarray) -> np.ndarray:
    """Roots that follow from other leaves: each step resumes its state with the digest and the right siblings only."""
    for level in range(ways.shape[1]):
        way = ways[:, level]
        active = np.flatnonzero(way[:, 0])
        children, slot = way[active, 0].astype(np.int64), way[active, 1].astype(np.int64)
        state = resume(words(way[active, 2:34]), block(digests[active]))
        for k in range(ARITY - 1):  # the others stand in order: those from `slot` on are to the right
            own = np.flatnonzero((k >= slot) & (k < children - 1))
            state = _taken(state, own, way[active[own], 34 + 32 * k : 66 + 32 * k])
        digests = digests.copy()
        digests[active] = closed(state, children)
    return digests


def proofs(ways: np.ndarray) -> list[str]:
    """SHA-256 of the hex digests of all siblings, level by level, left to right."""
    others = ways[:, :, 34:].reshape(*ways.shape[:2], ARITY - 1, 32)
    there = np.arange(ARITY - 1) < ways[:, :, :1].astype(np.int64) - 1
    return [hashlib.sha256(o[t].tobytes().hex().encode()).hexdigest() for o, t in zip(others, there, strict=True)]


def _flat(column: pa.Array) -> np.ndarray:
    """n x 32 bytes of a list column of digests."""
    parts = column.flatten()
    return np.frombuffer(b"".join(parts.to_pylist()), np.uint8).reshape(-1, 32)


def _built(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    common.begin("merkle")
    for batch in batches:
        for at in range(0, batch.num_rows, SLICE):
            own = batch.slice(at, SLICE)
            lists = own.column(own.schema.get_field_index("digests"))
            begins = np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy())])
            nodes, states = grown(_flat(lists), begins, np.array([depth(n) for n in common.values(own, "total")]))
            more = [[b"".join(x.tobytes() for x in page[1:]) for page in nodes], [b"".join(x.tobytes() for x in page) for page in states], [page[-1].tobytes() for page in nodes]]
            names = [*own.schema.names, "nodes", "states", "root"]
            yield pa.RecordBatch.from_arrays([*own.columns, *[pa.array(x, pa.binary()) for x in more]], names=names)


def _ways(row: dict) -> tuple[np.ndarray, np.ndarray]:
    """A page's leaves and their ways up."""
    leaves = np.frombuffer(b"".join(row["digests"]), np.uint8).reshape(-1, 32)
    counts = sizes(len(leaves), depth(row["total"]))
    cuts = np.cumsum(counts[1:])[:-1]
    above = np.split(np.frombuffer(row["nodes"], np.uint8).reshape(-1, 32), cuts) if len(counts) > 1 else []
    before = np.split(np.frombuffer(row["states"], np.uint8).reshape(-1, 64), cuts) if len(counts) > 1 else []
    return leaves, steps([leaves, *above], before, np.frombuffer(row["steps"], np.uint8).reshape(-1, STEP))


def _down(top: bool, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """PATHS of the pages below; top: these are the parts' last pages, whose roots are the subroots."""
    common.begin("merkle")
    for batch in batches:
        for at in range(0, batch.num_rows, SLICE):
            out: list[list] = [[], [], [], [], []]
            for row in batch.slice(at, SLICE).to_pylist():
                leaves, ways = _ways(row)
                out[0] += row["ids"] if top else [row["grp"]] * len(leaves)
                out[1] += [0] * len(leaves) if top else row["ids"]
                out[2] += [x.tobytes() for x in ways]
                out[3] += [x.tobytes() for x in leaves] if top else [row["subroot"]] * len(leaves)
                out[4] += [row["path_root"]] * len(leaves)
            yield common.batch_of(PATHS, out)


def _leaves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    common.begin("merkle")
    for batch in batches:
        for at in range(0, batch.num_rows, SLICE):
            rows = batch.slice(at, SLICE).to_pylist()
            pages = [_ways(r) for r in rows]
            longest = max(w.shape[1] for _, w in pages)
            ways = np.concatenate([np.pad(w, ((0, 0), (0, longest - w.shape[1]), (0, 0))) for _, w in pages])
            other = np.concatenate([np.frombuffer(b"".join(y or x for x, y in zip(r["digests"], r["changed"], strict=True)), np.uint8).reshape(-1, 32) for r in rows])
            each = [len(x) for x, _ in pages]
            hexes = [x.tobytes().hex() for x in np.concatenate([x for x, _ in pages])]
            roots = lambda name, rows=rows, each=each: [r[name].hex() for r, n in zip(rows, each, strict=True) for _ in range(n)]
            yield common.batch_of(FOLDED, [[i for r in rows for i in r["ids"]], hexes, roots("subroot"), roots("path_root"), proofs(ways), [x.tobytes().hex() for x in folded(other, ways)]])


def positions(df: DataFrame, *order: Column | str) -> DataFrame:
    """df with dense places `at` from 0 on: sorted by ranges, counted by task, and the counts added up.

    The order may have ties only between equal rows.
    """
    staged = common.stage_table(df.orderBy(*order).withColumn("own_row", F.monotonically_increasing_id()), "ordered")
    part = F.shiftright("own_row", 33).alias("own_part")
    before = F.coalesce(F.sum("n").over(Window.orderBy("own_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = staged.groupBy(part).agg(F.count("*").alias("n")).select("own_part", before.alias("own_before"))
    return staged.withColumn("own_part", part).join(counts, "own_part").withColumn("at", F.col("own_before") + F.col("own_row").bitwiseAND((1 << 33) - 1)).drop("own_part", "own_before", "own_row")


def _rounds(nodes: DataFrame, most: int) -> list[DataFrame]:
    """PAGES of each round; nodes: grp, at, total (nodes of the part), id, digest, changed."""
    out = []
    while not out or most > 1:
        item = F.struct("at", "id", "digest", "changed")
        pages = nodes.groupBy("grp", F.expr(f"at div {PAGE}").alias("page")).agg(F.max("total").alias("total"), F.sort_array(F.collect_list(item)).alias("items"))
        items = pages.select("grp", "page", "total", F.col("items.id").alias("ids"), F.col("items.digest").alias("digests"), F.col("items.changed").alias("changed"))
        out.append(common.stage_table(items.mapInArrow(_built, PAGES), "pages"))
        most = -(-most // PAGE)
        total = F.expr(f"(total + {PAGE - 1}) div {PAGE}")
        nodes = out[-1].select("grp", F.col("page").alias("at"), total.alias("total"), F.col("page").alias("id"), F.col("root").alias("digest"), F.lit(None).cast("binary").alias("changed"))
    return out


@dataclass
class Manifest:
    """The tree's pages: rounds of every part's tree, then rounds of the tree of the parts' roots."""

    spark: SparkSession
    parts: list[DataFrame]
    top: list[DataFrame]

    def root(self) -> str | None:
        rows = self.top[-1].select("root").collect() if self.top else []
        return rows[0].root.hex() if rows else None

    def fold(self) -> DataFrame:
        """FOLDED for each leaf: its proof, and the root that follows from its changed digest (else its own)."""
        if not self.top:
            return self.spark.createDataFrame([], FOLDED)
        paths = self.top[-1].select("grp", "page", F.lit(b"").alias("steps"), F.lit(None).cast("binary").alias("subroot"), F.col("root"))
        for k, pages in reversed([*enumerate(self.parts), *enumerate(self.top, len(self.parts))]):
            below = pages.drop("root").join(paths.withColumnRenamed("root", "path_root"), ["grp", "page"])
            if not k:
                return below.mapInArrow(_leaves, FOLDED)
            paths = below.mapInArrow(lambda b, top=k == len(self.parts): _down(top, b), PATHS)
            paths = common.stage_table(paths, "paths")
        raise AssertionError("a manifest has pages")


def field(column: Column) -> Column:
    """`-` for null, else the value's bytes in UTF-8, a colon and the value."""
    text = column.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(*columns: Column) -> Column:
    return F.unhex(F.sha2(F.concat(*map(field, columns)), 256))


def build(leaves: DataFrame) -> Manifest:
    """leaves: part, id, leaf, changed (null: not). Leaves of a part ascend by id, parts by name, nulls first.

    Rows that share an id stand in the order of their digests; repeated rows are leaves of their own; parts are told
    apart bytewise. An empty table has no root.
    """
    spark = leaves.sparkSession
    placed = common.stage_table(positions(leaves.select("part", "id", "leaf", "changed"), "part", "id", "leaf", "changed"), "leaves")
    parts = common.stage_table(positions(placed.groupBy("part").agg(F.min("at").alias("first"), F.count("*").alias("total")), "part").withColumnRenamed("at", "grp"), "parts")
    n_parts, most = parts.agg(F.count("*"), F.max("total")).first()
    if not n_parts:
        return Manifest(spark, [], [])
    nodes = placed.join(parts.withColumnRenamed("part", "own_part"), F.col("part").eqNullSafe(F.col("own_part")))
    own = _rounds(nodes.select("grp", (F.col("at") - F.col("first")).alias("at"), "total", "id", F.col("leaf").alias("digest"), "changed"), most)
    top = own[-1].select(F.lit(0).cast("long").alias("grp"), F.col("grp").alias("at"), F.lit(n_parts).cast("long").alias("total"), F.col("grp").alias("id"), F.col("root").alias("digest"), F.lit(None).cast("binary").alias("changed"))
    return Manifest(spark, own, _rounds(top, n_parts))


def oracle_sql(levels: int = 12, top: int = 7) -> str:
    """Level by level in plain SQL, for parts of 3**levels rows and 3**top parts at most; CRC-32 bit by bit."""
    crc = "list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT))), lambda crc, b: list_reduce(list_prepend(xor(crc, b), range(8)), lambda x, k: xor(x >> 1, (x & 1) * 3988292384)))"
    part = lambda c: f"coalesce(strlen(CAST({c} AS VARCHAR)) || ':' || {c}, '-')"
    hashed = lambda text: f"sha256({' || '.join(map(part, ('doc_id', 'source', 'lang', 'n_chars')))} || {part(text)})"
    # the last step of the checksum flips all bits, so it is even where the register is odd
    ctes = [f"docs AS MATERIALIZED (SELECT doc_id, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS g, {hashed('text')} AS leaf, CASE WHEN doc_id IS NOT NULL AND ({crc}) & 1 = 1 THEN {hashed("replace(text, chr(10), '')")} END AS changed FROM documents)"]
    ctes.append("f0 AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, coalesce(changed, leaf) AS f, '' AS others FROM docs)")
    ctes.append("n0 AS MATERIALIZED (SELECT g, i, leaf AS d, count(*) OVER (PARTITION BY g) AS total FROM f0)")
    for k in range(levels + top + 1):
        if k == levels:
            ctes.append(f"n{k + 1} AS MATERIALIZED (SELECT 0 AS g, g AS i, d, count(*) OVER () AS total FROM n{k})")
            ctes.append(f"f{k + 1} AS MATERIALIZED (SELECT f.* REPLACE (0 AS g, f.g AS i), n.d AS subroot FROM f{k} f JOIN n{k} n USING (g))")
            continue
        beside = "string_agg(d, '') OVER (PARTITION BY g, i // 3 ORDER BY i ROWS BETWEEN {})"
        ctes.append(f"s{k} AS MATERIALIZED (SELECT g, i, total, coalesce({beside.format('UNBOUNDED PRECEDING AND 1 PRECEDING')}, '') AS l, coalesce({beside.format('1 FOLLOWING AND UNBOUNDED FOLLOWING')}, '') AS r FROM n{k})")
        ctes.append(f"n{k + 1} AS MATERIALIZED (SELECT g, i // 3 AS i, CASE WHEN max(total) = 1 THEN max(d) ELSE sha256(string_agg(d, '' ORDER BY i)) END AS d, (max(total) + 2) // 3 AS total FROM n{k} GROUP BY g, i // 3)")
        ctes.append(f"f{k + 1} AS MATERIALIZED (SELECT f.* REPLACE (f.i // 3 AS i, CASE WHEN s.total = 1 THEN f.f ELSE sha256(s.l || f.f || s.r) END AS f, f.others || s.l || s.r AS others) FROM f{k} f JOIN s{k} s USING (g, i))")
    last = levels + top + 1
    return f"WITH {', '.join(ctes)} SELECT doc_id, leaf, subroot, n.d AS root, sha256(others) AS proof_sha256, f AS folded_root, f = n.d AS verified FROM f{last} CROSS JOIN n{last} n"
