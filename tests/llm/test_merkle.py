"""The tree of stored states against a plain tree of nested lists, tampered leaves and lost rows among them."""

import hashlib
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.fixtures import DOCS, documents, rows
from tidewright.llm import common, merkle, queries


def h(*parts: str) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row, text) -> str:
    doc_id, _, lang, source, n_chars = row
    return h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text)))


def tree(leaves: list[str]) -> list[list[str]]:
    levels = [leaves]
    while len(levels[-1]) > 1:
        levels.append([h(*levels[-1][k : k + 3]) for k in range(0, len(levels[-1]), 3)])
    return levels


def siblings(levels: list[list[str]], at: int) -> list[tuple[list[str], list[str]]]:
    out = []
    for level in levels[:-1]:
        first = at - at % 3
        out.append((level[first:at], level[at + 1 : first + 3]))
        at //= 3
    return out


def plain(data: list[tuple]) -> Counter:
    parts = defaultdict(list)
    for row in data:
        changed = leaf(row, row[1].replace("\n", "") if row[1] is not None else None) if row[0] is not None and zlib.crc32(str(row[0]).encode()) % 2 == 0 else None
        parts[row[3]].append((row[0] is not None, row[0] or 0, leaf(row, row[1]), changed))
    names = sorted(parts, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: tree([x[2] for x in sorted(parts[s], key=lambda x: x[:3])]) for s in names}
    top, out = tree([trees[s][-1][0] for s in names]), Counter()
    for k, s in enumerate(names):
        for at, (there, doc_id, own, changed) in enumerate(sorted(parts[s], key=lambda x: x[:3])):
            way = siblings(trees[s], at) + siblings(top, k)
            digest = changed or own
            for left, right in way:
                digest = h(*left, digest, *right)
            out[doc_id if there else None, own, trees[s][-1][0], top[-1][0], h(*[x for left, right in way for x in (*left, *right)]), digest, digest == top[-1][0]] += 1
    return out


def build(spark, data, monkeypatch) -> Counter:
    frame = spark.createDataFrame(data, DOCS).withColumn("part", F.lit("clash")).withColumn("at", F.lit(0)).withColumn("leaf", F.lit(0)).repartition(7)
    monkeypatch.setattr(common, "table", lambda *_: frame)
    return Counter(map(tuple, queries.op12_merkle(spark, "").collect()))


@pytest.mark.parametrize("n", [1, 2, 3, 4, 243, 244, 1500])
def test_one_part_of_any_size(spark, monkeypatch, n):
    data = [(i, f"a\nb{i}" if i % 3 else "same", "en", "s", i) for i in range(n)]
    assert build(spark, data, monkeypatch) == plain(data)


def test_awkward_rows_and_many_parts(spark, monkeypatch):
    data = rows() + [(i, f"x\n{i}", None, f"s{i % 300}é", 1) for i in range(700)] + [(7, "z\n" * 5000, None, "", 0)] + [(2000 + i, "\n", "en", "hot", i) for i in range(800)]
    data += [(5, f"tie {k % 3}", "en", "hot", None) for k in range(9)] + [(None, "t\n", "en", None, None)] * 3
    got = build(spark, data, monkeypatch)
    assert got == plain(data)
    assert {r[-1] for r in got} == {True, False}


def test_no_rows(spark):
    empty = documents(spark, []).select(F.col("source").alias("part"), F.col("doc_id").alias("id"), merkle.leaf(F.col("text")).alias("leaf"), F.lit(None).cast("binary").alias("changed"))
    manifest = merkle.build(empty)
    assert manifest.root() is None and manifest.fold().count() == 0


def test_states_resume_without_the_left_siblings():
    rng = np.random.default_rng(1)
    leaves = rng.integers(0, 256, (8, 32), dtype=np.uint8)
    nodes, states = merkle.grown(leaves, np.array([0, 8]), np.array([2]))
    ways = merkle.steps(nodes[0], states[0], np.zeros((0, merkle.STEP), np.uint8))
    assert [x.tobytes().hex() for x in merkle.folded(leaves, ways)] == [tree([x.tobytes().hex() for x in leaves])[-1][0]] * 8
    slot = ways[:, :, 1]
    for level in range(ways.shape[1]):  # siblings to the left are part of the proof, not of the fold
        for k in range(merkle.ARITY - 1):
            ways[slot[:, level] > k, level, 34 + 32 * k : 66 + 32 * k] = 0
    assert [x.tobytes().hex() for x in merkle.folded(leaves, ways)] == [nodes[0][-1].tobytes().hex()] * 8
