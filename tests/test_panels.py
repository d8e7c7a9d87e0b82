"""Panels of settings: worked on where a series' rows are, against windows and scans on the same rows; nothing of a setting is stored."""

import datetime
from pathlib import Path

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from tidewright import stage
from tidewright.operators import panels, summaries
from tidewright.plans.catalogue import QUERIES

SF = "/root/testdata/sf0.001"
NAMES = ("b12_stress", "b16_panel", "b17_gate_runs", "b12_sweep")


@pytest.fixture(scope="module")
def odd(tmp_path_factory):
    """Events of series that are short, flat, all alike, without a training part, with gaps, and longer than the widest window."""
    folder, rows = tmp_path_factory.mktemp("odd"), []
    values = {
        3: [5.0],
        40: [None, 7.0],  # the only value left is no training row
        41: [4.0] * 30,
        42: [float(i * 37 % 11) for i in range(130)],
        77: [None if i % 5 == 0 else float("nan") if i % 7 == 0 else i * i % 223 + 0.125 for i in range(90)],
        88_500: [((i * 7919) % 1009) / 3.0 for i in range(64)],
    }
    for user, own in values.items():
        rows += [(user * 1000 + i, datetime.datetime(2024, 1, 1) + datetime.timedelta(hours=i), user, "view", x, "{}") for i, x in enumerate(own)]
    names = ("event_id", "ts", "user_id", "event_type", "value", "props")
    pq.write_table(pa.table({k: list(c) for k, c in zip(names, zip(*rows, strict=True), strict=True)}), folder / "events.parquet")
    return str(folder)


def rows_of(spark, name: str, folder: str) -> list:
    found = QUERIES[name](spark, folder)
    return sorted((tuple(r[c] for c in sorted(found.columns)) for r in found.collect()), key=str)


@pytest.mark.parametrize("name", NAMES)
def test_series_of_either_length_score_alike(spark, odd, name, monkeypatch):
    together = rows_of(spark, name, odd)
    monkeypatch.setattr(panels, "HELD", 80)  # some in blocks, some by windows and scans
    assert together and rows_of(spark, name, odd) == together


@pytest.mark.parametrize("name", NAMES)
def test_settings_are_not_stored(spark, tmp_path, name, monkeypatch):
    monkeypatch.setattr(stage, "folder", lambda _: f"file://{tmp_path}")
    QUERIES[name](spark, SF).collect()
    stored = sum(pq.read_metadata(p).num_rows for p in Path(tmp_path).rglob("*.parquet"))
    assert 0 < stored <= 3 * 1000


def test_failures_ask_for_the_posterior_model_only(spark, monkeypatch):
    asked, areas_of = [], panels.areas_of
    monkeypatch.setattr(panels, "areas_of", lambda *args: asked.append(args[2]) or areas_of(*args))
    assert QUERIES["b2_failures"](spark, SF).count() == 10
    assert asked == [("hmm",)]


def test_a_suite_makes_its_runs_once(spark):
    made = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            made.add(batch.num_rows)
            yield batch

    runs = [(k, m, 0.5, a) for k, own in (("x", {"a": 0.4, "b": 0.9, "c": 0.9}), ("y", {"a": 0.3, "b": None}), ("z", {"c": 0.1})) for m, a in own.items()]
    rows = spark.createDataFrame(runs, "mode string, method string, auroc double, auprc double").mapInArrow(count, "mode string, method string, auroc double, auprc double")
    found = summaries.suite(rows, ["mode"], F.col("method").isin("a", "b"), F.upper("method"))
    got = {r["mode"]: (r.recommended_method, r.recommended_family, r.best_auprc, r.cases, r.own_method, r.own_auprc, r.gain) for r in found.collect()}
    assert got == {"x": ("b", "B", 0.9, 1, "b", 0.9, 0.0), "y": ("a", "A", 0.3, 1, "a", 0.3, 0.0), "z": ("c", "C", 0.1, 1, None, None, None)}
    assert made.value == len(runs)


def test_blocks_hold_whole_series_whatever_the_batches():
    sizes = {1: 5, 2: 300, 4: 1, 9: 70, 10: 70, 11: 3}
    ids = [i for i, n in sizes.items() for _ in range(n)]
    t = [k for n in sizes.values() for k in range(n)]
    whole = pa.RecordBatch.from_pydict({"series_id": ids, "own": [True] * len(ids), "t": t, "id": t, "v": [k / 7 for k in t], "train": [k < 3 for k in t]})
    for step in (1, 64, 449, 1000):
        got = {}
        for block in panels.blocks((whole.slice(a, step) for a in range(0, whole.num_rows, step)), 128):
            assert list(block.size) == sorted(block.size, reverse=True)
            for i, n, inside, own in zip(block.ids, block.size, block.inside, block.t, strict=True):
                assert i not in got and list(own[inside]) == list(range(n))
                got[int(i)] = int(n)
        assert got == sizes
