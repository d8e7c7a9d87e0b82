"""Interval joins, the versioned table and the audits on small cases with nulls, repeats, ties and empty tables."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tidewright.operators import audits, intervals
from tidewright.operators import selection as P
from tidewright.operators import summaries as B
from tidewright.sources.versioned import KeyedTable

ROWS = "k string, sub long, name string, score double"


def test_points_in_intervals_against_every_pair(spark):
    rng = random.Random(1)
    points = [(rng.choice(["a", "b", None]), rng.randint(-300, 3000), i % 50) for i in range(600)] + [("hot", i % 900, 1) for i in range(900)]
    spans = [(rng.choice(["a", "b", None]), b := rng.randint(-400, 3000), b + rng.choice([0, 1, 15, 16, 17, 200, 2500]), i) for i in range(80)]
    spans += [("hot", -10**6, 10**6, 100), ("hot", 5, 4, 101), ("a", None, 9, 102), ("a", 3, None, 103), ("b", 0, 128, 104), ("b", 0, 128, 104)]
    p = spark.createDataFrame(points, "series string, t long, _bin long").withColumnRenamed("_bin", "tag")
    s = spark.createDataFrame(spans, "series string, begin long, end long, flag long")
    got = Counter(map(tuple, intervals.covered(p, s, ["series"]).select("series", "t", "tag", "flag").collect()))
    want = Counter((k, t, tag, f) for k, t, tag in points for j, b, e, f in spans if k is not None and k == j and b is not None and e is not None and b <= t <= e)
    assert got == want and sum(n for (k, *_), n in got.items() if k == "hot") == 900
    assert intervals.covered(p, s.where("false"), ["series"]).count() == 0 and intervals.covered(p.where("false"), s, ["series"]).count() == 0


def files(spark, table: KeyedTable) -> dict[str, set]:
    return {b: {f.split("/")[-1] for f in spark.read.parquet(p).inputFiles()} for b, p in table.state().parts.items()}


def test_upserts_rewrite_what_they_touch(spark, tmp_path):
    table = KeyedTable(spark, f"file://{tmp_path}/t", ROWS, ["k", "sub"], 8)
    assert table.read().count() == 0 and table.state().version == 0
    first = [("a", 1, "one", 1.0), ("b", 1, "two", 2.0), (None, None, "none", 0.0), ("c", 2, "three", None)] + [(f"k{i}", i, "many", float(i)) for i in range(60)]
    assert table.upsert(spark.createDataFrame(first, ROWS), 3) == 1
    before = files(spark, table)
    second = [("a", 1, "new", 9.0), ("d", 4, "four", 4.0), (None, None, "still none", 1.0), ("d", 4, "five", 4.0)]
    extra = spark.createDataFrame(second, ROWS).withColumn("bucket", F.lit("clash"))
    assert table.upsert(extra, 5) == 2
    want = {(k, s): (n, x) for k, s, n, x in first} | {("a", 1): ("new", 9.0), ("d", 4): ("four", 4.0), (None, None): ("still none", 1.0)}  # of two rows the greater
    assert {(r.k, r["sub"]): (r.name, r.score) for r in table.read().collect()} == want and table.read().count() == len(want)
    after = files(spark, table)
    touched = {b for b in after if after[b] != before.get(b)}
    assert 0 < len(touched) <= 3 and set(before) - touched  # the other buckets' files are the old ones
    assert {(r.k, r["sub"]): (r.name, r.score) for r in table.read(1).collect()} == {(k, s): (n, x) for k, s, n, x in first}
    for epoch in (5, 4):  # batches that come again, or late
        assert table.upsert(spark.createDataFrame(first, ROWS), epoch) == 2
    assert table.upsert(spark.createDataFrame([], ROWS), 6) == 3 and table.read().count() == len(want)


def test_a_writer_that_comes_second_fails(spark, tmp_path):
    one, two = (KeyedTable(spark, f"file://{tmp_path}/t", ROWS, ["k"]) for _ in range(2))
    old = one.state()
    assert one.upsert(spark.createDataFrame([("a", 1, "x", 1.0)], ROWS), 0) == 1
    two.state = lambda version=None: old  # it has read the table before the other one wrote
    with pytest.raises(RuntimeError, match="version 1"):
        two.upsert(spark.createDataFrame([("b", 1, "y", 1.0)], ROWS), 0)
    assert [r.k for r in KeyedTable(spark, f"file://{tmp_path}/t", ROWS, ["k"]).read().collect()] == ["a"]


def test_flags_and_classes(spark):
    flags = spark.createDataFrame([(1, 0, 10, "t_u  gps_lat p_u", "CHECKME", "give 0degC here", False), (2, 0, None, None, "x", None, False), (3, 5, 9, "wspd_l", "stuck", "", True), (4, 1, 2, "rh_u", "OK", "Disfunctional", False)], "flag_id int, begin long, end long, variable string, flag string, comment string, commented_out boolean")
    got = {r.flag_id: (r.duration, r.scalar_variable_count, r.variable_families, r.relevance, r.usable) for r in audits.flag_inventory(flags).collect()}
    assert got == {1: (10, 2, "pressure temperature", P.CLASSES[0], 1), 2: (None, 0, "", P.CLASSES[2], 0), 3: (4, 1, "wind_speed", P.CLASSES[0], 0), 4: (1, 1, "humidity", P.CLASSES[1], 0)}
    layers = spark.createDataFrame([("field_qc_low_epsilon_1",), ("iid_stuck",), ("segment_stuck",), (None,)], "layer string")
    assert [r[0][:8] for r in layers.select(P.layer_trigger(F.col("layer"))).collect()] == ["deployed", "iid scal", "persiste", "persiste"]
    rows = spark.createDataFrame([("x", "l", "a", "a"), ("x", "availability", "a", "a"), ("A HadISD b", "l", "a", "b"), ("coops", "l", "a", None), ("x", "l", "identity_channel_hmm_1", None), ("x", "l", "a", None)], "s string, l string, b string, o string")
    kind = P.boundary_class(F.col("s"), F.col("l"), F.col("b"), F.col("o"))["boundary_class"]
    assert [r[0] for r in rows.select(kind).collect()] == ["own_compatible", "availability_extension", "own_compatible", "own_compatible", "own_compatible", "semantic_mismatch_router_boundary"]


def test_streaks_and_ablation_of_few_rows(spark):
    tests = spark.createDataFrame([(1, t, name, q) for t, (a, b) in enumerate([(1, 0), (1, 1), (0, -1), (1, 0)]) for name, q in (("stuck", a), ("jump", b))], "series_id int, t long, test string, qc int")
    got = {r.test: r for r in audits.test_summary(tests, {"stuck": "value"}).collect()}
    assert (got["stuck"].positive_runs, got["stuck"].max_positive_run_length, got["stuck"].fit) == (2, 2, "semantic candidate")
    assert (got["jump"].negative_flags, got["jump"].nonzero_flags, got["jump"].mapped_variable) == (1, 2, "")
    events = [tuple(r) for r in audits.streak_events(tests, "stuck", ["stuck", "jump"]).orderBy("t").collect()]
    assert events == [(1, 0, 0, 1, 2, "stuck"), (1, 1, 0, 1, 2, "stuck|jump"), (1, 3, 3, 3, 1, "stuck")]
    assert audits.test_summary(tests.where("false"), {}).count() == audits.streak_events(tests.where("false"), "stuck", ["stuck"]).count() == 0
    runs = [("c", m, part, 0.5, a) for m, v, t in (("x", 0.9, 0.3), ("y", 0.8, 0.7), ("z", None, 0.9)) for part, a in (("validation", v), ("test", t))]
    frame = spark.createDataFrame(runs, "case string, method string, part string, auroc double, auprc double")
    found = {r.left_out: (r.selected_method, round(r.regret, 9), r.methods) for r in B.ablation(frame, ["case"], F.when(F.col("method") == "x", "one").otherwise("other")).collect()}
    assert found == {"none": ("x", 0.6, 3), "one": ("y", 0.2, 2), "other": ("x", 0.6, 1)}


def test_spans_of_a_small_file_are_not_broadcast(spark, tmp_path):
    spark.range(4000).selectExpr("id % 50 as series", "id div 50 as begin", "id div 50 + 1 as end").write.parquet(f"{tmp_path}/spans")
    points = spark.range(4000).selectExpr("id % 50 as series", "id div 50 as t")
    found = intervals.covered(points, spark.read.parquet(f"{tmp_path}/spans"), ["series"])
    assert found.count() == 50 * (80 + 79)
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()
