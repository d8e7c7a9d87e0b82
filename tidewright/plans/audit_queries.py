"""Named queries of simulations, audits of flags, layers and long series, over the devices' series."""

from __future__ import annotations

from collections.abc import Callable
from uuid import uuid4

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewright import stage
from tidewright.operators import audits, faults, hmm, panels, scan, simulation
from tidewright.operators import channel as C
from tidewright.operators import evaluation as E
from tidewright.operators import selection as P
from tidewright.operators import series as S
from tidewright.operators import summaries as B
from tidewright.plans.report_queries import LENGTH, OWN, SEEDS, SETTINGS, cases, of_setting, private_runs, spread, surprising
from tidewright.plans.series_queries import SHARE, STUCK, Query, Series, rounded
from tidewright.sources.versioned import KeyedTable

#: Groups of devices that stand for streams, and the epsilons of their channels.
STREAMS, STREAM_EPSILONS = 5, (2.0, 4.0)
LENGTHS, WINDOWS = (8, 16, 32, 64), 1000


def advantage(s: Series) -> DataFrame:
    stream = s.clean.where("part = 'train'").withColumn("series_id", F.col("series_id") % STREAMS)
    return simulation.channel_advantage(C.alpha(stream), {e: C.piecewise_matrix(s.spark, e) for e in STREAM_EPSILONS}, LENGTHS, WINDOWS)


#: A station's variables, and texts of manual flags, by the number of a flag.
VARIABLES = ("t_u t_l", "p_u", "rh_u wspd_u", "gps_lat", "t_i_1 t_i_2 wdir_l", "", "wspd_l")
COMMENTS = ("constant since May", "sensor drift", "Too much zero", "checked on site", "disfunctional", None, "give 0degC")
#: Rows of a block (a year), of an episode at least, and blocks that are chosen.
BLOCK, EPISODE, CHOSEN = 16, 3, 2
TESTS = ("stuck", "range", "jump")
#: Sources and layers of evidence, by case.
SOURCES = ("HadISD stations", "CO-OPS water level", "IORS dropout", "IORS field QC", "native windows")
LAYERS = ("real_station_straight_string", "official_flat_tolerance_labels", "explicit_availability_dropout", "field_qc_stuck_labels", "native_flatline_windows", "prepared_multivariate_stuck_labels", "iid_stuck")
ROUTER = 'layer string, source string, router_operator string, operator_family string, best_auprc double, own_operator string, own_auprc double'


def of(values: tuple, number: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (number % len(values) + 1).cast("int"))


def manual_flags(s: Series) -> DataFrame:
    """Flags as a station's keeper would set them: around each run of faults, and over the whole of every fifth series."""
    runs = S.runs(s.faulty, F.col("label") == 1).select("series_id", (F.col("begin") - 2).alias("begin"), (F.col("end") + 2).alias("end"), (F.col("series_id").cast("long") * 1000 + F.col("begin")).alias("flag_id"))
    whole = s.faulty.where("series_id % 5 = 0").groupBy("series_id").agg(F.lit(0).cast("long").alias("begin"), F.max("t").alias("end"), F.max(F.col("series_id").cast("long") * 1000 + 999).alias("flag_id"))
    flags = runs.unionByName(whole)
    return flags.withColumns({"variable": of(VARIABLES, F.col("flag_id")), "comment": of(COMMENTS, F.floor(F.col("flag_id") / 7)), "flag": F.lit("CHECKME"), "commented_out": F.col("flag_id") % 11 == 0})


def flagged(s: Series) -> DataFrame:
    flags = stage.table(audits.flag_inventory(manual_flags(s)), "flags")
    rows = audits.flagged_rows(s.faulty, flags, F.col("label") == 1)
    return rows.select("flag_id", "series_id", "begin", "end", "duration", "scalar_variable_count", "variable_families", "relevance", "usable", "rows", "hits")


def streak_audit(s: Series) -> DataFrame:
    private = stage.table(s.private.select("series_id", "t", "obs", "label"), "reports")
    return audits.streaks_against_flags(private, S.runs(private, F.col("obs") >= 16), stage.table(audits.flag_inventory(manual_flags(s)), "flags"), "relevance")


def tests(s: Series) -> DataFrame:
    """series_id, t, test, qc: stuck values, values out of range on either side, jumps up and down."""
    jump = F.col("obs") - F.lag("obs").over(S.along())
    sign = lambda x, most: F.when(x > most, 1).when(x < -most, -1).otherwise(0)
    each = {"stuck": F.col("label"), "range": sign(F.col("v"), 0.8), "jump": sign(F.coalesce(jump, F.lit(0)), 12)}
    rows = s.private.select("series_id", "t", F.array(*[F.struct(F.lit(k).alias("test"), each[k].cast("int").alias("qc")) for k in TESTS]).alias("_q"))
    return stage.table(rows.select("series_id", "t", F.explode("_q").alias("_q")).select("series_id", "t", "_q.test", "_q.qc"), "tests")


def evidence(s: Series) -> DataFrame:
    """The best and the best own method of each case, with where it comes from."""
    found = B.suite(cases(s), ["case"], F.col("method").isin(*OWN), P.family(F.col("method")))
    return found.withColumns({"source": of(SOURCES, F.col("case")), "layer": of(LAYERS, F.col("case"))})


def boundaries(s: Series) -> DataFrame:
    found = evidence(s)
    kinds = P.boundary_class(F.col("source"), F.col("layer"), F.col("recommended_method"), F.col("own_method"))
    return found.select("case", "source", "layer", *[c.alias(k) for k, c in kinds.items()], F.round("gain", 9).alias("gain"))


def router_rows(runs: DataFrame, name: Column) -> DataFrame:
    found = B.suite(runs, ["case"], F.col("method").isin(*OWN), P.family(F.col("method")))
    names = {"layer": name, "source": of(SOURCES, F.col("case"))}
    return found.select(*[c.alias(k) for k, c in names.items()], F.col("recommended_method").alias("router_operator"), F.col("recommended_family").alias("operator_family"), F.round("best_auprc", 9).alias("best_auprc"), F.col("own_method").alias("own_operator"), F.round("own_auprc", 9).alias("own_auprc"))


def layered(s: Series) -> KeyedTable:
    """The router's table: all cases, then two measured again on the test part and one over all rows; the second batch twice."""
    runs = stage.table(cases(s), "cases")
    table = KeyedTable(s.spark, f"{stage.folder(s.spark).rstrip('/')}/router-{uuid4().hex}", ROUTER, ["layer"], 4)
    layer = of(LAYERS, F.col("case"))
    table.upsert(router_rows(runs, layer), 0)
    again = router_rows(runs.where("part = 'test' and case in (1, 3)"), layer).unionByName(router_rows(runs.withColumn("case", F.lit(4)), F.lit("all layers")))
    for _ in range(2):
        table.upsert(again, 1)
    return table


def rollup(rows: DataFrame) -> DataFrame:
    return rows.groupBy("operator_family").agg(F.count("*").alias("tasks"), F.round(F.avg("best_auprc"), 6).alias("mean_best_auprc"))


def review(s: Series) -> DataFrame:
    """What reviewing the rows of least likely reports costs and finds."""
    rows = stage.table(surprising(s), "scores")
    pooled = rounded(B.pooled(rows, ["case"]), 9)
    rate = E.recall_at_fpr(rows, ["case"]).withColumnRenamed("recall", "recall_fpr")
    return B.operational(pooled.join(rate, "case"))


def triggers(s: Series) -> DataFrame:
    """Faulty rows by what their layer's labels mean."""
    rows = s.faulty.withColumn("layer", of(LAYERS, F.col("series_id")))
    return rows.groupBy("layer", P.layer_trigger(F.col("layer")).alias("semantic_trigger")).agg(F.count("*").alias("rows"), F.sum("label").alias("faults"))


#: What the posterior model is put under: calibrations mixed with the stuck bucket, channels of other sizes, and a channel
#: of another epsilon than the reports'; fleets of so many devices.
STRESS = {"calibration_contamination": (0.0, 0.02, 0.05, 0.10, 0.20, 0.35), "bucket_count": (8, 16, 32, 64), "epsilon_mismatch": (0.75, 1.0, 1.5, 2.0, 3.0, 4.0)}
FLEETS, TRUE_EPSILON = (4, 16, 32), 2.0
CHANNELS = ((TRUE_EPSILON, 32), (TRUE_EPSILON, 8), (TRUE_EPSILON, 16), (TRUE_EPSILON, 64), *((e, 32) for e in STRESS["epsilon_mismatch"] if e != TRUE_EPSILON))
#: panel, x, seed, share of the stuck bucket in the calibration, channel of each setting.
STRESSED = tuple((panel, float(x), seed, x if panel == "calibration_contamination" else 0.0, CHANNELS.index((x, 32) if panel == "epsilon_mismatch" else (TRUE_EPSILON, x) if panel == "bucket_count" else (TRUE_EPSILON, 32))) for panel, values in STRESS.items() for x in values for seed in SEEDS)


def long_stressed(s: Series) -> DataFrame:
    """series_id (keyed), t, label, score, candidate, d and bucket (the true one): all settings in one scan, whatever a series' length."""
    largest = max(d for _, d in CHANNELS)
    pick = lambda i: of_setting([x[i] for x in STRESSED])
    size = of_setting([CHANNELS[x[4]][1] for x in STRESSED])
    inside = lambda x: F.greatest(F.lit(0), F.least(F.col("d") - 1, F.floor(x))).cast("int")
    rows = spread(s, [(("seed", x[2]),) for x in STRESSED]).withColumn("d", size)
    rows = faults.inject(faults.segment_mask(rows, SHARE, LENGTH), "segment_stuck", stuck=STUCK)
    _, c = C.shape(TRUE_EPSILON)
    rows = stage.table(rows.withColumn("obs", inside((C.piecewise(F.col("vf"), TRUE_EPSILON) + F.lit(c)) / (F.lit(2 * c) / F.col("d")))).select("series_id", "t", "part", "v", "label", "d", "obs"), "stressed")
    bucket = inside(F.lit(STUCK + 1.0) * (F.col("d") / F.lit(2.0)))
    counted = rows.where("part = 'train'").groupBy("series_id", "d", inside((F.col("v") + F.lit(1.0)) * (F.col("d") / F.lit(2.0))).alias("stuck_bucket")).agg(F.count("*").alias("n"))
    every = counted.groupBy("series_id", "d").agg(F.sum("n").alias("total")).withColumn("stuck_bucket", F.explode(F.sequence(F.lit(0), F.col("d") - 1)))
    share = (F.coalesce("n", F.lit(0)) + F.lit(1e-3)) / (F.col("total") + F.col("d") * F.lit(1e-3))
    alpha = every.join(counted, ["series_id", "d", "stuck_bucket"], "left").withColumn("alpha", share * (1 - pick(3)) + F.when(F.col("stuck_bucket") == bucket, pick(3)).otherwise(F.lit(0.0))).withColumn("channel", pick(4))
    tables, matrix = np.zeros((len(CHANNELS), largest, largest)), None
    for k, (e, d) in enumerate(CHANNELS):
        own = C.piecewise_matrix(s.spark, e, d, d)
        tables[k, :d, :d] = np.maximum(hmm.table(own, d), hmm.FLOOR)
        own = own.withColumn("channel", F.lit(k))
        matrix = own if matrix is None else matrix.unionByName(own)
    p0 = alpha.join(F.broadcast(matrix), ["channel", "stuck_bucket"]).groupBy("series_id", "report_bucket").agg(F.sum(F.col("p") * F.col("alpha")).alias("p0"))
    p01, p11 = hmm.transition(SHARE, float(LENGTH))
    found = scan.posteriors(rows, scan.normals(p0, largest), scan.Chain(tables, p01, p11, SHARE, pick(4)), rate=False)
    return stage.table(found.join(rows.select("series_id", "t", "label", "d"), ["series_id", "t"]).withColumn("bucket", bucket), "stressed-scores")


def stress(s: Series) -> DataFrame:
    """Means over devices of each setting's areas and of how often the true bucket is found; fleets of devices are scored
    as one, on what isn't contaminated."""
    short, long = s.by_length()
    settings = [panels.Setting(k, x[2], share=SHARE, length=LENGTH, stuck=STUCK, rate=SHARE, lasts=LENGTH, mixed=x[3]) for k, x in enumerate(STRESSED)]
    tables = [hmm.table(C.piecewise_matrix(s.spark, e, d, d), d) for e, d in CHANNELS]
    channels = [panels.Channel(TRUE_EPSILON, table, tuple(y for y, x in zip(settings, STRESSED, strict=True) if x[4] == i)) for i, table in enumerate(tables)]
    pure = [k for k, x in enumerate(STRESSED) if x[:2] == ("calibration_contamination", 0.0)]
    bucket = of_setting([int((STUCK + 1.0) * (CHANNELS[x[4]][1] / 2.0)) for x in STRESSED])
    keyed = (F.col("series_id") * SETTINGS + F.col("setting")).alias("series_id")
    runs = panels.areas_of(short.clean, channels, ("hmm",)).select(keyed, "auroc", "auprc", "candidate").withColumn("hit", (F.col("candidate") == bucket).cast("double")).drop("candidate")
    plain = panels.scores_of(short.clean, [panels.Channel(TRUE_EPSILON, tables[0], tuple(settings[k] for k in pure))], "hmm").select(keyed, "label", "score")
    if long is not None:
        rows = long_stressed(long).withColumn("score", F.round("score", 6))
        hits = rows.groupBy("series_id").agg(F.max((F.col("candidate") == F.col("bucket")).cast("double")).alias("hit"))
        runs = runs.unionByName(E.ranking(rows, ["series_id"], many=True).join(hits, "series_id").select("series_id", "auroc", "auprc", "hit"))
        plain = plain.unionByName(rows.where((F.col("series_id") % SETTINGS).isin(pure)).select("series_id", "label", "score"))
    pick = lambda i, name: of_setting([x[i] for x in STRESSED]).alias(name)
    means = [F.count("auprc").alias("runs"), F.avg("auroc").alias("auroc"), F.avg("auprc").alias("auprc")]
    single = runs.groupBy(pick(0, "panel"), pick(1, "x"), pick(2, "seed")).agg(*means, F.avg("hit").alias("bucket_hit"))
    plain = plain.withColumn("x", F.explode(F.array(*map(F.lit, FLEETS)))).withColumn("fleet", F.floor(F.floor(F.col("series_id") / SETTINGS) / F.col("x"))).withColumn("seed", pick(2, "seed"))
    fleets = E.ranking(plain, ["x", "seed", "fleet"]).groupBy(F.lit("multi_device_short_traces").alias("panel"), F.col("x").cast("double").alias("x"), "seed").agg(*means, F.lit(None).cast("double").alias("bucket_hit"))
    return single.unionByName(fleets)


#: Kinds of stuck values, in the order of reports: the tails of the training part, then what is hardest to see.
KINDS = ("tail_q05", "tail_q95", "median", "mode_bucket", "min_tv_column")
GATED = ("hmm", "window_glr", "surprise")


def stuck_kinds(s: Series) -> DataFrame:
    """series_id, kind, value of each series; where both tails are one value, it is the lower one."""
    tails = s.clean.where("part = 'train'").groupBy("series_id").agg(F.percentile("v", F.lit(0.05)).alias("low"), F.percentile("v", F.lit(0.95)).alias("high"))
    pair = F.array(F.struct(F.lit(KINDS[0]).alias("kind"), F.col("low").alias("value")), F.struct(F.when(F.col("high") > F.col("low"), KINDS[1]).otherwise(KINDS[0]).alias("kind"), F.col("high").alias("value")))
    tails = tails.select("series_id", F.explode(F.array_distinct(pair)).alias("x")).select("series_id", "x.kind", "x.value")
    return tails.unionByName(C.stuck_values(s.clean, s.matrix, s.alpha).select("series_id", "kind", "value")).withColumn("value", F.round("value", 6))


#: The gate's settings by their numbers.
GATES = tuple((kind, seed) for kind in KINDS for seed in SEEDS)


def gate_runs(s: Series, methods: tuple[str, ...] = GATED) -> DataFrame:
    """Runs that a gate of separation judges: stuck segments at values of each kind, with the channel's separation there."""
    short, long = s.by_length()
    settings = tuple(panels.Setting(k, seed, share=SHARE, length=LENGTH, note=KINDS.index(kind), rate=SHARE, lasts=LENGTH) for k, (kind, seed) in enumerate(GATES))
    channels = [panels.Channel(e, hmm.table(C.piecewise_matrix(s.spark, e)), settings) for e in STREAM_EPSILONS]
    place = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind")) - 1
    notes = stuck_kinds(short).select("series_id", place.alias("number"), F.lit(0).alias("n"), "value")
    runs = panels.areas_of(short.clean, channels, methods, notes)
    kind, seed = (panels.of_number([x[i] for x in GATES], "setting") for i in (0, 1))
    out = runs.select("series_id", panels.of_number(list(STREAM_EPSILONS), "channel").alias("epsilon"), kind.alias("stuck_value_type"), seed.alias("seed"), "method", "auprc", (F.col("positives") / (F.col("positives") + F.col("negatives"))).alias("prevalence"), F.col("tv").alias("tv_sep"), F.col("kl").alias("kl_sep"))
    if long is not None:
        out = out.unionByName(long_gate_runs(long, methods))
    layer = F.when(F.col("stuck_value_type").startswith("tail"), "controlled_tail_segment").otherwise("controlled_central_segment")
    return out.withColumn("semantic_layer", layer)


def long_gate_runs(s: Series, methods: tuple[str, ...]) -> DataFrame:
    """The gate's runs of series of any length."""
    settings = [(("seed", seed), ("kind", kind)) for kind, seed in GATES]
    values = stage.table(stuck_kinds(s), "stuck-values")
    rows = spread(s, settings).withColumn("_own", F.floor(F.col("series_id") / SETTINGS)).join(values.select(F.col("series_id").alias("_own"), "kind", "value"), ["_own", "kind"])
    labelled = faults.segment_mask(rows, SHARE, LENGTH)
    faulty = stage.table(labelled.select("series_id", "t", "id", "part", "v", "label", F.when(F.col("label") == 1, F.col("value")).otherwise(F.col("v")).alias("vf")), "faulty")
    out = None
    for e in STREAM_EPSILONS:
        runs = private_runs(s, faulty, e, methods, F.lit(SHARE), F.lit(LENGTH))
        runs = runs.select(F.floor(F.col("series_id") / SETTINGS).alias("series_id"), F.lit(e).alias("epsilon"), of_setting([x[1][1] for x in settings]).alias("stuck_value_type"), of_setting([x[0][1] for x in settings]).alias("seed"), "method", F.col("auprc"), (F.col("positives") / (F.col("positives") + F.col("negatives"))).alias("prevalence"))
        apart = C.separation(C.piecewise_matrix(s.spark, e), s.alpha)
        lookup = values.withColumn("stuck_bucket", C.bucket(F.col("value"))).join(apart, ["series_id", "stuck_bucket"]).select("series_id", F.col("kind").alias("stuck_value_type"), F.col("tv").alias("tv_sep"), F.col("kl").alias("kl_sep"))
        runs = runs.join(lookup, ["series_id", "stuck_value_type"])
        out = runs if out is None else out.unionByName(runs)
    return out


def failures(runs: DataFrame) -> DataFrame:
    """What the posterior model loses where the channel tells little: means by kind of stuck value and epsilon, in order."""
    means = [F.avg(c).alias(c) for c in ("tv_sep", "kl_sep", "auprc", "prevalence")]
    place = F.array_position(F.array(*map(F.lit, KINDS)), F.col("stuck_value_type"))
    return runs.where("method = 'hmm'").groupBy("stuck_value_type", "epsilon").agg(F.count("auprc").alias("cases"), *means).orderBy(place, "epsilon")


#: Rows of a test part, of a series at least, and of a wide window.
TEST, ENOUGH, WIDE = 150, 120, 257


def long_series(s: Series) -> DataFrame:
    """Groups of devices as long series, in the order of their reports."""
    t = F.row_number().over(Window.partitionBy("series_id").orderBy("id")) - 1
    return s.raw.select((F.col("series_id") % STREAMS).alias("series_id"), "id", "x").withColumn("t", t)


def wide_medians(s: Series) -> DataFrame:
    """Medians of wide windows over long series in which values are missing."""
    return S.wide_median(long_series(s).withColumn("x", F.when(F.col("id") % 14 != 0, F.col("x"))), "x", WIDE)


def buckets(s: Series) -> DataFrame:
    """A report's bin by both conventions, on its value and on the value's own edge, and the raw value's in its series' range."""
    _, c = C.shape(TRUE_EPSILON)
    edge = F.lit(-c) + F.col("obs") * F.lit(2 * c / C.D)
    whole = Window.partitionBy("series_id")
    rows = s.private.withColumns({"_low": F.min("x").over(whole), "_high": F.max("x").over(whole)})
    right = {"right": C.discretize_right(F.col("y"), TRUE_EPSILON), "edge": C.discretize_right(edge - F.lit(1e-9), TRUE_EPSILON)}
    return rows.select("series_id", "t", "obs", *[x.alias(k) for k, x in right.items()], C.discretize_range(F.col("x"), F.col("_low"), F.col("_high"), 24).alias("raw"))


AUDITS: dict[str, Callable[[Series], DataFrame]] = {
    "m1_chronological": lambda s: rounded(S.chronological(long_series(s), test_len=TEST, least=ENOUGH)),
    "w5_wide_medians": lambda s: rounded(wide_medians(s)),
    "m7_discretize": buckets,
    "b2_failures": lambda s: rounded(failures(rounded(gate_runs(s, ("hmm",)), 9))),
    "b17_gate_runs": lambda s: rounded(gate_runs(s), 9),
    "b12_stress": lambda s: rounded(stress(s)),
    "d27_channel_advantage": lambda s: rounded(advantage(s), 9),
    "d27_by_epsilon": lambda s: rounded(simulation.by_epsilon(rounded(advantage(s), 9))),
    "j14_flagged_rows": flagged,
    "b6_boundary_classes": boundaries,
    "b7_ablation": lambda s: rounded(B.ablation(cases(s), ["case"], P.family(F.col("method"))), 9),
    "b7_operational": lambda s: rounded(review(s)),
    "b10_router_rows": lambda s: layered(s).read(),
    "b10_rollup": lambda s: rollup(layered(s).read()),
    "b14_streaks_against_flags": streak_audit,
    "b14_inventory": lambda s: audits.block_inventory(s.faulty, BLOCK, EPISODE, CHOSEN),
    "b14_test_summary": lambda s: audits.test_summary(tests(s), {"stuck": "value"}),
    "b14_streak_events": lambda s: audits.streak_events(tests(s), "stuck", list(TESTS)),
    "p17_layer_triggers": triggers,
}

QUERIES: dict[str, Query] = {key: (lambda spark, d, build=build: build(Series(spark, d))) for key, build in AUDITS.items()}
