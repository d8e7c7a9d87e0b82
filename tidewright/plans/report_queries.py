"""Named queries of reports, predicates and choices, over the devices' series and the runs of the methods on them."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewright import stage
from tidewright.operators import channel as C
from tidewright.operators import detectors as D
from tidewright.operators import evaluation as E
from tidewright.operators import faults, hmm, panels, scan
from tidewright.operators import relations as R
from tidewright.operators import selection as P
from tidewright.operators import series as S
from tidewright.operators import summaries as B
from tidewright.plans.series_queries import SEGMENT, SHARE, STUCK, Query, Series, rounded
from tidewright.sources import telemetry

#: Rows of a block (a month, a year) of the short series here, and of a calibration at least.
BLOCK, LEAST = 8, 3
#: Methods that work on reports; the others see raw values.
OWN = ("point_glr", "surprise")
TOLERANCE, TEMPLATE = 30.0, 2
#: Values of a subsequence.
SUBSEQUENCE = 32


def cases(s: Series) -> DataFrame:
    """Runs with the group of a series, its part, prevalence and the separation of its channel."""
    runs = s.runs().withColumns({"case": F.col("series_id") % 5, "part": F.when(F.col("series_id") % 2 == 0, "validation").otherwise("test"), "prevalence": F.col("positives") / (F.col("positives") + F.col("negatives"))})
    runs = runs.withColumns({"auroc": F.round("auroc", 6), "auprc": F.round("auprc", 6)})
    apart = C.separation(s.matrix, s.alpha).groupBy("series_id").agg(F.min("tv").alias("tv"), F.min("kl").alias("kl"))
    return runs.join(apart, "series_id")


def suites(s: Series) -> DataFrame:
    return B.suite(cases(s), ["case"], F.col("method").isin(*OWN), P.family(F.col("method")))


def surprising(s: Series) -> DataFrame:
    rows = D.surprise(s.private, s.p0)
    return rows.select("series_id", (F.col("series_id") % 5).alias("case"), "t", "label", F.round("score", 6).alias("score"))


def profiles(s: Series) -> DataFrame:
    runs = s.runs().groupBy("method").agg(F.count("*").alias("runs"))
    own = F.col("method").isin(*OWN)
    name, category = F.when(own, F.concat(F.lit("ldp_"), "method")).otherwise(F.col("method")), F.when(own, "channel_aware_baseline").otherwise("raw_domain_upper_bound")
    return runs.select("method", "runs", *[c.alias(k) for k, c in P.method_profile(name, category).items()], P.family(F.col("method")).alias("family"))


def mined(s: Series) -> DataFrame:
    rows = s.faulty.select("series_id", "t", F.round("vf", 9).alias("x"))
    return faults.templates(rows, "x", faults.tolerances(rows, "x"))


def template_series(s: Series) -> DataFrame:
    return faults.template_faults(s.clean, mined(s), SHARE, length=48)


def alignment(s: Series) -> DataFrame:
    """Values and labels, missing, infinite or no numbers on either side, by position of what is left."""
    left = s.raw.select("series_id", "t", F.when(F.col("id") % 14 == 0, float("nan")).when(F.col("id") % 7 != 0, F.col("x")).alias("x"))
    right = s.faulty.select("series_id", "t", F.when(F.col("id") % 10 == 0, float("inf")).when(F.col("id") % 5 != 0, F.col("label").cast("double")).alias("y"))
    return P.aligned(left, right).groupBy("series_id").agg(F.count("*").alias("n"), F.avg("x").alias("mean"), F.sum("y").cast("long").alias("positives"))


def products(s: Series) -> DataFrame:
    """A preliminary product beside a verified one that lacks rows: matched by time, left."""
    verified = s.raw.where("id % 3 <> 0").select("series_id", "t", F.col("x").alias("verified"))
    both = s.raw.select("series_id", "t", "x").join(verified, ["series_id", "t"], "left")
    return both.groupBy("series_id").agg(F.count("*").alias("n"), F.count("verified").alias("available"), F.avg(F.abs(F.col("x") - F.col("verified"))).alias("difference"))


def quality_flags(s: Series) -> DataFrame:
    """Rows that are good, flagged as stuck or missing, and the mean of what can be used: the flagged value if it is
    there, else the stored one."""
    flag = F.when(F.col("id") % 11 == 0, 8).when(F.col("label") == 1, 5).otherwise(1)
    rows = s.faulty.withColumn("flag", flag).withColumn("flagged", F.when(F.col("flag") != 8, F.when(F.col("flag") == 5, F.col("vf")).otherwise(F.col("v"))))
    counts = [F.count_if(F.col("flag") == k).alias(name) for k, name in ((1, "good"), (5, "stuck"), (8, "missing"))]
    return rows.groupBy("series_id").agg(*counts, F.avg(F.coalesce("flagged", "v")).alias("usable_mean"), F.avg(F.when(F.col("flag") == 1, F.col("v"))).alias("good_mean"))


def comments(s: Series) -> DataFrame:
    docs = telemetry.table(s.spark, s.sf_dir, "documents")
    return docs.groupBy("lang", P.relevance(F.col("text")).alias("relevance")).agg(F.count("*").alias("n"))


def ordered_parts(s: Series) -> DataFrame:
    """Parts in their own order, not by name."""
    place = F.when(F.col("part") == "train", 0).when(F.col("part") == "validation", 1).otherwise(2)
    return s.clean.groupBy("part").agg(F.count("*").alias("n"), F.avg("v").alias("mean")).withColumn("place", place).orderBy("place")


def policies(s: Series) -> DataFrame:
    """The router's policy with the reports that each of its operators cleaned."""
    cleaned = R.cleaning(s.reports).groupBy("operator").agg(F.count("*").alias("cleaned"), F.avg("posterior").alias("posterior"))
    return telemetry.router_policy(s.spark, workflow=True).join(cleaned, "operator", "left").withColumn("cleaned", F.coalesce("cleaned", F.lit(0)))


#: Panel: epsilons, seeds, faults and the rows of a segment. Sweeps: lengths and shares, each with three seeds. A series has
#: one key for each setting.
EPSILONS, SEEDS, MODES, LENGTH, SETTINGS = (2.0, 4.0), (0, 1, 2), ("iid_stuck", "segment_stuck", "template_stuck", "bias"), 48, panels.SETTINGS
AXES = {"segment_length": (12, 24, 48, 96), "fault_rate": (0.05, 0.10, 0.20, 0.30)}
SWEEP = tuple((axis, float(v), seed, v if axis == "fault_rate" else SHARE, v if axis == "segment_length" else LENGTH) for axis, values in AXES.items() for v in values for seed in SEEDS)


def spread(s: Series, settings: list[tuple]) -> DataFrame:
    """The clean series once for each setting, under a key of its own; settings: structs of named literals."""
    grid = F.array(*[F.struct(*[F.lit(v).alias(k) for k, v in x]) for x in settings])
    rows = s.clean.select("*", F.posexplode(grid).alias("setting", "x_"))
    own = [F.col(f"x_.{k}").alias(k) for k, _ in settings[0]]
    return rows.select((F.col("series_id").cast("long") * SETTINGS + F.col("setting")).alias("series_id"), "t", (F.col("id") + F.col("x_.seed") * 1_000_003).alias("id"), "x", "part", "v", "setting", *own)


def of_setting(values: list) -> Column:
    """The value of a series' setting, by its key."""
    return F.element_at(F.array(*map(F.lit, values)), (F.col("series_id") % SETTINGS + 1).cast("int"))


def private_runs(s: Series, faulty: DataFrame, epsilon: float, methods: tuple[str, ...], rate: Column, length: Column) -> DataFrame:
    """series_id, method, auroc, auprc of methods on raw values and on reports at one epsilon; rate and length: what the
    posterior model expects of a series."""
    private = stage.table(faulty.select("series_id", "t", "part", "v", "label", "vf", C.discretize(C.piecewise(F.col("vf"), epsilon), epsilon).alias("obs")), "panel")
    matrix = C.piecewise_matrix(s.spark, epsilon)
    p0 = stage.table(C.normal(matrix, C.alpha(private.where("part = 'train'"))), "normal-reports")
    ratios = D.ratio_lists(matrix, p0)
    p11 = F.greatest(F.lit(0.5), 1 - 1 / F.greatest(length.cast("double"), F.lit(2.0)))
    p01 = F.least(F.lit(0.2), F.greatest(F.lit(1e-4), rate * (1 - p11) / F.greatest(1 - rate, F.lit(1e-6))))
    chain = scan.Chain(np.maximum(hmm.table(matrix), hmm.FLOOR), p01, p11, rate)
    found = {
        "robust_z": lambda: D.robust_z(private, "vf"),
        "surprise": lambda: D.surprise(private, p0),
        "point_glr": lambda: D.point_glr(private, ratios),
        "window_glr": lambda: D.window_glr(private, ratios),
        "mixture": lambda: D.mixture_posterior(private, matrix, p0, stage.table(D.mixture(private, matrix, p0), "fit")),
        "hmm": lambda: scan.posteriors(private, scan.normals(p0, C.D), chain, rate=False).join(private.select("series_id", "t", "label"), ["series_id", "t"]),
    }
    parts = [found[name]().select("series_id", "t", "label", F.round("score", 6).alias("score"), F.lit(name).alias("method")) for name in methods]
    return E.ranking(reduce(DataFrame.union, parts), ["series_id", "method"], many=True)


#: The panel's settings by their numbers, and its methods.
PANEL = tuple((seed, mode) for seed in SEEDS for mode in MODES)
METHODS = ("robust_z", "surprise", "point_glr", "window_glr", "mixture", "hmm")


def panel(s: Series) -> DataFrame:
    """A run for each series, epsilon, seed, fault and method."""
    short, long = s.by_length()
    settings = tuple(panels.Setting(k, seed, mode, SHARE, LENGTH, STUCK, rate=SHARE, lasts=LENGTH) for k, (seed, mode) in enumerate(PANEL))
    channels = [panels.Channel(e, hmm.table(C.piecewise_matrix(s.spark, e)), settings) for e in EPSILONS]
    notes = mined(short).select("series_id", F.col("rank").alias("number"), "n", F.col("level").alias("value"))
    runs = panels.areas_of(short.clean, channels, METHODS, notes)
    seed, mode = (panels.of_number([x[i] for x in PANEL], "setting") for i in (0, 1))
    runs = runs.select("series_id", panels.of_number(list(EPSILONS), "channel").alias("epsilon"), seed.alias("seed"), mode.alias("mode"), "method", "auroc", "auprc")
    return runs if long is None else runs.unionByName(long_panel(long))


def long_panel(s: Series) -> DataFrame:
    """The panel of series of any length, by windows and scans."""
    settings = [(("seed", seed), ("mode", mode)) for seed, mode in PANEL]
    rows = stage.table(spread(s, settings), "panel-series")
    of = {mode: rows.where(F.col("mode") == mode) for mode in MODES}
    keyed = mined(s).withColumn("_k", F.explode(F.array(*[F.lit(k) for k, x in enumerate(settings) if x[1][1] == "template_stuck"])))
    keyed = keyed.withColumn("series_id", F.col("series_id").cast("long") * SETTINGS + F.col("_k")).drop("_k")
    parts = [faults.inject(faults.iid_mask(of["iid_stuck"], SHARE), "iid_stuck", stuck=STUCK), faults.template_faults(of["template_stuck"], keyed, SHARE, length=LENGTH)]
    parts += [faults.inject(faults.segment_mask(of[mode], SHARE, LENGTH), mode, stuck=STUCK) for mode in ("segment_stuck", "bias")]
    faulty = stage.table(reduce(DataFrame.unionByName, [x.select("series_id", "t", "id", "part", "v", "label", "vf") for x in parts]), "faulty")
    runs = reduce(DataFrame.unionByName, (private_runs(s, faulty, e, METHODS, F.lit(SHARE), F.lit(LENGTH)).withColumn("epsilon", F.lit(e)) for e in EPSILONS))
    seed, mode = of_setting([x[0][1] for x in settings]), of_setting([x[1][1] for x in settings])
    return runs.select(F.floor(F.col("series_id") / SETTINGS).alias("series_id"), "epsilon", seed.alias("seed"), mode.alias("mode"), "method", "auroc", "auprc")


SWEPT = ("window_glr", "hmm", "surprise")


def sweep(s: Series) -> DataFrame:
    """Mean scores along each axis, by seed."""
    short, long = s.by_length()
    settings = tuple(panels.Setting(k, seed, share=share, length=length, stuck=STUCK, rate=share, lasts=length) for k, (_, _, seed, share, length) in enumerate(SWEEP))
    runs = panels.areas_of(short.clean, [panels.Channel(EPSILONS[0], hmm.table(C.piecewise_matrix(s.spark, EPSILONS[0])), settings)], SWEPT)
    runs = runs.select((F.col("series_id") * SETTINGS + F.col("setting")).alias("series_id"), "method", "auroc", "auprc")
    if long is not None:
        runs = runs.unionByName(long_sweep(long).select("series_id", "method", "auroc", "auprc"))
    names = [of_setting([x[i] for x in SWEEP]).alias(name) for i, name in enumerate(("axis", "axis_value", "seed"))]
    return runs.groupBy(*names, "method").agg(F.count("auprc").alias("runs"), F.avg("auroc").alias("auroc"), F.avg("auprc").alias("auprc"))


def long_sweep(s: Series) -> DataFrame:
    """The sweep's runs, by key and method, of series of any length."""
    settings = [(("seed", seed), ("share", share), ("length", length)) for _, _, seed, share, length in SWEEP]
    faulty = faults.inject(faults.segment_mask(spread(s, settings), F.col("share"), F.col("length")), "segment_stuck", stuck=STUCK)
    return private_runs(s, faulty, EPSILONS[0], SWEPT, of_setting([x[3] for x in SWEEP]), of_setting([x[4] for x in SWEEP]))


def layers(s: Series) -> DataFrame:
    """The panel by fault: the best method of all and of the own ones at each epsilon, and the router's choice."""
    runs = panel(s).withColumns({"auroc": F.round("auroc", 6), "auprc": F.round("auprc", 6)})
    found = B.suite(runs, ["mode", "epsilon"], F.col("method").isin(*OWN), P.family(F.col("method")))
    return found.withColumn("router_choice", F.when(F.col("own_auprc") >= F.col("best_auprc") - 0.02, F.col("own_method")).otherwise(F.col("recommended_method")))


REPORTS: dict[str, Callable[[Series], DataFrame]] = {
    "a17_mode": lambda s: B.mode(s.private, ["series_id"], "obs"),
    "a23_case_means": lambda s: rounded(B.case_means(cases(s), ["method"], "case", "auprc", "positives"), 9),
    "a27_pooled": lambda s: rounded(B.pooled(surprising(s), ["case"])),
    "a30_accounting": lambda s: rounded(B.accounting(cases(s)), 9),
    "b3_suite": lambda s: rounded(suites(s), 9),
    "b5_router_policy": lambda s: rounded(policies(s)),
    "b6_boundary": lambda s: rounded(B.boundary(suites(s), ["case"]), 9),
    "b7_router_ledger": lambda s: rounded(B.router_ledger(cases(s), ["case"]), 9),
    "b4_layers": lambda s: rounded(layers(s), 9),
    "b12_sweep": lambda s: rounded(sweep(s)),
    "b16_panel": lambda s: rounded(panel(s)),
    "d26_subsequences": lambda s: rounded(D.subsequence_neighbours(s.raw, "x", SUBSEQUENCE)),
    "f4_templates": lambda s: rounded(mined(s)),
    "f4_template_faults": lambda s: rounded(template_series(s).select("series_id", "t", "label", "vf")),
    "j15_products": lambda s: rounded(products(s)),
    "j17_prior_rows": lambda s: rounded(P.prior_rows(s.faulty, "v", BLOCK, 12)),
    "j19_runs_with_shape": lambda s: rounded(s.runs().select("series_id", "method", F.round("auprc", 6).alias("auprc")).join(S.flatlines(s.raw, "x", TOLERANCE, TEMPLATE).groupBy("series_id").agg(F.count("*").alias("flatlines")), "series_id", "left")),
    "j21_matched_negatives": lambda s: P.matched_negatives(s.faulty, S.runs(s.faulty, F.col("label") == 1), "v", 2 / C.D),
    "m12_estimated_alpha": lambda s: rounded(C.estimated_alpha(s.private, hmm.table(s.matrix))),
    "m16_distances": lambda s: rounded(C.distances(s.matrix, s.alpha)),
    "m16_channel_quality": lambda s: rounded(C.channel_quality(s.matrix, s.alpha, round(float(np.linalg.cond(hmm.table(s.matrix))), 6))),
    "m17_stuck_values": lambda s: rounded(C.stuck_values(s.clean, s.matrix, s.alpha)),
    "m18_device_grid": lambda s: rounded(C.device_grid(s.reports)),
    "o4_top_blocks": lambda s: P.top_blocks(s.faulty, BLOCK, 2),
    "o5_top_and_forced": lambda s: P.top_and_forced(s.faulty.groupBy("series_id").agg(F.sum("label").alias("positives")), "series_id", "positives", 3, [1, 2]),
    "o6_ordered_parts": lambda s: rounded(ordered_parts(s)),
    "p14_quality_flags": lambda s: rounded(quality_flags(s)),
    "p16_relevance": comments,
    "p17_method_profile": profiles,
    "p18_eligible": lambda s: rounded(P.eligible(s.faulty, ["series_id"], 5, 20, 0.2)),
    "p19_calibration_source": lambda s: rounded(P.calibration_source(s.faulty, "v", BLOCK, LEAST)),
    "p20_alignment": lambda s: rounded(alignment(s)),
    "p21_block_choice": lambda s: P.block_choice(s.faulty, BLOCK, 1, 20),
    "u4_set_checks": lambda s: P.set_checks(R.cleaning(s.reports).where("action = 'repair'"), s.reports.where("report_id % 2 = 0"), "report_id"),
}

QUERIES: dict[str, Query] = {key: (lambda spark, d, build=build: build(Series(spark, d))) for key, build in REPORTS.items()}
