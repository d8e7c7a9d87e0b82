"""Named queries over series: mechanisms, faults, detectors, repair, metrics and reports, on the devices' events."""

from __future__ import annotations

from collections.abc import Callable
from copy import copy

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewright import stage
from tidewright.operators import channel as C
from tidewright.operators import detectors as D
from tidewright.operators import evaluation as E
from tidewright.operators import faults, hmm, panels, scan
from tidewright.operators import relations as R
from tidewright.operators import series as S
from tidewright.operators import summaries as B
from tidewright.sources import telemetry
from tidewright.streaming import shortlist

Query = Callable[[SparkSession, str], DataFrame]
EPSILON, SHARE, SEGMENT, STUCK = 2.0, 0.2, 8, 0.3


class Series:
    """Series of one folder: raw, normalised, with faults, private; plans only."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir
        events = telemetry.table(spark, sf_dir, "events")
        self.reports = telemetry.reports(events)
        self.raw = S.split(S.finite(S.from_reports(telemetry.reports(events, "value"))))
        self.matrix = C.piecewise_matrix(spark, EPSILON)
        self._derive(S.normalize(self.raw))

    def _derive(self, clean: DataFrame) -> None:
        self.clean = clean
        self.faulty = faults.inject(faults.segment_mask(self.clean, SHARE, SEGMENT), "segment_stuck", stuck=STUCK)
        self.private = self.faulty.withColumn("y", C.piecewise(F.col("vf"), EPSILON)).withColumn("obs", C.discretize(F.col("y"), EPSILON))
        self.alpha = C.alpha(self.clean.where("part = 'train'"))
        self.p0 = C.normal(self.matrix, self.alpha)
        self.ratios = D.ratio_lists(self.matrix, self.p0)

    def within(self, clean: DataFrame) -> Series:
        """The series of these normalised rows."""
        found = copy(self)
        found._derive(clean)
        return found

    def by_length(self) -> tuple[Series, Series | None]:
        """The series that a task may hold (operators/panels.py), and longer ones, if there are any."""
        clean = stage.table(self.clean, "clean")
        long = clean.groupBy("series_id").agg(F.count("*").alias("n")).where(F.col("n") > panels.HELD).select("series_id")
        if long.isEmpty():
            return self.within(clean), None
        long = stage.table(long, "long-series")
        return self.within(clean.join(long, "series_id", "left_anti")), self.within(clean.join(long, "series_id", "left_semi"))

    @property
    def centred(self) -> DataFrame:
        """Reports as the values at the centres of their bins."""
        c = C.shape(EPSILON)[1]
        return self.private.withColumn("y", F.lit(-c) + (F.col("obs") + F.lit(0.5)) * F.lit(2 * c / C.D))

    def undisturbed(self) -> DataFrame:
        """The stuck HMM on the buckets of the values themselves."""
        matrix = C.identity_matrix(self.spark)
        rows = self.faulty.withColumn("obs", C.bucket(F.col("vf")))
        return hmm.stuck(rows, hmm.table(matrix), C.normal(matrix, self.alpha), **HMM)

    def mistaken(self, factor: float) -> DataFrame:
        """The stuck HMM with the channel of another epsilon."""
        matrix = C.piecewise_matrix(self.spark, max(0.05, EPSILON * factor))
        return hmm.stuck(self.private, hmm.table(matrix), C.normal(matrix, self.alpha), **HMM)

    def with_faults(self, mode: str) -> DataFrame:
        return faults.inject(faults.iid_mask(self.clean, SHARE), mode, stuck=STUCK)

    def scores(self) -> dict[str, DataFrame]:
        return {
            "cusum": D.cusum(self.faulty, "vf", moments=D.train_moments(self.clean, "v")),
            "hampel": D.hampel(self.faulty, "vf"),
            "point_glr": D.point_glr(self.private, self.ratios),
            "robust_z": D.robust_z(self.faulty, "vf"),
            "surprise": D.surprise(self.private, self.p0),
        }

    def runs(self) -> DataFrame:
        """series_id, method, positives, negatives, auroc, auprc: one pass over all methods' scores."""
        self.faulty, self.private = (stage.table(x, name) for x, name in ((self.faulty, "faulty"), (self.private, "private")))
        self.p0 = stage.table(self.p0, "normal-reports")
        self.ratios = D.ratio_lists(self.matrix, self.p0)
        parts = [d.select("series_id", "t", "label", F.round("score", 6).alias("score"), F.lit(name).alias("method")) for name, d in self.scores().items()]
        rows = parts[0]
        for p in parts[1:]:
            rows = rows.union(p)
        return E.ranking(rows, ["series_id", "method"])


def scored(rows: DataFrame, digits: int = 6) -> DataFrame:
    extra = [F.col("candidate")] if "candidate" in rows.columns else []
    return rows.select("series_id", "t", F.round("score", digits).alias("score"), *extra)


def rounded(rows: DataFrame, digits: int = 6) -> DataFrame:
    # the sum with zero turns -0.0 into 0.0
    return rows.select(*[(F.round(c, digits) + F.lit(0.0)).alias(c) if kind == "double" else F.col(c) for c, kind in rows.dtypes])


def masked(s: Series) -> DataFrame:
    rows = D.hampel(s.faulty, "vf").withColumn("score", F.round("score", 6))
    return E.top_mask(rows, F.sum("label").over(Window.partitionBy("series_id")))


def repaired(s: Series, how: str) -> DataFrame:
    return E.repair(masked(s), how)


def stuck_scores(s: Series) -> DataFrame:
    return hmm.stuck(s.private, hmm.table(s.matrix), s.p0, **HMM)


def variants(s: Series) -> DataFrame:
    """All ways of repair, measured."""
    means = C.clean_mean(s.matrix, s.alpha).withColumnRenamed("report_bucket", "obs")
    rows = stage.table(s.private.join(means, ["series_id", "obs"]), "private")
    scores = {"robust_z": D.robust_z(rows, "y"), "mean_hampel": D.hampel(rows, "mean"), "point_glr": D.point_glr(rows, s.ratios)}
    posterior = hmm.stuck(rows, hmm.table(s.matrix), s.p0, **HMM)
    found = stage.table(E.variants(rows, {name: scored(d) for name, d in scores.items()}, scored(posterior)), "repaired")
    keys = ("series_id", "repair_method", "mask_source")
    counts = found.groupBy(*keys).agg(F.sum("mask").alias("masked"))
    return counts.join(E.repair_metrics(found, keys=keys), list(keys)).select(*keys, "masked", "mae", "rmse", "false_repairs")


def quality_scores(s: Series) -> DataFrame:
    """Labelled documents with a score in [0, 1] from their length."""
    docs, labels = telemetry.table(s.spark, s.sf_dir, "documents"), telemetry.table(s.spark, s.sf_dir, "labels")
    rows = labels.join(docs.select("doc_id", "lang", "n_chars"), "doc_id")
    return rows.select("lang", F.col("doc_id").alias("t"), F.col("quality").alias("label"), F.round(F.col("n_chars") / (F.col("n_chars") + 1000), 6).alias("score"))


def neighbours(s: Series) -> DataFrame:
    vectors = telemetry.table(s.spark, s.sf_dir, "embeddings").select("vec_id", "embedding")
    return rounded(D.nearest_neighbours(vectors.where("vec_id % 100 = 0"), vectors))


def gated(s: Series) -> DataFrame:
    runs = s.runs().select((F.col("series_id") % 5).alias("group"), F.when(F.col("series_id") % 2 == 0, "validation").otherwise("test").alias("part"), "series_id", "method", "auprc", (F.col("positives") / (F.col("positives") + F.col("negatives"))).alias("prevalence"))
    apart = C.separation(s.matrix, s.alpha).groupBy("series_id").agg(F.min("tv").alias("tv"), F.min("kl").alias("kl"))
    return B.gate(runs.join(apart, "series_id"))


def html_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and title of each page, by regular expressions over its HTML."""
    pages = telemetry.table(spark, sf_dir, "pages")
    links = F.regexp_extract_all("html", F.lit('href="/([^"]*)"'), 1)
    return pages.select("page_id", F.size(links).alias("n_links"), F.element_at(F.concat(links, F.array(F.lit(""))), 1).alias("first_link"), F.length(F.regexp_extract("html", "<title>([^<]*)</title>", 1)).alias("title_chars"))


SERIES: dict[str, Callable[[Series], DataFrame]] = {
    "m1_robust_normalize": lambda s: rounded(s.clean.select("series_id", "t", "part", "v")),
    "m2_range_normalize": lambda s: rounded(S.normalize(s.raw, "range").select("series_id", "t", "v")),
    "m3_reference_normalize": lambda s: rounded(S.normalize(s.raw, reference=F.col("part") != "test").select("series_id", "t", "v")),
    "m5_piecewise_sample": lambda s: rounded(s.private.select("series_id", "t", "y", "obs")),
    "m8_binary_sample": lambda s: s.clean.select("series_id", "t", C.binary(F.col("v"), EPSILON).alias("bit")),
    "m9_randomized_response": lambda s: s.clean.select("series_id", "t", C.randomized_response(C.bucket(F.col("v")), EPSILON).alias("obs")),
    "m11_histogram_alpha": lambda s: rounded(s.alpha, 9),
    "m13_normal_reports": lambda s: rounded(s.p0, 9),
    "m14_clean_mean": lambda s: rounded(C.clean_mean(s.matrix, s.alpha)),
    "m15_output_moments": lambda s: rounded(C.output_moments(s.matrix, s.alpha, EPSILON)),
    "m16_separation": lambda s: rounded(C.separation(s.matrix, s.alpha)),
    "m18_budget_days": lambda s: rounded(C.budget_days(R.ledger(s.reports), 30.0, (10.0, 100.0, 1000.0))),
    "f1_iid_mask": lambda s: faults.iid_mask(s.clean, SHARE).select("series_id", "t", "label"),
    "f2_segment_mask": lambda s: s.faulty.select("series_id", "t", "label"),
    **{f"f3_inject_{mode}": (lambda s, mode=mode: rounded(s.with_faults(mode).select("series_id", "t", "vf"))) for mode in ("iid_stuck", "bias", "drift", "scale", "spike", "dropout")},
    "f7_contaminated": lambda s: rounded(C.contaminated(s.alpha, 0.1, 5), 9),
    "d1_robust_z": lambda s: scored(D.robust_z(s.clean, "x")),
    "d2_rolling_median": lambda s: scored(D.rolling_median_score(s.clean, "v")),
    "d2_hampel": lambda s: scored(D.hampel(s.clean, "v")),
    "d3_cusum": lambda s: scored(D.cusum(s.clean, "x")),
    "d3_private_cusum": lambda s: scored(D.cusum(s.centred, "y", moments=C.output_moments(s.matrix, s.alpha, EPSILON))),
    "d5_surprise": lambda s: scored(D.surprise(s.private, s.p0)),
    "d6_frequency_surprise": lambda s: scored(D.frequency_surprise(s.private)),
    "d7_point_glr": lambda s: scored(D.point_glr(s.private, s.ratios)),
    "d8_window_glr": lambda s: scored(D.window_glr(s.private, s.ratios)),
    "d9_window_kl": lambda s: scored(D.window_kl(s.private, s.p0)),
    "d10_llr_cusum": lambda s: scored(D.llr_cusum(s.private, s.ratios)),
    "d11_smoothed_glr": lambda s: scored(D.smoothed(D.point_glr(s.private, s.ratios))),
    "d12_mixture_fit": lambda s: rounded(D.mixture(s.private, s.matrix, s.p0)),
    "d12_mixture": lambda s: scored(D.mixture_posterior(s.private, s.matrix, s.p0, D.mixture(s.private, s.matrix, s.p0))),
    "d22_missing_share": lambda s: scored(D.missing_share(s.with_faults("dropout"), "vf")),
    "d23_local_shape": lambda s: rounded(S.local_shape(s.raw).select("series_id", "t", "local_range", "local_slope")),
    "d26_nearest_neighbours": neighbours,
    "d28_rank_maximum": lambda s: rounded(S.percentile_rank(S.percentile_rank(s.raw, "x", "a"), "id", "b").select("series_id", "t", F.greatest("a", "b").alias("score"))),
    "w7_rolling_features": lambda s: rounded(S.rolling_features(s.raw).drop("id", "x", "part"), 9),
    "w16_runs": lambda s: S.runs(s.private, F.col("obs") >= 16),
    "w17_flatlines": lambda s: rounded(S.flatlines(s.raw, "x", 10.0, 2)),
    "w20_block_means": lambda s: rounded(S.block_means(s.raw, "x", 8)),
    "w21_every_nth": lambda s: rounded(S.every(s.raw, 6).select("series_id", "t", "x")),
    **{f"r1_repair_{how}": (lambda s, how=how: rounded(repaired(s, how).select("series_id", "t", "mask", "repaired"))) for how in ("linear", "forward", "median")},
    "r3_repair_metrics": lambda s: rounded(E.repair_metrics(repaired(s, "linear"))),
    "r4_bucket_wasserstein": lambda s: rounded(E.bucket_wasserstein(repaired(s, "linear"))),
    "r5_block_errors": lambda s: rounded(E.block_errors(repaired(s, "linear"))),
    "e1_ranking": lambda s: rounded(E.ranking(quality_scores(s), ["lang"])),
    "e2_stepwise_auprc": lambda s: rounded(E.stepwise_auprc(quality_scores(s), ["lang"])),
    "e3_at_budget": lambda s: rounded(E.at_budget(quality_scores(s), ["lang"], 0.1)),
    "e4_recall_at_fpr": lambda s: rounded(E.recall_at_fpr(quality_scores(s), ["lang"])),
    "e5_events": lambda s: rounded(E.events(S.runs(s.faulty, F.col("label") == 1), S.runs(masked(s), F.col("mask") == 1))),
    "e4_recall_by_sweep": lambda s: rounded(E.recall_by_sweep(quality_scores(s), ["lang"])),
    "e6_calibration": lambda s: rounded(E.calibration(quality_scores(s), ["lang"])),
    "b1_gate": lambda s: rounded(gated(s)),
    "b2_tagged_separation": lambda s: B.tagged(rounded(C.separation(s.matrix, s.alpha)), ["series_id"], "tv").select("series_id", "stuck_bucket", "tv", "rank", "tag"),
    "b3_runs": lambda s: rounded(s.runs()),
    "b3_best_method": lambda s: rounded(B.best(rounded(s.runs()), ["series_id"], "auprc", "method").select("series_id", "method", "auprc")),
    "b4_method_summary": lambda s: rounded(B.summary(s.runs(), ["method"], "auprc")),
    "b8_method_total": lambda s: rounded(B.with_total(s.runs(), "method", "auprc")),
    "b9_tiers": lambda s: rounded(B.tiers(s.runs(), "positives", "auprc", (1, 5, 10, 15))),
    "b9_bootstrap": lambda s: rounded(B.bootstrap(rounded(s.runs()), "method", "series_id", "auprc"), 6),
    "b11_family_gap": lambda s: rounded(B.best_against(rounded(s.runs()), ["series_id"], "auprc", "method", F.col("method").isin("point_glr", "surprise"))),
    "b11_gap_closed": lambda s: rounded(B.gap_closed(rounded(s.runs()), ["series_id"], "auprc", "method", "surprise", "robust_z").select("series_id", "method", "gap_closed")),
    "a19_correlation": lambda s: rounded(B.guarded_correlation(s.raw, ["series_id"], "x", "id")),
    "a29_profile": lambda s: rounded(B.profile(telemetry.table(s.spark, s.sf_dir, "events"), ["value", "user_id"])),
    "a31_pivot": lambda s: rounded(s.private.withColumn("third", (F.col("t") % 3).cast("string")).groupBy("series_id").pivot("third", ["0", "1", "2"]).agg(F.avg("y"))).selectExpr("series_id", "`0` as y0", "`1` as y1", "`2` as y2"),
    "b13_capped_strata": lambda s: B.capped_strata(s.raw, "series_id", "id", 10).select("series_id", "id"),
}
#: Row-by-row detectors; tests hold them against plain recursions too.
HMM = {"rate": SHARE, "length": float(SEGMENT)}
SEQUENTIAL: dict[str, Callable[[Series], DataFrame]] = {
    "d4_change_points": lambda s: rounded(hmm.change_points(s.clean, D.train_moments(s.clean, "v", robust=False), "v")),
    "d4_private_change_points": lambda s: rounded(hmm.change_points(s.centred, C.output_moments(s.matrix, s.alpha, EPSILON), "y")),
    "d14_stuck_hmm": lambda s: rounded(stuck_scores(s)),
    "d15_row_hmm": lambda s: rounded(hmm.stuck(s.private, hmm.table(s.matrix), s.p0, per_row=True, **HMM)),
    "d16_range_hmm": lambda s: rounded(hmm.stuck(s.private, hmm.table(s.matrix), s.p0, radius=2, **HMM)),
    "d17_learned_hmm": lambda s: rounded(hmm.learned(s.private, hmm.table(s.matrix), s.p0, **HMM)),
    "d18_dropout_hmm": lambda s: rounded(hmm.dropout(s.with_faults("dropout").withColumn("obs", C.bucket(F.col("vf"))), **HMM)),
    "d19_raw_hmm": lambda s: rounded(s.undisturbed()),
    **{f"d20_wrong_epsilon_{name}": (lambda s, f=f: rounded(s.mistaken(f))) for name, f in (("half", 0.5), ("double", 2.0))},
    "r2_repair_variants": lambda s: rounded(variants(s)),
    "e7_diagnosis": lambda s: rounded(E.diagnosis(rounded(stuck_scores(s)).join(s.faulty.select("series_id", "t", "label"), ["series_id", "t"]), int((STUCK + 1.0) * C.D / 2)), 12),
    "st13_stream": lambda s: rounded(shortlist.replay(s.private.join(scan.normals(s.p0, C.D), "series_id"), hmm.table(s.matrix), HMM)),
    "st13_shortlist_hmm": lambda s: rounded(hmm.shortlist(s.private, hmm.table(s.matrix), s.p0, **HMM)),
}

QUERIES: dict[str, Query] = {key: (lambda spark, d, build=build: build(Series(spark, d))) for key, build in {**SERIES, **SEQUENTIAL}.items()} | {"s25_html_links": html_links}
