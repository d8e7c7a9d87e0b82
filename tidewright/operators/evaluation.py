"""Repair of series and evaluation of scores, by group, without a group ever leaving Spark."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewright.operators.series import fill, nearest, rolling_median


def top_mask(rows: DataFrame, k: Column, key: str = "series_id") -> DataFrame:
    """mask 1 for the k rows of largest score; of equal scores the later row first."""
    return rows.withColumn("mask", (F.row_number().over(Window.partitionBy(key).orderBy(F.desc("score"), F.desc("t"))) <= k).cast("int"))


def repair(rows: DataFrame, how: str = "linear", column: str = "vf", width: int = 9) -> DataFrame:
    """Adds repaired: masked values replaced by interpolation or the last value of the others, or by the rolling median
    of all values; without others the value stays."""
    if how == "median":
        rows = rows.withColumn("_mid", rolling_median(column, width))
        rows = rows.withColumn("_mid", F.coalesce("_mid", *nearest("_mid")))
        return rows.withColumn("repaired", F.when(F.col("mask") == 0, F.col(column)).otherwise(F.coalesce("_mid", column))).drop("_mid")
    rows = rows.withColumn("_open", F.when(F.col("mask") == 0, F.col(column)))
    value = fill(rows, "_open", "linear" if how == "linear" else "forward")
    return rows.withColumn("repaired", F.coalesce(value, F.col(column))).drop("_open")


def blend(rows: DataFrame, column: str = "vf", target: str = "repaired") -> DataFrame:
    """A soft repair: the score's share of the target."""
    share = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("score")))
    return rows.withColumn("repaired", F.col(column) + share * (F.col(target) - F.col(column)))


def repair_metrics(rows: DataFrame, truth: str = "v", bins: int = 32, keys: tuple[str, ...] = ("series_id",)) -> DataFrame:
    """By series: mae, rmse, js2 (squared Jensen-Shannon distance, base 2, of smoothed histograms), wasserstein, errors of
    mean, deviation and 95th percentile, mae on faulty and clean rows, share of rows that are clean and masked."""
    e, wrong = F.abs(F.col("repaired") - F.col(truth)), (F.col("mask") == 1) & (F.col("label") == 0)
    basic = rows.groupBy(*keys).agg(
        F.avg(e).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"), F.abs(F.avg("repaired") - F.avg(truth)).alias("mean_error"), F.abs(F.stddev_pop("repaired") - F.stddev_pop(truth)).alias("std_error"),
        F.abs(F.percentile("repaired", F.lit(0.95)) - F.percentile(truth, F.lit(0.95))).alias("p95_error"), F.avg(F.when(F.col("label") == 1, e)).alias("fault_mae"), F.avg(F.when(F.col("label") == 0, e)).alias("clean_mae"), F.avg(F.when(wrong, F.lit(1.0)).otherwise(F.lit(0.0))).alias("false_repairs"),
    )
    at = lambda c: F.greatest(F.lit(0), F.least(F.lit(bins - 1), F.floor((F.col(c) + F.lit(1.0)) * F.lit(bins / 2))))
    sides = rows.select(*keys, F.explode(F.array(F.struct(at(truth).alias("bin"), F.lit(1.0).alias("a"), F.lit(0.0).alias("b")), F.struct(at("repaired").alias("bin"), F.lit(0.0).alias("a"), F.lit(1.0).alias("b")))).alias("s"))
    shares = sides.groupBy(*keys, "s.bin").agg(F.sum("s.a").alias("a"), F.sum("s.b").alias("b"))
    whole = Window.partitionBy(*keys)  # a bin that neither has adds nothing
    share = lambda c: (F.col(c) + F.lit(1e-3)) / (F.sum(c).over(whole) + F.lit(bins * 1e-3))
    shares = shares.withColumns({"a": share("a"), "b": share("b")})
    middle = (F.col("a") + F.col("b")) / 2
    js = shares.groupBy(*keys).agg(F.greatest(F.lit(0.0), F.lit(0.5) * F.sum(F.col("a") * F.log2(F.col("a") / middle) + F.col("b") * F.log2(F.col("b") / middle))).alias("js2"))
    place = lambda c: F.row_number().over(Window.partitionBy(*keys).orderBy(c))
    left, right = rows.select(*keys, place(truth).alias("n"), F.col(truth).alias("a")), rows.select(*keys, place("repaired").alias("n"), F.col("repaired").alias("b"))
    moved = left.join(right, [*keys, "n"]).groupBy(*keys).agg(F.avg(F.abs(F.col("a") - F.col("b"))).alias("wasserstein"))
    return basic.join(js, list(keys)).join(moved, list(keys))


def variants(rows: DataFrame, scores: dict[str, DataFrame], posterior: DataFrame, mean: str = "mean") -> DataFrame:
    """Every way of repair: none, the true mask three ways, the k rows of largest score of each method (k true faults),
    the posterior's, and a blend of a private series (`mean`) with its interpolation by the posterior's share.

    rows: series_id, t, v, vf, label and `mean`; scores and posterior: series_id, t, score. Adds mask, repaired,
    repair_method and mask_source, a row for each row and way.
    """
    base = ["series_id", "t", "v", "vf", "label", mean]
    rows = rows.select(*base)
    known = rows.withColumn("mask", F.col("label"))
    out = [rows.withColumn("mask", F.lit(0)).withColumn("repaired", F.col("vf")).withColumns({"repair_method": F.lit("no_repair"), "mask_source": F.lit("none")})]
    for how, name in (("linear", "linear_interpolation"), ("forward", "locf"), ("median", "rolling_median")):
        out.append(repair(known, how).withColumns({"repair_method": F.lit(name), "mask_source": F.lit("oracle_fault_mask")}))
    faults = F.sum("label").over(Window.partitionBy("series_id"))
    for name, score in {**scores, "posterior": posterior}.items():
        masked = top_mask(rows.join(score.select("series_id", "t", "score"), ["series_id", "t"]), faults)
        out.append(repair(masked, "linear").drop("score").withColumns({"repair_method": F.lit(f"{name}_repair"), "mask_source": F.lit(f"{name}_topk_mask_linear")}))
    soft = blend(repair(masked, "linear", mean), mean).drop("score")
    out.append(soft.withColumns({"repair_method": F.lit("posterior_soft_repair"), "mask_source": F.lit("posterior_soft_private")}))
    return reduce(DataFrame.unionByName, out)


def bucket_wasserstein(rows: DataFrame, truth: str = "v", bins: int = 32) -> DataFrame:
    """Earth mover's distance of the two histograms on bucket centres: the areas between their running shares."""
    at = lambda c: F.greatest(F.lit(0), F.least(F.lit(bins - 1), F.floor((F.col(c) + F.lit(1.0)) * F.lit(bins / 2))))
    n = F.count("*").over(Window.partitionBy("series_id"))
    sides = rows.withColumn("_n", n).select("series_id", F.explode(F.array(F.struct(at(truth).alias("bin"), (1.0 / F.col("_n")).alias("w")), F.struct(at("repaired").alias("bin"), (-1.0 / F.col("_n")).alias("w")))).alias("s"))
    bars = sides.groupBy("series_id", "s.bin").agg(F.sum("s.w").alias("w"))
    order = Window.partitionBy("series_id").orderBy("bin")
    bars = bars.withColumn("_gap", (F.lead("bin").over(order) - F.col("bin")) * F.lit(2.0 / bins)).withColumn("_cum", F.sum("w").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return bars.groupBy("series_id").agg(F.coalesce(F.sum(F.abs("_cum") * F.col("_gap")), F.lit(0.0)).alias("wasserstein"))


def block_errors(rows: DataFrame, truth: str = "v", block: int = 8) -> DataFrame:
    """Repaired aggregates: mean error of block means, and blocks above the truth's 90th percentile in either."""
    found = rows.groupBy("series_id", F.floor(F.col("t") / block).alias("block")).agg(F.avg(truth).alias("a"), F.avg("repaired").alias("b"), F.count("*").alias("n")).where(F.col("n") == block)
    limit = found.groupBy("series_id").agg(F.percentile("a", F.lit(0.9)).alias("limit"))
    return found.join(limit, "series_id").groupBy("series_id").agg(F.avg(F.abs(F.col("a") - F.col("b"))).alias("block_error"), F.count_if(F.col("a") > F.col("limit")).alias("above"), F.count_if(F.col("b") > F.col("limit")).alias("above_repaired"))


def ranking(rows: DataFrame, keys: list[str], many: bool = False) -> DataFrame:
    """By group: positives, negatives, auroc, auprc (tied scores together), null where a class is missing.

    Rows are first counted by score, so a group's windows run over its different scores, and counting starts
    before the shuffle. many: groups are many and small, so rows are dealt by group at once, in one shuffle instead of
    two.
    """
    rows = rows.select(*keys, "score", "label").repartition(*keys) if many else rows
    by_score = rows.groupBy(*keys, "score").agg(F.sum("label").alias("hits"), F.sum(1 - F.col("label")).alias("others"))
    down = Window.partitionBy(*keys).orderBy(F.desc("score"))
    so_far = down.rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(*keys)
    steps = by_score.withColumns({"tp": F.sum("hits").over(so_far), "fp": F.sum("others").over(so_far), "all_hits": F.sum("hits").over(whole), "all_others": F.sum("others").over(whole)})
    area = F.sum(F.col("others") * (F.col("tp") - F.col("hits") / F.lit(2.0)))
    both = (F.max("all_hits") > 0) & (F.max("all_others") > 0)
    precision = F.sum(F.col("hits") / F.nullif(F.col("all_hits"), F.lit(0)) * F.col("tp") / (F.col("tp") + F.col("fp")))
    return steps.groupBy(*keys).agg(F.max("all_hits").alias("positives"), F.max("all_others").alias("negatives"), F.when(both, area / F.max("all_hits") / F.max("all_others")).alias("auroc"), F.when(both, precision).alias("auprc"))


def stepwise_auprc(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Average precision row by row: equal scores stay in the order of t."""
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), "t").rowsBetween(Window.unboundedPreceding, 0)
    ranked = rows.withColumn("_tp", F.sum("label").over(order)).withColumn("_n", F.count("*").over(order))
    return ranked.groupBy(*keys).agg(F.when(F.sum("label") > 0, F.sum(F.when(F.col("label") == 1, F.col("_tp") / F.col("_n"))) / F.sum("label")).alias("auprc_rows"))


def first_hits(rows: DataFrame, keys: list[str], ties: list[Column], sizes: dict[str, Column]) -> DataFrame:
    """keys, rows, positives and, for each size, <name>_k and <name>_hits: faults among the first k rows by score.

    sizes: k from rows and positives. Rows are first counted by score; only those of the score at which the k-th row
    stands are put in order, by `ties`, so no group's rows meet in one task unless their scores are equal.
    """
    by_score = rows.groupBy(*keys, "score").agg(F.count("*").alias("_n"), F.sum("label").alias("_hits"))
    whole = by_score.groupBy(*keys).agg(F.sum("_n").alias("rows"), F.sum("_hits").alias("positives"))
    whole = whole.select("*", *[k.cast("long").alias(f"{name}_k") for name, k in sizes.items()])
    down = Window.partitionBy(*keys).orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, -1)
    before = by_score.withColumns({"_above": F.coalesce(F.sum("_n").over(down), F.lit(0)), "_found": F.coalesce(F.sum("_hits").over(down), F.lit(0))}).join(whole.drop("rows", "positives"), keys)
    edges = before.select("*", F.explode(F.array(*[F.struct(F.lit(name).alias("name"), F.col(f"{name}_k").alias("k")) for name in sizes])).alias("_e")).select(*keys, "score", "_n", "_above", "_found", "_e.name", "_e.k")
    edges = edges.where((F.col("_above") < F.col("k")) & (F.col("k") <= F.col("_above") + F.col("_n"))).withColumn("_need", F.col("k") - F.col("_above"))
    place = F.row_number().over(Window.partitionBy(*keys, "score", "name").orderBy(*ties))
    inside = rows.join(edges, [*keys, "score"]).withColumn("_place", place).where(F.col("_place") <= F.col("_need"))
    found = inside.groupBy(*keys, "name").agg((F.max("_found") + F.sum("label")).alias("_hits"))
    out = found.groupBy(*keys).agg(*[F.max(F.when(F.col("name") == name, F.col("_hits"))).alias(f"{name}_hits") for name in sizes])
    return whole.join(out, keys, "left").select(*keys, "rows", "positives", *[c for name in sizes for c in (F.col(f"{name}_k"), F.coalesce(f"{name}_hits", F.lit(0)).alias(f"{name}_hits"))])


def at_budget(rows: DataFrame, keys: list[str], share: float | None = None) -> DataFrame:
    """Precision and recall of the first k rows: as many as there are faults, or a share of all (one at least)."""
    k = F.col("positives") if share is None else F.greatest(F.lit(1), F.round(F.col("rows") * F.lit(share)))
    found = first_hits(rows, keys, [F.desc("t")], {"own": k})
    return found.select(*keys, F.col("own_k").alias("k"), F.when(F.col("own_k") > 0, F.col("own_hits") / F.col("own_k")).alias("precision"), F.when(F.col("positives") > 0, F.col("own_hits") / F.col("positives")).alias("recall"))


def recall_at_fpr(rows: DataFrame, keys: list[str], rate: float = 0.05) -> DataFrame:
    """Recall at or above the quantile of the negatives' scores that the given share of them exceeds; null where a class is missing."""
    limit = rows.groupBy(*keys).agg(F.percentile(F.when(F.col("label") == 0, F.col("score")), F.lit(1 - rate)).alias("_limit"), F.sum("label").alias("_hits"))
    found = rows.join(limit, keys).groupBy(*keys, "_limit", "_hits").agg(F.count_if((F.col("label") == 1) & (F.col("score") >= F.col("_limit"))).alias("_n"))
    return found.select(*keys, F.when(F.col("_limit").isNotNull() & (F.col("_hits") > 0), F.col("_n") / F.col("_hits")).alias("recall"))


def recall_by_sweep(rows: DataFrame, keys: list[str], rate: float = 0.05) -> DataFrame:
    """The largest recall of the first rows by score (equal ones by t) among which the share of all negatives is within the rate."""
    upto = Window.partitionBy(*keys).orderBy(F.desc("score"), "t").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(*keys)
    steps = rows.select(*keys, F.sum("label").over(upto).alias("tp"), F.sum(1 - F.col("label")).over(upto).alias("fp"), F.sum("label").over(whole).alias("p"), F.sum(1 - F.col("label")).over(whole).alias("n"))
    inside = F.max(F.when(F.col("fp") / F.nullif(F.col("n"), F.lit(0)) <= rate, F.col("tp") / F.nullif(F.col("p"), F.lit(0))))
    return steps.groupBy(*keys).agg(F.when((F.max("p") > 0) & (F.max("n") > 0), F.coalesce(inside, F.lit(0.0))).alias("recall"))


def diagnosis(rows: DataFrame, truth: int | None) -> DataFrame:
    """By series, of rows with label, score, candidate and rate: the estimated fault rate and stuck bucket against the
    true ones, and the calibration of the scores. truth: the true bucket, null where there is none."""
    per = rows.groupBy("series_id").agg(F.avg("label").alias("rate_true"), F.max("rate").alias("rate_estimated"), F.max("candidate").alias("bucket_estimated"))
    true = F.lit(truth).cast("int")
    per = per.withColumns({"rate_error": F.abs(F.col("rate_estimated") - F.col("rate_true")), "bucket_true": true, "bucket_error": F.abs(F.col("bucket_estimated") - true), "bucket_hit": (F.col("bucket_estimated") == true).cast("double")})
    return per.join(calibration(rows, ["series_id"]), "series_id")


def calibration(rows: DataFrame, keys: list[str], bins: int = 10) -> DataFrame:
    """Brier score and expected calibration error of scores in [0, 1]."""
    b = F.least(F.floor(F.col("score") * bins), F.lit(bins - 1))
    parts = rows.groupBy(*keys, b.alias("bin")).agg(F.count("*").alias("n"), F.sum("score").alias("s"), F.sum("label").alias("y"), F.sum((F.col("score") - F.col("label")) * (F.col("score") - F.col("label"))).alias("e"))
    return parts.groupBy(*keys).agg((F.sum("e") / F.sum("n")).alias("brier"), (F.sum(F.abs(F.col("s") - F.col("y"))) / F.sum("n")).alias("ece"))


def events(truth: DataFrame, found: DataFrame) -> DataFrame:
    """By series: recall of true runs, median delay, and the share that runs have in common; runs: begin and end."""
    pairs = truth.select("series_id", F.col("begin").alias("a"), F.col("end").alias("b")).join(found.select("series_id", F.col("begin").alias("c"), F.col("end").alias("d")), "series_id")
    pairs = pairs.where("c <= b and d >= a")
    common = F.least("b", "d") - F.greatest("a", "c") + 1
    per = pairs.groupBy("series_id", "a", "b").agg(F.greatest(F.lit(0), F.min("c") - F.col("a")).alias("delay"), F.sum(common).alias("common"), F.sum(F.col("d") - F.col("c") + 1).alias("length"))
    rows = truth.select("series_id", F.col("begin").alias("a"), F.col("end").alias("b")).join(per, ["series_id", "a", "b"], "left")
    iou = F.coalesce(F.col("common") / (F.col("b") - F.col("a") + 1 + F.col("length") - F.col("common")), F.lit(0.0))
    return rows.groupBy("series_id").agg(F.count("*").alias("events"), (F.count("delay") / F.count("*")).alias("recall"), F.percentile("delay", F.lit(0.5)).alias("delay"), F.avg(iou).alias("iou"))
