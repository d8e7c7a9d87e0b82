"""Reports over run tables: the best per group, ranks, pivots, rollups, tiers, bootstrap intervals, gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .evaluation import first_hits


def best(rows: DataFrame, keys: list[str], score: str, tie: str) -> DataFrame:
    """The row of largest score in each group; of equals the first by `tie`."""
    order = Window.partitionBy(*keys).orderBy(F.desc(score), tie)
    return rows.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


def best_against(rows: DataFrame, keys: list[str], score: str, method: str, family: Column) -> DataFrame:
    """The best method of a family against the best of all, and their difference."""
    inside = rows.where(family)
    a = best(rows, keys, score, method).select(*keys, F.col(method).alias("best"), F.col(score).alias("best_score"))
    b = best(inside, keys, score, method).select(*keys, F.col(method).alias("own"), F.col(score).alias("own_score"))
    return a.join(b, keys).withColumn("gap", F.col("best_score") - F.col("own_score"))


def gap_closed(rows: DataFrame, keys: list[str], score: str, method: str, base: str, oracle: str) -> DataFrame:
    whole = Window.partitionBy(*keys)
    at = lambda name: F.max(F.when(F.col(method) == name, F.col(score))).over(whole)
    return rows.withColumn("gap_closed", F.when(at(oracle) - at(base) > 1e-12, (F.col(score) - at(base)) / (at(oracle) - at(base))))


def summary(rows: DataFrame, keys: list[str], score: str) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count(score).alias("n"), F.avg(score).alias("mean"), F.stddev_samp(score).alias("std"), F.min(score).alias("least"), F.max(score).alias("most"), F.median(score).alias("median"))


def with_total(rows: DataFrame, key: str, score: str) -> DataFrame:
    """Means by key and over all; the total row's key is "all"."""
    out = rows.rollup(key).agg(F.grouping(key).alias("_g"), F.count(score).alias("n"), F.avg(score).alias("mean"))
    return out.select(F.when(F.col("_g") == 1, F.lit("all")).otherwise(F.col(key)).alias(key), "n", "mean")


def tiers(rows: DataFrame, count: str, score: str, limits: tuple[int, ...]) -> DataFrame:
    """Means by overlapping tiers: a row is in each tier whose limit it reaches."""
    names = F.filter(F.array(*[F.when(F.col(count) >= x, F.lit(f"all_ge_{x}")) for x in limits]), lambda x: x.isNotNull())
    return rows.select(F.explode(names).alias("tier"), score).groupBy("tier").agg(F.count("*").alias("n"), F.avg(score).alias("mean"))


def bootstrap(rows: DataFrame, key: str, row_id: str, score: str, rounds: int = 500) -> DataFrame:
    """Percentile interval of a group's mean; draws by a hash of round and place, so that they can be repeated.

    rows: few per group (a row for each case); each round draws as many places as the group has, and joins them.
    """
    place = F.row_number().over(Window.partitionBy(key).orderBy(row_id)) - 1
    size = F.count("*").over(Window.partitionBy(key))
    numbered = rows.where(F.col(score).isNotNull()).select(key, place.alias("place"), size.alias("size"), score)
    drawn = numbered.select(key, "size", "place", F.explode(F.sequence(F.lit(0), F.lit(rounds - 1))).alias("round"))
    mixed = ((F.col("round") * 1000003 + F.col("place")).cast("long") * 1103515245 + 12345) % 2147483648
    drawn = drawn.select(key, "round", (F.floor(mixed / 65536) % F.col("size")).cast("int").alias("place"))
    means = drawn.join(numbered.select(key, "place", score), [key, "place"]).groupBy(key, "round").agg(F.avg(score).alias("m"))
    order = Window.partitionBy(key).orderBy("m", "round")
    ranked = means.withColumn("_n", F.row_number().over(order) - 1)
    low, high = int(0.025 * (rounds - 1)), int(0.975 * (rounds - 1))
    return ranked.groupBy(key).agg(F.max(F.when(F.col("_n") == low, F.col("m"))).alias("low"), F.max(F.when(F.col("_n") == high, F.col("m"))).alias("high"), F.avg("m").alias("mean"))


def guarded_correlation(rows: DataFrame, keys: list[str], a: str, b: str, least: int = 3) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count("*").alias("n"), F.when(F.count("*") >= least, F.corr(a, b)).alias("r"))


def tagged(rows: DataFrame, keys: list[str], score: str) -> DataFrame:
    """Adds rank (dense) and tag: q05 for the first twentieth of ranks, q95 for the last, else mid."""
    rank = F.dense_rank().over(Window.partitionBy(*keys).orderBy(score))
    rows = rows.withColumn("rank", rank).withColumn("_most", F.max("rank").over(Window.partitionBy(*keys)))
    share = F.col("rank") / F.col("_most")
    return rows.withColumn("tag", F.when(share <= 0.05, "q05").when(share >= 0.95, "q95").otherwise("mid")).drop("_most")


def gate(rows: DataFrame, tv: float = 0.10, kl: float = 0.03) -> DataFrame:
    """rows: group, part (validation or test), method, auprc, prevalence, tv, kl. The method of best validation mean is
    routed where the channel separates faults, used where it lifts the test score, else nothing is done."""
    means = rows.groupBy("group", "method").agg(F.avg(F.when(F.col("part") == "validation", F.col("auprc"))).alias("validation"), F.avg(F.when(F.col("part") == "test", F.col("auprc"))).alias("test"), F.avg("prevalence").alias("prevalence"), F.min("tv").alias("tv"), F.min("kl").alias("kl"))
    chosen = best(means.where("validation is not null"), ["group"], "validation", "method").withColumn("lift", F.col("test") / F.col("prevalence"))
    apart = (F.col("tv") >= tv) & (F.col("kl") >= kl)
    return chosen.withColumn("action", F.when(apart & (F.col("lift") > 1), "route").when(F.col("lift") > 1, "use").otherwise("abstain"))


def profile(rows: DataFrame, columns: list[str]) -> DataFrame:
    """A row for each column: rows, valid, missing share, mean, deviation, 1st, 50th and 99th percentile."""
    stats = [F.struct(F.lit(c).alias("column"), F.count("*").alias("rows"), F.count(c).alias("valid"), (F.lit(1.0) - F.count(c) / F.count("*")).alias("missing"), F.avg(F.col(c).cast("double")).alias("mean"), F.stddev_samp(F.col(c).cast("double")).alias("std"), *[F.percentile(F.col(c).cast("double"), F.lit(q)).alias(n) for q, n in ((0.01, "p01"), (0.5, "p50"), (0.99, "p99"))]) for c in columns]
    return rows.agg(F.array(*stats).alias("s")).select(F.explode("s").alias("s")).select("s.*")


def capped_strata(rows: DataFrame, key: str, row_id: str, most: int) -> DataFrame:
    """At most `most` rows of each stratum, those that come first by a scatter of their ids."""
    order = Window.partitionBy(key).orderBy((F.col(row_id) * 7919) % 1000003, row_id)
    return rows.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= most).drop("_n")


def mode(rows: DataFrame, keys: list[str], column: str) -> DataFrame:
    """The most frequent value, of equals the smallest, and how often it is there."""
    counted = rows.where(F.col(column).isNotNull()).groupBy(*keys, column).agg(F.count("*").alias("n"))
    best = counted.groupBy(*keys).agg(F.max(F.struct("n", (-F.col(column)).alias("v"))).alias("b"))
    return best.select(*keys, (-F.col("b.v")).alias("mode"), F.col("b.n").alias("n"))


def case_means(rows: DataFrame, keys: list[str], case: str, score: str, weight: str) -> DataFrame:
    """The mean of the cases' means, and the mean of all rows by weight."""
    per = rows.where(F.col(score).isNotNull()).groupBy(*keys, case).agg(F.avg(score).alias("m"), F.sum(F.col(score) * F.col(weight)).alias("s"), F.sum(weight).alias("w"))
    return per.groupBy(*keys).agg(F.count("*").alias("cases"), F.avg("m").alias("case_mean"), (F.sum("s") / F.sum("w")).alias("row_mean"))


def pooled(rows: DataFrame, keys: list[str], shares: tuple[float, ...] = (0.01, 0.05)) -> DataFrame:
    """Prevalence over all rows of a group, and for each share the precision, recall and lift of the first rows by score
    (one at least; of equals the later t first)."""
    names = {f"{round(100 * x)}pct": F.greatest(F.lit(1), F.round(F.col("rows") * F.lit(x))) for x in shares}
    found = first_hits(rows, keys, [F.desc("t"), F.col("series_id")], names).withColumn("prevalence", F.col("positives") / F.col("rows"))
    out = []
    for name in names:
        precision = F.col(f"{name}_hits") / F.col(f"{name}_k")
        out += [precision.alias(f"precision_{name}"), (F.col(f"{name}_hits") / F.nullif(F.col("positives"), F.lit(0))).alias(f"recall_{name}"), (precision / F.nullif(F.col("prevalence"), F.lit(0.0))).alias(f"lift_{name}")]
    return found.select(*keys, "rows", "positives", "prevalence", *out)


def accounting(rows: DataFrame, tv: float = 0.10, kl: float = 0.03, lift: float = 1.0) -> DataFrame:
    """bucket, count, mean_score, mean_lift: accepted or rejected by the separation screen against good or bad by the lift;
    all four buckets have a row. rows: tv, kl, auprc, prevalence."""
    good = F.col("auprc") / F.col("prevalence")
    bucket = F.concat(F.when((F.col("tv") >= tv) & (F.col("kl") >= kl), "accepted").otherwise("rejected"), F.lit("-"), F.when(good >= lift, "good").otherwise("bad"))
    found = rows.where("auprc is not null").select(bucket.alias("bucket"), "auprc", good.alias("lift")).groupBy("bucket").agg(F.count("*").alias("n"), F.avg("auprc").alias("mean_score"), F.avg("lift").alias("mean_lift"))
    names = rows.sparkSession.range(1).select(F.explode(F.array(*[F.lit(f"{a}-{b}") for a in ("accepted", "rejected") for b in ("good", "bad")])).alias("bucket"))
    return names.join(found, "bucket", "left").select("bucket", F.coalesce("n", F.lit(0)).alias("count"), "mean_score", "mean_lift")


def suite(rows: DataFrame, keys: list[str], own: Column, family: Column) -> DataFrame:
    """By group: the best method by its mean score with its family, the best of the own ones, and the gain over that.

    rows: method, auroc, auprc."""
    means = rows.groupBy(*keys, "method").agg(F.avg("auroc").alias("auroc"), F.avg("auprc").alias("auprc"), F.count("auprc").alias("cases")).where("auprc is not null")
    # both in one aggregation, so that the runs are made once
    place = F.struct((-F.col("auprc")).alias("less"), "method", family.alias("family"), "auroc", "auprc", "cases")
    found = means.groupBy(*keys).agg(F.min(place).alias("_a"), F.min(F.when(own, place)).alias("_b"))
    names = {"recommended_method": "_a.method", "recommended_family": "_a.family", "best_auroc": "_a.auroc", "best_auprc": "_a.auprc", "cases": "_a.cases", "own_method": "_b.method", "own_auroc": "_b.auroc", "own_auprc": "_b.auprc"}
    return found.select(*keys, *[F.col(c).alias(name) for name, c in names.items()], (F.col("_a.auprc") - F.col("_b.auprc")).alias("gain"))


def boundary(rows: DataFrame, keys: list[str]) -> DataFrame:
    """boundary_class, groups, mean_gap and counts: groups whose best method is the own one, and those where it isn't.

    rows: as suite() gives them."""
    kind = F.when(F.col("own_method").isNull(), "no_own_method").when(F.col("recommended_method") == F.col("own_method"), "compatible").otherwise("router_boundary")
    return rows.groupBy(kind.alias("boundary_class")).agg(F.count("*").alias("groups"), F.avg("gain").alias("mean_gap"), F.max("gain").alias("largest_gap"))


def router_ledger(rows: DataFrame, keys: list[str]) -> DataFrame:
    """By group: the methods allowed, the one chosen by its validation mean, and its test metrics; beside it what the best
    on the test part would have had. rows: part (validation or test), method, auroc, auprc."""
    at = lambda part, c: F.avg(F.when(F.col("part") == part, F.col(c)))
    means = rows.groupBy(*keys, "method").agg(at("validation", "auprc").alias("validation"), at("test", "auroc").alias("test_auroc"), at("test", "auprc").alias("test_auprc"))
    allowed = means.groupBy(*keys).agg(F.concat_ws(",", F.sort_array(F.collect_set("method"))).alias("allowed_methods"))
    chosen = best(means.where("validation is not null"), keys, "validation", "method").select(*keys, F.col("method").alias("selected_method"), "validation", "test_auroc", "test_auprc")
    oracle = best(means.where("test_auprc is not null"), keys, "test_auprc", "method").select(*keys, F.col("method").alias("best_method"), F.col("test_auprc").alias("best_auprc"))
    return allowed.join(chosen, keys).join(oracle, keys, "left").withColumn("regret", F.col("best_auprc") - F.col("test_auprc"))


def ablation(rows: DataFrame, keys: list[str], family: Column) -> DataFrame:
    """By group and left-out family (`none` first): the method that the validation part chooses of those that stay, its
    test metrics, and its regret against the best of all on the test part.

    Each method stands under every family but its own, so one aggregation chooses for all sets at once. rows: part
    (validation or test), method, auroc, auprc. A set without a validated method is left out.
    """
    at = lambda part, c: F.avg(F.when(F.col("part") == part, F.col(c)))
    means = rows.groupBy(*keys, "method").agg(at("validation", "auprc").alias("validation"), at("test", "auroc").alias("test_auroc"), at("test", "auprc").alias("test_auprc")).withColumn("family", family)
    families = means.groupBy(*keys).agg(F.array_union(F.array(F.lit("none")), F.sort_array(F.collect_set("family"))).alias("_all"), F.max("test_auprc").alias("best_auprc"))
    kept = means.join(families, keys).withColumn("left_out", F.explode(F.filter("_all", lambda f: f != F.col("family"))))
    order = F.struct(F.when(F.col("validation").isNotNull(), -F.round("validation", 12)).otherwise(float("inf")).alias("v"), "method", "family", "validation", "test_auroc", "test_auprc")
    chosen = kept.groupBy(*keys, "left_out").agg(F.min(order).alias("c"), F.max("best_auprc").alias("best_auprc"), F.count("*").alias("methods")).where("c.validation is not null")
    return chosen.select(*keys, "left_out", "methods", F.col("c.method").alias("selected_method"), F.col("c.family").alias("selected_family"), *[F.col(f"c.{x}").alias(x) for x in ("validation", "test_auroc", "test_auprc")], (F.col("best_auprc") - F.col("c.test_auprc")).alias("regret"))


def operational(cases: DataFrame) -> DataFrame:
    """threshold, precision, recall, lift, review rows: what reviewing the first rows costs and finds, over all cases.

    cases: rows, positives, precision_1pct, precision_5pct, lift_1pct, lift_5pct and recall_fpr of each case. Recall of
    a share follows from its mean precision and all faults; at 5 % false positives the mean recall is given.
    """
    sums = cases.agg(F.sum("rows").alias("total_test_rows"), F.sum("positives").alias("total_fault_rows"), *[F.avg(c).alias(c) for c in ("precision_1pct", "precision_5pct", "lift_1pct", "lift_5pct", "recall_fpr")])
    total, faults = F.col("total_test_rows"), F.greatest(F.col("total_fault_rows"), F.lit(1))
    null = F.lit(None).cast("double")
    share = lambda x, name: F.struct(F.lit(f"top_{name}_rank").alias("threshold"), F.col(f"precision_{name}").alias("precision"), (total * F.lit(x) * F.col(f"precision_{name}") / faults).alias("recall"), F.col(f"lift_{name}").alias("prevalence_lift"), F.round(total * F.lit(x)).cast("long").alias("review_rows"))
    rate = F.struct(F.lit("5pct_fpr").alias("threshold"), null.alias("precision"), F.col("recall_fpr").alias("recall"), null.alias("prevalence_lift"), F.lit(None).cast("long").alias("review_rows"))
    rows = sums.withColumn("r", F.explode(F.array(share(0.01, "1pct"), share(0.05, "5pct"), rate)))
    return rows.select("r.*", "total_test_rows", "total_fault_rows", (F.col("total_fault_rows") / total).alias("pooled_prevalence"))
