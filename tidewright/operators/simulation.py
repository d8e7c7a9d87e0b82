"""Monte-Carlo over grids of settings, as one plan: draws by inverse distribution functions from hashes of the settings.

Nothing is drawn from a generator's state: a window's first number is a hash of its setting, and the further ones follow
from a linear congruence in closed form, so any window can be drawn anywhere and again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import channel
from .evaluation import ranking

#: A congruence modulo 2**31 and the multiplier of a hash of 32 bits.
FACTOR, STEP, HASH = 1103515245, 12345, 73244475
FLOOR = 1e-12
SETTING = ("series_id", "epsilon", "stuck_bucket")


def places(n: int) -> list[tuple[int, int]]:
    """a, b for each of the first n draws: the i-th state after s is (a * s + b) modulo 2**31."""
    out = [(FACTOR, STEP)]
    while len(out) < n:
        a, b = out[-1]
        out.append((a * FACTOR % 2**31, (b * FACTOR + STEP) % 2**31))
    return out[:n]


def hashed(rows: DataFrame, column: str, name: str) -> DataFrame:
    """A hash of 31 bits of a whole number: two rounds of shift, xor and multiplication, and a last shift."""
    for k in (1, 2):
        x = F.col(column) if k == 1 else F.col("_h")
        rows = rows.withColumn("_h", ((x.bitwiseXOR(F.shiftright(x, 16))) * HASH).bitwiseAND(0xFFFFFFFF))
    return rows.withColumn(name, F.shiftright(F.col("_h").bitwiseXOR(F.shiftright("_h", 16)), 1)).drop("_h")


def distributions(alpha: DataFrame, channels: dict[float, DataFrame], candidates: list[int]) -> DataFrame:
    """series_id, epsilon, stuck_bucket and arrays over the reports: q0 and q1 (normal, faulty), c0 and c1 (their running
    sums), llr; candidates: stuck buckets."""
    out = None
    for epsilon, matrix in channels.items():
        normal = channel.normal(matrix, alpha).withColumn("p0", F.greatest("p0", F.lit(FLOOR)))
        fault = matrix.where(F.col("stuck_bucket").isin(candidates)).withColumn("p", F.greatest("p", F.lit(FLOOR)))
        rows = normal.join(F.broadcast(fault), "report_bucket").withColumn("epsilon", F.lit(epsilon))
        out = rows if out is None else out.unionByName(rows)
    of = Window.partitionBy(*SETTING)
    upto = of.orderBy("report_bucket").rowsBetween(Window.unboundedPreceding, 0)
    rows = out.withColumns({"q0": F.col("p0") / F.sum("p0").over(of), "q1": F.col("p") / F.sum("p").over(of)})
    rows = rows.withColumns({"c0": F.sum("q0").over(upto), "c1": F.sum("q1").over(upto), "llr": F.log("q1") - F.log("q0")})
    names = ("q0", "q1", "c0", "c1", "llr")
    own = rows.groupBy(*SETTING).agg(F.sort_array(F.collect_list(F.struct("report_bucket", *names))).alias("_a"))
    return own.select(*SETTING, *[F.col(f"_a.{c}").alias(c) for c in names])


def padded(running: Column, d: int) -> Column:
    """d running sums without the last, which rounding may leave below a draw, and as many unreachable ones as halving asks for."""
    return F.concat(F.slice(running, 1, d - 1), F.array_repeat(F.lit(2.0), (1 << (d - 1).bit_length()) - d))


def drawn(start: Column, running: Column, length: Column, longest: int, d: int) -> Column:
    """The reports of a window: for each draw, how many running sums it reaches, found by halving; see padded()."""
    jumps = [1 << k for k in reversed(range((d - 1).bit_length()))]
    steps = F.array(*[F.struct(F.lit(a).cast("long").alias("a"), F.lit(b).cast("long").alias("b")) for a, b in places(longest)])
    uniform = F.transform(F.slice(steps, 1, length), lambda s: (s["a"] * start + s["b"]) % F.lit(2**31) / F.lit(2.0**31))
    reached = lambda u: F.aggregate(F.array(*map(F.lit, jumps)), F.lit(0), lambda n, s: F.when(F.element_at(running, n + s) <= u, n + s).otherwise(n))
    return F.transform(uniform, reached)


def channel_advantage(alpha: DataFrame, channels: dict[float, DataFrame], lengths: tuple[int, ...] = (8, 16, 32, 64), windows: int = 1000, seed: int = 0, d: int = channel.D) -> DataFrame:
    """What a channel's likelihoods tell beyond counting a value's own bucket, by series, epsilon, stuck bucket and length.

    For each setting, so many windows are drawn from a normal series' reports and as many from a stuck one's. Each is
    scored by its log-likelihood ratio and by its reports in the output bucket of the stuck value; areas under both
    scores' curves follow. alpha: series_id, stuck_bucket, alpha; channels: by epsilon. Settings are few and windows are
    many, so windows are dealt over all tasks and meet the distributions by a broadcast of one row for each setting.
    """
    spark = alpha.sparkSession
    candidates = sorted({0, 1, d // 4, d // 2, 3 * d // 4, d - 2, d - 1})
    known = distributions(alpha, channels, candidates)
    own = F.coalesce(*[F.when(F.col("epsilon") == e, channel.discretize(channel.centre(d=d), e)) for e in channels])
    known = known.withColumns({"output_bucket": own, "c0": padded(F.col("c0"), d), "c1": padded(F.col("c1"), d)})
    mean = lambda terms: F.aggregate(terms, F.lit(0.0), lambda s, x: s + x)
    known = known.withColumn("kl", mean(F.zip_with("q1", "llr", lambda q, x: q * x))).withColumn("chernoff", -F.log(mean(F.zip_with("q0", "q1", lambda a, b: F.sqrt(a * b)))))
    known = known.withColumns({"bucket_p_under_fault": F.element_at("q1", F.col("output_bucket") + 1), "bucket_p_under_normal": F.element_at("q0", F.col("output_bucket") + 1)})
    every = known.select(*SETTING).withColumn("segment_len", F.explode(F.array(*map(F.lit, lengths))))
    every = every.withColumn("window", F.explode(F.sequence(F.lit(0), F.lit(windows - 1)))).withColumn("label", F.explode(F.array(F.lit(0), F.lit(1))))
    every = every.repartition(max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))), *SETTING, "segment_len", "window")
    place = F.lit(0)
    for e, k in zip(channels, range(len(channels)), strict=True):
        place = F.when(F.col("epsilon") == e, k).otherwise(place)
    code = ((((F.col("series_id").cast("long") * len(channels) + place) * d + F.col("stuck_bucket")) * 128 + F.col("segment_len")) * windows + F.col("window")) * 2 + F.col("label") + seed
    every = hashed(every.withColumn("_code", code % F.lit(2**32)), "_code", "_start")
    rows = every.join(known.select(*SETTING, "c0", "c1", "llr", "output_bucket"), list(SETTING))
    reports = drawn(F.col("_start"), F.when(F.col("label") == 1, F.col("c1")).otherwise(F.col("c0")), F.col("segment_len"), max(lengths), d)
    rows = rows.withColumn("_reports", reports).select(*SETTING, "segment_len", "label", F.array(
        F.round(F.aggregate("_reports", F.lit(0.0), lambda s, b: s + F.element_at("llr", b + 1)), 9),
        F.aggregate("_reports", F.lit(0.0), lambda s, b: s + F.when(b == F.col("output_bucket"), 1.0).otherwise(0.0)),
    ).alias("_scores"))
    keys = [*SETTING, "segment_len", "kind"]
    areas = ranking(rows.select(*SETTING, "segment_len", "label", F.posexplode("_scores").alias("kind", "score")), keys)
    areas = areas.groupBy(*keys[:-1]).agg(*[F.max(F.when(F.col("kind") == k, F.col(c))).alias(name) for k, c, name in ((1, "auroc", "bucket_auc"), (0, "auroc", "llr_auc"), (0, "auprc", "llr_auprc"))])
    out = areas.join(known.drop("q0", "q1", "c0", "c1", "llr"), list(SETTING))
    hard = (F.round("bucket_auc", 9) <= 0.55) & (F.round("llr_auc", 9) >= 0.70)
    return out.withColumns({"stuck_value": channel.centre(d=d), "bucket_delta": F.col("bucket_p_under_fault") - F.col("bucket_p_under_normal"), "auroc_gap": F.col("llr_auc") - F.col("bucket_auc"), "hard_case": hard.cast("int")})


def by_epsilon(runs: DataFrame) -> DataFrame:
    """Settings, the share of hard cases and medians of the measures at each epsilon."""
    medians = [F.percentile(c, F.lit(0.5)).alias(f"median_{c}") for c in ("bucket_auc", "llr_auc", "llr_auprc", "kl", "auroc_gap")]
    return runs.groupBy("epsilon").agg(F.count("*").alias("settings"), F.avg("hard_case").alias("weak_bucket_case_fraction"), *medians)
