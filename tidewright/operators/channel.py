"""Privacy mechanisms and their channels.

A channel is a long table (stuck_bucket, report_bucket, p) of fixed size, columns (stuck buckets) sum to one; it
is broadcast. Samplers take uniforms computed from row ids, so that results can be repeated anywhere.
"""

from __future__ import annotations

from math import exp

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

D = 32


#: Multipliers of the draws of a row.
DRAWS = (0, 1103515245, 1812433253)


def uniform(row_id: str, k: int) -> Column:
    """A number in [0, 1) from a row id, the k-th draw (1 or 2) of that row; in whole numbers below 2**62."""
    mixed = ((F.col(row_id) % 2147483648) * DRAWS[k] + k * 12345) % 2147483648
    return ((mixed * 16807 + F.floor(mixed / 8192)) % 2147483648) / F.lit(2147483648.0)


def shape(epsilon: float) -> tuple[float, float]:
    """s and the bound c of the piecewise mechanism's outputs."""
    s = exp(epsilon / 2)
    return s, (s + 1) / (s - 1)


def piecewise(v: Column, epsilon: float, row_id: str = "id") -> Column:
    """Sample of the piecewise mechanism at v in [-1, 1]: near v with probability s / (s + 1), else in the tails."""
    s, c = shape(epsilon)
    low, high = (F.lit(s) * v - F.lit(1.0)) / F.lit(s - 1), (F.lit(s) * v + F.lit(1.0)) / F.lit(s - 1)
    u, w = uniform(row_id, 1), uniform(row_id, 2)
    place = w * (low + F.lit(c) + F.lit(c) - high)
    tail = F.when(place < low + F.lit(c), F.lit(-c) + place).otherwise(high + (place - (low + F.lit(c))))
    return F.when(u < F.lit(s / (s + 1)), low + w * (high - low)).otherwise(tail)


def discretize(y: Column, epsilon: float, out: int = D) -> Column:
    _, c = shape(epsilon)
    return F.greatest(F.lit(0), F.least(F.lit(out - 1), F.floor((y + F.lit(c)) / F.lit(2 * c / out)))).cast("int")


def discretize_right(y: Column, epsilon: float, out: int = D) -> Column:
    """The other convention: a value on an edge falls into the bin below it."""
    _, c = shape(epsilon)
    return F.greatest(F.lit(0), F.least(F.lit(out - 1), F.ceil((y + F.lit(c)) / F.lit(2 * c / out)) - 1)).cast("int")


def discretize_range(v: Column, low: Column, high: Column, out: int = D) -> Column:
    """Bins of equal width from low to high; what is beyond falls into the outer ones."""
    scaled = (v - low) / F.greatest(high - low, F.lit(1e-12))
    return F.greatest(F.lit(0), F.least(F.lit(out - 1), F.floor(scaled * out))).cast("int")


def bucket(v: Column, d: int = D) -> Column:
    """The bucket of v in [-1, 1], left-closed; a null has none."""
    return F.when(v.isNotNull(), F.greatest(F.lit(0), F.least(F.lit(d - 1), F.floor((v + F.lit(1.0)) * F.lit(d / 2)))).cast("int"))


def centre(column: str = "stuck_bucket", d: int = D) -> Column:
    return F.lit(-1.0 + 1.0 / d) + F.lit(2.0 / d) * F.col(column)


def grid(spark: SparkSession, d: int = D, out: int = D) -> DataFrame:
    ids = spark.range(d * out, numPartitions=1)
    return ids.select((F.col("id") % d).cast("int").alias("stuck_bucket"), F.floor(F.col("id") / d).cast("int").alias("report_bucket"))


def piecewise_matrix(spark: SparkSession, epsilon: float, d: int = D, out: int = D) -> DataFrame:
    s, c = shape(epsilon)
    width, step = 2 / (s - 1), 2 * c / out
    inside, outside = s / (s + 1) / width, 1 / (s + 1) / (2 * c - width)
    v = centre(d=d)
    low = (F.lit(s) * v - F.lit(1.0)) / F.lit(s - 1)
    a = F.lit(-c) + F.col("report_bucket") * F.lit(step)
    overlap = F.greatest(F.lit(0.0), F.least(a + F.lit(step), low + F.lit(width)) - F.greatest(a, low))
    mass = F.lit(inside) * overlap + F.lit(outside) * (F.lit(step) - overlap)
    rows = grid(spark, d, out).withColumn("_mass", mass)
    return rows.select("stuck_bucket", "report_bucket", (F.col("_mass") / F.sum("_mass").over(Window.partitionBy("stuck_bucket"))).alias("p"))


def randomized_response_matrix(spark: SparkSession, epsilon: float, k: int = D) -> DataFrame:
    total = exp(epsilon) + k - 1
    return grid(spark, k, k).withColumn("p", F.when(F.col("stuck_bucket") == F.col("report_bucket"), F.lit(exp(epsilon) / total)).otherwise(F.lit(1 / total)))


def randomized_response(b: Column, epsilon: float, k: int = D, row_id: str = "id") -> Column:
    """The true bucket with probability e^eps / (e^eps + k - 1), else one of the others."""
    other = F.floor(uniform(row_id, 2) * (k - 1)).cast("int")
    return F.when(uniform(row_id, 1) < F.lit(exp(epsilon) / (exp(epsilon) + k - 1)), b).otherwise(other + F.when(other >= b, 1).otherwise(0))


def binary_matrix(spark: SparkSession, epsilon: float, d: int = D) -> DataFrame:
    up = F.lit(0.5) + centre(d=d) * F.lit((exp(epsilon) - 1) / (2 * (exp(epsilon) + 1)))
    return grid(spark, d, 2).withColumn("p", F.when(F.col("report_bucket") == 1, up).otherwise(F.lit(1.0) - up))


def binary(v: Column, epsilon: float, row_id: str = "id") -> Column:
    up = F.lit(0.5) + v * F.lit((exp(epsilon) - 1) / (2 * (exp(epsilon) + 1)))
    return (uniform(row_id, 1) < up).cast("int")


def identity_matrix(spark: SparkSession, smoothing: float = 1e-4, d: int = D) -> DataFrame:
    """Values as they are: `smoothing` on every other bucket, the rest on the own one."""
    own = F.col("stuck_bucket") == F.col("report_bucket")
    return grid(spark, d, d).withColumn("p", F.when(own, F.lit(1.0 - smoothing * (d - 1))).otherwise(F.lit(smoothing)))


def alpha(rows: DataFrame, column: str = "v", smoothing: float = 1e-3, d: int = D) -> DataFrame:
    """series_id, stuck_bucket, alpha: smoothed shares of the buckets of each series; all d buckets have a row."""
    counted = rows.groupBy("series_id", bucket(F.col(column), d).alias("stuck_bucket")).agg(F.count("*").alias("n"))
    totals = counted.groupBy("series_id").agg(F.sum("n").alias("total"))
    every = totals.select("series_id", "total", F.explode(F.sequence(F.lit(0), F.lit(d - 1))).alias("stuck_bucket"))
    share = (F.coalesce("n", F.lit(0)) + F.lit(smoothing)) / (F.col("total") + F.lit(d * smoothing))
    return every.join(counted, ["series_id", "stuck_bucket"], "left").select("series_id", "stuck_bucket", share.alias("alpha"))


def contaminated(calibration: DataFrame, share: float, at: int) -> DataFrame:
    hot = F.when(F.col("stuck_bucket") == at, F.lit(share)).otherwise(F.lit(0.0))
    return calibration.withColumn("alpha", F.col("alpha") * F.lit(1 - share) + hot)


def normal(matrix: DataFrame, calibration: DataFrame) -> DataFrame:
    """series_id, report_bucket, p0: what a normal series reports. Series are dealt before their 32 rows become 1024."""
    return calibration.repartition("series_id").join(F.broadcast(matrix), "stuck_bucket").groupBy("series_id", "report_bucket").agg(F.sum(F.col("p") * F.col("alpha")).alias("p0"))


def clean_mean(matrix: DataFrame, calibration: DataFrame, d: int = D) -> DataFrame:
    """series_id, report_bucket, mean: expected clean value given a report."""
    joined = calibration.join(F.broadcast(matrix), "stuck_bucket")
    mass = F.col("p") * F.col("alpha")
    return joined.groupBy("series_id", "report_bucket").agg((F.sum(mass * centre(d=d)) / F.sum(mass)).alias("mean"))


def output_moments(matrix: DataFrame, calibration: DataFrame, epsilon: float, out: int = D) -> DataFrame:
    """series_id, mean, variance of a normal series' outputs, at the centres of the report bins."""
    _, c = shape(epsilon)
    y = F.lit(-c) + (F.col("report_bucket") + F.lit(0.5)) * F.lit(2 * c / out)
    rows = normal(matrix, calibration).withColumn("_y", y)
    mean = F.sum(F.col("p0") * F.col("_y"))
    return rows.groupBy("series_id").agg(mean.alias("mean"), (F.sum(F.col("p0") * F.col("_y") * F.col("_y")) - mean * mean).alias("variance"))


def separation(matrix: DataFrame, calibration: DataFrame) -> DataFrame:
    """series_id, stuck_bucket, tv, kl: how far a stuck column is from a normal series' reports."""
    rows = normal(matrix, calibration).join(F.broadcast(matrix), "report_bucket")
    p, q = F.greatest("p", F.lit(1e-12)), F.greatest("p0", F.lit(1e-12))
    return rows.groupBy("series_id", "stuck_bucket").agg((F.lit(0.5) * F.sum(F.abs(F.col("p") - F.col("p0")))).alias("tv"), F.sum(p * F.log(p / q)).alias("kl"))


def budget_days(ledger: DataFrame, horizon: float, budgets: tuple[float, ...]) -> DataFrame:
    """For each device and budget: its spending per day over the horizon, reports affordable, days until it is spent."""
    rate = F.col("epsilon_sum") / F.lit(horizon)
    rows = ledger.select("device_id", "reports", "epsilon_sum", F.explode(F.array(*map(F.lit, budgets))).alias("budget"))
    return rows.select("device_id", "budget", rate.alias("epsilon_per_day"), (rate * 30).alias("epsilon_per_30_days"), F.floor(F.col("budget") * F.col("reports") / F.col("epsilon_sum")).alias("max_reports"), F.floor(F.col("budget") / rate).alias("days"))


def estimated_alpha(rows: DataFrame, matrix: np.ndarray) -> DataFrame:
    """series_id, stuck_bucket, alpha: the shares of buckets whose reports would be nearest (least squares) to those seen.

    The channel's pseudo-inverse is a table of fixed size, which is broadcast; a null report counts nowhere.
    """
    inverse = np.linalg.pinv(matrix, rcond=np.finfo(float).eps * max(matrix.shape))
    spark, d = rows.sparkSession, matrix.shape[1]
    table = spark.createDataFrame([(int(c), int(r), float(inverse[c, r])) for c in range(d) for r in range(matrix.shape[0])], "stuck_bucket int, obs int, w double")
    counted = rows.where("obs is not null").groupBy("series_id", "obs").agg(F.count("*").alias("n"))
    share = F.col("n") / F.sum("n").over(Window.partitionBy("series_id"))
    raw = counted.withColumn("q", share).join(F.broadcast(table), "obs").groupBy("series_id", "stuck_bucket").agg(F.greatest(F.sum(F.col("w") * F.col("q")), F.lit(1e-9)).alias("a"))
    return raw.select("series_id", "stuck_bucket", (F.col("a") / F.sum("a").over(Window.partitionBy("series_id"))).alias("alpha"))


def distances(matrix: DataFrame, calibration: DataFrame) -> DataFrame:
    """series_id, stuck_bucket, l1, l2, chernoff: more distances of a stuck column from a normal series' reports."""
    rows = normal(matrix, calibration).join(F.broadcast(matrix), "report_bucket")
    p, q = F.greatest("p", F.lit(1e-12)), F.greatest("p0", F.lit(1e-12))
    away = F.abs(p - q)
    return rows.groupBy("series_id", "stuck_bucket").agg(F.sum(away).alias("l1"), F.sqrt(F.sum(away * away)).alias("l2"), (-F.log(F.sum(F.sqrt(p * q)))).alias("chernoff"))


def channel_quality(matrix: DataFrame, calibration: DataFrame, condition: float) -> DataFrame:
    """By series: the least total variation of neighbouring columns and the condition number (of the channel), and the
    entropy of the calibration in bits."""
    other = matrix.select((F.col("stuck_bucket") - 1).alias("stuck_bucket"), "report_bucket", F.col("p").alias("p1"))
    near = matrix.join(other, ["stuck_bucket", "report_bucket"]).groupBy("stuck_bucket").agg((F.lit(0.5) * F.sum(F.abs(F.col("p") - F.col("p1")))).alias("tv")).agg(F.min("tv").alias("adjacent_tv"))
    bits = calibration.groupBy("series_id").agg((-F.sum(F.col("alpha") * F.log2(F.greatest("alpha", F.lit(1e-12))))).alias("entropy_bits"))
    return bits.crossJoin(F.broadcast(near)).withColumn("condition_number", F.lit(float(condition)))


def stuck_values(rows: DataFrame, matrix: DataFrame, calibration: DataFrame, column: str = "v", d: int = D) -> DataFrame:
    """series_id, kind, value, bucket: values at which a stuck sensor is hardest to see: the training median, the centre
    of the fullest bucket, and that of the column nearest to normal reports (of equals the lowest)."""
    middle = rows.where("part = 'train'").groupBy("series_id").agg(F.percentile(column, F.lit(0.5)).alias("value"))
    middle = middle.select("series_id", F.lit("median").alias("kind"), "value", bucket(F.col("value"), d).alias("bucket"))
    first = lambda name: F.row_number().over(Window.partitionBy("series_id").orderBy(name, "stuck_bucket"))
    full = calibration.withColumn("_n", first(F.desc(F.round("alpha", 12)))).where("_n = 1")
    near = separation(matrix, calibration).withColumn("_n", first(F.round("tv", 12))).where("_n = 1")
    out = middle
    for name, found in (("mode_bucket", full), ("min_tv_column", near)):
        out = out.union(found.select("series_id", F.lit(name), centre(d=d), "stuck_bucket"))
    return out.withColumn("value", F.greatest(F.lit(-1.0), F.least(F.lit(1.0), "value")))


def device_grid(reports: DataFrame, minutes: tuple[int, ...] = (10, 60, 1440), budgets: tuple[float, ...] = (1.0, 10.0)) -> DataFrame:
    """For each epsilon in use, cadence and budget: what a device spends by simple composition and when its budget is
    gone; devices and reports: how many use that epsilon."""
    used = reports.groupBy("epsilon").agg(F.countDistinct("device_id").alias("devices"), F.count("*").alias("reports"))
    rows = used.withColumn("minutes", F.explode(F.array(*map(F.lit, minutes)))).withColumn("budget", F.explode(F.array(*map(F.lit, budgets))))
    daily, most = F.lit(1440.0) / F.col("minutes"), F.floor(F.col("budget") / F.col("epsilon"))
    day = F.col("epsilon") * daily
    return rows.select("epsilon", "minutes", "budget", "devices", "reports", daily.alias("reports_per_day"), day.alias("epsilon_per_day"), (day * 30).alias("epsilon_per_30_days"), (day * 365).alias("epsilon_per_year"), most.alias("max_reports"), (most / daily).alias("days"))
