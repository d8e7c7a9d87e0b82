"""Scalar series: splits, normalisation, rolling statistics, runs, filling and ranks.

A series is rows of series_id, t (0, 1, ...) and values; every operator is a window partitioned by series_id, so
series are worked on side by side and one shuffle serves all windows of a plan.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F


def along(key: str = "series_id", order: str = "t") -> WindowSpec:
    return Window.partitionBy(key).orderBy(order)


def from_reports(reports: DataFrame, value: str = "value") -> DataFrame:
    """series_id, t, id, x: the raw values of each device in the order of its reports."""
    t = F.row_number().over(Window.partitionBy("device_id").orderBy("ts", "report_id")) - 1
    return reports.select(F.col("device_id").alias("series_id"), t.cast("long").alias("t"), F.col("report_id").alias("id"), F.col(value).alias("x"))


def finite(rows: DataFrame, column: str = "x") -> DataFrame:
    return rows.where(F.col(column).isNotNull() & ~F.isnan(column) & (F.abs(column) != F.lit(float("inf"))))


def split(rows: DataFrame, train: float = 0.6, validation: float = 0.2) -> DataFrame:
    """Adds `part` (train, validation, test) by position in the series."""
    place = F.col("t") / F.count("*").over(Window.partitionBy("series_id"))
    return rows.withColumn("part", F.when(place < train, "train").when(place < train + validation, "validation").otherwise("test"))


def normalize(rows: DataFrame, how: str = "robust", reference: Column | None = None) -> DataFrame:
    """Adds v in [-1, 1]: the 1st and 99th percentile ("robust") or least and largest ("range") of the reference rows
    (the train part if none is given) become -1 and 1; what is beyond is clipped, a flat reference gives 0. v counts to
    12 digits, so that a value on a bucket's edge stays on it though engines' percentiles are an ulp apart."""
    chosen = F.when(reference if reference is not None else F.col("part") == "train", F.col("x"))
    low, high = (F.percentile(chosen, F.lit(0.01)), F.percentile(chosen, F.lit(0.99))) if how == "robust" else (F.min(chosen), F.max(chosen))
    bounds = rows.groupBy("series_id").agg(low.alias("low"), high.alias("high"))
    width = F.col("high") - F.col("low")
    v = F.when(width > 0, F.greatest(F.lit(-1.0), F.least(F.lit(1.0), (F.col("x") - F.col("low")) / width * F.lit(2.0) - F.lit(1.0)))).otherwise(F.lit(0.0))
    return rows.join(bounds, "series_id").withColumn("v", F.round(v, 12)).drop("low", "high")


def chronological(rows: DataFrame, train: float = 0.6, validation: float = 0.2, test_len: int = 1200, least: int = 300) -> DataFrame:
    """series_id, t, part, v: the train, validation and test parts of series of at least `least` rows, in [-1, 1] by the
    training part's 1st and 99th percentile.

    The test part is the first `test_len` rows after the others, or, where these are fewer than 200 and than half of it,
    the series' last ones, which may be rows of other parts too. t counts rows; values must be finite.
    """
    size = F.count("*").over(Window.partitionBy("series_id"))
    rows = rows.withColumn("_size", size).where(F.col("_size") >= least)
    n_train, n_validation = F.floor(F.col("_size") * F.lit(train)), F.floor(F.col("_size") * F.lit(validation))
    after = F.col("t") - n_train - n_validation
    left = F.least(F.lit(test_len), F.col("_size") - n_train - n_validation)
    few = left < min(200, test_len // 2)
    test = F.when(few, F.col("t") >= F.col("_size") - test_len).otherwise((after >= 0) & (after < test_len))
    parts = F.array_compact(F.array(F.when(F.col("t") < n_train, "train").when(after < 0, "validation"), F.when(test, "test")))
    bounds = rows.where(F.col("t") < n_train).groupBy("series_id").agg(F.percentile("x", F.lit(0.01)).alias("low"), F.percentile("x", F.lit(0.99)).alias("high"))
    v = F.lit(2.0) * (F.col("x") - F.col("low")) / F.greatest(F.col("high") - F.col("low"), F.lit(1e-12)) - F.lit(1.0)
    return rows.withColumn("part", F.explode(parts)).join(bounds, "series_id").select("series_id", "t", "part", F.greatest(F.lit(-1.0), F.least(F.lit(1.0), v)).alias("v"))


def centred(width: int) -> WindowSpec:
    """width // 2 rows before, (width - 1) // 2 after."""
    return along().rowsBetween(-(width // 2), (width - 1) // 2)


def trailing(width: int) -> WindowSpec:
    return along().rowsBetween(-(width - 1), 0)


def rolling_median(column: str | Column, width: int, least: int | None = None) -> Column:
    c = F.col(column) if isinstance(column, str) else column
    frame = centred(width)
    return F.when(F.count(c).over(frame) >= (least or max(3, width // 4)), F.percentile(c, F.lit(0.5)).over(frame))


def wide_median(rows: DataFrame, column: str, width: int, least: int | None = None, block: int = 4096) -> DataFrame:
    """series_id, t, median: as rolling_median, for windows so wide that sorting each anew would cost too much.

    A series is cut into blocks with the rows that windows from its own rows reach beside them, so no task holds a
    series; within a block the window's values are kept in order while it moves on. t counts rows without gaps; nulls
    don't count; windows with fewer values than `least` have no median.
    """
    before, after, enough = width // 2, (width - 1) // 2, least or max(3, width // 4)
    size = max(block, width)
    home = F.floor(F.col("t") / size)
    near = F.array_compact(F.array(home, F.when(F.col("t") >= (home + 1) * size - before, home + 1), F.when((F.col("t") < home * size + after) & (home > 0), home - 1)))
    spread = rows.select("series_id", F.col("t").cast("long").alias("t"), F.col(column).cast("double").alias("x"), F.explode(near).alias("blk"))

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("t")
        t, x, blk = table["t"].to_pylist(), table["x"].to_pylist(), table["blk"][0].as_py()
        kept, found, end, begin = [], [], 0, 0
        own = [i for i, v in enumerate(t) if v // size == blk]
        for i in own:
            while end < len(x) and end <= i + after:
                if x[end] is not None:
                    insort(kept, x[end])
                end += 1
            while begin < i - before:
                if x[begin] is not None:
                    kept.pop(bisect_left(kept, x[begin]))
                begin += 1
            n = len(kept)
            found.append((kept[(n - 1) // 2] + kept[n // 2]) / 2 if n >= enough else None)
        return pa.table({"series_id": [table["series_id"][0].as_py()] * len(own), "t": [t[i] for i in own], "median": pa.array(found, pa.float64())}).cast(form)

    kind = spread.schema["series_id"].dataType
    form = pa.schema([("series_id", pa.int64() if kind.simpleString() == "bigint" else pa.int32()), ("t", pa.int64()), ("median", pa.float64())])
    return spread.groupBy("series_id", "blk").applyInArrow(run, f"series_id {kind.simpleString()}, t bigint, median double")


def rolling_mad(rows: DataFrame, column: str, width: int) -> DataFrame:
    """Adds median and mad: the rolling median, and the rolling median of distances from it; edges take the nearest."""
    rows = rows.withColumn("median", rolling_median(column, width))
    rows = rows.withColumn("median", F.coalesce("median", *nearest("median")))
    return rows.withColumn("mad", rolling_median(F.abs(F.col(column) - F.col("median")), width)).withColumn("mad", F.coalesce("mad", *nearest("mad")))


def nearest(column: str) -> tuple[Column, Column]:
    after = along().rowsBetween(0, Window.unboundedFollowing)
    before = along().rowsBetween(Window.unboundedPreceding, 0)
    return F.first(column, ignorenulls=True).over(after), F.last(column, ignorenulls=True).over(before)


def rolling_features(rows: DataFrame, column: str = "x", widths: tuple[int, ...] = (4, 8, 16, 32)) -> DataFrame:
    for w in widths:
        frame = trailing(w)
        mean = F.avg(column).over(frame)
        rows = rows.withColumns({f"mean_{w}": mean, f"std_{w}": F.coalesce(F.stddev_samp(column).over(frame), F.lit(0.0)), f"dev_{w}": F.abs(F.col(column) - mean)})
    return rows.withColumn("diff", F.coalesce(F.col(column) - F.lag(column).over(along()), F.lit(0.0)))


def local_shape(rows: DataFrame, column: str = "x", radius: int = 2) -> DataFrame:
    """Adds the range of the rows within the radius, and their mean absolute slope."""
    frame = along().rowsBetween(-radius, radius)
    rows = rows.withColumn("_step", F.abs(F.col(column) - F.lag(column).over(along())))
    slope = F.coalesce(F.avg("_step").over(along().rowsBetween(-radius + 1, radius)), F.lit(0.0))
    return rows.withColumn("local_range", F.max(column).over(frame) - F.min(column).over(frame)).withColumn("local_slope", slope).drop("_step")


def fill(rows: DataFrame, column: str, how: str) -> Column:
    """Gaps filled forward, backward or linearly; an edge takes the nearest value."""
    after, before = along().rowsBetween(0, Window.unboundedFollowing), along().rowsBetween(Window.unboundedPreceding, 0)
    last, first = F.last(column, ignorenulls=True).over(before), F.first(column, ignorenulls=True).over(after)
    if how == "forward":
        return F.coalesce(last, first)
    if how == "backward":
        return F.coalesce(first, last)
    at = F.when(F.col(column).isNotNull(), F.col("t"))
    t0, t1 = F.last(at, ignorenulls=True).over(before), F.first(at, ignorenulls=True).over(after)
    return F.coalesce(F.col(column), last + (first - last) * (F.col("t") - t0) / (t1 - t0), last, first)


def runs(rows: DataFrame, flag: Column) -> DataFrame:
    """begin, end, n of each maximal run of consecutive flagged rows (also one that reaches the end)."""
    rows = rows.where(flag).withColumn("_run", F.col("t") - F.row_number().over(along()))
    return rows.groupBy("series_id", "_run").agg(F.min("t").alias("begin"), F.max("t").alias("end"), F.count("*").alias("n")).drop("_run")


def flatlines(rows: DataFrame, column: str, tolerance: float, least: int) -> DataFrame:
    """begin, end, n, level of runs whose steps stay within twice the tolerance; a series' last run is left out."""
    broken = F.when(F.abs(F.col(column) - F.lag(column).over(along())) > 2 * tolerance, 1).otherwise(0)
    rows = rows.withColumn("_break", broken).withColumn("_run", F.sum("_break").over(along().rowsBetween(Window.unboundedPreceding, 0)))
    rows = rows.withColumn("_last", F.max("_run").over(Window.partitionBy("series_id"))).where("_run < _last")
    return rows.groupBy("series_id", "_run").agg(F.min("t").alias("begin"), F.max("t").alias("end"), F.count("*").alias("n"), F.avg(column).alias("level")).where(F.col("n") >= least).drop("_run")


def percentile_rank(rows: DataFrame, column: str, name: str) -> DataFrame:
    """Average rank of ties over the number of rows."""
    order = Window.partitionBy("series_id").orderBy(column)
    ties = F.count("*").over(Window.partitionBy("series_id", column))
    return rows.withColumn(name, (F.rank().over(order) + (ties - 1) / F.lit(2.0)) / F.count("*").over(Window.partitionBy("series_id")))


def block_means(rows: DataFrame, column: str, block: int) -> DataFrame:
    """Means of consecutive blocks; an incomplete last one is dropped."""
    found = rows.groupBy("series_id", F.floor(F.col("t") / block).alias("block")).agg(F.avg(column).alias("mean"), F.count("*").alias("n"))
    return found.where(F.col("n") == block).drop("n")


def every(rows: DataFrame, n: int) -> DataFrame:
    return rows.where(F.col("t") % n == 0)
