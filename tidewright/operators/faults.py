"""Faults injected into series, for evaluation; every choice follows from row ids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def scatter(row_id: str = "id") -> Column:
    """A number in [0, 100) that doesn't follow the order of ids."""
    return (F.col(row_id) * 7919) % 100


def mixed(segment: Column) -> Column:
    """A scatter of a segment's number and its series; in long numbers, as an int product passes 2**31 at series 20,505."""
    return (segment * 7919 + F.col("series_id").cast("long") * 104729) % 1000003


def iid_mask(rows: DataFrame, share: float) -> DataFrame:
    """label 1 for the floor(n * share) rows of a series that come first by a scatter of their ids."""
    order = Window.partitionBy("series_id").orderBy((F.col("id") * 7919) % 1000003, "id")
    target = F.floor(F.count("*").over(Window.partitionBy("series_id")) * F.lit(share))
    return rows.withColumn("label", (F.row_number().over(order) <= target).cast("int"))


def segment_mask(rows: DataFrame, share: float | Column, length: int | Column) -> DataFrame:
    """label 1 on whole segments of `length` rows, chosen by a scatter of their number until the share is reached."""
    share = F.lit(share) if isinstance(share, float) else share
    segment = F.floor(F.col("t") / length)
    order = Window.partitionBy("series_id").orderBy(mixed(segment), segment, "t")
    target = F.floor(F.count("*").over(Window.partitionBy("series_id")) * share)
    return rows.withColumn("label", (F.row_number().over(order) <= target).cast("int"))


def tolerances(rows: DataFrame, column: str, share: float = 0.01, least: float = 1e-3) -> DataFrame:
    """series_id, tolerance: a low quantile of a series' steps that aren't zero."""
    step = F.abs(F.col(column) - F.lag(column).over(Window.partitionBy("series_id").orderBy("t")))
    return rows.withColumn("_s", step).groupBy("series_id").agg(F.greatest(F.lit(least), F.coalesce(F.percentile(F.when(F.col("_s") > 1e-12, F.col("_s")), F.lit(share)), F.lit(least))).alias("tolerance"))


def templates(rows: DataFrame, column: str, known: DataFrame, least: int = 8, most: int = 24) -> DataFrame:
    """Flat pieces of series by how much they stand out, with their rank: series_id, begin, end (exclusive), n, level,
    range, flank_delta, score, rank.

    A piece's steps stay within twice the series' tolerance (known: series_id, tolerance); a series' last one is left out. Flanks are as long as a piece is
    at least. score: the flanks' distance times the root of the length, over the range.
    """
    order = Window.partitionBy("series_id").orderBy("t")
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    broken = F.when(F.abs(F.col(column) - F.lag(column).over(order)) > 2 * F.col("tolerance"), 1).otherwise(0)
    rows = rows.join(known, "series_id").withColumns({"_step": broken, "_all": F.sum(column).over(upto)}).withColumn("_run", F.sum("_step").over(upto))
    size = F.count("*").over(Window.partitionBy("series_id"))
    rows = rows.withColumns({"_last": F.max("_run").over(Window.partitionBy("series_id")), "_size": size})
    found = rows.where("_run < _last").groupBy("series_id", "_run").agg(F.min("t").alias("begin"), (F.max("t") + 1).alias("end"), F.count("*").alias("n"), F.avg(column).alias("level"), (F.max(column) - F.min(column)).alias("range"), F.max("_size").alias("_size"), F.sum(column).alias("_own"), F.max("tolerance").alias("tolerance"))
    found = found.where(F.col("n") >= least)
    sums = rows.select("series_id", (F.col("t") + 1).alias("_at"), "_all").union(rows.where("t = 0").select("series_id", F.lit(0).cast("long"), F.lit(0.0)))
    low, high = F.greatest(F.lit(0), F.col("begin") - least), F.least(F.col("_size"), F.col("end") + least)
    for name, at in (("_a", low), ("_b", high)):
        found = found.withColumn("_at", at.cast("long")).join(sums.withColumnRenamed("_all", name), ["series_id", "_at"]).withColumnRenamed("_at", f"{name}_at")
    rest = (F.col("_b_at") - F.col("_a_at") - F.col("n")).cast("double")
    flank = F.when(rest > 0, F.abs((F.col("_b") - F.col("_a") - F.col("_own")) / rest - F.col("level"))).otherwise(F.lit(0.0))
    found = found.withColumn("flank_delta", flank).withColumn("score", F.col("flank_delta") * F.sqrt("n") / F.greatest("range", "tolerance"))
    found = found.withColumn("rank", F.row_number().over(Window.partitionBy("series_id").orderBy(F.desc(F.round("score", 9)), "begin"))).where(F.col("rank") <= most)
    return found.select("series_id", "begin", "end", "n", "level", "range", "flank_delta", "score", "rank")


def template_faults(rows: DataFrame, found: DataFrame, share: float, column: str = "v", length: int = 48) -> DataFrame:
    """label and vf: segments stuck at the level of one of a series' templates, drawn by a hash of its id, and as long as
    that (8 rows at least, a third of the series or 96 at most); without one, at the 95th percentile for `length` rows."""
    count = found.groupBy("series_id").agg((((F.col("series_id").cast("long") * 7919 + 12345) % 1000003) % F.count("*") + 1).alias("rank"))
    first = found.join(count, ["series_id", "rank"]).select("series_id", F.greatest(F.lit(-1.0), F.least(F.lit(1.0), "level")).alias("_level"), F.col("n").alias("_n"))
    whole = rows.groupBy("series_id").agg(F.count("*").alias("_size"), F.percentile(column, F.lit(0.95)).alias("_high")).join(first, "series_id", "left")
    least = F.greatest(F.lit(8), F.least(F.lit(96), F.floor(F.col("_size") / 3)))
    size = F.coalesce(F.greatest(F.lit(8), F.least(least, F.col("_n"))), F.lit(length))
    rows = rows.join(whole.select("series_id", "_size", size.alias("_length"), F.coalesce("_level", "_high").alias("_level")), "series_id")
    segment = F.floor(F.col("t") / F.col("_length"))
    order = Window.partitionBy("series_id").orderBy(mixed(segment), segment, "t")
    rows = rows.withColumn("label", (F.row_number().over(order) <= F.greatest(F.lit(1), F.round(F.col("_size") * F.lit(share)))).cast("int"))
    return rows.withColumn("vf", F.when(F.col("label") == 1, F.col("_level")).otherwise(F.col(column))).drop("_size", "_length", "_level")


def inject(rows: DataFrame, mode: str, column: str = "v", stuck: float = 0.3) -> DataFrame:
    """Adds vf: the value with the fault where label is 1, clipped to [-1, 1].

    iid_stuck and segment_stuck hold a value, bias adds 0.35, drift grows to 0.45 over the faulty rows, scale
    stretches 1.7 times about the median, spike jumps 0.85 up or down, dropout loses the value.
    """
    v, bad = F.col(column), F.col("label") == 1
    if mode in ("iid_stuck", "segment_stuck"):
        faulty: Column = F.lit(stuck)
    elif mode == "bias":
        faulty = v + F.lit(0.35)
    elif mode == "drift":
        place = F.sum("label").over(Window.partitionBy("series_id").orderBy("t").rowsBetween(Window.unboundedPreceding, 0))
        total = F.sum("label").over(Window.partitionBy("series_id"))
        faulty = v + F.lit(0.45) * (place - 1) / F.greatest(total - 1, F.lit(1))
    elif mode == "scale":
        median = rows.groupBy("series_id").agg(F.percentile(column, F.lit(0.5)).alias("_median"))
        rows, faulty = rows.join(median, "series_id"), F.col("_median") + F.lit(1.7) * (v - F.col("_median"))
    elif mode == "spike":
        faulty = v + F.when(F.col("id") % 2 == 0, F.lit(0.85)).otherwise(F.lit(-0.85))
    elif mode == "dropout":
        return rows.withColumn("vf", F.when(~bad, v))
    else:
        raise ValueError(f"unknown mode: {mode}")
    return rows.withColumn("vf", F.when(bad, F.greatest(F.lit(-1.0), F.least(F.lit(1.0), faulty))).otherwise(v)).drop("_median")
