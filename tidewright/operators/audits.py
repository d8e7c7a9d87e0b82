"""Audits of flags: tests and their streaks, intervals of manual flags, and inventories by block."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import intervals
from .selection import relevance, variable_family


def streaks(rows: DataFrame, keys: list[str], flag: Column) -> DataFrame:
    """keys, begin, end, n of each maximal run of consecutive flagged rows; t counts rows."""
    rows = rows.where(flag).withColumn("_run", F.col("t") - F.row_number().over(Window.partitionBy(*keys).orderBy("t")))
    return rows.groupBy(*keys, "_run").agg(F.min("t").alias("begin"), F.max("t").alias("end"), F.count("*").alias("n")).drop("_run")


def test_summary(tests: DataFrame, streak_tests: dict[str, str]) -> DataFrame:
    """By test: flags of either sign, runs of positive ones and the longest; streak_tests: those of repeated values with
    their variable. tests: series_id, t, test, qc (positive: failed; negative: failed the other way)."""
    counts = tests.groupBy("test").agg(F.count("*").alias("rows"), F.count_if(F.col("qc") > 0).alias("positive_flags"), F.count_if(F.col("qc") < 0).alias("negative_flags"))
    runs = streaks(tests, ["series_id", "test"], F.col("qc") > 0).groupBy("test").agg(F.count("*").alias("positive_runs"), F.max("n").alias("max_positive_run_length"))
    known = F.col("test").isin(*streak_tests)
    variable = F.lit("")
    for test, name in streak_tests.items():
        variable = F.when(F.col("test") == test, name).otherwise(variable)
    out = counts.join(runs, "test", "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in ("positive_runs", "max_positive_run_length")})
    use = F.when(known & (F.col("positive_flags") > 0), "semantic candidate").otherwise("not used")
    return out.select("*", (F.col("positive_flags") + F.col("negative_flags")).alias("nonzero_flags"), known.cast("int").alias("string_or_streak_code"), variable.alias("mapped_variable"), use.alias("fit"))


def streak_events(tests: DataFrame, test: str, order: list[str]) -> DataFrame:
    """The rows that fail a test, with their run and the other tests that they fail, in the order given.

    A run's bounds come from windows over the failing rows of a series; tests of a row are gathered by one aggregation.
    """
    place = F.array_position(F.array(*map(F.lit, order)), F.col("test"))
    others = tests.where(F.col("qc") > 0).groupBy("series_id", "t").agg(F.count_if(F.col("test") == test).alias("_own"), F.sort_array(F.collect_set(F.struct(place.alias("place"), F.col("test").alias("test")))).alias("_all"))
    rows = others.where("_own > 0").withColumn("_run", F.col("t") - F.row_number().over(Window.partitionBy("series_id").orderBy("t")))
    run = Window.partitionBy("series_id", "_run")
    joined = F.array_join(F.transform("_all", lambda x: x["test"]), "|")
    return rows.select("series_id", "t", F.min("t").over(run).alias("positive_run_start"), F.max("t").over(run).alias("positive_run_end"), F.count("*").over(run).alias("positive_run_length"), joined.alias("cooccurring_positive_flags"))


def flag_inventory(flags: DataFrame) -> DataFrame:
    """flags (begin, end, variable, flag, comment) with duration, scalar variables, their families, relevance and use.

    variable: names parted by blanks. A flag is used for triage if its text speaks of repeated values and it names a
    scalar variable; one whose begin is commented out is not.
    """
    names = F.filter(F.split(F.trim(F.coalesce("variable", F.lit(""))), r"\s+"), lambda v: v != "")
    scalar = F.filter(names, lambda v: v.rlike("(?i)^(t|p|rh|wspd|wdir|t_i_)"))
    families = F.array_join(F.array_sort(F.array_distinct(F.transform("_scalar", variable_family))), " ")
    text = F.concat_ws(" ", F.coalesce("comment", F.lit("")), F.coalesce("variable", F.lit("")), F.coalesce("flag", F.lit("")))
    rows = flags.withColumns({"_scalar": scalar, "relevance": relevance(text)})
    rows = rows.withColumns({"duration": F.col("end") - F.col("begin"), "scalar_variable_count": F.size("_scalar"), "variable_families": families})
    usable = ~F.col("commented_out") & (F.col("relevance") == "explicit_repeated_value_or_zero") & (F.col("scalar_variable_count") > 0)
    return rows.withColumn("usable", usable.cast("int")).drop("_scalar")


def flagged_rows(rows: DataFrame, flags: DataFrame, flag: Column) -> DataFrame:
    """Flags (flag_id, series_id, begin, end and more) with their rows, and how many of them `flag` holds for."""
    inside = intervals.covered(rows.withColumn("_hit", flag.cast("int")).select("series_id", "t", "_hit"), flags.select("flag_id", "series_id", "begin", "end"), ["series_id"])
    counts = inside.groupBy("flag_id").agg(F.count("*").alias("rows"), F.sum("_hit").alias("hits"))
    return flags.join(counts, "flag_id", "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in ("rows", "hits")})


def streaks_against_flags(rows: DataFrame, runs: DataFrame, flags: DataFrame, group: str) -> DataFrame:
    """By group of flags: streaks with a row under one of its flags, their rows, and those under it; flags hold groups.

    runs: series_id, begin, end, n. The rows of the runs are points; a row under several flags of a group counts once.
    """
    inside = intervals.covered(rows.select("series_id", "t"), runs.select("series_id", "begin", "end", "n"), ["series_id"]).withColumnsRenamed({"begin": "streak", "end": "streak_end"})
    under = intervals.covered(inside, flags.select("series_id", "begin", "end", group), ["series_id"]).select("series_id", "streak", "n", "t", group).distinct()
    per = under.groupBy(group, "series_id", "streak", "n").agg(F.count("*").alias("_rows"))
    return per.groupBy(group).agg(F.count("*").alias("streaks"), F.sum("n").alias("streak_rows"), F.sum("_rows").alias("flagged_rows"))


def block_inventory(rows: DataFrame, block: int, least: int, chosen: int) -> DataFrame:
    """By series and block: good rows, stuck ones, those in episodes of at least `least` rows, episodes with their median
    and longest, and whether the block is among the series' `chosen` with most persistent rows.

    rows: series_id, t, label. An episode's length is that in the whole series; a block's episodes end with it.
    """
    home = F.floor(F.col("t") / block).alias("block")
    whole = streaks(rows, ["series_id"], F.col("label") == 1).where(F.col("n") >= least)
    persistent = intervals.covered(rows.select("series_id", "t"), whole.drop("n"), ["series_id"]).groupBy("series_id", home).agg(F.count("*").alias("persistent_stuck_rows"))
    counts = rows.groupBy("series_id", home).agg(F.count_if(F.col("label") == 0).alias("good_rows"), F.count_if(F.col("label") == 1).alias("all_stuck_rows"))
    parts = streaks(rows.withColumn("block", home), ["series_id", "block"], F.col("label") == 1)
    parts = parts.groupBy("series_id", "block").agg(F.count("*").alias("stuck_episodes"), F.percentile("n", F.lit(0.5)).alias("median_stuck_episode_length"), F.max("n").alias("max_stuck_episode_length"))
    out = counts.join(persistent, ["series_id", "block"], "left").join(parts, ["series_id", "block"], "left")
    out = out.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("persistent_stuck_rows", "stuck_episodes", "max_stuck_episode_length")})
    place = F.row_number().over(Window.partitionBy("series_id").orderBy(F.desc("persistent_stuck_rows"), "block"))
    return out.withColumns({"short_stuck_rows_excluded": F.col("all_stuck_rows") - F.col("persistent_stuck_rows"), "selected": ((place <= chosen) & (F.col("persistent_stuck_rows") > 0)).cast("int")})
