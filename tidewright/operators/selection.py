"""Predicates, classes and choices of rows: who is eligible, what is calibrated on what, which windows match."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewright import stage

#: Patterns of comments on repeated values and on failures, in order of priority, and their classes.
REPEATED = r"(?i)\b(constant|flat|stuck|persist|zero values|too much zero|give 0degc|same value)\b"
FAILURE = r"(?i)\b(not working|malfunction|sensor drift|suspicious|bad data|disfunctional|failure|failed)\b"
CLASSES = ("explicit_repeated_value_or_zero", "sensor_failure_or_suspicious", "other_manual_flag")
#: What a layer's labels mean, by the layers that have that meaning; all others are as the last one.
TRIGGERS = {
    "iid scalar stuck-at points": ("iid_stuck",),
    "official flat-tolerance labels with scalar values preserved": ("official_flat_tolerance_labels",),
    "row-level prepared multivariate stuck labels": ("prepared_multivariate_stuck_labels",),
    "explicit availability or dropout labels": ("explicit_availability_dropout",),
    "deployed field-QC stuck labels encoding local regime changes": ("field_qc",),
    "persistent scalar stuck-at or flatline segments": (),
}
#: Classes of evidence with what they support and how they count.
BOUNDARIES = {
    "availability": ("availability_extension", "supports dropout emission, not stuck-at generality", "count separately from stuck-at/flatline evidence"),
    "streak": ("own_compatible", "supports scalar repeated-value/stuck semantics", "real-streak evidence of stations"),
    "tolerance": ("own_compatible", "supports official scalar flat-tolerance semantics with public values preserved", "direct value and label benchmark"),
    "own": ("own_compatible", "supports scalar flatline/stuck semantics", "mined native flatline-like evidence"),
    "other": ("semantic_mismatch_router_boundary", "supports router selection for label semantics outside single-bucket stuck-at", "validation selects local channel statistics"),
}


def relevance(text: Column) -> Column:
    """The class of a flag's comment, variable and name: the first pattern that they have; a null text has none."""
    has = lambda pattern: F.coalesce(text.rlike(pattern), F.lit(False))
    return F.when(has(REPEATED), CLASSES[0]).when(has(FAILURE), CLASSES[1]).otherwise(CLASSES[2])


def variable_family(name: Column) -> Column:
    """The quantity that a station's variable measures, by its name."""
    temperature = name.startswith("t_i_") | name.isin("t_i", "t_u", "t_l")
    return F.when(temperature, "temperature").when(name.isin("p_i", "p_u", "p_l"), "pressure").when(name.isin("rh_i", "rh_u", "rh_l"), "humidity").when(name.startswith("wspd"), "wind_speed").when(name.startswith("wdir"), "wind_direction").otherwise("other")


def family(method: Column) -> Column:
    raw = method.isin("robust_z", "hampel", "cusum")
    return F.when(method.contains("glr") | method.contains("cusum") | method.contains("spike"), "local channel statistic").when(method.contains("surprise") | method.contains("mixture"), "report distribution").when(raw, "raw values").otherwise("other")


def method_profile(method: Column, category: Column, own: str = "own_") -> dict[str, Column]:
    """What a method looks at, by its name and category; names begin with ldp_ or, of posterior models, with `own`."""
    raw, wrong = category == "raw_domain_upper_bound", method.contains("wrong_epsilon")
    temporal = F.lit(False)
    for token in ("hmm", "cusum", "bocpd", "rolling", "window"):
        temporal = temporal | method.contains(token)
    return {
        "access_regime": F.when(raw, "raw_upper_bound").otherwise("pm_ldp_reports"),
        "uses_raw_values": raw,
        "uses_pm_reports": category.isin("privatized_domain", "channel_aware_baseline", "privacy_aware", "channel_ablation"),
        "uses_pm_channel": method.startswith("ldp_") | method.startswith(own) | wrong,
        "uses_temporal_model": temporal,
        "diagnostic_outputs": method.isin(f"{own}mixture", f"{own}hmm", "ldp_window_glr") | wrong,
        "privacy_comparable": ~raw,
    }


def layer_trigger(layer: Column) -> Column:
    """The row of the router's policy that a layer of labels falls under; field_qc and what begins with it are one."""
    names = list(TRIGGERS)
    out = F.lit(names[-1])
    for name in reversed(names[:-1]):
        own = TRIGGERS[name]
        out = F.when(layer.startswith("field_qc") if own == ("field_qc",) else layer.isin(*own), name).otherwise(out)
    return out


def boundary_class(source: Column, layer: Column, best: Column, own: Column) -> dict[str, Column]:
    """boundary_class, supports and counts of evidence, by where it comes from, its layer and the best operator."""
    low = F.lower(source)
    kind = F.when(low.contains("dropout") | F.lower(layer).contains("availability"), "availability").when(low.contains("hadisd"), "streak").when(low.contains("co-ops") | low.contains("coops"), "tolerance")
    kind = kind.when(best.eqNullSafe(own) | F.coalesce(best.startswith("identity_channel_hmm"), F.lit(False)), "own").otherwise("other")
    pick = lambda i: F.element_at(F.create_map(*[F.lit(x) for k, v in BOUNDARIES.items() for x in (k, v[i])]), kind)
    return {name: pick(i) for i, name in enumerate(("boundary_class", "supports", "counts"))}


def eligible(rows: DataFrame, keys: list[str], least_positive: int, least_negative: int, most: float) -> DataFrame:
    """Groups with enough faults, enough clean rows and a share of faults within the limit."""
    sums = rows.groupBy(*keys).agg(F.sum("label").alias("positives"), F.sum(1 - F.col("label")).alias("negatives"))
    rate = F.col("positives") / (F.col("positives") + F.col("negatives"))
    return sums.withColumn("rate", rate).where((F.col("positives") >= least_positive) & (F.col("negatives") >= least_negative) & (F.col("rate") <= most))


def _blocks(rows: DataFrame, block: int) -> DataFrame:
    return rows.withColumn("block", F.floor(F.col("t") / block))


def calibration_source(rows: DataFrame, value: str, block: int, least: int) -> DataFrame:
    """series_id, block, source, n, mean: clean rows of the block before; if they are few, of the block itself; if those
    are few, all rows of the block."""
    per = _blocks(rows, block).groupBy("series_id", "block").agg(F.count_if(F.col("label") == 0).alias("clean"), F.sum(F.when(F.col("label") == 0, F.col(value))).alias("clean_sum"), F.count("*").alias("rows"), F.sum(value).alias("sum"))
    order = Window.partitionBy("series_id").orderBy("block")
    near = F.lag("block").over(order) == F.col("block") - 1
    before = lambda c: F.when(near, F.lag(c).over(order))
    per = per.withColumns({"_n": F.coalesce(before("clean"), F.lit(0)), "_s": before("clean_sum")})
    source = F.when(F.col("_n") >= least, "previous").when(F.col("clean") >= least, "same").otherwise("all")
    per = per.withColumn("source", source)
    pick = lambda a, b, c: F.when(F.col("source") == "previous", F.col(a)).when(F.col("source") == "same", F.col(b)).otherwise(F.col(c))
    return per.withColumn("n", pick("_n", "clean", "rows")).select("series_id", "block", "source", "n", (pick("_s", "clean_sum", "sum") / F.col("n")).alias("mean"))


def aligned(left: DataFrame, right: DataFrame, key: str = "series_id", order: str = "t") -> DataFrame:
    """The n-th row of each side of a key together, up to the shorter one; left: key, order, x; right: key, order, y.

    Rows without a finite value are dropped on each side before they are numbered.
    """
    n = F.row_number().over(Window.partitionBy(key).orderBy(order))
    sound = lambda rows, c: rows.where(F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double")) & (F.abs(F.col(c).cast("double")) != float("inf")))
    return sound(left, "x").select(key, n.alias("n"), "x").join(sound(right, "y").select(key, n.alias("n"), "y"), [key, "n"])


def block_choice(rows: DataFrame, block: int, least_positive: int, least_calibration: int) -> DataFrame:
    """Blocks with enough faults and enough clean rows in earlier blocks."""
    per = _blocks(rows, block).groupBy("series_id", "block").agg(F.sum("label").alias("positives"), F.sum(1 - F.col("label")).alias("clean"))
    earlier = F.coalesce(F.sum("clean").over(Window.partitionBy("series_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return per.withColumn("earlier", earlier).where((F.col("positives") >= least_positive) & (F.col("earlier") >= least_calibration)).select("series_id", "block", "positives", "earlier")


def top_blocks(rows: DataFrame, block: int, most: int) -> DataFrame:
    """The blocks of each series with most faults (of equals the first), back in order of time."""
    per = _blocks(rows, block).groupBy("series_id", "block").agg(F.sum("label").alias("positives"))
    place = F.row_number().over(Window.partitionBy("series_id").orderBy(F.desc("positives"), "block"))
    return per.withColumn("_n", place).where(F.col("_n") <= most).withColumn("place", F.row_number().over(Window.partitionBy("series_id").orderBy("block"))).drop("_n")


def top_and_forced(rows: DataFrame, key: str, score: str, most: int, forced: list[int]) -> DataFrame:
    """The keys of largest score and some that are always taken, each once."""
    best = rows.orderBy(F.desc(score), key).limit(most)
    return best.union(rows.where(F.col(key).isin(forced))).dropDuplicates([key])


def prior_rows(rows: DataFrame, value: str, block: int, most: int) -> DataFrame:
    """series_id, block, n, mean of the last clean rows, at most so many, of all earlier blocks.

    A running list of the last rows, not a join of blocks with all before them: its size is bounded.
    """
    rows = _blocks(rows, block).withColumn("_v", F.when(F.col("label") == 0, F.col(value)))
    upto = Window.partitionBy("series_id").orderBy("t").rowsBetween(Window.unboundedPreceding, -1)
    place = F.sum(F.when(F.col("label") == 0, 1).otherwise(0)).over(upto)
    sums = rows.withColumns({"_k": F.coalesce(place, F.lit(0)), "_s": F.coalesce(F.sum("_v").over(upto), F.lit(0.0))})
    first = sums.groupBy("series_id", "block").agg(F.min(F.struct("t", "_k", "_s")).alias("f")).select("series_id", "block", F.col("f._k").alias("k"), F.col("f._s").alias("s"))
    # the sum of what is before the last `most` clean rows, found by their number
    known = sums.where("label = 0").select("series_id", F.col("_k").alias("at"), F.col("_s").alias("before"))
    wanted = first.withColumn("at", F.greatest(F.lit(0), F.col("k") - most)).where("k > 0")
    return wanted.join(known, ["series_id", "at"]).select("series_id", "block", F.least(F.col("k"), F.lit(most)).alias("n"), ((F.col("s") - F.col("before")) / F.least(F.col("k"), F.lit(most))).alias("mean"))


def sparse_table(rows: DataFrame, value: str, longest: int, block: int = 1024) -> DataFrame:
    """series_id, blk, t, own, low, high, fault: of each row, arrays over powers of two up to `longest` with the least and
    the largest value and whether there is a fault in the next 1, 2, 4, ... rows (null where the series ends before).

    A series is cut into blocks, each with the rows of the next one beside its own, so a block has all that windows from
    its own rows on can reach, and no task holds a series. t counts rows without gaps.
    """
    block = max(block, longest)
    home = F.floor(F.col("t") / block)
    wide = rows.select("series_id", "t", F.col(value).alias("_low"), F.col(value).alias("_high"), F.col("label").alias("_fault"), F.explode(F.array(home, home - 1)).alias("blk"))
    wide = wide.where("blk >= 0").withColumn("own", F.col("blk") == home)
    order, names = Window.partitionBy("series_id", "blk").orderBy("t"), ("_low", "_high", "_fault")
    join = dict(zip(names, (F.least, F.greatest, F.greatest), strict=True))
    levels = [names]
    while 2 ** len(levels) <= longest:
        half, last = 2 ** (len(levels) - 1), levels[-1]
        own = [f"{n}{len(levels)}" for n in names]
        beyond = {c: F.lead(c, half).over(order) for c in last}
        wide = wide.withColumns({new: F.when(beyond[c].isNotNull() & F.col(c).isNotNull(), join[n](F.col(c), beyond[c])) for n, c, new in zip(names, last, own, strict=True)})
        levels.append(own)
    return wide.select("series_id", "blk", "t", "own", *[F.array(*[level[k] for level in levels]).alias(n) for k, n in enumerate(("low", "high", "fault"))])


def matched_negatives(rows: DataFrame, runs: DataFrame, value: str, width: float, most: int = 5) -> DataFrame:
    """series_id, begin (of a run of faults), n (its rows), negative, start: windows of the same length without a fault
    whose range is beyond `width`, at most so many by a scatter of their starts; where those are fewer than `most`, any
    window without a fault.

    Two windows of a power of two cover a window of any length, so its range and its faults take two rows of a sparse
    table. Lengths are few (a run's length); windows are taken once for each length of a series, not for each run. t
    counts rows without gaps; a run as long as its series has no negatives; values must not be null.
    """
    longest = runs.agg(F.max("n")).first()[0] or 1
    table = stage.table(sparse_table(rows, value, longest), "ranges")
    lengths = runs.select("series_id", F.col("n").alias("length"), F.floor(F.log2("n") + F.lit(1e-9)).cast("int").alias("power")).distinct()
    at = F.element_at
    first = table.where("own").join(lengths, "series_id")
    first = first.select("series_id", "blk", "t", "length", "power", (F.col("t") + F.col("length") - F.pow(F.lit(2.0), F.col("power")).cast("long")).alias("_u"), *[at(c, F.col("power") + 1).alias(f"_{c}") for c in ("low", "high", "fault")])
    second = table.select("series_id", "blk", F.col("t").alias("_u"), "low", "high", "fault")
    both = first.join(second, ["series_id", "blk", "_u"])
    low, high = F.least("_low", at("low", F.col("power") + 1)), F.greatest("_high", at("high", F.col("power") + 1))
    clean = (F.col("_fault") == 0) & (at("fault", F.col("power") + 1) == 0)
    starts = stage.table(both.where(clean).select("series_id", "length", "t", (high - low > width).alias("good")), "starts")
    few = starts.groupBy("series_id", "length").agg(F.count_if("good").alias("_good"))
    starts = starts.join(few, ["series_id", "length"]).where(F.col("good") | (F.col("_good") < most))
    place = F.row_number().over(Window.partitionBy("series_id", "length").orderBy((F.col("t") * 7919 + F.col("series_id").cast("long") * 104729) % 1000003, "t"))
    starts = starts.withColumn("_place", place).where(F.col("_place") <= most).withColumn("negative", F.col("_place") - 1)
    return runs.select("series_id", "begin", "n").join(starts.select("series_id", F.col("length").alias("n"), "negative", F.col("t").alias("start")), ["series_id", "n"])


def set_checks(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """both, left_only, right_only, subset: one row; keys count once."""
    sides = left.select(key).distinct().withColumn("a", F.lit(1)).join(right.select(key).distinct().withColumn("b", F.lit(1)), key, "full")
    return sides.agg(F.count_if(F.col("a").isNotNull() & F.col("b").isNotNull()).alias("both"), F.count_if(F.col("b").isNull()).alias("left_only"), F.count_if(F.col("a").isNull()).alias("right_only")).withColumn("subset", F.col("left_only") == 0)
