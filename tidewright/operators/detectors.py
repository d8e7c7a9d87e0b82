"""Detectors that windows and small lookup tables can express; each adds a score per row.

Lookups have 32 rows for each series and are joined on series and report; what is kept for each candidate is an array
in the row, so rows stay as many as they are and all windows of a plan share the series' partitioning.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewright import stage
from tidewright.operators import channel
from tidewright.operators.series import along, centred, rolling_mad, trailing


def robust_z(rows: DataFrame, column: str = "x") -> DataFrame:
    median = rows.groupBy("series_id").agg(F.percentile(column, F.lit(0.5)).alias("_median"))
    rows = rows.join(median, "series_id").withColumn("_dev", F.abs(F.col(column) - F.col("_median")))
    mad = rows.groupBy("series_id").agg(F.percentile("_dev", F.lit(0.5)).alias("_mad"))
    return rows.join(mad, "series_id").withColumn("score", F.col("_dev") / F.greatest(F.lit(1e-6), F.lit(1.4826) * F.col("_mad"))).drop("_median", "_dev", "_mad")


def rolling_median_score(rows: DataFrame, column: str = "x", width: int = 9) -> DataFrame:
    return rolling_mad(rows, column, width).withColumn("score", F.abs(F.col(column) - F.col("median"))).drop("median", "mad")


def hampel(rows: DataFrame, column: str = "x", width: int = 9, most: float = 20.0) -> DataFrame:
    score = F.abs(F.col(column) - F.col("median")) / F.greatest(F.lit(1e-6), F.lit(1.4826) * F.col("mad"))
    return rolling_mad(rows, column, width).withColumn("score", F.least(F.lit(most), score)).drop("median", "mad")


def spike(rows: DataFrame, column: str = "x") -> DataFrame:
    return rolling_median_score(rows, column, 9)


def rise(x: Column, key: list[str]) -> Column:
    """CUSUM max(0, s + x) in closed form: the running sum less the least of it so far and zero."""
    order = Window.partitionBy(*key).orderBy("t").rowsBetween(Window.unboundedPreceding, 0)
    return x - F.least(F.lit(0.0), F.min(x).over(order))


def train_moments(rows: DataFrame, column: str = "x", robust: bool = True) -> DataFrame:
    """series_id, mean, variance of the training part: its median and squared 1.4826 MAD, or its mean and variance."""
    rows = rows.where("part = 'train'")
    if not robust:
        return rows.groupBy("series_id").agg(F.avg(column).alias("mean"), F.var_pop(column).alias("variance"))
    middle = rows.groupBy("series_id").agg(F.percentile(column, F.lit(0.5)).alias("mean"))
    away = rows.join(middle, "series_id").groupBy("series_id", "mean").agg((F.lit(1.4826) * F.percentile(F.abs(F.col(column) - F.col("mean")), F.lit(0.5))).alias("_s"))
    return away.select("series_id", "mean", (F.col("_s") * F.col("_s")).alias("variance"))


def cusum(rows: DataFrame, column: str = "x", drift: float = 0.25, moments: DataFrame | None = None) -> DataFrame:
    """The larger of the upward and downward sums of standardised values; moments: series_id, mean, variance (the
    training part's if none are given)."""
    if moments is None:
        moments = train_moments(rows, column)
    rows = rows.join(moments.select("series_id", F.col("mean").alias("_mean"), F.greatest(F.sqrt("variance"), F.lit(1e-6)).alias("_std")), "series_id")
    z = (F.col(column) - F.col("_mean")) / F.col("_std")
    order = along().rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("_up", F.sum(z - F.lit(drift)).over(order)).withColumn("_down", F.sum(-z - F.lit(drift)).over(order))
    return rows.withColumn("score", F.greatest(rise(F.col("_up"), ["series_id"]), rise(F.col("_down"), ["series_id"]))).drop("_up", "_down", "_mean", "_std")


def surprise(rows: DataFrame, p0: DataFrame) -> DataFrame:
    """-ln p of the report under the normal distribution of its series."""
    table = p0.select("series_id", F.col("report_bucket").alias("obs"), (-F.log(F.greatest("p0", F.lit(1e-15)))).alias("score"))
    return rows.join(table, ["series_id", "obs"])


def frequency_surprise(rows: DataFrame, d: int = channel.D) -> DataFrame:
    """-ln of the report's own frequency in its series, one added to each count."""
    n, total = F.count("*").over(Window.partitionBy("series_id", "obs")), F.count("*").over(Window.partitionBy("series_id"))
    return rows.withColumn("score", -F.log((n + 1) / (total + d)))


def ratios(matrix: DataFrame, p0: DataFrame) -> DataFrame:
    """series_id, obs, candidate, llr: ln of a stuck column over the normal distribution."""
    rows = p0.join(F.broadcast(matrix), "report_bucket")
    llr = F.log(F.greatest("p", F.lit(1e-15))) - F.log(F.greatest("p0", F.lit(1e-15)))
    return rows.select("series_id", F.col("report_bucket").alias("obs"), F.col("stuck_bucket").alias("candidate"), llr.alias("llr"))


def ratio_lists(matrix: DataFrame, p0: DataFrame) -> DataFrame:
    """series_id, obs, of: ratios() as one list of (candidate, llr) in the order of candidates for each report.

    The channel's columns are lists before they meet a series, so a series has 32 rows here, never 1024.
    """
    logs = matrix.groupBy("report_bucket").agg(F.array_sort(F.collect_list(F.struct(F.col("stuck_bucket").alias("candidate"), F.log(F.greatest("p", F.lit(1e-15))).alias("llr")))).alias("_logs"))
    quiet = F.log(F.greatest("p0", F.lit(1e-15)))
    of = F.transform("_logs", lambda x: F.struct(x.candidate.alias("candidate"), (x.llr - quiet).alias("llr")))
    return p0.join(F.broadcast(logs), "report_bucket").select("series_id", F.col("report_bucket").alias("obs"), of.alias("of"))


def _lists(table: DataFrame) -> DataFrame:
    """ratio_lists() of what is either that or ratios()."""
    if "of" in table.columns:
        return table
    return table.groupBy("series_id", "obs").agg(F.array_sort(F.collect_list(F.struct("candidate", "llr"))).alias("of"))


def point_glr(rows: DataFrame, table: DataFrame) -> DataFrame:
    """The largest ratio over candidates, and the candidate (the lowest of those within 1e-9 of the largest; rounded ratios
    would part equal ones that lie on either side of a half). The join is no broadcast: what lists leave is taken for smaller
    than it is."""
    best = _lists(table).withColumn("score", F.array_max(F.transform("of", lambda x: x.llr)))
    near = F.filter("of", lambda x: x.llr >= F.col("score") - F.lit(1e-9))
    best = best.select("series_id", "obs", "score", F.array_min(F.transform(near, lambda x: x.candidate)).alias("candidate"))
    return rows.join(best.hint("merge"), ["series_id", "obs"])


def smoothed(rows: DataFrame, width: int = 5) -> DataFrame:
    return rows.withColumn("score", F.avg("score").over(trailing(width)))


def _placed(rows: DataFrame, values: dict[int, Column]) -> DataFrame:
    """score: of each width's window values (at their first rows), put at the windows' centres and spread by a centred
    maximum, the largest; 0 where no full window is near."""
    first = {f"_v{w}": value for w, value in values.items()}
    rows = rows.withColumns(first)
    rows = rows.withColumns({f"_v{w}": F.coalesce(F.lag(f"_v{w}", w // 2).over(along()), F.lit(0.0)) for w in values})
    spread = [F.max(f"_v{w}").over(centred(w)) for w in values]
    return rows.withColumn("score", F.greatest(*spread, F.lit(0.0))).drop(*first)


def _with_ratios(rows: DataFrame, table: DataFrame) -> DataFrame:
    """Adds _l, the ratios of a row's report by candidate: rows stay as many as they are.

    A series' lists are one map, met by the series alone: rows are dealt as the windows over them ask, and the lists don't
    travel with each row.
    """
    maps = _lists(table).groupBy("series_id").agg(F.map_from_entries(F.collect_list(F.struct("obs", F.col("of.llr").alias("_l")))).alias("_of"))
    return rows.join(maps.hint("merge"), "series_id").withColumn("_l", F.try_element_at("_of", F.col("obs"))).drop("_of").where(F.col("_l").isNotNull())


def _each(column: str, d: int, do) -> Column:
    """An array of what `do` makes of each of the d entries of an array."""
    return F.array(*[do(F.get(column, F.lit(i))) for i in range(d)])


def window_glr(rows: DataFrame, table: DataFrame, widths: tuple[int, ...] = (8, 16, 32, 64), d: int = channel.D) -> DataFrame:
    """The largest sum of ratios over a full window, for any candidate and width, floored at 0.

    The sums so far of all candidates are taken once; a window of any width is the difference of two of them.
    """
    upto = along().rowsBetween(Window.unboundedPreceding, 0)
    spread = _with_ratios(rows, table).withColumn("_sum", _each("_l", d, lambda x: F.sum(x).over(upto)))
    spread = spread.withColumns({f"_e{w}": F.lead("_sum", w - 1).over(along()) for w in widths})
    before = F.zip_with("_sum", "_l", lambda s, own: s - own)
    values = {w: F.array_max(F.zip_with(F.col(f"_e{w}"), before, lambda e, b: e - b)) for w in widths}
    return _placed(spread, values).drop("_l", "_sum", *[f"_e{w}" for w in widths])


def window_kl(rows: DataFrame, p0: DataFrame, widths: tuple[int, ...] = (8, 16, 32, 64)) -> DataFrame:
    """The largest divergence, times the width, of a full window's reports from the normal distribution."""
    logs = p0.select("series_id", F.col("report_bucket").alias("obs"), F.log(F.greatest("p0", F.lit(1e-12))).alias("_lp"))
    inside = rows.join(logs, ["series_id", "obs"])
    frames = {w: along().rowsBetween(0, w - 1) for w in widths}
    inside = inside.withColumns({f"_in{w}": F.collect_list("obs").over(f) for w, f in frames.items()} | {f"_lp{w}": F.sum("_lp").over(f) for w, f in frames.items()})

    def value(w: int) -> Column:
        # at most w reports, sorted: the sum of n ln n over their runs, by the growth of each run
        start = F.struct(F.lit(-1).alias("o"), F.lit(0.0).alias("n"), F.lit(0.0).alias("s"))

        def grow(a: Column, o: Column) -> Column:
            n = F.when(o == a.o, a.n + 1.0).otherwise(F.lit(1.0))
            return F.struct(o.alias("o"), n.alias("n"), (a.s + n * F.log(n) - F.when(n > 1, (n - 1.0) * F.log(n - 1.0)).otherwise(F.lit(0.0))).alias("s"))

        entropy = F.aggregate(F.sort_array(f"_in{w}"), start, grow, lambda a: a.s)
        return F.when(F.size(f"_in{w}") == w, entropy - F.lit(w * math.log(w)) - F.col(f"_lp{w}"))

    return _placed(inside, {w: value(w) for w in widths}).drop("_lp", *[f"_{n}{w}" for n in ("in", "lp") for w in widths])


def llr_cusum(rows: DataFrame, table: DataFrame, drift: float = 0.25, d: int = channel.D) -> DataFrame:
    """The largest CUSUM over candidates of ratios standardised within series and candidate."""
    whole, upto = Window.partitionBy("series_id"), along().rowsBetween(Window.unboundedPreceding, 0)
    spread = _with_ratios(rows, table)
    spread = spread.withColumn("_mean", _each("_l", d, lambda x: F.avg(x).over(whole))).withColumn("_std", _each("_l", d, lambda x: F.greatest(F.stddev_pop(x).over(whole), F.lit(1e-6))))
    z = F.zip_with(F.zip_with("_l", "_mean", lambda x, m: x - m), "_std", lambda x, s: x / s - F.lit(drift))
    spread = spread.withColumn("_z", z).withColumn("_z", _each("_z", d, lambda x: F.sum(x).over(upto)))
    spread = spread.withColumn("_least", _each("_z", d, lambda x: F.min(x).over(upto)))
    score = F.array_max(F.zip_with("_z", "_least", lambda x, m: x - F.least(F.lit(0.0), m)))
    return spread.withColumn("score", score).drop("_l", "_mean", "_std", "_z", "_least")


LOW, HIGH = 0.01, 0.70


def rate_at(i: Column, steps: int) -> Column:
    return F.lit(LOW) + i * F.lit((HIGH - LOW) / (steps - 1))


def rates(steps: int = 100) -> Column:
    """The grid of fault rates, evenly spaced."""
    return F.transform(F.sequence(F.lit(0), F.lit(steps - 1)), lambda i: rate_at(i, steps))


def mixture(rows: DataFrame, matrix: DataFrame, p0: DataFrame, steps: int = 100) -> DataFrame:
    """series_id, candidate, rate, loss: the stuck column and rate whose mixture with p0 is nearest the reports' shares.

    The sum over 32 buckets of (q - (1 - r) b0 - r b1) ** 2 is a parabola in r whose three sums are taken first, so
    the grid of rates meets 32 rows per series, not 1024. The least loss of a candidate is at one of the
    four rates about the parabola's lowest point; the rate, the lowest of equals by 12 digits, is looked up on the whole grid
    for the candidate chosen.
    """
    n = rows.groupBy("series_id", F.col("obs").alias("report_bucket")).agg(F.count("*").alias("n"))
    q = p0.join(n, ["series_id", "report_bucket"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    q = q.withColumn("q", F.col("n") / F.sum("n").over(Window.partitionBy("series_id")))
    d, g = F.col("q") - F.col("p0"), F.col("p") - F.col("p0")
    sums = q.join(F.broadcast(matrix), "report_bucket").groupBy("series_id", "stuck_bucket").agg(F.sum(d * d).alias("dd"), F.sum(d * g).alias("dg"), F.sum(g * g).alias("gg"))
    loss = lambda r, of: F.col(f"{of}dd") - 2 * r * F.col(f"{of}dg") + r * r * F.col(f"{of}gg")
    below = F.floor(F.greatest(F.lit(-1.0), F.least(F.lit(float(steps)), (F.coalesce(F.col("dg") / F.nullif(F.col("gg"), F.lit(0.0)), F.lit(0.0)) - F.lit(LOW)) / F.lit((HIGH - LOW) / (steps - 1))))).cast("int")
    sums = sums.withColumn("_below", below)
    near = [rate_at(F.greatest(F.lit(0), F.least(F.lit(steps - 1), F.col("_below") + k)), steps) for k in (-1, 0, 1, 2)]
    least = F.round(F.least(*[loss(r, "") for r in near]), 12)
    best = sums.groupBy("series_id").agg(F.min(F.struct(least.alias("loss"), F.col("stuck_bucket").alias("candidate"), "dd", "dg", "gg")).alias("b"))
    rate = F.get(F.filter(rates(steps), lambda r: F.round(loss(r, "b."), 12) == F.col("b.loss")), F.lit(0))
    return best.select("series_id", "b.candidate", rate.alias("rate"), "b.loss")


def mixture_posterior(rows: DataFrame, matrix: DataFrame, p0: DataFrame, fit: DataFrame) -> DataFrame:
    """score: the fault's share of the mixture at each report."""
    table = p0.join(fit, "series_id").join(F.broadcast(matrix), (F.col("stuck_bucket") == F.col("candidate")) & (matrix["report_bucket"] == p0["report_bucket"]))
    fault, normal = F.col("rate") * F.col("p"), (F.lit(1.0) - F.col("rate")) * F.col("p0")
    table = table.select("series_id", p0["report_bucket"].alias("obs"), (fault / F.greatest(fault + normal, F.lit(1e-15))).alias("score"))
    return rows.join(table, ["series_id", "obs"])


def missing_share(rows: DataFrame, column: str, width: int = 9, least: int = 2) -> DataFrame:
    gone = F.when(F.col(column).isNull(), F.lit(1.0)).otherwise(F.lit(0.0))
    return rows.withColumn("score", F.when(F.count("*").over(centred(width)) >= least, F.avg(gone).over(centred(width))).otherwise(gone))


def subsequence_neighbours(rows: DataFrame, column: str = "x", window: int = 32, k: int = 5, most: int = 512, block: int = 4096) -> DataFrame:
    """series_id, t, score: for each test row the mean distance of its last `window` values to the k nearest such pieces of
    the training part, all z-normalised and then scaled by each place's deviation in training.

    A piece that begins before its part is filled up with the part's first value. Of longer training parts, `most` pieces
    evenly spaced count, so a series' pieces are one array of bounded size, which goes to each block of its test rows.
    """
    part = Window.partitionBy("series_id", "part").orderBy("t")
    rows = rows.where(F.col("part").isin("train", "test")).withColumns({"_seg": F.collect_list(column).over(part.rowsBetween(-(window - 1), 0)), "_i": F.row_number().over(part) - 1})
    full = F.concat(F.array_repeat(F.col("_seg")[0], F.lit(window) - F.size("_seg")), "_seg")
    rows = rows.withColumn("_seg", full)
    mean = F.aggregate("_seg", F.lit(0.0), lambda s, x: s + x) / F.lit(window)
    rows = rows.withColumn("_mean", mean)
    deviation = F.sqrt(F.aggregate("_seg", F.lit(0.0), lambda s, x: s + (x - F.col("_mean")) * (x - F.col("_mean"))) / F.lit(window))
    # written, as else each value's z would be planned with the mean and the deviation in it
    rows = stage.table(rows.withColumn("_dev", F.greatest(deviation, F.lit(1e-6))), "pieces").withColumn("_z", F.transform("_seg", lambda x: (x - F.col("_mean")) / F.col("_dev")))
    train = rows.where("part = 'train'")
    places = train.select("series_id", F.posexplode("_z").alias("place", "z")).groupBy("series_id", "place").agg(F.stddev_pop("z").alias("d"))
    scale = F.when(F.col("d") > 1e-12, F.col("d")).otherwise(F.lit(1.0))
    scales = places.groupBy("series_id").agg(F.array_sort(F.collect_list(F.struct("place", scale.alias("d")))).alias("_s")).select("series_id", F.col("_s.d").alias("_s"))
    n = F.count("*").over(Window.partitionBy("series_id"))
    step = (n - 1) / F.lit(most - 1)
    spaced = (n <= most) | (F.floor(F.ceil(F.col("_i") / step) * step + 1e-9) == F.col("_i"))
    known = train.withColumn("_in", spaced).where("_in").groupBy("series_id").agg(F.collect_list("_z").alias("_known"))
    tests = rows.where("part = 'test'").select(F.col("series_id").cast("long").alias("series_id"), F.col("t").cast("long").alias("t"), "_z", F.floor(F.col("t") / block).alias("blk"))
    # a series' pieces go to each block of its test rows, not to each row
    trained = known.join(scales, "series_id").withColumn("series_id", F.col("series_id").cast("long")).join(tests.select("series_id", "blk").distinct(), "series_id")
    trained = trained.select(F.col("series_id").alias("_own"), F.col("blk").alias("_blk"), "_known", "_s")

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return out.empty_table()
        scale = np.array(right["_s"][0].as_py())
        pieces, z = np.array(right["_known"][0].as_py()) / scale, np.array(left["_z"].to_pylist()) / scale
        few = min(k, len(pieces))
        score = [float(np.sort(np.sqrt(((pieces - row) ** 2).sum(axis=1)))[:few].mean()) for row in z]
        return pa.table([left["series_id"], left["t"], pa.array(score, pa.float64())], schema=out)

    out = pa.schema([("series_id", pa.int64()), ("t", pa.int64()), ("score", pa.float64())])
    found = tests.groupBy("series_id", "blk").cogroup(trained.groupBy("_own", "_blk")).applyInArrow(run, "series_id long, t long, score double")
    return found.withColumn("series_id", F.col("series_id").cast(rows.schema["series_id"].dataType))


def nearest_neighbours(queries: DataFrame, vectors: DataFrame, k: int = 5, block: int = 4096) -> DataFrame:
    """query_id, score: the mean distance of a query to its k nearest rows, itself apart; exact.

    queries and vectors: vec_id, embedding; all of one length. Both are dealt by a hash of their ids into blocks of about
    a fixed number, and each pair of blocks is a group that keeps a query's k nearest. A product of matrices leaves out what
    is farther than its own rounding allows; the rest is measured. Rows without a vector are near nothing, a query
    without one has no score.
    """
    whole = F.col("embedding").isNotNull() & ~F.exists("embedding", lambda x: x.isNull())
    n, m = (max(1, -(-x.count() // block)) for x in (vectors, queries))

    def dealt(rows: DataFrame, own: str, of: int, other: str, others: int) -> DataFrame:
        every = F.explode(F.sequence(F.lit(0), F.lit(others - 1))).alias(other)
        return rows.where(whole).select(F.col("vec_id").cast("long").alias("vec_id"), "embedding", F.pmod(F.xxhash64("vec_id"), F.lit(of)).cast("int").alias(own), every)

    def stacked(table: pa.Table) -> np.ndarray:
        return np.array(table["embedding"].combine_chunks().flatten(), dtype=float).reshape(table.num_rows, -1)

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        ids, x, found = np.array(left["vec_id"]), None, []
        if left.num_rows and right.num_rows:
            x, own, q = stacked(left), np.array(right["vec_id"]), stacked(right)
            lengths = (x * x).sum(axis=1)
            rounding = 1e-15 * (4 + x.shape[1])  # of a square, in shares of both lengths
            for at in range(0, len(q), 256):
                some, names = q[at : at + 256], own[at : at + 256]
                sizes = (some * some).sum(axis=1)
                squares = sizes[:, None] + lengths - 2 * (some @ x.T)
                squares[names[:, None] == ids] = np.inf
                few = min(k, len(x)) - 1
                most = np.partition(squares, few, axis=1)[:, few] + 4 * rounding * (sizes + lengths.max())
                for i, name in enumerate(names):
                    near = np.flatnonzero(~(squares[i] > most[i]) & (ids != name))
                    away = np.sort(np.sqrt(((x[near] - some[i]) ** 2).sum(axis=1)))[:k]
                    found += [(name, d) for d in away]
        names, distances = zip(*found, strict=True) if found else ((), ())
        return pa.table([pa.array(names, pa.int64()), pa.array(distances, pa.float64())], schema=out)

    out = pa.schema([("query_id", pa.int64()), ("distance", pa.float64())])
    pairs = dealt(vectors, "part", n, "of", m).groupBy("part", "of").cogroup(dealt(queries, "of", m, "part", n).groupBy("part", "of"))
    near = pairs.applyInArrow(run, "query_id long, distance double")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("distance"))
    scored = near.withColumn("_n", place).where(F.col("_n") <= k).groupBy("query_id").agg(F.avg("distance").alias("score"))
    return scored.unionByName(queries.where(~whole).select(F.col("vec_id").cast("long").alias("query_id"), F.lit(None).cast("double").alias("score")))
