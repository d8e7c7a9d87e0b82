"""Points in intervals, as an equi-join: an interval stands in at most two bins of a width that fits it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Width of the finest bins, and how much wider each level is than the one below.
FINEST, WIDER = 16, 8


def covered(points: DataFrame, spans: DataFrame, keys: list[str], at: str = "t", begin: str = "begin", end: str = "end") -> DataFrame:
    """The rows of points with the columns of each span that holds them (begin <= at <= end, whole numbers).

    A span is kept at the level whose bins are as wide as it is, so in two bins at most however long it is; a point looks
    into one bin of each level that there is. Levels are few: eight times the length is one more. Spans without an end or
    a begin, or that end before they begin, hold nothing; null keys match nothing; repeated rows count each. A key with
    very many points is dealt over its bins. The join is no broadcast: what comes of a stage table is taken for as small as
    its compressed files are.
    """
    length = F.col(end) - F.col(begin) + 1
    level = F.greatest(F.lit(0), F.ceil(F.log(length.cast("double") / FINEST) / F.log(F.lit(float(WIDER))) - F.lit(1e-9))).cast("int")
    own = spans.where(F.col(begin).isNotNull() & F.col(end).isNotNull() & (F.col(begin) <= F.col(end))).withColumn("_level", level)
    levels = [r[0] for r in own.select("_level").distinct().collect()]
    width = lambda c: (F.pow(F.lit(float(WIDER)), c) * FINEST).cast("long")
    place = lambda x, w: F.floor(x / w)
    bins = F.array_distinct(F.array(place(F.col(begin), width(F.col("_level"))), place(F.col(end), width(F.col("_level")))))
    own = own.withColumn("_bin", F.explode(bins))
    looks = F.explode(F.array(*[F.lit(k) for k in levels]).cast("array<int>"))
    rows = points.withColumn("_level", looks).withColumn("_bin", place(F.col(at), width(F.col("_level"))))
    return rows.join(own.hint("merge"), [*keys, "_level", "_bin"]).where(F.col(at).between(F.col(begin), F.col(end))).drop("_level", "_bin")
