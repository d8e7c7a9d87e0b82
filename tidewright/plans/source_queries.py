"""Named queries of the readers and sinks: events are written in a source's own format by Spark and read back."""

from __future__ import annotations

from collections.abc import Callable
from uuid import uuid4

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewright import stage
from tidewright.operators import detectors as D
from tidewright.plans.series_queries import Query, Series, scored
from tidewright.sources import loaders as L
from tidewright.sources import telemetry
from tidewright.streaming import incremental

TIME = "yyyy-MM-dd HH:mm:ss"
#: One value in so many is missing; users of a dump file and of a document of windows; bounds that a reader is given.
GONE, TOGETHER, LISTED, BEGIN, END = 13, 16, 1024, "2024-01-05T00:00:00Z", "2024-01-20T00:00:00Z"
#: Codes of tests with their descriptions, and the months' sum that a calibration needs.
CODES = {"DUP": "duplicate   check", "HTS": "straight strings", "FVS": "frequent values"}
NEEDED, FIRST = 500, "2024-01-22"


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = telemetry.table(spark, sf_dir, "events")
    return rows.withColumns({"ts": F.date_trunc("second", F.col("ts").cast("timestamp")), "gone": F.col("event_id") % GONE == 0})


def folder(spark: SparkSession, name: str) -> str:
    return f"{stage.folder(spark).rstrip('/')}/{name}-{uuid4().hex}"


def at(form: str) -> Column:
    return F.date_format("ts", form)


def csv_of(rows: DataFrame, name: str, sep: str = ",") -> str:
    path = folder(rows.sparkSession, name)
    rows.write.option("header", True).option("sep", sep).csv(path)
    return path


def shown(rows: DataFrame, *more: str) -> DataFrame:
    return rows.select(F.date_format("ts", TIME).alias("ts"), "value", *more)


def air_quality(spark: SparkSession, d: str) -> DataFrame:
    value = F.when(F.col("gone"), "-200").otherwise(F.translate(F.col("value").cast("string"), ".", ","))
    return shown(L.air_quality(spark, csv_of(events(spark, d).select(at("dd/MM/yyyy").alias("Date"), at("HH.mm.ss").alias("Time"), value.alias("C6H6(GT)")), "air", ";")))


def household_power(spark: SparkSession, d: str) -> DataFrame:
    value = F.when(F.col("gone"), "?").otherwise(F.col("value").cast("string"))
    rows = events(spark, d).withColumn("ts", F.date_trunc("minute", "ts"))
    return shown(L.household_power(spark, csv_of(rows.select(at("d/M/yyyy").alias("Date"), at("HH:mm:ss").alias("Time"), value.alias("Global_active_power")), "power", ";")))


def bike_sharing(spark: SparkSession, d: str) -> DataFrame:
    return shown(L.bike_sharing(spark, csv_of(events(spark, d).select(at("yyyy-MM-dd").alias("dteday"), at("H").alias("hr"), (F.col("event_id") % 1000).alias("cnt")), "bikes")))


def beijing_air(spark: SparkSession, d: str) -> DataFrame:
    value = F.when(F.col("gone"), "NA").otherwise(F.col("value").cast("string"))
    return shown(L.beijing_air(spark, csv_of(events(spark, d).select(at("y").alias("year"), at("M").alias("month"), at("d").alias("day"), at("H").alias("hour"), value.alias("PM2.5")), "beijing")))


def timestamped(spark: SparkSession, d: str) -> DataFrame:
    return shown(L.timestamped(spark, csv_of(events(spark, d).select(at(TIME).alias("timestamp"), F.when(~F.col("gone"), F.col("value")).alias("value")), "nab")))


def inside_windows(spark: SparkSession, d: str) -> DataFrame:
    """Events of a user within windows that a JSON document gives: the first hour of each fifth day, for every third user."""
    rows = events(spark, d).select(F.concat(F.lit("user"), "user_id").alias("series_id"), "user_id", "ts")
    hours = rows.where("user_id % 3 = 0 and day(ts) % 5 = 0").select("series_id", F.date_trunc("day", "ts").alias("b")).distinct()
    spans = hours.groupBy("series_id").agg(F.array_sort(F.collect_list(F.array(F.date_format("b", TIME), F.date_format(F.col("b") + F.expr("interval 1 hour"), TIME)))).alias("w"))
    documents = spans.groupBy(F.floor(F.substring("series_id", 5, 20).cast("long") / LISTED).alias("document")).agg(F.map_from_entries(F.collect_list(F.struct(F.concat(F.lit("real/"), "series_id"), "w"))).alias("m"))
    path = folder(spark, "windows")
    documents.select(F.to_json("m")).write.option("maxRecordsPerFile", 1).text(path)
    return L.inside_windows(rows, L.label_windows(spark, path)).groupBy("series_id").agg(F.count("*").alias("n"), F.sum("label").alias("inside"))


def gas_drift(spark: SparkSession, d: str) -> DataFrame:
    base = folder(spark, "gas")
    rows = events(spark, d)
    for k in (1, 2, 3):
        own = rows.where((F.col("event_id") % 3 + 1) == k)
        own.select(F.concat((F.col("user_id") % 6 + 1).cast("string"), F.when(F.col("gone"), "").otherwise(F.concat(F.lit(" 1:"), F.col("value").cast("string"))), F.lit(" 2:0.5"))).write.text(f"{base}/batch{k}")
    return L.gas_drift(spark, f"{base}/batch*")


def dumped(spark: SparkSession, d: str) -> str:
    """A text dump of arrays for every TOGETHER users, each a file of its own."""
    rows = events(spark, d).withColumn("dump", F.floor(F.col("user_id") / TOGETHER))
    rows = rows.groupBy("dump").agg(F.sort_array(F.collect_list(F.struct("event_id", F.when(F.col("gone"), "_").otherwise(F.col("value").cast("string")).alias("v")))).alias("x"))
    join = lambda c: F.array_join(c, ", ")
    text = F.concat(F.lit("netcdf x {\ndimensions:\n\ttime = "), F.size("x").cast("string"), F.lit(" ;\n\ttest = 71 ;\nvariables:\n\tdouble value(time) ;\ndata:\n\n id = "), join(F.col("x.event_id").cast("array<string>")), F.lit(" ;\n\n value = "), join(F.col("x.v")), F.lit(" ;\n}"))
    path = folder(spark, "dumps")
    rows.select("dump", text.alias("text")).repartition("dump").write.partitionBy("dump").text(path)
    return path


def dump() -> Column:
    return F.regexp_extract("file", r"dump=(\d+)", 1).cast("long").alias("dump")


def arrays(spark: SparkSession, d: str) -> DataFrame:
    return L.cdl(spark, dumped(spark, d)).select(dump(), "variable", "place", "value")


def dimensions(spark: SparkSession, d: str) -> DataFrame:
    return L.dimensions(spark, dumped(spark, d)).select(dump(), "dimension", "size")


def codes(spark: SparkSession, d: str) -> DataFrame:
    """The codes' descriptions with the events of their types."""
    path, names = folder(spark, "codes"), F.array(*map(F.lit, CODES))
    counts = events(spark, d).withColumn("code", F.element_at(names, (F.col("event_id") % len(CODES) + 1).cast("int"))).groupBy("code").agg(F.count("*").alias("n"))
    described = F.element_at(F.create_map(*[F.lit(x) for pair in CODES.items() for x in pair]), F.col("code"))
    counts.select(F.concat(F.lit(" "), "code", F.lit(" = "), described, F.lit("  "), F.col("n").cast("string"))).write.text(path)
    return L.codes(spark, path)


def fail_summary(spark: SparkSession, d: str) -> DataFrame:
    """Counts of users and their percentages by share of failing events, in eight bins, for each code."""
    path, names = folder(spark, "fails"), F.array(*map(F.lit, CODES))
    per = events(spark, d).withColumn("place", (F.col("event_id") % len(CODES)).cast("int")).groupBy("place", "user_id").agg(F.least(F.lit(7), F.floor(F.avg(F.col("gone").cast("int")) * 16)).alias("bin"))
    bins = per.groupBy("place").agg(*[F.count_if(F.col("bin") == k).alias(f"b{k}") for k in range(8)], F.count("*").alias("n"))
    numbers = [F.col(f"b{k}").cast("string") for k in range(8)] + [F.format_string("%.1f", F.col(f"b{k}") * F.lit(100.0) / F.col("n")) for k in range(8)]
    bins.select(F.concat(F.lit("  "), (F.col("place") * 40).cast("string"), F.element_at(names, F.col("place") + 1), F.lit("   "), F.concat_ws("  ", *numbers))).write.text(path)
    return L.fail_summary(spark, path).select("index", "code", "ordered", F.array_join("counts", ",").alias("counts"), F.aggregate("percentages", F.lit(0.0), lambda s, x: s + x).alias("total"))


def units_row(spark: SparkSession, d: str) -> DataFrame:
    rows = events(spark, d).select(at("yyyy-MM-dd'T'HH:mm:ss'Z'").alias("time"), F.col("value").cast("string").alias("value"))
    path = csv_of(rows.unionByName(rows.limit(1).select(F.lit("UTC").alias("time"), F.lit("m").alias("value"))), "levels")
    return shown(L.with_units_row(spark, path, BEGIN, END).withColumn("value", L.number("value")))


def documents(spark: SparkSession, d: str) -> str:
    """JSON documents of water levels, one for each user, those of TOGETHER users in a file."""
    rows = events(spark, d)
    value = F.when(F.col("gone"), "").otherwise(F.col("value").cast("string"))
    item = F.struct(at("yyyy-MM-dd HH:mm:ss").alias("t"), value.alias("v"), F.lit("").alias("s"), F.concat(F.lit("0,"), (F.col("event_id") % 2).cast("string")).alias("f"), F.when(F.col("user_id") % 2 == 0, "p").otherwise("v").alias("q"))
    per = rows.groupBy("user_id").agg(F.to_json(F.struct(F.collect_list(item).alias("data"))).alias("doc")).withColumn("dump", F.floor(F.col("user_id") / TOGETHER))
    path = folder(spark, "water")
    per.groupBy("dump").agg(F.concat(F.lit("["), F.array_join(F.collect_list("doc"), ","), F.lit("]")).alias("text")).repartition("dump").write.partitionBy("dump").text(path)
    return path


def water_levels(spark: SparkSession, d: str) -> DataFrame:
    return shown(L.water_levels(spark, documents(spark, d)), "label", "quality")


def flag_counts(spark: SparkSession, d: str) -> DataFrame:
    return L.flag_counts(L.water_levels(spark, documents(spark, d)))


def results(spark: SparkSession, d: str) -> DataFrame:
    """A result table with nulls, written in a fixed order of columns and read in another."""
    path = folder(spark, "results")
    runs = events(spark, d).groupBy("user_id").agg(F.count("*").alias("n"), F.max(F.when(~F.col("gone"), F.col("value"))).alias("best"), F.max(F.when(F.col("event_type") == "error", "error")).alias("kind"))
    L.write_csv(runs, path, ["kind", "n", "user_id", "best"])
    return L.read_results(spark, path, "user_id long, best double, kind string, n long")


def summary(spark: SparkSession, d: str) -> DataFrame:
    """A summary of one row as a JSON document, read back with its nulls."""
    path = folder(spark, "summary")
    L.write_document(events(spark, d).agg(F.count("*").alias("n"), F.max("value").alias("highest"), F.max(F.when(F.col("event_id") < 0, "none")).alias("note")), path)
    return spark.read.schema("n long, highest double, note string").json(path)


def sizes(spark: SparkSession, d: str) -> DataFrame:
    """Sizes of texts as a listing shows them, in megabytes."""
    n = F.col("n_chars")
    shown = F.when(n % 3 == 0, F.concat(n.cast("string"), F.lit("K"))).when(n % 3 == 1, F.concat(F.format_string("%.1f", n / 10.0), F.lit(" M"))).otherwise(n.cast("string"))
    return telemetry.table(spark, d, "documents").select("doc_id", F.round(L.size_mb(shown), 9).alias("mb"))


def backfilled(spark: SparkSession, d: str) -> DataFrame:
    """The days before one whose events are enough for a calibration, newest first."""
    days = events(spark, d).groupBy(F.to_date("ts").alias("month")).agg(F.count("*").alias("n"))
    return L.backfill(days, FIRST, NEEDED).select(F.date_format("month", "yyyy-MM-dd").alias("day"), "n")


def streams(spark: SparkSession, d: str) -> DataFrame:
    """Two streams of a folder as one table; those that aren't there are left out."""
    base, rows = folder(spark, "streams"), events(spark, d)
    rows.select(at("yyyy-MM-dd").alias("dteday"), at("H").alias("hr"), (F.col("event_id") % 1000).alias("cnt")).write.option("header", True).csv(f"{base}/hour.csv")
    rows.select(at("y").alias("year"), at("M").alias("month"), at("d").alias("day"), at("H").alias("hour"), F.col("value").alias("PM2.5")).write.option("header", True).csv(f"{base}/PRSA_data.csv")
    return shown(L.streams(spark, base), "series_id")


def maintained(spark: SparkSession, d: str, aggregate: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The state of an aggregate after a stream of reports, in files of about a third each."""
    base = folder(spark, "stream")
    telemetry.reports(telemetry.table(spark, d, "events")).select(*[x.split(" ")[0] for x in incremental.REPORTS.split(", ")]).repartition(3).write.parquet(f"{base}/reports")
    query = incremental.maintain(aggregate(incremental.source(spark, f"{base}/reports")), base)
    query.awaitTermination()
    return spark.read.parquet(f"{base}/state/{query.lastProgress['batchId']}")


SOURCES: dict[str, Query] = {
    "s8_air_quality": air_quality, "s9_household_power": household_power, "s10_bike_sharing": bike_sharing, "s11_beijing_air": beijing_air, "s12_timestamped": timestamped, "s13_gas_drift": gas_drift,
    "s14_streams": streams, "s15_inside_windows": inside_windows, "s17_arrays": arrays, "s17_dimensions": dimensions, "s18_codes": codes, "s18_fail_summary": fail_summary, "s20_units_row": units_row,
    "s22_water_levels": water_levels, "a28_flag_counts": flag_counts, "s26_sizes": sizes, "s29_results": results, "k3_summary": summary, "j16_backfill": backfilled,
    "st10_ledger": lambda spark, d: maintained(spark, d, incremental.ledger), "st12_device_counts": lambda spark, d: maintained(spark, d, incremental.device_counts),
    "d21_spike": lambda spark, d: scored(D.spike(Series(spark, d).clean, "v")),
}
QUERIES = SOURCES
