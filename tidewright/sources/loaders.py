"""Readers of public sensor data sets: each gives series_id, ts (or t) and value, with the source's own missing marks
as nulls. Paths may be files, folders or globs that Spark can open; nothing is fetched."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewright.operators.selection import relevance

#: Flags of a sea-level record, and numbers that stand for missing.
GOOD, OUT_OF_RANGE, SPIKE, STUCK, METADATA, MISSING = 1, 2, 4, 5, 7, 8
SENTINELS = (-99999.0, -9999.0, -999.0, -888.0, -200.0, 1e20, -1e20)


def number(column: str | Column, decimal: str = ".") -> Column:
    """A double, or null for what isn't one."""
    c = F.col(column) if isinstance(column, str) else column
    return (F.regexp_replace(c, ",", ".") if decimal == "," else c).try_cast("double")


def known(value: Column, sentinels: tuple[float, ...] = SENTINELS) -> Column:
    return F.when(value.isin(*sentinels) | F.isnan(value), None).otherwise(value)


def csv(spark: SparkSession, path: str, sep: str = ",") -> DataFrame:
    """All columns as text: types are given where they are used."""
    return spark.read.option("header", True).option("sep", sep).option("inferSchema", False).csv(path)


def air_quality(spark: SparkSession, path: str, target: str = "C6H6(GT)") -> DataFrame:
    """Semicolons, decimal commas, day first, -200 for missing."""
    rows = csv(spark, path, ";")
    ts = F.try_to_timestamp(F.concat_ws(" ", "Date", "Time"), F.lit("dd/MM/yyyy HH.mm.ss"))
    return rows.select(F.lit("air_quality").alias("series_id"), ts.alias("ts"), known(number(F.col(f"`{target}`"), ",")).alias("value")).where("ts is not null")


def household_power(spark: SparkSession, path: str, every: int = 60) -> DataFrame:
    """Semicolons, ? for missing; every 60th row in the order of time."""
    rows = csv(spark, path, ";")
    ts = F.try_to_timestamp(F.concat_ws(" ", "Date", "Time"), F.lit("d/M/yyyy HH:mm:ss"))
    rows = rows.select(F.lit("household_power").alias("series_id"), ts.alias("ts"), number("Global_active_power").alias("value")).where("ts is not null")
    # minutes since the first row stand for the place in a file without gaps, and need no global order
    first = rows.agg(F.min("ts").alias("first"))
    minutes = F.expr("timestampdiff(MINUTE, first, ts)")
    return rows.crossJoin(F.broadcast(first)).where(minutes % every == 0).drop("first")


def bike_sharing(spark: SparkSession, path: str) -> DataFrame:
    ts = F.to_timestamp("dteday") + F.make_dt_interval(hours=F.col("hr").cast("int"))
    return csv(spark, path).select(F.lit("bike_sharing").alias("series_id"), ts.alias("ts"), number("cnt").alias("value"))


def beijing_air(spark: SparkSession, path: str) -> DataFrame:
    parts = [F.col(c).cast("int") for c in ("year", "month", "day", "hour")]
    return csv(spark, path).select(F.lit("beijing_air").alias("series_id"), F.make_timestamp(*parts, F.lit(0), F.lit(0.0)).alias("ts"), number(F.col("`PM2.5`")).alias("value"))


def timestamped(spark: SparkSession, path: str) -> DataFrame:
    """timestamp and value; the series is the file's name."""
    rows = csv(spark, path).withColumn("series_id", F.element_at(F.split(F.input_file_name(), "/"), -1))
    return rows.select("series_id", F.try_to_timestamp("timestamp").alias("ts"), number("value").alias("value"))


def label_windows(spark: SparkSession, path: str) -> DataFrame:
    """A JSON object of file name to [[begin, end], ...]: series_id, begin, end."""
    rows = spark.read.text(path, wholetext=True).select(F.from_json("value", "map<string, array<array<string>>>").alias("m"))
    rows = rows.select(F.explode("m").alias("series_id", "windows")).select("series_id", F.explode("windows").alias("w"))
    return rows.select(F.element_at(F.split("series_id", "/"), -1).alias("series_id"), F.to_timestamp(F.col("w")[0]).alias("begin"), F.to_timestamp(F.col("w")[1]).alias("end"))


def inside_windows(rows: DataFrame, windows: DataFrame) -> DataFrame:
    """label 1 for rows within a window of their series: an equal join with a range condition, a row once."""
    hit = rows.join(windows, "series_id").where("ts between begin and end").select("series_id", "ts").distinct().withColumn("label", F.lit(1))
    return rows.join(hit, ["series_id", "ts"], "left").fillna(0, ["label"])


def gas_drift(spark: SparkSession, path: str, feature: int = 1) -> DataFrame:
    """Sparse "label index:value ..." lines of batch files; one feature."""
    rows = spark.read.text(path).withColumn("batch", F.regexp_extract(F.input_file_name(), r"batch(\d+)", 1).cast("int"))
    return rows.select("batch", F.split("value", "[ ;]")[0].alias("label"), number(F.regexp_extract("value", rf"(?:^|\s){feature}:(\S+)", 1)).alias("value")).where("value is not null")


def with_units_row(spark: SparkSession, path: str, begin: str | None = None, end: str | None = None) -> DataFrame:
    """CSV whose second row has units: rows without a parsable time are left out.

    begin, end (exclusive): ISO times; as such texts are in the order of time, the bounds go down to the CSV reader.
    """
    rows = csv(spark, path)
    if begin is not None:
        rows = rows.where(F.col("time") >= begin)
    if end is not None:
        rows = rows.where(F.col("time") < end)
    return rows.where(F.try_to_timestamp("time").isNotNull()).withColumn("ts", F.try_to_timestamp("time"))


def flag_bits(flags: Column, width: int = 4) -> Column:
    """Comma-separated bits, padded with zeros."""
    parts = F.split(F.coalesce(flags, F.lit("")), ",")
    return F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda i: F.coalesce(F.get(parts, i).try_cast("int"), F.lit(0)))


def water_levels(spark: SparkSession, path: str) -> DataFrame:
    """JSON with data: [{t, v, s, f, q}]; the second flag is that of a flat line."""
    rows = spark.read.option("multiLine", True).schema("data array<struct<t string, v string, s string, f string, q string>>").json(path)
    rows = rows.select(F.explode("data").alias("d"))
    return rows.select(F.to_timestamp("d.t").alias("ts"), number("d.v").alias("value"), flag_bits(F.col("d.f"))[1].alias("label"), F.col("d.q").alias("quality"))


def flag_counts(rows: DataFrame, column: str = "quality") -> DataFrame:
    """One row: counts by value as JSON, in the order of values."""
    counted = rows.groupBy(column).agg(F.count("*").alias("n"))
    return counted.agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.coalesce(F.col(column).cast("string"), F.lit("")), "n"))))).alias("counts"))


def cdl(spark: SparkSession, path: str) -> DataFrame:
    """A text dump of arrays: file, variable, place, value (null for _)."""
    rows = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.element_at(F.split("value", r"(?m)^data:"), -1).alias("data"))
    statements = rows.select("file", F.explode(F.split("data", ";")).alias("s")).where(F.contains("s", F.lit("=")))
    parts = statements.select("file", F.trim(F.regexp_extract("s", r"(?s)^\s*([A-Za-z_]\w*)\s*=", 1)).alias("variable"), F.regexp_extract("s", r"(?s)=\s*(.*)$", 1).alias("values"))
    return parts.select("file", "variable", F.posexplode(F.split(F.trim("values"), r"\s*,\s*")).alias("place", "v")).select("file", "variable", "place", number(F.col("v")).alias("value"))


def dimensions(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.split("value", r"(?m)^variables:")[0].alias("head"))
    found = F.regexp_extract_all("head", F.lit(r"(\w+\s*=\s*\d+)\s*;"), 1)
    rows = rows.select("file", F.explode(found).alias("d"))
    return rows.select("file", F.trim(F.split("d", "=")[0]).alias("dimension"), F.trim(F.split("d", "=")[1]).cast("long").alias("size"))


def codes(spark: SparkSession, path: str) -> DataFrame:
    """Lines of code=description; blanks in a row are one."""
    rows = spark.read.text(path).where(F.contains("value", F.lit("=")))
    return rows.select(F.trim(F.split("value", "=", 2)[0]).alias("code"), F.trim(F.regexp_replace(F.split("value", "=", 2)[1], r"\s+", " ")).alias("description"))


def fail_summary(spark: SparkSession, path: str, tests: int = 71) -> DataFrame:
    """Lines of a number and a code, eight counts of stations and eight percentages: index, code, ordered (whether it is one
    of the tests' own columns), counts, percentages."""
    line = r"^\s*(\d+)([A-Z_]+)\s+(.*)$"
    rows = spark.read.text(path).where(F.col("value").rlike(line))
    rest = F.split(F.trim(F.regexp_extract("value", line, 3)), r"\s+")
    index = F.regexp_extract("value", line, 1).cast("int")
    counts, shares = F.transform(F.slice(rest, 1, 8), lambda x: x.try_cast("int")), F.transform(F.slice(rest, 9, 8), lambda x: x.try_cast("double"))
    return rows.select(index.alias("index"), F.regexp_extract("value", line, 2).alias("code"), (index < tests).alias("ordered"), counts.alias("counts"), shares.alias("percentages"))


def manual_flags(spark: SparkSession, path: str) -> DataFrame:
    """Intervals t0, t1, variable, flag, comment; lines that begin with # don't count. hours: their length."""
    rows = spark.read.option("header", True).option("comment", "#").csv(path)
    begin, end = F.try_to_timestamp("t0"), F.try_to_timestamp("t1")
    kind = relevance(F.concat_ws(" ", "comment", "variable", "flag"))
    return rows.select(begin.alias("begin"), end.alias("end"), F.split("variable", r"[\s|;]+").alias("variables"), "flag", "comment", kind.alias("kind"), ((F.unix_timestamp(end) - F.unix_timestamp(begin)) / 3600.0).alias("hours"))


def size_mb(text: Column) -> Column:
    """"12K", "3.5M", "1G" or bytes, in megabytes."""
    value, unit = number(F.regexp_extract(text, r"([\d.]+)", 1)), F.upper(F.regexp_extract(text, r"[\d.]+\s*([KMGkmg])", 1))
    return value * F.when(unit == "K", 1 / 1024).when(unit == "M", 1.0).when(unit == "G", 1024.0).otherwise(1 / 1048576)


def inventory(spark: SparkSession, path: str) -> DataFrame:
    """File, bytes and time of every file; contents are not read."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return rows.select(F.col("path").alias("file"), F.col("length").alias("bytes"), F.col("modificationTime").alias("modified"))


def backfill(months: DataFrame, at: str, least: int = 100, most: int = 12) -> DataFrame:
    """months: month (date), n. Those before `at`, newest first, up to and with the one that brings the sum to `least`."""
    rows = months.where((F.col("month") < F.lit(at).cast("date")) & (F.col("month") >= F.add_months(F.lit(at).cast("date"), -most)))
    before = F.coalesce(F.sum("n").over(Window.orderBy(F.desc("month")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # twelve rows at most
    return rows.withColumn("_before", before).where(F.col("_before") < least).drop("_before")


def write_csv(rows: DataFrame, path: str, columns: list[str]) -> None:
    """Fixed column order, a header also where there are no rows."""
    rows.select(*columns).write.mode("overwrite").option("header", True).csv(path)


#: Streams by name: the reader and the file or folder that it takes, below a common folder.
STREAMS = {"air_quality": (air_quality, "AirQualityUCI.csv"), "household_power": (household_power, "household_power_consumption.txt"), "bike_sharing": (bike_sharing, "hour.csv"), "beijing_air": (beijing_air, "PRSA_data.csv"), "timestamped": (timestamped, "timestamped")}


def streams(spark: SparkSession, folder: str, names: tuple[str, ...] = tuple(STREAMS)) -> DataFrame:
    """All streams that are there as one table (series_id, ts, value); files that aren't are left out."""
    found = spark.createDataFrame([], "series_id string, ts timestamp, value double")
    for name in names:
        reader, file = STREAMS[name]
        path = f"{folder.rstrip('/')}/{file}"
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        if where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
            found = found.unionByName(reader(spark, path).select("series_id", F.col("ts").cast("timestamp").alias("ts"), "value"))
    return found


def config(spark: SparkSession, path: str, prefix: str = "tidewright.") -> dict:
    """A JSON document's values by dotted name, with those of the session's settings under the prefix in their place."""
    import json

    def flat(value, name: str) -> dict:
        if isinstance(value, dict):
            return {k: v for key, own in value.items() for k, v in flat(own, f"{name}.{key}" if name else key).items()}
        return {name: value}

    text = "\n".join(r.value for r in spark.read.option("wholetext", True).text(path).collect())  # one small file
    found = flat(json.loads(text), "")
    for key in found:
        if (own := spark.conf.get(prefix + key, None)) is not None:
            found[key] = own if isinstance(found[key], str) else json.loads(own)
    return found


def read_results(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A result table that write_csv left, with its columns in any order; an empty field is null."""
    rows = csv(spark, path)
    fields = [x.strip().rsplit(" ", 1) for x in schema.split(",")]
    return rows.select(*[F.nullif(F.col(f"`{n}`"), F.lit("")).try_cast(t).alias(n) for n, t in fields])


def write_document(row: DataFrame, path: str) -> None:
    """A summary of one row as a JSON document, nulls included."""
    row.limit(1).coalesce(1).write.mode("overwrite").option("ignoreNullFields", False).json(path)
