"""Page fixtures with truth, budget files, requests, and generated tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MAX_REQUEST_BYTES = 2 * 1024 * 1024


def load_pages(spark: SparkSession, folder: str) -> DataFrame:
    """(id, html) of every <id>.html in a folder that Spark reads."""
    pages = spark.read.text(f"{folder}/*.html", wholetext=True)
    return pages.select(F.regexp_extract(F.input_file_name(), r"([^/]+)\.html$", 1).alias("id"), F.col("value").alias("html"))


def load_fixtures(spark: SparkSession, folder: str) -> DataFrame:
    """Pages with `truth`, the JSON of <id>.truth.json; reading fails where a page has none or names another id."""
    truth = spark.read.text(f"{folder}/*.truth.json", wholetext=True)
    truth = truth.select(F.regexp_extract(F.input_file_name(), r"([^/]+)\.truth\.json$", 1).alias("id"), F.col("value").alias("truth"))
    met = load_pages(spark, folder).join(truth, "id", "left")
    own = F.coalesce(F.get_json_object("truth", "$.id") == F.col("id"), F.lit(False))
    return met.withColumn("truth", F.when(own, F.col("truth")).otherwise(F.raise_error(F.concat(F.lit("no truth for "), "id")).cast("string")))


def resolve_truth(truth: DataFrame, nodes: DataFrame) -> DataFrame:
    """Truth items (page_id, truth_id, path, ...) whose path must be an element's; reading fails otherwise."""
    known = nodes.select("page_id", "path", F.lit(True).alias("there"))
    met = truth.join(known, ["page_id", "path"], "left")
    return met.withColumn("path", F.when(F.col("there"), F.col("path")).otherwise(F.raise_error(F.concat(F.lit("no element at "), F.col("path"))).cast("string"))).drop("there")


def budgets(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.json(path, multiLine=True)


def check_budgets(measured: DataFrame, limits: DataFrame, tolerance: float = 4.0) -> DataFrame:
    """Measurements (label, ms, mb) over their limits (label, max_ms, max_mb) times the tolerance."""
    met = measured.join(limits, "label")
    return met.where((F.col("ms") > F.col("max_ms") * tolerance) | (F.col("mb") > F.col("max_mb") * tolerance))


def request_body(*columns: str) -> Column:
    """JSON of the columns; null beyond the size that a request may have."""
    body = F.to_json(F.struct(*columns))
    return F.when(F.octet_length(body) <= MAX_REQUEST_BYTES, body)


def stamp_rects(nodes: DataFrame, boxes: DataFrame) -> DataFrame:
    """Elements with the rectangle of the live element of the same number, outwards to whole pixels; `unrendered` without one."""
    b = boxes.select("page_id", "node_ord", F.floor("x").alias("x0"), F.floor("y").alias("y0"), F.ceil(F.col("x") + F.col("width")).alias("x1"), F.ceil(F.col("y") + F.col("height")).alias("y1"))
    met = nodes.join(b, ["page_id", "node_ord"], "left")
    rect = F.when(F.col("x0").isNotNull(), F.concat_ws(",", "x0", "y0", F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")))
    return met.withColumns({"rect": rect, "unrendered": F.col("x0").isNull()}).drop("x0", "y0", "x1", "y1")


def telemetry(spark: SparkSession, rows: int, seed: int = 7) -> DataFrame:
    """A seeded flight log: rising altitude, a speed that follows it, falling fuel, flat temperature with spikes, noise, gaps and contacts."""
    u = lambda k: F.pmod(F.xxhash64("id", F.lit(seed), F.lit(k)), F.lit(1 << 30)) / float(1 << 30)
    t = F.col("id").cast("double")
    span = float(max(rows, 1))
    some = lambda k, v: F.when(u(k) > 0.025, F.format_string("%.2f", v)).otherwise("")
    altitude = t / span * 40_000 + u("a") * 400
    return spark.range(rows).select(
        F.col("id").alias("sample"), F.format_string("%.1f", t / 10).alias("time_s"), some("m1", altitude).alias("altitude_m"), some("m2", altitude / 50 + u("v") * 20).alias("velocity_ms"), some("m3", F.lit(101.0) * F.exp(-altitude / 8000)).alias("pressure_kpa"),
        some("m4", 21 + u("t") + F.when(u("s") > 0.995, 60).otherwise(0)).alias("temperature_c"), some("m5", 27.5 + u("w")).alias("voltage_v"), some("m6", 100 - t / span * 80).alias("fuel_pct"),
        F.concat(F.lit("Operator "), (F.floor(u("o") * 26) + 1).cast("string")).alias("operator"), F.concat(F.lit("op"), F.floor(u("o") * 26).cast("string"), F.lit("@example.org")).alias("contact"),
    )
