"""Record files: JSON lines, JSON documents, calendars."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_jsonl(spark: SparkSession, paths: str | list[str], schema: T.StructType) -> DataFrame:
    """One object per line; blank lines are skipped, and a line that is no object of this schema is an error. Adds ``input_file``."""
    lines = spark.read.text(paths).filter(F.trim("value") != "").select("value", F.col("_metadata.file_path").alias("input_file"))
    parsed = F.when(F.substring(F.trim("value"), 1, 1) == "{", F.from_json("value", schema, {"mode": "FAILFAST"}))
    bad = F.raise_error(F.concat(F.lit("a line is no JSON object: "), F.col("input_file"))).cast("string")
    rows = lines.select(parsed.alias("r"), "input_file")
    return rows.select(F.when(F.col("r").isNull(), bad).otherwise(F.col("input_file")).alias("input_file"), "r.*")


def read_records(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A JSON array, an object with an array ``records``, a single object, or JSON lines. Array items that are no objects are dropped."""
    whole = spark.read.text(path, wholetext=True).select(F.trim("value").alias("value"))
    first = F.substring("value", 1, 1)
    items = F.from_json("value", T.ArrayType(T.StringType()))
    wrapped = F.from_json("value", T.StructType([T.StructField("records", T.ArrayType(T.StringType()))]))["records"]
    lines = F.filter(F.split("value", "\n"), lambda x: F.trim(x) != "")
    each = F.forall(lines, lambda x: F.startswith(F.trim(x), F.lit("{")) & F.try_parse_json(x).isNotNull())
    texts = F.when(first == "[", items).when(wrapped.isNotNull(), wrapped).when((F.size(lines) > 1) & each, lines).otherwise(F.array("value"))
    return whole.select(F.explode(texts).alias("item")).filter(F.substring(F.trim("item"), 1, 1) == "{").select(F.from_json("item", schema).alias("r")).select("r.*")


def holiday_calendar(spark: SparkSession, path: str) -> DataFrame:
    """Dates of a calendar document; an observed date stands before the date itself."""
    day = T.StructType([T.StructField("name", T.StringType()), T.StructField("date", T.StringType()), T.StructField("observed_date", T.StringType())])
    whole = spark.read.text(path, wholetext=True)
    parsed = F.from_json("value", T.StructType([T.StructField("dates", T.ArrayType(day)), T.StructField("holidays", T.ArrayType(day))]))
    days = whole.select(F.explode(F.coalesce(parsed["dates"], parsed["holidays"])).alias("d"))
    return days.select(F.to_date(F.coalesce("d.observed_date", "d.date")).alias("day"), F.col("d.name").alias("name")).filter("day IS NOT NULL")


def input_counts(records: DataFrame) -> DataFrame:
    """Records per input file of a multi-file read."""
    return records.groupBy("input_file").agg(F.count("*").alias("records"))
