"""Working-day arithmetic as a join with a calendar dimension."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def is_summer_excluded(day):
    """25 December to 15 January."""
    m, d = F.month(day), F.day(day)
    return ((m == 12) & (d >= 25)) | ((m == 1) & (d <= 15))


def calendar(spark: SparkSession, first: str, last: str, holidays: DataFrame | None = None, summer: bool = True) -> DataFrame:
    """Days from ``first`` to ``last`` with ``working`` and ``index``, the number of working days up to and with the day. A century has 36,525 rows, so the running sum may have one partition."""
    days = spark.sql(f"SELECT explode(sequence(DATE '{first}', DATE '{last}')) AS day")
    working = (F.weekday("day") < 5) & (~is_summer_excluded(F.col("day")) if summer else F.lit(True))
    if holidays is not None:
        days = days.join(F.broadcast(holidays.select("day", F.lit(True).alias("holiday")).distinct()), "day", "left")
        working = working & F.col("holiday").isNull()
    days = days.withColumn("working", working)
    return days.select("day", "working", F.sum(F.col("working").cast("int")).over(Window.orderBy("day")).cast("int").alias("index"))


def add_working_days(rows: DataFrame, start: str, days: int, cal: DataFrame, name: str) -> DataFrame:
    """Adds the ``days``-th working day after ``start`` (null if the calendar ends before). ``days`` of 0 is the start itself, working or not."""
    if days == 0:
        return rows.withColumn(name, F.col(start))
    at = cal.select(F.col("day").alias(start), F.col("index").alias("_from"))
    due = cal.filter("working").select((F.col("index") - days).alias("_from"), F.col("day").alias(name))
    return rows.join(F.broadcast(at), start, "left").join(F.broadcast(due), "_from", "left").drop("_from")


def indicative_clock(requests: DataFrame, cal: DataFrame, has_holidays: bool = False, decision_days: int = 20, transfer_days: int = 10) -> DataFrame:
    """Due dates of decision and transfer, how sure they are, and warnings."""
    rows = add_working_days(add_working_days(requests, "first_sent", decision_days, cal, "decision_due"), "first_sent", transfer_days, cal, "transfer_due")
    warnings = F.array_compact(
        F.array(F.when(F.col("first_sent").isNull(), "missing_received_date"), F.lit(None if has_holidays else "holidays_not_supplied").cast("string"), F.when(F.col("decision_due").isNull() & F.col("first_sent").isNotNull(), "calendar_too_short"))
    )
    return rows.withColumn("confidence", F.when(F.col("first_sent").isNull(), 0.0).otherwise(0.62 if has_holidays else 0.42)).withColumn("warnings", warnings)


def response_status(clocked: DataFrame, as_of: str) -> DataFrame:
    """Three-valued answer to whether a request is overdue: an answered one is not, one without dates is unknown."""
    answered = F.col("normalised_state").isin("ReleasedInFull", "ReleasedInPart", "Refused", "NoDocumentsFound", "Withdrawn", "Closed")
    late = F.col("decision_due") < F.lit(as_of).cast("date")
    return clocked.withColumn("overdue_state", F.when(answered, "answered").when(F.col("decision_due").isNull(), "unknown").when(late, "deemed_refusal_candidate").otherwise("within_time"))
