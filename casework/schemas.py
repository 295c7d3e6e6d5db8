"""Schemas of the model and the contract check: Spark does not enforce keys, so a query does."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

RAW_RECORD = T.StructType(
    [T.StructField(n, T.StringType()) for n in ("request_id", "id", "url_title", "title", "authority", "public_body", "state", "source_state", "first_sent", "sent_at", "created_at", "source_url", "description", "content_sha256")]
    + [T.StructField("attachments", T.ArrayType(T.MapType(T.StringType(), T.StringType())))]
)
REQUEST = T.StructType([T.StructField(n, T.StringType(), n not in ("request_id", "normalised_state")) for n in ("request_id", "authority", "source_state", "normalised_state")])
EVENT = T.StructType([T.StructField(n, T.StringType(), n not in ("event_id", "event_type")) for n in ("event_id", "request_id", "event_type", "lifecycle_state_after", "assertion_status")])
STATUSES = ["observed", "inferred", "asserted", "certified", "unknown"]


def contract_check(rows: DataFrame, schema: T.StructType, key: str, enums: dict[str, list[str]] | None = None) -> DataFrame:
    """Violations as ``violation, n``: missing columns, nulls where none may be, repeated keys, values outside an enumeration."""
    missing = [f.name for f in schema if f.name not in rows.columns]
    spark = rows.sparkSession
    parts = [spark.createDataFrame([(f"missing_column:{c}", 1) for c in missing], "violation string, n long")]
    checks = [F.count_if(F.col(f.name).isNull()).alias(f"null:{f.name}") for f in schema if not f.nullable and f.name in rows.columns]
    checks += [F.count_if(~F.col(c).isin(vs)).alias(f"enum:{c}") for c, vs in (enums or {}).items() if c in rows.columns]
    if checks:
        wide = rows.agg(*checks)
        parts.append(wide.select(F.explode(F.array(*(F.struct(F.lit(c).alias("violation"), F.col(f"`{c}`").alias("n")) for c in wide.columns))).alias("x")).select("x.*"))
    if key in rows.columns:
        parts.append(rows.groupBy(key).agg(F.count("*").alias("c")).filter("c > 1").agg(F.lit(f"duplicate:{key}").alias("violation"), F.count("*").alias("n")))
    return reduce(DataFrame.unionByName, parts).filter("n > 0")


def ddl(schema: T.StructType, table: str, key: str) -> str:
    """A CREATE TABLE statement with NOT NULL and PRIMARY KEY for engines that enforce them."""
    columns = ", ".join(f"{f.name} {f.dataType.simpleString().upper().replace('STRING', 'VARCHAR')}{'' if f.nullable else ' NOT NULL'}" for f in schema)
    return f"CREATE TABLE {table} ({columns}, PRIMARY KEY ({key}));"
