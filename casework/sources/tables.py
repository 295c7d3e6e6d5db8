"""Requests, events, messages and chunks as views of the star-schema tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import dims


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw request records: request_id, authority, source_state, first_sent. The two joins are on dimension tables."""
    orders, customer, nation = (table(spark, sf_dir, t) for t in ("orders", "customer", "nation"))
    status = F.create_map(*(F.lit(x) for pair in dims.ORDER_STATES for x in pair))
    joined = orders.join(customer, orders.o_custkey == customer.c_custkey).join(nation, customer.c_nationkey == nation.n_nationkey)
    return joined.select(
        F.col("o_orderkey").cast("string").alias("request_id"),
        F.col("n_name").alias("authority"),
        status[F.col("o_orderstatus")].alias("source_state"),
        F.to_date("o_orderdate").alias("first_sent"),
        F.col("o_orderpriority").alias("priority"),
    )


REQUESTS_SQL = """
requests AS (
    SELECT CAST(o_orderkey AS VARCHAR) AS request_id, n_name AS authority,
           CASE o_orderstatus WHEN 'F' THEN 'successful' WHEN 'O' THEN 'waiting_response' WHEN 'P' THEN 'partially_successful' END AS source_state,
           CAST(o_orderdate AS DATE) AS first_sent, o_orderpriority AS priority
    FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
)"""


def core_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Core events. The driver's events lack most fields of the model, so these follow from event_id and the number in props."""
    events = table(spark, sf_dir, "events")
    kinds = {raw: (core, state) for raw, core, state in dims.EVENT_TYPES}
    pick = lambda i: F.create_map(*(F.lit(x) for raw, v in kinds.items() for x in (raw, v[i])))[F.col("event_type")]
    k, i = F.get_json_object("props", "$.k").cast("int"), F.col("event_id")
    core = pick(0)
    certifiable = core.isin(dims.CERTIFICATION_TYPES)
    return events.select(
        F.concat(F.lit("event:"), i.cast("string")).alias("event_id"),
        i.alias("seq"),
        F.col("ts").alias("event_time"),
        F.col("user_id").cast("string").alias("request_id"),
        core.alias("event_type"),
        pick(1).alias("lifecycle_state_after"),
        (F.pmod(k, F.lit(101)) / 100.0).alias("confidence"),
        F.when(k % 10 == 0, "certified").when(k % 3 == 0, "observed").otherwise("inferred").alias("assertion_status"),
        (i % 2 == 0).alias("machine_generated"),
        F.when(i % 7 != 0, F.lit("casework")).alias("generator"),
        (i % 5).cast("int").alias("evidence_count"),
        (certifiable & (i % 4 != 0)).alias("requires_human_certification"),
        F.when(i % 3 == 1, F.lit(False)).when(i % 3 == 2, F.lit(True)).alias("human_certified"),
        F.when(i % 6 == 0, "external_gate").when(i % 6 != 1, "official").alias("legal_source_status"),
        F.when(k % 4 == 0, F.array(F.lit("language_detected"), F.lit("requires_human_review"))).otherwise(F.array().cast("array<string>")).alias("quality_flags"),
    )


EVENTS_SQL = """
core_events AS (
    SELECT 'event:' || event_id AS event_id, event_id AS seq, ts AS event_time, CAST(user_id AS VARCHAR) AS request_id,
           CASE event_type WHEN 'signup' THEN 'RequestObserved' WHEN 'view' THEN 'MessageObserved' WHEN 'click' THEN 'ExtensionNotified'
                WHEN 'purchase' THEN 'ReleaseMade' WHEN 'error' THEN 'RefusalCommunicated' END AS event_type,
           CASE event_type WHEN 'signup' THEN 'Received' WHEN 'view' THEN 'Searching' WHEN 'click' THEN 'ExtensionApplied'
                WHEN 'purchase' THEN 'ReleasedInFull' WHEN 'error' THEN 'Refused' END AS lifecycle_state_after,
           (k % 101) / 100.0 AS confidence,
           CASE WHEN k % 10 = 0 THEN 'certified' WHEN k % 3 = 0 THEN 'observed' ELSE 'inferred' END AS assertion_status,
           event_id % 2 = 0 AS machine_generated, CASE WHEN event_id % 7 <> 0 THEN 'casework' END AS generator,
           CAST(event_id % 5 AS INT) AS evidence_count,
           event_type IN ('click', 'purchase', 'error') AND event_id % 4 <> 0 AS requires_human_certification,
           CASE event_id % 3 WHEN 1 THEN false WHEN 2 THEN true END AS human_certified,
           CASE WHEN event_id % 6 = 0 THEN 'external_gate' WHEN event_id % 6 <> 1 THEN 'official' END AS legal_source_status,
           CASE WHEN k % 4 = 0 THEN ['language_detected', 'requires_human_review'] ELSE [] END AS quality_flags
    FROM (SELECT *, CAST(json_extract(props, '$.k') AS INT) AS k FROM events)
)"""


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations")
    return rows.select(F.col("conv_id").cast("string").alias("request_id"), F.col("turn").alias("position"), F.col("role").alias("sender"), F.trim("text").alias("body"))


MESSAGES_SQL = """
messages AS (
    SELECT CAST(conv_id AS VARCHAR) AS request_id, turn AS position, role AS sender, trim(text) AS body FROM conversations
)"""


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as text chunks with content-addressed ids."""
    docs = table(spark, sf_dir, "documents")
    digest = F.sha2(F.concat_ws("\x00", F.lit("document"), F.col("doc_id").cast("string"), F.lit("0"), F.col("text")), 256)
    return docs.filter(F.col("text").isNotNull()).select(F.concat(F.lit("chunk:"), F.left(digest, F.lit(24))).alias("chunk_id"), "doc_id", "source", "lang", "text")


CHUNKS_SQL = """
chunks AS (
    SELECT 'chunk:' || left(sha256('document' || chr(0) || doc_id || chr(0) || '0' || chr(0) || text), 24) AS chunk_id, doc_id, source, lang, text
    FROM documents WHERE text IS NOT NULL
)"""
