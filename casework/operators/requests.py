"""Normalisation: raw request records to profiles, and profiles to observed events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import dims
from ..functions.ids import uuid5

EVENT_URL = "https://example.org/event"


def state_key(state):
    """Trimmed, lower case, with ``_`` for spaces and hyphens."""
    return F.regexp_replace(F.lower(F.trim(F.coalesce(state, F.lit("")))), "[- ]", "_")


def map_states(records: DataFrame, column: str = "source_state") -> DataFrame:
    """Adds normalised_state, mapping_confidence and mapping_status; what has no rule is Unknown, 0.0, unknown. The dimension has 13 rows."""
    mapped = records.withColumn("state_key", state_key(F.col(column))).join(F.broadcast(dims.state_map(records.sparkSession)), "state_key", "left")
    defaults = {"normalised_state": "Unknown", "mapping_confidence": 0.0, "mapping_status": "unknown"}
    return mapped.fillna(defaults).drop("state_key")


def build_profiles(records: DataFrame) -> DataFrame:
    """Raw records with any of the alias columns to profiles. A record without request_id, id and url_title is an error."""
    have = set(records.columns)
    pick = lambda *names: F.coalesce(*(F.nullif(F.col(n).cast("string"), F.lit("")) for n in names if n in have), F.lit(None).cast("string"))
    key = F.coalesce(pick("request_id", "id", "url_title"), F.raise_error(F.lit("a record has no request_id, id or url_title")).cast("string"))
    has_state = pick("state").isNotNull()
    url, slug = pick("source_url", "url"), pick("url_title")
    rows = records.select(
        key.alias("request_id"),
        slug.alias("url_title"),
        F.when(url.rlike("^https?://"), url).when(slug.isNotNull(), F.concat(F.lit("https://example.org/request/"), slug)).alias("source_url"),
        F.coalesce(pick("title"), F.lit("Untitled request")).alias("title"),
        F.coalesce(pick("authority", "public_body"), F.lit("Unknown authority")).alias("authority"),
        pick("state", "source_state").alias("source_state"),
        F.when(has_state, "state").when(pick("source_state").isNotNull(), "source_state").otherwise("unknown").alias("raw_state_field"),
        F.to_date(pick("first_sent", "sent_at", "created_at")).alias("first_sent"),
    )
    return map_states(rows)


def event_id(kind, request_id, state=None, extra=None):
    """Deterministic event URN: the same request, kind and state always get the same id."""
    empty = F.lit("")
    name = F.concat_ws("/", F.lit(EVENT_URL), kind, request_id, F.coalesce(state, empty) if state is not None else empty, F.coalesce(extra, empty) if extra is not None else empty)
    return F.concat(F.lit("urn:uuid:"), uuid5(name))


def observed_events(profiles: DataFrame) -> DataFrame:
    """Per profile a RequestObserved, a StateObserved and, with a first date, a DeadlineCalculated event. None of them certifies anything."""
    event = lambda kind, name, status, confidence, state=None: F.struct(
        event_id(F.lit(kind), F.col("request_id"), state).alias("event_id"), F.lit(name).alias("event_type"), F.lit(status).alias("assertion_status"), confidence.cast("double").alias("confidence")
    )
    made = F.array(
        event("request-observed", "RequestObserved", "observed", F.lit(1.0)),
        event("state-observed", "StateObserved", "inferred", F.col("mapping_confidence"), F.col("source_state")),
        F.when(F.col("first_sent").isNotNull(), event("deadline-calculated", "DeadlineCalculated", "inferred", F.lit(0.42))),
    )
    return profiles.select("request_id", "normalised_state", F.explode(F.array_compact(made)).alias("e")).select("e.*", "request_id", F.col("normalised_state").alias("lifecycle_state_after"))


def attachment_events(profiles: DataFrame) -> DataFrame:
    """One AttachmentObserved event per entry of ``attachments`` (array of maps); the id falls back to the position, a digest that is not 64 characters long to the profile's."""
    rows = profiles.select("request_id", "content_sha256", F.posexplode("attachments").alias("position", "a"))
    name = F.coalesce(F.col("a")["id"], F.col("a")["attachment_id"], F.col("position").cast("string"))
    digest = F.when(F.length(F.col("a")["content_sha256"]) == 64, F.col("a")["content_sha256"]).otherwise(F.col("content_sha256"))
    return rows.select(event_id(F.lit("attachment-observed"), F.col("request_id"), None, name).alias("event_id"), "request_id", name.alias("attachment_id"), "position", digest.alias("content_sha256"))


def summarise_requests(profiles: DataFrame) -> DataFrame:
    return profiles.groupBy("normalised_state").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "normalised_state")


def top_authorities(profiles: DataFrame, k: int = 20) -> DataFrame:
    """The ``k`` authorities with most requests; of equals the one seen first, that is with the smallest number ``seq``."""
    return profiles.groupBy("authority").agg(F.count("*").alias("n"), F.min("seq").alias("first_seq")).orderBy(F.desc("n"), "first_seq").limit(k)


def audit_states(records: DataFrame) -> DataFrame:
    """Coverage of the state map: per source state the count and whether a rule exists."""
    mapped = map_states(records)
    return mapped.groupBy(F.coalesce("source_state", F.lit("")).alias("source_state")).agg(F.count("*").alias("n"), F.max(F.col("mapping_status") != "unknown").alias("mapped"))
