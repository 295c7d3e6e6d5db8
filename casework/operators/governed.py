"""Sealed documents, candidate frames, accounts of adjudication, and checks of source mappings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .measures import disagreements

#: Fields of a source reference, and what its status and basis may be. Fixed values.
REFERENCE_FIELDS = ["reference_id", "source_id", "status", "basis", "retrieved_at"]
STATUSES = ["verified", "unverified", "stale", "deprecated"]
BASES = ["statute", "guidance", "practice"]


def _digest(text: str, without: str | None) -> Column:
    """Of a JSON object in the column ``text``; a projection, so no row moves."""
    fields = F.filter(F.map_entries(F.expr(f"try_variant_get(try_parse_json(`{text}`), '$', 'map<string, variant>')")), lambda x: ~x["key"].eqNullSafe(F.lit(without)))
    # The name as JSON has it, after {"k": and with the closing brace
    written = F.array_sort(F.transform(fields, lambda x: F.struct(x["key"].alias("name"), F.substring(F.to_json(F.struct(x["key"].alias("k"))), 6, 1 << 30).alias("quoted"), F.coalesce(F.to_json(x["value"]), F.lit("null")).alias("value"))))
    return F.sha2(F.concat(F.lit("{"), F.array_join(F.transform(written, lambda x: F.concat(F.substring(x["quoted"], F.lit(1), F.length(x["quoted"]) - 1), F.lit(":"), x["value"])), ","), F.lit("}")), 256)


def canonical_digest(documents: DataFrame, key: str, text: str, without: str | None = None) -> DataFrame:
    """``key, digest``: SHA-256 of each JSON object with sorted keys at every depth and no white space, less its field ``without``. Text that is no JSON object has a null digest. One row for each row."""
    return documents.select(key, _digest(text, without).alias("digest"))


def seal_documents(documents: DataFrame, key: str, text: str, pin: str) -> DataFrame:
    """``key, sealed``: each JSON object with its own digest as the field ``pin``, which the digest leaves out."""
    sealed = documents.select(key, text, _digest(text, pin).alias("digest"))
    body = F.rtrim(F.to_json(F.expr(f"try_parse_json(`{text}`)")))
    comma = F.when(body == "{}", "").otherwise(",")
    return sealed.select(key, F.when(F.col("digest").isNotNull(), F.concat(F.substring(body, 1, F.length(body) - 1), comma, F.lit(f'"{pin}":"'), F.col("digest"), F.lit('"}'))).alias("sealed"))


def seal_problems(sealed: DataFrame, key: str, text: str, pin: str) -> DataFrame:
    """``key, code`` of sealed documents that don't hold: ``not_an_object``, ``pin_missing``, ``pin_mismatch``."""
    rows = sealed.select(key, F.get_json_object(text, f"$.{pin}").alias("_pin"), _digest(text, pin).alias("digest"))
    code = F.when(F.col("digest").isNull(), "not_an_object").when(F.col("_pin").isNull(), "pin_missing").when(F.col("_pin") != F.col("digest"), "pin_mismatch")
    return rows.select(key, code.alias("code")).filter("code IS NOT NULL")


def candidate_frame(candidates: DataFrame, replay: DataFrame) -> DataFrame:
    """Candidates (``slug, raw_sha256``) with what the replay has for them (``slug, raw_sha256, text``): accessible with text, ``no_text``, ``digest_mismatch`` or ``not_replayed``; frozen rows carry the digest of their text."""
    found = replay.select("slug", F.col("raw_sha256").alias("replayed"), "text", F.lit(True).alias("there"))
    rows = candidates.select("slug", "raw_sha256").join(found, "slug", "left")
    status = F.when(F.col("there").isNull(), "not_replayed").when(~F.col("raw_sha256").eqNullSafe(F.col("replayed")), "digest_mismatch").when(F.trim(F.coalesce("text", F.lit(""))) == "", "no_text").otherwise("accessible")
    return rows.select("slug", status.alias("access"), F.when(status == "accessible", F.sha2("text", 256)).alias("text_sha256"))


def queue_accounting(left: DataFrame, right: DataFrame, decisions: DataFrame, unit: str = "unit_id") -> DataFrame:
    """Does every disagreement have one decision, and every decision a disagreement? One row of counts with the verdict."""
    queue = disagreements(left, right, unit).select(unit, F.lit(True).alias("open"))
    decided = decisions.groupBy(unit).agg(F.count("*").alias("n"))
    rows = queue.join(decided, unit, "full_outer")
    counts = rows.agg(F.count_if("open").alias("disagreements"), F.count_if(F.col("open") & F.col("n").isNotNull()).alias("decided"), F.count_if(F.col("open") & F.col("n").isNull()).alias("undecided"), F.count_if(F.col("open").isNull()).alias("unasked"), F.count_if(F.col("n") > 1).alias("repeated"))
    return counts.withColumn("ok", (F.col("undecided") == 0) & (F.col("unasked") == 0) & (F.col("repeated") == 0))


def mapping_problems(references: DataFrame, sources: DataFrame) -> DataFrame:
    """``reference_id, code`` for references (``REFERENCE_FIELDS``) with fields missing, a status or basis that is not registered, a time that can't be read, or a source (``source_id``) that doesn't exist."""
    blank = lambda c: F.trim(F.coalesce(F.col(c), F.lit(""))) == ""
    rows = references.join(sources.select("source_id", F.lit(True).alias("known")).distinct(), "source_id", "left")
    codes = F.array_compact(
        F.array(
            *(F.when(blank(c), f"missing_{c}") for c in REFERENCE_FIELDS), F.when(~blank("status") & ~F.col("status").isin(STATUSES), "status_not_registered"), F.when(~blank("basis") & ~F.col("basis").isin(BASES), "basis_not_registered"),
            F.when(~blank("retrieved_at") & F.try_to_timestamp("retrieved_at").isNull(), "unreadable_time"), F.when(~blank("source_id") & F.col("known").isNull(), "unknown_source"),
        )
    )
    return rows.select("reference_id", F.explode(codes).alias("code"))
