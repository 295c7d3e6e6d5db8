"""Annotation tasks, role annotators, agent packs, trace spans and codebook overlays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ids import content_id
from .ledger import root_digest
from .retrieval import embed_chunks
from .review import last_wins

# Labels, priorities and instructions of the tasks, patterns of the two roles, constraints of packs.
RISK_LABELS = ["no_review_trigger", "privacy", "health", "commercial", "withholding_language", "ai_generated_request", "other"]
STATE_LABELS = ["Received", "AwaitingClarification", "ReleasedInFull", "ReleasedInPart", "Refused", "NoDocumentsFound", "Withdrawn", "Closed", "Unknown"]
PREFILLED = [("health_information", "health"), ("personal_information", "privacy"), ("withholding_or_redaction", "withholding_language"), ("ai_workload", "ai_generated_request")]
RISK_INSTRUCTIONS = "Select all review-trigger categories that apply. Do not decide release/refusal/redaction."
STATE_INSTRUCTIONS = "Review whether the normalised state is supported by the source state and event hints. Do not certify a legal outcome."
ROLE_PATTERNS = {
    "annotator_a": r"\bGIPA\b|Government Information \(Public Access\)",
    "annotator_b": r"\bGIPA Act\b|Government Information \(Public Access\) Act",
}
CANDIDATE_PATTERN = r"\binformation access\b|\bFOI\b"
AGENT_MAY = ["retrieve_context", "summarise_process_history", "draft_search_plan", "draft_correspondence_for_human_review", "flag_candidate_risks", "flag_candidate_redaction_spans"]
OVERLAY_SECTIONS = ["span_policy", "terminology", "calibration_examples"]


def _strings(values) -> Column:
    return F.array(*map(F.lit, values)).cast("array<string>")


def risk_triage_tasks(chunks: DataFrame, risks: DataFrame, order: str) -> DataFrame:
    """A task for every chunk (``chunk_id, request_id, text``) with text, and what is known of its risk (``source_id, risk_level, categories``): of several assessments the one with the largest ``order``. Without one, or with an unknown level, the priority is medium."""
    found = last_wins(risks.select("source_id", "risk_level", "categories", F.col(order).alias("_order")), "source_id", "_order").withColumn("assessed", F.lit(True)).drop("_order")
    rows = chunks.filter(F.coalesce("text", F.lit("")) != "").select(F.col("chunk_id").alias("source_id"), "request_id", "text").join(found, "source_id", "left")
    has = F.coalesce("categories", F.array().cast("array<string>"))
    label = F.lit(None).cast("string")
    for category, name in reversed(PREFILLED):
        label = F.when(F.array_contains(has, category), name).otherwise(label)
    prefilled = F.when(F.col("assessed"), F.coalesce(label, F.when(F.size(has) == 0, "no_review_trigger").otherwise(F.array_min(has))))
    return rows.select(
        content_id("gold:", F.lit("risk_triage"), F.col("source_id"), F.col("text")).alias("task_id"), F.lit("risk_triage").alias("task_type"), "source_id", "request_id", F.when(F.col("risk_level").isin("low", "medium", "high"), F.col("risk_level")).otherwise("medium").alias("priority"),
        "text", _strings(RISK_LABELS).alias("candidate_labels"), prefilled.alias("prefilled_label"), F.lit(RISK_INSTRUCTIONS).alias("instructions"),
    )


HINT = "struct<event_id: string, event_type: string, assertion_status: string, confidence: double, evidence_ids: array<string>>"


def state_mapping_tasks(profiles: DataFrame, events: DataFrame) -> DataFrame:
    """A task for every profile (``request_id, title, authority, source_state, normalised_state, mapping_confidence``), with a hint for each event of its request in the order of their ids. The hints of one request lie in one row, as they are what its annotator reads."""
    hint = F.struct(*(F.col(c) for c in ("event_id", "event_type", "assertion_status", "confidence", "evidence_ids"))).cast(HINT)
    hints = events.filter("request_id IS NOT NULL").groupBy("request_id").agg(F.array_sort(F.collect_list(hint)).alias("event_hints"))
    said = lambda c, default: F.when(F.coalesce(F.col(c), F.lit("")) != "", F.col(c)).otherwise(default)
    title, authority, source, state = said("title", "Untitled request"), said("authority", "Unknown authority"), said("source_state", "unknown"), said("normalised_state", "Unknown")
    text = F.concat(title, F.lit("\nAuthority: "), authority, F.lit("\nSource state: "), source, F.lit("\nNormalised state: "), state)
    rows = profiles.join(hints, "request_id", "left")
    return rows.select(
        content_id("gold:", F.lit("state_mapping"), F.col("request_id"), text).alias("task_id"), F.lit("state_mapping").alias("task_type"), F.col("request_id").alias("source_id"), "request_id", F.when(F.col("mapping_confidence") < 0.5, "high").otherwise("medium").alias("priority"),
        text.alias("text"), _strings(STATE_LABELS).alias("candidate_labels"), state.alias("prefilled_label"), F.coalesce("event_hints", F.array().cast(f"array<{HINT}>")).alias("event_hints"), F.lit(STATE_INSTRUCTIONS).alias("instructions"),
    )


def role_annotations(units: DataFrame, patterns: dict[str, str] | None = None, candidate: str = CANDIDATE_PATTERN, key: str = "unit_id", text: str = "text") -> DataFrame:
    """A row for each unit and role: ``observed`` where the role's own pattern is found, else ``candidate`` where the common one is, else ``unknown``, which abstains. The span is the first match, half-open, in characters. Case of ASCII letters aside."""
    patterns = patterns or ROLE_PATTERNS
    body = F.coalesce(F.col(text), F.lit(""))

    def place(pattern: str) -> Column:
        # What lies before the match, as its length counts characters and the places of a match don't.
        start = F.length(F.regexp_extract(body, rf"(?i)^([\s\S]*?)(?:{pattern})", 1))
        found = F.length(F.regexp_substr(body, F.lit(f"(?i){pattern}")))
        return F.when(found.isNotNull(), F.struct(start.cast("int").alias("start"), (start + found).cast("int").alias("end")))

    rows = units.select(key, F.sha2(body, 256).alias("unit_sha256"), body.alias("_body"), F.explode(F.array(*(F.struct(F.lit(role).alias("role"), place(p).alias("own"), place(candidate).alias("other")) for role, p in patterns.items()))).alias("r"))
    label = F.when(F.col("r.own").isNotNull(), "observed").when(F.col("r.other").isNotNull(), "candidate").otherwise("unknown")
    reason = F.when(label == "unknown", "insufficient_evidence")
    return rows.select(key, "unit_sha256", "r.role", label.alias("label"), (label == "unknown").alias("abstention"), reason.alias("abstention_reason"), F.coalesce("r.own", "r.other").alias("span"))


def trace_spans(artifacts: DataFrame, run: str = "run_id") -> DataFrame:
    """A root span for each run and one below it for each artifact (``run, path, sha256``), in the order of paths; ids follow from their content alone. A run's list of paths is its seed and lies in one row."""
    hex_ = lambda c, n: F.substring(F.sha2(c, 256), 1, n)
    runs = artifacts.groupBy(run).agg(F.array_sort(F.collect_list("path")).alias("paths"))
    runs = runs.select(run, hex_(F.concat_ws("|", F.col(run), "paths"), 32).alias("trace_id"), F.size("paths").alias("artifacts"))
    roots = runs.withColumn("root_id", hex_(F.concat("trace_id", F.lit(":root")), 16))
    sequence = (F.row_number().over(Window.partitionBy(run).orderBy("path", "sha256")) - 1).cast("int")
    seen = artifacts.select(run, "path", "sha256", sequence.alias("sequence")).join(roots, run)
    span_id = hex_(F.concat("trace_id", F.lit(":"), F.col("sequence").cast("string"), F.lit(":"), "path", F.lit(":"), "sha256"), 16)
    below = seen.select(run, "trace_id", span_id.alias("span_id"), F.col("root_id").alias("parent_span_id"), F.lit("artifact.observed").alias("name"), "sequence", F.concat(F.lit("sha256:"), "sha256").alias("link"))
    top = roots.select(run, "trace_id", F.col("root_id").alias("span_id"), F.lit(None).cast("string").alias("parent_span_id"), F.col(run).cast("string").alias("name"), F.col("artifacts").alias("sequence"), F.lit(None).cast("string").alias("link"))
    return top.unionByName(below)


def agent_packs(profiles: DataFrame, streams: dict[str, DataFrame], hits: DataFrame) -> DataFrame:
    """One row for each request (``request_id, profile``): how many records of each stream (``request_id, record_sha256``) are its own, with a digest over them in order, and its retrieval hits (``for_request, hit_id, request_id, profile``) kept or, by reason, left out.

    A hit of another request, or of another profile where both are known, is left out; one
    may have both reasons. Streams and hits are joined on the request after each is summed
    up, so nothing but sums meets.
    """
    out = profiles.select("request_id", "profile")
    for name, rows in streams.items():
        sums = root_digest(rows.filter("request_id IS NOT NULL"), "request_id", "record_sha256")
        out = out.join(sums.select("request_id", F.col("entries").alias(name), F.col("root_sha256").alias(f"{name}_sha256")), "request_id", "left").fillna(0, [name])
    own = profiles.select(F.col("request_id").alias("for_request"), F.col("profile").alias("own_profile"))
    judged = hits.join(own, "for_request")
    other, unlike = F.col("request_id").isNotNull() & (F.col("request_id") != F.col("for_request")), F.col("profile").isNotNull() & F.col("own_profile").isNotNull() & (F.col("profile") != F.col("own_profile"))
    judged = judged.select("for_request", "hit_id", other.alias("other"), unlike.alias("unlike"))
    sums = judged.groupBy(F.col("for_request").alias("request_id")).agg(F.count_if(~(F.col("other") | F.col("unlike"))).alias("hits"), F.count_if("other").alias("request_mismatch"), F.count_if("unlike").alias("profile_mismatch"), F.count_if(F.col("other") & F.col("unlike")).alias("both_mismatch"))
    return out.join(sums, "request_id", "left").fillna(0, ["hits", "request_mismatch", "profile_mismatch", "both_mismatch"]).withColumn("agent_may", _strings(AGENT_MAY))


def resolve_overlays(core: DataFrame, overlays: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Codebooks as settings: ``core`` (``section, key, value``) and the overlays of jurisdictions (``overlay_id, core_version, core_sha256, section, key, value``) to ``(resolved, problems)``.

    Settings of an overlay stand before the core's, in the sections that may be overridden.
    An overlay that pins another version or digest of the core, or touches other sections,
    has problems and is not resolved. The core's version is its setting ``core/version``; its
    digest is that of its settings in order.
    """
    sealed = core.select(F.lit("core").alias("g"), F.sha2(F.concat_ws("\x1f", "section", "key", "value"), 256).alias("h"))
    pin = root_digest(sealed, "g", "h").crossJoin(core.filter("section = 'core' AND key = 'version'").select(F.col("value").alias("version")))  # one row
    checked = overlays.crossJoin(F.broadcast(pin.select("root_sha256", "version")))
    code = F.explode(
        F.array_compact(
            F.array(
                F.when(~F.col("core_version").eqNullSafe(F.col("version")), "core_version_mismatch"), F.when(~F.col("core_sha256").eqNullSafe(F.col("root_sha256")), "core_digest_mismatch"),
                F.when(~F.coalesce(F.col("section").isin(OVERLAY_SECTIONS), F.lit(False)), "section_not_overridable"),
            )
        )
    )
    problems = checked.select("overlay_id", code.alias("code")).distinct()
    sound = overlays.join(problems.select("overlay_id").distinct(), "overlay_id", "left_anti")
    books = sound.select("overlay_id").distinct()
    # Every sound codebook has all of the core's settings: a core is small, and the product is the resolved books themselves.
    base = books.crossJoin(F.broadcast(core.select("section", "key", F.col("value").alias("core_value"))))
    own = sound.select("overlay_id", "section", "key", "value", F.lit(True).alias("own"))
    merged = base.join(own, ["overlay_id", "section", "key"], "full_outer")
    return merged.select("overlay_id", "section", "key", F.when(F.col("own"), F.col("value")).otherwise(F.col("core_value")).alias("value"), F.coalesce("own", F.lit(False)).alias("overridden")), problems


def embedding_records(chunks: DataFrame, dimensions: int = 128, provider: str = "local", model: str = "feature-hash", reachable: bool = True) -> DataFrame:
    """Vectors of chunks (``chunk_id, text``) with where they come from: provider, model, size, whether it was reachable, the digest of what was embedded, and that of the vector."""
    rows = embed_chunks(chunks, dimensions).select("chunk_id", "embedding").join(chunks.select("chunk_id", F.sha2("text", 256).alias("text_sha256")), "chunk_id")
    origin = F.struct(F.lit(provider).alias("provider"), F.lit(model).alias("model"), F.lit(dimensions).alias("dimensions"), F.lit(reachable).alias("available"), F.lit(provider == "local").alias("deterministic"))
    return rows.withColumn("provenance", origin).withColumn("vector_sha256", F.sha2(F.array_join(F.transform("embedding", lambda x: F.format_number(x, 9)), ","), 256))
