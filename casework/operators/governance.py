"""Rule tables: authorities over time, source triangulation, action policy, contracts, capture selection, context packs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .lineage import acyclic  # noqa: F401  a rule of supersession

# Fixed policy of agent actions: type, legal effect, certification, safety class, prohibited follow-on actions.
ACTION_POLICY = [
    ("extract_events", "none", False, "medium", ["certify_exemption", "approve_release"]),
    ("map_state", "none", False, "low", ["treat_state_as_legal_outcome"]),
    ("calculate_deadline", "preparatory", False, "medium", ["certify_timeliness"]),
    ("draft_search_plan", "preparatory", False, "medium", ["declare_search_adequate"]),
    ("draft_correspondence", "preparatory", True, "high", ["send_without_human_review"]),
    ("quality_check", "none", False, "low", []),
]
TIERS = {"primary_law": 0, "official_record": 1, "official_guidance": 2, "mirror": 3, "derived_summary": 4}


def normal_name(name):
    """Lower case, trimmed, single spaces. Evidence in decomposed Unicode forms should be composed before."""
    return F.trim(F.regexp_replace(F.lower(name), r"\s+", " "))


def classify_authority(evidence: DataFrame, registry: DataFrame) -> DataFrame:
    """Look an authority up by id, then name, alias and tag, each valid on the evidence's date (closed intervals). Ambiguity is kept: the count of candidates at the best level. ``registry``: authority_id, kind, value, valid_from, valid_to."""
    rank = F.create_map(*(F.lit(x) for kv in (("id", 0), ("name", 1), ("alias", 2), ("tag", 3)) for x in kv))[F.col("kind")]
    keys = evidence.select("record_id", "as_of", F.explode(F.array_distinct(F.array_compact(F.concat(F.array(F.struct(F.lit("id").alias("k"), F.col("authority_id").alias("v")), F.struct(F.lit("name").alias("k"), normal_name(F.col("authority_name")).alias("v")), F.struct(F.lit("alias").alias("k"), normal_name(F.col("authority_name")).alias("v"))), F.transform("tags", lambda t: F.struct(F.lit("tag").alias("k"), normal_name(t).alias("v"))))))).alias("key"))
    valid = (F.col("valid_from") <= F.col("as_of")) & (F.col("valid_to").isNull() | (F.col("as_of") <= F.col("valid_to")))
    found = keys.select("record_id", "as_of", F.col("key.k").alias("kind"), F.col("key.v").alias("value")).filter("value IS NOT NULL").join(registry, ["kind", "value"]).filter(valid).withColumn("rank", rank)
    levels = found.groupBy("record_id", "rank").agg(F.array_sort(F.collect_set("authority_id")).alias("ids"))
    best = levels.groupBy("record_id").agg(F.min_by("ids", "rank").alias("ids"), F.min("rank").alias("rank"))
    out = evidence.select("record_id").join(best, "record_id", "left")
    status = F.when(F.col("ids").isNull(), "unmatched").when(F.size("ids") > 1, "ambiguous").otherwise("matched")
    return out.select("record_id", status.alias("status"), F.when(F.size("ids") == 1, F.col("ids")[0]).alias("authority_id"), F.coalesce(F.size("ids"), F.lit(0)).alias("candidates"))


def registry_violations(registry: DataFrame) -> DataFrame:
    """Names and aliases must lie within their authority's own interval, and ids must be unique."""
    own = registry.filter("kind = 'id'").select("authority_id", F.col("valid_from").alias("own_from"), F.col("valid_to").alias("own_to"))
    outside = (F.col("valid_from") < F.col("own_from")) | (F.col("own_to").isNotNull() & (F.col("valid_to").isNull() | (F.col("valid_to") > F.col("own_to"))))
    nested = registry.filter("kind <> 'id'").join(own, "authority_id", "left").filter(F.col("own_from").isNull() | outside).select("authority_id", "kind", "value", F.lit("outside_interval").alias("violation"))
    twice = registry.filter("kind = 'id'").groupBy("authority_id").agg(F.count("*").alias("n")).filter("n > 1").select("authority_id", F.lit("id").alias("kind"), F.col("authority_id").alias("value"), F.lit("duplicate_id").alias("violation"))
    return nested.unionByName(twice)


def triangulate(assertions: DataFrame, minimum: int = 2) -> DataFrame:
    """Per claim: eligible support and contradiction, the controlling tier, and the reasons to ask a person. A claim is at best a candidate."""
    sound = (F.col("availability") == "available") & (F.col("freshness") == "event_time_match") & F.col("rights_status").isin("permitted", "metadata_only") & (F.col("integrity") == "hash_verified")
    eligible = sound & (F.col("authority_tier") != "derived_summary") & (F.col("source_role") == "authority_evidence")
    comparator = sound & (F.col("source_role") == "mirror_comparator")
    tier = F.create_map(*(F.lit(x) for kv in TIERS.items() for x in kv))[F.col("authority_tier")]
    named = lambda c: F.array_sort(F.collect_set(F.when(c, F.col("source_id"))))
    g = assertions.groupBy("claim_id").agg(
        named(eligible & (F.col("stance") == "supports")).alias("supporting"),
        named(eligible & (F.col("stance") == "contradicts")).alias("contradicting"),
        F.collect_set(F.when(eligible, F.col("stance"))).alias("stances"),
        F.collect_set(F.when(comparator, F.col("stance"))).alias("compared"),
        F.min_by("authority_tier", F.when(eligible, tier).otherwise(99)).alias("best_tier"),
        F.max(eligible).alias("any"),
        F.max(F.col("availability") == "blocked").alias("blocked"),
        F.max(F.col("freshness").isin("stale", "unknown")).alias("stale"),
        F.max(F.col("rights_status").isin("restricted", "unknown")).alias("rights"),
    )
    differ = (F.size("stances") > 0) & ((F.size("stances") > 1) & (F.size("compared") > 0) | (F.size(F.array_except("compared", "stances")) > 0))
    reasons = F.array_compact(
        F.array(
            F.when(F.col("blocked"), "blocked"), F.when((F.size("supporting") > 0) & (F.size("contradicting") > 0), "conflicting"), F.when(differ, "comparator_disagreement"), F.when(F.col("stale"), "stale"),
            F.when(F.col("rights"), "rights_uncertain"), F.when(F.size("supporting") < minimum, "insufficient_evidence"),
        )
    )
    return g.select(
        "claim_id", "supporting", "contradicting", F.when(F.col("any"), F.col("best_tier")).alias("controlling_tier"), reasons.alias("reasons"), F.when(F.size(reasons) > 0, "human_exception_required").otherwise("candidate_supported").alias("status")
    )


def evaluate_actions(actions: DataFrame) -> DataFrame:
    """Findings of actions against the policy: fields that differ, prohibitions that are missing, follow-on actions that are prohibited. An unknown type is a finding of its own."""
    policy = actions.sparkSession.createDataFrame(ACTION_POLICY, "action_type string, p_effect string, p_cert boolean, p_class string, p_prohibited array<string>")
    rows = actions.join(F.broadcast(policy), "action_type", "left")
    known = F.col("p_effect").isNotNull()
    f = lambda cond, severity, code: F.when(cond, F.struct(F.lit(severity).alias("severity"), F.lit(code).alias("code")))
    rules = F.array(
        f(~known, "error", "unknown_action_type"),
        f(known & (F.col("legal_effect") != F.col("p_effect")), "error", "policy_mismatch_legal_effect"),
        f(known & (F.col("requires_human_certification") != F.col("p_cert")), "error", "policy_mismatch_requires_human_certification"),
        f(known & (F.col("safety_class") != F.col("p_class")), "error", "policy_mismatch_safety_class"),
        f(F.size(F.array_except("p_prohibited", "prohibited")) > 0, "warning", "missing_prohibited_follow_on_actions"),
        f(F.size(F.array_intersect("p_prohibited", "requested")) > 0, "error", "prohibited_follow_on_action_requested"),
    )
    return rows.select("action_id", F.explode(F.array_compact(rules)).alias("f")).select("action_id", "f.*")


def unsafe_phrases(descriptors: DataFrame, key: str, text: str, phrases: list[str]) -> DataFrame:
    """Phrases of a list that a descriptor holds, case aside."""
    low = F.lower(F.coalesce(text, F.lit("")))
    found = F.filter(F.array(*map(F.lit, phrases)), lambda p: F.contains(low, p))
    return descriptors.select(key, F.explode(found).alias("phrase"))


def semver(text):
    """A strict three-part version as an ordered struct, else null."""
    part = lambda i: F.regexp_extract(text, r"^(0|[1-9]\d*)\.(0|[1-9]\d*)\.(0|[1-9]\d*)$", i).cast("int")
    return F.when(text.rlike(r"^(0|[1-9]\d*)\.(0|[1-9]\d*)\.(0|[1-9]\d*)$"), F.struct(part(1).alias("major"), part(2).alias("minor"), part(3).alias("patch")))


def negotiate(requests: DataFrame) -> DataFrame:
    """Outcome of a contract request (``declared`` and ``needed`` capabilities, ``requested``, ``exact``, ``range_from``, ``range_to`` versions): the first rule that fits."""
    v, lo, hi = semver(F.col("requested")), semver(F.col("range_from")), semver(F.col("range_to"))
    outcome = (
        F.when(F.size(F.array_except("needed", "declared")) > 0, "missing_capability").when(v.isNull(), "invalid_version").when(F.col("requested") == F.col("exact"), "exact")
        .when((v >= lo) & (v < hi), "compatible_range").when(v["major"] != semver(F.col("exact"))["major"], "unknown_major").otherwise("unsupported_revision")
    )
    return requests.select("request_id", outcome.alias("outcome"))


def latest_captures(captures: DataFrame) -> DataFrame:
    """Per slug the capture to use: JSON before HTML, then the latest, then the first row; only status 200."""
    order = F.struct(F.when(F.col("kind") == "json", 0).otherwise(1), -F.unix_micros(F.col("captured").cast("timestamp")), F.col("seq"))
    return captures.filter("status = 200").groupBy("slug").agg(F.min_by(F.struct("kind", "captured", "seq"), order).alias("c")).select("slug", "c.*")


def partition_check(index: DataFrame, parts: DataFrame, key: str) -> DataFrame:
    """Do the parts cover the index exactly? Missing, unknown and repeated keys."""
    counted = parts.groupBy(key).agg(F.count("*").alias("n"))
    both = index.select(key, F.lit(True).alias("in_index")).join(counted, key, "full_outer")
    issue = F.when(F.col("n").isNull(), "missing").when(F.col("in_index").isNull(), "unknown").when(F.col("n") > 1, "duplicate")
    return both.select(key, issue.alias("issue")).filter("issue IS NOT NULL")


def manifest_audit(manifest: DataFrame, key: str, digest: str) -> DataFrame:
    """Records, repeated ids, valid digests, and the sorted list of what blocks a run."""
    ids = manifest.groupBy(key).agg(F.count("*").alias("n"), F.count_if(F.col(digest).rlike("^[0-9a-f]{64}$")).alias("valid"))
    out = ids.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("records"), F.count_if(F.col("n") > 1).alias("duplicate_ids"), F.coalesce(F.sum("valid"), F.lit(0)).alias("valid_digests"))
    blockers = F.array_compact(F.array(F.when(F.col("duplicate_ids") > 0, "duplicate_ids"), F.when(F.col("valid_digests") < F.col("records"), "invalid_digests"), F.when(F.col("records") == 0, "no_records")))
    return out.withColumn("blockers", F.array_sort(blockers))


def context_pack(profiles: DataFrame, events: DataFrame, tasks: DataFrame) -> DataFrame:
    """Everything about each request in one row: counts, event types, the latest event, open tasks, and next safe actions."""
    e = events.groupBy("request_id").agg(F.count("*").alias("events"), F.array_sort(F.collect_set("event_type")).alias("event_types"), F.max_by("event_id", F.struct("event_time", "seq")).alias("last_event"), F.count_if(F.col("requires_human_certification")).alias("to_certify"))
    t = tasks.groupBy("request_id").agg(F.count("*").alias("open_tasks"))
    rows = profiles.select("request_id", "authority", "normalised_state").join(e, "request_id", "left").join(t, "request_id", "left")
    types = F.coalesce("event_types", F.array().cast("array<string>"))
    actions = F.array_compact(
        F.array(
            F.when(~F.array_contains(types, "MessageObserved"), "collect_messages"), F.when(F.coalesce("to_certify", F.lit(0)) > 0, "route_to_certifier"), F.when(F.coalesce("open_tasks", F.lit(0)) > 0, "review_open_tasks"),
            F.when(~F.col("normalised_state").isin("ReleasedInFull", "ReleasedInPart", "Refused", "NoDocumentsFound", "Withdrawn", "Closed"), "draft_search_plan"),
        )
    )
    return rows.select("request_id", "authority", "normalised_state", F.coalesce("events", F.lit(0)).alias("events"), types.alias("event_types"), "last_event", F.coalesce("open_tasks", F.lit(0)).alias("open_tasks"), actions.alias("next_actions"))
