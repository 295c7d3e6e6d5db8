"""Queries on texts, vectors, raters and rule tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scores, text
from ..functions.ids import content_id, fnv1a64
from ..operators import gates, governance, measures, requests, retrieval, review, texts
from ..session import written
from ..sources import tables as src
from .process import EVENTS, PROFILES_SQL, profiles


def doc_tokens(spark, d):
    rows = src.table(spark, d, "documents").select("doc_id", text.tokens(F.coalesce("text", F.lit(""))).alias("t"), text.estimate_tokens(F.coalesce("text", F.lit(""))).alias("estimate"))
    return rows.select("doc_id", F.size("t").alias("tokens"), F.size(F.array_distinct("t")).alias("distinct_tokens"), "estimate")


def doc_chunks(spark, d):
    return src.chunks(spark, d).select("chunk_id", "doc_id")


def request_chunks(spark, d):
    return texts.chunk_requests(profiles(spark, d))


def event_chunks(spark, d):
    return texts.chunk_events(src.core_events(spark, d))


def chunk_totals(spark, d):
    rows = texts.chunk_events(src.core_events(spark, d))
    return rows.agg(F.count("*").alias("chunks"), F.sum("token_estimate").alias("tokens"))


def risk_assessment(spark, d):
    return texts.assess_risk(src.table(spark, d, "documents"), "doc_id", "text").withColumn("categories", F.array_join("categories", ","))


def risk_summary(spark, d):
    return texts.risk_summary(texts.assess_risk(src.table(spark, d, "documents"), "doc_id", "text"))


def sensitive_spans(spark, d):
    return texts.redaction_candidates(src.table(spark, d, "documents"), "doc_id", "text")


def review_queue(spark, d):
    docs = src.table(spark, d, "documents")
    tasks = review.risk_tasks(texts.assess_risk(docs, "doc_id", "text")).unionByName(review.span_tasks(texts.redaction_candidates(docs, "doc_id", "text"))).unionByName(review.certification_tasks(src.core_events(spark, d)))
    return review.dedupe_tasks(tasks)


def message_events(spark, d):
    spoken = src.messages(spark, d)
    canned = F.when(F.col("position") % 3 == 0, "We need an extension of time. ").when(F.col("position") % 3 == 1, "The documents are attached; some were withheld. ").otherwise("")
    return texts.message_events(spoken.withColumn("body", F.concat(canned, F.col("body")))).select("request_id", "position", "event_type", F.round("confidence", 6).alias("confidence"), "requires_human_certification")


def page_text(spark, d):
    rows = texts.html_text(src.table(spark, d, "pages"), "page_id", "html")
    return rows.select("page_id", F.length("text").alias("chars"), F.sha2("text", 256).alias("text_sha256"))


def extraction_requests(spark, d):
    return texts.truncate(src.table(spark, d, "documents"), "doc_id", "text")


def masks(spark, d):
    """Masks, identifier forms and mail predicates over names."""
    names = src.table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.when(F.col("c_custkey") % 3 == 0, F.concat(F.lower(F.left("c_mktsegment", F.lit(4))), F.lit("@"), F.lit("example.org"))).when(F.col("c_custkey") % 3 == 1, F.col("c_name")).otherwise(F.left("c_name", F.col("c_custkey") % 4)).alias("name"))
    return names.select("id", text.mask(F.col("name")).alias("masked"), text.safe_identifier(F.col("name")).alias("identifier"), text.looks_like_email(F.col("name")).alias("email"), text.preview_width(F.length("name")).alias("width"), text.snake(F.lit("humanReviewNeeded")).alias("snake"))


def bm25_search(spark, d):
    """The ten best chunks of every benchmark text."""
    queries = src.table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    found = retrieval.best_chunks(src.table(spark, d, "documents").filter("text IS NOT NULL"), queries, 10, key="doc_id")
    return found.select("query_id", "doc_id", "rank", F.round("lexical_score", 4).alias("lexical_score"), "terms")


def blended_search(spark, d):
    query = "the of and with information request"
    return retrieval.search_chunks(src.chunks(spark, d), query, 20).withColumn("matched_terms", F.array_join("matched_terms", ","))


def hash_embeddings(spark, d):
    rows = retrieval.embed_chunks(src.chunks(spark, d), 64)
    return rows.select("chunk_id", F.size("embedding").alias("dimensions"), F.round(F.sqrt(scores.dot(F.col("embedding"), F.col("embedding"))), 6).alias("norm"))


def nearest_vectors(spark, d):
    vectors = src.table(spark, d, "embeddings")
    return retrieval.nearest_vectors(vectors, vectors.filter("vec_id = 0").select(F.col("embedding").alias("q")), 20).select("vec_id", F.round("score", 6).alias("score"))


def duplicate_clusters(spark, d):
    return review.duplicate_clusters(src.table(spark, d, "documents"), "doc_id", "text").select("cluster_id", "members", "first_member")


def rater_kappa(spark, d):
    return measures.kappa(src.table(spark, d, "labels"), "quality", "toxic").select("units", *(F.round(c, 9).alias(c) for c in ("observed", "expected", "kappa")))


def bootstrap_interval(spark, d):
    rates = written(measures.bootstrap_agreement(src.table(spark, d, "labels"), "doc_id", "quality", "toxic", 200, 20260721), "rates")
    return measures.order_statistics(rates, "agreement").select(F.round("low", 9).alias("low"), F.round("high", 9).alias("high"), "n")


def value_quantiles(spark, d):
    rows = src.table(spark, d, "events")
    return measures.quantile(rows, "value", 0.1).crossJoin(measures.quantile(rows, "value", 0.9).withColumnRenamed("quantile", "q90")).select(F.round("quantile", 9).alias("q10"), F.round("q90", 9).alias("q90"))


def extractor_scores(spark, d):
    rows = src.table(spark, d, "labels").select(F.when(F.col("doc_id") % 5 > 0, F.col("quality")).alias("gold"), F.when(F.col("doc_id") % 7 > 0, 1 - F.col("toxic")).alias("predicted"))
    return measures.extractor_scores(rows).select("tp", "fp", "fn", *(F.round(c, 9).alias(c) for c in ("coverage", "precision", "recall", "f1")))


def _spans(start, size):
    return F.array(F.struct(start.cast("int").alias("start"), (start + size).cast("int").alias("end")))


def span_overlap(spark, d):
    rows = src.table(spark, d, "orders").select("o_orderkey", _spans(F.col("o_orderkey") % 13, F.col("o_orderkey") % 9).alias("a"), _spans(F.col("o_custkey") % 11, F.col("o_custkey") % 7).alias("b"))
    return rows.select("o_orderkey", F.round(scores.span_iou(F.col("a"), F.col("b")), 9).alias("iou"), scores.spans_valid(F.col("a"), F.lit(15)).alias("valid"), scores.spans_valid(F.col("b"), F.lit(12)).alias("b_valid"))


def _annotators(spark, d):
    rows = src.table(spark, d, "labels").select(F.col("doc_id").alias("unit_id"), "quality", "toxic")
    make = lambda label, k: rows.select("unit_id", F.when(F.col("unit_id") % k > 0, label.cast("string")).alias("label"), F.when(F.col("unit_id") % k == 0, F.when(F.col("unit_id") % 2 == 0, "unclear").otherwise("no_text")).alias("abstention_reason"), F.array(F.struct(F.lit(0).alias("start"), (F.col("unit_id") % k).cast("int").alias("end"))).alias("spans"))
    return make(F.col("quality"), 6), make(1 - F.col("toxic"), 9)


def annotation_disagreements(spark, d):
    return measures.disagreements(*_annotators(spark, d)).withColumn("differs", F.array_join("differs", ","))


def adjudicated_reference(spark, d):
    left, right = _annotators(spark, d)
    decided = measures.disagreements(left, right).filter("unit_id % 4 > 0").select("unit_id", F.lit("1").alias("label"))
    return measures.adjudicate(left, right, decided).groupBy("label", "unsettled").agg(F.count("*").alias("n"))


def annotation_violations(spark, d):
    left, _ = _annotators(spark, d)
    return measures.annotation_violations(left.withColumn("length", F.lit(4)), ["1"], ["unclear"]).groupBy("violation").agg(F.count("*").alias("n"))


def metric_thresholds(spark, d):
    e = src.table(spark, d, "events").groupBy(F.col("event_type").alias("metric")).agg(F.round(F.avg("value"), 6).alias("value"))
    limits = spark.createDataFrame([("click", ">=", 10.0), ("view", "<", 10.0), ("error", ">", 0.0), ("missing", "==", 1.0)], 'metric string, op string, "limit" double'.replace('"', "`"))
    return measures.thresholds(e, limits).select("metric", "op", "passed")


def authority_lookup(spark, d):
    nation, region = src.table(spark, d, "nation"), src.table(spark, d, "region")
    day = lambda c: F.expr(c)
    base = nation.join(region, nation.n_regionkey == region.r_regionkey)
    start, end = day("DATE '1995-01-01' + CAST(n_nationkey * 30 AS INT)"), day("CASE WHEN n_nationkey % 4 = 0 THEN DATE '1999-12-31' + CAST(n_nationkey AS INT) END")
    row = lambda kind, value: base.select(F.concat(F.lit("A"), F.col("n_nationkey")).alias("authority_id"), F.lit(kind).alias("kind"), value.alias("value"), start.alias("valid_from"), end.alias("valid_to"))
    registry = row("id", F.concat(F.lit("A"), F.col("n_nationkey"))).unionByName(row("name", F.lower("n_name"))).unionByName(row("alias", F.concat(F.lower("r_name"), F.lit(" office")))).unionByName(row("tag", F.lower("r_name")))
    spelt = F.when(F.col("c_custkey") % 3 == 0, F.concat(F.lit("  Nation_"), F.col("c_nationkey"))).when(F.col("c_custkey") % 3 == 1, F.lit("ASIA  Office"))
    customer = src.table(spark, d, "customer")
    evidence = customer.select(
        F.col("c_custkey").alias("record_id"), F.when(F.col("c_custkey") % 10 == 0, F.concat(F.lit("A"), F.col("c_nationkey"))).alias("authority_id"), spelt.alias("authority_name"), F.array(F.lit("Europe")).alias("tags"), day("DATE '1996-06-01' + CAST(c_custkey % 1500 AS INT)").alias("as_of")
    )
    return governance.classify_authority(evidence, registry)


_AUTHORITY = """
WITH base AS (SELECT 'A' || n_nationkey AS authority_id, lower(n_name) AS name, lower(r_name) AS region, DATE '1995-01-01' + CAST(n_nationkey * 30 AS INT) AS f, CASE WHEN n_nationkey % 4 = 0 THEN DATE '1999-12-31' + CAST(n_nationkey AS INT) END AS t
    FROM nation JOIN region ON n_regionkey = r_regionkey),
reg AS (SELECT authority_id, 0 AS r, authority_id AS v, f, t FROM base UNION ALL SELECT authority_id, 1, name, f, t FROM base UNION ALL SELECT authority_id, 2, region || ' office', f, t FROM base UNION ALL SELECT authority_id, 3, region, f, t FROM base),
ev AS (SELECT c_custkey AS record_id, DATE '1996-06-01' + CAST(c_custkey % 1500 AS INT) AS as_of, CASE WHEN c_custkey % 10 = 0 THEN 'A' || c_nationkey END AS id, CASE c_custkey % 3 WHEN 0 THEN 'nation_' || c_nationkey WHEN 1 THEN 'asia office' END AS name FROM customer),
keys AS (SELECT record_id, as_of, 0 AS r, id AS v FROM ev UNION ALL SELECT record_id, as_of, 1, name FROM ev UNION ALL SELECT record_id, as_of, 2, name FROM ev UNION ALL SELECT record_id, as_of, 3, 'europe' FROM ev),
hit AS (SELECT DISTINCT record_id, keys.r, authority_id FROM keys JOIN reg ON keys.r = reg.r AND keys.v = reg.v AND f <= as_of AND (t IS NULL OR as_of <= t)),
best AS (SELECT record_id, min(r) AS r FROM hit GROUP BY 1), c AS (SELECT record_id, count(*) AS n, min(authority_id) AS a FROM hit JOIN best USING (record_id, r) GROUP BY 1)
SELECT record_id, CASE WHEN n IS NULL THEN 'unmatched' WHEN n > 1 THEN 'ambiguous' ELSE 'matched' END AS status, CASE WHEN n = 1 THEN a END AS authority_id, CAST(coalesce(n, 0) AS INT) AS candidates FROM ev LEFT JOIN c USING (record_id)
"""


def _assertions(spark, d):
    i = F.col("l_linenumber") + F.col("l_partkey")
    pick = lambda k, *xs: F.array(*map(F.lit, xs))[F.pmod(i * k + F.col("l_suppkey"), F.lit(len(xs)))]
    return src.table(spark, d, "lineitem").select(
        F.concat(F.lit("claim"), F.col("l_orderkey")).alias("claim_id"), F.concat(F.lit("s"), F.col("l_suppkey")).alias("source_id"), pick(1, "supports", "supports", "contradicts").alias("stance"), pick(3, *["available"] * 9, "blocked").alias("availability"),
        pick(5, *["event_time_match"] * 8, "stale").alias("freshness"), pick(7, "permitted", "permitted", "metadata_only", "restricted").alias("rights_status"), F.lit("hash_verified").alias("integrity"),
        pick(2, "primary_law", "official_record", "official_guidance", "derived_summary").alias("authority_tier"), pick(4, "authority_evidence", "authority_evidence", "authority_evidence", "mirror_comparator", "authority_evidence").alias("source_role"),
    )


def triangulation(spark, d):
    out = governance.triangulate(_assertions(spark, d))
    return out.select("claim_id", F.size("supporting").alias("supporting"), F.size("contradicting").alias("contradicting"), F.coalesce("controlling_tier", F.lit("")).alias("controlling_tier"), F.array_join("reasons", ",").alias("reasons"), "status")


def _pick(k: int, *xs: str) -> str:
    return f"list_extract({list(xs)!r}, CAST(((l_linenumber + l_partkey) * {k} + l_suppkey) % {len(xs)} + 1 AS INT))"


_TRIANGULATION = f"""
WITH a AS (SELECT 'claim' || l_orderkey AS claim_id, 's' || l_suppkey AS source_id, {_pick(1, 'supports', 'supports', 'contradicts')} AS stance, {_pick(3, *['available'] * 9, 'blocked')} AS availability,
    {_pick(5, *['event_time_match'] * 8, 'stale')} AS freshness, {_pick(7, 'permitted', 'permitted', 'metadata_only', 'restricted')} AS rights, {_pick(2, 'primary_law', 'official_record', 'official_guidance', 'derived_summary')} AS tier,
    {_pick(4, 'authority_evidence', 'authority_evidence', 'authority_evidence', 'mirror_comparator', 'authority_evidence')} AS role FROM lineitem),
b AS (SELECT *, availability = 'available' AND freshness = 'event_time_match' AND rights <> 'restricted' AS sound,
    CASE tier WHEN 'primary_law' THEN 0 WHEN 'official_record' THEN 1 WHEN 'official_guidance' THEN 2 ELSE 4 END AS rank FROM a),
c AS (SELECT *, sound AND tier <> 'derived_summary' AND role = 'authority_evidence' AS el, sound AND role = 'mirror_comparator' AS cmp FROM b),
g AS (SELECT claim_id, count(DISTINCT source_id) FILTER (WHERE el AND stance = 'supports') AS sup, count(DISTINCT source_id) FILTER (WHERE el AND stance = 'contradicts') AS con,
    arg_min(tier, rank) FILTER (WHERE el) AS best, bool_or(availability = 'blocked') AS blocked, bool_or(freshness = 'stale') AS stale, bool_or(rights = 'restricted') AS rr,
    count(*) FILTER (WHERE cmp AND stance = 'supports') AS cs, count(*) FILTER (WHERE cmp AND stance = 'contradicts') AS cc FROM c GROUP BY 1),
r AS (SELECT *, list_filter([CASE WHEN blocked THEN 'blocked' END, CASE WHEN sup > 0 AND con > 0 THEN 'conflicting' END,
    CASE WHEN (cs > 0 AND con > 0) OR (cc > 0 AND sup > 0) THEN 'comparator_disagreement' END, CASE WHEN stale THEN 'stale' END, CASE WHEN rr THEN 'rights_uncertain' END, CASE WHEN sup < 2 THEN 'insufficient_evidence' END], lambda x: x IS NOT NULL) AS reasons FROM g)
SELECT claim_id, CAST(sup AS INT) AS supporting, CAST(con AS INT) AS contradicting, coalesce(best, '') AS controlling_tier, coalesce(array_to_string(reasons, ','), '') AS reasons,
    CASE WHEN len(reasons) > 0 THEN 'human_exception_required' ELSE 'candidate_supported' END AS status FROM r
"""


def action_policy(spark, d):
    k = F.col("event_id")
    names = [p[0] for p in governance.ACTION_POLICY]
    rows = src.table(spark, d, "events").select(
        k.alias("action_id"), F.array(*map(F.lit, [*names, "no_such_action"]))[F.pmod(k, F.lit(7))].alias("action_type"), F.when(k % 3 == 0, "none").otherwise("preparatory").alias("legal_effect"), (k % 5 == 0).alias("requires_human_certification"),
        F.when(k % 2 == 0, "medium").otherwise("low").alias("safety_class"), F.array(F.lit("certify_timeliness"), F.lit("approve_release")).alias("prohibited"), F.when(k % 4 == 0, F.array(F.lit("declare_search_adequate"))).otherwise(F.array().cast("array<string>")).alias("requested"),
    )
    return governance.evaluate_actions(rows)


_POLICY = f"""
WITH p AS (SELECT * FROM (VALUES {', '.join(f"({i}, '{e}', {str(c).lower()}, '{s}', {p!r}::VARCHAR[])" for i, (_, e, c, s, p) in enumerate(governance.ACTION_POLICY))}) t(i, effect, cert, class, prohibited)),
a AS (SELECT event_id AS action_id, event_id % 7 AS i, CASE WHEN event_id % 3 = 0 THEN 'none' ELSE 'preparatory' END AS le, event_id % 5 = 0 AS rc, CASE WHEN event_id % 2 = 0 THEN 'medium' ELSE 'low' END AS sc, event_id % 4 = 0 AS asks FROM events),
j AS (SELECT * FROM a LEFT JOIN p USING (i))
SELECT action_id, 'error' AS severity, 'unknown_action_type' AS code FROM j WHERE effect IS NULL UNION ALL SELECT action_id, 'error', 'policy_mismatch_legal_effect' FROM j WHERE le <> effect
UNION ALL SELECT action_id, 'error', 'policy_mismatch_requires_human_certification' FROM j WHERE rc <> cert UNION ALL SELECT action_id, 'error', 'policy_mismatch_safety_class' FROM j WHERE sc <> class
UNION ALL SELECT action_id, 'warning', 'missing_prohibited_follow_on_actions' FROM j WHERE len(list_filter(prohibited, lambda x: x NOT IN ('certify_timeliness', 'approve_release'))) > 0
UNION ALL SELECT action_id, 'error', 'prohibited_follow_on_action_requested' FROM j WHERE asks AND list_contains(prohibited, 'declare_search_adequate')
"""


def descriptor_phrases(spark, d):
    return governance.unsafe_phrases(src.table(spark, d, "part"), "p_partkey", "p_name", ["red", "blue bolt", "ring"])


def contract_negotiation(spark, d):
    k = F.col("o_orderkey")
    version = F.when(k % 13 == 0, "1.2").otherwise(F.concat_ws(".", (k % 3).cast("string"), (k % 12).cast("string"), (k % 2).cast("string")))
    rows = src.table(spark, d, "orders").select(
        k.alias("request_id"), F.when(k % 5 == 0, F.array(F.lit("read"))).otherwise(F.array(F.lit("read"), F.lit("diff"))).alias("declared"), F.when(k % 2 == 0, F.array(F.lit("diff"))).otherwise(F.array(F.lit("read"))).alias("needed"), version.alias("requested"),
        F.lit("1.4.0").alias("exact"), F.lit("1.2.0").alias("range_from"), F.lit("1.10.0").alias("range_to"),
    )
    return governance.negotiate(rows)


def capture_selection(spark, d):
    rows = src.table(spark, d, "events").select(F.concat(F.lit("slug"), F.col("user_id")).alias("slug"), F.when(F.col("event_type") == "click", "json").otherwise("html").alias("kind"), F.date_trunc("day", "ts").alias("captured"), F.col("event_id").alias("seq"), F.when(F.col("event_id") % 9 == 0, 404).otherwise(200).alias("status"))
    return governance.latest_captures(rows).select("slug", "kind", F.to_date("captured").alias("captured"), "seq")


def partition_check(spark, d):
    index = src.table(spark, d, "orders").select(F.col("o_orderkey").alias("slug"))
    parts = index.filter("slug % 10 > 0").unionByName(index.filter("slug % 17 = 1")).unionByName(index.filter("slug % 23 = 0").select((-F.col("slug") - 1).alias("slug")))
    return governance.partition_check(index, parts, "slug").groupBy("issue").agg(F.count("*").alias("n"), F.sum("slug").alias("slugs"))


def manifest_audit(spark, d):
    rows = src.table(spark, d, "lineitem").select("l_orderkey", F.when(F.col("l_linenumber") % 6 == 0, "none").otherwise(F.sha2(F.col("l_orderkey").cast("string"), 256)).alias("digest"))
    return governance.manifest_audit(rows, "l_orderkey", "digest").withColumn("blockers", F.array_join("blockers", ","))


def context_packs(spark, d):
    tasks = review.certification_tasks(src.core_events(spark, d)).join(src.core_events(spark, d).select(F.col("event_id").alias("source_id"), "request_id"), "source_id")
    out = governance.context_pack(profiles(spark, d), src.core_events(spark, d), tasks)
    return out.select("request_id", "authority", "normalised_state", "events", F.array_join("event_types", ",").alias("event_types"), F.coalesce("last_event", F.lit("")).alias("last_event"), "open_tasks", F.array_join("next_actions", ",").alias("next_actions"))


def certification_invariant(spark, d):
    """No machine's certificate gets through the gate: by type, events that machines made, those of them that claim a certificate, and those that are passed on with one."""
    made = src.core_events(spark, d).filter("machine_generated").withColumn("human_review_required", F.col("seq") % 4 == 0)
    claims = (F.col("assertion_status") == "certified") | F.coalesce("human_certified", F.lit(False))
    through = gates.passed(made).filter(claims).groupBy("event_type").agg(F.count("*").alias("certified_passed"))
    seen = made.groupBy("event_type").agg(F.count("*").alias("made"), F.count_if(claims).alias("certified_seen"))
    return seen.join(through, "event_type", "left").fillna(0)


def text_buckets(spark, d):
    """FNV-1a buckets of names, checked in SQL by the same fold."""
    names = src.table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.left(F.concat(F.lit("é"), "c_name"), F.lit(6)).alias("name"))
    return names.select("id", fnv1a64(F.col("name")).cast("string").alias("hash"), (fnv1a64(F.col("name")) % 97).cast("long").alias("bucket"))


def record_seals(spark, d):
    """Content ids and self pins of nation records."""
    from ..functions.ids import seal

    rows = src.table(spark, d, "nation")
    return rows.select("n_nationkey", content_id("nation:", F.col("n_name"), F.col("n_regionkey")).alias("content_id"), seal("n_name", "n_nationkey").alias("pin"))


QUERIES = {f.__name__: f for f in (
    doc_tokens, doc_chunks, request_chunks, event_chunks, chunk_totals, risk_assessment, risk_summary, sensitive_spans, review_queue, message_events, page_text, extraction_requests, masks, bm25_search, blended_search, hash_embeddings,
    nearest_vectors, duplicate_clusters, rater_kappa, bootstrap_interval, value_quantiles, extractor_scores, span_overlap, annotation_disagreements, adjudicated_reference, annotation_violations, metric_thresholds, authority_lookup,
    triangulation, action_policy, descriptor_phrases, contract_negotiation, capture_selection, partition_check, manifest_audit, context_packs, certification_invariant, text_buckets, record_seals,
)}

_ANN = """
ann AS (SELECT doc_id AS unit_id, CASE WHEN doc_id % 6 > 0 THEN CAST(quality AS VARCHAR) END AS la, CASE WHEN doc_id % 6 = 0 THEN CASE WHEN doc_id % 2 = 0 THEN 'unclear' ELSE 'no_text' END END AS ra, doc_id % 6 AS sa,
    CASE WHEN doc_id % 9 > 0 THEN CAST(1 - toxic AS VARCHAR) END AS lb, CASE WHEN doc_id % 9 = 0 THEN CASE WHEN doc_id % 2 = 0 THEN 'unclear' ELSE 'no_text' END END AS rb, doc_id % 9 AS sb FROM labels)"""

SQL = {
    "doc_tokens": f"""WITH t AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\\p{{L}}\\p{{M}}\\p{{N}}_]+') AS t, length(coalesce(text, '')) AS n FROM documents)
        SELECT doc_id, CAST(len(t) AS INT) AS tokens, CAST(len(list_distinct(t)) AS INT) AS distinct_tokens, CAST(greatest(1, (n + 3) // 4) AS INT) AS estimate FROM t""",
    "doc_chunks": f"WITH {src.CHUNKS_SQL.strip()} SELECT chunk_id, doc_id FROM chunks",
    "request_chunks": f"""WITH {PROFILES_SQL}, t AS (SELECT request_id, 'Request ' || request_id || '. Authority: ' || authority || '. State: ' || normalised_state || '. Source state: ' || source_state || '.' AS text FROM profiles)
        SELECT 'chunk:' || left(sha256('request' || chr(0) || request_id || chr(0) || '0' || chr(0) || text), 24) AS chunk_id, request_id, text, sha256(text) AS text_sha256, CAST((length(text) + 3) // 4 AS INT) AS token_estimate FROM t""",
    "event_chunks": f"""WITH {EVENTS}, t AS (SELECT event_id, 'Event ' || event_type || ' for request ' || request_id || '. State after: ' || lifecycle_state_after || '. Payload: ' || concat_ws('; ', 'assertion_status: ' || assertion_status, 'generator: ' || generator, 'source_status: ' || legal_source_status) || '.' AS text FROM core_events)
        SELECT 'chunk:' || left(sha256('event' || chr(0) || event_id || chr(0) || '0' || chr(0) || text), 24) AS chunk_id, event_id, text, CAST((length(text) + 3) // 4 AS INT) AS token_estimate FROM t""",
    "chunk_totals": f"""WITH {EVENTS}, t AS (SELECT 'Event ' || event_type || ' for request ' || request_id || '. State after: ' || lifecycle_state_after || '. Payload: ' || concat_ws('; ', 'assertion_status: ' || assertion_status, 'generator: ' || generator, 'source_status: ' || legal_source_status) || '.' AS text FROM core_events)
        SELECT count(*) AS chunks, CAST(sum((length(text) + 3) // 4) AS BIGINT) AS tokens FROM t""",
    "message_events": f"""WITH {src.MESSAGES_SQL.strip()}, m AS (SELECT request_id, position, CASE position % 3 WHEN 0 THEN 'We need an extension of time. ' WHEN 1 THEN 'The documents are attached; some were withheld. ' ELSE '' END || body AS body FROM messages),
        t AS (SELECT * FROM (VALUES ('(?i)\\b(extension|extend(?:ed|ing)?|time\\s*limit|further\\s+working\\s+days)\\b', 'ExtensionNotified', 0.58, true), ('(?i)\\b(transfer(?:red|ring)?|transferring|section\\s+14|s\\s*14)\\b', 'TransferNotified', 0.54, true),
            ('(?i)\\b(clarif(?:y|ication)|scope|refine|narrow|due\\s+particularity)\\b', 'ClarificationRequested', 0.52, false), ('(?i)\\b(charge|charges|charging|deposit|invoice|fee)\\b', 'ChargeNoticeSent', 0.42, true),
            ('(?i)\\b(refuse|refused|decline|declined|withhold|withheld|section\\s+18|s\\s*18)\\b', 'RefusalCommunicated', 0.46, true), ('(?i)\\b(release|released|attached|provided|enclosed|supply|supplied)\\b', 'ReleaseMade', 0.38, true),
            ('(?i)\\b(ombudsman|complaint|complain|review)\\b', 'ComplaintObserved', 0.44, false), ('(?i)\\b(decision|decided|we have considered|our response)\\b', 'DecisionCommunicated', 0.40, true)) v(p, event_type, confidence, cert))
        SELECT request_id, position, 'MessageObserved' AS event_type, CAST(1.0 AS DOUBLE) AS confidence, false AS requires_human_certification FROM m WHERE body <> ''
        UNION ALL SELECT request_id, position, event_type, CAST(confidence AS DOUBLE), cert FROM m, t WHERE body <> '' AND regexp_matches(body, p)""",
    "extraction_requests": "SELECT doc_id, CAST(least(length(coalesce(text, '')), 4000) AS INT) AS chars, left(coalesce(text, ''), 160) AS preview, sha256(coalesce(text, '')) AS text_sha256, length(coalesce(text, '')) > 4000 AS truncated FROM documents",
    "masks": """WITH n AS (SELECT c_custkey AS id, CASE c_custkey % 3 WHEN 0 THEN lower(left(c_mktsegment, 4)) || '@example.org' WHEN 1 THEN c_name ELSE left(c_name, CAST(c_custkey % 4 AS INT)) END AS name FROM customer)
        SELECT id, CASE WHEN length(name) <= 2 THEN repeat('*', length(name)) WHEN contains(name, '@') THEN left(name, 1) || '***@e***' ELSE left(name, 1) || '***' || right(name, 1) END AS masked, regexp_replace(name, '[^0-9A-Za-z]', '_', 'g') AS identifier,
               contains(name, '@') AS email, CAST(CASE WHEN length(name) <= 2 THEN length(name) WHEN length(name) <= 8 THEN 1 ELSE 2 END AS INT) AS width, 'human_review_needed' AS snake FROM n""",
    "bm25_search": """WITH t AS (SELECT doc_id, regexp_extract_all(lower(text), '[\\p{L}\\p{M}\\p{N}_]+') AS w FROM documents WHERE text <> ''), s AS (SELECT count(*) AS n, avg(len(w)) AS a FROM t),
        q AS (SELECT DISTINCT item_id AS query_id, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{M}\\p{N}_]+')) AS term FROM benchmark), tf AS (SELECT doc_id, len(w) AS dl, unnest(w) AS term FROM t),
        c AS (SELECT doc_id, dl, term, count(*) AS tf FROM tf WHERE term IN (SELECT term FROM q) GROUP BY 1, 2, 3), df AS (SELECT term, count(*) AS df FROM c GROUP BY 1),
        sc AS (SELECT query_id, doc_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * (tf * 2.5) / (tf + 1.5 * (0.25 + 0.75 * dl / a))), 6) AS x, count(*) AS terms FROM q JOIN c USING (term) JOIN df USING (term), s GROUP BY 1, 2),
        r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY x DESC, doc_id) AS rank FROM sc) SELECT query_id, doc_id, CAST(rank AS INT) AS rank, round(x, 4) AS lexical_score, CAST(terms AS INT) AS terms FROM r WHERE rank <= 10""",
    "nearest_vectors": """WITH q AS (SELECT list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS q FROM embeddings WHERE vec_id = 0), v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings)
        SELECT vec_id, round(list_dot_product(e, q) / (sqrt(list_dot_product(e, e)) * sqrt(list_dot_product(q, q))), 6) AS score FROM v, q ORDER BY list_dot_product(e, q) / (sqrt(list_dot_product(e, e)) * sqrt(list_dot_product(q, q))) DESC, vec_id LIMIT 20""",
    "duplicate_clusters": "SELECT sha256(trim(regexp_replace(lower(coalesce(text, '')), '\\s+', ' ', 'g'))) AS cluster_id, count(*) AS members, min(doc_id) AS first_member FROM documents GROUP BY 1",
    "rater_kappa": """WITH n AS (SELECT count(*) AS n FROM labels), o AS (SELECT count(*) FILTER (WHERE quality = toxic) / count(*) AS observed FROM labels),
        e AS (SELECT sum(pa * pb) AS expected FROM (SELECT quality AS l, count(*) / (SELECT n FROM n) AS pa FROM labels GROUP BY 1) JOIN (SELECT toxic AS l, count(*) / (SELECT n FROM n) AS pb FROM labels GROUP BY 1) USING (l))
        SELECT n AS units, round(observed, 9) AS observed, round(expected, 9) AS expected, round((observed - expected) / (1 - expected), 9) AS kappa FROM n, o, e""",
    "value_quantiles": "SELECT round(quantile_cont(value, 0.1), 9) AS q10, round(quantile_cont(value, 0.9), 9) AS q90 FROM events",
    "extractor_scores": """WITH r AS (SELECT CASE WHEN doc_id % 5 > 0 THEN quality END AS g, CASE WHEN doc_id % 7 > 0 THEN 1 - toxic END AS p FROM labels),
        c AS (SELECT count(*) FILTER (WHERE g = p) AS tp, count(*) FILTER (WHERE p IS NOT NULL AND g IS DISTINCT FROM p) AS fp, count(*) FILTER (WHERE g IS NOT NULL AND g IS DISTINCT FROM p) AS fn, avg(CAST(p IS NOT NULL AS INT)) AS coverage FROM r)
        SELECT tp, fp, fn, round(coverage, 9) AS coverage, round(tp / (tp + fp), 9) AS precision, round(tp / (tp + fn), 9) AS recall, round(2 * tp / (2 * tp + fp + fn), 9) AS f1 FROM c""",
    "span_overlap": """WITH r AS (SELECT o_orderkey, o_orderkey % 13 AS a0, o_orderkey % 13 + o_orderkey % 9 AS a1, o_custkey % 11 AS b0, o_custkey % 11 + o_custkey % 7 AS b1 FROM orders),
        s AS (SELECT *, greatest(0, least(a1, b1) - greatest(a0, b0)) AS i FROM r)
        SELECT o_orderkey, round(CASE WHEN a1 = a0 AND b1 = b0 THEN 1.0 ELSE i / (a1 - a0 + b1 - b0 - i) END, 9) AS iou, a0 < a1 AND a1 <= 15 AS valid, b0 < b1 AND b1 <= 12 AS b_valid FROM s""",
    "annotation_disagreements": f"""WITH {_ANN.strip()}, x AS (SELECT *, concat_ws(',', CASE WHEN la IS DISTINCT FROM lb THEN 'label' END, CASE WHEN ra IS DISTINCT FROM rb THEN 'abstention_reason' END, CASE WHEN sa <> sb THEN 'spans' END) AS differs FROM ann)
        SELECT unit_id, differs, la AS left_label, lb AS right_label FROM x WHERE differs <> ''""",
    "adjudicated_reference": f"""WITH {_ANN.strip()}, x AS (SELECT *, la IS DISTINCT FROM lb OR ra IS DISTINCT FROM rb OR sa <> sb AS apart FROM ann)
        SELECT CASE WHEN apart AND unit_id % 4 > 0 THEN '1' ELSE la END AS label, apart AND unit_id % 4 = 0 AS unsettled, count(*) AS n FROM x GROUP BY 1, 2""",
    "annotation_violations": f"""WITH {_ANN.strip()}, x AS (SELECT 'missing_reason' AS violation FROM ann WHERE la IS NULL AND ra <> 'unclear' UNION ALL SELECT 'spans_without_label' FROM ann WHERE la IS NULL
        UNION ALL SELECT 'unknown_label' FROM ann WHERE la <> '1' UNION ALL SELECT 'bad_spans' FROM ann WHERE NOT (0 < sa AND sa <= 4)) SELECT violation, count(*) AS n FROM x GROUP BY 1""",
    "metric_thresholds": """WITH m AS (SELECT event_type AS metric, round(avg(value), 6) AS value FROM events GROUP BY 1), l AS (SELECT * FROM (VALUES ('click', '>=', 10.0), ('view', '<', 10.0), ('error', '>', 0.0), ('missing', '==', 1.0)) t(metric, op, lim))
        SELECT metric, op, coalesce(CASE op WHEN '>=' THEN value >= lim WHEN '<' THEN value < lim WHEN '>' THEN value > lim ELSE value = lim END, false) AS passed FROM l LEFT JOIN m USING (metric)""",
    "authority_lookup": _AUTHORITY,
    "triangulation": _TRIANGULATION,
    "action_policy": _POLICY,
    "descriptor_phrases": "SELECT p_partkey, phrase FROM part, (VALUES ('red'), ('blue bolt'), ('ring')) t(phrase) WHERE contains(lower(p_name), phrase)",
    "contract_negotiation": """WITH r AS (SELECT o_orderkey AS k, o_orderkey % 3 AS a, o_orderkey % 12 AS b, o_orderkey % 2 AS c FROM orders)
        SELECT k AS request_id, CASE WHEN k % 5 = 0 AND k % 2 = 0 THEN 'missing_capability' WHEN k % 13 = 0 THEN 'invalid_version' WHEN a = 1 AND b = 4 AND c = 0 THEN 'exact' WHEN a = 1 AND b BETWEEN 2 AND 9 THEN 'compatible_range' WHEN a <> 1 THEN 'unknown_major' ELSE 'unsupported_revision' END AS outcome FROM r""",
    "capture_selection": """WITH c AS (SELECT 'slug' || user_id AS slug, CASE WHEN event_type = 'click' THEN 'json' ELSE 'html' END AS kind, CAST(ts AS DATE) AS captured, event_id AS seq FROM events WHERE event_id % 9 <> 0)
        SELECT slug, kind, captured, seq FROM (SELECT *, row_number() OVER (PARTITION BY slug ORDER BY kind DESC, captured DESC, seq) AS r FROM c) WHERE r = 1""",
    "partition_check": """WITH p AS (SELECT o_orderkey AS s FROM orders WHERE o_orderkey % 10 > 0 UNION ALL SELECT o_orderkey FROM orders WHERE o_orderkey % 17 = 1 UNION ALL SELECT -o_orderkey - 1 FROM orders WHERE o_orderkey % 23 = 0), c AS (SELECT s, count(*) AS n FROM p GROUP BY 1),
        j AS (SELECT coalesce(s, o_orderkey) AS k, CASE WHEN n IS NULL THEN 'missing' WHEN o_orderkey IS NULL THEN 'unknown' WHEN n > 1 THEN 'duplicate' END AS issue FROM orders FULL JOIN c ON o_orderkey = s) SELECT issue, count(*) AS n, CAST(sum(k) AS BIGINT) AS slugs FROM j WHERE issue IS NOT NULL GROUP BY 1""",
    "manifest_audit": """WITH g AS (SELECT l_orderkey, count(*) AS n, count(*) FILTER (WHERE l_linenumber % 6 <> 0) AS v FROM lineitem GROUP BY 1) SELECT CAST(sum(n) AS BIGINT) AS records, count(*) FILTER (WHERE n > 1) AS duplicate_ids, CAST(sum(v) AS BIGINT) AS valid_digests,
        CASE WHEN count(*) FILTER (WHERE n > 1) > 0 AND sum(v) < sum(n) THEN 'duplicate_ids,invalid_digests' ELSE '?' END AS blockers FROM g""",
    "context_packs": f"""WITH {PROFILES_SQL}, {EVENTS}, e AS (SELECT request_id, count(*) AS events, string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS event_types, arg_max(event_id, (event_time, seq)) AS last_event, count(*) FILTER (WHERE requires_human_certification) AS tc,
            count(*) FILTER (WHERE requires_human_certification AND NOT coalesce(human_certified, false)) AS open_tasks, bool_or(event_type = 'MessageObserved') AS msg FROM core_events GROUP BY 1)
        SELECT p.request_id, authority, normalised_state, coalesce(events, 0) AS events, coalesce(event_types, '') AS event_types, coalesce(last_event, '') AS last_event, coalesce(open_tasks, 0) AS open_tasks,
            concat_ws(',', CASE WHEN NOT coalesce(msg, false) THEN 'collect_messages' END, CASE WHEN tc > 0 THEN 'route_to_certifier' END, CASE WHEN open_tasks > 0 THEN 'review_open_tasks' END, CASE WHEN normalised_state = 'Received' THEN 'draft_search_plan' END) AS next_actions
        FROM profiles p LEFT JOIN e ON p.request_id = e.request_id""",
    "certification_invariant": f"""WITH {EVENTS} SELECT event_type, count(*) AS made, count(*) FILTER (WHERE assertion_status = 'certified' OR coalesce(human_certified, false)) AS certified_seen, CAST(0 AS BIGINT) AS certified_passed
        FROM core_events WHERE machine_generated GROUP BY 1""",
    "record_seals": """SELECT n_nationkey, 'nation:' || left(sha256(n_name || chr(0) || n_regionkey), 24) AS content_id, sha256('{"n_name":"' || n_name || '","n_nationkey":' || n_nationkey || '}') AS pin FROM nation""",
}
