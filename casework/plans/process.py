"""Queries on requests and events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import dims
from ..functions import scores
from ..operators import clock, events, ledger, measures, requests, review
from ..sources import tables as src

STATE_CASE = """CASE source_state WHEN 'successful' THEN 'ReleasedInFull' WHEN 'waiting_response' THEN 'Received' WHEN 'partially_successful' THEN 'ReleasedInPart' ELSE 'Unknown' END"""
PROFILES_SQL = f"""{src.REQUESTS_SQL.strip()}, profiles AS (
    SELECT *, {STATE_CASE} AS normalised_state,
           CASE source_state WHEN 'successful' THEN 0.55 WHEN 'waiting_response' THEN 0.74 WHEN 'partially_successful' THEN 0.58 ELSE 0.0 END AS mapping_confidence
    FROM requests
)"""
EVENTS = src.EVENTS_SQL.strip()


def profiles(spark: SparkSession, d: str) -> DataFrame:
    return requests.map_states(src.requests(spark, d))


def request_profiles(spark, d):
    return profiles(spark, d).select("request_id", "authority", "source_state", "normalised_state", "mapping_confidence", "mapping_status")


def state_summary(spark, d):
    return requests.summarise_requests(profiles(spark, d))


def top_authorities(spark, d):
    return requests.top_authorities(profiles(spark, d).withColumn("seq", F.col("request_id").cast("long")))


def state_audit(spark, d):
    return requests.audit_states(src.requests(spark, d))


def state_key_variants(spark, d):
    """Raw states in many spellings all map alike."""
    spelt = F.when(F.col("o_orderkey") % 3 == 0, "  Waiting-Response ").when(F.col("o_orderkey") % 3 == 1, "PARTIALLY successful").otherwise("no such state")
    rows = src.table(spark, d, "orders").select(spelt.alias("source_state"))
    return requests.map_states(rows).groupBy("normalised_state", "mapping_status").agg(F.count("*").alias("n"))


def request_uuids(spark, d):
    return src.requests(spark, d).select("request_id", requests.event_id(F.lit("request-observed"), F.col("request_id"), F.col("source_state")).alias("event_urn"))


def observed_events(spark, d):
    return requests.observed_events(profiles(spark, d)).select("event_id", "request_id", "event_type", "assertion_status", F.round("confidence", 6).alias("confidence"), "lifecycle_state_after")


_OBSERVED = """
SELECT request_id, t.event_type, t.assertion_status, t.confidence, normalised_state AS lifecycle_state_after,
       'https://example.org/event/' || t.kind || '/' || request_id || '/' || CASE WHEN t.kind = 'state-observed' THEN source_state ELSE '' END || '/' AS name
FROM profiles, LATERAL (VALUES ('request-observed', 'RequestObserved', 'observed', 1.0), ('state-observed', 'StateObserved', 'inferred', CAST(mapping_confidence AS DOUBLE)),
                               ('deadline-calculated', 'DeadlineCalculated', 'inferred', 0.42)) t(kind, event_type, assertion_status, confidence)
"""
_UUID = """'urn:uuid:' || h[1:8] || '-' || h[9:12] || '-5' || h[14:16] || '-' || substr('89ab', CAST(('0x' || h[17:17])::INT % 4 + 1 AS INT), 1) || h[18:20] || '-' || h[21:32]"""
_SHA1 = "sha1(unhex('6ba7b8119dad11d180b400c04fd430c8') || encode(name))"


def event_summary(spark, d):
    return events.summarise_events(src.core_events(spark, d))


def quality_gate(spark, d):
    return events.quality_findings(src.core_events(spark, d))


def quality_summary(spark, d):
    return events.quality_summary(events.quality_findings(src.core_events(spark, d)))


def guardrail_replay(spark, d):
    return events.replay_guardrails(src.core_events(spark, d))


_QUALITY = f"""
WITH {EVENTS}, e AS (
    SELECT *, event_type IN ('ReleaseMade', 'RefusalCommunicated', 'ExtensionNotified') AS disp, assertion_status = 'certified' AS cert FROM core_events
), f AS (
    SELECT event_id, request_id, 'error' AS severity, 'missing_evidence' AS code FROM e WHERE evidence_count = 0
    UNION ALL SELECT event_id, request_id, 'warning', 'missing_generator' FROM e WHERE machine_generated AND generator IS NULL
    UNION ALL SELECT event_id, request_id, 'error', 'certification_boundary_bypassed' FROM e WHERE disp AND NOT requires_human_certification
    UNION ALL SELECT event_id, request_id, 'error', 'missing_human_certification_metadata' FROM e WHERE disp AND human_certified IS NULL
    UNION ALL SELECT event_id, request_id, 'error', 'false_certified_assertion' FROM e WHERE disp AND human_certified = false AND cert
    UNION ALL SELECT event_id, request_id, 'warning', 'certification_status_mismatch' FROM e WHERE disp AND human_certified AND NOT cert
    UNION ALL SELECT event_id, request_id, 'warning', 'unversioned_legal_reference' FROM e WHERE legal_source_status IS NULL
    UNION ALL SELECT event_id, request_id, 'warning', 'stale_or_unverified_legal_reference' FROM e WHERE legal_source_status = 'external_gate'
    UNION ALL SELECT event_id, request_id, 'warning', 'machine_generated_certified_event' FROM e WHERE cert AND machine_generated
)
"""


def transition_audit(spark, d):
    return events.audit_transitions(src.core_events(spark, d))


def transition_summary(spark, d):
    return events.audit_summary(src.core_events(spark, d))


_ALLOWED = " OR ".join(f"(from_state = '{a}' AND to_state = '{b}')" for a, bs in dims.TRANSITIONS.items() for b in bs if a in ("Received", "Searching", "ExtensionApplied") and b in ("Searching", "ExtensionApplied", "ReleasedInFull", "Refused", "Received"))
_MOVES = f"""{EVENTS}, moves AS (
    SELECT request_id, lag(event_id) OVER w AS previous_event_id, event_id, lag(lifecycle_state_after) OVER w AS from_state, lifecycle_state_after AS to_state
    FROM core_events WINDOW w AS (PARTITION BY request_id ORDER BY event_time, seq)
), changes AS (SELECT *, {_ALLOWED} AS allowed FROM moves WHERE from_state <> to_state)"""


def timeline(spark, d):
    return events.timeline(src.core_events(spark, d)).select("request_id", "event_id", "event_type", "position", F.coalesce("warning", F.lit("")).alias("warning"))


def validity_intervals(spark, d):
    versions = src.table(spark, d, "orders").select(F.col("o_custkey").alias("customer"), F.to_date("o_orderdate").alias("as_at")).distinct()
    return events.validity_intervals(versions, "customer", "as_at").select("customer", "valid_from", "valid_to")


def directly_follows(spark, d):
    return events.directly_follows(src.core_events(spark, d))


def case_conformance(spark, d):
    return events.conformance(src.core_events(spark, d), ["RequestObserved", "MessageObserved", "ReleaseMade"], ("RequestObserved", "ReleaseMade"))


def case_traces(spark, d):
    return events.case_traces(src.core_events(spark, d)).select("request_id", F.array_join("activities", ">").alias("activities"), "events")


def case_objects(spark, d):
    return events.case_objects(src.core_events(spark, d), "assertion_status", "generator")


def xes_traces(spark, d):
    return events.xes_lines(src.core_events(spark, d)).select("request_id", F.sha2("trace", 256).alias("trace_sha256"), F.length("trace").alias("chars"))


def _calendar(spark):
    holidays = spark.sql("SELECT explode(array(DATE '1997-02-06', DATE '1998-04-10', DATE '1999-06-07')) AS day")
    return clock.calendar(spark, "1990-01-01", "2010-12-31", holidays)


def due_dates(spark, d):
    rows = clock.indicative_clock(src.requests(spark, d).select("request_id", "first_sent"), _calendar(spark), has_holidays=True)
    return rows.select("request_id", "first_sent", "decision_due", "transfer_due", "confidence", F.array_join("warnings", ",").alias("warnings"))


def response_status(spark, d):
    rows = clock.indicative_clock(profiles(spark, d).select("request_id", "first_sent", "normalised_state"), _calendar(spark), has_holidays=True)
    return clock.response_status(rows, "1999-01-01").groupBy("normalised_state", "overdue_state").agg(F.count("*").alias("n"))


_DUE = """
cal AS (
    SELECT day, working, sum(CAST(working AS INT)) OVER (ORDER BY day) AS idx FROM (
        SELECT day, isodow(day) < 6 AND NOT ((month(day) = 12 AND day(day) >= 25) OR (month(day) = 1 AND day(day) <= 15))
               AND day NOT IN (DATE '1997-02-06', DATE '1998-04-10', DATE '1999-06-07') AS working
        FROM (SELECT CAST(unnest(generate_series(DATE '1990-01-01', DATE '2010-12-31', INTERVAL 1 DAY)) AS DATE) AS day))
), due AS (
    SELECT r.*, a.day AS decision_due, b.day AS transfer_due FROM profiles r JOIN cal c ON r.first_sent = c.day
    LEFT JOIN cal a ON a.working AND a.idx = c.idx + 20 LEFT JOIN cal b ON b.working AND b.idx = c.idx + 10
)"""


def snapshot_diff(spark, d):
    orders = src.table(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    after = orders.filter("o_orderkey % 7 <> 3").withColumn("o_orderstatus", F.when(F.col("o_orderkey") % 5 == 0, "X").otherwise(F.col("o_orderstatus")))
    before = orders.filter("o_orderkey % 11 <> 4")
    return review.snapshot_diff(before, after, "o_orderkey").groupBy("change").agg(F.count("*").alias("n"), F.sum("o_orderkey").alias("key_sum"))


def certification_queue(spark, d):
    tasks = review.certification_tasks(src.core_events(spark, d))
    return review.dedupe_tasks(tasks.unionByName(tasks)).select("task_id", "source_id", "priority")


def goldset_sample(spark, d):
    rows = src.requests(spark, d).select("request_id", "authority")
    return review.stratified_sample(rows, "request_id", "authority", "gold", 10, 100).select("request_id", "authority", "rank")


def random_sample(spark, d):
    return review.simple_sample(src.requests(spark, d).select("request_id"), "request_id", 20260721, 100).select("request_id", "population", F.round("probability", 9).alias("probability"), F.round("weight", 6).alias("weight"))


def holdout_sample(spark, d):
    units = src.requests(spark, d).select("request_id")
    return review.complement_holdout(units, review.simple_sample(units, "request_id", 20260721, 100), "request_id", 7, 50).select("request_id")


def frame_checks(spark, d):
    units = src.requests(spark, d).select("request_id")
    inside = units.filter("CAST(request_id AS LONG) % 4 > 0")
    return review.frame_checks(units, inside, units.subtract(inside), "request_id")


_SCORE = "sha256('{\"seed\":' || %d || ',\"unit\":\"' || request_id || '\"}')"


def metric_report(spark, d):
    return measures.metric_report(src.core_events(spark, d)).withColumn("matched_types", F.array_join("matched_types", ","))


def _pred_gold(spark, d):
    rows = src.core_events(spark, d)
    return rows.filter("seq % 3 <> 0"), rows.filter("seq % 4 <> 0")


def event_evaluation(spark, d):
    return measures.set_scores(*_pred_gold(spark, d)).select("tp", "fp", "fn", *(F.round(c, 9).alias(c) for c in ("precision", "recall", "f1")))


def strict_evaluation(spark, d):
    return measures.set_scores(*_pred_gold(spark, d), mode="strict").select("tp", "fp", "fn", *(F.round(c, 9).alias(c) for c in ("precision", "recall", "f1")))


def _prf_sql(key: str) -> str:
    return f"""WITH {EVENTS}, p AS (SELECT DISTINCT {key} AS k FROM core_events WHERE seq % 3 <> 0), g AS (SELECT DISTINCT {key} AS k FROM core_events WHERE seq % 4 <> 0),
    c AS (SELECT count(*) FILTER (WHERE p.k IS NOT NULL AND g.k IS NOT NULL) AS tp, count(*) FILTER (WHERE g.k IS NULL) AS fp, count(*) FILTER (WHERE p.k IS NULL) AS fn FROM p FULL JOIN g ON p.k = g.k)
    SELECT tp, fp, fn, round(tp / (tp + fp), 9) AS precision, round(tp / (tp + fn), 9) AS recall, round(2 * tp / (2 * tp + fp + fn), 9) AS f1 FROM c"""


def ledger_chain(spark, d):
    rows = src.core_events(spark, d).withColumn("record_sha256_in", F.sha2(F.concat_ws("\x00", "event_id", "event_type"), 256))
    return ledger.build_ledger(rows, "request_id", "seq", "record_sha256_in").select("request_id", "sequence", "seq", "record_sha256", "previous_sha256", "ledger_sha256")


def ledger_roots(spark, d):
    rows = src.core_events(spark, d).select("request_id", F.sha2("event_id", 256).alias("h"))
    return ledger.root_digest(rows, "request_id", "h")


def graph_nodes(spark, d):
    return ledger.graph_nodes(profiles(spark, d), src.core_events(spark, d))


def graph_edges(spark, d):
    return ledger.graph_edges(profiles(spark, d), src.core_events(spark, d))


def event_triples(spark, d):
    return ledger.event_triples(src.core_events(spark, d))


def kernel_scores(spark, d):
    """The scalar kernels over events: bands, ranks, risk, blends."""
    e = src.core_events(spark, d)
    c = F.col("confidence")
    return e.select(
        "event_id", scores.kernel_band(c).alias("kernel_band"), scores.summary_band(c).alias("summary_band"), scores.transition_rank(F.col("lifecycle_state_after")).alias("rank"), scores.is_forward(F.lit("Searching"), F.col("lifecycle_state_after")).alias("forward"),
        scores.kernel_risk(F.col("evidence_count"), F.lit(False)).alias("risk"), F.round(scores.blend(c, 1 - c, F.lit(0.7)), 9).alias("blended"), F.round(scores.unit_cosine(2 * c - 1), 9).alias("unit_cosine"), scores.clamp_top_k(F.col("evidence_count") - 1, F.lit(2)).alias("top_k"),
    )


QUERIES = {f.__name__: f for f in (
    state_summary, request_profiles, top_authorities, state_audit, state_key_variants, request_uuids, observed_events, event_summary, quality_gate, quality_summary, guardrail_replay, transition_audit, transition_summary,
    timeline, validity_intervals, directly_follows, case_conformance, case_traces, case_objects, xes_traces, due_dates, response_status, snapshot_diff, certification_queue, goldset_sample, random_sample, holdout_sample,
    frame_checks, metric_report, event_evaluation, strict_evaluation, ledger_chain, ledger_roots, graph_nodes, graph_edges, event_triples, kernel_scores,
)}

SQL = {
    "state_summary": f"WITH {PROFILES_SQL} SELECT normalised_state, count(*) AS n FROM profiles GROUP BY 1",
    "request_profiles": f"WITH {PROFILES_SQL} SELECT request_id, authority, source_state, normalised_state, CAST(mapping_confidence AS DOUBLE) AS mapping_confidence, CASE WHEN normalised_state = 'Unknown' THEN 'unknown' ELSE 'inferred' END AS mapping_status FROM profiles",
    "top_authorities": f"WITH {PROFILES_SQL} SELECT authority, count(*) AS n, min(CAST(request_id AS BIGINT)) AS first_seq FROM profiles GROUP BY 1 ORDER BY n DESC, first_seq LIMIT 20",
    "state_audit": f"WITH {PROFILES_SQL} SELECT source_state, count(*) AS n, normalised_state <> 'Unknown' AS mapped FROM profiles GROUP BY ALL",
    "state_key_variants": """SELECT CASE o_orderkey % 3 WHEN 0 THEN 'Received' WHEN 1 THEN 'ReleasedInPart' ELSE 'Unknown' END AS normalised_state,
        CASE o_orderkey % 3 WHEN 2 THEN 'unknown' ELSE 'inferred' END AS mapping_status, count(*) AS n FROM orders GROUP BY 1, 2""",
    "request_uuids": f"""WITH {PROFILES_SQL}, n AS (SELECT request_id, 'https://example.org/event/request-observed/' || request_id || '/' || source_state || '/' AS name FROM profiles),
        h AS (SELECT request_id, {_SHA1} AS h FROM n) SELECT request_id, {_UUID} AS event_urn FROM h""",
    "observed_events": f"""WITH {PROFILES_SQL}, n AS ({_OBSERVED}), h AS (SELECT *, {_SHA1} AS h FROM n)
        SELECT {_UUID} AS event_id, request_id, event_type, assertion_status, round(CAST(confidence AS DOUBLE), 6) AS confidence, lifecycle_state_after FROM h""",
    "event_summary": f"""WITH {EVENTS}, x AS (
        SELECT 'event_type' AS dimension, event_type AS key FROM core_events UNION ALL SELECT 'assertion_status', assertion_status FROM core_events
        UNION ALL SELECT 'confidence_band', CASE WHEN confidence >= 0.8 THEN 'high' WHEN confidence >= 0.5 THEN 'medium' WHEN confidence > 0 THEN 'low' ELSE 'zero' END FROM core_events
        UNION ALL SELECT 'condition', 'requires_human_certification' FROM core_events WHERE requires_human_certification
        UNION ALL SELECT 'condition', 'machine_generated' FROM core_events WHERE machine_generated
        UNION ALL SELECT 'quality_flag', unnest(quality_flags) FROM core_events) SELECT dimension, key, count(*) AS n FROM x GROUP BY 1, 2""",
    "quality_gate": _QUALITY + "SELECT * FROM f",
    "quality_summary": _QUALITY + "SELECT count(*) AS finding_count, count(*) FILTER (WHERE severity = 'error') AS error_count, count(*) FILTER (WHERE severity = 'warning') AS warning_count, count(*) FILTER (WHERE severity = 'error') = 0 AS ok FROM f",
    "guardrail_replay": f"""WITH {EVENTS}, e AS (SELECT *, event_type IN ('ReleaseMade', 'RefusalCommunicated', 'ExtensionNotified') AS disp, assertion_status = 'certified' AS cert FROM core_events)
        SELECT event_id, 'error' AS severity, 'machine_generated_certified_event' AS code FROM e WHERE cert AND machine_generated
        UNION ALL SELECT event_id, 'error', 'certification_boundary_bypassed' FROM e WHERE disp AND NOT requires_human_certification
        UNION ALL SELECT event_id, 'error', 'certified_without_human' FROM e WHERE disp AND cert AND NOT coalesce(human_certified, false)""",
    "transition_audit": f"WITH {_MOVES} SELECT request_id, previous_event_id, event_id, from_state, to_state FROM changes WHERE NOT allowed",
    "transition_summary": f"""WITH {_MOVES} SELECT (SELECT count(DISTINCT request_id) FROM core_events) AS request_count, count(*) AS transition_count,
        count(*) FILTER (WHERE NOT allowed) AS finding_count, count(*) FILTER (WHERE NOT allowed) = 0 AS ok FROM changes""",
    "timeline": f"WITH {EVENTS} SELECT request_id, event_id, event_type, CAST(row_number() OVER (PARTITION BY request_id ORDER BY event_time, seq) AS INT) AS position, '' AS warning FROM core_events",
    "validity_intervals": "SELECT o_custkey AS customer, d AS valid_from, lead(d) OVER (PARTITION BY o_custkey ORDER BY d) AS valid_to FROM (SELECT DISTINCT o_custkey, CAST(o_orderdate AS DATE) AS d FROM orders)",
    "directly_follows": f"""WITH {EVENTS}, x AS (SELECT event_type, lead(event_type) OVER (PARTITION BY request_id ORDER BY event_time, event_id) AS next_type FROM core_events)
        SELECT event_type, next_type, count(*) AS n FROM x WHERE next_type IS NOT NULL GROUP BY 1, 2""",
    "case_conformance": f"""WITH {EVENTS}, t AS (SELECT request_id, list(event_type ORDER BY event_time, event_id) AS a, count(*) AS events FROM core_events GROUP BY 1)
        SELECT request_id, events, a = ['RequestObserved', 'MessageObserved', 'ReleaseMade'] AS on_path,
               coalesce(list_position(a, 'RequestObserved'), 0) > 0 AND coalesce(list_position(a, 'ReleaseMade'), 0) > 0 AND list_position(a, 'RequestObserved') < list_position(a, 'ReleaseMade') AS ordered FROM t""",
    "case_traces": f"WITH {EVENTS} SELECT request_id, string_agg(event_type, '>' ORDER BY event_time, event_id) AS activities, count(*) AS events FROM core_events GROUP BY 1",
    "case_objects": f"""WITH {EVENTS}, r AS (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY event_time, event_id) AS n, count(*) OVER (PARTITION BY request_id) AS events FROM core_events)
        SELECT request_id, assertion_status, generator, events FROM r WHERE n = 1""",
    "xes_traces": f"""WITH {EVENTS}, t AS (SELECT request_id, '  <trace>' || chr(10) || '    <string key="concept:name" value="' || request_id || '"/>' || chr(10) || string_agg(
        '    <event><string key="concept:name" value="' || event_type || '"/><string key="event_id" value="' || event_id || '"/><date key="time:timestamp" value="' || strftime(event_time, '%Y-%m-%dT%H:%M:%S') || '"/></event>',
        chr(10) ORDER BY event_time, event_id) || chr(10) || '  </trace>' AS trace FROM core_events GROUP BY request_id)
        SELECT request_id, sha256(trace) AS trace_sha256, CAST(length(trace) AS INT) AS chars FROM t""",
    "due_dates": f"WITH {PROFILES_SQL}, {_DUE.strip()} SELECT request_id, first_sent, decision_due, transfer_due, CAST(0.62 AS DOUBLE) AS confidence, '' AS warnings FROM due",
    "response_status": f"""WITH {PROFILES_SQL}, {_DUE.strip()} SELECT normalised_state, CASE WHEN normalised_state IN ('ReleasedInFull', 'ReleasedInPart') THEN 'answered'
        WHEN decision_due < DATE '1999-01-01' THEN 'deemed_refusal_candidate' ELSE 'within_time' END AS overdue_state, count(*) AS n FROM due GROUP BY 1, 2""",
    "snapshot_diff": """WITH b AS (SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders WHERE o_orderkey % 11 <> 4),
        a AS (SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN 'X' ELSE o_orderstatus END AS o_orderstatus, o_totalprice FROM orders WHERE o_orderkey % 7 <> 3),
        j AS (SELECT coalesce(a.o_orderkey, b.o_orderkey) AS k, CASE WHEN b.o_orderkey IS NULL THEN 'added' WHEN a.o_orderkey IS NULL THEN 'removed' WHEN a.o_orderstatus <> b.o_orderstatus THEN 'modified' ELSE 'unchanged' END AS change
              FROM a FULL JOIN b ON a.o_orderkey = b.o_orderkey) SELECT change, count(*) AS n, CAST(sum(k) AS BIGINT) AS key_sum FROM j GROUP BY 1""",
    "certification_queue": f"""WITH {EVENTS} SELECT 'task:' || left(sha256('certification_review' || chr(0) || event_id || chr(0) || event_type || ' needs human certification'), 24) AS task_id, event_id AS source_id, 'high' AS priority
        FROM core_events WHERE requires_human_certification AND NOT coalesce(human_certified, false)""",
    "goldset_sample": f"""WITH {src.REQUESTS_SQL.strip()}, r AS (SELECT request_id, authority, sha256('gold:' || request_id) AS s, row_number() OVER (PARTITION BY authority ORDER BY sha256('gold:' || request_id)) AS rank FROM requests)
        SELECT request_id, authority, CAST(rank AS INT) AS rank FROM (SELECT * FROM r WHERE rank <= 10 ORDER BY authority, s LIMIT 100)""",
    "random_sample": f"""WITH {src.REQUESTS_SQL.strip()}, n AS (SELECT count(*) AS population FROM requests)
        SELECT request_id, population, round(least(1.0, 100.0 / population), 9) AS probability, round(1 / least(1.0, 100.0 / population), 6) AS weight FROM requests, n ORDER BY {_SCORE % 20260721}, request_id LIMIT 100""",
    "holdout_sample": f"""WITH {src.REQUESTS_SQL.strip()}, prior AS (SELECT request_id FROM requests ORDER BY {_SCORE % 20260721}, request_id LIMIT 100)
        SELECT request_id FROM requests WHERE request_id NOT IN (SELECT request_id FROM prior) ORDER BY {_SCORE % 7}, request_id LIMIT 50""",
    "frame_checks": "SELECT count(*) AS population, count(*) FILTER (WHERE o_orderkey % 4 > 0) AS included, count(*) FILTER (WHERE o_orderkey % 4 = 0) AS excluded, CAST(0 AS BIGINT) AS overlap, CAST(0 AS BIGINT) AS unknown, true AS ok FROM orders",
    "metric_report": f"""WITH {EVENTS}, m AS (SELECT * FROM (VALUES ('requests_received', 'derived', ['RequestObserved']), ('messages_exchanged', 'derived', ['MessageObserved']), ('extensions_notified', 'partial', ['ExtensionNotified']),
        ('requests_answered', 'partial', ['ReleaseMade', 'RefusalCommunicated']), ('internal_workload', 'not_derivable', [])) t(metric_id, status, deps)),
        a AS (SELECT metric_id, status, count(event_id) AS event_count, count(DISTINCT request_id) AS request_count, coalesce(array_to_string(list_sort(list_distinct(list(event_type) FILTER (WHERE event_type IS NOT NULL))), ','), '') AS matched_types
              FROM m LEFT JOIN core_events ON list_contains(deps, event_type) GROUP BY 1, 2)
        SELECT metric_id, event_count, request_count, matched_types, status, CASE WHEN status = 'not_derivable' THEN NULL WHEN request_count > 0 THEN request_count ELSE event_count END AS value FROM a""",
    "event_evaluation": _prf_sql("request_id || '|' || event_type || '|' || lifecycle_state_after"),
    "strict_evaluation": _prf_sql("request_id || '|' || event_type || '|' || lifecycle_state_after || '|' || assertion_status || '|' || CAST(confidence AS DECIMAL(9, 2))"),
    "ledger_chain": f"""WITH RECURSIVE {EVENTS}, r AS (SELECT request_id, seq, sha256(event_id || chr(0) || event_type) AS h, row_number() OVER (PARTITION BY request_id ORDER BY seq) - 1 AS sequence FROM core_events),
        c AS (SELECT request_id, sequence, seq, h, repeat('0', 64) AS previous, sha256(repeat('0', 64) || chr(10) || h) AS ledger FROM r WHERE sequence = 0
              UNION ALL SELECT r.request_id, r.sequence, r.seq, r.h, c.ledger, sha256(c.ledger || chr(10) || r.h) FROM c JOIN r ON r.request_id = c.request_id AND r.sequence = c.sequence + 1)
        SELECT request_id, CAST(sequence AS INT) AS sequence, seq, h AS record_sha256, previous AS previous_sha256, ledger AS ledger_sha256 FROM c""",
    "ledger_roots": f"WITH {EVENTS} SELECT request_id, sha256(string_agg(sha256(event_id), chr(10) ORDER BY sha256(event_id)) || chr(10)) AS root_sha256, count(*) AS entries FROM core_events GROUP BY 1",
    "graph_nodes": f"""WITH {PROFILES_SQL}, {EVENTS}, n AS (SELECT 'request:' || request_id AS id, 'request' AS kind, normalised_state AS label, 0 AS r FROM profiles UNION ALL SELECT 'authority:' || authority, 'authority', authority, 0 FROM profiles
        UNION ALL SELECT 'event:' || event_id, 'event', event_type, 0 FROM core_events UNION ALL SELECT 'request:' || request_id, 'request', request_id, 1 FROM core_events
        UNION ALL SELECT 'state:' || lifecycle_state_after, 'state', lifecycle_state_after, 1 FROM core_events)
        SELECT id, kind, label FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY r, label) AS i FROM n) WHERE i = 1""",
    "graph_edges": f"""WITH {PROFILES_SQL}, {EVENTS} SELECT 'request:' || request_id AS source, 'authority:' || authority AS target, 'addressed_to' AS label FROM profiles
        UNION ALL SELECT 'request:' || request_id, 'event:' || event_id, 'has_event' FROM core_events UNION ALL SELECT 'event:' || event_id, 'state:' || lifecycle_state_after, 'results_in' FROM core_events
        UNION ALL SELECT * FROM (SELECT 'event:' || lag(event_id) OVER (PARTITION BY request_id ORDER BY seq) AS source, 'event:' || event_id AS target, 'next_event' AS label FROM core_events) WHERE source IS NOT NULL""",
    "event_triples": f"""WITH {EVENTS}, x AS (SELECT '<https://example.org/event/' || replace(event_id, ':', '_') || '>' AS s, * FROM core_events)
        SELECT s, '<https://example.org/ns#type>' AS p, '<https://example.org/type/' || CASE event_type WHEN 'RequestObserved' THEN 'request_observed' WHEN 'MessageObserved' THEN 'message_observed' WHEN 'ExtensionNotified' THEN 'extension_notified' WHEN 'ReleaseMade' THEN 'release_made' ELSE 'refusal_communicated' END || '>' AS o FROM x
        UNION SELECT s, '<https://example.org/ns#request>', '<https://example.org/request/' || request_id || '>' FROM x UNION SELECT s, '<https://example.org/ns#stateAfter>', '<https://example.org/state/' || lifecycle_state_after || '>' FROM x
        UNION SELECT s, '<https://example.org/ns#assertionStatus>', '"' || assertion_status || '"' FROM x""",
    "kernel_scores": f"""WITH {EVENTS} SELECT event_id, CASE WHEN confidence <= 0 THEN 'none' WHEN confidence < 0.5 THEN 'low' WHEN confidence < 0.8 THEN 'medium' ELSE 'high' END AS kernel_band,
        CASE WHEN confidence >= 0.8 THEN 'high' WHEN confidence >= 0.5 THEN 'medium' WHEN confidence > 0 THEN 'low' ELSE 'zero' END AS summary_band,
        CASE lifecycle_state_after WHEN 'Received' THEN 2 WHEN 'Searching' THEN 7 WHEN 'ExtensionApplied' THEN 9 ELSE 13 END AS rank, lifecycle_state_after <> 'Received' AS forward,
        CASE WHEN evidence_count >= 5 THEN 'high' WHEN evidence_count >= 1 THEN 'medium' ELSE 'low' END AS risk, round(0.7 * confidence + 0.3 * (1 - confidence), 9) AS blended, round(confidence, 9) AS unit_cosine,
        CASE WHEN evidence_count - 1 <= 0 THEN 1 ELSE least(evidence_count - 1, 2) END AS top_k FROM core_events""",
}
