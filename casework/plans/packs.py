"""Queries on annotation tasks, roles, packs, traces and codebooks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import governed, measures, tasks
from ..session import written
from ..sources import tables as src
from .audits import _artifacts
from .process import EVENTS, PROFILES_SQL, profiles
from .texts import _ANN, _annotators


def _risks(spark, d) -> DataFrame:
    """Assessments of two in three documents, for some a second one."""
    k = F.col("doc_id")
    level = lambda n: F.when(k % 4 == n, "high").when(k % 4 == 1, "low").when(k % 4 == 2, "unheard")
    found = lambda n: F.array_compact(F.array(F.when(k % 5 == n, "personal_information"), F.when(k % 7 == n, "health_information"), F.when(k % 2 == n, "consultation"), F.when(k % 3 == 1, "ai_workload")))
    rows = src.table(spark, d, "documents")
    make = lambda rows, n: rows.select(k.cast("string").alias("source_id"), level(n).alias("risk_level"), found(n).alias("categories"), F.lit(n).alias("seq"))
    return make(rows.filter(k % 3 > 0), 0).unionByName(make(rows.filter(k % 9 == 1), 1))


def goldset_chunk_tasks(spark, d):
    chunks = src.table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("chunk_id"), "source", "text").withColumnRenamed("source", "request_id")
    return tasks.risk_triage_tasks(chunks, _risks(spark, d), "seq").select("task_id", "source_id", "request_id", "priority", "prefilled_label")


def goldset_request_tasks(spark, d):
    rows = profiles(spark, d).withColumns({"title": F.when(F.col("request_id").cast("long") % 5 > 0, F.concat(F.lit("Request "), "request_id")), "mapping_confidence": F.col("mapping_confidence")})
    events = src.core_events(spark, d).withColumn("evidence_ids", F.transform(F.sequence(F.lit(1), F.greatest("evidence_count", F.lit(1))), lambda i: F.concat("event_id", F.lit("/"), i)))
    found = tasks.state_mapping_tasks(rows, events)
    return found.select("task_id", "request_id", "priority", "prefilled_label", F.size("event_hints").alias("hints"), F.try_element_at("event_hints", F.lit(1))["event_id"].alias("first_hint"))


ROLES = {"annotator_a": "the (of|and)|und d", "annotator_b": "the of and|und der"}
CANDIDATE = "que l|wh[aeiou]t"


def role_annotations(spark, d):
    found = tasks.role_annotations(src.table(spark, d, "documents"), ROLES, CANDIDATE, "doc_id")
    return found.select("doc_id", "unit_sha256", "role", "label", "abstention", "abstention_reason", F.col("span.start").alias("start"), F.col("span.end").alias("end"))


def trace_spans(spark, d):
    return tasks.trace_spans(_artifacts(spark, d).select("run_id", "path", "sha256"))


def agent_packs(spark, d):
    """Streams of messages, events and line items; hits of the benchmark's kind on other requests and profiles."""
    base = profiles(spark, d).select("request_id", F.when(F.col("request_id").cast("long") % 6 > 0, F.col("source_state")).alias("profile"))
    lines = src.table(spark, d, "lineitem").select(F.col("l_orderkey").cast("string").alias("request_id"), F.sha2(F.concat_ws("/", "l_orderkey", "l_linenumber", "l_partkey"), 256).alias("record_sha256"))
    events = src.core_events(spark, d).select("request_id", F.sha2("event_id", 256).alias("record_sha256"))
    k = F.col("l_orderkey")
    hits = src.table(spark, d, "lineitem").select(k.cast("string").alias("for_request"), F.concat_ws("/", "l_orderkey", "l_linenumber").alias("hit_id"), F.when(F.col("l_linenumber") % 3 == 0, (k + F.col("l_partkey") % 2).cast("string")).alias("request_id"), F.when(F.col("l_partkey") % 5 > 0, "successful").alias("profile"))
    return tasks.agent_packs(base, {"lines": lines, "events": events}, hits).select("request_id", "lines", "lines_sha256", "events", "events_sha256", "hits", "request_mismatch", "profile_mismatch", "both_mismatch")


def codebook_overlays(spark, d):
    """A codebook of the nations' balances of trade names, with an overlay for each customer segment and nation."""
    version = spark.sql("SELECT 'core' AS section, 'version' AS key, '1.2.0' AS value")
    nations = src.table(spark, d, "nation")
    core = version.unionByName(nations.select(F.when(F.col("n_regionkey") < 3, "terminology").otherwise("span_policy").alias("section"), F.col("n_name").alias("key"), F.col("n_regionkey").cast("string").alias("value")))
    digest = core.select(F.sha2(F.concat_ws("\x1f", "section", "key", "value"), 256).alias("h")).agg(F.sha2(F.concat(F.array_join(F.sort_array(F.collect_list("h")), "\n"), F.lit("\n")), 256).alias("pin"))
    k = F.col("c_custkey")
    rows = src.table(spark, d, "customer").join(nations, F.col("c_nationkey") == F.col("n_nationkey")).crossJoin(F.broadcast(digest)).select(
        F.concat(F.lit("o"), F.floor(k / 20).cast("string")).alias("overlay_id"), F.when(F.floor(k / 20) % 7 == 0, "1.1.0").otherwise("1.2.0").alias("core_version"), F.when(F.floor(k / 20) % 11 == 0, "stale").otherwise(F.col("pin")).alias("core_sha256"),
        F.when(k % 97 == 0, "evidence").when(F.col("n_regionkey") < 3, "terminology").otherwise("span_policy").alias("section"), F.col("n_name").alias("key"), k.cast("string").alias("value"),
    )
    rows = rows.groupBy("overlay_id", "core_version", "core_sha256", "section", "key").agg(F.max("value").alias("value"))
    resolved, problems = tasks.resolve_overlays(core, rows)
    summary = resolved.groupBy("overlay_id").agg(F.count("*").alias("settings"), F.count_if("overridden").alias("overridden"), F.lit("").alias("codes"))
    broken = problems.groupBy("overlay_id").agg(F.array_join(F.array_sort(F.collect_set("code")), ",").alias("codes")).select("overlay_id", F.lit(0).cast("long").alias("settings"), F.lit(0).cast("long").alias("overridden"), "codes")
    return summary.unionByName(broken)


def embedding_provenance(spark, d):
    rows = tasks.embedding_records(src.chunks(spark, d).select("chunk_id", "text"), 64)
    return rows.groupBy("chunk_id", "text_sha256", F.col("provenance.provider").alias("provider"), F.col("provenance.dimensions").alias("dimensions"), F.size("embedding").alias("size")).agg(F.countDistinct("vector_sha256").alias("vectors"))


QUERIES = {f.__name__: f for f in (goldset_chunk_tasks, goldset_request_tasks, role_annotations, trace_spans, agent_packs, codebook_overlays, embedding_provenance)}

_ROLE = """SELECT doc_id, t, '%s' AS role, regexp_extract(t, '(?is)^(.*?)(%s)', ['b', 'm', 'x']) AS own, regexp_extract(t, '(?is)^(.*?)(%s)', ['b', 'm']) AS other FROM d"""
_GOLD = "'gold:' || left(sha256('%s' || chr(0) || %s || chr(0) || %s), 24)"

SQL = {
    "goldset_chunk_tasks": f"""WITH r AS (SELECT doc_id, text, source, CASE WHEN doc_id % 9 = 1 THEN 1 WHEN doc_id % 3 > 0 THEN 0 END AS n, doc_id AS k FROM documents WHERE coalesce(text, '') <> ''),
        c AS (SELECT *, n IS NOT NULL AS has, CASE WHEN k % 4 = n THEN 'high' WHEN k % 4 = 1 THEN 'low' END AS level, n IS NOT NULL AND k % 5 = n AS personal, n IS NOT NULL AND k % 7 = n AS health, n IS NOT NULL AND k % 2 = n AS consult, n IS NOT NULL AND k % 3 = 1 AS ai FROM r)
        SELECT {_GOLD % ('risk_triage', 'k', 'text')} AS task_id, CAST(k AS VARCHAR) AS source_id, source AS request_id, CASE WHEN has THEN coalesce(level, 'medium') ELSE 'medium' END AS priority,
            CASE WHEN NOT has THEN NULL WHEN health THEN 'health' WHEN personal THEN 'privacy' WHEN ai THEN 'ai_generated_request' WHEN consult THEN 'consultation' ELSE 'no_review_trigger' END AS prefilled_label FROM c""",
    "goldset_request_tasks": f"""WITH {PROFILES_SQL}, {EVENTS}, h AS (SELECT request_id, count(*) AS n, min(event_id) AS f FROM core_events GROUP BY 1),
        t AS (SELECT *, CASE WHEN CAST(request_id AS BIGINT) % 5 > 0 THEN 'Request ' || request_id ELSE 'Untitled request' END || chr(10) || 'Authority: ' || authority || chr(10) || 'Source state: ' || source_state || chr(10) || 'Normalised state: ' || normalised_state AS body FROM profiles)
        SELECT {_GOLD % ('state_mapping', 't.request_id', 'body')} AS task_id, t.request_id, CASE WHEN mapping_confidence < 0.5 THEN 'high' ELSE 'medium' END AS priority, normalised_state AS prefilled_label, CAST(coalesce(n, 0) AS INT) AS hints, f AS first_hint
        FROM t LEFT JOIN h ON t.request_id = h.request_id""",
    "role_annotations": f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
        r AS (SELECT doc_id, t, role, own.b AS ob, own.m AS om, other.b AS cb, other.m AS cm FROM ({_ROLE % ('annotator_a', ROLES['annotator_a'], CANDIDATE)} UNION ALL {(_ROLE % ('annotator_b', ROLES['annotator_b'], CANDIDATE)).replace(", 'x'", "")}))
        SELECT doc_id, sha256(t) AS unit_sha256, role, CASE WHEN om <> '' THEN 'observed' WHEN cm <> '' THEN 'candidate' ELSE 'unknown' END AS label, om = '' AND cm = '' AS abstention, CASE WHEN om = '' AND cm = '' THEN 'insufficient_evidence' END AS abstention_reason,
            CAST(CASE WHEN om <> '' THEN length(ob) WHEN cm <> '' THEN length(cb) END AS INT) AS start, CAST(CASE WHEN om <> '' THEN length(ob) + length(om) WHEN cm <> '' THEN length(cb) + length(cm) END AS INT) AS "end" FROM r""",
    "trace_spans": """WITH a AS (SELECT CAST(p_partkey - p_partkey % 40 AS VARCHAR) AS run_id, 'a/' || p_partkey AS path, sha256(coalesce(p_name, '')) AS sha FROM part),
        r AS (SELECT run_id, left(sha256(run_id || '|' || string_agg(path, '|' ORDER BY path)), 32) AS trace_id, count(*) AS n FROM a GROUP BY 1), t AS (SELECT *, left(sha256(trace_id || ':root'), 16) AS root FROM r),
        s AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY path, sha) - 1 AS i FROM a)
        SELECT run_id, trace_id, root AS span_id, CAST(NULL AS VARCHAR) AS parent_span_id, run_id AS name, CAST(n AS INT) AS sequence, CAST(NULL AS VARCHAR) AS link FROM t
        UNION ALL SELECT s.run_id, trace_id, left(sha256(trace_id || ':' || i || ':' || path || ':' || sha), 16), root, 'artifact.observed', CAST(i AS INT), 'sha256:' || sha FROM s JOIN t ON s.run_id = t.run_id""",
    "agent_packs": f"""WITH {PROFILES_SQL}, {EVENTS}, root AS (SELECT request_id, count(*) AS n, sha256(string_agg(h, chr(10) ORDER BY h) || chr(10)) AS sha FROM (SELECT request_id, sha256(event_id) AS h FROM core_events) GROUP BY 1),
        line AS (SELECT CAST(l_orderkey AS VARCHAR) AS request_id, count(*) AS n, sha256(string_agg(h, chr(10) ORDER BY h) || chr(10)) AS sha FROM (SELECT l_orderkey, sha256(l_orderkey || '/' || l_linenumber || '/' || l_partkey) AS h FROM lineitem) GROUP BY 1),
        hit AS (SELECT CAST(l_orderkey AS VARCHAR) AS request_id, l_linenumber % 3 = 0 AND l_partkey % 2 = 1 AS other, l_partkey % 5 > 0 AND l_orderkey % 6 > 0 AND source_state <> 'successful' AS unlike FROM lineitem JOIN profiles ON request_id = CAST(l_orderkey AS VARCHAR)),
        sums AS (SELECT request_id, count(*) FILTER (WHERE NOT (other OR unlike)) AS hits, count(*) FILTER (WHERE other) AS o, count(*) FILTER (WHERE unlike) AS u, count(*) FILTER (WHERE other AND unlike) AS b FROM hit GROUP BY 1)
        SELECT p.request_id, coalesce(line.n, 0) AS lines, line.sha AS lines_sha256, coalesce(root.n, 0) AS events, root.sha AS events_sha256, coalesce(hits, 0) AS hits, coalesce(o, 0) AS request_mismatch, coalesce(u, 0) AS profile_mismatch, coalesce(b, 0) AS both_mismatch
        FROM profiles p LEFT JOIN line ON p.request_id = line.request_id LEFT JOIN root ON p.request_id = root.request_id LEFT JOIN sums ON p.request_id = sums.request_id""",
    "codebook_overlays": """WITH r AS (SELECT DISTINCT 'o' || c_custkey // 20 AS overlay_id, c_custkey // 20 AS g, CASE WHEN c_custkey % 97 = 0 THEN 'evidence' WHEN n_regionkey < 3 THEN 'terminology' ELSE 'span_policy' END AS section, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey),
        o AS (SELECT overlay_id, g, count(*) AS n, bool_or(section = 'evidence') AS bad FROM r GROUP BY 1, 2)
        SELECT overlay_id, CASE WHEN bad OR g % 7 = 0 OR g % 11 = 0 THEN 0 ELSE (SELECT count(*) + 1 FROM nation) END AS settings, CASE WHEN bad OR g % 7 = 0 OR g % 11 = 0 THEN 0 ELSE n END AS overridden,
            concat_ws(',', CASE WHEN g % 11 = 0 THEN 'core_digest_mismatch' END, CASE WHEN g % 7 = 0 THEN 'core_version_mismatch' END, CASE WHEN bad THEN 'section_not_overridable' END) AS codes FROM o""",
    "embedding_provenance": f"WITH {src.CHUNKS_SQL.strip()} SELECT DISTINCT chunk_id, sha256(text) AS text_sha256, 'local' AS provider, 64 AS dimensions, 64 AS size, CAST(1 AS BIGINT) AS vectors FROM chunks",
}


def sealed_envelopes(spark, d):
    """Orders as sealed documents, some changed, stripped of their pin or broken since."""
    k = F.col("o_orderkey")
    body = F.to_json(F.struct(F.col("o_orderstatus").alias("z"), F.struct(k.alias("order"), F.lit("é\"").alias("a")).alias("nested"), F.array(k, F.lit(2)).alias("b")))
    spread = src.table(spark, d, "orders").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), k)  # a row is few bytes and much work, so a file is too much for a task
    docs = spread.select(k.alias("order_id"), F.concat(F.lit(" "), body).alias("text"))
    sealed = written(governed.seal_documents(docs, "order_id", "text", "pin"), "sealed")
    later = F.when(F.col("order_id") % 11 == 0, F.replace("sealed", F.lit('"order"'), F.lit('"Order"'))).when(F.col("order_id") % 13 == 0, F.regexp_replace("sealed", ',"pin":"[0-9a-f]*"', "")).when(F.col("order_id") % 17 == 0, F.lit("[]")).otherwise(F.regexp_replace("sealed", ",", " , "))
    return governed.seal_problems(sealed.select("order_id", later.alias("sealed")), "order_id", "sealed", "pin")


def candidate_frame(spark, d):
    k = F.col("page_id")
    pages = src.table(spark, d, "pages").select(k, F.concat(F.lit("s"), k).alias("slug"), F.sha2(F.coalesce("html", F.lit("")), 256).alias("raw_sha256"), "url")
    replay = pages.filter(k % 7 > 0).select("slug", F.when(k % 5 == 0, "x").otherwise(F.col("raw_sha256")).alias("raw_sha256"), F.when(k % 3 > 0, F.col("url")).otherwise(" ").alias("text"))
    return governed.candidate_frame(pages, replay)


def queue_accounting(spark, d):
    left, right = _annotators(spark, d)
    apart = measures.disagreements(left, right).select("unit_id")
    decisions = apart.filter("unit_id % 4 > 0").unionByName(apart.filter("unit_id % 8 = 1")).unionByName(left.join(apart, "unit_id", "left_anti").filter("unit_id % 5 = 0").select("unit_id"))
    return governed.queue_accounting(left, right, decisions)


def mapping_problems(spark, d):
    k = F.col("c_custkey")
    sources = src.table(spark, d, "nation").select(F.concat(F.lit("n"), F.col("n_nationkey")).alias("source_id"))
    rows = src.table(spark, d, "customer").select(
        k.cast("string").alias("reference_id"), F.when(k % 9 > 0, F.concat(F.lit("n"), F.col("c_nationkey") + F.when(k % 10 == 0, 100).otherwise(0))).alias("source_id"), F.when(k % 4 == 0, "verified").when(k % 4 == 1, "odd").otherwise("stale").alias("status"),
        F.when(k % 5 == 0, " ").otherwise("statute").alias("basis"), F.when(k % 6 == 0, "soon").otherwise("2026-01-02T03:04:05Z").alias("retrieved_at"),
    )
    return governed.mapping_problems(rows, sources)


QUERIES |= {f.__name__: f for f in (sealed_envelopes, candidate_frame, queue_accounting, mapping_problems)}
SQL |= {
    "sealed_envelopes": """SELECT o_orderkey AS order_id, CASE WHEN o_orderkey % 11 = 0 THEN 'pin_mismatch' WHEN o_orderkey % 13 = 0 THEN 'pin_missing' ELSE 'not_an_object' END AS code FROM orders WHERE o_orderkey % 11 = 0 OR o_orderkey % 13 = 0 OR o_orderkey % 17 = 0""",
    "candidate_frame": """SELECT 's' || page_id AS slug, CASE WHEN page_id % 7 = 0 THEN 'not_replayed' WHEN page_id % 5 = 0 THEN 'digest_mismatch' WHEN page_id % 3 = 0 OR trim(coalesce(url, '')) = '' THEN 'no_text' ELSE 'accessible' END AS access,
        CASE WHEN page_id % 7 > 0 AND page_id % 5 > 0 AND page_id % 3 > 0 AND trim(coalesce(url, '')) <> '' THEN sha256(url) END AS text_sha256 FROM pages""",
    "queue_accounting": f"""WITH {_ANN.strip()}, u AS (SELECT unit_id, la IS DISTINCT FROM lb OR ra IS DISTINCT FROM rb OR sa <> sb AS apart FROM ann),
        c AS (SELECT count(*) FILTER (WHERE apart) AS disagreements, count(*) FILTER (WHERE apart AND unit_id % 4 > 0) AS decided, count(*) FILTER (WHERE apart AND unit_id % 4 = 0) AS undecided, count(*) FILTER (WHERE NOT apart AND unit_id % 5 = 0) AS unasked, count(*) FILTER (WHERE apart AND unit_id % 8 = 1) AS repeated FROM u)
        SELECT *, undecided = 0 AND unasked = 0 AND repeated = 0 AS ok FROM c""",
    "mapping_problems": """WITH c AS (SELECT c_custkey AS k, CAST(c_custkey AS VARCHAR) AS reference_id FROM customer), v AS (SELECT reference_id, 'missing_source_id' AS code FROM c WHERE k % 9 = 0 UNION ALL SELECT reference_id, 'missing_basis' FROM c WHERE k % 5 = 0
        UNION ALL SELECT reference_id, 'status_not_registered' FROM c WHERE k % 4 = 1 UNION ALL SELECT reference_id, 'unreadable_time' FROM c WHERE k % 6 = 0 UNION ALL SELECT reference_id, 'unknown_source' FROM c WHERE k % 10 = 0 AND k % 9 > 0) SELECT * FROM v""",
}
