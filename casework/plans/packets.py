"""Queries on packets, deltas and checks of runs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import packets
from ..sources import tables as src


def redacted_context(spark, d):
    nested = F.struct("o_orderkey", F.struct(F.col("o_custkey").alias("secret"), F.col("o_orderstatus").alias("state")).alias("inner"), F.array(F.struct(F.lit(1).alias("token"), F.lit("ä").alias("kept"))).alias("list"))
    rows = src.table(spark, d, "orders").select("o_orderkey", F.to_json(nested).alias("context"))
    return packets.redact_keys(rows, "o_orderkey", "context", ("secret", "token", "password")).withColumn("removed", F.array_join("removed", ","))


def blinded_packets(spark, d):
    parts = src.table(spark, d, "part")
    members = parts.filter("p_partkey % 10 <> 3").select("p_partkey").unionByName(parts.filter("p_partkey % 20 = 0").select((-F.col("p_partkey")).alias("p_partkey")))
    return packets.blinded_packets(parts, members, "p_partkey", "p_name", ("annotator_a", "annotator_b"))


def legacy_labels(spark, d):
    rows = src.table(spark, d, "labels").select("doc_id", F.when(F.col("doc_id") % 5 == 0, " Unknown").otherwise(F.col("quality").cast("string")).alias("label"))
    return packets.legacy_labels(rows, "label").groupBy("label", "original", "abstention_reason").agg(F.count("*").alias("n"))


def reextraction_delta(spark, d):
    rows = src.table(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice", F.lit(1).alias("retrieved"))
    new = rows.filter("o_orderkey % 9 <> 4").withColumn("retrieved", F.when(F.col("o_orderkey") % 4 == 0, 2).otherwise(1)).withColumn("o_orderstatus", F.when(F.col("o_orderkey") % 6 == 0, "Z").otherwise(F.col("o_orderstatus")))
    return packets.reextraction_delta(new, rows.filter("o_orderkey % 8 <> 5"), "o_orderkey", ("retrieved",)).groupBy("change").agg(F.count("*").alias("n"))


def context_diffs(spark, d):
    rows = src.table(spark, d, "orders").select("o_orderkey", F.array_distinct(F.array((F.col("o_orderkey") % 3).cast("string"), (F.col("o_orderkey") % 5).cast("string"))).alias("evidence"), F.col("o_orderstatus").alias("plan"), F.col("o_orderpriority").alias("constraint"))
    after = rows.filter("o_orderkey % 7 > 0").select("o_orderkey", F.filter("evidence", lambda e: e != "1").alias("evidence"), F.when(F.col("o_orderkey") % 2 == 0, "X").otherwise(F.col("plan")).alias("plan"), "constraint")
    out = packets.context_diff(rows, after, "o_orderkey", ("plan", "constraint"))
    return out.select("o_orderkey", *(F.array_join(c, ",").alias(c) for c in ("added", "removed", "changed_fields")), "abstain")


def tuple_disagreements(spark, d):
    rows = src.table(spark, d, "labels")
    other = rows.withColumn("toxic", F.when(F.col("doc_id") % 4 > 0, F.col("toxic")))
    return packets.tuple_disagreements(rows, other, "doc_id", ("quality", "toxic"))


def registered_metrics(spark, d):
    rows = src.table(spark, d, "events").groupBy(F.concat(F.lit("events."), F.col("event_type"), F.lit(".count")).alias("path")).agg(F.count("*").cast("double").alias("value"))
    known = spark.sql("SELECT explode(array('events.click.count', 'events.view.count', 'events.none.count')) AS path")
    return packets.registered_metrics(rows, known)


def subset_frame(spark, d):
    return packets.subset_frame(src.table(spark, d, "documents"), "doc_id", ("source", "lang", "text"))


def membership_recomputed(spark, d):
    rows = src.table(spark, d, "lineitem").select("l_orderkey", "l_returnflag")
    stored = rows.filter("l_orderkey % 50 > 0")
    return packets.recomputed_equal(stored, rows.filter("l_orderkey % 40 > 0"))


def run_violations(spark, d):
    k = F.col("o_orderkey")
    name = lambda n, p: F.concat(F.lit(p), (k % n).cast("string"))
    runs = src.table(spark, d, "orders").select(
        k.cast("string").alias("run_id"), F.array(name(3, "c"), F.lit("c9")).alias("allowed"), F.array(name(4, "c")).alias("forbidden"), F.array(name(2, "c")).alias("used"), (k % 11).alias("selected"), (k % 5).alias("excluded"), F.lit(6).alias("population"),
        F.array(name(2, "d"), name(3, "d")).alias("inputs"), F.array(name(3, "d"), name(2, "d")).alias("recorded"),
    )
    return packets.run_violations(runs).groupBy("violation").agg(F.count("*").alias("n"))


def stage_violations(spark, d):
    rows = src.table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("run_id"), (F.col("l_linenumber") - 1).alias("position"), F.when(F.col("l_returnflag") == "N", "completed").when(F.col("l_returnflag") == "A", "running").otherwise("pending").alias("status"),
        F.lower("l_linestatus").alias("input"), F.lower("l_linestatus").alias("output"),
    )
    return packets.stage_violations(rows.groupBy("run_id", "position").agg(F.min("status").alias("status"), F.min("input").alias("input"), F.min("output").alias("output")))


QUERIES = {f.__name__: f for f in (
    redacted_context, blinded_packets, legacy_labels, reextraction_delta, context_diffs, tuple_disagreements, registered_metrics, subset_frame, membership_recomputed, run_violations, stage_violations,
)}

_NORM = "trim(regexp_replace(lower(coalesce(%s, '')), '\\s+', ' ', 'g'))"

SQL = {
    "redacted_context": """SELECT o_orderkey, '{"inner":{"state":"' || o_orderstatus || '"},"list":[{"kept":"ä"}],"o_orderkey":' || o_orderkey || '}' AS redacted, 'secret,token' AS removed FROM orders""",
    "blinded_packets": """WITH m AS (SELECT p_partkey AS k FROM part WHERE p_partkey % 10 <> 3 UNION ALL SELECT -p_partkey FROM part WHERE p_partkey % 20 = 0),
        j AS (SELECT coalesce(p_partkey, k) AS p_partkey, CASE WHEN p_partkey IS NOT NULL THEN sha256(CAST(p_partkey AS VARCHAR) || chr(0) || coalesce(p_name, '')) END AS unit_sha256, CASE WHEN p_partkey IS NULL THEN 'missing' WHEN k IS NULL THEN 'unknown' END AS issue FROM part FULL JOIN m ON p_partkey = k)
        SELECT p_partkey, unit_sha256, issue, role FROM j, (VALUES ('annotator_a'), ('annotator_b')) r(role)""",
    "legacy_labels": """SELECT CASE WHEN doc_id % 5 <> 0 THEN CAST(quality AS VARCHAR) END AS label, CASE WHEN doc_id % 5 = 0 THEN ' Unknown' ELSE CAST(quality AS VARCHAR) END AS original,
        CASE WHEN doc_id % 5 = 0 THEN 'legacy_unknown' END AS abstention_reason, count(*) AS n FROM labels GROUP BY 1, 2, 3""",
    "reextraction_delta": """WITH k AS (SELECT o_orderkey AS k FROM orders WHERE o_orderkey % 9 <> 4 OR o_orderkey % 8 <> 5)
        SELECT CASE WHEN k % 8 = 5 THEN 'added' WHEN k % 9 = 4 THEN 'removed' WHEN k % 6 = 0 THEN 'modified' WHEN k % 4 = 0 THEN 'provenance_changed' ELSE 'unchanged' END AS change, count(*) AS n FROM k GROUP BY 1""",
    "context_diffs": """WITH r AS (SELECT o_orderkey, o_orderkey % 7 > 0 AS there, list_sort(list_distinct([CAST(o_orderkey % 3 AS VARCHAR), CAST(o_orderkey % 5 AS VARCHAR)])) AS e, o_orderstatus <> 'X' AND o_orderkey % 2 = 0 AS moved FROM orders)
        SELECT o_orderkey, '' AS added, array_to_string(list_filter(e, lambda x: x = '1' OR NOT there), ',') AS removed,
               CASE WHEN NOT there THEN 'plan,constraint' WHEN moved THEN 'plan' ELSE '' END AS changed_fields, NOT there OR e = ['1'] AS abstain FROM r""",
    "tuple_disagreements": "SELECT doc_id FROM labels WHERE doc_id % 4 = 0 AND toxic IS NOT NULL",
    "registered_metrics": """WITH m AS (SELECT 'events.' || event_type || '.count' AS path, CAST(count(*) AS DOUBLE) AS value FROM events GROUP BY 1), k AS (SELECT * FROM (VALUES ('events.click.count'), ('events.view.count'), ('events.none.count')) t(p))
        SELECT coalesce(path, p) AS path, CASE WHEN p IS NULL THEN 'refused' WHEN value IS NULL THEN 'missing' ELSE 'fetched' END AS status, CASE WHEN p IS NOT NULL THEN value END AS value FROM m FULL JOIN k ON path = p""",
    "subset_frame": f"""WITH u AS (SELECT doc_id, sha256({_NORM % 'source'} || chr(31) || {_NORM % 'lang'} || chr(31) || {_NORM % 'text'}) AS cluster_id FROM documents)
        SELECT doc_id, cluster_id, sha256(CAST(doc_id AS VARCHAR) || chr(31) || cluster_id) AS unit_sha256, count(*) OVER w AS members, min(doc_id) OVER w AS first_member FROM u WINDOW w AS (PARTITION BY cluster_id)""",
    "membership_recomputed": """SELECT count(*) FILTER (WHERE l_orderkey % 50 > 0 AND l_orderkey % 40 = 0) AS only_stored, count(*) FILTER (WHERE l_orderkey % 40 > 0 AND l_orderkey % 50 = 0) AS only_recomputed,
        count(*) FILTER (WHERE (l_orderkey % 40 > 0) <> (l_orderkey % 50 > 0)) = 0 AS equal FROM lineitem""",
    "run_violations": """WITH k AS (SELECT o_orderkey AS k FROM orders), v AS (SELECT 'capability_conflict' AS violation FROM k WHERE k % 3 = k % 4 UNION ALL SELECT 'capability_not_allowed' FROM k WHERE k % 2 <> k % 3
        UNION ALL SELECT 'population_not_conserved' FROM k WHERE k % 11 + k % 5 <> 6) SELECT violation, count(*) AS n FROM v GROUP BY 1""",
    "stage_violations": """WITH s AS (SELECT l_orderkey AS run_id, l_linenumber - 1 AS position, min(CASE l_returnflag WHEN 'N' THEN 'completed' WHEN 'A' THEN 'running' ELSE 'pending' END) AS status, min(lower(l_linestatus)) AS io FROM lineitem GROUP BY 1, 2),
        b AS (SELECT *, lag(status) OVER w AS bs, lag(io) OVER w AS bo, lag(position) OVER w AS bp FROM s WINDOW w AS (PARTITION BY run_id ORDER BY position))
        SELECT run_id, max(position) FILTER (WHERE status = 'completed') AS last_completed, count(*) FILTER (WHERE bp IS NOT NULL AND status <> 'pending' AND bs <> 'completed') AS predecessor_incomplete,
               count(*) FILTER (WHERE bp IS NOT NULL AND io <> bo) AS broken_lineage, count(*) FILTER (WHERE coalesce(bp + 1, 0) <> position) AS gap_in_order FROM b GROUP BY 1""",
}
