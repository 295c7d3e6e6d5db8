"""Queries on rules of documents, provenance, statutory decisions, agreement and draws."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators import agreement, captures, decisions, documents, drawing, extractors, gates, lineage
from ..sources import tables as src
from .process import _DUE, _calendar

ORDER_SCHEMA = {
    "type": "object",
    "required": ["id", "status", "priority"],
    "additionalProperties": False,
    "properties": {
        "id": {"type": "integer", "minimum": 1},
        "status": {"enum": ["F", "O"]},
        "priority": {"type": "string", "pattern": "^[1-5]-", "maxLength": 8},
        "lines": {"type": "array", "minItems": 2, "items": {"$ref": "#/$defs/line"}},
    },
    "$defs": {
        "line": {
            "type": "object",
            "properties": {"quantity": {"type": "number", "maximum": 45}, "flag": {"type": "string", "enum": ["A", "N"]}, "shipped": {"type": "string", "format": "date"}, "tax": {"exclusiveMaximum": 0.08}},
        }
    },
}


def _order_documents(spark, d) -> DataFrame:
    """An order with its lines as a JSON document; some lack a priority, some have a note more."""
    lines = src.table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct("l_linenumber", F.col("l_quantity").alias("quantity"), F.col("l_returnflag").alias("flag"), F.col("l_tax").alias("tax"), F.date_format("l_shipdate", "yyyy-MM-dd").alias("shipped")))).alias("l"))
    k = F.col("o_orderkey")
    body = F.to_json(
        F.struct(
            k.alias("id"), F.col("o_orderstatus").alias("status"), F.when(k % 11 != 0, F.col("o_orderpriority")).alias("priority"), F.when(k % 13 == 0, "x").alias("note"),
            F.transform("l", lambda x: F.struct(*(x[c].alias(c) for c in ("quantity", "flag", "tax", "shipped")))).alias("lines"),
        )
    )
    return src.table(spark, d, "orders").join(lines, k == F.col("l_orderkey"), "left").select(k.alias("line"), F.when(k % 101 == 0, F.lit("{broken")).otherwise(body).alias("text"))


def schema_errors(spark, d):
    return documents.schema_errors(_order_documents(spark, d), ORDER_SCHEMA).select("line", "path", "keyword", "message")


def _artifacts(spark, d) -> DataFrame:
    k = F.col("p_partkey")
    kind = F.when(k % 40 < 3, "raw").when(k % 40 == 3, "schema").when(k % 40 == 4, "unknown").when(k % 40 < 20, "derived").when(k % 40 < 30, "report").otherwise("ontology")
    rows = src.table(spark, d, "part").select((k - k % 40).cast("string").alias("run_id"), kind.alias("kind"), F.concat(F.lit("a/"), k).alias("path"), F.sha2(F.coalesce("p_name", F.lit("")), 256).alias("sha256"))
    return lineage.artifact_ids(rows)


def lineage_edges(spark, d):
    return lineage.artifact_edges(_artifacts(spark, d)).select("run_id", "edge_id", "relation")


def _successions(spark, d) -> DataFrame:
    """Each order with the next one of its customer."""
    after = F.lead("o_orderkey").over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey"))
    return src.table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderdate", after.alias("next"))


def lineage_reach(spark, d):
    """How many pairs of orders lie so many steps apart; some customers' orders form a circle."""
    rows = _successions(spark, d)
    first = F.min(F.struct("o_orderkey")).over(Window.partitionBy("o_custkey"))["o_orderkey"]
    edges = rows.withColumn("first", first).select(F.col("o_orderkey").alias("source"), F.when((F.col("o_custkey") % 50 == 0) & F.col("next").isNull(), F.col("first")).otherwise(F.col("next")).alias("target"))
    return lineage.reachable(edges).groupBy("steps").agg(F.count("*").alias("pairs"), F.count_if(F.col("source") == F.col("target")).alias("circular"))


def pin_chains(spark, d):
    """Every order pins the next one; some digests differ, some targets don't exist."""
    digest = lambda c: F.sha2(c.cast("string"), 256)
    rows = _successions(spark, d)
    artifacts = rows.select(F.col("o_orderkey").alias("id"), digest(F.col("o_orderkey")).alias("sha256"))
    k, to = F.col("o_orderkey"), F.col("next")
    pins = rows.filter("next IS NOT NULL").select(k.alias("id"), F.when(k % 101 == 0, -to).otherwise(to).alias("pinned_id"), F.when(k % 97 == 0, F.lit("0")).otherwise(digest(to)).alias("pinned_sha256"))
    return lineage.pin_chains(artifacts, pins).select("id", "broken", F.array_join("codes", ",").alias("codes"), "distance")


def lifecycle_audit(spark, d):
    k, to = F.col("o_orderkey"), F.col("next")
    first = F.first("o_orderkey").over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    rows = _successions(spark, d).withColumn("first", first)
    target = F.when((F.col("o_custkey") % 40 == 0) & to.isNull() & (F.col("first") != k), F.col("first")).when(k % 103 == 0, -k - 1).otherwise(to)
    rows = rows.select(k.alias("id"), target.alias("superseded_by"), F.when(target.isNotNull(), "superseded").when(k % 7 == 0, "invalidated").otherwise("active").alias("disposition"), k.alias("k"))
    rows = rows.withColumn("reason", F.when((F.col("disposition") != "active") & (F.col("k") % 17 > 0), "replaced")).drop("k")
    return lineage.lifecycle_audit(rows, rows.filter("superseded_by IS NULL").select("id"))


def replay_census(spark, d):
    rows = src.table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.sha2("c_name", 256).alias("sha256"))
    change = lambda n: rows.withColumn("sha256", F.when(F.col("id") % n == 0, "x").otherwise(F.col("sha256")))
    approved, selection = rows.filter("id % 19 > 0"), rows.filter("id % 23 > 0")
    replay = change(29).filter("id % 31 > 0").unionByName(rows.filter("id % 37 = 0"))
    return lineage.replay_census(approved, selection, replay, change(41)).groupBy("issue").agg(F.count("*").alias("n"), F.min("id").alias("first_id"))


def _cases(spark, d) -> DataFrame:
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    told = lambda value, state=None: F.struct(value.cast("string").alias("value"), (state if state is not None else F.lit("known")).alias("state"))
    day = F.to_date("o_orderdate")
    state = F.when(k % 9 == 0, "not_provided").when(k % 9 == 1, "verified_stale").when(k % 9 == 2, "unknown").otherwise("known")
    return src.table(spark, d, "orders").select(
        k.alias("case_id"), F.when(k % 10 != 7, told(day, state)).alias("receipt_date"), told(F.date_add(day, (c % 60).cast("int"))).alias("extension_notice_date"),
        told(F.when(c % 4 == 0, "large_quantity").when(c % 4 == 1, "consultation_required").when(c % 4 == 2, "staff_leave")).alias("extension_ground"), told(c % 30, F.when(c % 5 > 0, "known").otherwise("unknown")).alias("extension_period_working_days"),
        told(F.lit("1998-03-02")).alias("current_date"), told(F.when(F.col("o_orderstatus") == "F", "true").when(F.col("o_orderstatus") == "O", "false")).alias("response_sent"), told(F.when(c % 3 == 0, "true").when(c % 3 == 1, "false")).alias("urgency_reasons_provided"),
    )


def statutory_decisions(spark, d):
    rows = decisions.statutory_decisions(_cases(spark, d), _calendar(spark))
    return rows.select("case_id", F.replace("decision", F.lit(decisions.PREFIX + "decision."), F.lit("")).alias("decision"), "value", "value_state", F.array_join("warnings", ";").alias("warnings"), F.array_join("trace.sources", ";").alias("sources"), F.col("discretion").isNotNull().alias("discretion"))


def _raters(spark, d):
    rows = src.table(spark, d, "labels").select(F.col("doc_id").cast("string").alias("unit_id"), "doc_id", "quality", "toxic")
    make = lambda label, k: rows.select("unit_id", F.when(F.col("doc_id") % k > 0, label.cast("string")).alias("label"), F.array(F.struct(F.lit(0).alias("start"), (F.col("doc_id") % k).cast("int").alias("end"))).alias("spans"))
    return make(F.col("quality"), 6), make(1 - F.col("toxic"), 9)


def _rounded(df):
    return df.select("measure", "numerator", "denominator", *(F.round(c, 9).alias(c) for c in ("estimate", "low", "high")), "valid", "undefined")


def agreement_intervals(spark, d):
    return _rounded(agreement.reliability(*_raters(spark, d), 20260721, 200))


def agreement_by_cluster(spark, d):
    """Whole sources of documents are drawn, by the rule of the older reports."""
    clusters = src.table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("unit_id"), F.concat_ws("/", "source", "lang").alias("cluster_id"))
    return _rounded(agreement.reliability(*_raters(spark, d), 7, 300, cluster=clusters, rule="legacy"))


def generator_sample(spark, d):
    units = src.table(spark, d, "documents").select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("unit_sha256"))
    return drawing.generator_sample(units, ["unit_sha256", "doc_id"], 100, 20260721).select("doc_id", F.round("probability", 9).alias("probability"), F.round("weight", 6).alias("weight"))


def cluster_sample(spark, d):
    return drawing.sample_entities(src.table(spark, d, "orders").select("o_orderkey", F.col("o_custkey").cast("string").alias("cluster")), "o_orderkey", "cluster", 50, 11).select("o_orderkey", "cluster", "entities", F.round("weight", 6).alias("weight"))


def output_gate(spark, d):
    rows = src.core_events(spark, d).withColumn("human_review_required", F.when(F.col("seq") % 4 == 0, True).when(F.col("seq") % 4 == 2, False))
    return gates.output_findings(rows).select("event_id", "code", "passed_on")


QUERIES = {f.__name__: f for f in (
    schema_errors, lineage_edges, lineage_reach, pin_chains, lifecycle_audit, replay_census, statutory_decisions, agreement_intervals, agreement_by_cluster, generator_sample, cluster_sample, output_gate,
)}

_LINES = """docs AS (SELECT *, o_orderkey AS k FROM orders WHERE o_orderkey % 101 <> 0),
    lines AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_quantity, l_returnflag, l_tax, CAST(l_shipdate AS DATE)) - 1 AS i FROM lineitem WHERE l_orderkey % 101 <> 0)"""
_NEXT = "SELECT o_orderkey, o_custkey, o_orderdate, lead(o_orderkey) OVER w AS next, min(o_orderkey) OVER (PARTITION BY o_custkey) AS least, first_value(o_orderkey) OVER w AS first FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)"
_KIND = "CASE WHEN p_partkey % 40 < 3 THEN 'raw' WHEN p_partkey % 40 = 3 THEN 'schema' WHEN p_partkey % 40 = 4 THEN 'unknown' ELSE 'derived' END"

SQL = {
    "schema_errors": f"""WITH {_LINES}
        SELECT o_orderkey AS line, '<root>' AS path, 'json' AS keyword, 'text is not JSON' AS message FROM orders WHERE o_orderkey % 101 = 0
        UNION ALL SELECT k, '<root>', 'required', '''priority'' is a required property' FROM docs WHERE k % 11 = 0 OR o_orderpriority IS NULL
        UNION ALL SELECT k, '<root>', 'additionalProperties', 'Additional properties are not allowed (''note'' was unexpected)' FROM docs WHERE k % 13 = 0
        UNION ALL SELECT k, 'status', 'enum', '''' || o_orderstatus || ''' is not one of [''F'', ''O'']' FROM docs WHERE o_orderstatus NOT IN ('F', 'O')
        UNION ALL SELECT k, 'priority', 'maxLength', '''' || o_orderpriority || ''' is too long' FROM docs WHERE k % 11 <> 0 AND length(o_orderpriority) > 8
        UNION ALL SELECT k, 'priority', 'pattern', '''' || o_orderpriority || ''' does not match ''^[1-5]-''' FROM docs WHERE k % 11 <> 0 AND NOT regexp_matches(o_orderpriority, '^[1-5]-')
        UNION ALL SELECT l_orderkey, 'lines', 'minItems', '[' || max('{{"flag":"' || l_returnflag || '","quantity":' || CAST(l_quantity AS BIGINT) || ',"shipped":"' || CAST(CAST(l_shipdate AS DATE) AS VARCHAR) || '","tax":' || CASE WHEN l_tax = 0 THEN '0' ELSE CAST(l_tax AS VARCHAR) END || '}}') || '] is too short' FROM lines GROUP BY 1 HAVING count(*) < 2
        UNION ALL SELECT l_orderkey, 'lines.' || i || '.quantity', 'maximum', CAST(l_quantity AS BIGINT) || ' is greater than the maximum of 45' FROM lines WHERE l_quantity > 45
        UNION ALL SELECT l_orderkey, 'lines.' || i || '.flag', 'enum', '''' || l_returnflag || ''' is not one of [''A'', ''N'']' FROM lines WHERE l_returnflag NOT IN ('A', 'N')
        UNION ALL SELECT l_orderkey, 'lines.' || i || '.tax', 'exclusiveMaximum', CAST(l_tax AS VARCHAR) || ' is greater than or equal to the maximum of 0.08' FROM lines WHERE l_tax >= 0.08""",
    "lineage_edges": f"""WITH a AS (SELECT CAST(p_partkey - p_partkey % 40 AS VARCHAR) AS run_id, {_KIND} AS kind, 'artifact:' || left(sha256('a/' || p_partkey || chr(0) || sha256(coalesce(p_name, ''))), 24) AS node FROM part)
        SELECT s.run_id, 'edge:' || left(sha256(s.node || '>' || t.node), 24) AS edge_id, CASE s.kind WHEN 'raw' THEN 'derived_from' ELSE 'validated_by' END AS relation FROM a s JOIN a t USING (run_id) WHERE s.kind IN ('raw', 'schema') AND t.kind = 'derived'""",
    "lineage_reach": f"""WITH RECURSIVE n AS ({_NEXT}), size AS (SELECT o_custkey, count(*) AS m FROM orders GROUP BY 1),
        e AS (SELECT o_orderkey AS s, CASE WHEN o_custkey % 50 = 0 AND next IS NULL THEN least ELSE next END AS t, m FROM n JOIN size USING (o_custkey)),
        r(s, t, steps, m) AS (SELECT s, t, CAST(1 AS BIGINT), m FROM e WHERE t IS NOT NULL UNION ALL SELECT r.s, e.t, r.steps + 1, r.m FROM r JOIN e ON e.s = r.t WHERE e.t IS NOT NULL AND r.steps < r.m)
        SELECT steps, count(*) AS pairs, count(*) FILTER (WHERE s = t) AS circular FROM (SELECT s, t, min(steps) AS steps FROM r GROUP BY 1, 2) GROUP BY 1""",
    "pin_chains": f"""WITH n AS ({_NEXT}), p AS (SELECT *, next IS NOT NULL AND (o_orderkey % 101 = 0 OR o_orderkey % 97 = 0) AS bad, row_number() OVER w AS i,
            coalesce(sum(CAST(next IS NOT NULL AND o_orderkey % 101 = 0 AS INT)) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS segment FROM n WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)),
        f AS (SELECT *, min(CASE WHEN bad THEN i END) OVER (PARTITION BY o_custkey, segment ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS nearest FROM p)
        SELECT o_orderkey AS id, CAST(bad AS BIGINT) AS broken, CASE WHEN NOT bad THEN '' WHEN o_orderkey % 101 = 0 THEN 'missing' ELSE 'digest_mismatch' END AS codes, nearest - i AS distance FROM f""",
    "lifecycle_audit": f"""WITH n AS ({_NEXT}), t AS (SELECT *, CASE WHEN o_custkey % 40 = 0 AND next IS NULL AND first <> o_orderkey THEN first WHEN o_orderkey % 103 = 0 THEN -o_orderkey - 1 ELSE next END AS target FROM n),
        d AS (SELECT *, CASE WHEN target IS NOT NULL THEN 'superseded' WHEN o_orderkey % 7 = 0 THEN 'invalidated' ELSE 'active' END AS kind FROM t),
        around AS (SELECT o_custkey FROM d GROUP BY 1 HAVING count(*) = count(target) AND min(target) > 0)
        SELECT o_orderkey AS id, kind || '_incomplete' AS code FROM d WHERE kind <> 'active' AND o_orderkey % 17 = 0
        UNION ALL SELECT o_orderkey, 'target_missing' FROM d WHERE target < 0 UNION ALL SELECT o_orderkey, 'current_not_active' FROM d WHERE target IS NULL AND kind <> 'active'
        UNION ALL SELECT o_orderkey, 'supersession_circle' FROM d WHERE o_custkey IN (SELECT o_custkey FROM around)""",
    "replay_census": """WITH i AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 19 = 0 THEN 'not_approved' WHEN c_custkey % 23 = 0 THEN 'missing_in_selection' WHEN c_custkey % 31 = 0 AND c_custkey % 37 <> 0 THEN 'missing_in_replay'
            WHEN c_custkey % 31 > 0 AND c_custkey % 37 = 0 THEN 'repeated_in_replay' WHEN c_custkey % 29 = 0 AND c_custkey % 31 > 0 THEN 'digest_differs_in_replay' WHEN c_custkey % 41 = 0 THEN 'digest_differs_in_completion' END AS issue FROM customer)
        SELECT issue, count(*) AS n, min(id) AS first_id FROM i WHERE issue IS NOT NULL GROUP BY 1""",
    "statutory_decisions": f"""WITH profiles AS (SELECT *, CAST(o_orderdate AS DATE) AS first_sent FROM orders), {_DUE.strip()},
        c AS (SELECT *, CASE WHEN o_orderkey % 10 = 7 OR o_orderkey % 9 = 0 THEN 'not_provided' WHEN o_orderkey % 9 = 1 THEN 'verified_stale' WHEN o_orderkey % 9 = 2 THEN 'unknown' ELSE 'known' END AS s, first_sent + CAST(o_custkey % 60 AS INT) > decision_due AS late FROM due),
        x AS (SELECT *, s = 'known' AND o_custkey % 4 < 3 AND o_custkey % 5 > 0 AS ext, s = 'known' AND o_orderstatus IN ('F', 'O') AS ref FROM c)
        SELECT o_orderkey AS case_id, 'response_deadline' AS decision, CASE WHEN s = 'known' THEN CAST(decision_due AS VARCHAR) END AS value, CASE WHEN s = 'known' THEN 'known' ELSE 'unknown' END AS value_state,
            CASE s WHEN 'not_provided' THEN 'receipt date is required to calculate the response deadline' WHEN 'verified_stale' THEN 'receipt date was verified but may be stale' ELSE '' END AS warnings,
            CASE s WHEN 'not_provided' THEN 'OIA 1982 s 15' WHEN 'unknown' THEN NULL ELSE 'OIA 1982 s 2;OIA 1982 s 15' END AS sources, false AS discretion FROM x
        UNION ALL SELECT o_orderkey, 'transfer_deadline', CASE WHEN s = 'known' THEN CAST(transfer_due AS VARCHAR) END, CASE WHEN s = 'known' THEN 'known' ELSE 'unknown' END, '', CASE WHEN s = 'known' THEN 'OIA 1982 s 2;OIA 1982 s 14' END, false FROM x
        UNION ALL SELECT o_orderkey, 'extension_validity', CASE WHEN ext THEN CASE WHEN NOT late AND o_custkey % 4 < 2 THEN 'true' ELSE 'false' END END, CASE WHEN ext THEN 'known' ELSE 'unknown' END,
            CASE WHEN NOT ext THEN '' WHEN late THEN 'extension notice after original deadline' WHEN o_custkey % 4 = 2 THEN 'extension ground is not one of the verified statutory ground labels' ELSE 'extension period reasonableness requires human review' END,
            CASE WHEN NOT ext THEN NULL WHEN NOT late AND o_custkey % 4 = 2 THEN 'OIA 1982 s 15A' ELSE 'OIA 1982 s 15;OIA 1982 s 15A' END, ext AND NOT late AND o_custkey % 4 < 2 FROM x
        UNION ALL SELECT o_orderkey, 'deemed_refusal', CASE WHEN ref THEN CASE WHEN o_orderstatus = 'O' AND DATE '1998-03-02' > decision_due THEN 'true' ELSE 'false' END END, CASE WHEN ref THEN 'known' ELSE 'unknown' END, '', CASE WHEN ref THEN 'OIA 1982 s 15;OIA 1982 s 28' END, false FROM x
        UNION ALL SELECT o_orderkey, 'urgency_flag', CASE o_custkey % 3 WHEN 0 THEN 'human_decision_required' WHEN 1 THEN 'not_requested' END, CASE WHEN o_custkey % 3 < 2 THEN 'known' ELSE 'unknown' END,
            CASE WHEN o_custkey % 3 = 0 THEN 'urgency affects routing only and cannot be machine certified' ELSE '' END, CASE WHEN o_custkey % 3 < 2 THEN 'OIA 1982 s 12(3)' END, o_custkey % 3 = 0 FROM x""",
    "cluster_sample": """WITH c AS (SELECT DISTINCT CAST(o_custkey AS VARCHAR) AS cluster FROM orders), n AS (SELECT count(*) AS entities FROM c),
        s AS (SELECT cluster FROM c ORDER BY sha256('{"seed":11,"unit":"' || cluster || '"}'), cluster LIMIT 50)
        SELECT o_orderkey, cluster, entities, round(1 / least(1.0, 50.0 / entities), 6) AS weight FROM orders JOIN s ON cluster = CAST(o_custkey AS VARCHAR), n""",
    "output_gate": f"""WITH {src.EVENTS_SQL.strip()}, f AS (
        SELECT event_id, 'model_output_review_required' AS code FROM core_events WHERE machine_generated AND seq % 4 <> 0
        UNION ALL SELECT event_id, 'certified_model_output_rejected' FROM core_events WHERE machine_generated AND assertion_status = 'certified'
        UNION ALL SELECT event_id, 'human_certification_boundary_required' FROM core_events WHERE event_type IN ('ExtensionNotified', 'ReleaseMade', 'RefusalCommunicated') AND NOT requires_human_certification
        UNION ALL SELECT event_id, 'provider_human_certification_rejected' FROM core_events WHERE human_certified) SELECT event_id, code, false AS passed_on FROM f""",
}


def _marked(unit: dict) -> dict:
    """An extractor to try the hook with: it labels by the first letter `e`, gives its place, and breaks the contract here and there."""
    at, key = unit["text"].find("e"), int(unit["unit_id"])
    if key % 50 == 7:
        return {"label": "unheard", "spans": [], "provenance": {}}
    if key % 50 == 8:
        return {"label": "1", "spans": [{"start": 0, "end": len(unit["text"]) + 1}], "provenance": {}}
    if key % 50 == 9:
        raise KeyError(key)
    if at < 0 or key % 6 == 0:
        return {"label": None, "spans": [], "provenance": {}}
    return {"label": str(at % 2), "spans": [{"start": at, "end": at + 1}], "provenance": {"rule": "first_e" if key % 4 else "", "unit": key}}


def _extracted(spark, d):
    extractors.register_extractor(spark, "casework_first_e", _marked, ["0", "1"])
    units = src.table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("unit_id"), "text")
    return extractors.extract(units, "casework_first_e")


def extractor_problems(spark, d):
    return _extracted(spark, d).groupBy("problem", F.col("label").isNotNull().alias("labelled")).agg(F.count("*").alias("n"))


def extractor_report(spark, d):
    docs = src.table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("unit_id"), F.coalesce("text", F.lit("")).alias("text"))
    at = F.instr("text", "e").cast("int")
    gold = docs.select("unit_id", F.when(at > 0, (F.length("text") % 2).cast("string")).alias("label"), F.when(at > 0, F.array(F.struct((at - 1).alias("start"), (at + F.when(F.length("text") % 3 == 0, 0).otherwise(F.least(F.lit(1), F.length("text") - at))).alias("end")))).alias("spans"))
    found = extractors.extractor_report(gold, _extracted(spark, d), ["rule", "unit"], 0.5)
    return found.select(*(F.round(c, 9).alias(c) if t == "double" else c for c, t in found.dtypes))


def capture_text(spark, d):
    pages = src.table(spark, d, "pages")
    found = captures.capture_text(pages, "page_id", "html", "div", "ad")
    return found.select("page_id", "text", "text_sha256", F.size("spans").alias("parts"))


def span_problems(spark, d):
    """Spans of captures, sealed, against captures of which some have changed since."""
    pages = src.table(spark, d, "pages").select("page_id", "html")
    found = captures.capture_text(pages, "page_id", "html", "div", "ad")
    sealed = captures.seal_spans(found, pages, "page_id", "html")
    k = F.col("page_id")
    later = pages.filter(k % 11 > 0).withColumn("html", F.when(k % 7 == 0, F.replace("html", F.lit('class="ad">'), F.lit('class="ad"> '))).when(k % 13 == 0, F.lit("")).otherwise(F.col("html")))
    return captures.span_problems(sealed, found.withColumn("text", F.when(k % 17 == 0, F.translate("text", "aeiou", "uoiea")).otherwise(F.col("text"))), later, "page_id", "html")


QUERIES |= {f.__name__: f for f in (extractor_problems, extractor_report, capture_text, span_problems)}

_EXTRACTED = """d AS (SELECT doc_id AS k, coalesce(text, '') AS t FROM documents), m AS (SELECT *, strpos(t, 'e') AS a, length(t) AS n FROM d),
    p AS (SELECT *, CASE k % 50 WHEN 7 THEN 'label_not_registered' WHEN 8 THEN 'span_outside_text' WHEN 9 THEN 'raised: KeyError' END AS problem, a > 0 AND k % 6 <> 0 AND k % 50 NOT IN (7, 8, 9) AS given,
        CASE WHEN n % 3 = 0 THEN 0 ELSE least(1, n - a) END AS more FROM m)"""
_AD = "regexp_extract_all(html, '(?s)<div class=\"ad\">(.*?)</div>', 1)"

SQL |= {
    "extractor_problems": f"WITH {_EXTRACTED} SELECT problem, given AS labelled, count(*) AS n FROM p GROUP BY ALL",
    "extractor_report": f"""WITH {_EXTRACTED}, r AS (SELECT *, given AND (a - 1) % 2 = n % 2 AS hit, CASE WHEN given THEN more = 0 ELSE a = 0 END AS same FROM p),
        c AS (SELECT count(*) AS units, count(problem) AS broken, count(*) FILTER (WHERE hit) AS tp, count(*) FILTER (WHERE given AND NOT hit) AS fp, count(*) FILTER (WHERE a > 0 AND NOT hit) AS fn, count(*) FILTER (WHERE given) AS covered,
            count(*) FILTER (WHERE same) AS all_exact_spans, count(*) FILTER (WHERE hit AND same) AS exact_spans, count(*) FILTER (WHERE hit) AS overlapping, count(*) FILTER (WHERE given AND k % 4 <> 0) AS complete FROM r)
        SELECT *, round(tp / (tp + fp), 9) AS precision, round(tp / (tp + fn), 9) AS recall, round(2 * tp / (2 * tp + fp + fn), 9) AS f1, round(covered / units, 9) AS coverage, round(all_exact_spans / units, 9) AS all_exact_span_rate,
            round(exact_spans / tp, 9) AS exact_span_rate, round(overlapping / tp, 9) AS overlap_rate, round(complete / covered, 9) AS provenance_rate FROM c""",
    "capture_text": f"""WITH t AS (SELECT page_id, {_AD} AS parts FROM pages), j AS (SELECT page_id, trim(regexp_replace(replace(array_to_string(parts, ' '), '&amp;', '&'), '\\s+', ' ', 'g')) AS text, len(parts) AS n FROM t)
        SELECT page_id, text, sha256(text) AS text_sha256, CAST(n AS INT) AS parts FROM j""",
    "span_problems": f"""SELECT page_id, 0 AS position, CASE WHEN page_id % 11 = 0 THEN 'capture_missing' WHEN page_id % 7 <> 0 AND page_id % 13 = 0 THEN 'out_of_bounds' WHEN page_id % 17 = 0 THEN 'text_differs' ELSE 'source_differs' END AS issue
        FROM pages WHERE len({_AD}) > 0 AND (page_id % 11 = 0 OR page_id % 7 = 0 OR page_id % 13 = 0 OR page_id % 17 = 0)""",
}
