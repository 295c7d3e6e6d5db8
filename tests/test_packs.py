"""Tasks, roles, packs, traces and overlays at their edges."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import functions as F

from casework.operators import governed, tasks

from .test_semantics import rows


def test_the_last_assessment_decides(spark):
    chunks = spark.createDataFrame([("a", "r1", "text"), ("b", None, "t"), ("c", "r1", ""), ("d", "r2", None), ("e", "r3", "x"), ("f", "r3", "y")], "chunk_id string, request_id string, text string")
    risks = spark.createDataFrame([("a", "high", ["consultation"], 1), ("a", "low", [], 2), ("e", "odd", ["x", "b"], 1), ("f", "high", ["ai_workload", "health_information"], 1), ("zz", "high", [], 1)], "source_id string, risk_level string, categories array<string>, at int")
    got = rows(tasks.risk_triage_tasks(chunks, risks, "at"), "source_id", "priority", "prefilled_label")
    assert got == [("a", "low", "no_review_trigger"), ("b", "medium", None), ("e", "medium", "b"), ("f", "high", "health")]
    assert tasks.risk_triage_tasks(chunks.limit(0), risks, "at").count() == 0


def test_requests_without_events_or_titles(spark):
    profiles = spark.createDataFrame([("1", None, "", None, "Received", 0.2), ("2", "T", "A", "s", "Closed", None)], "request_id string, title string, authority string, source_state string, normalised_state string, mapping_confidence double")
    events = spark.createDataFrame([("e2", "1", "X", "inferred", 0.5, ["i"]), ("e1", "1", "Y", None, None, None), ("e3", None, "Z", None, None, None)], "event_id string, request_id string, event_type string, assertion_status string, confidence double, evidence_ids array<string>")
    got = {r.request_id: r for r in tasks.state_mapping_tasks(profiles, events).collect()}
    assert [h.event_id for h in got["1"].event_hints] == ["e1", "e2"] and got["2"].event_hints == [] and (got["1"].priority, got["2"].priority) == ("high", "medium")
    assert got["1"].text == "Untitled request\nAuthority: Unknown authority\nSource state: unknown\nNormalised state: Received"
    assert got["2"].task_id == "gold:" + hashlib.sha256("\0".join(["state_mapping", "2", got["2"].text]).encode()).hexdigest()[:24]


def test_roles_look_for_their_own(spark):
    units = spark.createDataFrame([(1, "See the gipa act, or FOI."), (2, "information access"), (3, None), (4, "GIPA only: Government Information (Public Access)"), (5, "😀 FOI")], "unit_id int, text string")
    got = {(r.unit_id, r.role[-1]): (r.label, tuple(r.span) if r.span else None, r.abstention_reason) for r in tasks.role_annotations(units).collect()}
    assert got[1, "a"] == ("observed", (8, 12), None) and got[1, "b"] == ("observed", (8, 16), None)
    assert got[2, "a"] == got[2, "b"] == ("candidate", (0, 18), None) and got[3, "a"] == ("unknown", None, "insufficient_evidence")
    assert got[4, "a"] == ("observed", (0, 4), None) and got[4, "b"][0] == "unknown" and got[5, "b"] == ("candidate", (2, 5), None)


def test_packs_count_by_reason(spark):
    profiles = spark.createDataFrame([("1", "p"), ("2", None)], "request_id string, profile string")
    stream = spark.createDataFrame([("1", "b"), ("1", "a"), ("3", "c"), (None, "d")], "request_id string, record_sha256 string")
    hits = spark.createDataFrame([("1", "h1", None, None), ("1", "h2", "2", "q"), ("1", "h3", "1", "q"), ("2", "h4", "2", "q"), ("9", "h5", "9", None)], "for_request string, hit_id string, request_id string, profile string")
    got = {r.request_id: r for r in tasks.agent_packs(profiles, {"events": stream}, hits).collect()}
    assert (got["1"].events, got["1"].events_sha256, got["1"].hits, got["1"].request_mismatch, got["1"].profile_mismatch, got["1"].both_mismatch) == (2, hashlib.sha256(b"a\nb\n").hexdigest(), 1, 1, 2, 1)
    assert (got["2"].events, got["2"].events_sha256, got["2"].hits) == (0, None, 1)


def test_overlays_stand_before_the_core(spark):
    core = spark.createDataFrame([("core", "version", "1"), ("terminology", "a", "x"), ("labels", "b", "y")], "section string, key string, value string")
    pin = hashlib.sha256("".join(h + "\n" for h in sorted(hashlib.sha256("\x1f".join(r).encode()).hexdigest() for r in core.collect())).encode()).hexdigest()
    over = spark.createDataFrame([("o", "1", pin, "terminology", "a", "z"), ("o", "1", pin, "terminology", "new", None), ("p", "2", pin, "terminology", "a", "z"), ("q", "1", None, "labels", "b", "z")], "overlay_id string, core_version string, core_sha256 string, section string, key string, value string")
    resolved, problems = tasks.resolve_overlays(core, over)
    assert rows(problems) == [("p", "core_version_mismatch"), ("q", "core_digest_mismatch"), ("q", "section_not_overridable")]
    got = {(r.overlay_id, r.section, r.key): (r.value, r.overridden) for r in resolved.collect()}
    assert got == {("o", "core", "version"): ("1", False), ("o", "labels", "b"): ("y", False), ("o", "terminology", "a"): ("z", True), ("o", "terminology", "new"): (None, True)}


def test_trace_ids_follow_from_content(spark):
    rows_ = spark.createDataFrame([("run", "b", "2"), ("run", "a", "1")], "run_id string, path string, sha256 string")
    got = {r.sequence if r.parent_span_id else "root": r for r in tasks.trace_spans(rows_).collect()}
    sha = lambda s, n: hashlib.sha256(s.encode()).hexdigest()[:n]
    trace = sha("run|a|b", 32)
    assert {r.trace_id for r in got.values()} == {trace} and got["root"].span_id == sha(f"{trace}:root", 16) and got["root"].sequence == 2
    assert got[0].span_id == sha(f"{trace}:0:a:1", 16) and got[1].parent_span_id == got["root"].span_id and got[1].link == "sha256:2"


def test_embeddings_say_where_they_come_from(spark):
    r = tasks.embedding_records(spark.createDataFrame([("c", "some words")], "chunk_id string, text string"), 16, reachable=False).withColumn("n", F.size("embedding")).first()
    assert r.n == 16 and r.provenance.asDict() == {"provider": "local", "model": "feature-hash", "dimensions": 16, "available": False, "deterministic": True}
    assert r.text_sha256 == hashlib.sha256(b"some words").hexdigest() and len(r.vector_sha256) == 64


def test_seals_leave_out_their_own_field(spark):
    texts = {1: '{"b": [1, {"z": 2, "a": "é\\"x"}], "a": null, "pin": "old"}', 2: "{}", 3: "[1]", 4: "nope", 5: None, 6: '{"pin": 1}', 7: '{"a\\"b": "{", "A": true}'}
    docs = spark.createDataFrame(list(texts.items()), "id int, text string")
    got = {r.id: r.digest for r in governed.canonical_digest(docs, "id", "text", "pin").collect()}
    for i, t in texts.items():
        whole = json.loads(t) if t and i != 4 else None
        want = None
        if isinstance(whole, dict):
            whole.pop("pin", None)
            want = hashlib.sha256(json.dumps(whole, sort_keys=True, separators=(",", ":"), ensure_ascii=False).encode()).hexdigest()
        assert got[i] == want, i
    sealed = governed.seal_documents(docs.filter("id IN (2, 7)"), "id", "text", "seal")
    assert governed.seal_problems(sealed, "id", "sealed", "seal").count() == 0
    assert rows(governed.seal_problems(docs.filter("id IN (1, 2, 3, 5)"), "id", "text", "pin")) == [(1, "pin_mismatch"), (2, "pin_missing"), (3, "not_an_object"), (5, "not_an_object")]


def test_frames_and_accounts(spark):
    candidates = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", None), ("d", "4")], "slug string, raw_sha256 string")
    replay = spark.createDataFrame([("a", "1", "text"), ("b", "3", "t"), ("c", None, " ")], "slug string, raw_sha256 string, text string")
    assert rows(governed.candidate_frame(candidates, replay), "slug", "access") == [("a", "accessible"), ("b", "digest_mismatch"), ("c", "no_text"), ("d", "not_replayed")]
    side = lambda *xs: spark.createDataFrame([(u, label, None, []) for u, label in xs], "unit_id string, label string, abstention_reason string, spans array<int>")
    decided = spark.createDataFrame([("a",), ("z",), ("a",)], "unit_id string")
    r = governed.queue_accounting(side(("a", "x"), ("b", "x"), ("c", "x")), side(("a", "y"), ("b", "y"), ("c", "x")), decided).first()
    assert tuple(r) == (2, 1, 1, 1, 1, False)
    assert governed.queue_accounting(side(("a", "x")), side(("a", "x")), decided.limit(0)).first().ok


def test_seals_move_no_row(spark):
    docs = spark.createDataFrame([(1, '\n{"b":null,"a":{"d":1,"c":[2]},"pin":"x"}'), (2, "{}"), (3, '"{}"'), (4, None)], "id int, text string")
    want = [(1, hashlib.sha256(b'{"a":{"c":[2],"d":1},"b":null}').hexdigest()), (2, hashlib.sha256(b"{}").hexdigest()), (3, None), (4, None)]
    got = governed.canonical_digest(docs, "id", "text", "pin")
    assert sorted(tuple(r) for r in got.collect()) == want
    for plan in (got, governed.seal_documents(docs, "id", "text", "pin"), governed.seal_problems(docs, "id", "text", "pin")):
        assert "Exchange" not in plan._jdf.queryExecution().executedPlan().toString()
