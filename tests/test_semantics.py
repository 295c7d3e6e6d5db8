"""Edge cases of the operators, against values worked out by hand or a second implementation in Python."""

from __future__ import annotations

import datetime as dt
import hashlib
import json
import math
import uuid

import pytest
from pyspark.sql import functions as F

from casework import dims, schemas
from casework.functions import ids, scores, text
from casework.operators import clock, events, governance, ledger, measures, requests, retrieval, review, sinks, texts
from casework.sources import records


def one(spark, *columns):
    return spark.range(1).select(*(c.alias(f"c{i}") for i, c in enumerate(columns))).first()


def rows(frame, *columns):
    return sorted(tuple(r[c] for c in columns or frame.columns) for r in frame.collect())


def test_confidence_bands_differ_and_nan_is_zero(spark):
    r = one(spark, scores.summary_band(F.lit("NaN")), scores.summary_band(F.lit("x")), scores.summary_band(F.lit("0.8")), scores.kernel_band(F.lit(0.0)), scores.summary_band(F.lit(0.0)))
    assert list(r) == ["zero", "unknown", "high", "none", "zero"]


def test_uuid5_and_fnv_equal_python(spark):
    names = ["", "a", "https://example.org/é", "x" * 300]
    for name in names:
        h = 0xCBF29CE484222325
        for b in name.encode():
            h = (h ^ b) * 0x100000001B3 % (1 << 64)
        r = one(spark, ids.uuid5(F.lit(name)), ids.fnv1a64(F.lit(name)).cast("string"))
        assert list(r) == [str(uuid.uuid5(uuid.NAMESPACE_URL, name)), str(h)]


def test_masks(spark):
    r = one(spark, *(text.mask(F.lit(x)) for x in ("", "a", "ab", "abc", "jo@ex.org", "@ex.org")))
    assert list(r) == ["", "*", "**", "a***c", "j***@e***", "***@e***"]


def test_email_predicate(spark):
    r = one(spark, *(text.looks_like_email(F.lit(x)) for x in ("a@b.c", "a@b", "a@@b.c", "@b.c", "a b@c.d", "a+b%c@d-e.f")))
    assert list(r) == [True, False, False, False, False, True]


def test_tokens_are_unicode(spark):
    assert one(spark, text.tokens(F.lit("Māori Straße, x_1")))[0] == ["māori", "straße", "x_1"]


def test_state_mapping_and_profiles(spark):
    raw = spark.createDataFrame([("1", "", "Waiting-Response "), ("2", "no such", None), (None, "gone postal", "x")], "request_id string, state string, source_state string").withColumn("id", F.lit("9"))
    got = rows(requests.build_profiles(raw), "request_id", "normalised_state", "raw_state_field", "title")
    assert got == [("1", "Received", "source_state", "Untitled request"), ("2", "Unknown", "state", "Untitled request"), ("9", "Searching", "state", "Untitled request")]
    with pytest.raises(Exception, match="no request_id"):
        requests.build_profiles(spark.createDataFrame([(None, "x")], "request_id string, state string")).collect()


def test_attachment_fallbacks(spark):
    p = spark.createDataFrame([("r", "p" * 64, [{"id": "a", "content_sha256": "b" * 64}, {"url": "u", "content_sha256": "short"}])], "request_id string, content_sha256 string, attachments array<map<string,string>>")
    assert rows(requests.attachment_events(p), "attachment_id", "content_sha256") == [("1", "p" * 64), ("a", "b" * 64)]


def test_transitions_pass_over_nulls_and_keep_terminal_states(spark):
    e = spark.createDataFrame([("r", "2", 1, "Received"), ("r", "10", 2, None), ("r", "3", 3, "Searching"), ("r", "4", 4, "Closed"), ("q", "1", 1, None)], "request_id string, event_time string, seq long, lifecycle_state_after string").withColumn("event_id", F.col("seq").cast("string"))
    assert rows(events.state_changes(e), "from_state", "to_state", "allowed") == [("Received", "Searching", False), ("Searching", "Closed", False)]
    s = events.audit_summary(e).first()
    assert (s.request_count, s.transition_count, s.finding_count, s.ok) == (2, 2, 2, False)


def test_timeline_puts_bad_times_last(spark):
    e = spark.createDataFrame([("r", "b", "bad", 0), ("r", "a", "2024-01-02 00:00:00", 1), ("r", "n", None, 2), ("r", "c", "2024-01-01 00:00:00", 3)], "request_id string, event_id string, event_time string, seq long").withColumn("event_type", F.lit("x"))
    assert rows(events.timeline(e), "position", "event_id", "warning") == [(1, "c", None), (2, "a", None), (3, "b", "invalid_event_time"), (4, "n", "missing_event_time")]


def test_working_days_against_a_day_loop(spark):
    holiday = dt.date(2024, 2, 6)
    cal = clock.calendar(spark, "2023-11-01", "2024-12-31", spark.createDataFrame([(holiday,)], "day date"))
    starts = [dt.date(2023, 12, 1) + dt.timedelta(i) for i in range(90)]

    def loop(day, n):
        while n:
            day += dt.timedelta(1)
            n -= day.weekday() < 5 and day != holiday and not ((day.month == 12 and day.day >= 25) or (day.month == 1 and day.day <= 15))
        return day

    frame = clock.add_working_days(spark.createDataFrame([(s,) for s in starts], "start date"), "start", 20, cal, "due")
    assert {r.start: r.due for r in frame.collect()} == {s: loop(s, 20) for s in starts}
    saturday = spark.createDataFrame([(dt.date(2024, 3, 2),)], "start date")
    assert clock.add_working_days(saturday, "start", 0, cal, "due").first().due == dt.date(2024, 3, 2)


def test_clock_without_date(spark):
    cal = clock.calendar(spark, "2024-01-01", "2024-12-31")
    r = clock.indicative_clock(spark.createDataFrame([(None,)], "first_sent date"), cal).first()
    assert (r.decision_due, r.confidence, r.warnings) == (None, 0.0, ["missing_received_date", "holidays_not_supplied"])


def test_strict_key_rounds_half_to_even(spark):
    e = spark.createDataFrame([("r", "t", None, None, 0.125)], "request_id string, event_type string, lifecycle_state_after string, assertion_status string, confidence double")
    assert e.select(measures.match_key("strict").alias("k")).first().k.endswith("0.12")


def test_kappa_nulls_and_undefined(spark):
    same = spark.createDataFrame([("a", "a")] * 3, "x string, y string")
    assert measures.kappa(same, "x", "y").first().kappa is None
    mixed = spark.createDataFrame([("a", "a"), (None, None), ("a", None), ("b", "b")], "x string, y string")
    r = measures.kappa(mixed, "x", "y").first()
    expected = (2 * 1 + 1 * 2 + 1 * 1) / 16
    assert math.isclose(r.kappa, (0.75 - expected) / (1 - expected))


def test_percentile_rules_differ(spark):
    v = spark.createDataFrame([(float(i),) for i in range(10)], "v double")
    r = measures.order_statistics(v, "v").first()
    assert (r.low, r.high) == (0.0, 9.0) and measures.quantile(v, "v", 0.25).first().quantile == 2.25


def test_bootstrap_is_repeatable(spark):
    v = spark.createDataFrame([(i, i % 3, i % 2) for i in range(20)], "u int, a int, b int")
    a, b = (rows(measures.bootstrap_agreement(v, "u", "a", "b", 10, 5)) for _ in range(2))
    assert a == b and len(a) == 10


def test_span_overlap_of_empty_spans(spark):
    span = lambda *xs: F.array(*(F.struct(F.lit(a).alias("start"), F.lit(b).alias("end")) for a, b in xs))
    r = one(spark, scores.span_iou(span((3, 3)), span((2, 2))), scores.span_iou(span((0, 4)), span((2, 6))), scores.spans_valid(span((0, 2), (1, 3)), F.lit(9)), scores.spans_valid(span((0, 2), (2, 3)), F.lit(9)))
    assert list(r) == [1.0, 2 / 6, False, True]


def test_wrong_label_counts_twice(spark):
    r = measures.extractor_scores(spark.createDataFrame([("a", "b"), ("a", "a"), ("a", None), (None, None)], "gold string, predicted string")).first()
    assert (r.tp, r.fp, r.fn, r.coverage) == (1, 1, 2, 0.5)


def test_thresholds_fail_on_missing_metrics(spark):
    m, l = spark.createDataFrame([("a", 1.0)], "metric string, value double"), spark.createDataFrame([("a", ">=", 1.0), ("b", "<", 1.0)], "metric string, op string, limit double")
    assert rows(measures.thresholds(m, l), "metric", "passed") == [("a", True), ("b", False)]


def test_ledger_equals_a_fold_and_tampering_shows(spark):
    e = spark.createDataFrame([("s", i, hashlib.sha256(str(i).encode()).hexdigest()) for i in range(5)], "stream string, seq int, h string")
    built = ledger.build_ledger(e, "stream", "seq", "h")
    previous = "0" * 64
    for r in sorted(built.collect(), key=lambda r: r.sequence):
        assert r.previous_sha256 == previous
        previous = hashlib.sha256(f"{previous}\n{r.record_sha256}".encode()).hexdigest()
        assert r.ledger_sha256 == previous
    assert ledger.verify_ledger(built, built, "stream").count() == 0
    tampered = built.filter("sequence < 4").withColumn("record_sha256", F.when(F.col("sequence") == 2, "x").otherwise(F.col("record_sha256")))
    assert rows(ledger.verify_ledger(built, tampered, "stream"), "sequence", "mismatch") == [(2, "record_sha256"), (4, "missing_entry")]


def test_last_wins_and_diff(spark):
    d = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("b", 1, None)], "k string, seq int, v string")
    last = review.last_wins(d, "k", "seq").select("k", "v")
    assert rows(last) == [("a", "y"), ("b", None)]
    after = spark.createDataFrame([("a", "y"), ("b", "z"), ("c", "n")], "k string, v string")
    assert rows(review.snapshot_diff(last, after, "k")) == [("a", "unchanged"), ("b", "modified"), ("c", "added")]


def test_stratified_sample_starves_late_strata(spark):
    d = spark.createDataFrame([(str(i), s) for s in "abc" for i in range(10)], "k string, s string")
    assert [r.s for r in review.stratified_sample(d, "k", "s", "x", 3, 5).collect()] == ["a"] * 3 + ["b"] * 2


def test_risk_levels(spark):
    d = spark.createDataFrame([("1", "plain"), ("2", "they refuse"), ("3", "ABC1234"), ("4", "mail a@b.co and c@d.co, born today"), ("5", None)], "i string, t string")
    assert rows(texts.assess_risk(d, "i", "t"), "source_id", "risk_level", "score") == [("1", "low", 0), ("2", "medium", 1), ("3", "high", 3), ("4", "high", 7), ("5", "low", 0)]


def test_spans_have_code_point_offsets_and_no_text(spark):
    d = spark.createDataFrame([("1", "😀 ring a@b.co or 12 Long Road"), ("2", ""), ("3", None)], "i string, t string")
    out = texts.redaction_candidates(d, "i", "t")
    assert [(r.start, r.end, r.span_type) for r in out.orderBy("start").collect()] == [(7, 13, "email_address"), (17, 29, "postal_address_hint")]
    assert "matched" not in out.columns


def test_messages_from_any_field(spark):
    d = spark.createDataFrame([("r", [" one ", ""], [("m1", "two")], "three")], "id string, correspondence array<string>, messages array<struct<id:string,body:string>>, description string")
    assert rows(texts.extract_messages(d, "id"), "message_id", "body") == [("correspondence-0", "one"), ("description", "three"), ("m1", "two")]


def test_message_triggers_never_certify(spark):
    d = spark.createDataFrame([("r", 0, "We decline; see section 18."), ("r", 1, "")], "request_id string, position int, body string")
    assert rows(texts.message_events(d), "event_type", "requires_human_certification") == [("MessageObserved", False), ("RefusalCommunicated", True)]


def test_html_text(spark):
    d = spark.createDataFrame([(1, "<p>a&amp;lt;</p><script>x<y</script><!-- c --><b>b</b>\n c"), (2, None)], "i int, h string")
    assert rows(texts.html_text(d, "i", "h")) == [(1, "a&lt; b c"), (2, "")]


def test_search_keeps_chunks_without_terms_and_checks_arguments(spark):
    d = spark.createDataFrame([("a", "red ball"), ("b", "blue"), ("c", "")], "chunk_id string, text string")
    got = retrieval.search_chunks(d, "red red", 5, lexical_weight=1.0, include_vectors=False).collect()
    assert [(r.rank, r.chunk_id) for r in got] == [(1, "a"), (2, "b")] and got[1].score == 0
    with pytest.raises(ValueError):
        retrieval.search_chunks(d, "x", 0)


def test_hash_vector_equals_python(spark):
    d = hashlib.blake2b(b"word", digest_size=16).digest()
    want = [0.0] * 8
    want[int.from_bytes(d[:8], "big") % 8] = 1.0 if d[8] & 1 else -1.0
    assert spark.range(1).select(retrieval.hash_vectors(8)(F.array(F.lit("word"))).alias("v")).first().v == want


def test_authority_ambiguity_and_registry_rules(spark):
    reg = spark.createDataFrame(
        [("A", "id", "A", "2000-01-01", None), ("B", "id", "B", "2000-01-01", "2005-01-01"), ("A", "name", "office", "2000-01-01", None), ("B", "name", "office", "2000-01-01", "2006-01-01")], "authority_id string, kind string, value string, valid_from string, valid_to string"
    )
    ev = spark.createDataFrame([(1, None, " OFFICE ", [], "2005-06-01"), (2, None, "office", [], "2010-01-01"), (3, "Z", None, [], "2010-01-01")], "record_id int, authority_id string, authority_name string, tags array<string>, as_of string")
    assert rows(governance.classify_authority(ev, reg), "record_id", "status", "candidates") == [(1, "ambiguous", 2), (2, "matched", 1), (3, "unmatched", 0)]
    assert rows(governance.registry_violations(reg), "authority_id", "violation") == [("B", "outside_interval")]


def test_version_order_is_numeric(spark):
    r = one(spark, governance.semver(F.lit("1.10.0")) > governance.semver(F.lit("1.9.9")), governance.semver(F.lit("01.0.0")).isNull())
    assert list(r) == [True, True]


def test_supersession_cycles(spark):
    spark.sparkContext.setCheckpointDir(spark.conf.get("spark.checkpoint.dir"))
    link = lambda *xs: spark.createDataFrame(xs, "old string, new string")
    assert governance.acyclic(link(("a", "b"), ("b", "c"))) and not governance.acyclic(link(("a", "b"), ("b", "a")))


def test_record_files(spark, tmp_path):
    schema = schemas.RAW_RECORD
    (tmp_path / "a.jsonl").write_text('{"id":"1"}\n\n{"id":"2"}\n')
    got = records.read_jsonl(spark, str(tmp_path / "a.jsonl"), schema)
    assert rows(got, "id") == [("1",), ("2",)] and records.input_counts(got).first().records == 2
    (tmp_path / "bad.jsonl").write_text('{"id":"1"}\n[1]\n')
    with pytest.raises(Exception, match="no JSON object"):
        records.read_jsonl(spark, str(tmp_path / "bad.jsonl"), schema).collect()
    for name, body, want in (("b", '[{"id":"1"},2,{"id":"3"}]', ["1", "3"]), ("c", '{"records":[{"id":"1"}]}', ["1"]), ("d", '{"id":"7"}', ["7"]), ("e", '{"id":"7"}\n{"id":"8"}', ["7", "8"])):
        (tmp_path / name).write_text(body)
        assert [x for (x,) in rows(records.read_records(spark, str(tmp_path / name), schema), "id")] == want
    (tmp_path / "cal.json").write_text(json.dumps({"dates": [{"name": "x", "date": "2024-01-01", "observed_date": "2024-01-02"}, {"name": "y", "date": "2024-02-06"}]}))
    assert rows(records.holiday_calendar(spark, str(tmp_path / "cal.json")), "day") == [(dt.date(2024, 1, 2),), (dt.date(2024, 2, 6),)]


def test_contract_check(spark):
    d = spark.createDataFrame([("a", None, "weird"), ("a", "T", "observed")], "event_id string, event_type string, assertion_status string")
    got = dict(rows(schemas.contract_check(d, schemas.EVENT, "event_id", {"assertion_status": schemas.STATUSES})))
    assert got == {"missing_column:request_id": 1, "missing_column:lifecycle_state_after": 1, "null:event_type": 1, "enum:assertion_status": 1, "duplicate:event_id": 1}
    assert "PRIMARY KEY (event_id)" in schemas.ddl(schemas.EVENT, "events", "event_id")


def test_sinks(spark, data, tmp_path):
    from casework.plans.process import profiles
    from casework.sources.tables import core_events

    p, e = profiles(spark, data).limit(20), core_events(spark, data).limit(20)
    sinks.write_tables(p, e, str(tmp_path / "t"))
    assert sinks.register_tables(spark, str(tmp_path / "t")) == {"requests": 20, "events": 20}
    sinks.write_jsonl(e.select("event_id", "request_id"), str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j")).count() == 20
    sinks.write_ntriples(e, str(tmp_path / "n"))
    assert spark.read.text(str(tmp_path / "n")).count() == 80
    sinks.write_xes(e, str(tmp_path / "x"))
    sinks.write_content_store(e.select("event_type"), str(tmp_path / "c"))
    assert spark.read.parquet(str(tmp_path / "c")).count() == e.select("event_type").distinct().count()
    assert "Received --> Withdrawn" in sinks.process_model() and sinks.process_model("pnml").startswith("<pnml>") and "read_parquet" in sinks.bootstrap_sql("p")


def test_dimensions_agree():
    states = set(dims.TERMINAL_STATES) | set(dims.TRANSITIONS) | {b for bs in dims.TRANSITIONS.values() for b in bs}
    assert not set(dims.TERMINAL_STATES) & set(dims.TRANSITIONS) and {s for _, s, _, _ in dims.STATE_MAP} <= states | {"Unknown", "InternalReviewRequested"}


def test_streaming(spark, data, tmp_path):
    from casework.sources.tables import core_events
    from casework.streaming import quality as stream

    e = core_events(spark, data)
    e.coalesce(1).write.parquet(str(tmp_path / "in"))
    read = spark.readStream.schema(e.schema).parquet(str(tmp_path / "in"))
    for name, frame, want in (("findings", stream.stream_findings(read), events.quality_findings(e).count()), ("moves", stream.stream_transitions(read), events.state_changes(e).count())):
        q = frame.writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        q.awaitTermination()
        assert spark.table(name).count() == want
    assert stream.windowed_counts(e).agg(F.sum("n")).first()[0] == e.count()
