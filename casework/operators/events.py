"""Event streams: summaries, quality gates, transitions, timelines, process mining."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import dims
from ..functions.scores import summary_band


def summarise_events(events: DataFrame) -> DataFrame:
    """Counts in long form: ``dimension, key, n`` by type, assertion status, confidence band and quality flag, and two conditional counts. One pass: every event gives its keys."""
    item = lambda d, k: F.struct(F.lit(d).alias("dimension"), k.cast("string").alias("key"))
    fixed = [
        item("event_type", F.col("event_type")),
        item("assertion_status", F.col("assertion_status")),
        item("confidence_band", summary_band(F.col("confidence"))),
        F.when(F.col("requires_human_certification"), item("condition", F.lit("requires_human_certification"))),
        F.when(F.col("machine_generated"), item("condition", F.lit("machine_generated"))),
    ]
    flags = F.transform("quality_flags", lambda f: item("quality_flag", f))
    keys = F.concat(F.array_compact(F.array(*fixed)), flags)
    return events.select(F.explode(keys).alias("i")).groupBy("i.dimension", "i.key").agg(F.count("*").alias("n"))


def _finding(condition: Column, severity: str, code: str) -> Column:
    return F.when(condition, F.struct(F.lit(severity).alias("severity"), F.lit(code).alias("code")))


def quality_findings(events: DataFrame) -> DataFrame:
    """One row per rule that an event breaks. A machine-generated certified event is a warning here."""
    dispositive = F.col("event_type").isin(dims.CERTIFICATION_TYPES)
    certified = F.coalesce(F.col("assertion_status") == "certified", F.lit(False))
    human, machine = F.col("human_certified"), F.coalesce("machine_generated", F.lit(False))
    source = F.col("legal_source_status")
    rules = [
        _finding(F.coalesce("evidence_count", F.lit(0)) == 0, "error", "missing_evidence"),
        _finding(machine & F.col("generator").isNull(), "warning", "missing_generator"),
        _finding(dispositive & ~F.coalesce("requires_human_certification", F.lit(False)), "error", "certification_boundary_bypassed"),
        _finding(dispositive & human.isNull(), "error", "missing_human_certification_metadata"),
        _finding(dispositive & human.isNotNull() & certified & ~F.coalesce(human, F.lit(False)), "error", "false_certified_assertion"),
        _finding(dispositive & F.coalesce(human, F.lit(False)) & ~certified, "warning", "certification_status_mismatch"),
        _finding(source.isNull(), "warning", "unversioned_legal_reference"),
        _finding(source.isin(dims.STALE_SOURCES), "warning", "stale_or_unverified_legal_reference"),
        _finding(certified & machine, "warning", "machine_generated_certified_event"),
    ]
    return events.select("event_id", "request_id", F.explode(F.array_compact(F.array(*rules))).alias("f")).select("event_id", "request_id", "f.*")


def replay_guardrails(events: DataFrame) -> DataFrame:
    """The stricter replay: whatever a machine certifies is an error."""
    dispositive = F.col("event_type").isin(dims.CERTIFICATION_TYPES)
    certified = F.coalesce(F.col("assertion_status") == "certified", F.lit(False))
    rules = [
        _finding(certified & F.coalesce("machine_generated", F.lit(False)), "error", "machine_generated_certified_event"),
        _finding(dispositive & ~F.coalesce("requires_human_certification", F.lit(False)), "error", "certification_boundary_bypassed"),
        _finding(dispositive & certified & ~F.coalesce("human_certified", F.lit(False)), "error", "certified_without_human"),
    ]
    return events.select("event_id", F.explode(F.array_compact(F.array(*rules))).alias("f")).select("event_id", "f.*")


def quality_summary(findings: DataFrame) -> DataFrame:
    return findings.agg(
        F.count("*").alias("finding_count"), F.count_if(F.col("severity") == "error").alias("error_count"), F.count_if(F.col("severity") == "warning").alias("warning_count"), (F.count_if(F.col("severity") == "error") == 0).alias("ok")
    )


def can_transition(source: Column, target: Column) -> Column:
    """Same state: yes; from a terminal one: no; else by adjacency."""
    allowed = F.create_map(*(x for a, bs in dims.TRANSITIONS.items() for x in (F.lit(a), F.array(*map(F.lit, bs)))))
    return F.when(source == target, True).when(source.isin(dims.TERMINAL_STATES), False).otherwise(F.coalesce(F.array_contains(allowed[source], target), F.lit(False)))


def state_changes(events: DataFrame) -> DataFrame:
    """Changes of state per request in order of the time's text, then ``seq``. Null states are passed over, so they do not reset the state before."""
    order = Window.partitionBy("request_id").orderBy(F.col("event_time").cast("string"), "seq")
    stated = events.filter(F.col("lifecycle_state_after").isNotNull())
    moves = stated.withColumn("from_state", F.lag("lifecycle_state_after").over(order)).withColumn("previous_event_id", F.lag("event_id").over(order))
    changed = moves.filter(F.col("from_state") != F.col("lifecycle_state_after"))
    return changed.select("request_id", "previous_event_id", "event_id", "from_state", F.col("lifecycle_state_after").alias("to_state"), can_transition(F.col("from_state"), F.col("lifecycle_state_after")).alias("allowed"))


def audit_transitions(events: DataFrame) -> DataFrame:
    """Changes that the process profile does not have."""
    return state_changes(events).filter("NOT allowed").drop("allowed")


def audit_summary(events: DataFrame) -> DataFrame:
    """Requests (those without any state too), transitions and findings."""
    requests = events.agg(F.countDistinct("request_id").alias("request_count"))
    moves = state_changes(events).agg(F.count("*").alias("transition_count"), F.count_if(~F.col("allowed")).alias("finding_count"))
    return requests.crossJoin(moves).withColumn("ok", F.col("finding_count") == 0)  # one row each


def timeline(events: DataFrame) -> DataFrame:
    """Position of each event in its request, by parsed time, unparsed times last, then ``seq``; with a warning code where the time is missing or invalid."""
    raw = F.col("event_time").cast("string")
    parsed = F.try_to_timestamp(raw)
    rows = events.withColumn("parsed", parsed).withColumn("warning", F.when(F.coalesce(raw, F.lit("")) == "", "missing_event_time").when(parsed.isNull(), "invalid_event_time"))
    order = Window.partitionBy("request_id").orderBy(F.col("parsed").isNull(), "parsed", "seq")
    return rows.select("request_id", "event_id", "event_type", F.row_number().over(order).alias("position"), "warning")


def validity_intervals(versions: DataFrame, key: str, as_at: str) -> DataFrame:
    """Each version's half-open interval of validity, open at the last one."""
    return versions.withColumn("valid_to", F.lead(as_at).over(Window.partitionBy(key).orderBy(as_at))).withColumnRenamed(as_at, "valid_from")


def directly_follows(events: DataFrame) -> DataFrame:
    """How often one activity comes right after another in a case."""
    order = Window.partitionBy("request_id").orderBy(F.col("event_time").cast("string"), "event_id")
    pairs = events.withColumn("next_type", F.lead("event_type").over(order)).filter("next_type IS NOT NULL")
    return pairs.groupBy("event_type", "next_type").agg(F.count("*").alias("n"))


def case_traces(events: DataFrame) -> DataFrame:
    """Each case's activities in order. A case is one request, whose events are few."""
    listed = F.array_sort(F.collect_list(F.struct(F.col("event_time").cast("string").alias("t"), "event_id", "event_type")))
    return events.groupBy("request_id").agg(F.transform(listed, lambda e: e["event_type"]).alias("activities"), F.count("*").alias("events"))


def conformance(events: DataFrame, expected: list[str], before: tuple[str, str]) -> DataFrame:
    """Per case: does it follow the expected path, and does the first activity of ``before`` come first?"""
    traces = case_traces(events)
    a, b = (F.array_position("activities", F.lit(x)) for x in before)
    return traces.select("request_id", "events", (F.col("activities") == F.array(*map(F.lit, expected))).alias("on_path"), ((a > 0) & (b > 0) & (a < b)).alias("ordered"))


def case_objects(events: DataFrame, *attributes: str) -> DataFrame:
    """One object per case with the attribute values of its first event, null ones too."""
    first = F.struct(F.col("event_time").cast("string"), "event_id")
    return events.groupBy("request_id").agg(*(F.min_by(F.struct(a), first)[a].alias(a) for a in attributes), F.count("*").alias("events"))


def xes_lines(events: DataFrame) -> DataFrame:
    """One XES trace per case as text; see ``operators.sinks`` for the file."""
    esc = lambda c: F.replace(F.replace(F.replace(F.coalesce(c.cast("string"), F.lit("")), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    event = F.concat(
        F.lit('    <event><string key="concept:name" value="'), esc(F.col("event_type")), F.lit('"/><string key="event_id" value="'), esc(F.col("event_id")),
        F.lit('"/><date key="time:timestamp" value="'), esc(F.date_format("event_time", "yyyy-MM-dd'T'HH:mm:ss")), F.lit('"/></event>'),
    )
    listed = F.array_sort(F.collect_list(F.struct(F.col("event_time").cast("string").alias("t"), "event_id", event.alias("line"))))
    body = F.array_join(F.transform(listed, lambda e: e["line"]), "\n")
    grouped = events.groupBy("request_id").agg(body.alias("body"))
    return grouped.select("request_id", F.concat(F.lit('  <trace>\n    <string key="concept:name" value="'), esc(F.col("request_id")), F.lit('"/>\n'), F.col("body"), F.lit("\n  </trace>")).alias("trace"))
