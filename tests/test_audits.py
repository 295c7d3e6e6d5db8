"""Document rules, provenance, decisions, agreement and draws against Python."""

from __future__ import annotations

import collections
import datetime as dt
import math
import random

import pytest
from pyspark.sql import functions as F

from casework.operators import agreement, clock, decisions, documents, drawing, gates, lineage, measures
from casework.plans import audits

from .oracle import compare, connect


@pytest.fixture(scope="module")
def con(data):
    return connect(data)


@pytest.mark.parametrize("name", sorted(audits.SQL))
def test_equals_sql(spark, data, con, name):
    compare(audits.QUERIES[name](spark, data), audits.SQL[name], con)


# Document rules --------------------------------------------------------------------------------------
SCHEMA = {
    "type": "object", "required": ["id", "tags"], "additionalProperties": False,
    "properties": {
        "id": {"type": "string", "minLength": 2, "pattern": "^[a-z]+$"}, "n": {"type": "integer", "minimum": 1, "maximum": 5}, "tags": {"type": "array", "minItems": 1, "uniqueItems": True, "items": {"$ref": "#/$defs/tag"}},
        "when": {"type": ["string", "null"], "format": "date"}, "state": {"enum": ["open", "closed", 3]}, "deep": {"type": "object", "properties": {"list": {"type": "array", "items": {"type": "array", "items": {"type": "number", "exclusiveMinimum": 0}}}}},
        "both": {"allOf": [{"multipleOf": 2}, {"multipleOf": 0.5, "maximum": 10}]}, "fixed": {"const": True},
    },
    "$defs": {"tag": {"type": "object", "required": ["k"], "properties": {"k": {"type": "string"}}}},
}


def test_schema_errors(spark):
    texts = {
        1: '{"id":"ab","tags":[{"k":"x"}],"n":2.0,"when":null,"state":3.0,"both":4,"fixed":true}',
        2: '{"id":"A","tags":[],"n":7,"state":"o\'pen","extra":1,"more":2}',
        3: '{"tags":[{"k":1},{"z":2},{"z":2}],"n":"5","when":"2021-13-01","both":11,"fixed":1}',
        4: "nope", 5: "[1,2]", 6: '{"id":"abc","tags":[{"k":"a"}],"deep":{"list":[[1,0],[-2.5],3]},"when":"2023-02-30"}', 7: None, 8: "null", 9: "",
    }
    rows = spark.createDataFrame([(k, v, "x") for k, v in texts.items()], "line long, text string, value string")
    got = sorted(tuple(r) for r in documents.schema_errors(rows, SCHEMA).collect())
    assert got == sorted(
        [
            (2, "<root>", "additionalProperties", "Additional properties are not allowed ('extra', 'more' were unexpected)"), (2, "id", "minLength", "'A' is too short"), (2, "id", "pattern", "'A' does not match '^[a-z]+$'"),
            (2, "n", "maximum", "7 is greater than the maximum of 5"), (2, "state", "enum", "\"o'pen\" is not one of ['open', 'closed', 3]"), (2, "tags", "minItems", "[] should be non-empty"),
            (3, "<root>", "required", "'id' is a required property"), (3, "n", "type", "'5' is not of type 'integer'"), (3, "tags", "uniqueItems", '[{"k":1},{"z":2},{"z":2}] has non-unique elements'), (3, "tags.0.k", "type", "1 is not of type 'string'"),
            (3, "tags.1", "required", "'k' is a required property"), (3, "tags.2", "required", "'k' is a required property"), (3, "when", "format", "'2021-13-01' is not a 'date'"), (3, "both", "multipleOf", "11 is not a multiple of 2"),
            (3, "both", "maximum", "11 is greater than the maximum of 10"), (3, "fixed", "const", "True was expected"), (4, "<root>", "json", "text is not JSON"), (5, "<root>", "type", "[1,2] is not of type 'object'"),
            (6, "deep.list.0.1", "exclusiveMinimum", "0 is less than or equal to the minimum of 0"), (6, "deep.list.1.0", "exclusiveMinimum", "-2.5 is less than or equal to the minimum of 0"), (6, "deep.list.2", "type", "3 is not of type 'array'"),
            (6, "when", "format", "'2023-02-30' is not a 'date'"), (8, "<root>", "type", "None is not of type 'object'"), (9, "<root>", "json", "text is not JSON"),
        ]
    )
    assert documents.schema_errors(rows.limit(0), SCHEMA).count() == 0


def test_schemas_that_cannot_be_checked_are_refused():
    for bad, why in (({"oneOf": []}, "oneOf"), ({"$ref": "#"}, "itself"), ({"additionalProperties": {}}, "true or false")):
        with pytest.raises(ValueError, match=why):
            documents.compile_schema(bad)
    assert documents.compile_schema({"title": "x", "items": True}) == []


# Provenance ------------------------------------------------------------------------------------------
def pairs(spark, *xs):
    return spark.createDataFrame(xs, "source string, target string")


def test_reachable_equals_breadth_first(spark):
    rnd = random.Random(6)
    edges = {(str(rnd.randrange(25)), str(rnd.randrange(25))) for _ in range(40)} | {("x", "y"), ("y", "x"), ("z", "z")}
    after = collections.defaultdict(set)
    for a, b in edges:
        after[a].add(b)
    want = set()
    for a in list(after):
        seen, front, n = {}, {a}, 0
        while front:
            n += 1
            front = {c for b in front for c in after[b]} - set(seen)
            seen.update(dict.fromkeys(front, n))
        want |= {(a, b, n) for b, n in seen.items()}
    got = lineage.reachable(spark.createDataFrame([*edges, *edges, (None, "x"), ("x", None)], "source string, target string"))
    assert {tuple(r) for r in got.collect()} == want and got.count() == len(want)


def test_a_chain_of_a_thousand(spark):
    chain = spark.range(1000).select(F.col("id").cast("string").alias("source"), (F.col("id") + 1).cast("string").alias("target"))
    reach = lineage.reachable(chain)
    assert reach.count() == 500_500 and reach.agg(F.max("steps")).first()[0] == 1000
    links = chain.withColumnsRenamed({"source": "old", "target": "new"})
    assert lineage.acyclic(links) and not lineage.acyclic(links.unionByName(spark.createDataFrame([("1000", "500")], "old string, new string")))
    ends = lineage.follow(chain.withColumnsRenamed({"source": "node", "target": "next"}))
    assert ends.filter("last = '1000' AND hops = 1000 - CAST(node AS INT)").count() == 1000
    around = chain.withColumnsRenamed({"source": "node", "target": "next"}).unionByName(spark.createDataFrame([("1000", "990"), ("a", "b")], "node string, next string"))
    got = {r.node: r["last"] for r in lineage.follow(around).collect()}
    assert got.pop("a") == "b" and len(got) == 1001 and set(got.values()) == {None}


def test_the_nearest_broken_pin_behind_forks_and_circles(spark):
    rng = random.Random(3)
    steps = {(a, rng.randrange(60)) for a in range(60) for _ in range(rng.choice([0, 1, 1, 1, 2]))} | {(100 + i, 100 + (i + 1) % 7) for i in range(7)} | {(200, 103), (300, 300)}
    broken = {rng.randrange(60) for _ in range(3)} | {999}
    steps = {(a, b) for a, b in steps if a not in broken}
    want, near, n = {}, set(broken), 0
    while near:
        n, near = n + 1, {a for a, b in steps if b in near and a not in want}
        want |= dict.fromkeys(near, n)
    got = lineage.nearest_broken(spark.createDataFrame(sorted(steps), "id long, target long"), spark.createDataFrame([(b,) for b in broken], "id long"))
    assert sorted(map(tuple, got.collect())) == sorted(want.items())


def test_lifecycles_are_never_broadcast(spark):
    lives = spark.range(100).select("id", F.lit("superseded").alias("disposition"), (F.col("id") + 1).alias("superseded_by"), F.lit("r").alias("reason"))
    for found in (lineage.lifecycle_audit(lives, lives.select("id")), lineage.follow(lives.select(F.col("id").alias("node"), F.col("superseded_by").alias("next")))):
        assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()


def test_pins_and_lifecycles(spark):
    artifacts = spark.createDataFrame([(c, c * 2) for c in "abcdef"], "id string, sha256 string")
    pins = spark.createDataFrame([("a", "b", "bb"), ("b", "c", "xx"), ("d", "a", "aa"), ("d", "z", "zz"), ("e", "f", "ff"), ("c", "a", "aa")], "id string, pinned_id string, pinned_sha256 string")
    got = {r.id: (r.broken, r.codes, r.distance) for r in lineage.pin_chains(artifacts, pins).collect()}
    assert got == {"a": (0, [], 1), "b": (1, ["digest_mismatch"], 0), "c": (0, [], 2), "d": (1, ["missing"], 0), "e": (0, [], None), "f": (0, [], None)}
    rows = [("a", "active", None, None), ("b", "superseded", "a", "r"), ("c", "superseded", "q", "r"), ("d", "active", "a", None), ("e", "invalidated", None, None), ("f", "gone", None, None), ("g", "superseded", "h", "r"), ("h", "superseded", "g", "r"), ("i", "superseded", "i", " "), ("k", "active", None, None), ("k", "active", None, None)]
    lives = spark.createDataFrame(rows, "id string, disposition string, superseded_by string, reason string")
    current = spark.createDataFrame([("a",), ("b",), ("nowhere",)], "id string")
    got = sorted((r.id, r.code) for r in lineage.lifecycle_audit(lives, current).collect())
    assert got == sorted([("c", "target_missing"), ("d", "active_with_retirement"), ("e", "invalidated_incomplete"), ("f", "unknown_disposition"), ("g", "supersession_circle"), ("h", "supersession_circle"), ("i", "supersession_circle"), ("i", "superseded_incomplete"), ("k", "duplicate_id"), ("b", "current_not_active"), ("nowhere", "current_not_active")])


def test_edges_are_all_pairs_of_a_run(spark):
    rows = [("r", k, f"{k}{i}") for k in ("raw", "schema", "derived", "report", "unknown") for i in range(2)] + [("s", "raw", "raw0"), ("s", "derived", "x")]
    edges = lineage.artifact_edges(spark.createDataFrame(rows, "run_id string, kind string, node_id string")).collect()
    assert collections.Counter((e.run_id, e.relation) for e in edges) == {("r", "derived_from"): 8, ("r", "validated_by"): 8, ("s", "derived_from"): 1}


# Decisions -------------------------------------------------------------------------------------------
def test_statutory_decisions(spark):
    cal = clock.calendar(spark, "2026-01-01", "2026-12-31", spark.createDataFrame([(dt.date(2026, 2, 6),), (dt.date(2026, 4, 3),)], "day date"))
    value = "struct<value: string, state: string>"
    cases = {
        "plain": {"receipt_date": ("2026-02-02", "known"), "current_date": ("2026-03-03", "known"), "response_sent": ("false", "known"), "urgency_reasons_provided": ("true", "known")},
        "in_time": {"receipt_date": ("2026-02-02", "known"), "current_date": ("2026-03-02", "known"), "response_sent": ("false", "known"), "urgency_reasons_provided": ("false", "known")},
        "late": {"receipt_date": ("2026-02-02", "known"), "extension_notice_date": ("2026-03-04", "known"), "extension_ground": ("large_quantity", "known"), "extension_period_working_days": ("5", "known")},
        "ground": {"receipt_date": ("2026-02-02", "known"), "extension_notice_date": ("2026-03-03", "known"), "extension_ground": ("", "known"), "extension_period_working_days": ("5", "known")},
        "other": {"receipt_date": ("2026-02-02", "known"), "extension_notice_date": ("2026-03-03", "known"), "extension_ground": ("leave", "known"), "extension_period_working_days": ("5", "known")},
        "valid": {"receipt_date": ("2026-02-02", "known"), "extension_notice_date": ("2026-03-03", "known"), "extension_ground": ("consultation_required", "known"), "extension_period_working_days": ("5", "known")},
        "stale": {"receipt_date": ("2026-02-02", "verified_stale"), "current_date": ("2026-03-03", "known"), "response_sent": ("true", "known")},
        "sent": {"receipt_date": ("2026-02-02", "known"), "current_date": ("2027-03-03", "known"), "response_sent": ("true", "known")},
        "odd": {"receipt_date": ("soon", "known"), "current_date": ("2026-03-03", "known"), "response_sent": ("false", "known")},
        "nothing": {},
    }
    rows = spark.createDataFrame([(k, *(v.get(i) for i in decisions.INPUTS)) for k, v in cases.items()], "case_id string, " + ", ".join(f"{i} {value}" for i in decisions.INPUTS))
    got = {(r.case_id, r.decision.rpartition(".")[2]): r for r in decisions.statutory_decisions(rows, cal).collect()}
    assert len(got) == 50
    said = lambda c, d: (got[c, d].value, got[c, d].value_state)
    none = (None, "unknown")
    assert said("plain", "response_deadline") == ("2026-03-03", "known") and said("plain", "transfer_deadline") == ("2026-02-17", "known")
    assert said("plain", "deemed_refusal") == ("false", "known") and said("in_time", "deemed_refusal") == ("false", "known") and said("sent", "deemed_refusal") == ("false", "known")
    assert said("plain", "urgency_flag") == ("human_decision_required", "known") and got["plain", "urgency_flag"].discretion == "nz-oia/discretion.urgency_assessment"
    assert said("in_time", "urgency_flag") == ("not_requested", "known") and got["in_time", "urgency_flag"].discretion is None
    assert said("late", "extension_validity") == ("false", "known") and got["late", "extension_validity"].warnings == [decisions.LATE_NOTICE]
    assert said("ground", "extension_validity") == none and got["other", "extension_validity"].warnings == [decisions.BAD_GROUND]
    valid = got["valid", "extension_validity"]
    assert (valid.value, valid.discretion, valid.trace.inputs_used[2]) == ("true", "nz-oia/discretion.extension_reasonableness", "nz-oia/variable.extension_ground")
    assert got["stale", "response_deadline"].warnings == [decisions.STALE_RECEIPT] and got["stale", "response_deadline"].trace.sources == ["OIA 1982 s 2", "OIA 1982 s 15"]
    assert said("stale", "deemed_refusal") == none and got["stale", "deemed_refusal"].trace is None
    assert got["nothing", "response_deadline"].warnings == [decisions.NO_RECEIPT] and said("nothing", "urgency_flag") == none
    assert said("odd", "response_deadline") == none and said("odd", "deemed_refusal") == none
    later = rows.filter("case_id = 'plain'").withColumn("current_date", F.struct(F.lit("2026-03-04").alias("value"), F.lit("known").alias("state")))
    assert {r.value for r in decisions.statutory_decisions(later, cal).filter("decision LIKE '%deemed%'").collect()} == {"true"}
    fewer = decisions.statutory_decisions(rows.select("case_id", "receipt_date"), cal)
    assert fewer.count() == 50 and fewer.filter("value IS NOT NULL").count() == 14


def test_rules_in_a_circle_are_refused():
    facts = [decisions.Fact("a", ("b",), lambda b: b), decisions.Fact("b", ("a",), lambda a: a)]
    with pytest.raises(ValueError, match="circle"):
        decisions.order(facts, [], set())
    with pytest.raises(ValueError, match="nothing gives c"):
        decisions.order([decisions.Fact("a", ("c",), lambda c: c)], [], set())


def test_output_gate(spark):
    rows = [("a", "ReleaseMade", "certified", True, None, None, True), ("b", "ReleaseMade", "inferred", True, True, True, None), ("c", None, None, None, None, None, None), ("d", "MessageObserved", "certified", False, False, False, False)]
    table = spark.createDataFrame(rows, "event_id string, event_type string, assertion_status string, machine_generated boolean, human_review_required boolean, requires_human_certification boolean, human_certified boolean")
    assert sorted((r.event_id, r.code) for r in gates.output_findings(table).collect()) == sorted(("a", c) for c in (gates.REVIEW, gates.CERTIFIED, gates.BOUNDARY, gates.POSITIVE))
    assert {r.event_id for r in gates.passed(table).collect()} == {"b", "c", "d"}


# Draws and agreement ---------------------------------------------------------------------------------
def test_rows_are_numbered(spark):
    rnd = random.Random(9)
    values = [(rnd.random(), i) for i in range(5000)]
    got = drawing.numbered(spark.createDataFrame(values, "a double, b long").repartition(7), ["a", "b"])
    assert [(r.a, r.b) for r in sorted(got.collect(), key=lambda r: r.number)] == sorted(values)
    assert sorted(r.number for r in got.select("number").collect()) == list(range(5000))


@pytest.mark.parametrize("size", [1, 2, 37, 64, 1000])
def test_draws_equal_the_generator(spark, size):
    rng, want = random.Random(42), collections.Counter()
    for r in range(5):
        want.update((r, rng.randrange(size)) for _ in range(size))
    got = collections.Counter()
    for r in drawing.bootstrap_draws(spark, 42, size, 5).collect():
        got[r.replicate, r.number] += r.times
    assert got == want


def test_draws_across_blocks(monkeypatch):
    monkeypatch.setattr(drawing, "BLOCK", 64)
    rng, stream = random.Random(3), drawing.Stream(3)
    for n, count in ((1000, 500), (7, 3), (1 << 31, 90), (5, 640)):
        assert [x for block in stream.below(n, count) for x in block.tolist()] == [rng.randrange(n) for _ in range(count)]


@pytest.mark.parametrize("size", [0, 5, 150, 400])
def test_sample_equals_the_generator(spark, size):
    units = spark.range(400).select(F.sha2(F.col("id").cast("string"), 256).alias("h"), "id")
    ordered = sorted((r.h, r.id) for r in units.collect())
    want = {ordered[i] for i in random.Random(5).sample(range(400), size)}
    got = drawing.generator_sample(units, ["h"], size, 5).collect()
    assert {(r.h, r.id) for r in got} == want and len(got) == size and all(math.isclose(r.probability, size / 400) for r in got)
    with pytest.raises(ValueError):
        drawing.generator_sample(units, ["h"], 401, 5)


def brute_reliability(units, seed, replicates, rule):
    """``units``: entity, label, other label, whether spans agree."""
    entities = sorted({u[0] for u in units})
    members = {e: [u for u in units if u[0] == e] for e in entities}

    def scores(some):
        n = len(some)
        a, b = collections.Counter(u[1] for u in some), collections.Counter(u[2] for u in some)
        chance = sum(a[x] / n * b[x] / n for x in a)
        raw = sum(u[1] == u[2] for u in some) / n
        always = chance == 1 if rule == "legacy" else math.isclose(chance, 1.0)
        judged = [u for u in some if u[1] is not None and u[1] == u[2]]
        return {
            "raw_label": raw, "cohen_kappa": None if always else (raw - chance) / (1 - chance), "all_unit_exact_span": sum(u[3] for u in some) / n, "exact_span": sum(u[3] for u in judged) / len(judged) if judged else None,
            "abstention": sum((u[1] is None) == (u[2] is None) for u in some) / n,
        }

    rng = random.Random(seed)
    draws = [scores([u for _ in entities for u in members[entities[rng.randrange(len(entities))]]]) for _ in range(replicates)]
    out = {}
    for m, estimate in scores(units).items():
        values = sorted(d[m] for d in draws if d[m] is not None)
        n, tail = len(values), (1 - 0.95) / 2
        low, high = (int(0.025 * n), int(0.975 * n)) if rule == "legacy" else (math.floor(tail * n), math.ceil((1 - tail) * n) - 1)
        out[m] = (estimate, values[low] if n else None, values[high] if n else None, n)
    return out


@pytest.mark.parametrize("rule, clustered", [("registered", False), ("registered", True), ("legacy", False), ("legacy", True)])
def test_reliability_equals_python(spark, rule, clustered):
    rnd = random.Random(8)
    rows = [(f"u{i:02}", rnd.choice(["yes", "no", None]), rnd.choice(["yes", "no", None]), rnd.choice([[], [1]]), rnd.choice([[], [1]])) for i in range(30)]
    table = spark.createDataFrame(rows, "unit_id string, a string, b string, s array<int>, t array<int>")
    left, right = table.select("unit_id", F.col("a").alias("label"), F.col("s").alias("spans")), table.select("unit_id", F.col("b").alias("label"), F.col("t").alias("spans"))
    cluster = table.select("unit_id", F.concat(F.lit("c"), F.substring("unit_id", 3, 1)).alias("cluster_id")) if clustered else None
    got = {r.measure: (r.estimate, r.low, r.high, r.valid) for r in agreement.reliability(left, right, 99, 41, cluster=cluster, rule=rule).collect()}
    want = brute_reliability([(f"c{u[2]}" if clustered else u, a, b, s == t) for u, a, b, s, t in rows], 99, 41, rule)
    assert set(got) == set(want) == set(agreement.MEASURES)
    for m in want:
        assert got[m] == pytest.approx(want[m], abs=1e-9), m


def test_reliability_without_a_choice(spark):
    one = spark.createDataFrame([("u", "yes", [1]), ("v", "yes", [1])], "unit_id string, label string, spans array<int>")
    got = {r.measure: (r.estimate, r.low, r.valid, r.undefined) for r in agreement.reliability(one, one, 1, 10).collect()}
    assert got["cohen_kappa"] == (None, None, 0, 10) and got["raw_label"] == (1.0, 1.0, 10, 0)
    assert agreement.reliability(one.limit(0), one, 1, 10).count() == 0
    with pytest.raises(ValueError):
        agreement.reliability(one, one, 1, 0)
    stored = agreement.reliability(one, one, 1, 10).select("measure", "estimate")
    assert agreement.departures(stored, stored).count() == 0
    assert {(r.measure, r.found_in) for r in agreement.departures(stored.withColumn("estimate", F.when(F.col("measure") == "raw_label", 0.5).otherwise(F.col("estimate"))), stored).collect()} == {("raw_label", "stored"), ("raw_label", "recomputed")}


def test_lineage_of_annotations(spark):
    make = lambda *xs: spark.createDataFrame(xs, "unit_id string, unit_sha256 string")
    found = agreement.lineage_problems(make(("a", "1"), ("b", "2"), ("b", "2"), ("x", "9")), make(("a", "1"), ("b", "2"), ("c", "0")), make(("a", "1"), ("b", "2"), ("c", "3"), ("d", "4")))
    assert {(r.unit_id, r.issue) for r in found.collect()} == {("b", "repeated_left"), ("x", "not_a_member"), ("c", "missing_left"), ("d", "missing_left")}


def test_bootstrap_draws_in_tasks_as_the_driver_did(spark):
    rows = [(i, i % 2, i % 3 % 2, i % 7) for i in range(60)]
    got = {r.replicate: r.agreement for r in measures.bootstrap_agreement(spark.createDataFrame(rows, "u long, a long, b long, g long"), "u", "a", "b", 6, 4, clusters="g").collect()}
    rng = random.Random(4)
    for r in range(6):
        drawn = [x for _ in range(7) for g in [rng.randrange(7)] for x in rows if x[3] == g]
        assert math.isclose(got[r], sum(x[1] == x[2] for x in drawn) / len(drawn))


def test_draws_are_summed_range_by_range(spark, monkeypatch):
    monkeypatch.setattr(drawing, "RANGE_DRAWS", 1)
    rows = [(f"{i:04}", "x" if i % 3 else None, "x" if i % 5 else "y", i % 7 == 0, 1 + i % 2) for i in range(1000)]
    cells = [(r[0], *r[1:4]) for r in rows for _ in range(r[4])]
    got = agreement.replicates_of(spark.createDataFrame(cells, "entity string, a string, b string, same_spans boolean"), 5, 4)
    rng, want = random.Random(5), {}
    for replicate in range(4):
        drawn = [rows[rng.randrange(1000)] for _ in rows]
        want[replicate] = sum(r[4] for r in drawn if r[1] == r[2]), sum(r[4] for r in drawn)
    assert {r.replicate: (r.numerator, r.denominator) for r in got.filter("measure = 'raw_label'").collect()} == want


def test_schema_errors_make_their_texts_once(spark):
    texts = spark.range(4).groupBy("id").agg(F.to_json(F.struct(F.count("*").alias("n"))).alias("text"))
    found = documents.schema_errors(texts, {"properties": {"n": {"maximum": 0}}}, "id")
    assert "Aggregate" not in found._jdf.queryExecution().executedPlan().toString()


def test_draws_are_never_broadcast(spark):
    rows = spark.range(100).select("id", (F.col("id") % 2).alias("a"), (F.col("id") % 3).alias("b"))
    assert "Broadcast" not in measures.bootstrap_agreement(rows, "id", "a", "b", 5, 1)._jdf.queryExecution().executedPlan().toString()


def test_clusters_are_drawn_whole(spark):
    units = spark.createDataFrame([(i, f"c{i % 5}") for i in range(20)], "u long, c string")
    drawn = drawing.sample_entities(units, "u", "c", 2, 3)
    assert drawn.count() == 8 and drawn.select("c").distinct().count() == 2 and {r.entities for r in drawn.collect()} == {5}
    assert drawing.sample_entities(units, "u", None, 6, 3).count() == 6
