"""Statutory decisions as a graph of rules under three-valued logic, compiled to columns.

An input is a struct ``value, state``; where its state is not ``known``, or its value is
missing, its value is null, and nulls go through conditions as unknowns do in three-valued
logic. Facts are derived from inputs and other facts, decisions from both; :func:`compile`
puts them in order, refuses circles, and leaves one expression for each decision, so a case
is one row and the plan one projection. Each decision carries its state, warnings, a trace
of what it rests on, and the point that is left to a person, where there is one.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from graphlib import CycleError, TopologicalSorter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .clock import add_working_days

PREFIX = "nz-oia/"  # fixed value: the namespace of the decisions


@dataclass(frozen=True)
class Fact:
    """A value that decisions share: ``of`` gets the columns of what it needs."""

    name: str
    needs: tuple[str, ...]
    of: Callable[..., Column]


@dataclass(frozen=True)
class Clause:
    """What a decision says where ``when`` is true. A clause looks at values, or at the states of inputs if ``by_state``."""

    when: Callable[..., Column]
    value: Callable[..., Column] | str | None = None
    state: str = "known"
    warnings: tuple[str, ...] = ()
    sources: tuple[str, ...] = ()
    discretion: str | None = None
    by_state: bool = False


@dataclass(frozen=True)
class Decision:
    """The first clause that is true decides; without one, or with an input unknown, the answer is unknown and has no trace."""

    name: str
    inputs: tuple[str, ...]
    clauses: tuple[Clause, ...]
    facts: tuple[str, ...] = ()
    parameter: str | None = None


DECISION = "struct<decision: string, value: string, value_state: string, warnings: array<string>, trace: struct<step_id: string, inputs_used: array<string>, parameter: string, sources: array<string>>, discretion: string>"


def _strings(values) -> Column:
    return F.array(*map(F.lit, values)).cast("array<string>")


def _result(d: Decision, clause: Clause | None, value: Column) -> Column:
    if clause is None:
        trace = F.lit(None)
    else:
        trace = F.struct(F.lit(f"{PREFIX}decision.{d.name}").alias("step_id"), _strings(f"{PREFIX}variable.{i}" for i in d.inputs).alias("inputs_used"), F.lit(d.parameter).alias("parameter"), _strings(clause.sources).alias("sources"))
    parts = (
        F.lit(f"{PREFIX}decision.{d.name}"), value.cast("string"), F.lit(clause.state if clause else "unknown"), _strings(clause.warnings if clause else ()), trace, F.lit(f"{PREFIX}discretion.{clause.discretion}" if clause and clause.discretion else None),
    )
    return F.struct(*(p.alias(n) for p, n in zip(parts, ("decision", "value", "value_state", "warnings", "trace", "discretion")))).cast(DECISION)


def order(facts: list[Fact], decisions: list[Decision], inputs: set[str]) -> list[str]:
    """The facts in an order in which each comes after what it needs."""
    graph = {f.name: set(f.needs) - inputs for f in facts}
    for name in [n for needs in graph.values() for n in needs] + [n for d in decisions for n in d.facts]:
        if name not in graph:
            raise ValueError(f"nothing gives {name}")
    for d in decisions:
        if missing := set(d.inputs) - inputs:
            raise ValueError(f"{d.name} asks for unknown inputs {sorted(missing)}")
    try:
        return list(TopologicalSorter(graph).static_order())
    except CycleError as e:
        raise ValueError(f"the rules go round in a circle: {e.args[1]}") from e


def compile(facts: list[Fact], decisions: list[Decision], inputs: dict[str, str]) -> dict[str, Column]:
    """A column for each decision. ``inputs``: name to column of a struct ``value string, state string``."""
    known = {n: F.when((F.col(c)["state"] == "known") & (F.col(c)["value"] != ""), F.col(c)["value"]) for n, c in inputs.items()}
    states = {n: F.coalesce(F.col(c)["state"], F.lit("not_provided")) for n, c in inputs.items()}
    values, by_name = dict(known), {f.name: f for f in facts}
    for name in order(facts, decisions, set(inputs)):
        values[name] = by_name[name].of(*(values[n] for n in by_name[name].needs))
    out = {}
    for d in decisions:
        got = F.lit(True)
        for n in d.inputs:
            got = got & known[n].isNotNull()
        answer = _result(d, None, F.lit(None))
        for clause in reversed(d.clauses):
            asked = [states[n] for n in d.inputs] if clause.by_state else [values[n] for n in (*d.inputs, *d.facts)]
            holds = clause.when(*asked) if clause.by_state else got & clause.when(*asked)
            said = clause.value(*(values[n] for n in (*d.inputs, *d.facts))) if callable(clause.value) else F.lit(clause.value)
            answer = F.when(F.coalesce(holds, F.lit(False)), _result(d, clause, said)).otherwise(answer)
        out[d.name] = answer
    return out


# Sections, parameters, grounds and messages of the five decisions.
S2, S12, S14, S15, S15A, S28 = (f"OIA 1982 s {s}" for s in ("2", "12(3)", "14", "15", "15A", "28"))
RESPONSE_DAYS, TRANSFER_DAYS = 20, 10
GROUNDS = ["large_quantity", "consultation_required"]
NO_RECEIPT = "receipt date is required to calculate the response deadline"
STALE_RECEIPT = "receipt date was verified but may be stale"
LATE_NOTICE = "extension notice after original deadline"
BAD_GROUND = "extension ground is not one of the verified statutory ground labels"
REASONABLE = "extension period reasonableness requires human review"
ROUTING = "urgency affects routing only and cannot be machine certified"

ALWAYS = lambda *_: F.lit(True)
INPUTS = ["receipt_date", "extension_notice_date", "extension_ground", "extension_period_working_days", "current_date", "response_sent", "urgency_reasons_provided"]
DECISIONS = [
    Decision(
        "response_deadline", ("receipt_date",),
        (
            Clause(lambda s: s == "not_provided", state="unknown", warnings=(NO_RECEIPT,), sources=(S15,), by_state=True),
            Clause(lambda s: s == "verified_stale", state="unknown", warnings=(STALE_RECEIPT,), sources=(S2, S15), by_state=True),
            Clause(lambda _, due: due.isNotNull(), lambda _, due: due, sources=(S2, S15)),
        ),
        ("response_due",), "parameter.working_day_limit",
    ),
    Decision("transfer_deadline", ("receipt_date",), (Clause(lambda _, due: due.isNotNull(), lambda _, due: due, sources=(S2, S14)),), ("transfer_due",), "parameter.transfer_limit"),
    Decision(
        "extension_validity", ("receipt_date", "extension_notice_date", "extension_ground", "extension_period_working_days"),
        (
            Clause(lambda r, n, g, p, late: late, "false", warnings=(LATE_NOTICE,), sources=(S15, S15A)),
            Clause(lambda r, n, g, p, late: ~late & ~g.isin(GROUNDS), "false", warnings=(BAD_GROUND,), sources=(S15A,)),
            Clause(lambda r, n, g, p, late: ~late & g.isin(GROUNDS), "true", warnings=(REASONABLE,), sources=(S15, S15A), discretion="extension_reasonableness"),
        ),
        ("late_notice",),
    ),
    Decision(
        "deemed_refusal", ("receipt_date", "current_date", "response_sent"),
        (Clause(lambda r, c, sent, late: sent == "true", "false", sources=(S15, S28)), Clause(lambda r, c, sent, late: late.isNotNull(), lambda r, c, sent, late: late, sources=(S15, S28))),
        ("past_deadline",),
    ),
    Decision(
        "urgency_flag", ("urgency_reasons_provided",),
        (Clause(lambda u: u == "true", "human_decision_required", warnings=(ROUTING,), sources=(S12,), discretion="urgency_assessment"), Clause(ALWAYS, "not_requested", sources=(S12,))),
    ),
]


def statutory_decisions(cases: DataFrame, cal: DataFrame, key: str = "case_id") -> DataFrame:
    """The five decisions of each case, a row for each: ``key, decision, value, value_state, warnings, trace, discretion``.

    ``cases`` has a struct ``value string, state string`` for each of ``INPUTS``; a column that
    is missing, or a null struct, is ``not_provided``. A date that is no date, or beyond the
    calendar, leaves the decision unknown. ``cal`` comes from :func:`clock.calendar`.
    """
    none = F.struct(F.lit(None).cast("string").alias("value"), F.lit("not_provided").alias("state"))
    rows = cases.select(key, *((F.coalesce(F.col(i), none) if i in cases.columns else none).alias(i) for i in INPUTS))
    received = F.when(F.col("receipt_date")["state"] == "known", F.try_to_date(F.col("receipt_date")["value"], "yyyy-MM-dd"))
    rows = rows.withColumn("received", received)
    rows = add_working_days(add_working_days(rows, "received", RESPONSE_DAYS, cal, "response_day"), "received", TRANSFER_DAYS, cal, "transfer_day")
    day = lambda c: F.try_to_date(c, "yyyy-MM-dd")
    facts = [
        Fact("response_due", (), lambda: F.col("response_day")),
        Fact("transfer_due", (), lambda: F.col("transfer_day")),
        Fact("late_notice", ("extension_notice_date", "response_due"), lambda notice, due: day(notice) > due),
        Fact("past_deadline", ("current_date", "response_due"), lambda now, due: day(now) > due),
    ]
    found = compile(facts, DECISIONS, {i: i for i in INPUTS})
    return rows.select(key, F.explode(F.array(*found.values())).alias("d")).select(key, "d.*")
