"""Provenance as a graph: edges between artifacts, what is reached from what, broken pins, supersession.

Closures grow by doubling: a round joins the pairs that are exactly ``2^i`` steps apart with
all pairs up to there, so the rounds are the logarithm of the longest way, whatever it is,
and end when nothing is added. Every round's pairs are written, so none is computed twice.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import written

#: Kinds of artifacts whose origin is told. Fixed values.
DERIVED = ["derived", "report", "ontology"]


def artifact_ids(artifacts: DataFrame) -> DataFrame:
    """Adds ``node_id`` from ``path`` and ``sha256``."""
    return artifacts.withColumn("node_id", F.concat(F.lit("artifact:"), F.substring(F.sha2(F.concat(F.col("path"), F.lit("\0"), F.col("sha256")), 256), 1, 24)))


def artifact_edges(artifacts: DataFrame) -> DataFrame:
    """Edges by convention between the artifacts (``run_id, node_id, kind``) of one run: every raw and every schema artifact with every derived one. The product is the relation asked for; it stays within a run and moves each artifact once."""
    ends = artifacts.filter(F.col("kind").isin(DERIVED)).select("run_id", F.col("node_id").alias("target"))
    relation = F.when(F.col("kind") == "raw", "derived_from").otherwise("validated_by")
    starts = artifacts.filter(F.col("kind").isin("raw", "schema")).select("run_id", F.col("node_id").alias("source"), relation.alias("relation"))
    edges = starts.join(ends, "run_id").filter("source <> target")
    edge_id = F.concat(F.lit("edge:"), F.substring(F.sha2(F.concat("source", F.lit(">"), "target"), 256), 1, 24))
    return edges.select("run_id", edge_id.alias("edge_id"), "source", "target", "relation")


def reachable(edges: DataFrame) -> DataFrame:
    """``source, target, steps``: all pairs joined by a way along ``source, target`` edges, with the fewest steps. A node on a circle reaches itself. Null ends are no nodes."""
    known = written(edges.filter("source IS NOT NULL AND target IS NOT NULL").select("source", "target").distinct().withColumn("steps", F.lit(1).cast("long")), "reach")
    span = 1
    while True:
        far = known.filter(F.col("steps") == span).select("source", F.col("target").alias("mid"))
        on = known.select(F.col("source").alias("mid"), "target", "steps")
        longer = far.join(on, "mid").groupBy("source", "target").agg((F.min("steps") + span).alias("steps"))
        fresh = written(longer.join(known.select("source", "target"), ["source", "target"], "left_anti"), "reach-more")
        if fresh.isEmpty():
            return known
        known, span = written(known.unionByName(fresh), "reach"), 2 * span


def acyclic(links: DataFrame) -> bool:
    """Is a graph (``old, new``) free of circles? Of any depth."""
    return reachable(links.select(F.col("old").alias("source"), F.col("new").alias("target"))).filter("source = target").isEmpty()


def follow(links: DataFrame) -> DataFrame:
    """``node, last, hops`` for every node with a successor (``node, next``, one for a node): where the way along successors ends. ``last`` is null where it never does.

    Each round every node whose end isn't known jumps from where it has come to where that
    one has come, so the rounds are logarithmic in the longest way and circle. ``low`` is the
    least node that a way has passed: a node that is its own has come round in a circle, and
    so has every node that has passed it. Nodes that are done are only looked up.
    """
    columns = ["node", "last", "hops", "low"]
    state = links.filter("node IS NOT NULL AND next IS NOT NULL").select("node", F.col("next").alias("last"), F.lit(1).cast("long").alias("hops"), F.col("next").alias("low"))
    state, done = written(state, "follow"), []
    while not state.isEmpty():
        table = reduce(DataFrame.unionByName, [d.withColumn("over", F.lit(True)) for d in done], state.withColumn("over", F.lit(False)))
        on = table.select(F.col("node").alias("last"), F.col("last").alias("further"), F.col("hops").alias("more"), F.col("low").alias("lower"), "over")
        ended, hops = F.col("over").isNull(), F.col("hops") + F.col("more")
        moved = state.join(on.hint("merge"), "last", "left").select(
            "node", F.when(ended, F.col("last")).otherwise(F.col("further")).alias("last"), F.when(ended, F.col("hops")).otherwise(hops).alias("hops"), F.least("low", "lower").alias("low"), F.coalesce("over", F.lit(True)).alias("over")
        )
        moved = written(moved, "follow")
        done.append(moved.filter("over").select(columns))
        state = moved.filter("NOT over").select(columns)
        circles = state.filter("node = low").select("low")
        if not circles.isEmpty():
            told = written(state.join(circles.withColumn("circle", F.lit(True)).hint("merge"), "low", "left"), "follow")
            done.append(told.filter("circle").select("node", F.lit(None).cast(told.schema["last"].dataType).alias("last"), F.lit(None).cast("long").alias("hops"), "low"))
            state = told.filter("circle IS NULL").select(columns)
    return reduce(DataFrame.unionByName, done, state).select("node", "last", "hops")


def pin_status(artifacts: DataFrame, pins: DataFrame) -> DataFrame:
    """Every pin (``id, pinned_id, pinned_sha256``) against the artifacts (``id, sha256``): ``ok``, ``missing`` or ``digest_mismatch``."""
    there = artifacts.select(F.col("id").alias("pinned_id"), F.col("sha256").alias("found"), F.lit(True).alias("there")).dropDuplicates(["pinned_id"])
    status = F.when(F.col("there").isNull(), "missing").when(F.col("found").eqNullSafe(F.col("pinned_sha256")), "ok").otherwise("digest_mismatch")
    return pins.join(there.hint("merge"), "pinned_id", "left").select("id", "pinned_id", status.alias("status"))


def nearest_broken(steps: DataFrame, broken: DataFrame) -> DataFrame:
    """``id, steps`` for every ``id`` with steps (``id, target``) from which one of the ``broken`` ids is reached, with the fewest steps. Broken ids should have no steps.

    Nodes with one step are followed to their ends at once, so only those with several are
    left: these learn of a nearer broken one in rounds, each of which reads their steps.
    """
    own = written(steps.filter("id IS NOT NULL AND target IS NOT NULL").groupBy("id").agg(F.collect_set("target").alias("targets")), "steps")
    ends = written(follow(own.filter(F.size("targets") == 1).select(F.col("id").alias("node"), F.col("targets")[0].alias("next"))).filter("last IS NOT NULL"), "ends")
    fork = own.filter(F.size("targets") > 1).select("id", F.explode("targets").alias("target"))
    to = ends.select(F.col("node").alias("target"), "last", "hops").hint("merge")
    fork = written(fork.join(to, "target", "left").select("id", F.coalesce("last", "target").alias("target"), (1 + F.coalesce("hops", F.lit(0))).alias("far")), "forks")
    fresh = broken.filter("id IS NOT NULL").distinct().select(F.col("id").alias("target"), F.lit(0).cast("long").alias("steps"))
    known = fresh = written(fresh, "known")
    while not fork.isEmpty():
        near = fork.join(fresh.hint("merge"), "target").groupBy(F.col("id").alias("target")).agg(F.min(F.col("far") + F.col("steps")).alias("steps"))
        before = known.select("target", F.col("steps").alias("before")).hint("merge")
        fresh = written(near.join(before, "target", "left").filter("before IS NULL OR steps < before").select("target", "steps"), "nearer")
        if fresh.isEmpty():
            break
        known = written(known.unionByName(fresh).groupBy("target").agg(F.min("steps").alias("steps")), "known")
    found = ends.join(known.select(F.col("target").alias("last"), "steps").hint("merge"), "last").select(F.col("node").alias("id"), (F.col("hops") + F.col("steps")).alias("steps"))
    return found.unionByName(known.filter("steps > 0").select(F.col("target").alias("id"), "steps"))


def pin_chains(artifacts: DataFrame, pins: DataFrame) -> DataFrame:
    """Per artifact: its broken pins, and through how many pins the nearest broken one is reached (0: its own; null: none). A chain holds only as far as all pins below it do."""
    checked = pin_status(artifacts, pins)
    bad = F.col("status") != "ok"
    own = written(checked.groupBy("id").agg(F.count_if(bad).alias("broken"), F.array_sort(F.collect_set(F.when(bad, F.col("status")))).alias("codes"), F.collect_set("pinned_id").alias("targets")), "pins")
    # A way to the nearest broken pin goes through artifacts whose own pins all hold.
    below = nearest_broken(own.filter("broken = 0").select("id", F.explode("targets").alias("target")), own.filter("broken > 0").select("id"))
    rows = artifacts.select("id").distinct().join(own.drop("targets").hint("merge"), "id", "left").join(below.hint("merge"), "id", "left")
    broken = F.coalesce("broken", F.lit(0))
    return rows.select("id", broken.alias("broken"), F.coalesce("codes", F.array().cast("array<string>")).alias("codes"), F.when(broken > 0, 0).otherwise(F.col("steps")).cast("long").alias("distance"))


def lifecycle_audit(lifecycle: DataFrame, current: DataFrame) -> DataFrame:
    """``id, code`` for every broken rule of an evidence lifecycle (``id, disposition, superseded_by, reason``) and the ``current`` ids: duplicate ids, dispositions that don't go with target and reason, targets that are missing or lead round in a circle, current evidence that isn't active."""
    lifecycle = written(lifecycle.select("id", "disposition", "superseded_by", "reason"), "lifecycle")
    each = written(lifecycle.groupBy("id").agg(F.count("*").alias("count"), F.min("superseded_by").alias("next"), F.coalesce(F.bool_or(F.col("disposition") == "active"), F.lit(False)).alias("active")), "ids")
    said = F.coalesce(F.trim("reason"), F.lit("")) != ""
    to, kind = F.col("superseded_by").isNotNull(), F.col("disposition")
    codes = F.array_compact(
        F.array(
            F.when((kind == "active") & (to | F.col("reason").isNotNull()), "active_with_retirement"),
            F.when((kind == "superseded") & ~(to & said), "superseded_incomplete"),
            F.when((kind == "invalidated") & (to | ~said), "invalidated_incomplete"),
            F.when(~F.coalesce(kind.isin("active", "superseded", "invalidated"), F.lit(False)), "unknown_disposition"),
        )
    )
    own = lifecycle.select("id", F.explode(codes).alias("code"))
    twice = each.filter("count > 1").select("id", F.lit("duplicate_id").alias("code"))
    ids = each.select(F.col("id").alias("next")).hint("merge")
    lost = lifecycle.filter(to).select("id", F.col("superseded_by").alias("next")).join(ids, "next", "left_anti").select("id", F.lit("target_missing").alias("code"))
    ways = follow(each.select(F.col("id").alias("node"), "next"))
    round_ = ways.filter("last IS NULL").select(F.col("node").alias("id"), F.lit("supersession_circle").alias("code"))
    stale = current.select("id").distinct().join(each.filter("active").select("id").hint("merge"), "id", "left_anti").select("id", F.lit("current_not_active").alias("code"))
    return own.unionByName(twice).unionByName(lost).unionByName(round_).unionByName(stale)


def replay_census(approved: DataFrame, selection: DataFrame, replay: DataFrame, completion: DataFrame, key: str = "id", digest: str = "sha256") -> DataFrame:
    """Where a replay departs from the approved population: per key the first stage that lacks it, has it unasked, or has another digest. Without rows the pins of all four agree."""
    stages = {"selection": selection, "replay": replay, "completion": completion}
    rows = approved.select(F.col(key).alias("key"), F.col(digest).alias("pinned"), F.lit(True).alias("approved"))
    for name, table in stages.items():
        counted = table.groupBy(F.col(key).alias("key")).agg(F.count("*").alias(f"n_{name}"), F.min(digest).alias(f"sha_{name}"), F.max(digest).alias(f"most_{name}"))
        rows = rows.join(counted, "key", "full_outer")
    issue = F.when(F.col("approved").isNull(), "not_approved")
    for name in stages:
        n, low, high = F.col(f"n_{name}"), F.col(f"sha_{name}"), F.col(f"most_{name}")
        issue = issue.when(n.isNull(), f"missing_in_{name}").when(n > 1, f"repeated_in_{name}").when(~(low.eqNullSafe(F.col("pinned")) & high.eqNullSafe(F.col("pinned"))), f"digest_differs_in_{name}")
    return rows.select(F.col("key").alias(key), issue.alias("issue")).filter("issue IS NOT NULL")
