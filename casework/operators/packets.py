"""Annotation packets, legacy labels, re-extraction deltas, and checks of runs, envelopes and stages."""

from __future__ import annotations

import json

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _strip(value, forbidden: frozenset, removed: set):
    if isinstance(value, dict):
        removed |= forbidden & value.keys()
        return {k: _strip(v, forbidden, removed) for k, v in value.items() if k not in forbidden}
    return [_strip(v, forbidden, removed) for v in value] if isinstance(value, list) else value


def redact_keys(rows: DataFrame, key: str, document: str, forbidden: tuple[str, ...]) -> DataFrame:
    """Drop keys at any depth of open JSON; the rest in canonical form, and which keys were there. Nested JSON of no fixed schema is beyond the built-in functions, so it is read in Arrow batches. Null stays null."""
    names = frozenset(forbidden)

    def run(batches):
        for batch in batches:
            texts, gone = [], []
            for text in batch.column(1).to_pylist():
                removed: set = set()
                texts.append(None if text is None else json.dumps(_strip(json.loads(text), names, removed), sort_keys=True, separators=(",", ":"), ensure_ascii=False))
                gone.append(sorted(removed))
            yield pa.record_batch([batch.column(0), pa.array(texts, pa.string()), pa.array(gone, pa.list_(pa.string()))], [key, "redacted", "removed"])

    return rows.select(key, document).mapInArrow(run, f"`{key}` {dict(rows.dtypes)[key]}, redacted string, removed array<string>")


def blinded_packets(units: DataFrame, membership: DataFrame, key: str, content: str, roles: tuple[str, ...]) -> DataFrame:
    """The same units once for each role, with a digest that does not depend on the role; ``issue`` marks units outside the membership and members without a unit. The roles are a fixed list of distinct names."""
    if len(set(roles)) != len(roles):
        raise ValueError("roles must be distinct")
    both = units.select(key, F.sha2(F.concat_ws("\x00", F.col(key).cast("string"), F.coalesce(content, F.lit(""))), 256).alias("unit_sha256")).join(membership.select(key, F.lit(True).alias("member")), key, "full_outer")
    issue = F.when(F.col("unit_sha256").isNull(), "missing").when(F.col("member").isNull(), "unknown")
    return both.select(key, "unit_sha256", issue.alias("issue"), F.explode(F.array(*map(F.lit, roles))).alias("role"))


def legacy_labels(rows: DataFrame, label: str, unknown: str = "unknown", reason: str = "legacy_unknown") -> DataFrame:
    """An old "unknown" label becomes no label with a reason; what was there is kept as ``original``."""
    was = F.lower(F.trim(label)) == unknown
    return rows.withColumn("original", F.col(label)).withColumn("abstention_reason", F.when(was, reason)).withColumn(label, F.when(~was, F.col(label)))


def reextraction_delta(candidate: DataFrame, baseline: DataFrame, key: str, provenance: tuple[str, ...]) -> DataFrame:
    """Full outer comparison of two extractions; rows that differ in provenance alone are a class of their own."""
    content = [c for c in candidate.columns if c != key and c not in provenance]
    digest = lambda df, names: F.sha2(F.to_json(F.struct(*sorted(names)), {"ignoreNullFields": "false"}), 256)
    side = lambda df, p: df.select(key, digest(df, content).alias(f"{p}_content"), digest(df, provenance).alias(f"{p}_source"))
    both = side(baseline, "old").join(side(candidate, "new"), key, "full_outer")
    change = (
        F.when(F.col("old_content").isNull(), "added").when(F.col("new_content").isNull(), "removed").when(F.col("old_content") != F.col("new_content"), "modified")
        .when(F.col("old_source") != F.col("new_source"), "provenance_changed").otherwise("unchanged")
    )
    return both.select(key, change.alias("change"))


def context_diff(before: DataFrame, after: DataFrame, key: str, fields: tuple[str, ...]) -> DataFrame:
    """Two versions of context packs: evidence gained and lost, fields that changed, and whether to abstain, which is so where a version is missing or all its evidence is gone."""
    right = after.select(key, F.col("evidence").alias("new_evidence"), *(F.col(c).alias(f"new_{c}") for c in fields), F.lit(True).alias("has_new"))
    both = before.select(key, "evidence", *fields, F.lit(True).alias("has_old")).join(right, key, "full_outer")
    none = F.array().cast("array<string>")
    old, new = F.coalesce("evidence", none), F.coalesce("new_evidence", none)
    changed = F.array_compact(F.array(*(F.when(~F.col(c).eqNullSafe(F.col(f"new_{c}")), c) for c in fields)))
    abstain = F.col("has_old").isNull() | F.col("has_new").isNull() | (F.size(new) == 0)
    return both.select(key, F.array_sort(F.array_except(new, old)).alias("added"), F.array_sort(F.array_except(old, new)).alias("removed"), changed.alias("changed_fields"), abstain.alias("abstain"))


def tuple_disagreements(a: DataFrame, b: DataFrame, key: str, fields: tuple[str, ...]) -> DataFrame:
    """Keys of both sides whose tuples of ``fields`` differ; nulls are equal to nulls."""
    other = b.select(key, F.struct(*fields).alias("other"))
    return a.select(key, F.struct(*fields).alias("own")).join(other, key).filter(~F.col("own").eqNullSafe(F.col("other"))).select(key)


def registered_metrics(metrics: DataFrame, registered: DataFrame) -> DataFrame:
    """``path, value`` against the registered ``path``: a path that is not registered is refused, a registered one without a value is missing."""
    both = metrics.select("path", "value").join(registered.select("path", F.lit(True).alias("known")), "path", "full_outer")
    status = F.when(F.col("known").isNull(), "refused").when(F.col("value").isNull(), "missing").otherwise("fetched")
    return both.select("path", status.alias("status"), F.when(F.col("known"), F.col("value")).alias("value"))


def subset_frame(rows: DataFrame, key: str, parts: tuple[str, ...]) -> DataFrame:
    """Units with their own digest and the cluster of equal normalised ``parts`` (lower case, single spaces). Sizes are counted before units are joined to them, so a large cluster is no hot key."""
    norm = lambda c: F.trim(F.regexp_replace(F.lower(F.coalesce(F.col(c).cast("string"), F.lit(""))), r"\s+", " "))
    units = rows.select(key, F.sha2(F.concat_ws("\x1f", *map(norm, parts)), 256).alias("cluster_id"))
    units = units.withColumn("unit_sha256", F.sha2(F.concat_ws("\x1f", F.col(key).cast("string"), "cluster_id"), 256))
    sizes = units.groupBy("cluster_id").agg(F.count("*").alias("members"), F.min(key).alias("first_member"))
    return units.join(sizes, "cluster_id")


def recomputed_equal(stored: DataFrame, recomputed: DataFrame) -> DataFrame:
    """Are two tables equal as multisets? Rows that only one of them has, and the verdict."""
    columns = stored.columns
    count = lambda df, name: df.groupBy(*columns).agg(F.count("*").alias(name))
    on = None
    left, right = count(stored, "s"), count(recomputed.select(*columns), "r").select(*(F.col(c).alias(f"_{c}") for c in columns), "r")
    for c in columns:
        same = F.col(c).eqNullSafe(F.col(f"_{c}"))
        on = same if on is None else on & same
    extra = lambda a, b: F.coalesce(F.sum(F.greatest(F.coalesce(a, F.lit(0)) - F.coalesce(b, F.lit(0)), F.lit(0))), F.lit(0))
    out = left.join(right, on, "full_outer").agg(extra("s", "r").alias("only_stored"), extra("r", "s").alias("only_recomputed"))
    return out.withColumn("equal", (F.col("only_stored") == 0) & (F.col("only_recomputed") == 0))


def run_violations(runs: DataFrame) -> DataFrame:
    """Rules of a run specification: capabilities are not both allowed and forbidden, none is used that is not allowed, selected and excluded units make up the population, inputs and recorded digests are one multiset."""
    broken = F.array_compact(
        F.array(
            F.when(F.size(F.array_intersect("allowed", "forbidden")) > 0, "capability_conflict"), F.when(F.size(F.array_except("used", "allowed")) > 0, "capability_not_allowed"),
            F.when(F.col("selected") + F.col("excluded") != F.col("population"), "population_not_conserved"), F.when(F.array_sort("inputs") != F.array_sort("recorded"), "input_digests_differ"),
        )
    )
    return runs.select("run_id", F.explode(broken).alias("violation"))


def stage_violations(stages: DataFrame) -> DataFrame:
    """Per run: the last completed stage, and the stages that began out of order, whose predecessor is not complete or whose input is not the predecessor's output. ``stages``: run_id, position, status, input, output."""
    w = Window.partitionBy("run_id").orderBy("position")
    before = F.lag(F.struct("status", "output", "position")).over(w)
    rows = stages.withColumn("before", before)
    bad = F.array_compact(
        F.array(
            F.when(F.col("before").isNotNull() & (F.col("status") != "pending") & (F.col("before.status") != "completed"), "predecessor_incomplete"),
            F.when(F.col("before").isNotNull() & (F.col("input") != F.col("before.output")), "broken_lineage"),
            F.when(F.coalesce(F.col("before.position") + 1, F.lit(0)) != F.col("position"), "gap_in_order"),
        )
    )
    return rows.groupBy("run_id").agg(
        F.max(F.when(F.col("status") == "completed", F.col("position"))).alias("last_completed"), *(F.count_if(F.array_contains(bad, v)).alias(v) for v in ("predecessor_incomplete", "broken_lineage", "gap_in_order"))
    )
