"""Snapshot diffs, review queues, gold-set and probability samples, duplicate clusters."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import dims
from ..functions.ids import content_id

PRIORITY_RANK = {"urgent": 0, "high": 1, "medium": 2, "low": 3}


def last_wins(rows: DataFrame, key: str, order: str) -> DataFrame:
    """Of rows that share a key the one with the largest ``order``."""
    columns = [c for c in rows.columns if c != key]
    return rows.groupBy(key).agg(F.max_by(F.struct(*columns), order).alias("r")).select(key, "r.*")


def snapshot_diff(before: DataFrame, after: DataFrame, key: str, ignore: tuple[str, ...] = ()) -> DataFrame:
    """Full outer comparison on ``key``: added, removed, modified or unchanged by the digest of the other columns. Keys are unique; see :func:`last_wins`."""
    digest = lambda df: df.select(key, F.sha2(F.to_json(F.struct(*sorted(c for c in df.columns if c != key and c not in ignore)), {"ignoreNullFields": "false"}), 256).alias("d"))
    both = digest(before).withColumnRenamed("d", "before_sha256").join(digest(after).withColumnRenamed("d", "after_sha256"), key, "full_outer")
    change = F.when(F.col("before_sha256").isNull(), "added").when(F.col("after_sha256").isNull(), "removed").when(F.col("before_sha256") != F.col("after_sha256"), "modified").otherwise("unchanged")
    return both.select(key, change.alias("change"))


def risk_tasks(risks: DataFrame) -> DataFrame:
    rationale = F.concat(F.lit("Review risk signals: "), F.array_join("categories", ", "))
    return risks.filter("review_required").select(*_task("risk_review", F.col("source_id"), rationale, F.col("risk_level")))


def span_tasks(spans: DataFrame) -> DataFrame:
    rationale = F.concat(F.lit("Review candidate span: "), F.col("span_type"))
    return spans.select(*_task("span_review", F.col("candidate_id"), rationale, F.when(F.col("confidence") >= 0.9, "high").otherwise("medium")))


def certification_tasks(events: DataFrame) -> DataFrame:
    """Events that need a person's certification and have none."""
    rationale = F.concat(F.col("event_type"), F.lit(" needs human certification"))
    open_ = F.col("requires_human_certification") & ~F.coalesce("human_certified", F.lit(False))
    return events.filter(open_).select(*_task("certification_review", F.col("event_id"), rationale, F.lit("high")))


def _task(kind: str, source, rationale, priority):
    return [content_id("task:", F.lit(kind), source, rationale).alias("task_id"), F.lit(kind).alias("task_type"), source.alias("source_id"), priority.alias("priority"), rationale.alias("rationale")]


def dedupe_tasks(tasks: DataFrame) -> DataFrame:
    """One task per id, the most urgent."""
    rank = F.create_map(*(F.lit(x) for kv in PRIORITY_RANK.items() for x in kv))[F.col("priority")]
    return tasks.groupBy("task_id").agg(F.min_by(F.struct("task_type", "source_id", "priority", "rationale"), rank).alias("t")).select("task_id", "t.*")


def stratified_sample(rows: DataFrame, key: str, stratum: str, seed: str, per_stratum: int, limit: int) -> DataFrame:
    """At most ``per_stratum`` rows of each stratum by hash of seed and key, and ``limit`` in all, taken in the strata's order, so late strata may get none. The two limits are what a sample is."""
    score = F.sha2(F.concat_ws(":", F.lit(seed), F.col(key).cast("string")), 256)
    ranked = rows.withColumn("score", score).withColumn("rank", F.row_number().over(Window.partitionBy(stratum).orderBy("score")))
    return ranked.filter(F.col("rank") <= per_stratum).orderBy(stratum, "score").limit(limit)


def simple_sample(units: DataFrame, key: str, seed: int, size: int) -> DataFrame:
    """Simple random sample without replacement by rank of the hash, with inclusion probability and weight."""
    score = F.sha2(F.concat(F.lit(f'{{"seed":{seed},"unit":"'), F.col(key).cast("string"), F.lit('"}')), 256)
    drawn = units.withColumn("score", score).orderBy("score", key).limit(size)
    n = units.agg(F.count("*").alias("population"))
    return drawn.crossJoin(n).withColumn("probability", F.least(F.lit(1.0), F.lit(float(size)) / F.col("population"))).withColumn("weight", 1 / F.col("probability"))


def complement_holdout(units: DataFrame, prior: DataFrame, key: str, seed: int, size: int) -> DataFrame:
    """A sample of what an earlier one has left."""
    return simple_sample(units.join(prior.select(key), key, "left_anti"), key, seed, size)


def duplicate_clusters(rows: DataFrame, key: str, text: str) -> DataFrame:
    """Exact clusters on lower-case text with single spaces: id, size, smallest member. Members stay rows of their own."""
    norm = F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"\s+", " "))
    return rows.withColumn("cluster_id", F.sha2(norm, 256)).groupBy("cluster_id").agg(F.count("*").alias("members"), F.min(key).alias("first_member"))


def frame_checks(units: DataFrame, included: DataFrame, excluded: DataFrame, key: str) -> DataFrame:
    """Included and excluded ids are disjoint, known, and together as many as the population."""
    count = lambda df, name: df.agg(F.count("*").alias(name))
    out = count(units, "population").crossJoin(count(included, "included")).crossJoin(count(excluded, "excluded"))
    out = out.crossJoin(count(included.select(key).intersect(excluded.select(key)), "overlap")).crossJoin(count(included.select(key).unionByName(excluded.select(key)).subtract(units.select(key)), "unknown"))
    return out.withColumn("ok", (F.col("overlap") == 0) & (F.col("unknown") == 0) & (F.col("population") == F.col("included") + F.col("excluded")))


def requires_certification(event_type):
    return event_type.isin(dims.CERTIFICATION_TYPES)
