"""Agreement of two annotators: five measures, each with a bootstrap interval.

Units, or whole clusters of them, are drawn again as often as there are. What a measure needs
of a unit is the cell it falls into (both labels, and whether the spans agree), so draws are
counted by the units' cells, range by range of the units: a replicate is a handful of rows,
however many units there are.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import written
from .drawing import drawn_sums, numbered

MEASURES = ["raw_label", "cohen_kappa", "all_unit_exact_span", "exact_span", "abstention"]


def cells(left: DataFrame, right: DataFrame, unit: str = "unit_id", cluster: DataFrame | None = None) -> DataFrame:
    """``unit, entity, a, b, same_spans``: one row for a unit that both have. Tables of units are never broadcast, however small their files. ``cluster`` (``unit, cluster_id``) names what is drawn as a whole; else a unit is drawn alone."""
    r = right.select(unit, F.col("label").alias("b"), F.col("spans").alias("_s"))
    rows = left.select(unit, F.col("label").alias("a"), "spans").join(r.hint("merge"), unit).withColumn("same_spans", F.col("spans").eqNullSafe(F.col("_s"))).drop("spans", "_s")
    rows = rows.join(cluster.select(unit, F.col("cluster_id").alias("entity")).hint("merge"), unit) if cluster is not None else rows.withColumn("entity", F.col(unit))
    return rows.select(unit, "entity", "a", "b", "same_spans")


def lineage_problems(left: DataFrame, right: DataFrame, membership: DataFrame, unit: str = "unit_id") -> DataFrame:
    """Units that one side lacks, repeats, or has under another digest than the membership (``unit, unit_sha256``)."""
    rows = membership.select(unit, F.col("unit_sha256").alias("pinned"), F.lit(True).alias("member"))
    for side, table in (("left", left), ("right", right)):
        rows = rows.join(table.groupBy(unit).agg(F.count("*").alias(f"n_{side}"), F.min("unit_sha256").alias(f"sha_{side}")), unit, "full_outer")
    issue = F.when(F.col("member").isNull(), "not_a_member")
    for side in ("left", "right"):
        issue = issue.when(F.col(f"n_{side}").isNull(), f"missing_{side}").when(F.col(f"n_{side}") > 1, f"repeated_{side}").when(~F.col(f"sha_{side}").eqNullSafe(F.col("pinned")), f"digest_{side}")
    return rows.select(unit, issue.alias("issue")).filter("issue IS NOT NULL")


def measured(counted: DataFrame, by: list[str], rule: str = "registered") -> DataFrame:
    """The five measures from counts of cells (``a, b, same_spans, n``), for each group ``by``: ``measure, numerator, denominator, estimate``.

    A null label is a category of its own for kappa, which is undefined where chance agrees
    always: within 1e-9 by the rule ``registered``, exactly by ``legacy``. Spans are compared
    over all units, and over those with the same label.
    """
    same, judged = F.col("a").eqNullSafe(F.col("b")), F.col("a").isNotNull() & (F.col("a") == F.col("b"))
    some = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0))
    sums = counted.groupBy(*by).agg(
        F.sum("n").alias("units"), some(same).alias("raw"), some(F.col("same_spans")).alias("spans"), some(judged).alias("judged"), some(judged & F.col("same_spans")).alias("judged_spans"), some(F.col("a").isNull() == F.col("b").isNull()).alias("abstained"),
    )
    side = lambda c: counted.groupBy(*by, F.col(c).alias("label")).agg(F.sum("n").alias(f"n_{c}"))
    a, b = side("a"), side("b")
    both = a.alias("x").join(b.alias("y"), [F.col(f"x.{c}").eqNullSafe(F.col(f"y.{c}")) for c in (*by, "label")]).groupBy(*(F.col(f"x.{c}").alias(c) for c in by)).agg(F.sum(F.col("n_a").cast("decimal(19,0)") * F.col("n_b").cast("decimal(19,0)")).alias("chance"))
    rows = sums.join(both, by, "left") if by else sums.crossJoin(both)
    expected = F.coalesce(F.col("chance").cast("double"), F.lit(0.0)) / F.col("units") / F.col("units")
    always = F.col("chance") == F.col("units").cast("decimal(19,0)") * F.col("units") if rule == "legacy" else F.abs(expected - 1) <= 1e-9
    kappa = F.when(~F.coalesce(always, F.lit(False)), (F.col("raw") / F.col("units") - expected) / F.nullif(1 - expected, F.lit(0.0)))
    none = F.lit(None).cast("long")
    part = lambda m, n, d, e=None: F.struct(F.lit(m).alias("measure"), n.cast("long").alias("numerator"), d.cast("long").alias("denominator"), (e if e is not None else n / F.nullif(d, F.lit(0))).alias("estimate"))
    units = F.col("units")
    listed = F.array(part("raw_label", F.col("raw"), units), part("cohen_kappa", none, none, kappa), part("all_unit_exact_span", F.col("spans"), units), part("exact_span", F.col("judged_spans"), F.col("judged")), part("abstention", F.col("abstained"), units))
    return rows.filter(units > 0).select(*by, F.explode(listed).alias("m")).select(*by, "m.*")


def replicates_of(rows: DataFrame, seed: int, replicates: int, rule: str = "registered") -> DataFrame:
    """The measures of each bootstrap replicate of ``cells``: entities in the order of their names are drawn as Python's generator draws them."""
    entities = numbered(rows.select("entity").distinct(), ["entity"])
    weights = rows.groupBy("entity", "a", "b", "same_spans").agg(F.count("*").alias("n")).join(entities.hint("merge"), "entity")
    weights = written(weights.select("number", "a", "b", "same_spans", "n"), "cells")
    counted = drawn_sums(weights, seed, entities.count(), replicates, ["a", "b", "same_spans"], ["n"])
    return measured(written(counted, "replicates"), ["replicate"], rule)


def percentiles(values: DataFrame, confidence: float = 0.95, rule: str = "registered") -> DataFrame:
    """``measure, low, high, valid`` from the order statistics of the replicates that are defined. ``registered``: floor of the lower share of their number, ceiling of the upper one less one. ``legacy``: places ``0.025 n`` and ``0.975 n`` cut down to whole numbers."""
    if rule not in ("registered", "legacy"):
        raise ValueError(f"no rule {rule}")
    tail, n = (1 - confidence) / 2, F.count("*").over(Window.partitionBy("measure"))
    # ``replicates`` rows for a measure, as many as the caller asks for.
    ranked = values.filter("estimate IS NOT NULL").withColumn("at", F.row_number().over(Window.partitionBy("measure").orderBy("estimate")) - 1).withColumn("n", n)
    within = lambda c: F.greatest(F.lit(0), F.least(F.col("n") - 1, c.cast("long")))
    if rule == "registered":
        low, high = within(F.floor(F.lit(tail) * F.col("n"))), within(F.ceil(F.lit(1 - tail) * F.col("n")) - 1)
    else:
        low, high = within(F.floor(F.lit(0.025) * F.col("n"))), within(F.floor(F.lit(0.975) * F.col("n")))
    return ranked.groupBy("measure").agg(F.max(F.when(F.col("at") == low, F.col("estimate"))).alias("low"), F.max(F.when(F.col("at") == high, F.col("estimate"))).alias("high"), F.max("n").alias("valid"))


def reliability(left: DataFrame, right: DataFrame, seed: int, replicates: int, unit: str = "unit_id", cluster: DataFrame | None = None, confidence: float = 0.95, rule: str = "registered") -> DataFrame:
    """Per measure: numerator, denominator, estimate, interval, and how many replicates were defined. Without units the result is empty."""
    if replicates <= 0 or not 0 < confidence < 1 or math.isnan(confidence):
        raise ValueError("replicates must be positive and confidence between 0 and 1")
    rows = written(cells(left, right, unit, cluster), "units")
    if rows.isEmpty():
        return measured(rows.withColumn("n", F.lit(1)), []).withColumns({"low": F.lit(0.0), "high": F.lit(0.0), "valid": F.lit(0).cast("long"), "undefined": F.lit(0).cast("long")})
    point = measured(rows.groupBy("a", "b", "same_spans").agg(F.count("*").alias("n")), [], rule)
    spread = percentiles(written(replicates_of(rows, seed, replicates, rule), "measures"), confidence, rule)
    valid = F.coalesce("valid", F.lit(0)).cast("long")
    return point.join(spread, "measure", "left").withColumn("valid", valid).withColumn("undefined", F.lit(replicates) - valid)


def departures(stored: DataFrame, recomputed: DataFrame) -> DataFrame:
    """Rows of a stored result that a recomputation from the same rows doesn't give, and the other way round. Exact: a result that any row departs from doesn't hold."""
    columns = stored.columns
    lost, new = stored.exceptAll(recomputed.select(columns)), recomputed.select(columns).exceptAll(stored)
    return lost.withColumn("found_in", F.lit("stored")).unionByName(new.withColumn("found_in", F.lit("recomputed")))
