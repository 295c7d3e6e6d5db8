"""A user's extractor as a table function, and how well its output agrees with a reference.

``register_extractor`` turns a Python callable into a function that SQL calls on a table of
units. What the callable returns is held against a contract; a unit whose output breaks it
comes back as a row that says so, and the others go on.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, MapType, StringType, StructField, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from ..session import written
from .measures import prf

SPANS = ArrayType(StructType([StructField("start", IntegerType()), StructField("end", IntegerType())]))
OUTPUT = StructType([StructField("unit_id", StringType()), StructField("label", StringType()), StructField("spans", SPANS), StructField("provenance", MapType(StringType(), StringType())), StructField("problem", StringType())])


def contract_problem(prediction: object, text: str, labels: frozenset[str]) -> str | None:
    """The first rule of the contract that a prediction breaks."""
    if not isinstance(prediction, dict) or set(prediction) != {"label", "spans", "provenance"}:
        return "fields"
    label, spans = prediction["label"], prediction["spans"]
    if label is not None and label not in labels:
        return "label_not_registered"
    if not isinstance(spans, list) or any(not isinstance(s, dict) or set(s) != {"start", "end"} or any(type(v) is not int for v in s.values()) for s in spans):
        return "span_fields"
    if any(not 0 <= s["start"] < s["end"] <= len(text) for s in spans):
        return "span_outside_text"
    if any(a["end"] > b["start"] for a, b in zip(spans, spans[1:])):
        return "spans_not_in_order"
    if label is None and spans:
        return "spans_without_label"
    if not isinstance(prediction["provenance"], dict):
        return "provenance"
    return None


def register_extractor(spark: SparkSession, name: str, extractor: Callable[[dict], dict], labels: list[str]) -> None:
    """Make ``SELECT * FROM name(TABLE(units))`` run ``extractor`` on every row of a table with ``unit_id`` and ``text``.

    The callable gets a dictionary of all columns and returns ``label`` (null: it abstains),
    ``spans`` (``start``, ``end``, half-open, in characters) and ``provenance``. The result has
    a row for a unit; ``problem`` names a broken rule or ``raised: ...``, the rest is null
    then. A null text counts as empty.
    """
    known = frozenset(labels)

    class Extractor:
        @staticmethod
        def analyze(units: AnalyzeArgument) -> AnalyzeResult:
            columns = {f.name for f in units.dataType.fields} if units.isTable else set()
            if not {"unit_id", "text"} <= columns:
                raise ValueError("the argument must be a table with the columns unit_id and text")
            return AnalyzeResult(OUTPUT)

        def eval(self, row):
            unit = row.asDict(recursive=True)
            unit_id, unit["text"] = unit["unit_id"], unit["text"] or ""
            key = None if unit_id is None else str(unit_id)
            try:
                found = extractor(dict(unit))
            except Exception as e:  # one bad unit must not end the job
                yield key, None, None, None, f"raised: {type(e).__name__}"
                return
            problem = contract_problem(found, unit["text"], known)
            if problem:
                yield key, None, None, None, problem
            else:
                yield key, found["label"], [(s["start"], s["end"]) for s in found["spans"]], {str(k): None if v is None else str(v) for k, v in found["provenance"].items()}, None

    spark.udtf.register(name, F.udtf(Extractor))


def extract(units: DataFrame, name: str) -> DataFrame:
    """A registered extractor on ``units``."""
    return units.sparkSession.sql(f"SELECT * FROM {name}(TABLE({{units}}))", units=units)


def _length(spans):
    return F.aggregate(spans, F.lit(0), lambda n, s: n + s["end"] - s["start"])


def overlap_share(a, b):
    """Characters that two lists of disjoint spans share, of those that either has; 1 if both are empty. By the spans' ends, whatever their lengths."""
    pairs = F.flatten(F.transform(a, lambda x: F.transform(b, lambda y: F.greatest(F.lit(0), F.least(x["end"], y["end"]) - F.greatest(x["start"], y["start"])))))
    both = F.aggregate(pairs, F.lit(0), lambda n, x: n + x)
    either = _length(a) + _length(b) - both
    return F.when(either == 0, F.lit(1.0)).otherwise(both / either)


def extractor_report(reference: DataFrame, predictions: DataFrame, required: list[str], iou: float | None = None) -> DataFrame:
    """One row: labels, coverage, exact spans, span overlap and provenance of predictions against a reference (``unit_id, label, spans``).

    A wrong label is a false positive and a false negative. Spans are compared over all
    units, and over those whose labels match and are not null. A unit without a sound
    prediction counts as abstained and in ``broken``.
    """
    if iou is not None and not 0 <= iou <= 1:
        raise ValueError("the least overlap is between zero and one")
    none = F.array().cast(SPANS)
    p = predictions.select("unit_id", F.col("label").alias("p"), F.coalesce("spans", none).alias("p_spans"), "provenance", F.col("problem").isNotNull().alias("bad"), F.lit(True).alias("there"))
    rows = reference.select("unit_id", F.col("label").alias("g"), F.coalesce("spans", none).alias("g_spans")).join(p, "unit_id", "left").withColumn("p_spans", F.coalesce("p_spans", none))
    given, right, same = F.col("p").isNotNull(), F.coalesce(F.col("p") == F.col("g"), F.lit(False)), F.col("p_spans") == F.col("g_spans")
    complete = F.lit(True)
    for field in required:
        complete = complete & (F.coalesce(F.col("provenance")[field], F.lit("")) != "")
    near = overlap_share(F.col("g_spans"), F.col("p_spans")) >= iou if iou is not None else F.lit(None).cast("boolean")
    counts = rows.agg(
        F.count("*").alias("units"), F.count_if(F.coalesce("bad", F.lit(False)) | F.col("there").isNull()).alias("broken"), F.count_if(right).alias("tp"), F.count_if(given & ~right).alias("fp"), F.count_if(F.col("g").isNotNull() & ~right).alias("fn"),
        F.count_if(given).alias("covered"), F.count_if(same).alias("all_exact_spans"), F.count_if(right & same).alias("exact_spans"), F.count_if(right & near).alias("overlapping"), F.count_if(given & complete).alias("complete"),
    )
    share = lambda a, b: F.col(a) / F.nullif(F.col(b), F.lit(0))
    return counts.select(
        "*", *prf(F.col("tp"), F.col("fp"), F.col("fn")), share("covered", "units").alias("coverage"), share("all_exact_spans", "units").alias("all_exact_span_rate"), share("exact_spans", "tp").alias("exact_span_rate"),
        F.when(F.lit(iou is not None), share("overlapping", "tp")).alias("overlap_rate"), share("complete", "covered").alias("provenance_rate"),
    )


def span_matches(reference: DataFrame, predictions: DataFrame) -> DataFrame:
    """One-to-one pairs of spans (``unit_id, start, end`` on both sides, disjoint on each) that overlap: ``unit_id, start, end, p_start, p_end, overlap``.

    Of all pairs that overlap those go together that are each other's largest; then, among
    the spans left over, again, until none is left. Ties go to the earlier span. Disjoint
    spans overlap those next to them only, so a span has few pairs.
    """
    g = reference.select("unit_id", "start", "end").distinct()
    p = predictions.select("unit_id", F.col("start").alias("p_start"), F.col("end").alias("p_end")).distinct()
    shared = F.least("end", "p_end") - F.greatest("start", "p_start")
    left = written(g.join(p, (g.unit_id == p.unit_id) & (F.col("start") < F.col("p_end")) & (F.col("p_start") < F.col("end"))).select(g.unit_id, "start", "end", "p_start", "p_end", shared.alias("overlap")), "spans")
    found = left.limit(0)
    while not left.isEmpty():
        best = lambda *by: left.groupBy("unit_id", *by).agg(F.max_by(F.struct("start", "p_start"), F.struct("overlap", -F.col("start"), -F.col("p_start"))).alias("m")).select("unit_id", "m.start", "m.p_start")
        mutual = written(left.join(best("start").intersect(best("p_start")), ["unit_id", "start", "p_start"]).select(left.columns), "matches")
        found = found.unionByName(mutual)
        left = written(left.join(mutual.select("unit_id", "start"), ["unit_id", "start"], "left_anti").join(mutual.select("unit_id", "p_start"), ["unit_id", "p_start"], "left_anti").select(left.columns), "spans")
    return found
