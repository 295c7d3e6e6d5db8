"""What a model's output must not claim."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import dims

#: Codes of findings. Fixed values.
REVIEW, CERTIFIED, BOUNDARY, POSITIVE = "model_output_review_required", "certified_model_output_rejected", "human_certification_boundary_required", "provider_human_certification_rejected"


def output_findings(records: DataFrame, key: str = "event_id") -> DataFrame:
    """A row for each rule that a record breaks, all of them errors: ``key, severity, code, passed_on`` (always false).

    ``records`` has ``event_type, assertion_status, machine_generated, human_review_required,
    requires_human_certification, human_certified``. A missing flag is no promise and counts as false.
    """
    is_ = lambda c: F.coalesce(F.col(c), F.lit(False))
    machine = is_("machine_generated")
    codes = F.array_compact(
        F.array(
            F.when(machine & ~is_("human_review_required"), REVIEW),
            F.when(machine & F.col("assertion_status").eqNullSafe("certified"), CERTIFIED),
            F.when(F.coalesce(F.col("event_type").isin(dims.CERTIFICATION_TYPES), F.lit(False)) & ~is_("requires_human_certification"), BOUNDARY),
            F.when(is_("human_certified"), POSITIVE),
        )
    )
    return records.select(key, F.lit("error").alias("severity"), F.explode(codes).alias("code"), F.lit(False).alias("passed_on"))


def passed(records: DataFrame, key: str = "event_id") -> DataFrame:
    """The records without a finding: candidates still, with no legal effect."""
    return records.join(output_findings(records, key).select(key).distinct(), key, "left_anti").withColumns({"legal_effect": F.lit("none"), "machine_certification_allowed": F.lit(False)})
