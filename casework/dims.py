"""Vocabulary of the process model: small dimension tables. All values here are fixed by the model."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# source_state, normalised_state, confidence, assertion_status
STATE_MAP = [
    ("waiting_response", "Received", 0.74, "inferred"),
    ("waiting_clarification", "AwaitingClarification", 0.78, "observed"),
    ("gone_postal", "Searching", 0.48, "inferred"),
    ("internal_review", "InternalReviewRequested", 0.82, "observed"),
    ("error_message", "Unknown", 0.20, "observed"),
    ("requires_admin", "Unknown", 0.20, "observed"),
    ("successful", "ReleasedInFull", 0.55, "inferred"),
    ("partially_successful", "ReleasedInPart", 0.58, "inferred"),
    ("rejected", "Refused", 0.58, "inferred"),
    ("not_held", "NoDocumentsFound", 0.62, "inferred"),
    ("information_not_held", "NoDocumentsFound", 0.62, "inferred"),
    ("user_withdrawn", "Withdrawn", 0.75, "observed"),
    ("not_foi", "Closed", 0.45, "inferred"),
]
TERMINAL_STATES = ["ReleasedInFull", "ReleasedInPart", "Refused", "NoDocumentsFound", "Withdrawn", "Closed"]
TRANSITIONS = {
    "Drafted": ["Submitted", "Withdrawn"],
    "Submitted": ["Received", "AwaitingClarification"],
    "Received": ["Acknowledged", "ValidityChecking", "TransferredInFull", "SearchPlanning", "AwaitingClarification", "ExtensionApplied", "ChargeAssessment", "Withdrawn"],
    "SearchPlanning": ["Searching", "ConsultationRequired"],
    "Searching": ["DocumentsIdentified", "NoDocumentsFound", "ExtensionApplied", "ConsultationRequired", "ChargeAssessment"],
    "ExtensionApplied": ["SearchPlanning", "Searching", "DocumentsIdentified", "ConsultationRequired", "DecisionDrafting", "HumanDecisionRequired"],
    "ChargeAssessment": ["SearchPlanning", "Searching", "DecisionDrafting", "Withdrawn"],
    "DocumentsIdentified": ["DecisionDrafting", "ConsultationRequired", "HumanDecisionRequired"],
    "DecisionDrafting": ["HumanDecisionRequired"],
    "HumanDecisionRequired": ["DecisionApproved"],
    "DecisionApproved": ["ReleasedInFull", "ReleasedInPart", "Refused"],
}
CERTIFICATION_TYPES = ["HumanDecisionCertified", "DecisionCommunicated", "ReleaseMade", "RefusalCommunicated", "ChargeNoticeSent", "ExtensionNotified", "TransferNotified"]
STALE_SOURCES = ["external_gate", "deprecated", "unknown"]

# The driver's event types in terms of the model: event_type, core type, lifecycle state after
EVENT_TYPES = [
    ("signup", "RequestObserved", "Received"),
    ("view", "MessageObserved", "Searching"),
    ("click", "ExtensionNotified", "ExtensionApplied"),
    ("purchase", "ReleaseMade", "ReleasedInFull"),
    ("error", "RefusalCommunicated", "Refused"),
]
ORDER_STATES = [("F", "successful"), ("O", "waiting_response"), ("P", "partially_successful")]

# Message triggers: pattern (ASCII case-insensitive), event type, state, confidence, flag
TRIGGERS = [
    (r"\b(extension|extend(?:ed|ing)?|time\s*limit|further\s+working\s+days)\b", "ExtensionNotified", "ExtensionApplied", 0.58, "extension_language_detected"),
    (r"\b(transfer(?:red|ring)?|transferring|section\s+14|s\s*14)\b", "TransferNotified", "TransferredInFull", 0.54, "transfer_language_detected"),
    (r"\b(clarif(?:y|ication)|scope|refine|narrow|due\s+particularity)\b", "ClarificationRequested", "AwaitingClarification", 0.52, "clarification_language_detected"),
    (r"\b(charge|charges|charging|deposit|invoice|fee)\b", "ChargeNoticeSent", "ChargeAssessment", 0.42, "charge_language_detected"),
    (r"\b(refuse|refused|decline|declined|withhold|withheld|section\s+18|s\s*18)\b", "RefusalCommunicated", "Refused", 0.46, "refusal_language_detected"),
    (r"\b(release|released|attached|provided|enclosed|supply|supplied)\b", "ReleaseMade", "ReleasedInPart", 0.38, "release_language_detected"),
    (r"\b(ombudsman|complaint|complain|review)\b", "ComplaintObserved", "ComplaintMade", 0.44, "complaint_or_review_language_detected"),
    (r"\b(decision|decided|we have considered|our response)\b", "DecisionCommunicated", None, 0.40, "decision_language_detected"),
]

# Risk patterns: category, pattern id, pattern (case-insensitive)
RISKS = [
    ("personal_information", "email", r"\b[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}\b"),
    ("personal_information", "phone", r"(?<!\d)(?:\+?64|0)\s?\d{1,2}[\s-]?\d{3,4}[\s-]?\d{3,4}(?!\d)"),
    ("personal_information", "date_of_birth", r"\b(?:date of birth|dob|born)\b"),
    ("health_information", "nhi", r"\b[A-Z]{3}\d{4}\b"),
    ("withholding_or_redaction", "withholding_language", r"\b(withhold|withheld|refuse|refused|redact|redacted|section\s+\d+)\b"),
    ("consultation", "consultation_language", r"\b(consult|third party|commercial|confidential|privacy)\b"),
    ("ai_workload", "ai_language", r"\b(ai|llm|chatgpt|generated by|bot|automated request)\b"),
]

# Sensitive spans: type, pattern (case-insensitive), confidence
SPANS = [
    ("email_address", r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b", 0.96),
    ("phone_number", r"(?<!\d)(?:\+?64[\s-]?)?(?:0\d{1,2}[\s-]?\d{3}[\s-]?\d{3,4}|2\d[\s-]?\d{3}[\s-]?\d{3,4})(?!\d)", 0.72),
    ("possible_nhi", r"\b[A-HJ-NP-Z]{3}\d{4}\b", 0.58),
    ("possible_ird_number", r"(?<!\d)(?:\d{2,3}[-\s]?\d{3}[-\s]?\d{3})(?!\d)", 0.54),
    ("postal_address_hint", r"\b\d{1,5}\s+[A-Za-z][A-Za-z\s.'-]{2,60}\s+(?:Street|St|Road|Rd|Avenue|Ave|Drive|Dr|Lane|Ln|Place|Pl|Terrace|Tce)\b", 0.62),
]

# Reporting metrics: metric id, derivability, event dependencies
METRICS = [
    ("requests_received", "directly_observable", ["RequestObserved"]),
    ("messages_exchanged", "directly_observable", ["MessageObserved"]),
    ("extensions_notified", "candidate_only", ["ExtensionNotified"]),
    ("requests_answered", "candidate_only", ["ReleaseMade", "RefusalCommunicated"]),
    ("internal_workload", "not_derivable", []),
]


def state_map(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(STATE_MAP, "state_key string, normalised_state string, mapping_confidence double, mapping_status string")


def transitions(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(a, b) for a, bs in TRANSITIONS.items() for b in bs], "from_state string, to_state string")


def event_types(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(EVENT_TYPES, "raw_type string, core_type string, state_after string")


def metrics(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(METRICS, "metric_id string, derivability string, event_dependencies array<string>")
