"""Text operators: chunks, risk, sensitive spans, message events, HTML text."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import dims
from ..functions.ids import content_id
from ..functions.text import estimate_tokens, mask


def chunk_requests(profiles: DataFrame) -> DataFrame:
    """One templated chunk per request."""
    unknown = lambda c: F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit("Unknown"))
    text = F.concat(
        F.lit("Request "), F.col("request_id"), F.lit(". Authority: "), unknown("authority"), F.lit(". State: "), unknown("normalised_state"), F.lit(". Source state: "), unknown("source_state"), F.lit(".")
    )
    rows = profiles.select("request_id", "authority", text.alias("text"))
    return rows.select(content_id("chunk:", F.lit("request"), F.col("request_id"), F.lit(0), F.col("text")).alias("chunk_id"), "request_id", "text", F.sha2("text", 256).alias("text_sha256"), estimate_tokens(F.col("text")).alias("token_estimate"))


def chunk_events(events: DataFrame) -> DataFrame:
    """One templated chunk per event, with its scalar payload in key order."""
    payload = F.concat_ws("; ", F.concat(F.lit("assertion_status: "), F.col("assertion_status")), F.concat(F.lit("generator: "), F.col("generator")), F.concat(F.lit("source_status: "), F.col("legal_source_status")))
    text = F.concat(F.lit("Event "), F.col("event_type"), F.lit(" for request "), F.col("request_id"), F.lit(". State after: "), F.coalesce("lifecycle_state_after", F.lit("Unknown")), F.lit(". Payload: "), payload, F.lit("."))
    rows = events.select("event_id", "request_id", text.alias("text"))
    return rows.select(content_id("chunk:", F.lit("event"), F.col("event_id"), F.lit(0), F.col("text")).alias("chunk_id"), "event_id", "text", estimate_tokens(F.col("text")).alias("token_estimate"))


def assess_risk(rows: DataFrame, source_id: str, text: str) -> DataFrame:
    """Pattern counts to a score: all hits, and two more for each personal or health pattern that hits; high from 5 or with a health hit, medium with any hit."""
    # Unicode word boundaries, as for the spans below.
    counts = {pid: F.regexp_count(F.coalesce(text, F.lit("")), F.lit("(?iU)" + pattern)) for _, pid, pattern in dims.RISKS}
    rows = rows.select(F.col(source_id).cast("string").alias("source_id"), *(c.alias(p) for p, c in counts.items()))
    weight = {"personal_information": 3, "health_information": 3}
    score = sum((F.col(p) + F.when(F.col(p) > 0, weight.get(cat, 1) - 1).otherwise(0) for cat, p, _ in dims.RISKS), F.lit(0))
    health = sum((F.col(p) for cat, p, _ in dims.RISKS if cat == "health_information"), F.lit(0)) > 0
    hits = sum((F.col(p) for _, p, _ in dims.RISKS), F.lit(0))
    categories = F.array_sort(F.array_distinct(F.array_compact(F.array(*(F.when(F.col(p) > 0, cat) for cat, p, _ in dims.RISKS)))))
    level = F.when((score >= 5) | health, "high").when(hits > 0, "medium").otherwise("low")
    return rows.select("source_id", *counts, score.alias("score"), level.alias("risk_level"), (hits > 0).alias("review_required"), categories.alias("categories"))


def risk_summary(risks: DataFrame) -> DataFrame:
    """Counts by level, zeros included."""
    return risks.agg(*(F.count_if(F.col("risk_level") == x).alias(x) for x in ("low", "medium", "high")), F.count_if("review_required").alias("review_required"))


def _find_spans(batches):
    patterns = [(kind, re.compile(p, re.IGNORECASE), conf) for kind, p, conf in dims.SPANS]
    for batch in batches:
        out = []
        for key, text in zip(batch.source_id, batch.text):
            found = {(m.start(), m.end(), kind, m.group(), conf) for kind, p, conf in patterns for m in p.finditer(text)}
            out += [(key, *x) for x in sorted(found)]
        yield pd.DataFrame(out, columns=["source_id", "start", "end", "span_type", "matched", "confidence"])


def redaction_candidates(rows: DataFrame, source_id: str, text: str) -> DataFrame:
    """Candidate spans with code-point offsets, sorted by place within a record. The matched text itself never leaves: only its digest and a mask. Offsets of all matches have no built-in form, so this is a pandas function."""
    rows = rows.select(F.col(source_id).cast("string").alias("source_id"), F.coalesce(F.col(text), F.lit("")).alias("text")).filter("text <> ''")
    spans = rows.mapInPandas(_find_spans, "source_id string, start int, end int, span_type string, matched string, confidence double")
    return spans.select(
        content_id("span:", F.col("source_id"), F.col("span_type"), F.col("start"), F.col("end"), F.col("matched")).alias("candidate_id"), "source_id", "span_type", "start", "end", F.sha2("matched", 256).alias("text_sha256"), mask(F.col("matched")).alias("masked"), "confidence"
    )


def message_events(messages: DataFrame) -> DataFrame:
    """Per message a MessageObserved event and a candidate for every trigger in its body; dispositive types carry the certification requirement, none carries a certificate."""
    body = F.coalesce("body", F.lit(""))
    made = [F.struct(F.lit("MessageObserved").alias("event_type"), F.lit(None).cast("string").alias("state_after"), F.lit(1.0).alias("confidence"), F.lit(False).alias("requires_human_certification"), F.lit(None).cast("string").alias("flag"))]
    for pattern, kind, state, confidence, flag in dims.TRIGGERS:
        fields = (kind, state, confidence, kind in dims.CERTIFICATION_TYPES, flag)
        names = ("event_type", "state_after", "confidence", "requires_human_certification", "flag")
        made.append(F.when(body.rlike("(?i)" + pattern), F.struct(*((F.lit(v) if v is not None else F.lit(None).cast("string")).alias(n) for n, v in zip(names, fields)))))
    rows = messages.filter(body != "").select("request_id", "position", F.explode(F.array_compact(F.array(*made))).alias("e"))
    return rows.select("request_id", "position", "e.*")


def extract_messages(records: DataFrame, key: str, arrays: tuple[str, ...] = ("correspondence", "messages", "communications", "updates", "mail"), singles: tuple[str, ...] = ("description", "body", "text")) -> DataFrame:
    """Messages of a record from any of its message arrays (strings, or structs with id and body) and single text fields; trimmed, empty ones dropped."""
    have = dict(records.dtypes)
    parts = []

    def messages_of(name: str):
        fields = "struct" in have[name]

        def message(m, i):
            own = m["id"].cast("string") if fields else F.lit(None).cast("string")
            return F.struct(F.coalesce(own, F.concat(F.lit(f"{name}-"), i.cast("string"))).alias("message_id"), F.trim(m["body"] if fields else m).alias("body"))

        return F.transform(F.coalesce(name, F.array().cast(have[name])), message)

    parts += [messages_of(name) for name in arrays if name in have]
    for name in singles:
        if name in have:
            parts.append(F.array(F.struct(F.lit(name).alias("message_id"), F.trim(name).alias("body"))))
    rows = records.select(F.col(key), F.posexplode(F.flatten(F.array(*parts))).alias("position", "m"))
    return rows.select(key, "position", "m.*").filter(F.coalesce("body", F.lit("")) != "")


def html_text(pages: DataFrame, key: str, html: str) -> DataFrame:
    """Visible text of a page: scripts, styles, comments and tags dropped, the five basic entities decoded, white space collapsed."""
    text = F.regexp_replace(F.coalesce(html, F.lit("")), r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->", " ")
    text = F.regexp_replace(text, r"(?s)<[^>]*>", " ")
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        text = F.replace(text, F.lit(entity), F.lit(char))
    return pages.select(key, F.trim(F.regexp_replace(text, r"\s+", " ")).alias("text"))


def truncate(rows: DataFrame, key: str, text: str, limit: int = 4000) -> DataFrame:
    """A request for extraction: the first ``limit`` characters (that limit is the feature), a preview, the whole text's digest."""
    whole = F.coalesce(text, F.lit(""))
    return rows.select(key, F.length(F.substring(whole, 1, limit)).alias("chars"), F.substring(whole, 1, 160).alias("preview"), F.sha2(whole, 256).alias("text_sha256"), (F.length(whole) > limit).alias("truncated"))
