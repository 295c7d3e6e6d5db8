"""Queries that SQL can't express, against the same work in plain Python over the same tables."""

from __future__ import annotations

import collections
import hashlib
import math
import random
import re

import pytest

from casework import dims
from casework.plans import audits, packets, packs, process, texts

QUERIES, SQL = ({**process.QUERIES, **texts.QUERIES, **packets.QUERIES, **audits.QUERIES, **packs.QUERIES}, {**process.SQL, **texts.SQL, **packets.SQL, **audits.SQL, **packs.SQL})
WITHOUT_SQL = {"risk_assessment", "risk_summary", "sensitive_spans", "review_queue", "page_text", "blended_search", "hash_embeddings", "bootstrap_interval", "text_buckets", "agreement_intervals", "agreement_by_cluster", "generator_sample"}


def test_these_are_all():
    assert set(QUERIES) - set(SQL) == WITHOUT_SQL


def table(spark, data, name):
    return spark.read.parquet(f"{data}/{name}.parquet").collect()


def run(spark, data, name):
    return QUERIES[name](spark, data).collect()


def chunks(spark, data):
    sha = lambda *x: hashlib.sha256("\x00".join(x).encode()).hexdigest()[:24]
    return {"chunk:" + sha("document", str(r.doc_id), "0", r.text): r.text for r in table(spark, data, "documents") if r.text is not None}


def documents(spark, data):
    return {str(r.doc_id): r.text or "" for r in table(spark, data, "documents")}


def risks(text):
    counts = {p: len(re.findall(x, text, re.I)) for _, p, x in dims.RISKS}
    by = collections.Counter()
    for category, p, _ in dims.RISKS:
        by[category] += counts[p]
    twice = sum(2 for category, p, _ in dims.RISKS if counts[p] and category in ("personal_information", "health_information"))
    score = sum(counts.values()) + twice
    level = "high" if score >= 5 or by["health_information"] else "medium" if score else "low"
    return counts, score, level, sorted(c for c in by if by[c])


def test_risks(spark, data):
    want = {k: risks(v) for k, v in documents(spark, data).items()}
    got = run(spark, data, "risk_assessment")
    assert got and len({r[0] for r in got}) == len(got)
    for r in got:
        counts, score, level, categories = want[r.source_id]
        d = r.asDict()
        assert (d["score"], d["risk_level"], d["review_required"]) == (score, level, score > 0)
        said = d["categories"]
        assert (said.split(",") if isinstance(said, str) and said else list(said or [])) == categories
    levels = collections.Counter(w[2] for w in want.values())
    summary = run(spark, data, "risk_summary")[0]
    assert [summary[x] for x in ("low", "medium", "high")] == [levels[x] for x in ("low", "medium", "high")] and summary.review_required == sum(w[1] > 0 for w in want.values())


def test_sensitive_spans(spark, data):
    want = collections.Counter()
    for k, text in documents(spark, data).items():
        want.update({(k, m.start(), m.end(), kind) for kind, p, _ in dims.SPANS for m in re.finditer(p, text, re.I)})
    got = collections.Counter((r.source_id, r.start, r.end, r.span_type) for r in run(spark, data, "sensitive_spans"))
    assert got == want and got


def test_review_queue_has_one_task_for_each_reason(spark, data):
    got = run(spark, data, "review_queue")
    ids = [r.task_id for r in got]
    assert got and len(ids) == len(set(ids)) and {r.priority for r in got} <= {"high", "medium", "low"}
    of = documents(spark, data)
    wanted = {k for k, t in of.items() if risks(t)[1] > 0}
    assert {r.source_id for r in got if r.task_type == "risk_review"} == wanted


def test_page_text(spark, data):
    got = {r.page_id: (r.chars, r.text_sha256) for r in run(spark, data, "page_text")}
    for r in table(spark, data, "pages"):
        text = re.sub(r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->", " ", r.html or "")
        text = re.sub(r"(?s)<[^>]*>", " ", text)
        for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
            text = text.replace(entity, char)
        text = re.sub(r"[ \t\n\x0b\f\r]+", " ", text).strip(" ")
        assert got.pop(r.page_id) == (len(text), hashlib.sha256(text.encode()).hexdigest())
    assert not got


def words(text):
    return re.findall(r"\w+", text.lower())


def feature_vector(text, n):
    v = [0.0] * n
    for w in words(text):
        h = hashlib.blake2b(w.encode(), digest_size=16).digest()
        v[int.from_bytes(h[:8], "big") % n] += 1.0 if h[8] & 1 else -1.0
    size = math.sqrt(sum(x * x for x in v))
    return [x / size for x in v] if size else v


def test_hash_embeddings(spark, data):
    of = chunks(spark, data)
    for r in run(spark, data, "hash_embeddings"):
        assert r.dimensions == 64 and r.norm == pytest.approx(1.0 if any(feature_vector(of[r.chunk_id], 64)) else 0.0, abs=1e-5)


def test_blended_search(spark, data):
    query = "the of and with information request"
    of = {k: t for k, t in chunks(spark, data).items() if t}
    counts = {k: collections.Counter(words(t)) for k, t in of.items()}
    size = {k: sum(c.values()) for k, c in counts.items()}
    average = sum(size.values()) / len(of)
    df = {w: sum(w in c for c in counts.values()) for w in words(query)}
    idf = {w: math.log1p((len(of) - n + 0.5) / (n + 0.5)) for w, n in df.items()}
    lexical = {k: sum(idf[w] * c[w] * 2.5 / (c[w] + 1.5 * (0.25 + 0.75 * max(size[k], 1) / average)) for w in set(words(query)) if c[w]) for k, c in counts.items()}
    q = feature_vector(query, 128)
    score = {k: 0.7 * lexical[k] + 0.3 * (sum(a * b for a, b in zip(q, feature_vector(t, 128))) + 1) / 2 for k, t in of.items()}
    best = sorted(score, key=lambda k: (-round(score[k], 10), k))[:20]
    got = sorted(run(spark, data, "blended_search"), key=lambda r: r["rank"])
    assert [r.chunk_id for r in got] == best and all(abs(r.score - score[r.chunk_id]) < 1e-6 for r in got)


def test_bootstrap_interval(spark, data):
    rows = {str(r.doc_id): r.quality == r.toxic for r in table(spark, data, "labels")}
    names, rng = sorted(rows), random.Random(20260721)
    rates = sorted(sum(rows[names[rng.randrange(len(names))]] for _ in names) / len(names) for _ in range(200))
    r = run(spark, data, "bootstrap_interval")[0]
    assert (r.low, r.high, r.n) == (pytest.approx(rates[math.floor(0.025 * 199)]), pytest.approx(rates[math.ceil(0.975 * 199)]), 200)


def test_text_buckets(spark, data):
    got = {r.id: r for r in run(spark, data, "text_buckets")}
    for r in table(spark, data, "customer"):
        h = 0xCBF29CE484222325
        for b in ("é" + r.c_name)[:6].encode():
            h = (h ^ b) * 0x100000001B3 % (1 << 64)
        assert (got[r.c_custkey].hash, got[r.c_custkey].bucket) == (str(h), h % 97)


def agreement(spark, data, replicates, seed, cluster=None):
    rows = []
    for r in table(spark, data, "labels"):
        k = r.doc_id
        rows.append((str(k) if cluster is None else cluster[k], str(r.quality) if k % 6 else None, str(1 - r.toxic) if k % 9 else None, k % 6 == k % 9))
    return rows


@pytest.mark.parametrize("name, replicates, seed, rule", [("agreement_intervals", 200, 20260721, "registered"), ("agreement_by_cluster", 300, 7, "legacy")])
def test_agreement(spark, data, name, replicates, seed, rule):
    from .test_audits import brute_reliability

    cluster = {r.doc_id: f"{r.source}/{r.lang}" for r in table(spark, data, "documents")} if rule == "legacy" else None
    want = brute_reliability(agreement(spark, data, replicates, seed, cluster), seed, replicates, rule)
    got = {r.measure: (r.estimate, r.low, r.high, r.valid) for r in run(spark, data, name)}
    for m in want:
        assert got[m] == pytest.approx(want[m], abs=2e-9), m


def test_generator_sample(spark, data):
    units = sorted((hashlib.sha256((r.text or "").encode()).hexdigest(), r.doc_id) for r in table(spark, data, "documents"))
    want = {units[i][1] for i in random.Random(20260721).sample(range(len(units)), 100)}
    assert {r.doc_id for r in run(spark, data, "generator_sample")} == want
