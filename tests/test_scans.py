"""Order statistics by ranges, hash chains by a scan, and lexical search with bounds, against plain Python."""

from __future__ import annotations

import hashlib
import math
import random

import numpy as np
import pytest
import pyarrow as pa
from pyspark.sql import functions as F

from casework.operators import ledger, measures, retrieval


# Order statistics ------------------------------------------------------------------------------------
@pytest.mark.parametrize("kind", ["normal", "ties", "wide", "tiny", "odd"])
def test_every_rank(spark, kind):
    rnd = random.Random(4)
    make = {
        "normal": lambda: rnd.gauss(0, 1), "ties": lambda: float(rnd.randrange(4)), "wide": lambda: rnd.choice([-1, 1]) * 10.0 ** rnd.randint(-300, 308) * rnd.random(), "tiny": lambda: rnd.randrange(5) * 5e-324, "odd": lambda: rnd.choice([math.inf, -math.inf, 0.0, -1.5, 1e308, -1.7e308, math.nan, None]),
    }[kind]
    values = [make() for _ in range(300)]
    table = spark.createDataFrame([(v,) for v in values], "v double")
    some = [v for v in values if v is not None]
    ordered = sorted(v for v in some if not math.isnan(v)) + [v for v in some if math.isnan(v)]
    for rank in sorted({0, 1, 7, len(some) // 2, len(some) - 2, len(some) - 1}):
        got = measures.nth_value(table, "v", rank)
        assert got == ordered[rank] or math.isnan(got) and math.isnan(ordered[rank])
    assert measures.nth_value(table, "v", len(some)) is None and measures.nth_value(table, "v", -1) is None


def test_quantiles_equal_numpy(spark):
    rnd = np.random.default_rng(2)
    values = rnd.exponential(size=500)
    table = spark.createDataFrame([(float(v),) for v in values] + [(None,)], "v double")
    for p in (0.0, 0.1, 0.5, 0.977, 1.0):
        assert math.isclose(measures.quantile(table, "v", p).first().quantile, np.quantile(values, p))
    assert measures.quantile(table.limit(0), "v", 0.5).first().quantile is None


# Chains ----------------------------------------------------------------------------------------------
def test_a_long_stream_is_chained_in_batches(spark):
    n = 200_000
    rows = spark.range(n).select(F.lit("one").alias("s"), "id", F.sha2(F.col("id").cast("string"), 256).alias("h")).repartition(7)
    other = spark.createDataFrame([("two", 1, None), ("two", 2, "x"), (None, 3, "y")], "s string, id long, h string")
    built = ledger.build_ledger(rows.unionByName(other), "s", "id", "h")
    previous = ledger.ZERO_HASH
    for i in range(n):
        previous = hashlib.sha256(f"{previous}\n{hashlib.sha256(str(i).encode()).hexdigest()}".encode()).hexdigest()
    last = built.filter(f"s = 'one' AND sequence = {n - 1}").first()
    assert last.ledger_sha256 == previous and last.id == n - 1
    two = built.filter("s = 'two'").orderBy("sequence").collect()
    first = hashlib.sha256(ledger.ZERO_HASH.encode()).hexdigest()
    assert [(r.sequence, r.previous_sha256, r.ledger_sha256) for r in two] == [(0, ledger.ZERO_HASH, first), (1, first, hashlib.sha256(f"{first}\nx".encode()).hexdigest())]
    assert built.filter("s IS NULL").first().previous_sha256 == ledger.ZERO_HASH and built.count() == n + 3
    assert ledger.build_ledger(rows.limit(0), "s", "id", "h").count() == 0


def test_roots_of_groups(spark):
    rows = spark.createDataFrame([("a", "2"), ("a", "1"), ("b", None), (None, "3"), ("a", "1")] + [("c", str(i)) for i in range(30_000)], "g string, h string").repartition(5)
    got = {r.g: (r.root_sha256, r.entries) for r in ledger.root_digest(rows, "g", "h").collect()}
    sha = lambda *xs: hashlib.sha256("".join(x + "\n" for x in xs).encode()).hexdigest()
    assert got == {"a": (sha("1", "1", "2"), 3), "b": (sha(), 1), None: (sha("3"), 1), "c": (sha(*sorted(str(i) for i in range(30_000))), 30_000)}
    assert ledger.root_digest(rows.limit(0), "g", "h").count() == 0


# Search ----------------------------------------------------------------------------------------------
def corpus(n=600):
    rnd = random.Random(7)
    words = [f"w{i}" for i in range(200)]
    text = lambda size: " ".join(words[min(199, int(rnd.expovariate(0.03)))] for _ in range(size))
    rows = [(f"c{i:04}", text(rnd.randint(1, 60))) for i in range(n)]
    rows += [(f"d{i:04}", "w1 w150 w150 w199") for i in range(40)] + [("e", ""), ("f", None), ("g", "!!"), ("h", "zzz " * 100_000)]
    return rows, [("q0", "w150 w199"), ("q1", text(30)), ("q2", "w0"), ("q3", "nothing here"), ("q4", ""), ("q5", "w3 w3 w180 w0 w1 w2"), ("q6", None), ("q7", "Zzz w5")]


@pytest.mark.parametrize("batch, terms", [("10000", 500_000), ("16", 3)])
def test_best_chunks_equal_scoring_all(spark, monkeypatch, batch, terms):
    monkeypatch.setattr(retrieval, "QUERY_TERMS", terms)
    rows, asked = corpus()
    chunks, queries = spark.createDataFrame(rows, "chunk_id string, text string").repartition(3), spark.createDataFrame(asked, "query_id string, text string")
    every = retrieval.bm25(chunks, queries)
    want = retrieval.top_k(every.withColumn("lexical_score", F.round("lexical_score", 6)), 10, "query_id", "lexical_score", "chunk_id")
    want = {(r.query_id, r.chunk_id, r["rank"], r.lexical_score, len(r.matched_terms)) for r in want.collect()}
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        got = [(r.query_id, r.chunk_id, r["rank"], r.lexical_score, r.terms) for r in retrieval.best_chunks(chunks, queries, 10).collect()]
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(got) == len(set(got)) and {g[:3] + g[4:] for g in got} == {w[:3] + w[4:] for w in want}
    assert all(abs(g[3] - w[3]) < 2e-6 for g, w in zip(sorted(got), sorted(want)))
    assert retrieval.best_chunks(chunks, queries.limit(0), 10).count() == 0 and retrieval.best_chunks(chunks.limit(0), queries, 10).count() == 0


def test_bounds_leave_most_chunks_unscored():
    """A frequent term alone can't reach what a rare one gives, so only the rare one's chunks are scored."""
    lengths = np.full(1000, 10)
    counts = np.array([2 if i < 5 else 1 for i in range(1000)])
    terms = np.concatenate([[0, 1] if i < 5 else [0] for i in range(1000)])
    idf = np.log1p((1000 - np.array([1000, 5]) + 0.5) / (np.array([1000, 5]) + 0.5))
    block = retrieval.Postings(lengths, counts, terms, np.ones(len(terms)), idf, 10.0)
    found, score, matched = block.best(np.array([0, 1]), 1.0)
    assert found.tolist() == [0, 1, 2, 3, 4] and (matched == 2).all() and (score > 1).all()
    assert len(block.best(np.array([0]), 1.0)[0]) == 0 and len(block.best(np.array([0]), 0.0)[0]) == 1000


def test_feature_rows_in_slices(spark, monkeypatch):
    """Vectors and searches don't depend on how many tokens a task takes at once."""
    lists = [["a", "b", "a"], [], None, ["x"] * 7, ["c", "d"]]
    rows = pa.array(lists, pa.list_(pa.string()))
    assert retrieval.token_slices(rows, 4)[-1][1] == 5 and len(retrieval.token_slices(rows, 4)) > 1
    whole = retrieval.feature_rows(rows, 8)
    assert all((whole[a:b] == retrieval.feature_rows(rows.slice(a, b - a), 8)).all() for a, b in retrieval.token_slices(rows, 4))
    chunks = spark.createDataFrame([(f"c{i}", f"red w{i % 7} blue " * (i % 5 + 1)) for i in range(60)], "chunk_id string, text string").coalesce(1)
    queries = spark.createDataFrame([(1, "red w3"), (2, "blue w5 w6")], "query_id int, text string")
    run = lambda: ([tuple(r) for r in retrieval.search_chunks(chunks, "red w3", 9).collect()], sorted(tuple(r) for r in retrieval.best_chunks(chunks, queries, 5).collect()))
    want = run()
    monkeypatch.setattr(retrieval, "SLICE_TOKENS", 20)
    assert run() == want
