"""The pipeline, each stage against a plain version in Python on its own input."""

from __future__ import annotations

import re

import corpus_pipeline
from casework.llm.common import Scratch

from .test_operators import brute_components


def test_stages(spark, data):
    scratch = Scratch(spark, "test")
    docs = spark.read.parquet(f"{data}/documents.parquet")
    bench = [r.text for r in spark.read.parquet(f"{data}/benchmark.parquet").collect()]
    norm = lambda t: " ".join(re.findall(r"[^\W_]+", (t or "").lower()))
    seen = []
    for name, stage in corpus_pipeline.STAGES:
        before = {r.doc_id: r.text for r in docs.collect()} if "text" in docs.columns else {}
        docs = scratch.table(stage(spark, docs, data), name.replace(" ", "-"))
        kept = {r.doc_id for r in docs.select("doc_id").collect()}
        seen.append(len(kept))
        assert kept <= set(before)
        if name == "exact dedup":
            squeezed = lambda t: re.sub(r"[\x20\x09-\x0D]", "", t or "")
            best: dict[str, tuple] = {}
            for i, t in before.items():
                best[squeezed(t)] = min(best.get(squeezed(t), (1, 0)), (-len(t or ""), i))
            assert kept == {i for _, i in best.values()}
        if name == "n-gram Jaccard join":
            assert kept == {i for i, _, c in brute_components(before.items(), 5, 80) if i == c}
        if name == "benchmark decontamination":
            assert not any(norm(b) in norm(before[i]) for i in kept for b in bench)
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == list(corpus_pipeline.COLUMNS)
    assert seen == sorted(seen, reverse=True) and seen[-1] > 0 and {"n_tokens", "ids"} <= set(docs.columns)
    assert corpus_pipeline.run(spark, data).count() == seen[-1]


def test_null_and_repeated_ids(spark, data, tmp_path):
    """Rows without an id stay, as nothing names them; rows that share one go together; null and empty texts and empty tables pass."""
    real = spark.read.parquet(f"{data}/documents.parquet").limit(60)
    odd = [(None, "one text of its own, twice without an id", "en", "src0", 1)] * 2 + [(7001, "a repeated row", None, None, None)] * 2 + [(7002, None, None, None, None), (7003, "", "en", "src0", 0)]
    docs = real.unionByName(spark.createDataFrame(odd, real.schema))
    for n, table in enumerate((docs, docs.limit(0))):
        path = f"{tmp_path}/{n}"
        table.write.parquet(f"{path}/documents.parquet")
        for name in ("labels", "benchmark"):
            spark.read.parquet(f"{data}/{name}.parquet").write.parquet(f"{path}/{name}.parquet")
        rows = corpus_pipeline.exact(spark, spark.read.parquet(f"{path}/documents.parquet"), path)
        for stage in (corpus_pipeline.near, corpus_pipeline.decontaminate):
            rows = Scratch(spark, "odd").table(stage(spark, rows, path), "rows")
        ids = [r.doc_id for r in rows.select("doc_id").collect()]
        if n == 0:
            assert ids.count(None) == 2 and ids.count(7001) == 2 and ids.count(7002) + ids.count(7003) == 1
        else:
            assert not ids
        assert corpus_pipeline.run(spark, path).count() <= len(ids)
