"""Source divergence, nearest neighbours and centroid clustering against brute force, and their edge cases."""

from __future__ import annotations

import collections
import hashlib
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from casework.llm import divergence, elkan, vantage

NAMES = ("id", "key", "v", "x", "n", "term", "cell", "block", "owner", "region", "shard", "bound", "wide", "rank", "value", "part", "item")


def crowded(df):
    """With extra columns whose names the operators use inside."""
    return df.withColumns({c: F.lit("x") for c in NAMES if c not in df.columns})


# 11 ------------------------------------------------------------------------------------------------
def brute_divergence(docs, least=10, top=10):
    words = lambda t: re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    df, counts = collections.defaultdict(collections.Counter), collections.defaultdict(collections.Counter)
    for text, lang, source in docs:
        lang, source = lang or "", source or ""
        df[lang].update(set(words(text)))
        counts[lang, source].update(words(text))
    out = set()
    for lang in df:
        kept = [t for t, n in df[lang].items() if n >= least]
        groups = {s: counts[l, s] for l, s in counts if l == lang}
        p = {}
        for s, c in [*groups.items(), (None, sum(groups.values(), collections.Counter()))]:
            n = sum(c[t] for t in kept) + 2 * len(kept)
            p[s] = {t: 1 + 10**9 * (c[t] + 2) // n for t in kept}
        f = lambda a, b: (a - b) ** 2 // (a + b)
        for s in groups:
            pairs = sorted((-sum(f(p[s][t], p[o][t]) for t in kept), o.encode(), o) for o in groups if o != s)
            terms = sorted((-f(p[s][t], p[None][t]), t.encode(), t) for t in kept if groups[s][t] and p[s][t] > p[None][t])
            out |= {(lang, s, part, item, -v, i) for part, rows in (("pair", pairs), ("term", terms[:top])) for i, (v, _, item) in enumerate(rows, 1)}
    return out


def divergent_docs():
    rnd = random.Random(11)
    vocabulary = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(300)] + ["Éa", "ß", "日本", "Ünder"]
    docs = [(" ".join(rnd.choice(vocabulary[s * 7 : s * 7 + 120]) + rnd.choice([" ", "1", "-"]) for _ in range(60)), "en", f"s{s}") for s in range(23) for _ in range(8)]
    docs += [("the same Éa words 日本", "de", f"é{s}") for s in range(3) for _ in range(9)] * 2
    return docs + [(None, None, None), ("", "en", "silent"), ("word " * 200_000, "en", "s1"), ("rare", "xx", "a"), ("other", "xx", None), (None, "yy", "b")]


@pytest.mark.parametrize("block, cell", [(1 << 15, 4), (16, 1), (64, 100)])
def test_divergence_equals_brute_force(spark, block, cell):
    docs = divergent_docs()
    table = crowded(spark.createDataFrame(docs, "text string, lang string, source string"))
    got = [tuple(r) for r in divergence.source_divergence(table, block_terms=block, cell_sources=cell).select("lang", "source", "part", "item", "value", "rank").collect()]
    assert len(got) == len(set(got)) and set(got) == brute_divergence(docs)


def test_divergence_of_nothing(spark):
    empty = spark.createDataFrame([], "text string, lang string, source string")
    assert divergence.source_divergence(empty).count() == 0
    assert divergence.source_divergence(empty).columns == ["lang", "source", "part", "item", "value", "rank"]


def test_tournament_meets_everyone_once(spark):
    for cells in (2, 4, 6, 10):
        rows = spark.range(cells).select(F.col("id").cast("int").alias("cell")).crossJoin(spark.range(1, cells).select(F.col("id").cast("int").alias("turn")))
        met = collections.Counter()
        for r in rows.select("cell", "turn", divergence.partner(F.col("cell"), F.lit(cells), F.col("turn")).alias("other")).collect():
            assert r.cell != r.other
            met[frozenset((r.cell, r.other))] += 1
        assert len(met) == cells * (cells - 1) // 2 and set(met.values()) == {2}


def test_shares_and_vectors_are_exact():
    rnd = random.Random(5)
    for _ in range(300):
        total = rnd.randint(1, 10 ** rnd.randint(1, 14))
        count = rnd.randint(0, min(total, 9 * 10**13))
        assert int(divergence.share(count, total)) == 1 + 10**9 * count // total
    for n in (1, 2, 1000):
        slots, counts = np.array(sorted(rnd.sample(range(100_000), n))), np.array([rnd.choice([1, 300, 70_000, 1 << 40]) for _ in range(n)])
        back = divergence.unpack(divergence.pack(slots, counts))
        assert (back[0] == slots).all() and (back[1] == counts).all()


# 12 ------------------------------------------------------------------------------------------------
def sound(v):
    return v and all(x is not None and math.isfinite(x) for x in v) and any(v)


def brute_nearest(rows, every=100, k=10):
    rows = [(i, np.array(v, np.float32).astype(float)) for i, v in rows if sound(v)]
    out = collections.Counter()
    for at, (q, v) in enumerate(rows):
        if q is not None and q % every == 0:
            near = sorted((float(np.sqrt(((v - w) ** 2).sum())), math.inf if i is None else i) for j, (i, w) in enumerate(rows) if j != at and len(w) == len(v))
            out.update((q, r, None if i == math.inf else i, round(d, 9)) for r, (d, i) in enumerate(near[:k], 1))
    return out


def some_vectors(n=700, size=8):
    rnd = np.random.default_rng(12)
    x = rnd.normal(size=(n, size)).astype(np.float32)
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    rows += [(10_000 + i, [1.0] * size) for i in range(200)] + [(10_000, [1.0] * size)] * 2  # a hot vector, repeated rows
    rows += [(20_000, None), (20_100, []), (20_200, [0.0] * size), (20_300, [math.nan] + [1.0] * (size - 1)), (20_400, [None] + [1.0] * (size - 1)), (20_500, [math.inf] + [1.0] * (size - 1))]
    rows += [(None, [1.0] * size), (30_000, [1.0, 2.0]), (30_001, [1.0, 3.0]), (40_000, [5.0]), (50_000, [1e38] * size), (50_001, [-3e38] * size)]
    return rows


@pytest.mark.parametrize("how", [{}, {"shard_rows": 40, "leaf_rows": 4}, {"shard_rows": 100, "leaf_rows": 8, "sample_rows": 200}])
def test_factor_one_is_exact(spark, how, monkeypatch):
    if how:
        monkeypatch.setattr(vantage, "REGION_SAMPLE", 8)
        monkeypatch.setattr(vantage, "PASS_VALUES", 50)
    rows = some_vectors()
    table = crowded(spark.createDataFrame(rows, "vec_id long, embedding array<float>"))
    got = collections.Counter((r.query_id, r["rank"], r.vec_id, round(r.score, 9)) for r in vantage.nearest_neighbours(table, factor=1.0, **how).collect())
    assert got == brute_nearest(rows)


def test_recall_of_the_query(spark, data):
    """With the factor that the query uses, at least nine of ten neighbours are found, in few shards and in many."""
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{data}/embeddings.parquet").collect()]
    wanted = brute_nearest(rows)
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    for how in ({}, {"shard_rows": 60, "leaf_rows": 8}):
        got = {(r.query_id, r.vec_id) for r in vantage.nearest_neighbours(table, **how).collect()}
        assert len(got & {(q, i) for q, _, i, _ in wanted}) >= 0.9 * len(wanted)


def test_search_of_nothing(spark):
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert vantage.nearest_neighbours(empty).collect() == []
    alone = spark.createDataFrame([(100, [1.0, 2.0])], "vec_id long, embedding array<float>")
    assert vantage.nearest_neighbours(alone).collect() == []
    assert vantage.nearest_neighbours(alone.withColumn("vec_id", F.lit(7))).collect() == []


def test_pruning_leaves_out_what_is_far(spark):
    """In clusters far from each other a query visits its own tree's corner only."""
    rnd = np.random.default_rng(3)
    x = np.concatenate([rnd.normal(c, 0.1, (500, 6)) for c in (0, 50, 100, 150)])
    tree, looked = vantage.Tree(x, 16), 0
    shard = vantage.Shard(x[tree.order], tree.order, tree.order, tree.nodes, tree.ranges)
    near = shard._near

    def counting(start, end, v, own, q, found):
        nonlocal looked
        looked += (end - start) * len(q)
        near(start, end, v, own, q, found)

    shard._near = counting
    shard.search(x[::100], np.arange(0, 2000, 100), np.full(20, np.inf), 5, 1.0)
    assert looked < 0.4 * 20 * len(x)


# 13 ------------------------------------------------------------------------------------------------
def brute_clusters(rows, k=16, rounds=3, size=64):
    kept = [(i, [math.floor(64 * x) for x in v]) for i, v in rows if v is not None and len(v) == size and all(x is not None and math.isfinite(x) for x in v)]
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    centroids = [v for _, v in sorted((x for x in kept if x[0] is not None), key=lambda x: (sha(f"1:{x[0]}"), x[1]))[:k]]
    dist = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    for i in range(rounds + 1):
        owner = [min(range(len(centroids)), key=lambda j: (dist(v, centroids[j]), j)) for _, v in kept]
        if i == rounds:
            break
        for j in range(len(centroids)):
            mine = [v for (_, v), o in zip(kept, owner) if o == j]
            if mine:
                centroids[j] = [sum(c) // len(mine) for c in zip(*mine)]
    d = [dist(v, centroids[o]) for (_, v), o in zip(kept, owner)]
    inertia = collections.Counter()
    for o, x in zip(owner, d):
        inertia[o] += x
    told = lambda n: min(n, 2**63 - 1)
    return collections.Counter((i, o, told(x), told(inertia[o]), told(sum(d)), sha(",".join(map(str, centroids[o])))) for (i, _), o, x in zip(kept, owner, d))


def clusters(df, **how):
    found = elkan.cluster(df, **how).collect()
    return collections.Counter((r.vec_id, r.cluster, r.distance, r.cluster_inertia, r.inertia, r.centroid_sha256) for r in found), sum(r.computed for r in found)


def test_clusters_equal_brute_force(spark, data):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{data}/embeddings.parquet").collect()]
    odd = [(None, [0.5] * 64), (7, None), (8, []), (9, [1.0] * 63), (10, [None] + [1.0] * 63), (11, [math.nan] * 64), (12, [math.inf] * 64), (3, rows[3][1]), (3, rows[3][1])] + [(900 + i, [0.25] * 64) for i in range(150)]
    table = crowded(spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>")).repartition(5)
    got, computed = clusters(table)
    assert got == brute_clusters(rows + odd)
    assert computed < 4 * 16 * sum(got.values())


def test_ties_and_few_vectors(spark):
    grid = [(i, [float(i % 3), float(i // 3 % 3)]) for i in range(60)]
    for k, rows in ((16, grid), (4, grid), (3, grid[:2]), (1, grid), (5, [(i, [1.0, 1.0]) for i in range(20)])):
        assert clusters(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), size=2, centroids=k)[0] == brute_clusters(rows, k, size=2)
    assert elkan.cluster(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0
    assert elkan.cluster(spark.createDataFrame([(None, [1.0] * 64)], "vec_id long, embedding array<float>")).count() == 0


def test_huge_components(spark):
    rnd = random.Random(2)
    rows = [(i, [rnd.choice([1.0, -2.5, 3e6, -1e7, 1e20, 3e38, -3e38]) * rnd.random() for _ in range(3)]) for i in range(60)]
    rows = [(i, np.array(v, np.float32).tolist()) for i, v in rows]
    assert clusters(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), size=3, centroids=5)[0] == brute_clusters(rows, 5, size=3)


def test_bounds_save_distances(spark):
    rnd = np.random.default_rng(1)
    x = np.concatenate([rnd.normal(c, 0.05, (60, 64)) for c in np.linspace(-3, 3, 6)])
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    got, computed = clusters(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    assert got == brute_clusters(rows) and computed < 0.4 * 4 * 16 * len(rows)
