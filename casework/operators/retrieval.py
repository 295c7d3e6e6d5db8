"""Lexical and vector retrieval over chunks."""

from __future__ import annotations

import hashlib
import math
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scores import cosine, dot
from ..functions.text import tokens
from ..session import written

K1, B = 1.5, 0.75


def bm25(chunks: DataFrame, queries: DataFrame, key: str = "chunk_id", text: str = "text") -> DataFrame:
    """Score of every chunk that shares a term with a query (``query_id, text``): repeated query terms count once. Only terms of queries are shuffled, as the queries' term list is joined to the chunks' tokens before any count."""
    listed = chunks.filter(F.col(text) != "").select(F.col(key), tokens(F.col(text)).alias("tokens")).withColumn("length", F.size("tokens"))
    stats = listed.agg(F.count("*").alias("docs"), F.avg("length").alias("avg_length"))
    terms = queries.select("query_id", F.explode(F.array_distinct(tokens(F.col("text")))).alias("term"))
    wanted = terms.select("term").distinct()
    tf = listed.select(key, "length", F.explode("tokens").alias("term")).join(wanted, "term", "left_semi").groupBy("term", key, "length").agg(F.count("*").alias("tf"))
    df = tf.groupBy("term").agg(F.count("*").alias("df"))
    scored = tf.join(df, "term").crossJoin(F.broadcast(stats))  # one row
    idf = F.log1p((F.col("docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * (F.col("tf") * (K1 + 1)) / (F.col("tf") + K1 * (1 - B + B * F.greatest(F.col("length"), F.lit(1)) / F.col("avg_length")))
    return scored.withColumn("part", part).join(terms, "term").groupBy("query_id", key).agg(F.sum("part").alias("lexical_score"), F.array_sort(F.collect_set("term")).alias("matched_terms"))


#: Terms of the queries that are searched together.
QUERY_TERMS = 500_000


class Postings:
    """A block of chunks as lists by term: which chunks have it, what it adds to their scores, and the most that it adds to any."""

    def __init__(self, lengths: np.ndarray, counts: np.ndarray, terms: np.ndarray, tf: np.ndarray, idf: np.ndarray, average: float):
        chunk, self.size = np.repeat(np.arange(len(lengths)), counts), len(lengths)
        norm = K1 * (1 - B + B * np.maximum(lengths, 1) / average)
        impact = idf[terms] * tf * (K1 + 1) / (tf + norm[chunk])
        order = np.lexsort((chunk, terms))
        self.chunk, self.impact = chunk[order], impact[order]
        self.begin = np.searchsorted(terms[order], np.arange(len(idf) + 1))
        self.most = np.zeros(len(idf))
        np.maximum.at(self.most, terms, impact)

    def best(self, query: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Chunks that may reach the score ``least``, their scores, and how many terms they have.

        The terms that add least are set aside as long as all of them together stay below
        ``least``: a chunk that reaches it has one of the others. Only such chunks are scored.
        """
        query = query[self.begin[query] < self.begin[query + 1]]
        query = query[np.argsort(self.most[query], kind="stable")]
        if not len(query) or self.most[query].sum() < least:
            return np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64)
        aside = int(np.searchsorted(np.cumsum(self.most[query]), least)) if least > 0 else 0
        part = lambda t: slice(self.begin[t], self.begin[t + 1])
        found = np.unique(np.concatenate([self.chunk[part(t)] for t in query[aside:]]))
        score, matched = np.zeros(len(found)), np.zeros(len(found), np.int64)
        for t in query:
            there = self.chunk[part(t)]
            at = np.searchsorted(there, found)
            at[at == len(there)] = 0
            has = there[at] == found
            score[has] += self.impact[part(t)][at[has]]
            matched += has
        return found, score, matched


def best_chunks(chunks: DataFrame, queries: DataFrame, k: int, key: str = "chunk_id", text: str = "text", digits: int = 6) -> DataFrame:
    """The ``k`` best chunks of every query by :func:`bm25`: ``query_id, key, rank, lexical_score, terms`` (how many of the query's it has).

    Ranked by the score rounded to ``digits``, then ``key``. A chunk without a common term is
    none of them. Chunks are searched where they lie, block by block; a block's bounds rule
    most of its chunks out before they are scored, and a task gives at most ``k`` rows for a
    query. Queries go to the tasks in groups of at most ``QUERY_TERMS`` terms.
    """
    spark = chunks.sparkSession
    listed = chunks.filter(F.col(text) != "").select(F.col(key).alias("key"), tokens(F.col(text)).alias("tokens"))
    kind = dict(listed.dtypes)["key"]
    terms = written(queries.select("query_id", F.array_distinct(tokens(F.col("text"))).alias("terms")).filter(F.size("terms") > 0), "queries")
    groups = math.ceil((terms.agg(F.sum(F.size("terms"))).first()[0] or 0) / QUERY_TERMS)
    found = []
    for group in range(groups):
        some = terms.filter(F.pmod(F.xxhash64("query_id", "terms"), F.lit(groups)) == group).toArrow().sort_by("query_id")
        wanted = pa.array(sorted(set(some.column("terms").combine_chunks().flatten().to_pylist())), pa.string())
        asked = [pc.index_in(x.values, value_set=wanted).to_numpy() for x in some.column("terms")]
        ids = some.column("query_id").combine_chunks()

        def count(batches, wanted=wanted):
            for batch in (b.slice(i, j - i) for b in batches for i, j in token_slices(b.column("tokens"))):
                lists = batch.column("tokens")
                lengths = pc.list_value_length(lists).to_numpy()
                at = pc.index_in(lists.flatten(), value_set=wanted)
                chunk, term = np.repeat(np.arange(len(lengths)), lengths), at.fill_null(-1).to_numpy()
                pair, tf = np.unique(chunk[term >= 0].astype(np.int64) * len(wanted) + term[term >= 0], return_counts=True)
                offsets = pa.array(np.searchsorted(pair, np.arange(len(lengths) + 1) * len(wanted)), pa.int32())
                part = lambda x: pa.ListArray.from_arrays(offsets, pa.array(x, pa.int32()))
                yield pa.record_batch({"key": batch.column("key"), "length": pa.array(lengths, pa.int32()), "terms": part(pair % len(wanted)), "tf": part(tf)})

        counted = written(listed.mapInArrow(count, f"key {kind}, length int, terms array<int>, tf array<int>"), "postings")
        total = counted.agg(F.count("*").alias("n"), F.avg("length").alias("average")).first()
        held = np.zeros(len(wanted))
        for r in counted.select(F.explode("terms").alias("t")).groupBy("t").count().collect():  # a row for each term of the queries
            held[r.t] = r["count"]
        idf = np.log1p((total.n - held + 0.5) / (held + 0.5))

        def search(batches, asked=asked, ids=ids, idf=idf, average=total.average):
            best: list[list[tuple]] = [[] for _ in asked]  # of each query (-rounded score, key, terms), in order
            for batch in (b.slice(i, j - i) for b in batches for i, j in token_slices(b.column("terms"))):
                lists = batch.column("terms")
                block = Postings(batch.column("length").to_numpy(), pc.list_value_length(lists).to_numpy(), lists.flatten().to_numpy(), batch.column("tf").flatten().to_numpy().astype(float), idf, average)
                keys = batch.column("key").to_pylist()
                for q, query in enumerate(asked):
                    least = -best[q][-1][0] - 10.0**-digits if len(best[q]) == k else 0.0
                    chunk, score, matched = block.best(query, least)
                    score = np.round(score, digits)
                    some = np.flatnonzero(score >= least)
                    if len(some) > k:  # ties with the k-th stay for the order of their keys
                        some = some[score[some] >= np.partition(score[some], -k)[-k]]
                    if len(some):
                        best[q] = sorted(best[q] + [(-s, keys[c], m) for s, c, m in zip(score[some].tolist(), chunk[some].tolist(), matched[some].tolist())])[:k]
            rows = [(q, -s, key_, m) for q, listed_ in enumerate(best) for s, key_, m in listed_]
            if rows:
                q, s, found_keys, m = zip(*rows)
                yield pa.record_batch({"query_id": ids.take(pa.array(q)), "key": pa.array(found_keys, batch.schema.field("key").type), "lexical_score": pa.array(s, pa.float64()), "terms": pa.array(m, pa.int32())})

        found.append(counted.mapInArrow(search, f"query_id {dict(queries.dtypes)['query_id']}, key {kind}, lexical_score double, terms int"))
    if not found:
        return spark.createDataFrame([], f"query_id {dict(queries.dtypes)['query_id']}, {key} {kind}, rank int, lexical_score double, terms int")
    return top_k(reduce(DataFrame.unionByName, found), k, "query_id", "lexical_score", "key").select("query_id", F.col("key").alias(key), "rank", "lexical_score", "terms")


def top_k(scores: DataFrame, k: int, group: str, score: str, tie: str) -> DataFrame:
    """The k best rows of each group (that limit is the feature), ranked by unrounded score, then ``tie``."""
    order = Window.partitionBy(group).orderBy(F.desc(score), tie)
    return scores.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def search_chunks(chunks: DataFrame, query: str, k: int = 10, lexical_weight: float = 0.7, dimensions: int = 128, include_vectors: bool = True) -> DataFrame:
    """Blend of BM25 and feature-hash cosine for one query; chunks without a common term stay in the race with score 0."""
    if k <= 0 or not 0 <= lexical_weight <= 1 or dimensions <= 0:
        raise ValueError("k and dimensions must be positive, the weight between 0 and 1")
    terms = sorted(r.t for r in chunks.sparkSession.createDataFrame([(query,)], "text string").select(F.explode(F.array_distinct(tokens(F.col("text")))).alias("t")).collect())
    asked, kind = pa.array(terms, pa.string()), dict(chunks.dtypes)["chunk_id"]
    repeated = chunks.sparkSession.createDataFrame([(query,)], "text string").select(tokens(F.col("text")).alias("t")).first().t
    wanted = feature_rows(pa.array([repeated], pa.list_(pa.string())), dimensions)[0]

    def scan(batches):
        """Length, counts of the query's terms and nearness of vectors of each chunk, in one pass and without its text."""
        for batch in (b.slice(i, j - i) for b in batches for i, j in token_slices(b.column("tokens"))):
            lists = batch.column("tokens")
            lengths, n = pc.list_value_length(lists).to_numpy(), max(1, len(asked))
            at = pc.fill_null(pc.index_in(lists.flatten(), value_set=asked), -1).to_numpy()
            row = np.repeat(np.arange(len(lengths)), lengths)
            tf = np.bincount(row[at >= 0] * n + at[at >= 0], minlength=len(lengths) * n)
            near = ((feature_rows(lists, dimensions) * wanted).sum(1) + 1) / 2 if include_vectors else np.zeros(len(lengths))
            yield pa.record_batch({"chunk_id": batch.column("chunk_id"), "length": pa.array(lengths, pa.int32()), "tf": pa.ListArray.from_arrays(pa.array(np.arange(len(lengths) + 1) * n, pa.int32()), pa.array(tf, pa.int32())), "vector_score": pa.array(near, pa.float64())})

    listed = chunks.filter("text <> ''").select("chunk_id", tokens(F.col("text")).alias("tokens"))
    rows = written(listed.mapInArrow(scan, f"chunk_id {kind}, length int, tf array<int>, vector_score double"), "scanned")
    held = [F.count_if(F.col("tf")[i] > 0).alias(f"df{i}") for i in range(len(terms))]
    stats = rows.agg(F.count("*").alias("docs"), F.avg("length").alias("average"), *held).first()
    score = F.lit(0.0)
    for i in range(len(terms)):
        idf, tf = math.log1p((stats.docs - stats[f"df{i}"] + 0.5) / (stats[f"df{i}"] + 0.5)), F.col("tf")[i]
        score = score + F.when(tf > 0, F.lit(idf) * (tf * (K1 + 1)) / (tf + K1 * (1 - B + B * F.greatest(F.col("length"), F.lit(1)) / F.lit(stats.average)))).otherwise(0.0)
    matched = F.array_compact(F.array(*(F.when(F.col("tf")[i] > 0, F.lit(t)) for i, t in enumerate(terms)))) if terms else F.array().cast("array<string>")
    rows = rows.withColumn("lexical_score", score).withColumn("matched_terms", matched)
    rows = rows.withColumn("combined", lexical_weight * F.col("lexical_score") + (1 - lexical_weight) * F.col("vector_score"))
    best = rows.orderBy(F.desc("combined"), "chunk_id").limit(k)
    rank = F.row_number().over(Window.orderBy(F.desc("combined"), "chunk_id"))  # k rows
    return best.select(rank.alias("rank"), "chunk_id", *(F.bround(c, 8).alias(a) for c, a in (("combined", "score"), ("lexical_score", "lexical_score"), ("vector_score", "vector_score"))), F.coalesce("matched_terms", F.array().cast("array<string>")).alias("matched_terms"))


#: Tokens that a task works on at once in Python.
SLICE_TOKENS = 500_000


def token_slices(lists: pa.ListArray, most: int | None = None):
    """Ranges of rows whose lists have about ``most`` entries together; a row is never cut."""
    ends = lists.offsets.to_numpy()[1:].astype(np.int64) - lists.offsets[0].as_py() if len(lists) else np.zeros(0, np.int64)
    cuts = np.flatnonzero(np.diff(ends // (most or SLICE_TOKENS))) + 1
    return list(zip([0, *cuts.tolist()], [*cuts.tolist(), len(lists)])) if len(lists) else []


def feature_rows(lists: pa.ListArray, dimensions: int) -> np.ndarray:
    """Signed feature hashing of token lists, normalised, a row each. Every distinct token is hashed once."""
    coded = lists.flatten().dictionary_encode()
    digests = [hashlib.blake2b(t, digest_size=16).digest() for t in coded.dictionary.cast(pa.binary()).to_numpy(zero_copy_only=False)]
    bucket = np.fromiter((int.from_bytes(d[:8], "big") % dimensions for d in digests), np.int64, len(digests))
    sign = np.fromiter((1.0 if d[8] & 1 else -1.0 for d in digests), float, len(digests))
    code = coded.indices.to_numpy(zero_copy_only=False)
    row = np.repeat(np.arange(len(lists)), pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False))
    v = np.bincount(row * dimensions + bucket[code], sign[code], len(lists) * dimensions).reshape(len(lists), dimensions) if len(code) else np.zeros((len(lists), dimensions))
    norm = np.sqrt((v * v).sum(1, keepdims=True))
    return v / np.where(norm > 0, norm, 1.0)


def hash_vectors(dimensions: int):
    """:func:`feature_rows` as a column. BLAKE2b has no built-in form, so tokens go to Arrow tasks, some rows at a time."""

    @F.arrow_udf("array<double>")
    def embed(lists: pa.Array) -> pa.Array:
        parts = [feature_rows(lists.slice(a, b - a), dimensions) for a, b in token_slices(lists)]
        flat = np.concatenate(parts).ravel() if parts else np.zeros(0)
        return pa.ListArray.from_arrays(pa.array(np.arange(len(lists) + 1) * dimensions, pa.int32()), pa.array(flat))

    return embed


def embed_chunks(chunks: DataFrame, dimensions: int = 128) -> DataFrame:
    return chunks.select("chunk_id", hash_vectors(dimensions)(tokens(F.col("text"))).alias("embedding"))


def nearest_vectors(vectors: DataFrame, query: DataFrame, k: int, key: str = "vec_id", column: str = "embedding") -> DataFrame:
    """Exact cosine top k for one query vector (``q``); vectors of another length are passed over."""
    rows = vectors.crossJoin(F.broadcast(query.limit(1))).filter(F.size(column) == F.size("q"))
    return rows.select(F.col(key), cosine(F.col(column), F.col("q")).alias("score")).orderBy(F.desc("score"), key).limit(k)
