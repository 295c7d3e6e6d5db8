"""Toxicity by classifier chains.

Each category has a linear model. Models come in a fixed order, and each one sees, besides
the words of a document, the probabilities of the categories before it. For fitting, those
are out-of-fold predictions, so that a later model learns how far to trust an earlier one
on documents which that has not seen.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, slices
from .linear import Logistic

#: Labelled rows that the chain is fitted on at most, picked by hash of the id.
FIT_ROWS = 12_000
#: Terms per category that become features, and the least number of documents of the sample that have one.
TERMS = 64
LEAST_DOCS = 8
FOLDS = 5
#: Lengths of the word beginnings that are terms, besides whole words up to 12 letters.
STEMS = (4, 5, 6)
words_of = re.compile(r"\w+").findall


def terms_of(text: str) -> set[str]:
    """Whole words (as ``=word``) and word beginnings of a text, in lower case."""
    out: set[str] = set()
    for word in set(words_of(text.lower())):
        if len(word) <= 12:
            out.add("=" + word)
        for n in STEMS:
            if len(word) >= n:
                out.add(word[:n])
    return out


class Chain:
    """Models in order over presence features of the chosen terms."""

    def __init__(self, categories: list[str], folds: int = FOLDS):
        self.categories, self.folds = categories, folds

    def fit(self, terms: list[str], x: np.ndarray, y: np.ndarray) -> Chain:
        """``x``: documents by terms, 0 or 1; ``y``: documents by categories, 0 or 1."""
        self.terms = terms
        fold = np.arange(len(x)) % self.folds
        earlier = np.zeros((len(x), 0))
        self.models = []
        for k in range(len(self.categories)):
            full = np.hstack([x, earlier])
            out_of_fold = np.zeros(len(x))
            for f in range(self.folds):
                if (fold == f).any() and (fold != f).any():
                    out_of_fold[fold == f] = Logistic(steps=8).fit(full[fold != f], y[fold != f, k]).predict(full[fold == f])
            self.models.append(Logistic(steps=8).fit(full, y[:, k]))
            earlier = np.hstack([earlier, out_of_fold[:, None]])
        self.out_of_fold = earlier
        return self

    def predict(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros((len(x), 0))
        for model in self.models:
            out = np.hstack([out, model.predict(np.hstack([x, out]))[:, None]])
        return out

    def features(self, texts: list[str]) -> np.ndarray:
        at = {t: i for i, t in enumerate(self.terms)}
        known = at.keys()
        x = np.zeros((len(texts), len(at)), np.float32)
        for row, text in enumerate(texts):
            for term in known & terms_of(text):
                x[row, at[term]] = 1
        return x


def _sample_terms(batches):
    for batch in slices(batches):
        rows = [list(terms_of(t)) for t in batch.column("text").to_pylist()]
        yield pa.record_batch({"id": batch.column("id"), "terms": pa.array(rows, pa.list_(pa.string()))})


def fit_chain(docs: DataFrame, labels: DataFrame, categories: list[str], id_col: str = "doc_id", text_col: str = "text", fit_rows: int = FIT_ROWS, terms: int = TERMS) -> Chain:
    """Fit the chain on at most ``fit_rows`` labelled documents, those with the smallest hash of the id.

    ``labels`` has a 0/1 column per category. Of several rows of an id the largest label
    counts; a null label counts as 0. Terms are chosen by the log-odds of a category.
    """
    scratch = Scratch(docs.sparkSession, "toxicity")
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    known = labels.select(F.col(id_col).cast("long").alias("id"), *(F.coalesce(F.col(c).cast("int"), F.lit(0)).alias(f"y{k}") for k, c in enumerate(categories)))
    known = known.dropna().groupBy("id").agg(*(F.max(f"y{k}").alias(f"y{k}") for k in range(len(categories))))
    ids = rows.select("id").dropna().distinct()
    # Bounded by fit_rows, whatever the size of the corpus, and so small enough to be broadcast.
    chosen = scratch.table(ids.join(known, "id").orderBy(F.xxhash64("id"), "id").limit(fit_rows), "chosen")
    sample = scratch.table(rows.join(F.broadcast(chosen.select("id")), "id").mapInArrow(_sample_terms, "id long, terms array<string>").dropDuplicates(["id"]).join(F.broadcast(chosen), "id"), "sample")

    ys = [f"y{k}" for k in range(len(categories))]
    totals = chosen.agg(F.count("*").alias("n"), *(F.coalesce(F.sum(y), F.lit(0)).alias(y) for y in ys)).first()
    counts = sample.select(F.explode("terms").alias("term"), *ys).groupBy("term").agg(F.count("*").alias("n"), *(F.sum(y).alias(y) for y in ys)).filter(F.col("n") >= LEAST_DOCS)
    picked: list[str] = []
    for y in ys:
        rate = lambda c, t: (c + 0.5) / (t + 1.0)
        odds = F.log(rate(F.col(y), totals[y]) / rate(F.col("n") - F.col(y), totals["n"] - totals[y])) * F.sqrt(F.col(y))
        picked += [r.term for r in counts.filter(F.col(y) > 0).orderBy(odds.desc(), "term").limit(terms).collect()]
    picked = sorted(set(picked))
    found = sample.select("id", *ys, F.array_intersect("terms", F.array(*map(F.lit, picked)) if picked else F.array().cast("array<string>")).alias("terms")).orderBy(F.xxhash64("id"), "id").collect()
    at = {t: i for i, t in enumerate(picked)}
    x = np.zeros((len(found), len(picked)), np.float32)
    for row, r in enumerate(found):
        for term in r.terms:
            x[row, at[term]] = 1
    y = np.array([[r[c] for c in ys] for r in found], float).reshape(len(found), len(ys))
    return Chain(categories).fit(picked, x, y)


def _scorer(chain: Chain):
    def run(batches):
        for batch in slices(batches):
            p = chain.predict(chain.features(batch.column("text").to_pylist()))
            yield pa.record_batch({"id": batch.column("id")} | {f"p{k}": pa.array(p[:, k], pa.float64()) for k in range(len(chain.categories))})

    return run


def score_toxicity(docs: DataFrame, chain: Chain, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """Per row: the id, ``p_<category>`` for each category, and ``toxic``: whether the last category's probability reaches ``threshold``.

    A null or empty text has no terms and gets the base rates. Repeated rows and null ids
    are scored like others. An empty table gives an empty result. Other columns are ignored.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    schema = ", ".join(["id long", *(f"p{k} double" for k in range(len(chain.categories)))])
    scored = rows.mapInArrow(_scorer(chain), schema)
    last = F.col(f"p{len(chain.categories) - 1}")
    return scored.select(F.col("id").alias(id_col), *(F.col(f"p{k}").alias(f"p_{c}") for k, c in enumerate(chain.categories)), (last >= threshold).alias("toxic"))


#: Languages whose abuse is a category of its own. Before them comes low quality, the one other label there is and no part of toxicity; the last category is toxicity as such.
LANGS = ("en", "de", "fr", "es")


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    toxic = F.coalesce(F.col("toxic").cast("int"), F.lit(0))
    by_lang = labels.select("doc_id", "toxic", (1 - F.col("quality")).alias("low_quality")).join(docs.select("doc_id", "lang"), "doc_id")
    by_lang = by_lang.select("doc_id", "low_quality", "toxic", *(F.coalesce(toxic * (F.col("lang") == x).cast("int"), F.lit(0)).alias(f"toxic_{x}") for x in LANGS))
    return score_toxicity(docs, fit_chain(docs, by_lang, ["low_quality", *(f"toxic_{x}" for x in LANGS), "toxic"]))
