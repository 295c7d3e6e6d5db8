"""From raw documents to token ids in five stages, each one operator of ``casework.llm``.

A stage takes ``(spark, docs, sf_dir)`` and returns the documents that it keeps, with the
columns of ``documents``; the last one returns token ids. Every stage's result is written
as Parquet and read again as the next one's ``docs``. SQL can't express the stages (a
fitted model, edit distances, a tokenizer), so ``ORACLE_SQL`` is None and ``tests/llm``
hold the pipeline against a plain version in Python.

A row goes by its id. Rows without an id stay in stages 2 to 4, as nothing can name them;
rows that share an id go together, and those of equal id and text stay together. Null text
counts as empty: such rows are rejected by the first stage, and where that is left out, one
of them stays. Empty tables pass through every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from casework.llm.common import Scratch
from casework.llm.cotrain import fit_quality, score_quality
from casework.llm.decontaminate import find_leaks
from casework.llm.exact_dedup import exact_dedup
from casework.llm.ngram_join import jaccard_components
from casework.llm.sentencepiece_bpe import tokenize

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _without(docs: DataFrame, gone: DataFrame, name: str) -> DataFrame:
    """``docs`` less the ids in ``gone``, which is written first: the planner then knows its size and broadcasts it only if it is small."""
    return docs.join(Scratch(docs.sparkSession, name).table(gone.select("doc_id").distinct(), "gone"), "doc_id", "left_anti").select(*COLUMNS)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the co-trained classifier doesn't reject."""
    model = fit_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score_quality(docs, model, keep=COLUMNS[1:]).filter("keep").select(*COLUMNS)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    return _without(docs, exact_dedup(docs).filter("NOT kept"), "exact")


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The smallest id of each component of documents whose sets of five-word shingles are similar to 0.8 at least."""
    return _without(docs, jaccard_components(docs, words=5, percent=80).filter("doc_id <> component_id"), "near")


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any benchmark item in them."""
    return _without(docs, find_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")), "leaks")


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document that is left, and the digest of what they decode to. Written here, as the size of batches to Python is a setting of the session that runs the job."""
    return Scratch(spark, "tokens").table(tokenize(docs, keep=("lang", "source"), outputs=("n_tokens", "ids", "decoded_sha256")), "ids")


STAGES = [
    ("quality classifier", quality),
    ("exact dedup", exact),
    ("n-gram Jaccard join", near),
    ("benchmark decontamination", decontaminate),
    ("SentencePiece encoding", tokens),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table ``documents``."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(*COLUMNS)
    for i, (_, stage) in enumerate(STAGES[:-1]):
        docs = scratch.table(stage(spark, docs, sf_dir), f"stage-{i}")
    return STAGES[-1][1](spark, docs, sf_dir)
