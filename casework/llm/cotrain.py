"""Quality classifier by co-training on two views of a page.

One model sees the text (which bytes it has, how words repeat), the other only what
surrounds it (source, language, length and line layout). In every round both models score
all rows without a label of the fit, each model labels those of which it is most sure, and
the other one learns from these labels. In the end both are calibrated on labelled rows that neither has seen, and a third small model
combines the two views into the score of a document.
"""

from __future__ import annotations

import uuid
import zlib
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, forget, release, slices
from .linear import Logistic, calibrated

#: Labelled rows that the models are fitted on at most, picked by hash of the id.
FIT_ROWS = 12_000
ROUNDS = 4
#: Rows that a model labels per round at most, of all rows those of which it is surest, and how sure it has to be.
PER_ROUND = 1_000
SURE = 0.97
SOURCE_BUCKETS, LANG_BUCKETS = 32, 8


def text_features(text: str, data: bytes) -> np.ndarray:
    """The text view: the share of every byte value, and of repeated words, neighbours and lines."""
    counts = np.bincount(np.frombuffer(data, np.uint8), minlength=256).astype(np.float32)
    words = text.split()
    lines = data.split(b"\n")
    n, distinct = max(1, len(words)), set(words)
    again = sum(map(str.__eq__, words, words[1:]))
    extra = [len(distinct) / n, again / n, len(data) / n, len(set(lines)) / len(lines), max(map(len, distinct), default=0), float(not words)]
    extra[4] = np.log1p(extra[4])
    return np.concatenate([np.log1p(counts / max(1, len(data)) * 1000), np.array(extra, np.float32)])


def meta_features(source: str, lang: str, declared: int, text_bytes: int, lines: int) -> np.ndarray:
    """The metadata view: nothing of the text but its size and layout."""
    out = np.zeros(SOURCE_BUCKETS + LANG_BUCKETS + 4, np.float32)
    out[zlib.crc32(source.encode()) % SOURCE_BUCKETS] = 1
    out[SOURCE_BUCKETS + zlib.crc32(lang.encode()) % LANG_BUCKETS] = 1
    out[-4:] = np.log1p(max(0, declared)), np.log1p(text_bytes), np.log1p(lines), np.log1p(text_bytes / lines)
    return out


def _views(batch) -> tuple[np.ndarray, np.ndarray]:
    texts, metas = [], []
    for text, source, lang, declared in zip(*(batch.column(c).to_pylist() for c in ("text", "source", "lang", "declared"))):
        text = text or ""
        data = text.encode()
        texts.append(text_features(text, data))
        metas.append(meta_features(source, lang, declared, len(data), data.count(b"\n") + 1))
    return np.array(texts).reshape(len(texts), -1), np.array(metas).reshape(len(metas), -1)


#: Numbers of the two views.
WIDTHS = len(text_features("", b"")), len(meta_features("", "", 0, 0, 1))


def _featurize(batches):
    """Both views of a row as one string of 32-bit floats, and a key that tells rows apart by what the models see of them."""
    forget()
    for batch in slices(batches):
        both = np.hstack(_views(batch)).astype(np.float32)
        data = [x.tobytes() for x in both]
        keys = [xxhash.xxh3_64_intdigest(x) - (1 << 63) for x in data]
        yield pa.record_batch({"id": batch.column("id"), "key": pa.array(keys, pa.int64()), "x": pa.array(data, pa.binary())})
    release()


def _split(column) -> tuple[np.ndarray, np.ndarray]:
    x = np.frombuffer(b"".join(column.to_pylist()), np.float32).reshape(-1, sum(WIDTHS))
    return x[:, : WIDTHS[0]], x[:, WIDTHS[0] :]


def _proposer(models: list[Logistic], given: list[np.ndarray], most: list[int], sure: float):
    """What each model would teach the other: of every task the surest rows for each label, ``most`` of a label at most."""

    def run(batches):
        forget()
        best = {(v, label): (np.zeros(0, np.int64), np.zeros(0)) for v in (0, 1) for label in (0, 1)}
        for batch in slices(batches, "x"):
            keys = batch.column("key").to_numpy()
            for v, x in enumerate(_split(batch.column("x"))):
                p, free = models[v].predict(x), ~np.isin(keys, given[1 - v])
                for label, q in ((0, 1 - p), (1, p)):
                    ok = free & (q >= sure)
                    k, q = np.concatenate([best[v, label][0], keys[ok]]), np.concatenate([best[v, label][1], q[ok]])
                    k, first = np.unique(k, return_index=True)
                    order = np.argsort(-q[first], kind="stable")[: most[label]]
                    best[v, label] = k[order], q[first][order]
        for (v, label), (k, q) in best.items():
            yield pa.record_batch({"view": pa.array([v] * len(k), pa.int32()), "label": pa.array([label] * len(k), pa.int32()), "key": pa.array(k, pa.int64()), "sure": pa.array(q, pa.float64())})
        release()

    return run


class CoTrained:
    """The fitted models; ``score`` gives both views' calibrated and the combined probabilities."""

    def __init__(self, rounds: int = ROUNDS, per_round: int = PER_ROUND, sure: float = SURE):
        self.rounds, self.per_round, self.sure = rounds, per_round, sure
        self.pseudo: list[tuple[int, int]] = []

    def fit(self, a: np.ndarray, b: np.ndarray, y: np.ndarray, propose) -> CoTrained:
        """``propose(models, given, most, sure)`` returns ``(view, label, key, a, b)``: what each model labels in a round, with the features of both views."""
        held = np.arange(len(y)) % 5 == 4  # calibration rows; the order is that of hashed ids
        views, y_fit = (a[~held], b[~held]), y[~held]
        share = float(y_fit.mean()) if len(y_fit) else 0.5
        gained = [(views[v][:0], np.zeros(0)) for v in (0, 1)]  # rows and labels each model has got from the other
        given = [np.zeros(0, np.int64) for _ in views]

        def refit(v):
            return Logistic().fit(np.vstack([views[v], gained[v][0]]), np.concatenate([y_fit, gained[v][1]]))

        models = [refit(0), refit(1)]
        most = [max(1, int(self.per_round * (1 - share))), max(1, int(self.per_round * share))]
        for _ in range(self.rounds if 0 < share < 1 else 0):
            view, label, key, *both = propose(models, given, most, self.sure)
            for v in (0, 1):
                got = view == 1 - v
                gained[v] = np.vstack([gained[v][0], both[v][got]]), np.concatenate([gained[v][1], label[got]])
                given[v] = np.concatenate([given[v], key[got]])
            self.pseudo.append((int((view == 0).sum()), int((view == 1).sum())))
            models = [refit(0), refit(1)]
        self.models = models
        logits = [m.logit(x[held]) for m, x in zip(models, (a, b))]
        self.scales = [calibrated(z, y[held]) for z in logits]
        self.combine = Logistic(ridge=0.1).fit(np.stack([s.logit(z[:, None]) for s, z in zip(self.scales, logits)], 1), y[held])
        return self

    def score(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        logits = [s.logit(m.logit(x)[:, None]) for s, m, x in zip(self.scales, self.models, (a, b))]
        sigma = lambda z: 1 / (1 + np.exp(-np.clip(z, -40, 40)))
        return sigma(logits[0]), sigma(logits[1]), self.combine.predict(np.stack(logits, 1))


def _is_text(docs: DataFrame, column: str, text_col: str) -> bool:
    return column == text_col and dict(docs.dtypes)[column] == "string"


def _prepare(docs: DataFrame, id_col: str, text_col: str, source_col: str, lang_col: str, size_col: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """Columns for the tasks. A text that is to be kept goes there once, null or not, and comes back from there: it is most of a batch, on both sides."""
    word = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    return docs.select(
        F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"), word(source_col).alias("source"), word(lang_col).alias("lang"), F.coalesce(F.col(size_col).cast("long"), F.lit(0)).alias("declared"),
        *(F.col(c).alias(f"keep{i}") for i, c in enumerate(keep) if not _is_text(docs, c, text_col)),
    )


def fit_quality(docs: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", lang_col: str = "lang", size_col: str = "n_chars", fit_rows: int = FIT_ROWS, rounds: int = ROUNDS, per_round: int = PER_ROUND) -> CoTrained:
    """Fit on at most ``fit_rows`` labelled rows, those with the smallest hash of the id, and on what the models label of all others.

    Every round scores all rows; a model labels at most ``per_round`` of them, the surest of
    the whole table, so what reaches the driver is bounded by the parameters. Rows that
    look alike in both views are labelled once. Of several labels of an id the mean counts,
    rounded half up; null labels count as none; of several rows of an id one is fitted on.
    Without any labelled row the models say 0.5 of every document.
    """
    scratch = Scratch(docs.sparkSession, "cotrain")
    rows = _prepare(docs, id_col, text_col, source_col, lang_col, size_col)
    features = scratch.table(rows.mapInArrow(_featurize, "id long, key long, x binary"), "features")
    known = labels.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("double").alias("y")).dropna().groupBy("id").agg((F.avg("y") >= 0.5).cast("double").alias("y"))
    ids = features.select("id").dropna().distinct()
    # Bounded by the parameter, whatever the size of the corpus, and so small enough to be broadcast.
    chosen = scratch.table(ids.join(known, "id").orderBy(F.xxhash64("id"), "id").limit(fit_rows), "chosen")
    data = features.join(F.broadcast(chosen), "id").groupBy("id", "y").agg(F.min_by("x", "key").alias("x"), F.min("key").alias("key")).orderBy(F.xxhash64("id"), "id").toArrow()

    fitted = data.column("key").to_numpy()

    def propose(models, given, most, sure):
        told = [np.concatenate([fitted, g]) for g in given]
        found = scratch.table(features.select("key", "x").mapInArrow(_proposer(models, told, most, sure), "view int, label int, key long, sure double"), uuid.uuid4().hex)
        best = [found.filter((F.col("view") == v) & (F.col("label") == label)).groupBy("view", "label", "key").agg(F.max("sure").alias("sure")).orderBy(F.desc("sure"), "key").limit(most[label]) for v in (0, 1) for label in (0, 1)]
        picked = scratch.table(reduce(DataFrame.unionByName, best), uuid.uuid4().hex)
        wanted = features.join(F.broadcast(picked.select("key").distinct()), "key").groupBy("key").agg(F.min("x").alias("x"))
        got = wanted.join(F.broadcast(picked), "key").orderBy("view", "label", F.desc("sure"), "key").toArrow()
        return (*(got.column(c).to_numpy() for c in ("view", "label", "key")), *_split(got.column("x")))

    model = CoTrained(rounds, per_round).fit(*_split(data.column("x")), data.column("y").to_numpy(), propose)
    scratch.drop("features")
    return model


def _scorer(model: CoTrained, keep: list[str]):
    """``keep`` names the columns that go back as ``keep0``, ``keep1`` and so on."""

    def run(batches):
        forget()
        for batch in slices(batches):
            a, b = _views(batch)
            pa_, pb_, p = model.score(a, b)
            empty = np.array([not (t and t.strip()) for t in batch.column("text").to_pylist()], bool)
            p = np.where(empty, 0.0, p)
            kept = {f"keep{i}": batch.column(c) for i, c in enumerate(keep)}
            yield pa.record_batch({"id": batch.column("id"), "text_score": pa.array(pa_), "meta_score": pa.array(pb_), "quality_score": pa.array(p)} | kept)
        release()

    return run


def score_quality(docs: DataFrame, model: CoTrained, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", lang_col: str = "lang", size_col: str = "n_chars", keep: tuple[str, ...] = (), threshold: float = 0.5) -> DataFrame:
    """Per row: the id, ``text_score``, ``meta_score``, ``quality_score``, ``keep``, and the columns named in ``keep``.

    A null, empty or all-white text has the score 0. Nulls in the other columns count as an
    empty string or as 0. Repeated rows and null ids are scored like others. Other columns
    are ignored, whatever their names.
    """
    kinds = dict(docs.dtypes)
    rows = _prepare(docs, id_col, text_col, source_col, lang_col, size_col, keep)
    schema = ", ".join(["id long, text_score double, meta_score double, quality_score double", *(f"keep{i} {kinds[c]}" for i, c in enumerate(keep))])
    scored = rows.mapInArrow(_scorer(model, ["text" if _is_text(docs, c, text_col) else f"keep{i}" for i, c in enumerate(keep)]), schema)
    return scored.select(F.col("id").alias(id_col), "text_score", "meta_score", "quality_score", (F.col("quality_score") >= threshold).alias("keep"), *(F.col(f"keep{i}").alias(c) for i, c in enumerate(keep) if c != id_col))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return score_quality(docs, fit_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
