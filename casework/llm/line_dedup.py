"""Line deduplication over levelled sorted runs of line hashes.

A run is a bucketed, sorted table of line hashes with the number of documents that hold
the line. Documents arrive in batches. A new batch is merge-anti-joined with the runs'
keys that are already known to be common, and what is left becomes a run of level 0. When
a level holds ``fanout`` runs they are merged into one run of the next level, so a key is
rewritten a logarithmic number of times. Hashes are 128 bits wide.
"""

from __future__ import annotations

import hashlib
import uuid
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, bloom_join, slices

#: Batches in which one call takes in its documents.
BATCHES = 4
#: Runs of a level that are merged into one of the next level.
FANOUT = 2
#: Lines per bucket of a run.
BUCKET_ROWS = 1_000_000


def line_key(line: bytes) -> bytes:
    """A line's key: white space (``[\\x20\\x09-\\x0D]``) stripped at both ends, A-Z lower-cased. ``bytes`` methods know ASCII only, as wanted."""
    return line.strip(b" \t\n\x0b\x0c\r").lower()


def _hash(key: bytes) -> bytes:
    return hashlib.blake2b(key, digest_size=16).digest()


def _hash_lines(batches):
    for batch in slices(batches):
        counts, hashes, shas = [], [], []
        for text in batch.column("text").to_pylist():
            keys = [line_key(x) for x in text.split(b"\n")]
            counts.append(len(keys))
            hashes.append([_hash(k) if k else None for k in keys])
            shas.append(hashlib.sha256(text).hexdigest())
        yield pa.record_batch(
            {"key": batch.column("key"), "id": batch.column("id"), "n_lines": pa.array(counts, pa.int64()), "sha": pa.array(shas, pa.string()), "hashes": pa.array(hashes, pa.list_(pa.binary()))}
        )


def _drop_lines(batches):
    for batch in slices(batches):
        dropped, shas, texts = [], [], []
        for text, at in zip(batch.column("text").to_pylist(), batch.column("at").to_pylist()):
            at = set(at)
            text = b"\n".join([x for i, x in enumerate(text.split(b"\n")) if i not in at])
            dropped.append(len(at))
            shas.append(hashlib.sha256(text).hexdigest())
            texts.append(text.decode())
        yield pa.record_batch(
            {"key": batch.column("key"), "id": batch.column("id"), "n_dropped": pa.array(dropped, pa.int64()), "kept_sha": pa.array(shas, pa.string()), "kept_text": pa.array(texts, pa.string())}
        )


class LineRuns:
    """Levelled sorted runs of (hash, number of documents), each a table bucketed and sorted by hash, so that merges and anti-joins of runs need no shuffle."""

    def __init__(self, scratch: Scratch, threshold: int, buckets: int, fanout: int = FANOUT):
        self.scratch, self.threshold, self.buckets, self.fanout = scratch, threshold, buckets, fanout
        self.levels: list[list[DataFrame]] = []
        self.tables: list[str] = []

    def _run(self, counts: DataFrame) -> DataFrame:
        name = f"line_run_{uuid.uuid4().hex}"
        self.tables.append(name)
        counts.write.bucketBy(self.buckets, "hash").sortBy("hash").option("path", self.scratch.path(name)).saveAsTable(name)
        return self.scratch.spark.table(name)

    def append(self, lines: DataFrame) -> None:
        """Add a batch of (doc, hash) rows; all rows of a document are in one batch."""
        fresh = lines.select("doc", "hash").distinct().groupBy("hash").agg(F.count("*").alias("docs")).repartition(self.buckets, "hash")
        for run in (run for level in self.levels for run in level):
            fresh = fresh.join(run.filter(F.col("docs") >= self.threshold).select("hash").hint("merge"), "hash", "left_anti")
        self._add(0, self._run(fresh))

    def _add(self, level: int, run: DataFrame) -> None:
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(run)
        if len(self.levels[level]) >= self.fanout:
            runs, self.levels[level] = self.levels[level], []
            self._add(level + 1, self._run(self._merge(runs).repartition(self.buckets, "hash")))

    def _merge(self, runs: list[DataFrame]) -> DataFrame:
        """Runs joined two by two as they are sorted; every key is in one row of each, so in one row of the result.

        Not a union: Spark takes a union of bucketed scans for dealt by ``hash`` and would not bring the rows of a key together.
        """

        def merge(left: DataFrame, right: DataFrame) -> DataFrame:
            both = left.join(right.withColumnRenamed("docs", "more").hint("merge"), "hash", "full")
            return both.select("hash", (F.coalesce("docs", F.lit(0)) + F.coalesce("more", F.lit(0))).alias("docs"))

        return reduce(merge, runs)

    def common(self) -> DataFrame:
        """Keys in at least ``threshold`` documents."""
        return self._merge([run for level in self.levels for run in level]).filter(F.col("docs") >= self.threshold)

    def close(self) -> None:
        for name in self.tables:
            self.scratch.spark.sql(f"DROP TABLE IF EXISTS {name}")
        self.scratch.drop(*self.tables)


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: int = 10, batches: int = BATCHES, fanout: int = FANOUT) -> tuple[DataFrame, DataFrame]:
    """Drop every line whose key is in at least ``threshold`` documents.

    Returns ``(digests, changed)``: per document ``id_col``, ``n_lines``, ``n_dropped``,
    ``kept_sha256``; and of the documents that lose lines ``id_col`` and ``kept_text``.

    A null or empty text is one empty line. Empty keys are never dropped. A line that
    repeats in one document counts once. Rows that share an id, or have none, are one
    document in the counts and keep a row each in the result. Empty tables give empty
    results; other columns are ignored, whatever their names.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "line-dedup")
    text = F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary").alias("text")
    rows = docs.select(F.col(id_col).cast("long").alias("id"), text)
    rows = rows.select("id", "text", F.xxhash64("id", "text").alias("key"))  # tells rows of one id apart
    hashed = scratch.table(
        rows.mapInArrow(_hash_lines, "key long, id long, n_lines long, sha string, hashes array<binary>").withColumn(
            "batch", F.pmod(F.xxhash64("id"), F.lit(batches)).cast("int")
        ),
        "hashed",
        ["batch"],
    )
    buckets = max(8, min(8192, (hashed.agg(F.sum("n_lines")).first()[0] or 0) // BUCKET_ROWS))
    runs = LineRuns(scratch, threshold, buckets, fanout)
    try:
        for i in range(batches):
            lines = hashed.filter(F.col("batch") == i).select(F.coalesce("id", F.lit(-(1 << 63))).alias("doc"), F.explode("hashes").alias("hash"))
            runs.append(lines.filter("hash IS NOT NULL"))
        common = scratch.table(runs.common(), "common")
    finally:
        runs.close()

    places = hashed.select("key", F.posexplode("hashes").alias("pos", "hash")).filter("hash IS NOT NULL")
    dropped = scratch.table(
        places.join(common.select("hash"), "hash").groupBy("key").agg(F.collect_set("pos").alias("at")).select("key", "at", F.size("at").alias("n")), "dropped"
    )
    changed = bloom_join(
        scratch, "changed", rows, dropped.filter("n > 0"), "key",
        lambda joined: joined.select("key", "id", "text", "at").mapInArrow(_drop_lines, "key long, id long, n_dropped long, kept_sha string, kept_text string"),
    )
    once = changed.groupBy("key").agg(F.first("n_dropped").alias("n_dropped"), F.first("kept_sha").alias("kept_sha"))
    digests = hashed.select("key", "id", "n_lines", "sha").join(once, "key", "left").select(
        F.col("id").alias(id_col), "n_lines", F.coalesce("n_dropped", F.lit(0)).cast("long").alias("n_dropped"), F.coalesce("kept_sha", "sha").alias("kept_sha256")
    )
    return digests, changed.select(F.col("id").alias(id_col), "kept_text")


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))[0]


OP8_SQL = r"""
WITH l AS (
    SELECT doc_id, pos, line, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
           'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
    FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
                 generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents)
), common AS (
    SELECT key FROM l WHERE key <> '' GROUP BY key HAVING count(DISTINCT doc_id) >= 10
), m AS (
    SELECT l.*, common.key IS NOT NULL AS gone FROM l LEFT JOIN common ON l.key = common.key
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""
