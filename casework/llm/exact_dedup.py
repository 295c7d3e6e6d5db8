"""Exact deduplication by exchanging Golomb-coded fingerprints.

Each partition of the input keeps its texts. It sends only the sorted fingerprints of its
texts to owners, which are ranges of the fingerprint space, as Golomb-Rice coded gaps. An
owner answers every partition with a bitmap that marks the fingerprints which some other
row has too. Only rows marked in this way, the suspects, are shuffled with their texts,
and grouped by the texts themselves. A digest stands for a group only if a single text has it.
"""

from __future__ import annotations

import math
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACE, Scratch, bloom_join

#: Distinct fingerprints that one owner handles on average: 8 MB when decoded.
OWNER_ROWS = 1_000_000
#: The digest that names a text in the result, and in joins where the texts bear it out.
DIGEST = partial(F.sha2, numBits=256)
#: A fingerprint is this many bits wider than the base-2 logarithm of the row count, so about 1 in 4096 unique rows is a suspect by chance.
SLACK_BITS = 12


def rice_encode(values: np.ndarray) -> bytes:
    """Sorted distinct unsigned integers as Golomb-Rice coded gaps: one byte for the parameter, then all quotients in unary, then all remainders."""
    if not len(values):
        return b""
    gaps = np.diff(values, prepend=np.uint64(0)).astype(np.uint64)
    r = max(0, int(math.log2(max(1.0, float(values[-1]) / len(values) * math.log(2)))))
    quotients = (gaps >> np.uint64(r)).astype(np.int64)
    ends = np.cumsum(quotients + 1)
    unary = np.ones(int(ends[-1]), np.uint8)
    unary[ends - 1] = 0
    low = ((gaps[:, None] >> np.arange(r, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8)
    head = len(values).to_bytes(8, "little") + len(unary).to_bytes(8, "little") + bytes([r])
    return head + np.packbits(unary).tobytes() + np.packbits(low.ravel()).tobytes()


def rice_decode(data: bytes) -> np.ndarray:
    """The inverse of :func:`rice_encode`."""
    if not data:
        return np.zeros(0, np.uint64)
    n, bits, r = int.from_bytes(data[:8], "little"), int.from_bytes(data[8:16], "little"), data[16]
    cut = 17 + (bits + 7) // 8
    unary = np.unpackbits(np.frombuffer(data[17:cut], np.uint8), count=bits)
    gaps = (np.diff(np.flatnonzero(unary == 0), prepend=-1) - 1).astype(np.uint64) << np.uint64(r)
    if r:
        low = np.unpackbits(np.frombuffer(data[cut:], np.uint8), count=n * r).reshape(n, r)
        gaps |= low.astype(np.uint64) @ (np.uint64(1) << np.arange(r, dtype=np.uint64))
    return np.cumsum(gaps, dtype=np.uint64)


def _narrow(fingerprints: np.ndarray, bits: int) -> np.ndarray:
    return fingerprints.view(np.uint64) >> np.uint64(64 - bits)


def _owner_bounds(values: np.ndarray, owners: int, bits: int) -> np.ndarray:
    """Where each owner's range begins in the sorted values."""
    return np.searchsorted(values, np.array([(o << bits) // owners for o in range(owners)] + [1 << bits], np.uint64))


def _column(table: pa.Table, name: str) -> np.ndarray:
    return table.column(name).combine_chunks().to_numpy(zero_copy_only=False)


def _sender(owners: int, bits: int):
    def send(table: pa.Table) -> pa.Table:
        values, counts = np.unique(_narrow(_column(table, "fp"), bits), return_counts=True)
        at = _owner_bounds(values, owners, bits)
        full = [o for o in range(owners) if at[o] < at[o + 1]]
        part = table.column("part")[0].as_py()
        return pa.table(
            {
                "owner": pa.array(full, pa.int32()),
                "part": pa.array([part] * len(full), pa.int32()),
                "hashes": pa.array([rice_encode(values[at[o] : at[o + 1]]) for o in full], pa.binary()),
                "repeated": pa.array([np.packbits(counts[at[o] : at[o + 1]] > 1).tobytes() for o in full], pa.binary()),
            }
        )

    return send


def _answer(table: pa.Table) -> pa.Table:
    parts, coded, repeated = (table.column(c).to_pylist() for c in ("part", "hashes", "repeated"))
    lists = [rice_decode(x) for x in coded]
    flags = [np.unpackbits(np.frombuffer(b, np.uint8), count=len(v)).astype(bool) for b, v in zip(repeated, lists)]
    values, inverse, counts = np.unique(np.concatenate(lists), return_inverse=True, return_counts=True)
    common = counts > 1
    common[inverse[np.concatenate(flags)]] = True
    cuts = np.cumsum([0, *map(len, lists)])
    bitmaps = [np.packbits(common[inverse[a:b]]).tobytes() for a, b in zip(cuts, cuts[1:])]
    return pa.table({"part": pa.array(parts, pa.int32()), "owner": table.column("owner").cast(pa.int32()), "bitmap": pa.array(bitmaps, pa.binary())})


def _receiver(owners: int, bits: int):
    def receive(rows: pa.Table, bitmaps: pa.Table) -> pa.Table:
        values, inverse = np.unique(_narrow(_column(rows, "fp"), bits), return_inverse=True)
        at, marked = _owner_bounds(values, owners, bits), np.zeros(len(values), bool)
        for owner, bitmap in zip(bitmaps.column("owner").to_pylist(), bitmaps.column("bitmap").to_pylist()):
            a, b = at[owner], at[owner + 1]
            marked[a:b] = np.unpackbits(np.frombuffer(bitmap, np.uint8), count=int(b - a)).astype(bool)
        return rows.drop_columns(["part"]).append_column("suspect", pa.array(marked[inverse].astype(np.int32)))

    return receive


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: which row of its group of equal texts stays.

    Texts are equal when identical after deleting every white-space character
    (``[\\x20\\x09-\\x0D]``). Of equal texts the row with the most code points in the
    original text stays, of these the one with the smallest id. Returns ``id_col``,
    ``keep_id``, ``group_size``, ``kept``, ``text_sha256``.

    Null text counts as empty; all empty and all-white texts are one group. A repeated row
    is a member of its group like any other; where two rows share id and text, both carry
    ``kept`` true if that id stays. A null id is a row like others and sorts first. An empty
    table gives an empty result. Other columns are ignored, whatever their names.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "exact-dedup")
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    squeezed = F.regexp_replace("text", SPACE + "+", "")
    key = F.coalesce("id", F.lit(-(1 << 63)))  # a null id can't be joined

    prints = scratch.table(
        rows.select("id", F.length("text").alias("n"), squeezed.alias("squeezed")).select(
            "id", "n", DIGEST("squeezed").alias("sha"), F.xxhash64("squeezed").alias("fp"), F.spark_partition_id().alias("part")
        ),
        "fingerprints",
    )
    total = prints.count()
    owners = max(1, math.ceil(total / OWNER_ROWS))
    bits = min(62, math.ceil(math.log2(total + 2)) + SLACK_BITS)

    sent = prints.select("part", "fp").groupBy("part").applyInArrow(_sender(owners, bits), "owner int, part int, hashes binary, repeated binary")
    answers = sent.groupBy("owner").applyInArrow(_answer, "part int, owner int, bitmap binary")
    marked = scratch.table(
        prints.groupBy("part").cogroup(answers.groupBy("part")).applyInArrow(_receiver(owners, bits), "id long, n int, sha string, fp long, suspect int"), "marked"
    )

    suspects = marked.filter("suspect = 1")
    named = scratch.table(suspects.select(key.alias("key"), "suspect").distinct(), "suspects").filter("suspect = 1").select("key")
    texts = lambda joined: joined.select("id", F.length("text").alias("n"), squeezed.alias("squeezed"))
    grouped = lambda rows: rows.groupBy("squeezed").agg(F.count("*").alias("group_size"), F.min_by("id", F.struct(-F.col("n"), "id")).alias("keep_id"))
    groups = bloom_join(scratch, "groups", rows.withColumn("key", key), named, "key", lambda joined: grouped(texts(joined)).select(DIGEST("squeezed").alias("sha"), "group_size", "keep_id"))

    # One row per text there. Where a digest has one text, it stands for it; where it has several, the texts themselves decide.
    verified = scratch.table(groups.groupBy("sha").agg(F.count("*").alias("texts"), F.first("group_size").alias("group_size"), F.first("keep_id").alias("keep_id")), "verified")
    several = verified.filter("texts > 1").select("sha")
    shared = suspects.select("id", "sha").join(verified, "sha", "left").filter("texts IS NULL OR texts = 1").select("id", "sha", "group_size", "keep_id")
    if not several.isEmpty():
        own = suspects.join(several, "sha", "left_semi").select(key.alias("key"), "fp").distinct()
        whole = rows.select("id", F.length("text").alias("n"), squeezed.alias("squeezed"), key.alias("key")).withColumn("fp", F.xxhash64("squeezed"))
        doubtful = scratch.table(whole.join(own, ["key", "fp"], "left_semi").select("id", "n", "squeezed", DIGEST("squeezed").alias("sha")), "doubtful")
        shared = shared.unionByName(doubtful.select("id", "sha", "squeezed").join(scratch.table(grouped(doubtful), "by-text"), "squeezed").select("id", "sha", "group_size", "keep_id"))
    alone = F.col("group_size").isNull()
    return shared.select(
        F.col("id").alias(id_col),
        F.when(alone, F.col("id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        F.coalesce(alone | F.col("id").eqNullSafe(F.col("keep_id")), F.lit(True)).alias("kept"),
        F.col("sha").alias("text_sha256"),
    ).unionByName(
        marked.filter("suspect = 0").select(
            F.col("id").alias(id_col), F.col("id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), F.col("sha").alias("text_sha256")
        )
    )


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP7_SQL = r"""
WITH t AS (
    SELECT doc_id, length(coalesce(text, '')) AS n, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
    FROM documents
), w AS (
    SELECT doc_id, text_sha256, count(*) OVER (PARTITION BY text_sha256) AS group_size,
           first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY n DESC, doc_id) AS keep_id
    FROM t
)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM w
"""
