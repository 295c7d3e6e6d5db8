"""How far the sources of a language differ in their words, by a systolic tournament.

Counts of the kept terms of a language are cut into blocks of terms, and each source's
counts of a block are one compressed vector. The sources of a language are dealt to cells.
A cell's vectors stay where they are, in a bucketed table; in every round of a round-robin
tournament each cell meets one other, whose vectors come to it as they are, compressed, and
all pairs of the two cells are evaluated there in both directions. In the first round the
pairs within the cells are evaluated, and local heaps rank each source's terms against the
whole language. Partial results of the blocks are added up, or ranked again, at the end.

No task holds more than the vectors of two cells for one block of terms, both of bounded
size, and no row of the tournament is a single term's.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Scratch, release, slices

#: Documents of its language that hold a term at least, and ranks of terms that are told.
LEAST_DOCS = 10
TOP_TERMS = 10
#: Sum of a distribution's shares, before one is added to each.
UNIT = 1_000_000_000
#: Terms of a block at most, on average.
BLOCK_TERMS = 1 << 15
#: Sources of a cell at least, cells of a language at most, and bytes of a cell's vectors, which may ask for more cells.
CELL_SOURCES = 4
MOST_CELLS = 64
CELL_BYTES = 32 << 20
#: Entries that a counting task holds before it gives them away, and bytes of a text that it splits at once.
HELD_TERMS = 300_000
PIECE_BYTES = 1 << 20

#: ASCII letters in lower case, all else of ASCII a space; other bytes belong to letters of UTF-8 and stay.
_LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def term_pieces(text: bytes):
    """The terms of a text in lists, cut between terms after about ``PIECE_BYTES``."""
    text, at = text.translate(_LETTERS), 0
    while at < len(text):
        end = text.find(b" ", at + PIECE_BYTES)
        end = len(text) if end < 0 else end
        yield text[at:end].split()
        at = end


def _count(batches):
    """Occurrences and documents of each term, by language and source, added up within the task."""
    from collections import Counter

    held: dict[tuple[str, str], tuple[Counter, Counter]] = {}

    def give():
        for (lang, source), (counts, docs) in held.items():
            if counts:
                terms = pa.array(list(counts), pa.binary())
                n = len(terms)
                yield pa.record_batch(
                    {
                        "lang": pa.array([lang] * n, pa.string()),
                        "source": pa.array([source] * n, pa.string()),
                        "term": terms.cast(pa.string()),
                        "n": pa.array(list(counts.values()), pa.int64()),
                        "docs": pa.array(list(map(docs.__getitem__, counts)), pa.int64()),
                    }
                )
        held.clear()

    for batch in slices(batches):
        for lang, source, text in zip(*(batch.column(c).to_pylist() for c in ("lang", "source", "text"))):
            counts, docs = held.setdefault((lang, source), (Counter(), Counter()))
            seen: set[bytes] = set()
            for piece in term_pieces(text):
                counts.update(piece)
                seen.update(piece)
            docs.update(seen)
        if sum(len(c) for c, _ in held.values()) > HELD_TERMS:
            yield from give()
    yield from give()
    release()


def pack(slots: np.ndarray, counts: np.ndarray) -> bytes:
    """Sorted distinct slots and their counts: gaps and counts in the narrowest unsigned types, then Zstandard."""
    narrow = lambda x: x.astype(np.min_scalar_type(int(x.max())))
    gaps, counts = narrow(np.diff(slots, prepend=0)), narrow(counts)
    raw = bytes([gaps.itemsize, counts.itemsize]) + len(slots).to_bytes(4, "little") + gaps.tobytes() + counts.tobytes()
    return len(raw).to_bytes(8, "little") + pa.compress(raw, "zstd", asbytes=True)


def unpack(data: bytes | None) -> tuple[np.ndarray, np.ndarray]:
    """The inverse of :func:`pack`; nothing stands for an empty vector."""
    if not data:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    raw = pa.decompress(data[8:], int.from_bytes(data[:8], "little"), "zstd", asbytes=True)
    wide_gap, wide_count, n = raw[0], raw[1], int.from_bytes(raw[2:6], "little")
    gaps = np.frombuffer(raw, f"u{wide_gap}", n, 6)
    counts = np.frombuffer(raw, f"u{wide_count}", n, 6 + n * wide_gap)
    return np.cumsum(gaps, dtype=np.int64), counts.astype(np.int64)


def share(count, total):
    """``1 + floor(UNIT * count / total)`` exactly, for counts below 9e13: a long division in two digits of base ten thousand and more."""
    high, rest = np.divmod(np.asarray(count, np.int64) * 100_000, total)
    return 1 + high * 10_000 + rest * 10_000 // total


def gap(p, q):
    """The distance of two shares, rounded down."""
    return (p - q) * (p - q) // (p + q)


class Vector:
    """Shares of a source in one block of terms: those of the terms that it has, and the one of all others."""

    def __init__(self, source: str, packed: bytes | None, total: int):
        self.source = source
        self.slots, counts = unpack(packed)
        self.p, self.rest = share(counts + 2, total), int(share(2, total))

    def spread(self, into: np.ndarray) -> np.ndarray:
        """The shares of all slots, in a buffer that the caller lends."""
        into[:] = self.rest
        into[self.slots] = self.p
        return into


def distance(a: Vector, b: Vector, spread_a: np.ndarray, spread_b: np.ndarray) -> int:
    """Sum over all slots; work in proportion to the terms that either has."""
    only_b = b.slots[spread_a[b.slots] == a.rest] if len(a.slots) else b.slots
    if len(a.slots):  # a term of ``a`` can have the share of those it lacks, so look at the slots themselves
        at = np.searchsorted(a.slots, only_b)
        at[at == len(a.slots)] = 0
        only_b = only_b[a.slots[at] != only_b]
    others = len(spread_a) - len(a.slots) - len(only_b)
    return int(gap(a.p, spread_b[a.slots]).sum()) + int(gap(a.rest, spread_b[only_b]).sum()) + others * int(gap(a.rest, b.rest))


def _vectors(table: pa.Table) -> list[Vector]:
    return [Vector(*x) for x in zip(*(table.column(c).to_pylist() for c in ("source", "packed", "divisor")))]


_RESULT = "lang string, source string, part string, item string, value long"


def _result(lang: str, rows: list[tuple[str, str, str, int]]) -> pa.Table:
    columns = list(zip(*rows)) or [[]] * 4
    kinds = (pa.string(), pa.string(), pa.string(), pa.int64())
    return pa.table([pa.array([lang] * len(rows), pa.string()), *(pa.array(c, k) for c, k in zip(columns, kinds))], ["lang", "source", "part", "item", "value"])


def _both(a: Vector, b: Vector, value: int) -> list[tuple[str, str, str, int]]:
    return [(a.source, "pair", b.source, value), (b.source, "pair", a.source, value)]


def _at_home(top: int):
    """Pairs within a cell, and each source's terms against the language."""

    def run(residents: pa.Table, profile: pa.Table) -> pa.Table:
        if not residents.num_rows:
            return _result("", [])
        lang, found = residents.column("lang")[0].as_py(), _vectors(residents)
        terms, totals = profile.column("terms")[0].values, profile.column("totals")[0].values.to_numpy()
        q, rows = share(totals + 2, profile.column("divisor")[0].as_py()), []
        spread, other = np.empty(len(terms), np.int64), np.empty(len(terms), np.int64)
        for i, a in enumerate(found):
            a.spread(spread)
            for b in found[:i]:
                rows += _both(a, b, distance(a, b, spread, b.spread(other)))
            over = a.p > q[a.slots]
            slots, value = a.slots[over], gap(a.p[over], q[a.slots[over]])
            if len(value) > top:  # the heap sees only what can reach it, ties among them
                some = value >= np.partition(value, -top)[-top]
                slots, value = slots[some], value[some]
            for v, slot in heapq.nsmallest(top, zip((-value).tolist(), slots.tolist())):
                rows.append((a.source, "term", terms[slot].as_py(), -v))
        return _result(lang, rows)

    return run


def _meeting(residents: pa.Table, peers: pa.Table) -> pa.Table:
    """All pairs of a cell and the one that has come to it."""
    if not residents.num_rows or not peers.num_rows:
        return _result("", [])
    size = residents.column("slots")[0].as_py()
    spread, other, rows = np.empty(size, np.int64), np.empty(size, np.int64), []
    found = _vectors(residents)
    for a in _vectors(peers):
        a.spread(spread)
        for b in found:
            rows += _both(a, b, distance(a, b, spread, b.spread(other)))
    return _result(residents.column("lang")[0].as_py(), rows)


def partner(cell, cells, turn):
    """Whom ``cell`` of an even number of cells meets in a turn from 1 to ``cells - 1``: the circle method, the last cell standing still."""
    last = cells - 1
    other = F.when(cell == last, F.pmod(turn * (cells / 2).cast("int"), last)).otherwise(F.pmod(turn - cell, last))
    return F.when(cell == other, last).otherwise(other).cast("int")


def _packer(batches):
    for batch in batches:
        out = []
        for entries in batch.column("entries"):
            slots, counts = (entries.values.field(i).to_numpy() for i in (0, 1))
            order = np.argsort(slots)
            out.append(pack(slots[order].astype(np.int64), counts[order]))
        yield pa.record_batch({**{c: batch.column(c) for c in ("lang", "block", "source", "n")}, "packed": pa.array(out, pa.binary())})


def source_divergence(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", least_docs: int = LEAST_DOCS, top: int = TOP_TERMS, block_terms: int = BLOCK_TERMS, cell_sources: int = CELL_SOURCES) -> DataFrame:
    """Distances of the sources of each language, and the terms that set a source apart.

    Returns ``lang, source, part, item, value, rank``. Part ``pair`` has a row for each other
    source of the language, part ``term`` the ``top`` terms that a source uses more than the
    language as a whole. Ranks go by value, descending, then by item.

    Null text, language and source count as empty. A repeated row is a document like any
    other. A language without kept terms has distances of 0 and no terms; a source without
    terms has a distance to all others. An empty table gives an empty result. Other columns
    are ignored, whatever their names. Counts are exact below 9e13 occurrences of a term.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "divergence")
    named = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(n) for c, n in ((lang_col, "lang"), (source_col, "source"), (text_col, "text"))]
    rows = docs.select(*named)
    counted = rows.select("lang", "source", F.col("text").cast("binary").alias("text")).mapInArrow(_count, "lang string, source string, term string, n long, docs long")
    counts = scratch.table(counted.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")), "counts")
    kept = scratch.table(counts.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("total")).filter(F.col("docs") >= least_docs).select("lang", "term", "total"), "kept")

    # Each language's size decides on its blocks; of a block, terms get places in the order of their bytes.
    langs = rows.groupBy("lang").agg(F.countDistinct("source").alias("sources"))
    sizes = kept.groupBy("lang").agg(F.count("*").alias("terms"), F.sum("total").alias("total"))
    sizes = langs.join(sizes, "lang", "left").select("lang", "sources", F.coalesce("terms", F.lit(0)).alias("terms"), F.coalesce("total", F.lit(0)).alias("total"))
    sizes = scratch.table(sizes.withColumn("blocks", F.greatest(F.lit(1), F.ceil(F.col("terms") / block_terms)).cast("int")), "sizes")
    block = F.pmod(F.xxhash64("term"), "blocks").cast("int")
    placed = kept.join(sizes.select("lang", "blocks"), "lang").select("lang", "term", "total", block.alias("block"))
    placed = scratch.table(placed.withColumn("slot", F.row_number().over(Window.partitionBy("lang", "block").orderBy("term")) - 1), "placed")

    entries = counts.select("lang", "source", "term", "n").join(placed.select("lang", "term", "block", "slot"), ["lang", "term"])
    entries = entries.groupBy("lang", "block", "source").agg(F.collect_list(F.struct("slot", "n")).alias("entries"), F.sum("n").alias("n"))
    packed = scratch.table(entries.mapInArrow(_packer, "lang string, block int, source string, n long, packed binary"), "packed")
    scratch.drop("counts", "kept")

    # Every source has a row in every block of its language, terms or not.
    slots = placed.groupBy("lang", "block").agg(F.count("*").cast("int").alias("slots"))
    weight = packed.groupBy("lang", "block").agg(F.sum(F.length("packed")).alias("bytes")).groupBy("lang").agg(F.max("bytes").alias("bytes"))
    cells = F.greatest(F.ceil(F.col("sources") / F.greatest(F.lit(cell_sources), F.ceil(F.col("sources") / MOST_CELLS))), F.ceil(F.coalesce("bytes", F.lit(0)) / CELL_BYTES))
    dealt = scratch.table(sizes.join(weight, "lang", "left").withColumn("cells", (F.ceil(cells / 2) * 2).cast("int")), "dealt")
    sums = packed.groupBy("lang", "source").agg(F.sum("n").alias("n"))
    groups = rows.select("lang", "source").distinct().join(dealt.select("lang", "terms", "blocks", "cells"), "lang").join(sums, ["lang", "source"], "left")
    groups = groups.select("lang", "source", (F.coalesce("n", F.lit(0)) + 2 * F.col("terms")).alias("divisor"), "cells", F.pmod(F.xxhash64("source"), "cells").cast("int").alias("cell"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
    vectors = groups.join(packed.select("lang", "block", "source", "packed"), ["lang", "block", "source"], "left").join(slots, ["lang", "block"], "left")
    # Where a language has no terms at all nothing is divided.
    vectors = vectors.select("lang", "block", "cell", "cells", "source", F.greatest("divisor", F.lit(1)).alias("divisor"), F.coalesce("slots", F.lit(0)).alias("slots"), "packed")

    plan = dealt.agg(F.max("cells").alias("cells"), F.sum(F.col("cells").cast("long") * F.col("blocks")).alias("places")).first()
    if not plan.cells:
        return spark.createDataFrame([], _RESULT + ", rank int")
    at = ["lang", "block", "cell"]
    home = scratch.bucketed(vectors, "home", min(8192, max(8, plan.places // 8)), at)
    try:
        profile = placed.groupBy("lang", "block").agg(F.sort_array(F.collect_list(F.struct("slot", "term", "total"))).alias("x"))
        profile = profile.select("lang", "block", F.col("x.term").alias("terms"), F.col("x.total").alias("totals"))
        empty = F.array().cast("array<string>"), F.array().cast("array<long>")
        profile = dealt.select("lang", "cells", (F.col("total") + 2 * F.col("terms")).alias("divisor"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block")).join(profile, ["lang", "block"], "left")
        profile = profile.select("lang", "block", F.explode(F.sequence(F.lit(0), F.col("cells") - 1)).alias("cell"), F.greatest("divisor", F.lit(1)).alias("divisor"), *(F.coalesce(c, e).alias(c) for c, e in zip(("terms", "totals"), empty)))
        found = [scratch.table(home.groupBy(at).cogroup(profile.groupBy(at)).applyInArrow(_at_home(top), _RESULT), "round-0")]
        for turn in range(1, plan.cells):
            met = home.filter(F.col("cells") > turn).withColumn("other", partner(F.col("cell"), F.col("cells"), F.lit(turn)))
            # One of the two is the host, by turns the lower and the higher one.
            hosts = (F.col("cell") < F.col("other")) == F.lit(turn % 2 == 1)
            peers = met.filter(~hosts).select("lang", "block", F.col("other").alias("cell"), "source", "packed", "divisor")
            met = met.filter(hosts).select(*at, "source", "packed", "divisor", "slots")
            found.append(scratch.table(met.groupBy(at).cogroup(peers.groupBy(at)).applyInArrow(_meeting, _RESULT), f"round-{turn}"))
    finally:
        scratch.unbucket()

    parts = spark.read.schema(found[0].schema).parquet(*(scratch.path(f"round-{i}") for i in range(len(found))))
    # A pair has a row of each block, a term one.
    summed = parts.groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))
    rank = F.row_number().over(Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item"))
    return summed.withColumn("rank", rank).filter((F.col("part") == "pair") | (F.col("rank") <= top))


def op11_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_divergence(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP11_SQL = r"""
WITH d AS (
    SELECT row_number() OVER () AS doc, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents
), grp AS (
    SELECT DISTINCT lang, source FROM d
), tok AS (
    SELECT doc, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d
), cnt AS (
    SELECT lang, source, term, count(*) AS n, count(DISTINCT doc) AS docs FROM tok GROUP BY ALL
), kept AS (
    SELECT lang, term, CAST(sum(n) AS BIGINT) AS total FROM cnt GROUP BY ALL HAVING sum(docs) >= 10
), size AS (
    SELECT lang, count(*) AS v, CAST(sum(total) AS BIGINT) AS n FROM kept GROUP BY lang
), gn AS (
    SELECT lang, source, CAST(sum(cnt.n) AS BIGINT) AS n FROM cnt JOIN kept USING (lang, term) GROUP BY ALL
), p AS (
    SELECT grp.lang, grp.source, kept.term, coalesce(cnt.n, 0) AS n,
           1 + (1000000000 * CAST(coalesce(cnt.n, 0) + 2 AS HUGEINT)) // (coalesce(gn.n, 0) + 2 * size.v) AS p,
           1 + (1000000000 * CAST(kept.total + 2 AS HUGEINT)) // (size.n + 2 * size.v) AS q
    FROM grp JOIN kept USING (lang) JOIN size USING (lang)
    LEFT JOIN gn ON gn.lang = grp.lang AND gn.source = grp.source
    LEFT JOIN cnt ON cnt.lang = grp.lang AND cnt.source = grp.source AND cnt.term = kept.term
), pair AS (
    SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) AS value
    FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
), parts AS (
    SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(value, 0) AS BIGINT) AS value
    FROM grp a JOIN grp b ON a.lang = b.lang AND a.source <> b.source
    LEFT JOIN pair ON pair.lang = a.lang AND pair.source = a.source AND pair.item = b.source
    UNION ALL
    SELECT lang, source, 'term', term, CAST(((p - q) * (p - q)) // (p + q) AS BIGINT) FROM p WHERE n > 0 AND p > q
), ranked AS (
    SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM parts
)
SELECT lang, source, part, item, value, rank FROM ranked WHERE part = 'pair' OR rank <= 10
"""
