"""Benchmark decontamination by pigeonhole edit matching.

A test item may occur in a document with up to ``k`` edits. Cut into ``k + 1`` pieces, one
piece at least is then in the document unchanged. An Aho-Corasick automaton finds all
pieces of all items in one pass over a document; where a piece hits, Myers' bit-parallel
algorithm computes the item's distance to the text around it.
"""

from __future__ import annotations

from collections import defaultdict

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import release, slices
from .myers import masks, search

#: Edits allowed, in hundredths of an item's characters.
ERROR_PERCENT = 5
#: Characters of items that one automaton holds on average. More items go in blocks, each with a pass over the documents.
BLOCK_CHARS = 1_000_000


def normalized(text):
    """Lower case, with every run of characters that are no letters or digits as one space; none at the ends."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(text.cast("string"), F.lit(""))), r"[^\p{L}\p{N}]+", " "))


def pieces(item: str, errors: int) -> list[tuple[int, str]]:
    """``errors + 1`` pieces of nearly equal length with their offsets."""
    n = len(item)
    cuts = [i * n // (errors + 1) for i in range(errors + 2)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:]) if a < b]


class Matcher:
    """Finds the items of one block in normalised texts."""

    def __init__(self, items: list[tuple[int, str]], error_percent: int):
        import ahocorasick

        self.items = []
        at: dict[str, list[tuple[int, int]]] = defaultdict(list)
        for key, text in items:
            errors = len(text) * error_percent // 100
            text = f" {text} "  # whole words
            self.items.append((key, text, errors, masks(text)))
            for offset, piece in pieces(text, errors):
                at[piece].append((len(self.items) - 1, offset))
        self.automaton = ahocorasick.Automaton()
        for piece, places in at.items():
            self.automaton.add_word(piece, (len(piece), places))
        self.automaton.make_automaton()
        self.known: dict[tuple[int, str], tuple[int, int]] = {}

    def _distance(self, i: int, window: str) -> tuple[int, int]:
        """Passages repeat over documents, so a bounded number of results is kept."""
        found = self.known.get((i, window))
        if found is None:
            if len(self.known) > 20_000:
                self.known.clear()
            found = self.known[i, window] = search(self.items[i][3], len(self.items[i][1]), window)
        return found

    def find(self, text: str) -> list[tuple[int, int, int]]:
        """``(item, distance, end)`` of every item in ``text``, at its best place."""
        text = f" {text} "
        starts: dict[int, set[int]] = defaultdict(set)
        for end, (length, places) in self.automaton.iter(text):
            for i, offset in places:
                starts[i].add(end + 1 - length - offset)
        out = []
        for i, places in starts.items():
            key, item, errors, _ = self.items[i]
            n, best = len(item), None
            ordered = sorted(places)
            while ordered:
                last = first = ordered.pop(0)
                while ordered and ordered[0] - last <= 2 * errors and ordered[0] - first <= n:
                    last = ordered.pop(0)
                low = max(0, first - errors)
                found, end = self._distance(i, text[low : last + n + errors])
                if found <= errors and (best is None or found < best[0]):
                    best = found, low + end - 2  # without the space before the text and that after the item
            if best:
                out.append((key, *best))
        return out


def _searcher(items: list[tuple[int, str]], error_percent: int):
    def run(batches):
        matcher = Matcher(items, error_percent) if items else None
        for batch in slices(batches):
            out = []
            for id_, text in zip(batch.column("id").to_pylist(), batch.column("text").to_pylist()):
                out += [(id_, *hit) for hit in (matcher.find(text) if matcher else ())]
            columns = list(zip(*out)) or [[]] * 4
            yield pa.record_batch([pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.int64(), pa.int32(), pa.int64()))], ["id", "item", "distance", "end"])
        matcher = None
        release()

    return run


def find_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", error_percent: int = ERROR_PERCENT) -> DataFrame:
    """One row per document and test item found in it: ``id_col``, ``item_col``, ``distance``, ``end``.

    Both sides are normalised to lower-case letters and digits with single spaces;
    ``distance`` counts edits of an item's characters there, at most ``error_percent``
    hundredths of its length, and ``end`` is where the best match ends in the normalised
    document. Items match as whole words, a letter more at an end being an edit; one too
    short for an edit matches only unchanged.
    Null or empty items match nothing, null or empty documents have no match. Repeated items
    and repeated rows are reported each. Rows with a null id are searched like others. Empty
    tables give an empty result; other columns are ignored, whatever their names.
    """
    items = benchmark.select(F.col(item_col).cast("long").alias("item"), normalized(F.col(item_text_col)).alias("text")).filter("text <> ''")
    chars = items.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = 1 + chars // BLOCK_CHARS
    rows = docs.select(F.col(id_col).cast("long").alias("id"), normalized(F.col(text_col)).alias("text"))
    found = None
    for block in range(blocks):  # each of about BLOCK_CHARS, whatever the number of items
        held = items.filter(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == block)
        hits = rows.mapInArrow(_searcher([(r.item, r.text) for r in held.collect()], error_percent), "id long, item long, distance int, end long")
        found = hits if found is None else found.unionByName(hits)
    return found.select(F.col("id").alias(id_col), F.col("item").alias(item_col), "distance", "end")


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
