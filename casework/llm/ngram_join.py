"""Exact Jaccard self-join of word n-gram sets by partitioning the universe of shingles.

Sets fall into bands of sizes so that a set can only be similar to sets of its own and the
neighbouring bands. Within a band, similar sets differ in at most ``H`` shingles. A hash
deals all shingles to ``H + 1 + S`` segments, so two similar sets agree exactly in
``1 + S`` segments at least. Every set is indexed by its segments.

What a segment costs in candidates is how many sets have it too. The allocation follows
that: the ``S`` dearest entries of each set are left out, as by the pigeonhole principle
two similar sets still share one of the others. An empty segment costs most and says
least; it has no entry and counts as one of the ``S``. A set with more empty segments than
that leaves out nothing, and indexes the segment after each empty one with its
one-deletion neighbourhood: what the pigeonhole loses by the empty one it gains there.

An entry that many sets still share, such as a piece of a common passage, makes no pairs.
Its sets are indexed again among themselves with four segments to a shingle, where so
many entries are spare that those of the passage are left out and only rare ones stay.

Sets that share an index entry are candidates. First each set is compared with one hub of
its entries, the set that it has most in common with; after that only candidates in
different components of links. Candidates are verified on their whole sets of 64-bit
shingle hashes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, bloom_join, may_contain, release, slices
from .components import connected_components, forest_roots
from .shingles import mix, shingle_sets

NO_ID = -(1 << 63)
#: Sets of an entry from which on its sets get the finer index.
HOT_SETS = 100
#: Words of 64 bits in the parity sketch of a set.
SKETCH_WORDS = 16


def band_ends(percent: int, most: int = 1 << 40) -> list[int]:
    """Largest sizes of the bands: a set of a band can be similar to no larger set than the next band has."""
    ends = [1]
    while ends[-1] < most:
        ends.append(max(ends[-1] + 1, ends[-1] * 100 // percent))
    return ends


def budget(end: int, percent: int) -> int:
    """The largest symmetric difference of two similar sets, the smaller one of at most ``end`` shingles."""
    return (end + end * 100 // percent) * (100 - percent) // (100 + percent)


def segments(end: int, percent: int, fine: bool = False) -> tuple[int, int]:
    """Segments of a band and how many dear entries a set may leave out; segments keep four shingles each or as many as the budget allows; in the finer index most segments have one or none."""
    h = budget(end, percent)
    m = max(h + 1, 4 * end if fine else min(h + 1 + h // 2, end // 4))
    return m, m - h - 1


def entries(shingles: np.ndarray, percent: int, ends: list[int], fine: bool = False) -> list[tuple[np.ndarray, int]]:
    """Index entries of one set, in the group of its own band and in that of the band below, each with the number of them that may be left out."""
    n = len(shingles)
    out = []
    if not n:
        return out
    band = int(np.searchsorted(ends, n))
    with np.errstate(over="ignore"):
        spread = mix(shingles * np.uint64(0xD6E8FEB86659FD93))
        for group in (band, band - 1):
            if group < 0 or not budget(ends[group], percent):
                continue  # only equal sets are similar there, and they are one set here
            m, spare = segments(ends[group], percent, fine)
            segment = (mix(shingles + np.uint64(group)) % np.uint64(m)).astype(np.int64)
            sums = np.zeros(m, np.uint64)
            np.add.at(sums, segment, spread)
            full = np.bincount(segment, minlength=m) > 0
            tags = mix((np.uint64(group) << np.uint64(40)) + np.arange(m, dtype=np.uint64))
            found = [mix(sums[full] ^ tags[full])]
            empty = np.flatnonzero(~full)
            if len(empty) > spare:
                for i in empty:
                    j = (i + 1) % m
                    near = np.concatenate([sums[j : j + 1], sums[j] - spread[segment == j]])
                    found.append(mix(near ^ mix(tags[i : i + 1] + tags[j])))
            out.append((np.unique(np.concatenate(found)), max(0, spare - len(empty))))
    return out


ENTRY = "array<struct<spare:int,entries:array<bigint>>>"
ENTRY_KIND = pa.list_(pa.struct([("spare", pa.int32()), ("entries", pa.list_(pa.int64()))]))


def _fine_index(percent: int):
    ends = band_ends(percent)

    def run(batches):
        for batch in batches:
            sets = [s.values.to_numpy().view(np.uint64) for s in batch.column("shingles")]
            groups = [[{"spare": spare, "entries": e.view(np.int64)} for e, spare in entries(s, percent, ends, fine=True)] for s in sets]
            yield pa.record_batch({"id": batch.column("id"), "n": pa.array([len(s) for s in sets], pa.int64()), "groups": pa.array(groups, ENTRY_KIND)})

    return run


def _allocate(scratch: Scratch, name: str, indexed: DataFrame) -> DataFrame:
    """``entry, id, n``: the entries of ``indexed`` (a table ``id, n, groups``) that sets share, less the dearest of each set as far as it can spare them."""
    places = indexed.select("id", "n", F.posexplode("groups").alias("side", "g")).select("id", "n", "side", F.col("g.spare").alias("spare"), F.explode("g.entries").alias("entry"))
    # Most entries have one set; they are counted where they lie, and a bitmap of the others keeps them out of the join.
    common = scratch.table(places.groupBy("entry").agg(F.count("*").alias("sets")).filter("sets > 1"), f"{name}-common")
    shared = scratch.table(may_contain(places, common, "entry").join(common, "entry"), f"{name}-shared")
    dear = F.row_number().over(Window.partitionBy("id", "n", "side").orderBy(F.desc("sets"), F.desc("entry")))
    kept = scratch.table(shared.withColumn("dear", dear).filter("dear > spare").select("entry", "id", "n"), f"{name}-kept")
    scratch.drop(f"{name}-common", f"{name}-shared")
    return kept


def _index(k: int, percent: int):
    ends = band_ends(percent)

    def run(batches):
        for batch in slices(batches):
            sets = shingle_sets(batch.column("text"), k)
            with np.errstate(over="ignore"):
                first = [int(s.sum(dtype=np.uint64)) if len(s) else 0 for s in sets]
                second = [int(mix(s).sum(dtype=np.uint64)) if len(s) else 0 for s in sets]
            groups = [[{"spare": spare, "entries": e.view(np.int64)} for e, spare in entries(s, percent, ends)] for s in sets]
            yield pa.record_batch(
                {
                    "id": batch.column("id"),
                    "n": pa.array([len(s) for s in sets], pa.int64()),
                    "s1": pa.array(np.array(first, np.uint64).view(np.int64)),
                    "s2": pa.array(np.array(second, np.uint64).view(np.int64)),
                    "groups": pa.array(groups, ENTRY_KIND),
                }
            )
        release()

    return run


def _parity(shingles: np.ndarray, bits: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        counts = np.bincount((mix(shingles * np.uint64(0xA0761D6478BD642F)) % np.uint64(bits)).astype(np.int64), minlength=bits)
    return np.packbits((counts & 1).astype(np.uint8))


def sketch(shingles: np.ndarray) -> np.ndarray:
    """Parity of the number of shingles in each of ``64 * SKETCH_WORDS`` buckets. The sketches of two sets differ in no more bits than the sets in shingles."""
    return _parity(shingles, 64 * SKETCH_WORDS).view(np.int64)


def wide_sketch(shingles: np.ndarray) -> bytes:
    """The same in two to four buckets per shingle, a power of two, for a thirtieth of the set's size."""
    return _parity(shingles, 1 << max(10, (2 * len(shingles) - 1).bit_length())).tobytes()


def wide_difference(x: bytes, y: bytes) -> int:
    """Bits in which two wide sketches differ; the wider one is folded to the width of the other."""
    u, v = np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8)
    while len(u) != len(v):
        u, v = (u, v) if len(u) > len(v) else (v, u)
        u = u[: len(u) // 2] ^ u[len(u) // 2 :]
    return int(np.bitwise_count(u ^ v).sum())


def _compare_wide(percent: int):
    def run(batches):
        for batch in batches:
            keep = [wide_difference(x, y) * (100 + percent) <= (m + n) * (100 - percent) for x, y, m, n in zip(*(batch.column(c).to_pylist() for c in ("x", "y", "m", "n")))]
            yield batch.select(["a", "b", "c", "d"]).filter(pa.array(keep, pa.bool_()))
        release()

    return run


def _sets(k: int):
    def run(batches):
        for batch in slices(batches):
            sets = shingle_sets(batch.column("text"), k)
            yield pa.record_batch(
                {
                    "id": batch.column("id"),
                    "size": pa.array([len(s) for s in sets], pa.int64()),
                    "sketch": pa.array([sketch(s) for s in sets], pa.list_(pa.int64())),
                    "wide": pa.array([wide_sketch(s) for s in sets], pa.binary()),
                    "shingles": pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64())),
                }
            )
        release()

    return run


def _verify(percent: int):
    def similar(x: np.ndarray, y: np.ndarray) -> bool:
        common = len(np.intersect1d(x, y, assume_unique=True))
        return bool(common) and 100 * common >= percent * (len(x) + len(y) - common)

    def run(batches):
        for batch in batches:
            x, y = batch.column("x"), batch.column("y")
            keep = [similar(x[i].values.to_numpy(), y[i].values.to_numpy()) for i in range(batch.num_rows)]
            yield batch.select([c for c in batch.schema.names if c not in "xy"]).filter(pa.array(keep, pa.bool_()))
        release()

    return run


def _links(scratch: Scratch, name: str, pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs ``a, b`` (and what else they carry) that are similar, each once."""
    pairs = scratch.table(pairs.distinct(), name)
    loaded = pairs.join(sets.select(F.col("id").alias("a"), F.col("shingles").alias("x")), "a").join(sets.select(F.col("id").alias("b"), F.col("shingles").alias("y")), "b")
    return loaded.mapInArrow(_verify(percent), ", ".join(f"{c} long" for c in ["b", "a", *pairs.columns[2:]])).distinct()


def _likely_pairs(scratch: Scratch, named: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs ``a, b`` of sets that share an entry of ``named`` and lie in different components ``c, d``, less those whose sketches differ in more bits than similar sets may in shingles. The join itself compares the sketches, so the others are no rows at any time."""
    words = [f"w{i}" for i in range(SKETCH_WORDS)]
    mixed = named.groupBy("entry").agg(F.min("c").alias("low"), F.max("c").alias("high")).filter("low < high").select("entry")
    drawn = sets.select("id", "size", *(F.col("sketch")[i].alias(w) for i, w in enumerate(words)))
    own = scratch.table(named.select("entry", "id", "c").join(mixed, "entry").join(drawn, "id").select("entry", "id", "c", "size", *words), "open")
    other = own.select("entry", F.col("id").alias("b"), F.col("c").alias("d"), F.col("size").alias("other"), *(F.col(w).alias(f"v{w}") for w in words))
    differ = sum((F.bit_count(F.col(w).bitwiseXOR(F.col(f"v{w}"))) for w in words), F.lit(0))
    close = differ * (100 + percent) <= (F.col("size") + F.col("other")) * (100 - percent)
    return own.join(other, "entry").filter((F.col("id") < F.col("b")) & (F.col("c") != F.col("d")) & close).select(F.col("id").alias("a"), "b", "c", "d").distinct()


def _label(rows: DataFrame, components: DataFrame, column: str, name: str) -> DataFrame:
    """``rows`` with the component of ``column``, which is itself if it has no link."""
    found = components.select(F.col("node").alias(column), F.col("component").alias(name))
    return rows.join(found, column, "left").withColumn(name, F.coalesce(name, column))


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, percent: int = 90) -> DataFrame:
    """Per row ``id_col``, ``n_shingles`` and ``component_id``, the smallest id that links reach.

    Words are runs of characters other than ``[\\x20\\x09-\\x0D]`` with A-Z lower-cased; a
    text's set are its distinct ``words``-word shingles, or all its words as one if there
    are fewer. Two rows link when their sets' intersection is at least ``percent`` hundredths
    of the union. Null, empty and all-white texts have no shingles and link with nothing.
    Equal texts are one component. Rows without an id count as the smallest id and get a
    null ``component_id``. Rows that share an id keep a row each. An empty table gives an
    empty result; other columns are ignored, whatever their names.
    """
    scratch = Scratch(docs.sparkSession, "ngram-join")
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    full = scratch.table(rows.mapInArrow(_index(words, percent), f"id long, n long, s1 long, s2 long, groups {ENTRY}"), "full")
    indexed = scratch.table(full.drop("groups"), "indexed")

    # Equal sets are one set, under its smallest id.
    same = indexed.filter("n > 0").groupBy("s1", "s2").agg(F.min("id").alias("set_id"))
    first = scratch.table(indexed.filter("n > 0").select("id", "s1", "s2").join(same, ["s1", "s2"]).filter("id = set_id").select("s1", "s2", "id").distinct(), "first")
    once = scratch.table(full.select("id", "n", "s1", "s2", "groups").join(first, ["id", "s1", "s2"], "left_semi").select("id", "n", "groups"), "once")
    scratch.drop("full")
    kept = _allocate(scratch, "coarse", once)
    scratch.drop("once")

    sets = bloom_join(
        scratch, "sets", rows, scratch.table(kept.select("id").distinct().withColumn("n", F.lit(1)), "candidates").filter("n > 0").select("id"), "id",
        lambda joined: joined.select("id", "text").mapInArrow(_sets(words), "id long, size long, sketch array<long>, wide binary, shingles array<long>"),
    )
    # Pairs under a hot entry are pairs of the finer index, so the hot entries can go.
    hot = scratch.table(kept.groupBy("entry").agg(F.count("*").alias("sets")).filter(F.col("sets") >= HOT_SETS), "hot")
    in_hot = scratch.table(kept.join(hot, "entry").select("id").distinct().withColumn("n", F.lit(1)), "in-hot")
    again = bloom_join(
        scratch, "fine", sets.select("id", "shingles"), in_hot.filter("n > 0").select("id"), "id",
        lambda joined: joined.select("id", "shingles").mapInArrow(_fine_index(percent), f"id long, n long, groups {ENTRY}"),
    )
    kept = scratch.table(kept.join(hot.select("entry"), "entry", "left_anti").unionByName(_allocate(scratch, "fine", again)), "kept")
    scratch.drop("candidates", "hot", "in-hot", "fine", "coarse-kept", "fine-kept")

    close = F.greatest("n", "m") * percent <= F.least("n", "m") * 100
    hubs = kept.groupBy("entry").agg(F.min_by(F.struct("id", "n"), "id").alias("hub"), F.count("*").alias("sets")).filter("sets > 1").select("entry", F.col("hub.id").alias("hub"), F.col("hub.n").alias("m"))
    stars = kept.join(hubs, "entry").filter("id <> hub").filter(close).groupBy(F.col("hub").alias("a"), F.col("id").alias("b")).agg(F.count("*").alias("common"))
    best = stars.groupBy("b").agg(F.max_by("a", F.struct("common", -F.col("a"))).alias("a"))
    to_hubs = _links(scratch, "hub-pairs", best.select("a", "b"), sets, percent)
    near_hub = forest_roots(to_hubs.select(F.col("b").alias("node"), F.col("a").alias("parent")), scratch, "forest")
    # What is in one component needs no comparison; everything else that shares an entry and has a sketch near enough gets one. The links between components are then few.
    named = scratch.table(_label(kept, near_hub, "id", "c"), "named")
    likely = scratch.table(_likely_pairs(scratch, named, sets, percent), "sketched")
    # The short sketches of large sets say little; wide ones leave few pairs for which whole sets are moved.
    wide = lambda i, n, w: sets.select(F.col("id").alias(i), F.col("size").alias(n), F.col("wide").alias(w))
    likely = likely.join(wide("a", "m", "x"), "a").join(wide("b", "n", "y"), "b").select("a", "b", "c", "d", "m", "n", "x", "y")
    likely = scratch.table(likely.mapInArrow(_compare_wide(percent), "a long, b long, c long, d long"), "likely")
    ids = scratch.table(likely.select(F.explode(F.array("a", "b")).alias("id")).distinct().withColumn("n", F.lit(1)), "likely-ids")
    few = bloom_join(scratch, "likely-sets", sets.select("id", "shingles"), ids.filter("n > 0").select("id"), "id", lambda joined: joined)
    merged = connected_components(_links(scratch, "other-pairs", likely, few, percent).select(F.col("c").alias("a"), F.col("d").alias("b")), scratch, "merged")

    scratch.drop("sets", "kept", "hub-pairs", "named", "open", "sketched", "likely", "likely-ids", "likely-sets", "other-pairs")
    result = indexed.select("id", "n", "s1", "s2").filter("n > 0").join(same, ["s1", "s2"]).select("id", "n", "set_id").unionByName(
        indexed.filter("n = 0").select("id", "n", F.col("id").alias("set_id"))
    )
    result = _label(_label(result, near_hub, "set_id", "c"), merged, "c", "component")
    real = lambda c: F.nullif(F.col(c), F.lit(NO_ID))
    return result.select(real("id").alias(id_col), F.col("n").alias("n_shingles"), real("component").alias("component_id"))


def op10_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(spark.read.parquet(f"{sf_dir}/documents.parquet"))
