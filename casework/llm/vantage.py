"""Nearest neighbours by vantage-point trees, one per shard, with relaxed pruning.

A small vantage-point tree of a bounded sample deals all vectors to shards: what lies in one
region goes together, and regions with many rows are split further by hash. Every shard
holds a vantage-point tree of its own over all of its vectors; the trees form a bucketed
table, the index. A query first searches the shards of its own region, which bounds the
distance of its ``k``-th neighbour, then all others that this bound leaves open.

A region at least ``g`` away from the query, by the triangle inequality, is left out if
``factor * g`` exceeds the bound. With a factor of one nothing nearer can be there and the
search is exact; larger factors leave out more. Distances are compared in double precision,
and bounds from the triangle inequality give way to rounding.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Scratch

#: Neighbours of a query, and queries: rows whose id this divides.
NEIGHBOURS = 10
EVERY = 100
#: Factor of the pruning; see README for its recall.
FACTOR = 4.0
#: Vectors of a shard, on average at most; of a tree's leaf; and rows of the sample that the regions are made from.
SHARD_ROWS = 8192
LEAF_ROWS = 128
SAMPLE_ROWS = 16_384
#: Sample rows in a region at least.
REGION_SAMPLE = 32
#: Components of the queries that go round together at most, and of the pairs that are measured together.
PASS_VALUES = 1 << 24
BLOCK_VALUES = 1 << 22
#: Rounding of a distance, relative to the larger of two that are compared.
SLACK = 1e-9
_LAST = np.iinfo(np.int64).max


def exact(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distances of rows in double precision."""
    with np.errstate(over="ignore", invalid="ignore"):
        return np.sqrt(((a - b) ** 2).sum(-1))


class Tree:
    """A vantage-point tree over the rows of ``x``; row ``order[start]`` of a node is its vantage point.

    ``nodes``: start, end, first child or -1; the second child is the next one.
    ``ranges``: least and largest distance of a node's rows from its parent's vantage point.
    """

    def __init__(self, x: np.ndarray, leaf: int = LEAF_ROWS):
        self.order = np.arange(len(x))
        nodes, ranges, todo = [[0, len(x), -1]], [[0.0, 0.0]], [0]
        while todo:
            i = todo.pop()
            start, end, _ = nodes[i]
            if end - start <= max(leaf, 2):
                continue
            rows = self.order[start:end]
            # The row farthest from the first one: from there the others spread most.
            far = int(exact(x[rows], x[rows[0]]).argmax())
            rows[[0, far]] = rows[[far, 0]]
            d = exact(x[rows[1:]], x[rows[0]])
            by = np.argsort(d, kind="stable")
            rows[1:], d = rows[1:][by], d[by]
            half = (len(d) + 1) // 2
            nodes[i][2] = len(nodes)
            for a, b in ((0, half), (half, len(d))):
                todo.append(len(nodes))
                nodes.append([start + 1 + a, start + 1 + b, -1])
                ranges.append([float(d[a]), float(d[b - 1])])
        self.nodes, self.ranges = np.array(nodes, np.int32), np.array(ranges, np.float64)


class Nearest:
    """The nearest ``k`` rows found for each of many queries: distances, ids, row keys, in order."""

    def __init__(self, m: int, k: int, bound: np.ndarray):
        self.d, self.id, self.row, self.bound = np.full((m, k), np.inf), np.full((m, k), _LAST), np.full((m, k), -1), bound

    def add(self, q: np.ndarray, d: np.ndarray, ids: np.ndarray, rows: np.ndarray) -> None:
        """Candidates of the queries ``q``, a line of ``d`` each; -1 as a row stands for none."""
        k = self.d.shape[1]
        d, ids, rows = (np.concatenate([old[q], new], 1) for old, new in ((self.d, d), (self.id, ids), (self.row, rows)))
        best = np.lexsort((rows, ids, rows < 0, d), 1)[:, :k]
        self.d[q], self.id[q], self.row[q] = (np.take_along_axis(v, best, 1) for v in (d, ids, rows))
        full = self.row[q, k - 1] >= 0
        self.bound[q[full]] = np.minimum(self.bound[q[full]], self.d[q[full], k - 1])


class Shard:
    """A tree with its vectors, ids and row keys in the tree's order."""

    def __init__(self, x: np.ndarray, ids: np.ndarray, rows: np.ndarray, nodes: np.ndarray, ranges: np.ndarray):
        self.x, self.ids, self.rows, self.nodes, self.ranges = x, ids, rows, nodes, ranges
        with np.errstate(over="ignore"):
            self.square = (x**2).sum(1)

    def _near(self, start: int, end: int, v: np.ndarray, own: np.ndarray, q: np.ndarray, found: Nearest) -> None:
        """Hold the rows from ``start`` to ``end`` against the queries ``q``. A product of matrices rules out most pairs, with room for its rounding; the rest are measured as such."""
        x, ids, rows = self.x[start:end], self.ids[start:end], self.rows[start:end]
        step = max(1, BLOCK_VALUES // max(1, x.size))
        for a in range(0, len(q), step):
            some = q[a : a + step]
            with np.errstate(over="ignore", invalid="ignore"):
                sums = (v[some] ** 2).sum(1)[:, None] + self.square[start:end]
                rough = sums - 2 * (v[some] @ x.T)
                pair = ~(rough > (found.bound[some] ** 2)[:, None] * (1 + SLACK) + sums * 1e-15 * (x.shape[1] + 8)) & (own[some][:, None] != rows)
            at, to = np.nonzero(pair)
            if not len(at):
                continue
            d = np.full(pair.shape, np.inf)
            real = exact(v[some[at]], x[to])
            d[at, to] = real
            # Only lines with a candidate are sorted, and of these only columns with one.
            lines, columns = np.unique(at), np.unique(to)
            keys = np.where(pair, rows, -1)[np.ix_(lines, columns)]
            found.add(some[lines], d[np.ix_(lines, columns)], np.broadcast_to(ids[columns], keys.shape), keys)

    def search(self, v: np.ndarray, own: np.ndarray, bound: np.ndarray, k: int, factor: float) -> Nearest:
        """The nearest ``k`` rows within ``bound`` of each query, its own row aside."""
        found = Nearest(len(v), k, bound.copy())
        # Down to one leaf first, whose rows bound the distance.
        first, todo = Nearest(len(v), k, bound.copy()), [(0, np.arange(len(v)))]
        while todo:
            i, q = todo.pop()
            start, end, child = self.nodes[i]
            if child < 0:
                self._near(start, end, v, own, q, first)
                continue
            inner = exact(v[q], self.x[start]) <= (self.ranges[child, 1] + self.ranges[child + 1, 0]) / 2
            todo += [(c, q[side]) for c, side in ((child, inner), (child + 1, ~inner)) if side.any()]
        found.bound = first.bound
        # Then through the whole tree, with all queries for which a node is open.
        todo = [(0, np.arange(len(v)), np.zeros(len(v)))]
        while todo:
            i, q, least = todo.pop()
            bound = found.bound[q]
            with np.errstate(invalid="ignore"):
                open_ = ~(least * factor > bound + SLACK * (bound + least))
            q, least = q[open_], least[open_]
            if not len(q):
                continue
            start, end, child = self.nodes[i]
            if child < 0:
                self._near(start, end, v, own, q, found)
                continue
            self._near(start, start + 1, v, own, q, found)
            d = exact(v[q], self.x[start])
            for c in (child + 1, child):
                low, high = self.ranges[c]
                with np.errstate(invalid="ignore"):
                    todo.append((c, q, np.fmax(least, np.fmax(low - d, d - high))))
        return found


class Regions:
    """The sample's tree: which region a vector belongs to, and which regions are open to a query."""

    def __init__(self, sample: np.ndarray, regions: int):
        self.points: list[np.ndarray] = []
        self.radius: list[float] = []
        self.children: list[tuple[int, int]] = []  # a node's number, or -1 less a region's
        self.count = 0
        self.root = self._split(sample, regions)

    def _split(self, x: np.ndarray, regions: int) -> int:
        d = None
        if regions > 1 and len(x) >= 2 * REGION_SAMPLE:
            point = x[exact(x, x[0]).argmax()]
            d = exact(x, point)
            radius = float(np.median(d))
            inner = d <= radius
        if d is None or inner.all():  # equal vectors can't be told apart by distance
            self.count += 1
            return -self.count
        node = len(self.points)
        self.points.append(point)
        self.radius.append(radius)
        self.children.append((0, 0))
        half = regions // 2
        self.children[node] = (self._split(x[inner], regions - half), self._split(x[~inner], half))
        return node

    def region(self, x: np.ndarray) -> np.ndarray:
        out, todo = np.zeros(len(x), np.int32), [(self.root, np.arange(len(x)))]
        while todo:
            node, rows = todo.pop()
            if node < 0:
                out[rows] = -1 - node
                continue
            inner = exact(x[rows], self.points[node]) <= self.radius[node]
            todo += [(c, rows[side]) for c, side in zip(self.children[node], (inner, ~inner)) if side.any()]
        return out

    def open(self, v: np.ndarray, bound: np.ndarray, factor: float) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of query and region."""
        pairs, todo = [], [(self.root, np.arange(len(v)), np.zeros(len(v)))]
        while todo:
            node, q, least = todo.pop()
            with np.errstate(invalid="ignore"):
                some = ~(least * factor > bound[q] + SLACK * (bound[q] + least))
            q, least = q[some], least[some]
            if not len(q):
                continue
            if node < 0:
                pairs.append((q, np.full(len(q), -1 - node)))
                continue
            d = exact(v[q], self.points[node])
            gap = d - self.radius[node]
            todo += [(c, q, np.fmax(least, g)) for c, g in zip(self.children[node], (gap, -gap))]
        return tuple(np.concatenate(x) for x in zip(*pairs)) if pairs else (np.zeros(0, int), np.zeros(0, int))


def _matrix(column: pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _by_size(batch: pa.RecordBatch):
    """Parts of a batch whose vectors have one size."""
    sizes = np.diff(batch.column("v").offsets.to_numpy())
    for size in np.unique(sizes):
        yield int(size), (batch if (sizes == size).all() else batch.filter(pa.array(sizes == size)))


def _dealer(regions: Regions, size: int):
    """Adds each vector's region; those of another size than the sample's have regions of their own, below zero."""

    def run(batches):
        for batch in batches:
            for n, part in _by_size(batch):
                region = regions.region(_matrix(part.column("v"))) if n == size else np.full(part.num_rows, -n, np.int32)
                yield pa.record_batch({**{c: part.column(c) for c in part.schema.names}, "region": pa.array(region, pa.int32())})

    return run


def _planter(leaf: int):
    """All rows of a shard to its tree."""

    def run(table: pa.Table) -> pa.Table:
        x = _matrix(table.column("v"))
        tree = Tree(x, leaf)
        kept = table.take(pa.array(tree.order))
        return pa.table(
            {
                "region": kept.column("region").slice(0, 1),
                "shard": kept.column("shard").slice(0, 1),
                "size": pa.array([x.shape[1]], pa.int32()),
                "vectors": pa.array([kept.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False).tobytes()], pa.binary()),
                "ids": pa.array([kept.column("id").combine_chunks().fill_null(_LAST).to_numpy().tobytes()], pa.binary()),
                "keys": pa.array([kept.column("key").combine_chunks().to_numpy().tobytes()], pa.binary()),
                "nodes": pa.array([tree.nodes.tobytes()], pa.binary()),
                "ranges": pa.array([tree.ranges.tobytes()], pa.binary()),
            }
        )

    return run


_INDEX = "region int, shard int, size int, vectors binary, ids binary, keys binary, nodes binary, ranges binary"
_FOUND = "key long, query_id long, vec_id long, near long, score double"


def _searcher(kind: str, k: int, factor: float):
    """The queries that visit a shard against its tree."""

    def run(index: pa.Table, queries: pa.Table) -> pa.Table:
        out = [np.zeros(0, np.int64)] * 4 + [np.zeros(0)]
        if index.num_rows and queries.num_rows:
            blob = {c: index.column(c)[0].as_py() for c in index.column_names}
            read = lambda name, type_: np.frombuffer(blob[name], type_)
            shard = Shard(read("vectors", kind).astype(np.float64).reshape(-1, blob["size"]), read("ids", np.int64), read("keys", np.int64), read("nodes", np.int32).reshape(-1, 3), read("ranges", np.float64).reshape(-1, 2))
            own, ids = (queries.column(c).combine_chunks().to_numpy() for c in ("key", "id"))
            found = shard.search(_matrix(queries.column("v")), own, queries.column("bound").combine_chunks().to_numpy(), k, factor)
            at = np.nonzero(found.row >= 0)
            out = [own[at[0]], ids[at[0]], found.id[at], found.row[at], found.d[at]]
        names = ("key", "query_id", "vec_id", "near", "score")
        return pa.table({n: pa.array(v) for n, v in zip(names, out)})

    return run


def _opener(regions: Regions, size: int, factor: float):
    """Each query with the regions that are open to it beside its own."""

    def run(batches):
        for batch in batches:
            for n, part in _by_size(batch):
                if n != size:
                    continue  # a region of its own, which it has searched
                v, bound = _matrix(part.column("v")), part.column("bound").to_numpy(zero_copy_only=False)
                q, region = regions.open(v, bound, factor)
                other = region != part.column("region").to_numpy()[q]
                some = part.take(pa.array(q[other]))
                yield pa.record_batch({**{c: some.column(c) for c in ("key", "id", "v", "bound")}, "region": pa.array(region[other], pa.int32())})

    return run


def nearest_neighbours(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", every: int = EVERY, k: int = NEIGHBOURS, factor: float = FACTOR, shard_rows: int = SHARD_ROWS, leaf_rows: int = LEAF_ROWS, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """The nearest ``k`` rows of every query, a row whose id ``every`` divides, among all other rows.

    Returns ``query_id, rank, vec_id, score``: the Euclidean distance in double precision,
    ties by the smaller ``vec_id``. With ``factor`` one the result is exact.

    Vectors that are null, empty, all zeros, or hold null or non-finite components take no
    part. A vector's candidates are those of its own length. Of rows that repeat, or share
    an id, each is a candidate of its own, and a query of its own where the id says so; a
    row without an id is a candidate that comes last among ties. Fewer candidates than
    ``k`` are all returned. An empty table gives an empty result. Other columns are ignored,
    whatever their names.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark, "vantage")
    type_ = "double" if vectors.schema[vector_col].dataType.elementType.simpleString() == "double" else "float"
    v = F.col(vector_col).cast(f"array<{type_}>")
    sound = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(math.inf))) & F.exists(v, lambda x: x != 0)
    rows = vectors.filter(sound).select(F.monotonically_increasing_id().alias("key"), F.col(id_col).cast("long").alias("id"), v.alias("v"))
    rows = scratch.table(rows, "rows")  # from here on a row keeps its key

    # Regions from a sample of bounded expected size, of the commonest length; repeats count once.
    common = rows.groupBy(F.size("v").alias("size")).count().orderBy(F.desc("count"), "size").first()
    none = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    if common is None:
        return none
    total, size = common["count"], common["size"]
    chance = min(1.0, sample_rows / total)
    sample = rows.filter((F.size("v") == size) & (F.pmod(F.xxhash64("id", "v"), F.lit(1 << 30)) < int(chance * (1 << 30)))).select("v").distinct()
    sample = sample.orderBy(F.xxhash64("v"), "v").limit(2 * sample_rows).toArrow()
    regions = Regions(_matrix(sample.column("v")), math.ceil(total / shard_rows)) if sample.num_rows else None
    if regions is None:  # by chance nothing of a small table was drawn
        regions = Regions(np.array([rows.filter(F.size("v") == size).first()["v"]], np.float64), 1)

    # At most ``sample_rows / REGION_SAMPLE`` vantage points go to the tasks.
    dealt = scratch.table(rows.mapInArrow(_dealer(regions, size), f"key long, id long, v array<{type_}>, region int"), "dealt")
    scratch.drop("rows")
    split = scratch.table(dealt.groupBy("region").agg(F.ceil(F.count("*") / shard_rows).cast("int").alias("shards")), "split")
    shards = dealt.join(split, "region").withColumn("shard", F.pmod(F.xxhash64("key"), "shards").cast("int"))
    at = ["region", "shard"]
    trees = shards.select("key", "id", "v", *at).groupBy(at).applyInArrow(_planter(leaf_rows), _INDEX)
    index = scratch.bucketed(scratch.table(trees, "trees"), "index", min(8192, max(8, math.ceil(total / shard_rows))), at)
    scratch.drop("trees")

    def visit(callers: DataFrame, name: str) -> DataFrame:
        """Every caller to all shards of its region."""
        going = callers.join(split, "region").select("key", "id", "v", "bound", "region", F.explode(F.sequence(F.lit(0), F.col("shards") - 1)).alias("shard"))
        kind = "float64" if type_ == "double" else "float32"
        return scratch.table(index.groupBy(at).cogroup(going.groupBy(at)).applyInArrow(_searcher(kind, k, factor), _FOUND), name)

    def best(found: DataFrame) -> DataFrame:
        order = Window.partitionBy("key").orderBy("score", "vec_id", "near")
        return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)

    def search(queries: DataFrame, i: int) -> list[DataFrame]:
        """What queries find in their own region, and in the others that this leaves open."""
        home = visit(queries, f"home-{i}")
        bounds = best(home).filter(F.col("rank") == k).select("key", F.col("score").alias("bound"))
        known = queries.drop("bound").join(bounds, "key", "left").withColumn("bound", F.coalesce("bound", F.lit(math.inf)))
        opened = known.mapInArrow(_opener(regions, size, factor), f"key long, id long, v array<{type_}>, bound double, region int")
        return [home, visit(opened, f"away-{i}")]

    try:
        queries = dealt.filter(F.col("id") % every == 0).withColumn("bound", F.lit(math.inf))
        # However many queries there are, those that meet in a shard fit in its task.
        passes = math.ceil((queries.agg(F.sum(F.size("v"))).first()[0] or 0) / PASS_VALUES)
        found = [rows_of for i in range(passes) for rows_of in search(queries.filter(F.pmod(F.xxhash64("key", F.lit("pass")), F.lit(passes)) == i), i)]
    finally:
        scratch.unbucket()
    if not found:
        return none
    result = best(reduce(DataFrame.unionByName, found)).withColumn("vec_id", F.when(F.col("vec_id") < _LAST, F.col("vec_id")))
    return result.select("query_id", "rank", "vec_id", "score")


def op12_vantage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest_neighbours(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
