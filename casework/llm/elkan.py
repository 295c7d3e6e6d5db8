"""Centroid clustering of integer vectors with Elkan's bounds.

Between rounds every vector keeps, in a table, the centroid that it belongs to, an upper
bound on the distance to it and a lower bound on the distance to each of the ``k``
centroids. When the centroids move the bounds move with them; a distance is computed only
where neither the bounds nor half the distance between two centroids show that the other
centroid is farther. Bounds are rounded away from the truth and compared strictly, so a tie
is always computed. Every distance that decides, and every sum, is an exact integer.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch

#: Components of a vector that takes part, units to one, centroids, and rounds.
SIZE = 64
SCALE = 64
CENTROIDS = 16
ROUNDS = 3
#: Components below this in size, of vectors and centroids alike, have squared distances that fit 64 bits; others are computed in Python's integers.
NARROW = 1 << 27
LARGEST = (1 << 63) - 1
#: Decimal digits of each of the three parts in which sums travel.
DIGITS = 18


def above(x):
    return np.nextafter(x, np.inf)


def below(x):
    return np.maximum(np.nextafter(x, -np.inf), 0.0)


def root_above(squares: np.ndarray) -> np.ndarray:
    """At least the square roots of integers, whatever their size."""
    return above(np.sqrt(above(squares.astype(np.float64))))


def root_below(squares: np.ndarray) -> np.ndarray:
    return below(np.sqrt(below(squares.astype(np.float64))))


def squares(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances, of integers of 64 bits or of Python's."""
    d = x - c
    return (d * d).sum(-1)


class Centroids:
    """The centroids of one round, how far they are from each other and how far they have moved."""

    def __init__(self, rows: list[list[int]], before: list[list[int]] | None = None):
        self.rows = rows
        self.narrow = all(abs(v) < NARROW for row in rows for v in row)
        self.wide_rows = np.array(rows, object)
        self.int_rows = np.array(rows, np.int64) if self.narrow else None
        k = len(rows)
        #: Half of the distance between two centroids, at most.
        self.half = np.array([root_below(squares(self.wide_rows, self.wide_rows[j])) / 2 for j in range(k)]).reshape(k, k)
        np.fill_diagonal(self.half, np.inf)
        #: How far each has moved, at least.
        self.moved = root_above(squares(self.wide_rows, np.array(before, object))) if before else np.zeros(k)

    def of(self, x: np.ndarray) -> np.ndarray:
        return self.wide_rows if x.dtype == object else self.int_rows


def assign(x: np.ndarray, centroids: Centroids, owner: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Each vector to its nearest centroid, the smaller number of equals: ``(owner, upper, lower, distances computed)``.

    An owner of -1 stands for none yet; ``upper`` and ``lower`` are bounds for the centroids of the round before.
    """
    rows, n, k = centroids.of(x), len(x), len(centroids.rows)
    owner, new, computed = owner.copy(), owner < 0, np.zeros(n, np.int64)
    owner[new] = 0
    upper = above(upper + centroids.moved[owner])
    upper[new] = np.inf
    lower = below(lower - centroids.moved)
    lower[new] = 0.0
    best = np.zeros(n, x.dtype)  # exact, where ``known``
    known = np.zeros(n, bool)

    def measure(at: np.ndarray, j: np.ndarray) -> np.ndarray:
        d = squares(x[at], rows[j])
        lower[at, j] = root_below(d)
        computed[at] += 1
        return d

    # Nothing nearer than half of the way to the next centroid: all of these stay as they are.
    todo = np.flatnonzero(~(upper < centroids.half.min(1)[owner]))
    for j in range(k):
        some = todo[owner[todo] != j]
        some = some[~(upper[some] < lower[some, j]) & ~(upper[some] < centroids.half[owner[some], j])]
        fresh = some[~known[some]]
        if len(fresh):  # the bound may be loose: first measure the way to the own centroid
            best[fresh] = measure(fresh, owner[fresh])
            known[fresh] = True
            upper[fresh] = root_above(best[fresh])
            some = some[~(upper[some] < lower[some, j]) & ~(upper[some] < centroids.half[owner[some], j])]
        if not len(some):
            continue
        d = measure(some, np.full(len(some), j))
        nearer = (d < best[some]) | ((d == best[some]) & (j < owner[some]))
        some, d = some[nearer], d[nearer]
        owner[some], best[some], upper[some] = j, d, root_above(d)
    return owner, upper, lower, computed


def _parts(batch: pa.RecordBatch, centroids: Centroids | None):
    """A batch as matrices of 64-bit integers and of Python's: ``(places in the batch, matrix)``."""
    wide = batch.column("wide").is_valid().to_numpy(zero_copy_only=False)
    some = np.flatnonzero(~wide)
    if len(some):
        x = batch.column("v").take(pa.array(some)).flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(some), -1)
        yield some, x if centroids is None or centroids.narrow else x.astype(object)
    some = np.flatnonzero(wide)
    if len(some):
        yield some, np.array([[int(v) for v in row] for row in batch.column("wide").take(pa.array(some)).to_pylist()], object)


_STATE = "id long, v array<int>, wide array<string>, owner int, upper double, lower array<double>, computed long"


def _assigner(centroids: Centroids, final: bool):
    def run(batches):
        k = len(centroids.rows)
        for batch in batches:
            if not batch.num_rows:
                continue
            n = batch.num_rows
            owner, upper = batch.column("owner").to_numpy().astype(np.int64), batch.column("upper").to_numpy()
            lower = batch.column("lower").flatten().to_numpy(zero_copy_only=False).reshape(n, k)
            distance, computed, lower_out = np.zeros(n, np.int64), batch.column("computed").to_numpy().copy(), np.zeros((n, k))
            owner, upper = owner.copy(), upper.copy()
            for at, x in _parts(batch, centroids):
                owner[at], upper[at], lower_out[at], more = assign(x, centroids, owner[at], upper[at], lower[at])
                computed[at] += more
                if final:
                    d = squares(x, centroids.of(x)[owner[at]])
                    distance[at] = np.minimum(d, LARGEST).astype(np.int64)
            out = {"id": batch.column("id"), "owner": pa.array(owner, pa.int32()), "computed": pa.array(computed)}
            if final:
                yield pa.record_batch({**out, "distance": pa.array(distance)})
                continue
            offsets = pa.array(np.arange(0, n * k + 1, k), pa.int32())
            out |= {"v": batch.column("v"), "wide": batch.column("wide"), "upper": pa.array(upper), "lower": pa.ListArray.from_arrays(offsets, pa.array(lower_out.ravel()))}
            yield pa.record_batch({c: out[c] for c in ("id", "v", "wide", "owner", "upper", "lower", "computed")})

    return run


def _summer(size: int, k: int):
    """Each centroid's vectors in this task, added up: a row for each component, the sum in three parts of ``DIGITS`` digits."""

    def run(batches):
        counts, sums = [0] * k, np.zeros((k, size), object)
        for batch in batches:
            owner = batch.column("owner").to_numpy()
            for at, x in _parts(batch, None):
                for j in np.unique(owner[at]).tolist():
                    mine = owner[at] == j
                    counts[j] += int(mine.sum())
                    sums[j] += x[mine].sum(0).astype(object)
        rows = [(j, i, counts[j], sums[j, i]) for j in range(k) if counts[j] for i in range(size)]
        base = 10**DIGITS
        columns = [[r[0] for r in rows], [r[1] for r in rows], [r[2] for r in rows], [r[3] % base for r in rows], [r[3] // base % base for r in rows], [str(r[3] // base**2) for r in rows]]
        kinds = (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.string())
        yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, kinds)], ["owner", "at", "n", "low", "middle", "high"])

    return run


def _next(state: DataFrame, rows: list[list[int]]) -> list[list[int]]:
    """The centroids that the owners of ``state`` lead to. The driver gets a row for each centroid and component."""
    size, k = len(rows[0]), len(rows)
    parts = state.select("owner", "v", "wide").mapInArrow(_summer(size, k), "owner int, at int, n long, low long, middle long, high string")
    wide = lambda c: F.sum(F.col(c).cast("decimal(38,0)")).alias(c)
    out = [list(row) for row in rows]
    for r in parts.groupBy("owner", "at").agg(F.sum("n").alias("n"), wide("low"), wide("middle"), wide("high")).collect():
        out[r.owner][r.at] = (int(r.low) + int(r.middle) * 10**DIGITS + int(r.high) * 10 ** (2 * DIGITS)) // r.n
    return out


def cluster(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", size: int = SIZE, scale: int = SCALE, centroids: int = CENTROIDS, rounds: int = ROUNDS) -> DataFrame:
    """Every kept vector with its cluster after ``rounds`` rounds and a last assignment.

    Kept are vectors of exactly ``size`` components, none null or non-finite, also after
    scaling; each becomes ``floor(scale * component)``. The first centroids are the vectors
    with the smallest SHA-256 of ``1:<id>``. A round assigns every vector to its nearest
    centroid, the smaller number of equals, and moves each centroid to the mean of its
    vectors, rounded down; one without vectors stays.

    Returns ``id_col, cluster, distance`` (squared), ``cluster_inertia``, ``inertia``,
    ``centroid_sha256`` and ``computed``, the number of distances that had to be computed.

    Repeated rows are vectors of their own and may all be first centroids. A row without an
    id is assigned like others and starts no centroid. Where fewer vectors have an id than
    there should be centroids, there are fewer; without any, or in an empty table, the
    result is empty. Values are exact whatever the size of a component; a result beyond 64
    bits is told as the largest such number. Other columns are ignored, whatever their names.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark, "elkan")
    scaled = F.transform(F.col(vector_col), lambda x: x.cast("double") * scale)
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), scaled.alias("x"))
    rows = rows.filter((F.size("x") == size) & F.forall("x", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(math.inf))))
    kept = rows.mapInArrow(_integers, "id long, v array<int>, wide array<string>")
    k_rows = kept.filter("id IS NOT NULL").orderBy(F.sha2(F.concat(F.lit("1:"), F.col("id").cast("string")), 256), "id", "v", "wide").limit(centroids).collect()
    now = [[int(v) for v in (r.wide or r.v)] for r in k_rows]
    schema = f"{id_col} long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string, computed long"
    if not now:
        return spark.createDataFrame([], schema)

    none = F.lit(-1).alias("owner"), F.lit(math.inf).alias("upper"), F.array_repeat(F.lit(0.0), len(now)).alias("lower"), F.lit(0).cast("long").alias("computed")
    state, before = kept.select("*", *none), None
    for i in range(rounds):
        state = scratch.table(state.mapInArrow(_assigner(Centroids(now, before), False), _STATE), f"round-{i}")
        if i:
            scratch.drop(f"round-{i - 1}")
        before, now = now, _next(state, now)
    last = scratch.table(state.mapInArrow(_assigner(Centroids(now, before), True), "id long, owner int, computed long, distance long"), "assigned")
    if rounds:
        scratch.drop(f"round-{rounds - 1}")

    # A row for each cluster, so at most as many as there are centroids.
    found = {r.owner: int(r.inertia) for r in last.groupBy("owner").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("inertia")).collect()}
    whole, told = sum(found.values()), lambda n: min(n, LARGEST)
    sha = [hashlib.sha256(",".join(map(str, row)).encode()).hexdigest() for row in now]
    facts = spark.createDataFrame([(j, told(n), told(whole), sha[j]) for j, n in found.items()], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    joined = last.select(F.col("id").alias(id_col), F.col("owner").alias("cluster"), "distance", "computed").join(F.broadcast(facts), "cluster")
    return joined.select(id_col, "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256", "computed")


def _integers(batches):
    """Scaled components rounded down: as integers, or as decimal text where one of the vector's is large."""
    for batch in batches:
        if not batch.num_rows:
            continue
        x = np.floor(batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1))
        wide = (np.abs(x) >= NARROW).any(1)
        small = np.where(wide[:, None], 0, x).astype(np.int32)
        offsets = pa.array(np.arange(0, x.size + 1, x.shape[1]), pa.int32())
        large = [[str(int(c)) for c in row] if w else None for row, w in zip(x, wide)] if wide.any() else [None] * len(x)
        yield pa.record_batch({"id": batch.column("id"), "v": pa.ListArray.from_arrays(offsets, pa.array(small.ravel())), "wide": pa.array(large, pa.list_(pa.string()))})


def op13_elkan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster(spark.read.parquet(f"{sf_dir}/embeddings.parquet")).drop("computed")


def _round_sql(i: int) -> str:
    """Assignment to the centroids ``c<i>`` and the centroids that follow."""
    return f"""
, a{i} AS (
    SELECT n, cluster, distance FROM (
        SELECT n, j AS cluster, sum((v.x - c.x) * (v.x - c.x)) AS distance, row_number() OVER (PARTITION BY n ORDER BY sum((v.x - c.x) * (v.x - c.x)), j) AS r
        FROM v JOIN c{i} c USING (i) GROUP BY n, j
    ) WHERE r = 1
), m{i} AS (
    SELECT cluster, i, sum(x) AS s, count(*) AS k FROM v JOIN a{i} USING (n) GROUP BY cluster, i
), c{i + 1} AS (
    SELECT c.j, c.i, CASE WHEN s IS NULL THEN c.x ELSE (s - ((s % k) + k) % k) // k END AS x FROM c{i} c LEFT JOIN m{i} m ON m.cluster = c.j AND m.i = c.i
)"""


OP13_SQL = f"""
WITH e AS (
    SELECT row_number() OVER () AS n, vec_id, embedding FROM embeddings WHERE len(embedding) = {SIZE}
), u AS (
    SELECT n, unnest(range({SIZE})) AS i, unnest(embedding) AS x FROM e
), good AS (
    SELECT n FROM u GROUP BY n HAVING count(*) FILTER (WHERE x IS NULL OR isnan(x) OR isinf(x)) = 0
), v AS (
    SELECT n, i, CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT) AS x FROM u JOIN good USING (n)
), s AS (
    SELECT n, row_number() OVER (ORDER BY sha256('1:' || vec_id)) - 1 AS j FROM e JOIN good USING (n) WHERE vec_id IS NOT NULL
), c0 AS (
    SELECT j, i, CAST(x AS HUGEINT) AS x FROM s JOIN v USING (n) WHERE j < {CENTROIDS}
){"".join(map(_round_sql, range(ROUNDS + 1)))}, sha AS (
    SELECT j, sha256(string_agg(x, ',' ORDER BY i)) AS centroid_sha256 FROM c{ROUNDS} GROUP BY j
)
SELECT vec_id, CAST(cluster AS INTEGER) AS cluster, CAST(distance AS BIGINT) AS distance, CAST(sum(distance) OVER (PARTITION BY cluster) AS BIGINT) AS cluster_inertia,
       CAST(sum(distance) OVER () AS BIGINT) AS inertia, centroid_sha256
FROM a{ROUNDS} JOIN e USING (n) JOIN sha ON sha.j = cluster
"""
