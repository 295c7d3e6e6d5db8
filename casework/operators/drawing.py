"""Draws that equal those of Python's generator, made in tasks, and rows numbered without one task for all.

A replicate's draws begin where the generator stands after the ones before. Its states are
found in one task that passes over the stream of words without keeping it, 2.5 kB for each
replicate; from there every replicate draws on its own.
"""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..session import written
from .review import simple_sample

#: Words of the generator that are looked at together.
BLOCK = 1 << 18


def numbered(rows: DataFrame, by: list[str], name: str = "number") -> DataFrame:
    """Adds the place of each row, from 0, in the order of the columns ``by``, which should tell rows apart. Ranges are sorted each on its own; only their sizes are added up."""
    parts = rows.repartitionByRange(*by).sortWithinPartitions(*by)
    parts = written(parts.withColumn("_part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))), "numbered")
    sizes = parts.groupBy("_part").agg(F.count("*").alias("_n"))
    before = sizes.select("_part", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))  # a row for each range
    return parts.join(F.broadcast(before), "_part").withColumn(name, F.col("_before") + F.col("_at")).drop("_part", "_at", "_before")


class Stream:
    """The words of Python's generator in whole blocks."""

    def __init__(self, seed: int | None = None, state: bytes | None = None):
        self.bits = np.random.MT19937()
        if state is None:
            key = random.Random(seed).getstate()[1]
            state = np.array(key, np.uint32).tobytes()
        words = np.frombuffer(state, np.uint32)
        self.bits.state = {"bit_generator": "MT19937", "state": {"key": words[:624].copy(), "pos": int(words[624])}}

    def state(self) -> bytes:
        s = self.bits.state["state"]
        return np.append(s["key"].astype(np.uint32), np.uint32(s["pos"])).tobytes()

    def below(self, n: int, count: int):
        """``count`` numbers below ``n`` in blocks, as ``randrange`` gives them: the top bits of each word, those too large left out."""
        if not 0 < n < 1 << 32:
            raise ValueError("numbers must be below 2^32")
        shift = np.uint64(32 - n.bit_length())
        while count:
            before = self.bits.state
            found = self.bits.random_raw(min(BLOCK, 2 * count + 16)) >> shift
            good = np.flatnonzero(found < n)
            if len(good) >= count:  # go back to just behind the last one that is used
                good = good[:count]
                self.bits.state = before
                self.bits.random_raw(int(good[-1]) + 1)
            if len(good):
                yield found[good].astype(np.int64)
            count -= len(good)


def replicate_states(spark: SparkSession, seed: int, size: int, replicates: int) -> DataFrame:
    """``replicate, state``: where the generator stands before each replicate of ``size`` draws below ``size``."""

    def run(batches):
        for _ in batches:
            pass
        stream = Stream(seed)
        for r in range(replicates):
            yield pa.record_batch({"replicate": pa.array([r], pa.int32()), "state": pa.array([stream.state()], pa.binary())})
            for _ in stream.below(size, size):
                pass

    return spark.range(0, 1, 1, 1).mapInArrow(run, "replicate int, state binary")


def bootstrap_draws(spark: SparkSession, seed: int, size: int, replicates: int) -> DataFrame:
    """``replicate, number, times``: how often each of ``size`` numbers is drawn in each replicate, with replacement. A number may have several rows."""

    def run(batches):
        for batch in batches:
            for replicate, state in zip(*(batch.column(c).to_pylist() for c in ("replicate", "state"))):
                for block in Stream(state=state).below(size, size):
                    number, times = np.unique(block, return_counts=True)
                    yield pa.record_batch({"replicate": pa.array(np.full(len(number), replicate), pa.int32()), "number": pa.array(number), "times": pa.array(times)})

    states = written(replicate_states(spark, seed, size, replicates), "states")
    return states.repartition(min(replicates, 4096), "replicate").mapInArrow(run, "replicate int, number long, times long")


#: Draws that one task holds of a range of numbers, two bytes each; a range has at most 65,536 numbers.
RANGE_DRAWS = 1 << 24


def drawn_sums(rows: DataFrame, seed: int, size: int, replicates: int, by: list[str], counts: list[str]) -> DataFrame:
    """``replicate, by, counts``: what the draws of each replicate sum up to. ``rows`` has ``number``, from 0 to below ``size``, and may have several rows for one.

    Draws go to the task of their range of numbers as two bytes each, where the rows of that
    range are: neither the rows nor the draws are ever together in one place.
    """
    width = max(256, min(1 << 16, RANGE_DRAWS // replicates))

    def deal(batches):
        for batch in batches:
            for replicate, state in zip(*(batch.column(c).to_pylist() for c in ("replicate", "state"))):
                for block in Stream(state=state).below(size, size):
                    block.sort()
                    at, first = np.unique(block // width, return_index=True)
                    places = [p.astype(np.uint16).tobytes() for p in np.split(block % width, first[1:])]
                    yield pa.record_batch({"replicate": pa.array(np.full(len(at), replicate), pa.int32()), "range": pa.array(at), "places": pa.array(places, pa.binary())})

    kinds = T.StructType([T.StructField("replicate", T.IntegerType()), *(rows.schema[c] for c in by), *(T.StructField(c, T.LongType()) for c in counts)])

    def add(draws: pa.Table, own: pa.Table) -> pa.Table:
        held = own.to_pandas()
        cell = held.groupby(by, dropna=False, sort=False).ngroup().to_numpy() if by else np.zeros(len(held), np.int64)
        _, first = np.unique(cell, return_index=True)
        place, worth = held["number"].to_numpy() % width, [held[c].to_numpy() for c in counts]
        times: dict[int, np.ndarray] = {}
        for replicate, places in zip(draws.column("replicate").to_pylist(), draws.column("places").to_pylist()):
            n = np.bincount(np.frombuffer(places, np.uint16), minlength=width)
            times[replicate] = times[replicate] + n if replicate in times else n
        sums = [[np.bincount(cell, weights=n[place] * w).round().astype(np.int64) for n in times.values()] for w in worth] if len(held) else [[] for _ in worth]
        some = own.select(by).take(pa.array(np.tile(first, len(times) if len(held) else 0)))
        columns = {"replicate": pa.array(np.repeat(list(times), len(first)), pa.int32()), **{c: some.column(c) for c in by}}
        return pa.table(columns | {c: pa.array(np.concatenate(s) if s else [], pa.int64()) for c, s in zip(counts, sums)})

    states = written(replicate_states(rows.sparkSession, seed, size, replicates), "states")
    draws = states.repartition(min(replicates, 4096), "replicate").mapInArrow(deal, "replicate int, range long, places binary")
    own = rows.select("number", *by, *(F.col(c).cast("long").alias(c) for c in counts)).withColumn("range", F.floor(F.col("number") / width))
    found = draws.groupBy("range").cogroup(own.groupBy("range")).applyInArrow(add, kinds)
    return found.groupBy("replicate", *by).agg(*(F.sum(c).alias(c) for c in counts))


def generator_sample(units: DataFrame, by: list[str], size: int, seed: int) -> DataFrame:
    """The units that ``random.Random(seed).sample`` takes from their list in the order of ``by``, with the probability of being taken and the weight. A task holds the ``size`` places, never the units."""
    rows = numbered(units, by, "_number")
    total = rows.count()
    if not 0 <= size <= total:
        raise ValueError("the sample is larger than the population")

    def run(batches):
        for _ in batches:
            pass
        places = random.Random(seed).sample(range(total), size)
        for a in range(0, size, BLOCK):
            yield pa.record_batch({"_number": pa.array(places[a : a + BLOCK], pa.int64())})

    places = units.sparkSession.range(0, 1, 1, 1).mapInArrow(run, "_number long")
    chance = size / total if total else 0.0
    drawn = rows.join(places, "_number", "left_semi").drop("_number")
    return drawn.withColumn("probability", F.lit(chance)).withColumn("weight", F.lit(1 / chance if chance else None).cast("double"))


def sample_entities(units: DataFrame, key: str, cluster: str | None, size: int, seed: int) -> DataFrame:
    """A simple random sample of units, or of whole clusters with all of their units: ``size`` entities by hash of seed and name, joined back to the units."""
    entity = cluster or key
    drawn = simple_sample(units.select(entity).distinct(), entity, seed, size).select(entity, F.col("population").alias("entities"), "probability", "weight")
    return units.join(drawn, entity)
