"""Hash-chained ledgers, content-addressed manifests, graphs and triples."""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import media_type, safe_identifier, snake

ZERO_HASH = "0" * 64
_NO_STREAM = ("no stream yet",)  # no value of a column is a tuple


def _in_order(rows: DataFrame, group: str, *by: str) -> DataFrame:
    """The rows of each group in one partition, one group after the other, sorted."""
    return rows.repartition(group).sortWithinPartitions(group, *by)


def build_ledger(records: DataFrame, stream: str, order: str, record_hash: str) -> DataFrame:
    """Chain the records of each stream: every entry's hash covers the one before. Hashing records is parallel. The chain is a scan of the sorted stream that carries one hash from batch to batch, so a stream may have any number of entries."""
    rows = records.select(F.col(stream).alias("stream"), F.col(order).alias("seq"), F.col(record_hash).alias("h"))
    types = dict(rows.dtypes)

    def run(batches):
        last, previous, sequence = _NO_STREAM, ZERO_HASH, 0
        for batch in batches:
            places, befores, hashes = [], [], []
            for group, h in zip(batch.column("stream").to_pylist(), batch.column("h").to_pylist()):
                if group != last or last is _NO_STREAM:
                    last, previous, sequence = group, ZERO_HASH, 0
                befores.append(previous)
                previous = hashlib.sha256((previous if h is None else f"{previous}\n{h}").encode()).hexdigest()
                hashes.append(previous)
                places.append(sequence)
                sequence += 1
            yield pa.record_batch({"stream": batch.column("stream"), "sequence": pa.array(places, pa.int32()), "seq": batch.column("seq"), "h": batch.column("h"), "previous": pa.array(befores, pa.string()), "ledger": pa.array(hashes, pa.string())})

    chained = _in_order(rows, "stream", "seq", "h").mapInArrow(run, f"stream {types['stream']}, sequence int, seq {types['seq']}, h string, previous string, ledger string")
    return chained.select(F.col("stream").alias(stream), "sequence", F.col("seq").alias(order), F.col("h").alias("record_sha256"), F.col("ledger").alias("ledger_sha256"), F.col("previous").alias("previous_sha256"))


def verify_ledger(rebuilt: DataFrame, ledger: DataFrame, stream: str) -> DataFrame:
    """First field that differs per entry, or an entry that only one side has."""
    fields = ("record_sha256", "previous_sha256", "ledger_sha256")
    old = ledger.select(stream, "sequence", F.lit(True).alias("has_old"), *(F.col(f).alias(f"old_{f}") for f in fields))
    both = rebuilt.withColumn("has_new", F.lit(True)).join(old, [stream, "sequence"], "full_outer")
    wrong = F.coalesce(F.when(F.col("has_old").isNull(), "missing_entry"), F.when(F.col("has_new").isNull(), "extra_entry"), *(F.when(~F.col(f).eqNullSafe(F.col(f"old_{f}")), f) for f in fields))
    return both.select(stream, "sequence", wrong.alias("mismatch")).filter("mismatch IS NOT NULL")


def root_digest(entries: DataFrame, group: str, digest: str) -> DataFrame:
    """Root over a group's digests in order, each ended by a new line: a scan of the sorted group that carries the state of one hash. Null digests count as entries and add nothing."""
    rows = entries.select(F.col(group).alias("group"), F.col(digest).alias("h"))

    def run(batches):
        last, state, count = _NO_STREAM, hashlib.sha256(), 0
        for batch in batches:
            done = []
            for key, h in zip(batch.column("group").to_pylist(), batch.column("h").to_pylist()):
                if key != last or last is _NO_STREAM:
                    if last is not _NO_STREAM:
                        done.append((last, state.hexdigest(), count))
                    last, state, count = key, hashlib.sha256(), 0
                if h is not None:
                    state.update(h.encode() + b"\n")
                count += 1
            yield _roots(done, batch.schema.field("group").type)
        if last is not _NO_STREAM:
            yield _roots([(last, state.hexdigest(), count)], batch.schema.field("group").type)

    found = _in_order(rows, "group", "h").mapInArrow(run, f"group {dict(rows.dtypes)['group']}, root_sha256 string, entries long")
    return found.withColumnRenamed("group", group)


def _roots(rows: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [[]] * 3
    return pa.record_batch([pa.array(c, t) for c, t in zip(columns, (kind, pa.string(), pa.int64()))], ["group", "root_sha256", "entries"])


def file_manifest(spark, path: str) -> DataFrame:
    """Digest, size and media type of every file under a path."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select(F.col("path"), F.sha2("content", 256).alias("sha256"), F.col("length").alias("bytes"), media_type(F.col("path")).alias("media_type"))


def content_paths(records: DataFrame, *columns: str) -> DataFrame:
    """Content-addressed place of each record: ``<first two digits>/<digest>.json``."""
    digest = F.sha2(F.to_json(F.struct(*sorted(columns)), {"ignoreNullFields": "false"}), 256)
    return records.select(digest.alias("sha256"), F.concat(F.substring(digest, 1, 2), F.lit("/"), digest, F.lit(".json")).alias("path")).distinct()


def graph_nodes(profiles: DataFrame, events: DataFrame) -> DataFrame:
    """Request, authority, event and state nodes. A node that a record describes takes precedence over one that an edge only implies."""
    node = lambda df, kind, key, label, rank: df.select(F.concat(F.lit(f"{kind}:"), F.col(key)).alias("id"), F.lit(kind).alias("kind"), F.col(label).alias("label"), F.lit(rank).alias("rank"))
    rows = node(profiles, "request", "request_id", "normalised_state", 0)
    rows = rows.unionByName(node(profiles, "authority", "authority", "authority", 0)).unionByName(node(events, "event", "event_id", "event_type", 0))
    rows = rows.unionByName(node(events, "request", "request_id", "request_id", 1)).unionByName(node(events.filter("lifecycle_state_after IS NOT NULL"), "state", "lifecycle_state_after", "lifecycle_state_after", 1))
    return rows.groupBy("id").agg(F.min_by(F.struct("kind", "label"), F.struct("rank", "label")).alias("n")).select("id", "n.*")


def graph_edges(profiles: DataFrame, events: DataFrame) -> DataFrame:
    """Edges of requests to authorities and events, of events to states, and from each event to the next of its request in file order."""
    edge = lambda df, a, ak, b, bk, label: df.select(F.concat(F.lit(f"{a}:"), F.col(ak)).alias("source"), F.concat(F.lit(f"{b}:"), F.col(bk)).alias("target"), F.lit(label).alias("label"))
    rows = edge(profiles, "request", "request_id", "authority", "authority", "addressed_to").unionByName(edge(events, "request", "request_id", "event", "event_id", "has_event"))
    rows = rows.unionByName(edge(events.filter("lifecycle_state_after IS NOT NULL"), "event", "event_id", "state", "lifecycle_state_after", "results_in"))
    following = events.withColumn("previous", F.lag("event_id").over(Window.partitionBy("request_id").orderBy("seq"))).filter("previous IS NOT NULL")
    return rows.unionByName(edge(following, "event", "previous", "event", "event_id", "next_event"))


def mermaid_lines(edges: DataFrame) -> DataFrame:
    a, b = safe_identifier(F.col("source")), safe_identifier(F.col("target"))
    return edges.select(F.concat(F.lit("  "), a, F.lit(" -->|"), F.col("label"), F.lit("| "), b).alias("line"))


def event_triples(events: DataFrame, base: str = "https://example.org/") -> DataFrame:
    """Triples of events as a set: ``s, p, o``. Predicates are the columns' names; objects that name things are IRIs."""
    uri = lambda kind, c: F.concat(F.lit(f"<{base}{kind}/"), F.regexp_replace(c, "[^0-9A-Za-z_.-]", "_"), F.lit(">"))
    literal = lambda c: F.concat(F.lit('"'), F.replace(F.replace(c.cast("string"), F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"'))
    subject = uri("event", F.col("event_id"))
    pair = lambda p, o: F.when(o.isNotNull(), F.struct(F.lit(f"<{base}ns#{p}>").alias("p"), o.alias("o")))
    pairs = F.array(
        pair("type", uri("type", snake(F.col("event_type")))), pair("request", uri("request", F.col("request_id"))), pair("stateAfter", uri("state", F.col("lifecycle_state_after"))), pair("assertionStatus", literal(F.col("assertion_status")))
    )
    return events.select(subject.alias("s"), F.explode(F.array_compact(pairs)).alias("x")).select("s", "x.*").distinct()
