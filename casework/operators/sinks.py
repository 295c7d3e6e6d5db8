"""Sinks: canonical JSON lines, Parquet, vector tables, bootstrap SQL, RDF and XES files. All are written by Spark's writers, in parallel, with their commit protocol."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.ids import canonical_json
from .events import xes_lines
from .ledger import event_triples, mermaid_lines


def write_jsonl(rows: DataFrame, path: str) -> None:
    """Canonical JSON lines: sorted keys, nulls kept, one file per partition."""
    rows.select(canonical_json(*rows.columns).alias("value")).write.mode("overwrite").text(path)


def write_tables(profiles: DataFrame, events: DataFrame, path: str) -> None:
    profiles.write.mode("overwrite").parquet(f"{path}/requests")
    events.write.mode("overwrite").parquet(f"{path}/events")


def register_tables(spark: SparkSession, path: str) -> dict[str, int]:
    """Views of the written tables and their counts."""
    counts = {}
    for name in ("requests", "events"):
        spark.read.parquet(f"{path}/{name}").createOrReplaceTempView(name)
        counts[name] = spark.table(name).count()
    return counts


def bootstrap_sql(path: str) -> str:
    """Portable SQL that makes the two views."""
    return "".join(f"CREATE OR REPLACE VIEW {t} AS SELECT * FROM read_parquet('{path}/{t}/*.parquet');\n" for t in ("requests", "events"))


def write_vectors(embeddings: DataFrame, path: str, mode: str = "overwrite") -> None:
    """A vector table: id and array of doubles. Exact search reads it whole; Spark has no approximate index."""
    embeddings.write.mode(mode).parquet(path)


def write_ntriples(events: DataFrame, path: str) -> None:
    event_triples(events).select(F.concat_ws(" ", "s", "p", "o", F.lit(".")).alias("value")).write.mode("overwrite").text(path)


def write_xes(events: DataFrame, path: str) -> None:
    """One trace per line group; head and foot of the log are files of their own that sort first and last."""
    spark = events.sparkSession
    head = '<?xml version="1.0" encoding="UTF-8"?>\n<log xes.version="1.0" xmlns="http://www.xes-standard.org/">'
    xes_lines(events).select("trace").write.mode("overwrite").text(f"{path}/traces")
    spark.createDataFrame([(head,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/head")
    spark.createDataFrame([("</log>",)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/tail")


def write_mermaid(edges: DataFrame, path: str) -> None:
    mermaid_lines(edges).select(F.col("line").alias("value")).write.mode("overwrite").text(path)


def write_content_store(records: DataFrame, path: str) -> None:
    """Content-addressed store: partitioned by the digest's first two digits, equal records once."""
    body = canonical_json(*records.columns)
    rows = records.select(F.sha2(body, 256).alias("sha256"), body.alias("record")).dropDuplicates(["sha256"])
    rows.withColumn("prefix", F.substring("sha256", 1, 2)).write.mode("overwrite").partitionBy("prefix").parquet(path)


def review_items(tasks: DataFrame, fmt: str = "neutral") -> DataFrame:
    """Review tasks as records of a labelling tool."""
    if fmt == "neutral":
        return tasks.select("task_id", "task_type", "source_id", "priority", "rationale")
    return tasks.select(F.struct("task_id", "source_id", F.col("rationale").alias("text")).alias("data"), F.struct(F.col("priority")).alias("meta"))


def process_model(fmt: str = "mermaid") -> str:
    """The transition table as text of a process model."""
    from .. import dims

    edges = sorted((a, b) for a, bs in dims.TRANSITIONS.items() for b in bs)
    if fmt == "mermaid":
        return "stateDiagram-v2\n" + "".join(f"  {a} --> {b}\n" for a, b in edges)
    if fmt == "pnml":
        states = sorted({x for e in edges for x in e})
        places = "".join(f'<place id="{s}"/>' for s in states)
        moves = "".join(f'<transition id="t{i}"/><arc id="a{i}" source="{a}" target="t{i}"/><arc id="b{i}" source="t{i}" target="{b}"/>' for i, (a, b) in enumerate(edges))
        return f'<pnml><net id="process"><page id="p">{places}{moves}</page></net></pnml>'
    raise ValueError(f"no such format: {fmt}")
