"""Secret scan with corpus-wide ownership frequency, in DataFrame operations only.

Candidates are found by pattern. Each candidate's value is hashed, and the hashes are
counted over the corpus by distinct repositories and owners: a value that many owners
carry is a copied example, one that a single owner carries looks live. Besides the three
base kinds, long opaque tokens (letters of both cases and digits) are candidates; they
prove nothing by themselves and become spans, of kind ``owned``, only where the corpus
shows that one owner alone carries them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch

#: Name, pattern, group that holds the value, its least length.
KINDS = [
    ("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    ("access", r"(AKIA[A-Z0-9]{16,})", 1, 20),
    ("hex", r"([0-9a-f]{24,})", 1, 24),
]
OWNED = ("owned", r"([A-Za-z0-9+/_=-]{32,})", 1, 32)
#: Distinct owners from which on a value counts as a copied example.
EXAMPLE_OWNERS = 3


def _matches(text, pattern: str, group: int):
    """All leftmost non-overlapping matches: the length of what lies before each, its own length, its value."""
    found = F.arrays_zip(
        F.split(text, pattern, -1).alias("gap"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("whole"), F.regexp_extract_all(text, F.lit(pattern), F.lit(group)).alias("value")
    )
    found = F.filter(found, lambda m: m["whole"].isNotNull())  # after the last match comes one more gap
    return F.when(text.rlike(pattern), F.transform(found, lambda m, i: F.struct(i.alias("pos"), F.length(m["gap"]).alias("gap"), F.length(m["whole"]).alias("size"), m["value"].alias("value"))))


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source", repo_cols: tuple[str, ...] = ("source", "lang"), example_owners: int = EXAMPLE_OWNERS) -> tuple[DataFrame, DataFrame]:
    """Returns ``(rows, spans)``.

    ``spans`` has per span ``row, kind, rank, start, end`` (code points, end exclusive),
    ``value_sha256``, ``owners``, ``repositories``, ``verdict`` (``live``: one owner;
    ``example``: at least ``example_owners``; ``shared``: between). ``rows`` has ``row`` and
    the id of every input row, those without spans too.

    A null text is empty and has no spans. Null owners are one owner, null repository
    columns empty strings. Repeated rows have spans of their own; they add nothing to the
    counts of distinct owners. Empty tables give empty results; other columns are ignored.
    """
    scratch = Scratch(docs.sparkSession, "secrets")
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    owner = F.coalesce(F.col(owner_col).cast("string"), F.lit(""))
    repo = F.concat_ws("/", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in repo_cols))
    base = docs.select(F.col(id_col).alias("id"), text.alias("text"), owner.alias("owner"), repo.alias("repo"))
    kinds = [*KINDS, OWNED]
    scanned = scratch.table(
        base.select("id", "owner", "repo", *(_matches(F.col("text"), p, g).alias(k) for k, p, g, _ in kinds)).withColumn("row", F.monotonically_increasing_id()), "scanned"
    )

    each = F.array(*(F.struct(F.lit(k).alias("kind"), F.lit(r).alias("rank"), F.lit(least).alias("least"), F.col(k).alias("found")) for r, (k, _, _, least) in enumerate(kinds)))
    lists = scanned.select("row", "owner", "repo", F.explode(each).alias("x")).filter("x.found IS NOT NULL")
    matches = lists.select("row", "owner", "repo", "x.kind", "x.rank", "x.least", F.explode("x.found").alias("m"))
    before = Window.partitionBy("row", "rank").orderBy("m.pos")
    placed = matches.withColumn("end", F.sum(F.col("m.gap") + F.col("m.size")).over(before)).withColumn("start", F.col("end") - F.col("m.size"))
    placed = placed.filter(F.length("m.value") >= F.col("least"))

    # An opaque token counts only where it overlaps no base span and mixes cases and digits.
    is_base = F.col("rank") < len(KINDS)
    at = Window.partitionBy("row").orderBy("start", "rank")
    ends = F.max(F.when(is_base, F.col("end"))).over(at.rowsBetween(Window.unboundedPreceding, -1))
    starts = F.min(F.when(is_base, F.col("start"))).over(at.rowsBetween(1, Window.unboundedFollowing))
    value = F.col("m.value")
    opaque = value.rlike("[0-9]") & value.rlike("[a-z]") & value.rlike("[A-Z]")
    clear = (F.coalesce(ends, F.lit(0)) <= F.col("start")) & F.coalesce(starts >= F.col("end"), F.lit(True))
    candidates = scratch.table(
        placed.withColumn("clear", clear).filter(is_base | (F.col("clear") & opaque)).select("row", "owner", "repo", "kind", "rank", "start", "end", F.sha2(value, 256).alias("value_sha256")), "candidates"
    )

    # First one row per hash, owner and repository, so that a value copied a million times is counted where it lies.
    repos = candidates.groupBy("value_sha256", "owner", "repo").agg(F.count("*").alias("n"))
    owners = repos.groupBy("value_sha256", "owner").agg(F.count("*").alias("repos"))
    counted = owners.groupBy("value_sha256").agg(F.count("*").alias("owners"), F.sum("repos").alias("repositories"))
    verdict = F.when(F.col("owners") >= example_owners, "example").when(F.col("owners") == 1, "live").otherwise("shared")
    counted = scratch.table(counted.withColumn("verdict", verdict), "counted")
    spans = candidates.join(counted, "value_sha256").filter(is_base | (F.col("verdict") == "live"))
    return scanned.select("row", "id"), spans.drop("owner", "repo")


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, spans = scan_secrets(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    text = F.concat_ws(":", "kind", F.col("start").cast("string"), F.col("end").cast("string"))
    base = F.col("rank") < len(KINDS)
    listed = F.sort_array(F.collect_list(F.struct("start", "rank", text.alias("text"))))
    digest = spans.groupBy("row").agg(
        *(F.count_if(F.col("kind") == k).alias(f"n_{k}") for k, *_ in [*KINDS, OWNED]),
        F.count_if(base & (F.col("verdict") == "live")).alias("n_live"),
        F.count_if(base & (F.col("verdict") == "example")).alias("n_example"),
        listed.alias("all"),
    )
    joined = lambda x: F.array_join(F.transform(x, lambda s: s["text"]), ",")
    digest = digest.select("*", joined(F.filter("all", lambda s: s["rank"] < len(KINDS))).alias("base"), joined(F.col("all")).alias("spans")).drop("all")
    out = rows.join(digest, "row", "left")
    counts = [c for c in digest.columns if c.startswith("n_")]
    return out.select(
        F.col("id").alias("doc_id"), *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in counts), F.sha2(F.coalesce("base", F.lit("")), 256).alias("base_sha256"), F.coalesce("spans", F.lit("")).alias("spans")
    )
