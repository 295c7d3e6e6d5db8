"""A session with the settings that the operators expect, and tables that cut a lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "casework", **conf: str) -> SparkSession:
    """UTC, ANSI mode and adaptive execution; everything else is the cluster's own."""
    builder = SparkSession.builder.appName(app).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true").config("spark.sql.ansi.enabled", "true")
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


_OWN: dict[str, str] = {}


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in the folder that ``spark.checkpoint.dir`` names: later plans read it, whatever executors are lost. Where the session names none (a laptop) the folder is a local one of this process."""
    spark = df.sparkSession
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        folder = _OWN.setdefault(spark.sparkContext.applicationId, "")
        if not folder:
            folder = _OWN[spark.sparkContext.applicationId] = "file://" + tempfile.mkdtemp(prefix="casework-")
    path = f"{folder.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
