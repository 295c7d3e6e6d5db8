"""Record files as a data source: ``spark.read.format("casework_records")``.

Paths are files, folders (their ``.json`` and ``.jsonl`` files) or patterns. They are found
once, on the driver, sorted and told once each; a path that names nothing is an error. Each
file is a partition, read in a task: JSON lines, a JSON array, an object with ``records``, or
one object. Every record comes with its file and its number there.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from fnmatch import fnmatchcase

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SUFFIXES = (".json", ".jsonl")


def _open(path: str):
    """A file system of Arrow's and the path in it; a bare path is a local one."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def discover(paths: list[str]) -> list[str]:
    """The files that ``paths`` name, sorted, each once."""
    from pyarrow import fs

    found: set[str] = set()
    for path in paths:
        system, at = _open(path)
        prefix = path[: len(path) - len(at)] if path.endswith(at) else path.split("://")[0] + "://"
        if any(c in at for c in "*?["):
            cut = min(at.index(c) for c in "*?[" if c in at)
            base = at[:cut].rpartition("/")[0] or "/"
            listed = system.get_file_info(fs.FileSelector(base, recursive=True, allow_not_found=True))
            depth = at.count("/")
            found |= {prefix + x.path for x in listed if x.type == fs.FileType.File and x.path.count("/") == depth and all(map(fnmatchcase, x.path.split("/"), at.split("/")))}
            continue
        info = system.get_file_info(at)
        if info.type == fs.FileType.File:
            found.add(prefix + at)
        elif info.type == fs.FileType.Directory:
            found |= {prefix + x.path for x in system.get_file_info(fs.FileSelector(at)) if x.type == fs.FileType.File and x.path.endswith(SUFFIXES)}
        else:
            raise FileNotFoundError(path)
    return sorted(found)


def records_of(text: str, lines: bool) -> Iterator[tuple[int, str]]:
    """Number and JSON text of each record of a file; of JSON lines the line's number, blank ones passed over."""
    if lines:
        for n, line in enumerate(text.split("\n"), 1):
            if line.strip():
                if not isinstance(json.loads(line), dict):
                    raise ValueError(f"line {n} is no JSON object")
                yield n, line.strip()
        return
    whole = json.loads(text)
    listed = whole if isinstance(whole, list) else whole["records"] if isinstance(whole, dict) and isinstance(whole.get("records"), list) else [whole]
    for n, record in enumerate(listed, 1):
        if isinstance(record, dict):
            yield n, json.dumps(record, ensure_ascii=False)


class File(InputPartition):
    def __init__(self, path: str):
        super().__init__(path)


class Reader(DataSourceReader):
    def __init__(self, paths: list[str]):
        self.paths = paths

    def partitions(self) -> list[InputPartition]:
        return [File(p) for p in discover(self.paths)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        if partition is None:  # without any file there is one partition of nothing
            return
        system, at = _open(partition.value)
        with system.open_input_stream(at) as f:
            text = f.read().decode("utf-8-sig")
        try:
            for number, record in records_of(text, at.endswith(".jsonl")):
                yield partition.value, number, record
        except ValueError as e:
            raise ValueError(f"{partition.value}: {e}") from e


class RecordFiles(DataSource):
    """Options: ``paths``, a JSON array of paths, or ``path`` from ``load(path)``."""

    @classmethod
    def name(cls) -> str:
        return "casework_records"

    def schema(self) -> str:
        return "input_file string, number int, record string"

    def reader(self, schema) -> DataSourceReader:
        paths = json.loads(self.options["paths"]) if "paths" in self.options else [self.options["path"]]
        return Reader(paths)


def read_record_files(spark: SparkSession, paths: list[str]) -> DataFrame:
    """``input_file, number, record`` of all files that ``paths`` name."""
    spark.dataSource.register(RecordFiles)
    return spark.read.format("casework_records").option("paths", json.dumps(paths)).load()


def batch_report(records: DataFrame, paths: list[str]) -> DataFrame:
    """Records of each input file, files without any among them."""
    files = records.sparkSession.createDataFrame([(p,) for p in discover(paths)], "input_file string")
    counted = records.groupBy("input_file").agg(F.count("*").alias("records"))
    return files.join(counted, "input_file", "left").select("input_file", F.coalesce("records", F.lit(0)).alias("records"))
