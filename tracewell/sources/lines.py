"""Files to numbered lines.

A file's bytes are read whole by the task that numbers its lines: the number is
part of a line's identity, and a split in the middle of a file could not know it.
Reading goes through Spark, so paths may lie in any store it can open.
"""

from __future__ import annotations

import fnmatch
import io
import os
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def discover(sources: Iterable[str], pattern: str, prune: bool = False, depth: int = 0) -> tuple[list[str], list[str]]:
    """Files under the sources in order, each once, and the sources that don't exist.

    A file is taken whatever its name. ``prune`` stops at a folder that holds a
    match itself; links to folders are followed nowhere. A match lies at least
    ``depth`` folders below its source.
    """
    found, missing = set(), []
    for source in sources:
        source = os.path.expanduser(source)
        if os.path.isfile(source):
            found.add(os.path.realpath(source))
        elif not os.path.isdir(source):
            missing.append(source)
        else:
            for folder, below, names in os.walk(source):
                deep = depth == 0 or len(os.path.relpath(folder, source).split(os.sep)) >= depth and folder != source
                hits = [n for n in names if deep and fnmatch.fnmatch(n, pattern)]
                found.update(os.path.realpath(os.path.join(folder, n)) for n in hits)
                if prune and hits:
                    below.clear()
    return sorted(found), missing


def local_path(c):
    """A path as the file system spells it, without Spark's ``file:`` scheme."""
    return F.regexp_replace(F.url_decode(F.regexp_replace(F.regexp_replace(c, r"\+", "%2B"), r"%(?![0-9A-Fa-f]{2})", "%25")), "^file:(//)?", "")


def files(spark: SparkSession, paths: list[str]) -> DataFrame:
    """file_path, size_bytes, mtime, content for each path."""
    if not paths:
        return spark.createDataFrame([], "file_path string, size_bytes long, mtime double, content binary")
    raw = spark.read.format("binaryFile").load(paths)
    return raw.select(local_path(F.col("path")).alias("file_path"), F.col("length").alias("size_bytes"), (F.unix_millis("modificationTime") / 1000.0).alias("mtime"), "content")


def numbered(data: bytes) -> Iterator[tuple[int, str]]:
    """Non-blank lines with their 1-based numbers; a byte-order mark is dropped, bad bytes become U+FFFD."""
    for n, line in enumerate(io.TextIOWrapper(io.BytesIO(data), "utf-8-sig", "replace"), 1):
        if line := line.strip():
            yield n, line


def lines(source: DataFrame) -> DataFrame:
    """file_path, seq, raw of ``files``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, data in zip(b.column(0).to_pylist(), b.column(1)):
                got = list(numbered(data.as_py() or b""))
                for i in range(0, len(got), 10_000):
                    part = got[i : i + 10_000]
                    yield pa.RecordBatch.from_arrays([pa.array([path] * len(part), pa.string()), pa.array([n for n, _ in part], pa.int64()), pa.array([t for _, t in part], pa.string())], ["file_path", "seq", "raw"])

    return source.select("file_path", "content").mapInArrow(run, "file_path string, seq long, raw string")


def read_lines(numbered_lines: DataFrame, parse, schema: str) -> DataFrame:
    """Add the columns that ``parse(raw) -> dict | None`` makes of each line, and ``ok`` (false: not an object)."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    target = StructType.fromDDL("file_path string, seq long, raw string, ok boolean, " + schema)
    arrow = to_arrow_schema(target)
    names, kinds = [f.name for f in target][4:], [f.type for f in arrow][3:]
    bad = (False, *[None] * len(names))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = map(parse, b.column(2).to_pylist())
            rows = [bad if m is None else (True, *map(m.get, names)) for m in made]
            cols = [pa.array(c, t) for c, t in zip(zip(*rows), kinds)] if rows else [pa.array([], t) for t in kinds]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), *cols], schema=arrow)

    return numbered_lines.select("file_path", "seq", "raw").mapInArrow(run, target)


def as_is(df: DataFrame) -> DataFrame:
    return df


def stem(path):
    return F.regexp_replace(F.regexp_extract(path, r"([^/]*)$", 1), r"(?<=.)\.[^.]*$", "")


def parent_name(path):
    return F.nullif(F.regexp_extract(path, r"([^/]+)/[^/]*$", 1), F.lit(""))
