"""File listing and byte access. Listings are metadata; contents are read in tasks only."""

from __future__ import annotations

import fnmatch
import os
import re
from collections.abc import Sequence
from dataclasses import dataclass
from typing import BinaryIO

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class InputFile:
    """``src`` is the file's place among all files, ``arg`` that of its path, folder or glob in the caller's list.

    ``uri`` is how ``_metadata.file_path`` spells the file, ``modified`` its time of change in milliseconds.
    """

    src: int
    path: str
    uri: str
    bytes: int
    arg: int = 0
    modified: int = 0


def _bare(path: str) -> str:
    return re.sub(r"^[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?", "", path).rstrip("/")


def list_files(spark: SparkSession, paths: str | Sequence[str]) -> list[InputFile]:
    """The files behind paths, folders and globs: in the caller's order, by path within a folder or glob."""
    given = [paths] if isinstance(paths, str) else list(paths)
    listing = spark.read.format("binaryFile").load([_as_glob(p) for p in given]).select(
        "path", "_metadata.file_path", "length", F.unix_millis("modificationTime").alias("modified"))
    entries = [_bare(p) for p in given]
    exact = {p: i for i, p in reversed(list(enumerate(entries)))}

    def place(path: str) -> int:
        bare = _bare(path)
        if bare in exact:
            return exact[bare]
        hits = (i for i, p in enumerate(entries) if bare.startswith(p + "/") or fnmatch.fnmatch(bare, p))
        return next(hits, len(entries))

    rows = {r.path: r for r in listing.collect()}.values()
    ranked = sorted(rows, key=lambda r: (place(r.path), r.path))
    return [InputFile(i, r.path, r.file_path, r.length, min(place(r.path), len(entries) - 1), r.modified) for i, r in enumerate(ranked)]


def _as_glob(path: str) -> str:
    """The path escaped, where a file of exactly that name exists; else the glob it is."""
    if not re.search(r"[\[\]{}*?]", path):
        return path
    store, inner = _store(path)
    return path if store.get_file_info(inner).type.name == "NotFound" else literal_path(path)


# A scan takes at most this many files and input splits, so tables of one row per
# file or per split (tens of bytes each) are small enough to broadcast.
MAX_FILES, MAX_SPLITS = 100_000, 2_000_000


def scan_groups(spark: SparkSession, files: Sequence[InputFile]) -> list[list[InputFile]]:
    """The files in portions one scan may take; one portion unless there are very many."""
    split_bytes = bytes_setting(spark, "spark.sql.files.maxPartitionBytes")
    groups: list[list[InputFile]] = [[]]
    splits = 0
    for f in files:
        more = f.bytes // split_bytes + 1
        if groups[-1] and (len(groups[-1]) == MAX_FILES or splits + more > MAX_SPLITS):
            groups.append([])
            splits = 0
        groups[-1].append(f)
        splits += more
    return groups


def bytes_setting(spark: SparkSession, name: str) -> int:
    number, unit = re.fullmatch(r"(\d+)\s*([kmgt]?)b?", spark.conf.get(name).strip().lower()).groups()
    return int(number) << {"": 0, "k": 10, "m": 20, "g": 30, "t": 40}[unit]


def pin_splits(spark: SparkSession) -> None:
    """Keep input splits the same in every pass over a file, also when executors come and go.

    Spark sizes splits by the cores it has at the moment unless this setting is given.
    """
    name = "spark.sql.files.minPartitionNum"
    if spark.conf.get(name, None) is None:
        spark.conf.set(name, str(spark.sparkContext.defaultParallelism))


def read_if_there(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame | None:
    """A Parquet dataset, or None where nothing has been written yet; any other fault is an error."""
    reader = spark.read if schema is None else spark.read.schema(schema)
    try:
        return reader.parquet(path)
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


def literal_path(path: str) -> str:
    """A path whose brackets and stars are not globs."""
    return re.sub(r"([\[\]{}*?\\])", r"\\\1", path)


def qualified(spark: SparkSession, path: str) -> str:
    """A path with the file system Spark would resolve it on, for code that opens files by itself."""
    if "://" in path or path.startswith("file:"):
        return path
    default = spark.sparkContext._jsc.hadoopConfiguration().get("fs.defaultFS") or "file:///"
    return path if default.startswith("file:") else f"{default.rstrip('/')}/{path.lstrip('/')}"


def _store(path: str):
    """Arrow file system and inner path."""
    from pyarrow import fs

    if path.startswith("file:"):
        return fs.LocalFileSystem(), _bare(path)
    if "://" not in path:
        return fs.LocalFileSystem(), path
    return fs.FileSystem.from_uri(re.sub(r"^s3[an]://", "s3://", path))


def open_input(path: str) -> BinaryIO:
    """Open a file for reading inside a task, on any store Arrow can reach."""
    store, inner = _store(path)
    return store.open_input_file(inner)


def open_output(path: str) -> BinaryIO:
    """Open a file for writing inside a task, creating its folder."""
    store, inner = _store(path)
    if "/" in inner:
        store.create_dir(inner.rsplit("/", 1)[0], recursive=True)
    return store.open_output_stream(inner)


def claim(spark: SparkSession, path: str) -> bool:
    """Create an empty file if there is none; False if there is. Of several callers one gets True."""
    bare = re.sub(r"^file:(//)?", "", path)
    if "://" not in bare:
        # Hadoop's local file system looks first and creates then, so two callers may both succeed there.
        os.makedirs(os.path.dirname(bare), exist_ok=True)
        try:
            os.close(os.open(bare, os.O_CREAT | os.O_EXCL))
        except FileExistsError:
            return False
        return True
    from py4j.protocol import Py4JJavaError

    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    try:
        target.getFileSystem(spark._jsc.hadoopConfiguration()).create(target, False).close()
    except Py4JJavaError as e:
        if "FileAlreadyExistsException" in e.java_exception.getClass().getName():
            return False
        raise
    return True


def delete_output(path: str) -> None:
    store, inner = _store(path)
    store.delete_file(inner)
