"""Versions of a stored table: readers see one whole version, of two writers one wins.

Data lies in folders that are written once. A *manifest* is a small file that names, for
every part of the table, the folder that holds it; it is put in place by one rename that
fails if the name is taken. Manifests are numbered, so a writer that prepared version n + 1
from version n learns that somebody else was faster, and nothing it wrote is ever read.
The folder of the table has to be on a file system whose rename refuses an existing name
in one step, as HDFS does.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Mapping
from dataclasses import dataclass, field

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

PART = "_part"


class Conflict(RuntimeError):
    """Another writer committed first; prepare the change again from the new version."""


@dataclass(frozen=True)
class Snapshot:
    """One version: the folder of each part, and the writer's own notes."""

    root: str
    version: int = 0
    parts: Mapping[str, str] = field(default_factory=dict)
    notes: Mapping = field(default_factory=dict)


class _Files:
    """The few file operations a manifest needs, on whatever file system Spark uses."""

    def __init__(self, spark: SparkSession, root: str):
        self.jvm = spark._jvm
        self.fs = self.jvm.org.apache.hadoop.fs
        self.conf = spark._jsc.hadoopConfiguration()
        self.folder = self.fs.Path(f"{root.rstrip('/')}/manifests")
        self.system = self.folder.getFileSystem(self.conf)

    def versions(self) -> list[int]:
        if not self.system.exists(self.folder):
            return []
        names = [s.getPath().getName() for s in self.system.listStatus(self.folder)]
        return sorted(int(n.removesuffix(".json")) for n in names if not n.startswith((".", "_")))

    def _at(self, name: str):
        return self.fs.Path(self.folder, name)

    def text(self, version: int) -> str:
        stream = self.system.open(self._at(f"{version:012d}.json"))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def create(self, version: int, text: str) -> None:
        hidden = self._at(f".{uuid.uuid4().hex}")
        out = self.system.create(hidden, False)
        out.write(text.encode())
        out.close()
        context = self.fs.FileContext.getFileContext(self.folder.toUri(), self.conf)
        refuse = self.jvm.java.lang.reflect.Array.newInstance(
            getattr(self.fs, "Options$Rename")._java_lang_class, 0
        )
        try:
            target = context.makeQualified(self._at(f"{version:012d}.json"))
            context.rename(context.makeQualified(hidden), target, refuse)
        except Py4JJavaError as error:
            self.system.delete(hidden, False)
            if "FileAlreadyExistsException" not in error.java_exception.getClass().getName():
                raise
            raise Conflict(f"version {version} exists") from None


def current(spark: SparkSession, root: str) -> Snapshot:
    """The newest version; version 0, without parts, of a table that has none yet."""
    files = _Files(spark, root)
    versions = files.versions()
    return at(spark, root, versions[-1]) if versions else Snapshot(root)


def at(spark: SparkSession, root: str, version: int) -> Snapshot:
    return Snapshot(root, version, **json.loads(_Files(spark, root).text(version)))


def commit(
    spark: SparkSession, base: Snapshot, parts: Mapping[str, str], notes: Mapping | None = None
) -> Snapshot:
    """The version after ``base``; ``Conflict`` if somebody committed it meanwhile."""
    after = Snapshot(base.root, base.version + 1, dict(parts), dict(notes or {}))
    text = json.dumps({"parts": after.parts, "notes": after.notes}, sort_keys=True)
    _Files(spark, base.root).create(after.version, text)
    return after


def write(rows: DataFrame, root: str, part: str) -> str:
    """Write rows into a fresh folder, one directory per value of column ``part``.

    Returns the folder, to be named in a manifest for the parts it holds.
    """
    folder = f"data/{uuid.uuid4().hex}"
    named = rows.withColumn(PART, F.col(part).cast("string"))
    named.write.partitionBy(PART).parquet(f"{root.rstrip('/')}/{folder}")
    return folder


def read(
    spark: SparkSession, snapshot: Snapshot, schema: T.StructType, wanted: set[str] | None = None
) -> DataFrame:
    """The rows of a version, or of some of its parts; other folders are not opened."""
    paths = [
        f"{snapshot.root.rstrip('/')}/{folder}/{PART}={part}"
        for part, folder in sorted(snapshot.parts.items())
        if wanted is None or part in wanted
    ]
    if not paths:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(*paths)
