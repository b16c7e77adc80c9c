"""Deposits that readers see whole or not at all.

A deposit is a version: its files' contents in a folder of its own, and a manifest of lengths and digests made from the source
rows. After writing, the contents are read back and held against the manifest; only then a pointer is moved to the version, by
one rename that replaces it. Readers follow the pointer. A failure at any step leaves the pointer where it was, and what the
failed version wrote is removed; earlier versions stay and the pointer can be moved back to them.
"""

from __future__ import annotations

import uuid

from py4j.java_gateway import JavaObject
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FILES = "name string, content binary"
POINTER = "CURRENT"


class DepositError(RuntimeError):
    """What was written differs from what was to be written."""


def _path(spark: SparkSession, *parts: str) -> tuple[JavaObject, JavaObject]:
    path = spark._jvm.org.apache.hadoop.fs.Path("/".join(parts))
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), path


def versions(spark: SparkSession, folder: str) -> list[str]:
    """The versions that were published, the current one last; none of a folder without a deposit."""
    fs, path = _path(spark, folder, POINTER)
    if not fs.exists(path):
        return []
    return [r.value for r in spark.read.text(path.toString()).collect() if r.value]  # a line for each version


def _point(spark: SparkSession, folder: str, names: list[str]) -> None:
    fs, draft = _path(spark, folder, f".{POINTER}.{uuid.uuid4().hex}")
    out = fs.create(draft)
    out.write(bytearray("".join(f"{n}\n" for n in names).encode()))
    out.close()
    jvm, (_, to) = spark._jvm, _path(spark, folder, POINTER)
    replace = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    replace[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark._jsc.hadoopConfiguration()).rename(fs.makeQualified(draft), fs.makeQualified(to), replace)


def manifest(files: DataFrame) -> DataFrame:
    """(name, length, sha) of files (name, content); a null content counts as an empty one."""
    content = F.coalesce("content", F.lit(b""))
    return files.select("name", F.octet_length(content).cast("long").alias("length"), F.sha2(content, 256).alias("sha"))


def stage(files: DataFrame, folder: str, version: str | None = None) -> str:
    """Writes contents and manifest of a new version and gives its name; readers don't see it yet."""
    version = version or uuid.uuid4().hex
    manifest(files).write.parquet(f"{folder}/{version}/manifest")
    files.select("name", F.coalesce("content", F.lit(b"")).alias("content")).write.parquet(f"{folder}/{version}/files")
    return version


def differences(spark: SparkSession, folder: str, version: str) -> DataFrame:
    """(name, length, sha, n, fault) of what is missing, left over or damaged in a staged version, by reading it back. Names that
    occur twice are told apart by their contents and counted."""
    kept = ("name", "length", "sha")
    listed = spark.read.schema("name string, length long, sha string").parquet(f"{folder}/{version}/manifest").groupBy(*kept).agg(F.count(F.lit(1)).alias("wanted"))
    found = manifest(spark.read.schema(FILES).parquet(f"{folder}/{version}/files")).groupBy(*kept).agg(F.count(F.lit(1)).alias("seen"))
    both = listed.select(*kept, "wanted", F.lit(0).alias("seen")).unionByName(found.select(*kept, F.lit(0).alias("wanted"), "seen")).groupBy(*kept).agg((F.sum("seen") - F.sum("wanted")).alias("n"))
    return both.where("n <> 0").withColumn("fault", F.when(F.col("n") < 0, "missing or damaged").otherwise("left over"))


def publish(spark: SparkSession, folder: str, version: str) -> None:
    """Checks a staged version and moves the pointer to it; if it differs from its manifest, raises and leaves the pointer."""
    wrong = differences(spark, folder, version).limit(5).collect()
    if wrong:
        raise DepositError("; ".join(f"{r.fault}: {r.name}" for r in wrong))
    _point(spark, folder, [*versions(spark, folder), version])


def discard(spark: SparkSession, folder: str, version: str) -> None:
    """Removes a version that isn't the current one."""
    if version in versions(spark, folder)[-1:]:
        raise ValueError("readers use this version")
    fs, path = _path(spark, folder, version)
    fs.delete(path, True)


def deposit(files: DataFrame, folder: str) -> str:
    """``files`` (name, content) as the new version of a folder, whole or not at all. An empty table is an empty version."""
    spark, version = files.sparkSession, uuid.uuid4().hex
    try:
        stage(files, folder, version)
        publish(spark, folder, version)
    except Exception:
        if version not in versions(spark, folder):
            discard(spark, folder, version)
        raise
    return version


def current(spark: SparkSession, folder: str) -> DataFrame:
    """(name, content) of the version that readers use; empty without one."""
    known = versions(spark, folder)
    return spark.read.schema(FILES).parquet(f"{folder}/{known[-1]}/files") if known else spark.createDataFrame([], FILES)


def roll_back(spark: SparkSession, folder: str) -> str | None:
    """Moves the pointer to the version before and names it; None if there is none, and readers see no version then."""
    known = versions(spark, folder)[:-1]
    _point(spark, folder, known)
    return known[-1] if known else None


def unpublished(spark: SparkSession, folder: str) -> list[str]:
    """Versions that a run staged and never published, as after a crash; ``discard`` removes them."""
    fs, path = _path(spark, folder)
    names = [s.getPath().getName() for s in fs.listStatus(path) if s.isDirectory()] if fs.exists(path) else []
    return sorted(set(names) - set(versions(spark, folder)))
