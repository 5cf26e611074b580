"""Small file-system calls on the shared storage a history lives on."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def file_name() -> Column:
    """A row's file below the rows folder, as a column of a scan."""
    return F.regexp_extract(F.col("_metadata.file_path"), r"/rows/(spec=\d+/batch=\d+/attempt=.*)$", 1)


class BehindLog(RuntimeError):
    """Another writer has moved a history on since it was loaded."""


def _fs(spark: SparkSession, path: str):
    jvm_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return jvm_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), jvm_path


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return fs.exists(p)


def delete(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return fs.delete(p, True)


def delete_encoded(spark: SparkSession, root: str, names: list[str]) -> None:
    """Delete files below `root` by their names as scans show them, which are URL-encoded."""
    fs, p = _fs(spark, root)
    base = fs.makeQualified(p).toUri().toString()
    jvm = spark.sparkContext._jvm
    for name in names:
        fs.delete(jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(f"{base}/{name}")), False)


def write_new_text(spark: SparkSession, path: str, text: str) -> None:
    """Write a small text file that must not exist yet; readers never see it half written."""
    fs, target = _fs(spark, path)
    _, draft = _fs(spark, f"{os.path.dirname(path)}/.draft-{uuid.uuid4().hex}")
    if fs.exists(target):
        raise BehindLog(f"{path} exists already: another writer moved this history on")
    out = fs.create(draft, False)
    try:
        out.write(bytearray(text, "utf-8"))
    finally:
        out.close()
    if fs.exists(target) or not fs.rename(draft, target):
        fs.delete(draft, False)
        raise BehindLog(f"{path} exists already: another writer moved this history on")


def data_files(spark: SparkSession, paths: list[str], pattern: str = "*.parquet") -> DataFrame:
    """One row (path, file, length) per file below `paths`; the content is never read."""
    return (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", pattern)
        .load(paths)
        .select("path", file_name().alias("file"), "length")
    )


def bytes_setting(spark: SparkSession, name: str) -> int:
    """A size setting of the session, such as 128MB, in bytes."""
    value = spark.conf.get(name)
    return spark.sparkContext._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(value)


def size_of(spark: SparkSession, paths: list[str], pattern: str = "*.parquet") -> tuple[int, int]:
    """(number of files, bytes) below `paths`."""
    if not paths:
        return 0, 0
    row = data_files(spark, paths, pattern).agg(
        F.count(F.lit(1)).alias("files"), F.coalesce(F.sum("length"), F.lit(0)).alias("bytes")
    ).first()
    return row["files"], row["bytes"]


def work_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder named by spark.checkpoint.dir.

    Where the setting is absent (local tests) a new local temporary folder is used.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get(
        "spark.checkpoint.dir"
    )
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        base = tempfile.mkdtemp(prefix="tidemark-")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"
