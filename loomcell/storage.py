"""Folders that the driver and all executors share, and files of any Hadoop file system."""

from __future__ import annotations

import re
import tempfile
import uuid
from urllib.parse import quote

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir.

    Where it is unset, a temporary one of this machine, but only if the whole job runs on
    this machine; on a cluster executors would write to different disks, so that is an error.
    """
    context = spark.sparkContext
    path = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not re.fullmatch(r"local(\[[^\]]*\])?", context.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        path = f"file://{tempfile.mkdtemp(prefix='loomcell-')}"
        spark.conf.set("spark.checkpoint.dir", path)
    return path


def _folder(spark: SparkSession, path: str):
    """A Hadoop path and its file system."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write a DataFrame to the shared folder and read it again.

    Lineage ends at the files, so a lost executor costs no upstream work, and the
    file sizes give the planner true statistics.  The folder goes when ``discard`` is
    called, or else when the driver ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{quote(label)}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    where, files = _folder(spark, path)
    files.deleteOnExit(where)
    out = spark.read.schema(df.schema).parquet(path)
    out._lc_path = path
    return out


def discard(*written: DataFrame) -> None:
    """Delete what ``materialise`` wrote; nothing that still reads it may run afterwards."""
    for df in written:
        where, files = _folder(df.sparkSession, df._lc_path)
        files.delete(where, True)
        files.cancelDeleteOnExit(where)


def delete(spark: SparkSession, path: str) -> None:
    where, files = _folder(spark, path)
    files.delete(where, True)


def scratch(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder, deleted when the driver ends."""
    path = f"{shared_dir(spark)}/{quote(label)}-{uuid.uuid4().hex}"
    where, files = _folder(spark, path)
    files.mkdirs(where)
    files.deleteOnExit(where)
    return path


def parts(spark: SparkSession, path: str) -> list[str]:
    """The data files of a folder, by name."""
    where, files = _folder(spark, path)
    found = [s.getPath() for s in files.listStatus(where)]
    return [p.toString() for p in sorted(found, key=lambda p: p.getName()) if not p.getName().startswith(("_", "."))]


def join_files(spark: SparkSession, folder: str, path: str, header: str = "") -> str:
    """One file of a header and all files of a folder, in the order of their names; bytes pass through the driver in small buffers."""
    where, files = _folder(spark, path)
    files.setWriteChecksum(False)
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    out = files.create(where, True)
    try:
        out.write(bytearray(header.encode()))
        for part in parts(spark, folder):
            one, there = _folder(spark, part)
            into = there.open(one)
            try:
                jvm.org.apache.hadoop.io.IOUtils.copyBytes(into, out, conf, False)
            finally:
                into.close()
    finally:
        out.close()
    return path


def append_line(spark: SparkSession, path: str, line: str) -> None:
    """Add a line to a file, by writing it anew with all that it holds: not every file system can append."""
    where, files = _folder(spark, path)
    files.setWriteChecksum(False)
    held = "".join(f"{r[0]}\n" for r in spark.read.text(path).toLocalIterator()) if files.exists(where) else ""
    out = files.create(where, True)
    try:
        out.write(bytearray(f"{held}{line}\n".encode()))
    finally:
        out.close()
