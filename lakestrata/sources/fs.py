"""Small driver-side file helpers over the Hadoop FileSystem API (names and metadata only)."""

from __future__ import annotations

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


def _resolve(spark: SparkSession, path: str):
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jpath.getFileSystem(spark._jsc.hadoopConfiguration()), jpath


def exists(spark: SparkSession, path: str) -> bool:
    files, jpath = _resolve(spark, path)
    return files.exists(jpath)


def names(spark: SparkSession, path: str) -> list[str]:
    """Names of the direct children of a folder; empty when there is no such folder."""
    files, jpath = _resolve(spark, path)
    if not files.exists(jpath):
        return []
    return sorted(status.getPath().getName() for status in files.listStatus(jpath))


def size(spark: SparkSession, path: str) -> int:
    """Bytes of all files below a folder."""
    files, jpath = _resolve(spark, path)
    return files.getContentSummary(jpath).getLength()


def read_text(spark: SparkSession, path: str) -> str:
    files, jpath = _resolve(spark, path)
    stream = files.open(jpath)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """Write a small file that appears under its name only when complete."""
    files, jpath = _resolve(spark, path)
    _, partial = _resolve(spark, f"{path}.partial")
    stream = files.create(partial, True)
    try:
        stream.write(bytearray(text.encode("utf-8")))
    finally:
        stream.close()
    if not files.rename(partial, jpath):
        raise OSError(f"could not publish {path}")


def claim(spark: SparkSession, path: str) -> bool:
    """Create an empty file unless there is one; of several writers one succeeds."""
    files, jpath = _resolve(spark, path)
    files.mkdirs(jpath.getParent())
    if files.getScheme() == "file":
        # Hadoop's local files look first and create then
        return bool(spark._jvm.java.io.File(jpath.toUri().getPath()).createNewFile())
    try:
        files.create(jpath, False).close()
    except Py4JJavaError:
        if files.exists(jpath):
            return False
        raise
    return True


def delete(spark: SparkSession, path: str) -> None:
    files, jpath = _resolve(spark, path)
    files.delete(jpath, True)
