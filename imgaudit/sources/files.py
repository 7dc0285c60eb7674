"""Small file-system calls on any Hadoop file system."""

from __future__ import annotations

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


def _open(spark: SparkSession, path: str):
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), target


def exists(spark: SparkSession, path: str) -> bool:
    system, target = _open(spark, path)
    return system.exists(target)


def is_folder(spark: SparkSession, path: str) -> bool:
    system, target = _open(spark, path)
    return system.exists(target) and system.getFileStatus(target).isDirectory()


def names(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder; empty if it is not there."""
    system, target = _open(spark, path)
    return [s.getPath().getName() for s in system.listStatus(target)] if system.exists(target) else []


def matches(spark: SparkSession, pattern: str) -> list[str]:
    """Full paths that a path or a pattern names; empty if there are none."""
    system, target = _open(spark, pattern)
    return [s.getPath().toString() for s in system.globStatus(target) or []]


def remove(spark: SparkSession, path: str) -> None:
    system, target = _open(spark, path)
    system.delete(target, True)


def create_new(spark: SparkSession, path: str, text: str) -> bool:
    """Create a small file unless it is there, in one step; whether this call made it.

    Cluster file systems refuse a second creation themselves. For local files the check and the
    creation would be two steps, so Java's own one-step creation is used.
    """
    system, target = _open(spark, path)
    jvm, gateway = spark.sparkContext._jvm, spark.sparkContext._gateway
    system.mkdirs(target.getParent())
    data = bytearray(text.encode())
    try:
        if system.getScheme() == "file":
            options = gateway.new_array(jvm.java.nio.file.OpenOption, 2)
            options[0] = jvm.java.nio.file.StandardOpenOption.CREATE_NEW
            options[1] = jvm.java.nio.file.StandardOpenOption.WRITE
            jvm.java.nio.file.Files.write(jvm.java.io.File(target.toUri().getPath()).toPath(), data, options)
        else:
            stream = system.create(target, False)
            stream.write(data)
            stream.close()
    except Py4JJavaError as error:
        if "AlreadyExists" in error.java_exception.getClass().getName():
            return False
        raise
    return True


def read_text(spark: SparkSession, path: str) -> str | None:
    """A small file's text; None if it is not there."""
    system, target = _open(spark, path)
    try:
        stream = system.open(target)
    except Py4JJavaError:
        return None
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()


def modified(spark: SparkSession, path: str) -> int | None:
    """When a file was last written or touched, in milliseconds; None if it is not there."""
    system, target = _open(spark, path)
    try:
        return system.getFileStatus(target).getModificationTime()
    except Py4JJavaError:
        return None


def touch(spark: SparkSession, path: str, millis: int) -> None:
    system, target = _open(spark, path)
    system.setTimes(target, millis, -1)


def rename(spark: SparkSession, path: str, to: str) -> bool:
    """Move a file or a folder; false if it is gone, or if something has the new name."""
    system, source = _open(spark, path)
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(to)
    if not system.exists(source) or system.exists(target):
        return False
    try:
        return system.rename(source, target)
    except Py4JJavaError:
        return False
