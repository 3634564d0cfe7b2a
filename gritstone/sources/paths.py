"""Small files in any store that Spark reaches, by Hadoop's file system."""

from __future__ import annotations

import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


def _path(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def path_exists(spark: SparkSession, path: str) -> bool:
    p, fs = _path(spark, path)
    return fs.exists(p)


def names_in(spark: SparkSession, folder: str) -> dict[str, float]:
    """Names in a folder with the seconds since the epoch of their last change; none if there is no such folder."""
    p, fs = _path(spark, folder)
    return {s.getPath().getName(): s.getModificationTime() / 1000 for s in fs.listStatus(p)} if fs.exists(p) else {}


def read_text(spark: SparkSession, path: str) -> str:
    p, fs = _path(spark, path)
    stream = fs.open(p)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def put_text(spark: SparkSession, path: str, text: str) -> bool:
    """Writes a file whole, in one step, unless there is one; says whether it did."""
    target, fs = _path(spark, path)
    own, _ = _path(spark, f"{path}.{uuid.uuid4().hex}.tmp")
    out = fs.create(own, True)
    out.write(bytearray(text.encode()))
    out.close()
    fs_package = spark._jvm.org.apache.hadoop.fs
    context = fs_package.FileContext.getFileContext(fs.getUri(), spark._jsc.hadoopConfiguration())
    try:
        context.rename(own, target, spark.sparkContext._gateway.new_array(getattr(fs_package, "Options$Rename"), 0))
        return True
    except Py4JJavaError as e:
        fs.delete(own, False)
        if "FileAlreadyExistsException" in str(e.java_exception):
            return False
        raise


def delete(spark: SparkSession, path: str) -> None:
    p, fs = _path(spark, path)
    fs.delete(p, True)
