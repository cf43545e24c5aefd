"""Small files and folders on whatever file system Spark writes to."""

from __future__ import annotations

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


def _path(spark: SparkSession, path: str):
    return spark._jvm.org.apache.hadoop.fs.Path(path)


def _system(spark: SparkSession, path: str):
    return _path(spark, path).getFileSystem(spark._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    return _system(spark, path).exists(_path(spark, path))


def remove(spark: SparkSession, path: str) -> None:
    _system(spark, path).delete(_path(spark, path), True)


def listed(spark: SparkSession, path: str) -> dict[str, int]:
    """Names in a folder with the milliseconds they were last changed at; none of a missing one."""
    if not exists(spark, path):
        return {}
    found = _system(spark, path).listStatus(_path(spark, path))
    return {f.getPath().getName(): f.getModificationTime() for f in found}


def read_text(spark: SparkSession, path: str) -> str:
    stream = _system(spark, path).open(_path(spark, path))
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def write_text(spark: SparkSession, path: str, text: str) -> None:
    stream = _system(spark, path).create(_path(spark, path), True)
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()


def rename(spark: SparkSession, old: str, new: str) -> bool:
    """Move ``old`` to ``new``, whose folder exists. False if there is something at ``new``."""
    fs = spark._jvm.org.apache.hadoop.fs
    context = fs.FileContext.getFileContext(
        _system(spark, old).getUri(), spark._jsc.hadoopConfiguration()
    )
    none = spark.sparkContext._gateway.new_array(fs.Options.Rename, 0)
    try:
        context.rename(_path(spark, old), _path(spark, new), none)
    except Py4JJavaError as error:
        if error.java_exception.getClass().getSimpleName() == "FileAlreadyExistsException":
            return False
        raise
    return True


def replace(spark: SparkSession, old: str, new: str) -> None:
    """Put the folder ``old`` in the place of ``new``."""
    remove(spark, new)
    if not rename(spark, old, new):
        raise FileExistsError(new)
