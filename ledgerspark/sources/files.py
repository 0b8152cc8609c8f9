"""Finding out what lies under a path, in any store that Spark reads."""

import re

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession


def read_if_there(build) -> DataFrame | None:
    """The DataFrame ``build`` returns, or ``None`` when its path does not exist (yet)."""
    try:
        return build()
    except AnalysisException as error:
        if error.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise


def file_system(spark: SparkSession, root: str):
    """The store of ``root`` and its path type."""
    folder = spark._jvm.org.apache.hadoop.fs.Path
    return folder(root).getFileSystem(spark._jsc.hadoopConfiguration()), folder


def finished_versions(spark: SparkSession, root: str) -> list[int]:
    """The ``version=N`` folders under ``root`` that hold a finished write, newest first.

    Only the version folders are listed. ``_SUCCESS`` tells that a write came to its end; Spark's
    readers hide it, so the file system is asked.
    """
    files, folder = file_system(spark, root)
    if not files.exists(folder(root)):
        return []
    names = (re.fullmatch(r"version=(\d+)", status.getPath().getName()) for status in files.listStatus(folder(root)))
    versions = sorted((int(m.group(1)) for m in names if m), reverse=True)
    return [v for v in versions if is_finished(spark, f"{root}/version={v}")]


def is_finished(spark: SparkSession, path: str) -> bool:
    """Did the write of this folder come to its end?"""
    files, folder = file_system(spark, path)
    return files.exists(folder(f"{path}/_SUCCESS"))


def newest_version(spark: SparkSession, root: str) -> int | None:
    """Highest version of the table that holds a finished write."""
    return next(iter(finished_versions(spark, root)), None)


def delete_folder(spark: SparkSession, path: str) -> None:
    files, folder = file_system(spark, path)
    files.delete(folder(path), True)


def move_folder(spark: SparkSession, source: str, target: str) -> bool:
    """Rename a finished folder to a name that must be free; False if somebody else has it.

    The rename is the claim: HDFS and local disks let one of two writers win. A local rename that loses
    the race may put the folder inside the target instead, so the folder's own mark is looked for.
    """
    files, folder = file_system(spark, source)
    mark = f"_claim-{source.rsplit('/', 1)[-1].lstrip('_')}"
    files.createNewFile(folder(f"{source}/{mark}"))
    hadoop = spark._jvm.org.apache.hadoop.fs
    context = hadoop.FileContext.getFileContext(folder(source).toUri(), spark._jsc.hadoopConfiguration())
    plain = spark.sparkContext._gateway.new_array(getattr(hadoop, "Options$Rename"), 0)
    try:
        context.rename(files.makeQualified(folder(source)), files.makeQualified(folder(target)), plain)
    except Py4JJavaError as error:
        if "FileAlreadyExistsException" in str(error.java_exception.getClass().getName()):
            return False
        raise
    return files.exists(folder(f"{target}/{mark}"))
