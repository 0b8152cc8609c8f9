"""Cutting lineage through the folder the cluster shares."""

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

# Spark removes the shuffle files of an execution at its end where this is set; else they stay until the driver collects garbage.
_FREE = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``, which every executor can reach.

    Only a local session without that setting gets a temporary folder; on a cluster the
    setting has to be there.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
    folder = tempfile.mkdtemp(prefix="run-")
    spark.sparkContext.setCheckpointDir(folder)
    return folder


@contextmanager
def _freeing(spark: SparkSession) -> Iterator[None]:
    before = spark.conf.get(_FREE, None)
    spark.conf.set(_FREE, "true")
    try:
        yield
    finally:
        spark.conf.unset(_FREE) if before is None else spark.conf.set(_FREE, before)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and go on from the stored rows.

    Unlike a checkpoint the rows are computed only once and later steps read just the
    columns they use. A lost executor costs no recomputation of what came before. The
    shuffle files that the rows came from are removed once they are stored.
    """
    path = f"{shared_folder(df.sparkSession)}/{uuid.uuid4()}"
    with _freeing(df.sparkSession):
        df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
